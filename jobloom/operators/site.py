"""The site table, its order and its metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import dates, pay, text
from .merge import require_id

LOCATION_FACETS = 40
REPORT_ROWS = 10


def _col(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit("")


def to_site(master: DataFrame, keep: tuple[str, ...] = ("source_rank", "ord")) -> DataFrame:
    """Master rows as site rows: one narrow projection, rows without an id dropped."""
    c = lambda name: _col(master, name)
    job_id = text.clean(text.first_non_empty(c("job_id"), c("posting_number")))
    source = text.clean(c("source"))
    cleaned = require_id(master.select(
        *[k for k in keep if k in master.columns],
        job_id.alias("id"),
        text.clean(text.first_non_empty(c("job_title"), c("working_title"))).alias("title"),
        text.clean(c("institution")).alias("institution"),
        text.clean(c("department")).alias("dept_raw"),
        text.clean(c("location")).alias("location"),
        text.strip(c("posted_date")).alias("posted_raw"),
        text.strip(c("close_date")).alias("closes_raw"),
        text.clean(c("full_part_time")).alias("fpt"),
        text.clean(c("regular_temporary")).alias("rt"),
        text.clean(c("salary")).alias("pay_raw"),
        text.clean(c("extra_sections")).alias("extra"),
        text.clean(c("other_information")).alias("other"),
        text.clean(c("job_summary")).alias("job_summary"),
        text.clean(c("position_summary")).alias("position_summary"),
        (F.coalesce(c("job_summary"), F.lit("")) != "").alias("has_summary"),
        text.clean(c("responsibilities")).alias("resp"),
        text.clean(c("apply_link")).alias("apply_raw"),
        text.clean(c("posting_url")).alias("posting_url"),
        source.alias("source"),
    ), "id")
    summary = F.when(F.col("has_summary"), F.col("job_summary")).otherwise(F.col("position_summary"))
    cleaned = cleaned.withColumn("summary_raw", text.fill_short(summary, "resp"))
    priced = pay.add_pay(cleaned, "salary", "pay_raw", "extra", "dept_raw", "source",
                         "other", "extra", "job_summary", "resp")
    return priced.select(
        *[k for k in keep if k in master.columns],
        "id", "title", "institution",
        F.when(text.is_garbled("dept_raw"), "").otherwise(F.col("dept_raw")).alias("department"),
        "location",
        text.is_remote("location").alias("remote"),
        dates.parse_date("posted_raw", stripped=True).alias("posted"),
        dates.parse_date("closes_raw", stripped=True).alias("closes"),
        text.first_non_empty(text.norm_full_part("fpt"), pay.blob_type("dept_raw", "source")).alias("type"),
        text.norm_regular_temp("rt").alias("employment"),
        "salary",
        pay.pay_type("salary").alias("salary_type"),
        text.cut("summary_raw", 700).alias("summary"),
        text.view_link("posting_url", text.whole_link("apply_raw", "posting_url")).alias("view"),
        text.whole_link("apply_raw", "posting_url").alias("apply"),
        "source",
    )


def posted_key(posted: Column | None = None) -> Column:
    """Sort key: undated rows order as the oldest."""
    return F.coalesce(text.non_empty(F.col("posted") if posted is None else posted), F.lit("0000-00-00"))


def _input_order(df: DataFrame) -> list[str]:
    """The columns that tell the order of input: source first, then place in the source."""
    return [c for c in ("source_rank", "ord") if c in df.columns]


def newest_order(df: DataFrame) -> list[Column]:
    return [posted_key().desc(), *[F.col(c).asc() for c in _input_order(df)]]


def newest_first(site: DataFrame) -> DataFrame:
    """Newest first, undated last, ties in input order (range sort on all of it)."""
    return site.orderBy(*newest_order(site))


def newest_site(master: DataFrame) -> DataFrame:
    """`newest_first(to_site(master))` with the sort below the text work.

    A range sort looks at its input twice; sorting the plain master rows by their
    parsed date keeps the costly expressions out of that.
    """
    day = posted_key(dates.parse_date("posted_date"))
    return to_site(master.orderBy(day.desc(), *_input_order(master)))


def _facets(site: DataFrame, column: str, n: int | None = None, blanks: bool = False) -> DataFrame:
    """Values by frequency, with the day and place of their first newest-first appearance.

    Partial aggregation per (value, day, source), then per (value, day), then per value:
    a value that owns most rows reaches its task as a few rows per map task.
    """
    value, rank = F.col(column).alias("value"), (["source_rank"] if "source_rank" in site.columns else [])
    rows = site if blanks else site.where(F.col(column) != "")
    daily = rows.groupBy(value, posted_key().alias("_day"), *rank).agg(F.count("*").alias("_n"), F.min("ord").alias("ord"))
    if rank:
        daily = daily.groupBy("value", "_day").agg(F.sum("_n").alias("_n"), F.min(F.struct(*rank, "ord")).alias("ord"))
    values = daily.groupBy("value").agg(
        F.sum("_n").alias("count"), F.max("_day").alias("_day"), F.max_by("ord", "_day").alias("_ord"))
    ranked = values.orderBy(F.desc("count"), F.desc("_day"), F.asc("_ord"))
    return ranked if n is None else ranked.limit(n)


def facet_values(site: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """`(value, count)` by frequency; ties by first appearance in newest-first order."""
    return _facets(site, column, n).select("value", "count")


def top_institutions(site: DataFrame, n: int = REPORT_ROWS) -> DataFrame:
    """The n most frequent institutions, a blank one included; ties as in `facet_values`."""
    top = _facets(site, "institution", n, blanks=True)
    return top.select(F.col("value").alias("institution"), F.col("count").alias("jobs"))


def quality_by_source(site: DataFrame) -> DataFrame:
    filled = lambda c: F.count_if(F.col(c) != "")
    return site.groupBy("source").agg(
        F.count("*").alias("n"), filled("salary").alias("with_salary"), filled("type").alias("with_type"),
        filled("employment").alias("with_employment"), filled("posted").alias("with_date"))


def _in_order(kind: str) -> Column:
    """Aggregate: the values of one facet kind, in facet order."""
    entry = F.struct((-F.col("count")).alias("c"), F.col("_day").alias("day"), F.col("_ord").alias("ord"),
                     F.col("value").alias("value"))
    order = lambda a, b: (
        F.when(a["c"] < b["c"], -1).when(a["c"] > b["c"], 1)
        .when(a["day"] > b["day"], -1).when(a["day"] < b["day"], 1)
        .when(a["ord"] < b["ord"], -1).otherwise(1))
    entries = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, entry)), order)
    return F.transform(entries, lambda e: e["value"])


def site_meta(site: DataFrame, last_updated: str | None = None) -> DataFrame:
    """One row: day of the run (UTC), number of jobs, institution and location lists.

    The institution list is one array of one row; `facet_values` has the same as a table, for sites
    with more institutions than a row should hold.
    """
    institutions = _facets(site, "institution")
    locations = _facets(site, "location", LOCATION_FACETS)
    total = site.agg(F.count("*").alias("count"))
    facts = (institutions.withColumn("kind", F.lit("institution"))
             .unionByName(locations.withColumn("kind", F.lit("location")))
             .unionByName(total.withColumn("kind", F.lit("total")), allowMissingColumns=True))
    day = (F.lit(last_updated) if last_updated
           else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd"))
    return facts.agg(
        F.max(F.when(F.col("kind") == "total", F.col("count"))).alias("total"),
        _in_order("institution").alias("institutions"),
        _in_order("location").alias("locations"),
    ).select(day.alias("last_updated"), "total", "institutions", "locations")
