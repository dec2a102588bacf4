"""Counts, gates and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import html as H
from ..functions.text import strip, words

# Titles that show a listing was read from a page shell.
UNIT_NAMES = [
    "perimeter college",
    "robinson college of business",
    "andrew young school of policy studies",
    "college of arts & sciences",
    "college of arts and sciences",
    "college of education & human development",
    "college of law",
    "graduate studies",
    "honors college",
    "institute for biomedical sciences",
    "nek college of public health",
    "school of public health",
    "georgia state university",
    "georgia state",
    "gsu",
]

# Fixed values: (url parts, portal name), first match wins.
PORTALS = [
    (("taleo.net", "panthtemps"), "Taleo PanthTemps"),
    (("taleo.net",), "Taleo Staff"),
    (("facultycareers",), "Faculty Careers"),
]
UNKNOWN_PORTAL = "Unknown"

# Page acceptance thresholds and markers per portal family.
SPAN_PAGE_CHARS = 10_000
SPAN_PAGE_MARKERS = ["HRS_SCH_WRK2_POSTING_TITLE", "HRS_SCH_PSTDSC_DESCRLONG"]
PLAIN_PAGE_CHARS = 5_000
SHELL_PHRASE = "toggle navigation"


def count_by(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most first, ties in first-seen order."""
    per_source = df.groupBy(column, "source_rank").agg(F.count("*").alias("n"), F.min("ord").alias("ord"))
    counts = per_source.groupBy(column).agg(
        F.sum("n").alias("jobs"), F.min(F.struct("source_rank", "ord")).alias("_first"))
    return counts.orderBy(F.desc("jobs"), "_first").drop("_first")


def loaded_counts(master: DataFrame) -> DataFrame:
    return master.groupBy("source_key").agg(F.count("*").alias("loaded"))


def portal_name(url) -> Column:
    c = F.col(url) if isinstance(url, str) else url
    tests = [F.when(reduce(lambda a, b: a & b, [c.contains(p) for p in parts]), name) for parts, name in PORTALS]
    return F.coalesce(*tests, F.lit(UNKNOWN_PORTAL))


def count_by_portal(df: DataFrame, url: str = "posting_url", name: Column | None = None) -> DataFrame:
    """Rows per portal, sorted by portal name; `name` replaces the default url rules."""
    portal = portal_name(url) if name is None else name
    return df.groupBy(portal.alias("portal")).agg(F.count("*").alias("jobs")).orderBy("portal")


def listing_looks_valid(cards: DataFrame, listing: str, title: str,
                        listings: DataFrame | None = None) -> DataFrame:
    """`(listing, valid)`: false when empty, when a title is a unit name, when one title
    covers more than half the cards, or when more than half have at most two words.

    Counted per (listing, title) first, so a listing with most of the rows arrives
    as its distinct titles only. `listings` adds listings without any card.
    """
    short = words(title) <= 2
    blocked = F.lower(strip(title)).isin(UNIT_NAMES)
    titles = cards.groupBy(listing, title).agg(F.count("*").alias("n"))
    titles = titles.select(listing, "n", blocked.alias("blocked"), short.alias("short"))
    checked = titles.groupBy(listing).agg(
        F.sum("n").alias("n"), F.max("n").alias("top"), F.bool_or("blocked").alias("blocked"),
        F.sum(F.when(F.col("short"), F.col("n")).otherwise(0)).alias("short"))
    checked = checked.select(listing, (~F.col("blocked") & (F.col("top") <= F.col("n") * 0.5)
                                       & (F.col("short") <= F.col("n") * 0.5)).alias("valid"))
    if listings is None:
        return checked
    return (listings.select(listing).distinct().join(checked, listing, "left")
            .select(listing, F.coalesce("valid", F.lit(False)).alias("valid")))


def filled(columns: list[str]) -> Column:
    """Number of non-blank columns."""
    return reduce(lambda a, b: a + b,
                  [F.when(F.coalesce(F.col(c), F.lit("")) != "", 1).otherwise(0) for c in columns])


def fill_rate(df: DataFrame, key: str, columns: list[str], flags: list[str]) -> DataFrame:
    """Per row: filled columns, column count, and whether each key column has a value."""
    has = [(F.coalesce(F.col(c), F.lit("")) != "").alias(f"has_{c}") for c in flags]
    return df.select(key, filled(columns).alias("filled"), F.lit(len(columns)).alias("columns"), *has)


def fill_share(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: share of filled values per column."""
    return df.agg(*[F.avg((F.coalesce(F.col(c), F.lit("")) != "").cast("int")).alias(c) for c in columns])


# --- page gates ------------------------------------------------------------------

def is_complete_page(html, min_chars: int, markers: list[str] | None = None) -> Column:
    c = F.col(html) if isinstance(html, str) else html
    ok = F.length(c) > min_chars
    return ok & reduce(lambda a, b: a | b, [c.contains(m) for m in markers]) if markers else ok


def page_is_complete(pages: DataFrame, min_chars: int = PLAIN_PAGE_CHARS,
                     markers: list[str] | None = None) -> DataFrame:
    return pages.where(is_complete_page("html", min_chars, markers))


def page_is_shell(html, phrase: str = SHELL_PHRASE) -> Column:
    """Only navigation: the opening of the page text starts with, or soon shows, the phrase."""
    start = strip(F.lower(F.substring(H.raw_text(html), 1, 200)))
    return F.substring(start, 1, 100).contains(phrase)
