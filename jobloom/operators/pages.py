"""Page tables to blocks, pairs, links, cards and postings.

A page is one row, and all it yields is computed inside that row (no shuffle).
Only the join with listing cards moves data, once, by page id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import html as H, labels as L, text as X
from ..schemas import INSTITUTIONS, S0_COLUMNS, SECTION_COLUMNS, SOURCES, strings
from .keyed import one_per_key
from .mapping import conform
from .merge import enrich_listing

# ---------------------------------------------------------------------------
# Span ids of listing and detail pages, default place of one portal.
# ---------------------------------------------------------------------------

CARD_SPANS = {
    "job_id": "HRS_APP_JBSCH_I_HRS_JOB_OPENING_ID$",
    "job_title": "SCH_JOB_TITLE$",
    "institution": "HRS_BU_DESCR$",
    "department": "HRS_APP_JBSCH_I_HRS_DEPT_DESCR$",
    "location": "LOCATION$",
    "posted_date": "SCH_OPENED$",
}
DETAIL_SPANS = {
    "job_title": "HRS_SCH_WRK2_POSTING_TITLE",
    "job_id": "HRS_SCH_WRK2_HRS_JOB_OPENING_ID",
    "location_detail": "HRS_SCH_WRK_HRS_DESCRLONG",
    "full_part_time": "HRS_SCH_WRK_HRS_FULL_PART_TIME",
    "regular_temporary": "HRS_SCH_WRK_HRS_REG_TEMP",
}
LABEL_SPAN, LABEL_SUFFIX = "HRS_SCH_WRK_DESCR100$", "lbl"
CONTENT_SPAN = "HRS_SCH_PSTDSC_DESCRLONG$"
DEFAULT_PLACE = "Atlanta, Georgia"

_SPAN_IDS = r"^(?:SCH_|HRS_|LOCATION\$)"


def _rows(df: DataFrame, array: Column, *names: str) -> DataFrame:
    """One row per array entry: `(page_id, ord, names...)`."""
    long = df.select("page_id", F.posexplode(array).alias("ord", "e"))
    return long.select("page_id", "ord", *[F.col("e")[n].alias(n) for n in names])


def page_blocks(pages: DataFrame) -> DataFrame:
    kept = F.filter(H.blocks("html"), lambda b: b["text"] != "")
    return _rows(pages, kept, "tag", "text")


def page_label_values(pages: DataFrame, kind: str = "table") -> DataFrame:
    """`(page_id, ord, label, value)` from `table` (th/td), `cells` (two-cell rows) or `list` (dt/dd)."""
    pairs, spaces = _PAIRS[kind]
    return _rows(pages, H.normalised(pairs("html"), spaces), "label", "value")


_PAIRS = {"table": (H.table_pairs, False), "cells": (H.cell_pairs, True), "list": (H.list_pairs, True)}


def page_links(pages: DataFrame, path: str = "") -> DataFrame:
    return _rows(pages, H.links("html", path), "href", "text")


def drop_pager_links(links: DataFrame) -> DataFrame:
    return links.where(~H.is_pager_text("text"))


def apply_link(html, page_url, base: str, path: str = r"(?i)/pre_apply|/apply") -> Column:
    """The first matching link, made absolute; else the page itself."""
    href = F.get(H.links(html, path), F.lit(0))["href"]
    return X.let(href, lambda h: F.coalesce(X.absolute_url(base, h), X.col(page_url)))


# --- numbered spans ----------------------------------------------------------------

def _with_spans(pages: DataFrame) -> DataFrame:
    return pages.withColumn("spans", H.id_spans("html", _SPAN_IDS))


def _numbered(spans: Column, most: int | None = None) -> Column:
    """`(label, value)` of the numbered sections up to the first gap."""
    sections = H.numbered(spans, [(LABEL_SPAN, LABEL_SUFFIX), (CONTENT_SPAN, "")], most)
    return F.transform(sections, lambda s: F.struct(F.get(s, F.lit(0)).alias("label"), F.get(s, F.lit(1)).alias("value")))


def page_indexed_fields(pages: DataFrame, most: int | None = None) -> DataFrame:
    """Numbered section labels and contents as long rows, boilerplate included; at most `most` a page if given."""
    return _rows(_with_spans(pages), _numbered(F.col("spans"), most), "label", "value")


def postings_from_spans(pages: DataFrame, columns: list[str]) -> DataFrame:
    """Detail fields of span pages: the last section of a column wins, others are packed."""
    df = _with_spans(pages).withColumn("sections", F.filter(
        _numbered(F.col("spans")),
        lambda s: (s["value"] != "") & ~F.lower(s["label"]).isin(L.SKIPPED_SECTIONS)))
    df = df.withColumn("sections", F.transform("sections", lambda s: F.struct(
        L.resolve_rules(F.lower(s["label"]), L.SECTION_LABELS, L.SECTION_RULES).alias("field"),
        s["label"].alias("label"), s["value"].alias("value"))))

    def column(name: str) -> Column:
        if name in DETAIL_SPANS:
            return F.coalesce(H.span_value(F.col("spans"), DETAIL_SPANS[name]), F.lit(""))
        if name == "extra_sections":
            return _packed("sections")
        hits = F.filter("sections", lambda s: s["field"] == name)
        return F.coalesce(F.get(F.reverse(hits), F.lit(0))["value"], F.lit(""))

    detail = [c for c in columns if c in DETAIL_SPANS or c == "extra_sections" or c in SECTION_COLUMNS
              or c == "salary"]
    return df.select("page_id", *[column(c).alias(c) for c in detail])


def _packed(sections: str) -> Column:
    rest = F.filter(sections, lambda s: s["field"].isNull())
    return F.concat_ws(" || ", F.transform(rest, lambda s: F.concat(
        F.lit("["), s["label"], F.lit("] "), s["value"])))


# --- th/td pages ---------------------------------------------------------------------

def _duties(pairs: Column) -> Column:
    """Duty rows of one page in order, each with the shares that follow it."""
    def joined(kept: Column) -> Column:
        duties = F.filter(F.transform(kept, lambda p, i: F.when(p["label"] == L.DUTY_LABEL, i)),
                          lambda i: i.isNotNull())
        return X.let(F.coalesce(F.get(duties, F.lit(0)), F.size(kept)), lambda first: F.concat_ws("", F.transform(
            kept, lambda p, i: F.when(i == first, p["value"])
            .when(p["label"] == L.DUTY_LABEL, F.concat(F.lit(" | "), p["value"]))
            .when(i > first, F.concat(F.lit("  ["), p["value"], F.lit("% of time]"))))))

    return X.let(F.filter(pairs, lambda p: p["label"].isin(L.DUTY_LABEL, L.DUTY_SHARE_LABEL)), joined)


def postings_from_tables(pages: DataFrame, base: str) -> DataFrame:
    """Detail fields of th/td pages: first non-blank value per column, duties joined."""
    df = pages.withColumn("pairs", H.normalised(H.table_pairs("html")))
    df = df.withColumn("pairs", F.transform("pairs", lambda p: F.struct(
        L.resolve_rules(p["label"], L.TABLE_LABELS, L.TABLE_RULES).alias("field"),
        p["label"].alias("label"), p["value"].alias("value"))))
    df = df.withColumn("plain", F.filter("pairs", lambda p: ~p["label"].isin(L.DUTY_LABEL, L.DUTY_SHARE_LABEL)))

    def column(name: str) -> Column:
        hit = F.get(F.filter("plain", lambda p: p["field"] == name), F.lit(0))["value"]
        if name == "duties_responsibilities":
            hit = _duties(F.col("pairs"))
        if name == "apply_link":
            hit = apply_link("html", "url", base)
        return F.coalesce(hit, F.lit("")).alias(name)

    return df.select("page_id", *[column(c) for c in S0_COLUMNS if c not in ("posting_url", "scraped_at")])


# --- section pages -------------------------------------------------------------------

def _resolved_sections(html) -> Column:
    """`(field, label, value)` per section; text without a heading counts as summary, and so does all
    the text of a page without any section."""
    def resolve(s: Column) -> Column:
        key = F.regexp_replace(F.lower(s["heading"]), r"^[: ]+|[: ]+\z", "")
        field = F.coalesce(L.resolve_exact(key, L.HEADING_LABELS),
                           F.when(s["heading"] == "", "job_summary"))
        return F.struct(field.alias("field"), s["heading"].alias("label"), s["content"].alias("value"))

    whole = F.struct(F.lit("job_summary").alias("field"), F.lit("").alias("label"), H.text_of(H.without_noise(html)).alias("value"))
    return X.let(F.transform(H.sections(H.blocks(html)), resolve), lambda found: F.when(F.size(found) > 0, found).otherwise(
        F.filter(F.array(whole), lambda s: s["value"] != "")))


def _appended(sections, name: str) -> Column:
    hits = F.filter(sections, lambda s: s["field"] == name)
    return F.concat_ws(" ", F.transform(hits, lambda s: s["value"]))


def page_sections(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Sections by heading; repeated columns append, unknown headings are packed."""
    df = pages.withColumn("sections", _resolved_sections("html"))
    return df.select("page_id", *keep, *[_appended("sections", c).alias(c) for c in SECTION_COLUMNS],
                     _packed("sections").alias("extra_sections"))


def has_real_content(columns: list[str], marker: str = X.NAV_MARKER) -> Column:
    """Some value is longer than 80 characters and free of the navigation marker."""
    values = F.array(*[F.col(c) for c in columns])
    return F.exists(values, lambda v: (F.length(v) > 80) & ~v.contains(marker))


def _with_groups(pairs: Column, groups) -> Column:
    return F.transform(pairs, lambda p: F.struct(
        p["label"].alias("label"), p["value"].alias("value"), p["cell"].alias("cell"),
        L.classify_keywords(p["label"], groups).alias("group")))


def _grouped(pairs: Column, name: str) -> Column:
    """First non-blank value of a keyword group inside a pair array, or `''`."""
    hits = F.filter(pairs, lambda p: p["group"] == name)
    if name == "close_note":
        return F.concat_ws("  ", F.transform(hits, lambda p: X.close_note(p["value"])))
    return F.coalesce(F.get(hits, F.lit(0))["value"], F.lit(""))


_META = ["department", "location", "full_part_time", "regular_temporary", "posted_date"]


def postings_from_cells(pages: DataFrame) -> DataFrame:
    """Detail fields of two-cell label tables, else of the page's headed sections.

    A row whose label names a section feeds that column; other labels are packed;
    meta labels become short columns. `job_title` is that of the page, unless it is only a heading
    of the portal; a card's title comes before it.
    """
    df = pages.withColumn("pairs", _with_groups(H.normalised(H.cell_pairs("html"), spaces=True), L.TABLE_GROUPS))

    def body(p: Column) -> Column:
        def value(field: Column) -> Column:
            spaced = H.text_of(p["cell"])
            inner = F.when(field.isNotNull() & (field != "salary"), _appended_in(p["cell"], field))
            text = X.let(inner, lambda v: F.when(v != "", v).otherwise(spaced))
            return F.struct(field.alias("field"), H.title_case(p["label"]).alias("label"), text.alias("value"))

        return X.let(L.resolve_exact(p["label"], L.HEADING_LABELS), value)

    df = df.withColumn("cells", F.transform(F.filter("pairs", lambda p: ~L.is_meta_label(p["label"])), body))
    df = df.withColumn("sections", F.when(F.size("cells") > 0, F.col("cells"))
                       .otherwise(_resolved_sections(_main_html())))
    titles = F.transform(F.array(*[H.any_element("html", H.with_class(CELL_TITLE_CLASS)) if tag is None else
                                   H.element("html", tag, H.with_class(CELL_TITLE_CLASS)) for tag in ("span", None, "h1")]),
                         lambda t: H.text_of(t, ""))
    title = F.get(F.filter(titles, lambda t: (t != "") & ~t.rlike(GENERIC_TITLE)), F.lit(0))
    wide = df.select(
        "page_id", (F.size("cells") > 0).alias("from_cells"), F.coalesce(title, F.lit("")).alias("job_title"),
        *[_grouped(F.col("pairs"), c).alias(c) for c in _META],
        _grouped(F.col("pairs"), "close_note").alias("close_note"),
        *[_appended("sections", c).alias(c) for c in SECTION_COLUMNS],
        _appended("sections", "salary").alias("salary"),
        _packed("sections").alias("extra_sections"))
    return _repaired(wide)


# Description containers by id or class, in order; the menu inside the first; the title's class.
MAIN_PARTS = [H.with_id("maincontent"), H.with_id("jobDescriptionInterface"), H.with_id("jobDescriptionText"),
              H.id_like("jobDesc|job_desc|jobDescriptionText"), H.class_like(r"jobDescriptionText|jobDescription\b"),
              H.with_id("requisitionDescriptionInterface"), H.id_like("requisitionDesc")]
MENU_ID = "job_menubar"
CELL_TITLE_CLASS, GENERIC_TITLE = "jobTitle", r"(?i)^Job\s+Description\b"


def _boxed(inner: Column) -> Column:
    """The inner HTML of a chosen division as the division itself: its own text is enclosed."""
    return X.let(inner, lambda v: F.when(v != "", F.concat(F.lit("<div>"), v, F.lit("</div>"))).otherwise(v))


def _after_title(html) -> Column:
    return F.regexp_replace(html, r"(?is)^.*?</h1\s*>", "")


def _main_html() -> Column:
    """The description container without its menu, else all that follows the title."""
    def main(page: Column) -> Column:
        return X.first_of(*[_boxed(H.any_element(page, p)) for p in MAIN_PARTS], _after_title(page))

    def without_menu(html: Column) -> Column:
        return X.let(H.any_element(html, H.with_id(MENU_ID)), lambda menu: F.when(
            menu != "", F.replace(html, menu, F.lit(""))).otherwise(html))

    return X.let(X.let(H.without_noise("html"), main), without_menu)


def _appended_in(cell: Column, field: Column) -> Column:
    return F.concat_ws(" ", F.transform(F.filter(_resolved_sections(cell), lambda s: s["field"] == field),
                                        lambda s: s["value"]))


def _repaired(wide: DataFrame) -> DataFrame:
    """Page chrome out of the summary; the close date goes to the other information."""
    real = F.col("from_cells") | has_real_content([*SECTION_COLUMNS, "extra_sections"])
    kept = wide
    for c in ("about_us", "job_summary"):
        kept = kept.withColumn(c, F.when(F.col("from_cells"), F.col(c)).otherwise(X.strip_nav_marker(c)))
    kept = kept.select("page_id", "from_cells", "job_title", *_META, "salary", "close_note", *[
        F.when(real, F.col(c)).otherwise("").alias(c) for c in [*SECTION_COLUMNS, "extra_sections"]])
    extra, summary = X.promote_section("extra_sections", "job_summary")
    kept = kept.withColumns({
        "extra_sections": F.when(F.col("from_cells"), F.col("extra_sections")).otherwise(extra),
        "job_summary": F.when(F.col("from_cells"), F.col("job_summary")).otherwise(summary)})
    return kept.select(
        "page_id", "job_title", *_META, "salary",
        *[c for c in SECTION_COLUMNS if c != "other_information"],
        X.first_non_empty("other_information", "close_note").alias("other_information"), "extra_sections")


# Classes (or ids) of description parts in order, classes of titles in order.
DESCRIPTION_PARTS = ["posting-description", "job-description", "posting-requirements"]
TITLE_CLASSES = ["posting-header", "job-title"]
APPLY_ID = "apply-button-top"


def postings_from_lists(pages: DataFrame, base: str) -> DataFrame:
    """Detail fields of dt/dd pages with headed sections in the description parts."""
    df = pages.withColumn("page", H.without_noise("html"))
    df = df.withColumn("pairs", _with_groups(H.normalised(H.list_pairs("page"), spaces=True), L.LIST_GROUPS))
    page = F.col("page")
    parts = F.concat_ws(" ", F.filter(F.array(*[
        _boxed(X.first_of(H.any_element(page, H.with_class(p)), H.any_element(page, H.with_id(p))))
        for p in DESCRIPTION_PARTS]), lambda v: v != ""))
    rest = _after_title(F.regexp_replace(page, r"(?is)<dl\b.*?</dl\s*>", " "))
    df = df.withColumn("sections", _resolved_sections(X.first_of(parts, rest)))
    title = X.first_of(
        *[H.text_of(H.element(page, "h1", H.with_class(c)), "") for c in TITLE_CLASSES],
        H.text_of(F.regexp_extract(page, r"(?is)<h1\b[^>]*>(.*?)</h1\s*>", 1), ""),
        H.classed(page, "posting-title"))
    note = _grouped(F.col("pairs"), "close_note")
    first_link = lambda links: F.get(links, F.lit(0))["href"]
    named_apply = F.filter(H.links("page"), lambda a: F.lower(a["text"]) == "apply")
    href = F.coalesce(first_link(H.links(H.any_element(page, H.with_id(APPLY_ID)))),
                      first_link(H.links("page", "/apply")), first_link(named_apply))
    return df.select(
        "page_id", title.alias("job_title"),
        *[_grouped(F.col("pairs"), c).alias(c)
          for c in ("department", "location", "full_part_time", "posted_date")],
        *[_appended("sections", c).alias(c) for c in SECTION_COLUMNS if c != "other_information"],
        X.first_non_empty(_appended("sections", "other_information"), note).alias("other_information"),
        _packed("sections").alias("extra_sections"),
        X.let(href, lambda h: F.coalesce(X.absolute_url(base, h), F.lit(""))).alias("apply_link"))


# --- listings ------------------------------------------------------------------------

def listing_from_spans(pages: DataFrame) -> DataFrame:
    """Cards of a numbered-span listing, up to the first number without a title."""
    # the title comes first: it says how far the numbers run
    names = ["job_title", *[c for c in CARD_SPANS if c != "job_title"]]
    cards = F.transform(H.numbered(F.col("spans"), [(CARD_SPANS[c], "") for c in names]), lambda texts: F.struct(
        *[F.get(texts, F.lit(names.index(c))).alias(c) for c in CARD_SPANS]))
    return _rows(_with_spans(pages), cards, *CARD_SPANS)


def _containers(html, opening: str) -> Column:
    """The page cut at each opening tag that matches; the text before the first is dropped."""
    parts = F.split(H.without_noise(html), rf"(?is)(?={opening})")
    return F.filter(parts, lambda p: p.rlike(rf"(?is)^{opening}"))


def _classed_tag(tag: str, *names: str) -> str:
    checks = "".join(rf"(?=[^>]*\sclass\s*=\s*[\"'](?:[^\"']*\s)?{n}[\s\"'])" for n in names)
    return rf"<{tag}\b{checks}[^>]*>"


def listing_from_table(pages: DataFrame, template: str) -> DataFrame:
    """Cards of a row listing: numeric row id, title link, place, date, labelled department."""
    rows = _containers("html", _classed_tag("tr", "ftlcopy", "ftlrow"))
    named = lambda r, tag, part: H.text_of(F.regexp_extract(
        r, rf"(?is)<{tag}\b[^>]*\sid\s*=\s*[\"'][^\"']*{part}[^\"']*[\"'][^>]*>(.*?)</{tag}\s*>", 1), "")

    def card(r: Column) -> Column:
        job_id = F.regexp_extract(r, r"(?is)<div\b[^>]*\sid\s*=\s*[\"'](\d+)[\"']", 1)
        after = F.regexp_extract(r, r"(?is)<span\b[^>]*>\s*Department\s*Name\s*</span\s*>(.*)", 1)
        texts = F.transform(F.regexp_extract_all(after, F.lit(r"(?is)<span\b[^>]*>(.*?)</span\s*>"), 1),
                            lambda s: H.text_of(s, ""))
        department = F.get(F.filter(texts, lambda t: ~t.isin("", ":", "-", "|")), F.lit(0))
        return F.struct(
            job_id.alias("job_id"), X.detail_url(template, job_id).alias("url"),
            named(r, "a", "reqTitleLink").alias("title"),
            F.coalesce(department, F.lit("")).alias("department"),
            named(r, "span", "reqBasicLocation").alias("location"),
            named(r, "span", "reqPostingDate").alias("posted_date"))

    cards = F.filter(F.transform(rows, card), lambda c: (c["job_id"] != "") & (c["title"] != ""))
    return _rows(pages, cards, "job_id", "url", "title", "department", "location", "posted_date")


def listing_from_cards(pages: DataFrame, base: str) -> DataFrame:
    """Cards of a block listing: title link with an id, department and place by class."""
    opening = "|".join([_classed_tag("div", "row", "posting"), _classed_tag("div", "posting-block"),
                        _classed_tag("article", "posting")])
    blocks = _containers("html", f"(?:{opening})")

    def card(b: Column) -> Column:
        def fields(link: Column) -> Column:
            url = X.absolute_url(base, link["href"])
            return F.struct(X.url_id(url).alias("job_id"), url.alias("url"), link["text"].alias("title"),
                            X.first_of(*[H.classed(b, c) for c in ("department", "unit", "college")]
                                              ).alias("department"),
                            X.first_of(*[H.classed(b, c) for c in ("location", "campus")],
                                              F.lit(DEFAULT_PLACE)).alias("location"))

        return X.let(F.get(H.links(b, "/postings/"), F.lit(0)), fields)

    cards = F.filter(F.transform(blocks, card), lambda c: F.coalesce(c["job_id"], F.lit("")) != "")
    return _rows(pages, cards, "job_id", "url", "title", "department", "location")


def listing_from_columns(pages: DataFrame, base: str) -> DataFrame:
    """Cards of a grid listing: the row's posting link, then four columns by position."""
    rows = _containers("html", _classed_tag("div", "row"))

    def card(r: Column) -> Column:
        cells = F.regexp_extract_all(
            r, F.lit(r"(?is)<div\b[^>]*\sclass\s*=\s*[\"'][^\"']*col-md-2[^\"']*[\"'][^>]*>(.*?)</div\s*>"), 1)
        return X.let(F.struct(F.get(H.links(r, r"^/postings/\d+\z"), F.lit(0)).alias("link"), cells.alias("cells")),
                     lambda found: fields(found["link"], found["cells"]))

    def fields(link: Column, cells: Column) -> Column:
        at = lambda i: F.coalesce(H.text_of(F.get(cells, F.lit(i)), ""), F.lit(""))
        return F.struct(
            X.url_id(link["href"]).alias("posting_id"), X.absolute_url(base, link["href"]).alias("posting_url"),
            link["text"].alias("working_title"), at(1).alias("posting_number"), at(2).alias("department"),
            at(3).alias("position_type"), at(4).alias("close_date"))

    cards = F.filter(F.transform(rows, card), lambda c: F.coalesce(c["posting_id"], F.lit("")) != "")
    return _rows(pages, cards, "posting_id", "posting_url", "working_title", "posting_number",
                 "department", "position_type", "close_date")


def listing_from_links(pages: DataFrame, base: str, path: str = r"/postings/\d+") -> DataFrame:
    """Fallback: every posting link, pager links dropped, first link per url."""
    links = drop_pager_links(page_links(pages, path)).withColumn("url", X.absolute_url(base, F.col("href")))
    first = one_per_key(links, ["url"], ["page_id", "ord"])
    return first.select("page_id", "ord", X.url_id("url").alias("job_id"), "url", F.col("text").alias("title"),
                        F.lit(DEFAULT_PLACE).alias("location"))


# --- whole job -------------------------------------------------------------------------

# Who wins where card and detail both have a value.
CARD_POLICY = {
    "tables": {c: "card" for c in ("working_title", "posting_number", "department", "close_date", "posting_date")},
    "spans": {},
    "cells": {"job_title": "card"},
    "lists": {c: "card" for c in ("department", "location")},
}


def page_to_posting(pages: DataFrame, cards: DataFrame, style: str, **options) -> DataFrame:
    """Full detail job: parse pages, then one row per card, stubs included.

    Cards hold `page_id`, `url` and the listing's columns; both tables have one row
    per `page_id`, which is the only key that moves. Pages are dealt to the join's partitions
    before they are parsed: however few files or row groups they come in, all tasks parse,
    and the parsed rows do not move again.
    """
    parse = {"tables": postings_from_tables, "spans": postings_from_spans, "cells": postings_from_cells,
             "lists": postings_from_lists}[style]
    if "title" in cards.columns:
        cards = cards.withColumnRenamed("title", "job_title")
    rows = enrich_listing(cards, parse(pages.repartition("page_id"), **options), "page_id", CARD_POLICY[style], url="url")
    if style == "tables":  # this portal's rows get an apply link only from a page
        rows = rows.withColumn("apply_link", F.when(F.col("stub"), "").otherwise(F.col("apply_link")))
    if style == "cells":
        rows = rows.withColumn("job_summary", X.strip_header("job_summary", "job_title"))
    return rows


def to_source(postings: DataFrame, key: str, scraped_at: str | None = None,
              keep: tuple[str, ...] = ("page_id", "stub")) -> DataFrame:
    """Postings in the columns of source `key`, stamped with the time of the run."""
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()),
                        "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    rows = postings.withColumn("scraped_at", now if scraped_at is None else F.lit(scraped_at))
    if SOURCES[key].institution == "constant" and "institution" in SOURCES[key].columns:
        rows = rows.withColumn("institution", F.lit(INSTITUTIONS[key]))
    return conform(rows, strings(SOURCES[key].columns), keep=keep)
