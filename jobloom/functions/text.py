"""Text, link and label expressions (all JVM-side)."""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import urlsplit

from pyspark.sql import Column, functions as F

# Every Unicode white-space character; the Unicode class alone misses four separators.
WS = r"[\s\x1c-\x1f]"

ELLIPSIS = "\u2026"


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once per row, however often `body` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def contains_any(c: Column, words) -> Column:
    return any_of(c.contains(w) for w in words)


def non_empty(c) -> Column:
    """The value, or null when it is `''`."""
    return F.nullif(col(c), F.lit(""))


def first_of(*cols) -> Column:
    """As `first_non_empty`, for costly page expressions: each is computed exactly once."""
    return F.coalesce(F.get(F.filter(F.array(*[col(c) for c in cols]), lambda v: v != ""), F.lit(0)), F.lit(""))


def first_non_empty(*cols) -> Column:
    return F.coalesce(*[non_empty(c) for c in cols], F.lit(""))


def sql_text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def lookup(table: dict[str, str], key) -> Column:
    """The table's value for `key`, or null."""
    entries = ", ".join(f"{sql_text(k)}, {sql_text(v)}" for k, v in table.items())
    return F.try_element_at(F.expr(f"map({entries})"), col(key))


def clean(c) -> Column:
    """Null to `''`, white-space runs to one space, trimmed."""
    if isinstance(c, str):
        return F.expr(f"trim(regexp_replace(coalesce(`{c}`, ''), {sql_text(f'(?U){WS}+')}, ' '))")
    return F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), rf"(?U){WS}+", " "))


def strip(c) -> Column:
    """Trim Unicode white space; inner white space stays."""
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), rf"(?U)^{WS}+|{WS}+\z", "")


def cut_at_word(c: Column, n: int) -> Column:
    """First n characters, cut back to the last space, with an ellipsis."""
    return F.concat(F.regexp_replace(F.substring(c, 1, n), r" [^ ]*\z", ""), F.lit(ELLIPSIS))


def cut(c, n: int) -> Column:
    """Clean text of at most n characters plus the ellipsis."""
    return F.when(F.length(col(c)) > n, cut_at_word(col(c), n)).otherwise(col(c))


def truncate(c, n: int = 600) -> Column:
    return cut(clean(c), n)


def words(c) -> Column:
    """Number of white-space separated words."""
    s = clean(c)
    return F.when(s == "", 0).otherwise(F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) + 1)


# --- job type ------------------------------------------------------------------

def norm_full_part(c) -> Column:
    v = F.lower(col(c))
    return (F.when(v.contains("full"), "Full-Time").when(v.contains("part"), "Part-Time")
            .otherwise(""))


def norm_regular_temp(c) -> Column:
    v = F.lower(col(c))
    return (F.when(contains_any(v, ["regular", "perm"]), "Regular")
            .when(contains_any(v, ["temp", "contract"]), "Temporary").otherwise(""))


def is_remote(location) -> Column:
    return F.lower(col(location)).contains("remote")


# Openings of known navigation noise, and its numbered form.
NOISE_OPENINGS = [
    "beginning of the main content",
    "return to the home page",
    "- description:",
    "qualifications college/business unit",
]
NOISE_NUMBERED = r"(?U)\b\d{5,}\b.*\bdescription\b"


def is_garbled(c) -> Column:
    low = F.trim(F.lower(col(c)))
    return any_of([low.startswith(p) for p in NOISE_OPENINGS]
                  + [F.substring(low, 1, 80).rlike(NOISE_NUMBERED)])


def fill_short(summary, responsibilities) -> Column:
    """Clean texts: a summary below 100 characters is followed by the responsibilities."""
    s, extra = col(summary), col(responsibilities)
    return F.when((F.length(s) < 100) & (extra != ""), F.trim(F.concat(s, F.lit(" "), extra))).otherwise(s)


def short_summary_fill(summary, responsibilities) -> Column:
    return fill_short(clean(summary), clean(responsibilities))


# --- joining parts ---------------------------------------------------------------

def labelled_concat(parts: list[Column], sep: str = " | ") -> Column:
    """Join the non-empty parts."""
    return F.concat_ws(sep, *[non_empty(p) for p in parts])


def prefixed(label: str, c) -> Column:
    """`label` + value, or `''` when the value is empty; the value is taken as it is."""
    v = F.coalesce(col(c), F.lit(""))
    return F.when(v != "", F.concat(F.lit(label), v)).otherwise("")


def flag_labels(flags: dict[str, str], sep: str = " | ") -> Column:
    """The labels of the columns that say yes (any case, untrimmed)."""
    return labelled_concat([F.when(F.lower(F.coalesce(col(c), F.lit(""))) == "yes", label).otherwise("")
                            for c, label in flags.items()], sep)


def append_note(other, note) -> Column:
    return F.trim(F.concat_ws("  ", non_empty(other), non_empty(note)))


def close_note(c) -> Column:
    return prefixed("Close date: ", c)


def job_text(title, department, summary) -> Column:
    """Text for the encoder: the title counts three times."""
    t, d, s = (non_empty(strip(c)) for c in (title, department, summary))
    return F.concat_ws(" ", t, t, t, d, s)


# --- links -----------------------------------------------------------------------

def whole_link(apply_link, posting_url) -> Column:
    """Clean links: the apply link if it is a whole url, else the posting, else the apply link."""
    a = col(apply_link)
    return F.when(a.startswith("http"), a).otherwise(first_non_empty(posting_url, a))


def fix_link(apply_link, posting_url) -> Column:
    return whole_link(clean(apply_link), clean(posting_url))


def view_link(posting_url, apply_link) -> Column:
    """The posting itself, else where to apply."""
    return first_non_empty(posting_url, apply_link)


def url_id(c, path: str = "/postings/") -> Column:
    """The number that follows `path`; `''` if there is none."""
    return F.regexp_extract(col(c), re.escape(path) + r"(\d+)", 1)


def _without_dots(url: Column, origin: str) -> Column:
    """Resolve `.` and `..` in the path of a url below `origin`."""
    def stacked(path: Column) -> Column:
        parts = F.concat(F.split(path, "/"), F.when(path.rlike(r"/\.\.?\z"), F.array(F.lit(""))).otherwise(F.array()))
        step = lambda done, p: (F.when(p == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1))))
                                .when(p == ".", done).otherwise(F.concat(done, F.array(p))))
        return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")

    tail = F.substr(url, F.lit(len(origin) + 1))
    return F.concat(F.lit(origin), let(F.regexp_extract(tail, r"^[^?#]*", 0), stacked),
                    F.regexp_extract(tail, r"[?#].*", 0))


def absolute_url(base: str, href) -> Column:
    """Resolve `href` against the page at `base`."""
    h = col(href)
    parts = urlsplit(base)
    origin = f"{parts.scheme}://{parts.netloc}"
    folder = origin + (parts.path.rsplit("/", 1)[0] if "/" in parts.path else "")
    page = origin + parts.path
    below = (F.when(h.startswith("/"), F.concat(F.lit(origin), h))
             .otherwise(F.concat(F.lit(folder + "/"), h)))
    return (
        F.when(h.rlike(r"(?i)^[a-z][a-z0-9+.\-]*:"), h)
        .when(h == "", base)
        .when(h.startswith("//"), F.concat(F.lit(parts.scheme + ":"), h))
        .when(h.startswith("?") | h.startswith("#"), F.concat(F.lit(page), h))
        .when(h.rlike(r"(?:^|/)\.\.?(?:/|\z)"), let(below, lambda u: _without_dots(u, origin)))
        .otherwise(below)
    )


def detail_url(template: str, job_id) -> Column:
    """Put an id into a URL template at `{job_id}`."""
    head, tail = template.split("{job_id}")
    return F.concat(F.lit(head), col(job_id), F.lit(tail))


# --- labels ------------------------------------------------------------------------

def norm_label(c, spaces: bool = False) -> Column:
    """Clean, lower-case, without trailing colons (and spaces between them)."""
    return F.regexp_replace(F.lower(clean(c)), r"[: ]+\z" if spaces else r":+\z", "")


def facet_name(c) -> Column:
    return strip(F.regexp_replace(clean(c), r"\s*\(\d+\)\z", ""))


def facet_count(c) -> Column:
    n = F.regexp_extract(clean(c), r"\((\d+)\)\z", 1)
    return F.coalesce(n.try_cast("bigint"), F.lit(0).cast("bigint"))


# --- summary repair ------------------------------------------------------------------

# Page chrome that ends up in a scraped summary.
HEADER_PHRASE = "Georgia State University"
NAV_MARKER = "Beginning of the main content section"
SESSION_PHRASES = [
    "Welcome. You are not signed in",
    "This service is set to disconnect",
    "You have been signed out",
]


def strip_header(summary, title, phrase: str = HEADER_PHRASE) -> Column:
    """Drop a repeated title and a header block, unless little would be left."""
    s, t = col(summary), col(title)
    cut = F.when((t != "") & F.startswith(F.lower(s), F.lower(t)),
                 F.ltrim(F.substr(s, F.length(t) + 1))).otherwise(s)
    at = F.locate(phrase + " ", cut)
    cut = F.when(at.between(1, 400), F.trim(F.substr(cut, at + F.lit(len(phrase) + 1)))).otherwise(cut)
    return F.when(F.length(cut) > 50, cut).otherwise(s)


def strip_nav_marker(c, marker: str = NAV_MARKER) -> Column:
    return F.when(col(c).startswith(marker),
                  strip(F.regexp_replace(col(c), rf"^{re.escape(marker)}\.?\s*", ""))).otherwise(col(c))


def has_session_bar(summary) -> Column:
    return contains_any(F.substring(col(summary), 1, 400), SESSION_PHRASES)


def summary_is_nav(summary) -> Column:
    return (col(summary) == "") | has_session_bar(summary)


_LIFTED = r"(?s)\[Job Description[^\]]*\]\s*(.+?)(?=\s*\|\|\s*\[|\z)"


def _lifted_body(extra: Column) -> Column:
    """Content of the lifted section without its repeated header and label."""
    body = clean(F.regexp_extract(extra, _LIFTED, 1))
    body = strip(F.regexp_replace(body, r"^Job Description\s+.+?\s*[-\u2013]\s*\d+\s*", ""))
    label = r"^(.{0,149}?)Description\s*:\s*"
    return let(body, lambda b: strip(F.regexp_replace(b, label, "")))


def promote_section(extra, summary) -> tuple[Column, Column]:
    """Lift the `[Job Description ...]` section into a summary that is only page chrome.

    Returns the new (extra, summary).
    """
    e, s = col(extra), col(summary)
    lift = summary_is_nav(s) & e.rlike(_LIFTED)
    rest = F.regexp_replace(F.regexp_replace(e, _LIFTED, ""), r"^[| ]+|[| ]+\z", "")
    lifted = let(_lifted_body(e), lambda b: F.when(F.length(b) > 50, b).otherwise(s))
    new_summary = F.when(lift, lifted).when((e == "") & has_session_bar(s), "").otherwise(s)
    return F.when(lift, rest).otherwise(e), new_summary
