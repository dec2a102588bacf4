"""Page text, pairs, spans, links and sections as array expressions over one HTML cell.

Everything a page yields is built inside its own row, so no page needs a shuffle.
"""

from __future__ import annotations

import re
from html.entities import html5

from pyspark.sql import Column, functions as F

from .text import clean, col, let, norm_label

#: Named character references of the HTML standard, from the standard library's table: the old names, which
#: also count without a semicolon, and all that are written with one.
OLD_ENTITIES = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
_NAME_MARK, _CHAR_MARK = "\x02", "\x03"
#: One text that is searched for a name, old names first: it is far smaller in a plan than a map of 2,000 entries.
_ENTITY_TEXT = "".join(f"{_NAME_MARK}{n}{_CHAR_MARK}{html5[n + ';']}" for n in dict.fromkeys(
    [*reversed(OLD_ENTITIES), *(n[:-1] for n in html5 if n.endswith(";"))])) + _NAME_MARK


def _named(name: Column) -> Column:
    """The characters of a reference by its name without a semicolon, or null."""
    place = F.position(F.concat(F.lit(_NAME_MARK), name, F.lit(_CHAR_MARK)), F.lit(_ENTITY_TEXT))
    return let(place, lambda at: F.when(at > 0, F.substring_index(
        F.substr(F.lit(_ENTITY_TEXT), at + F.length(name) + 2, F.lit(3)), _NAME_MARK, 1)))


_NOISES = r"!--.*?-->|script\b.*?</script\s*>|style\b.*?</style\s*>"
NOISE = rf"(?is)<(?:{_NOISES})"
NOISE_AND_TITLE = rf"(?is)<(?:{_NOISES}|title\b.*?</title\s*>)"
BLOCK_TAGS = "p|ul|ol|li|div|strong|b"
HEADING_TAGS = ["h1", "h2", "h3", "h4"]
_CONTAINERS = ["ul", "ol", "div", "strong", "b"]

_CUT, _TAG_END = "\x02", "\x03"


def without_noise(html) -> Column:
    """Drop scripts, styles, comments and the window title."""
    return F.regexp_replace(col(html), NOISE_AND_TITLE, " ")


def _numbered(number: Column) -> Column:
    """The character of a decimal or x-prefixed hexadecimal number."""
    code = F.when(F.lower(F.substring(number, 1, 1)) == "x", F.conv(F.substring(number, 2, 6), 16, 10)
                  ).otherwise(number).try_cast("int")
    return let(code, lambda n: F.when(
        n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF),
        F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise("\ufffd"))


_OLD_NAMES = "|".join(OLD_ENTITIES)


def _referred(piece: Column) -> Column:
    """Text after an `&`: a known reference becomes its character, else the `&` stays.

    A name with a semicolon counts as a whole; otherwise the longest old name that the text begins with.
    """
    def char(n: Column) -> Column:
        return F.when(n.startswith("#"), _numbered(F.substring(n, 2, 7))).otherwise(_named(n))

    def old(p: Column) -> Column:
        name = F.regexp_extract(p, f"^({_OLD_NAMES})", 1)
        return let(name, lambda n: F.when(n != "", F.concat(_named(n), F.substr(p, F.length(n) + 1)))
                   .otherwise(F.concat(F.lit("&"), p)))

    name = F.regexp_extract(piece, r"^(#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,30});", 1)
    return let(name, lambda n: F.when(n == "", old(piece)).otherwise(let(char(n), lambda c: F.when(
        c.isNotNull(), F.concat(c, F.substr(piece, F.length(n) + 2))).otherwise(old(piece)))))


def decode_entities(c: Column) -> Column:
    return let(c, lambda t: F.when(t.contains("&"), F.concat_ws("", F.transform(
        F.split(t, "&"), lambda p, i: F.when(i == 0, p).otherwise(_referred(p))))).otherwise(t))


def text_of(html, sep: str = " ") -> Column:
    """Text without tags, cleaned; `sep` stands where a tag was."""
    return clean(decode_entities(F.regexp_replace(col(html), r"(?s)<[^>]*>", sep)))


def raw_text(html) -> Column:
    """All page text, window title included, white space as it is."""
    return decode_entities(F.regexp_replace(F.regexp_replace(col(html), NOISE, ""), r"(?s)<[^>]*>", ""))


# --- blocks and sections -----------------------------------------------------------

def _runs(fragment: Column) -> Column:
    """Text runs between block tags; a run after a closing tag has tag `''`, `mark` is the tag as written."""
    marked = F.regexp_replace(fragment, rf"(?i)<(/?)({BLOCK_TAGS})\b[^>]*>", f"{_CUT}$1$2{_TAG_END}")

    def run(r: Column) -> Column:
        mark = F.lower(F.regexp_extract(r, f"^(/?[a-zA-Z]*){_TAG_END}", 1))
        body = F.regexp_replace(r, f"^/?[a-zA-Z]*{_TAG_END}", "")
        return F.struct(F.when(mark.startswith("/"), "").otherwise(mark).alias("tag"), text_of(body).alias("text"), mark.alias("mark"))

    return F.transform(F.split(marked, _CUT), run)


def _enclosed(units: Column) -> Column:
    """For each unit, whether a listed tag is open at its text.

    Counted are open containers (lists, divisions, bold). A paragraph stays open until it is closed or a
    list, division or heading begins or a container ends; an item until it or a list is closed.
    """
    def step(acc: Column, u: Column) -> Column:
        mark = u["mark"]
        depth = F.greatest(F.lit(0), acc["depth"] + F.when(mark.isin(*_CONTAINERS), 1).when(
            mark.isin(*[f"/{t}" for t in _CONTAINERS]), -1).otherwise(0))
        p = F.when(mark == "p", True).when((mark == "/p") | mark.isin("ul", "ol", "div", *HEADING_TAGS, "/ul", "/ol", "/div"), False).otherwise(acc["p"])
        li = F.when(mark == "li", True).when(mark.isin("/li", "/ul", "/ol"), False).otherwise(acc["li"])
        inside = mark.isin(*HEADING_TAGS) | (depth > 0) | p | li
        return F.struct(depth.alias("depth"), p.alias("p"), li.alias("li"), F.concat(acc["inside"], F.array(inside)).alias("inside"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("p"), F.lit(False).alias("li"),
                     F.array().cast("array<boolean>").alias("inside"))
    return F.aggregate(units, start, step, lambda acc: acc["inside"])


def blocks(html) -> Column:
    """Ordered `(tag, text)` leaf blocks; every piece of text that a listed tag or a heading encloses comes exactly once."""
    h = F.replace(F.replace(without_noise(html), F.lit(_CUT), F.lit("")), F.lit(_TAG_END), F.lit(""))
    h = F.regexp_replace(h, r"(?i)(<h[1-4]\b)", f"{_CUT}$1")
    h = F.regexp_replace(h, r"(?i)(</h[1-4]\s*>)", f"$1{_CUT}")

    def unit(part: Column) -> Column:
        name = F.lower(F.substring(part, 2, 2))
        heading = F.struct(name.alias("tag"), text_of(part).alias("text"), name.alias("mark"))
        return F.when(part.rlike(r"(?i)^<h[1-4]\b"), F.array(heading)).otherwise(_runs(part))

    units = F.flatten(F.transform(F.split(h, _CUT), unit))

    def kept(u: Column) -> Column:
        inside = let(_enclosed(u), lambda e: F.transform(u, lambda b, i: F.struct(b["tag"], b["text"], F.get(e, i).alias("inside"))))
        shown = F.filter(inside, lambda b: b["inside"] & ((b["text"] != "") | b["tag"].isin(HEADING_TAGS)))
        return F.transform(shown, lambda b: F.struct(b["tag"].alias("tag"), b["text"].alias("text")))

    return let(units, kept)


def is_heading(block: Column) -> Column:
    bold = block["tag"].isin("b", "strong") & (F.length(block["text"]) < 80) & block["text"].endswith(":")
    return block["tag"].isin(HEADING_TAGS) | bold


def heading_text(block: Column) -> Column:
    return F.when(block["tag"].isin(HEADING_TAGS), block["text"]).otherwise(
        F.regexp_replace(block["text"], r":+\z", ""))


def sections(block_array) -> Column:
    """Blocks to `(heading, content)`; text before any heading has heading `''`."""
    def cut(b: Column) -> Column:
        marks = F.filter(F.transform(b, lambda x, i: F.when(is_heading(x), i)), lambda i: i.isNotNull())
        return let(F.concat(F.array(F.lit(-1)), marks), lambda starts: F.transform(
            starts, lambda start, k: section(b, start, F.coalesce(F.get(starts, k + 1), F.size(b)))))

    def section(b: Column, start: Column, end: Column) -> Column:
        body = F.slice(b, start + 2, end - start - 1)
        return F.struct(
            F.when(start < 0, "").otherwise(let(F.get(b, start), heading_text)).alias("heading"),
            clean(F.concat_ws(" ", F.transform(body, lambda x: x["text"]))).alias("content"))

    return F.filter(let(col(block_array), cut), lambda s: s["content"] != "")


# --- label/value pairs -------------------------------------------------------------

ROW = r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"
CELL = r"(?is)<t[hd]\b[^>]*>(.*?)</t[hd]\s*>"


def _first(html: Column, tag: str) -> Column:
    return F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)


def _pair(label_html: Column, value_html: Column) -> Column:
    return F.struct(text_of(label_html, "").alias("label"), text_of(value_html, "").alias("value"),
                    value_html.alias("cell"))


def _has_nested_table(html: Column) -> Column:
    """Whether some table begins inside another: two beginnings before one end."""
    return F.exists(F.split(html, r"(?i)</table"), lambda part: F.size(F.split(part, r"(?i)<table\b")) > 2)


def _nested(html: Column, tag: str) -> Column:
    """Inner HTML of every `tag`, nested ones within and after their outer one."""
    def inner(tokens: Column) -> Column:
        return F.transform(_positions(tokens, lambda t: t.rlike(rf"(?i)^<{tag}\b")), lambda i: _inner(tokens, i, tag))

    return let(_tokens(html, tag), inner)


def _rows_or_nested(html, flat, deep) -> Column:
    """`flat` of each row; where tables lie in tables, `deep` of each row with all that lies in it."""
    return let(without_noise(html), lambda page: F.when(
        _has_nested_table(page), F.transform(_nested(page, "tr"), deep)).otherwise(
        F.transform(F.regexp_extract_all(page, F.lit(ROW), 1), flat)))


def table_pairs(html) -> Column:
    """`(label, value, cell)` from rows with a th and a td; a row's text includes the tables in it, whose rows follow."""
    first = lambda r, tag: F.get(_nested(r, tag), F.lit(0))
    has_both = lambda r, pair: F.when(r.rlike(r"(?i)<th\b") & r.rlike(r"(?i)<td\b"), pair)
    rows = _rows_or_nested(html, lambda r: has_both(r, _pair(_first(r, "th"), _first(r, "td"))),
                           lambda r: has_both(r, _pair(first(r, "th"), first(r, "td"))))
    return F.filter(rows, lambda p: p.isNotNull())


def cell_pairs(html) -> Column:
    """`(label, value, cell)` from the first two cells of each row, tables in it included; their rows follow."""
    two = lambda cells: F.when(F.size(cells) >= 2, _pair(F.get(cells, F.lit(0)), F.get(cells, F.lit(1))))
    rows = _rows_or_nested(html, lambda r: let(F.regexp_extract_all(r, F.lit(CELL), 1), two),
                           lambda r: let(_nested(r, "t[hd]"), two))
    return F.filter(rows, lambda p: p.isNotNull())


def list_pairs(html) -> Column:
    """`(label, value, cell)` from dt entries and the dd that follows in the same dl."""
    lists = F.regexp_extract_all(without_noise(html), F.lit(r"(?is)<dl\b[^>]*>(.*?)</dl\s*>"), 1)

    def entry(parts: Column, i: Column) -> Column:
        rest = F.slice(parts, i + 1, F.size(parts))
        return F.struct(F.get(parts, i).alias("term"), F.get(F.filter(
            rest, lambda p: p.rlike(r"(?i)<dd\b")), F.lit(0)).alias("rest"))

    def pairs(parts: Column) -> Column:
        entries = F.filter(F.transform(parts, lambda p, i: entry(parts, i)),
                           lambda e: e["term"].rlike(r"(?i)^<dt\b") & e["rest"].isNotNull())
        return F.transform(entries, lambda e: _pair(_first(e["term"], "dt"), _first(e["rest"], "dd")))

    return F.flatten(F.transform(lists, lambda body: let(F.split(body, r"(?i)(?=<dt\b)"), pairs)))


def normalised(pairs: Column, spaces: bool = False) -> Column:
    """Normalise labels, drop pairs with a blank label or value."""
    out = F.transform(pairs, lambda p: F.struct(
        norm_label(p["label"], spaces).alias("label"), p["value"].alias("value"), p["cell"].alias("cell")))
    return F.filter(out, lambda p: (p["value"] != "") & (p["label"] != ""))


# --- elements, nesting respected ------------------------------------------------------

def _tokens(html, tag: str) -> Column:
    return F.split(col(html), rf"(?i)(?=</?{tag}\b)")


def _inner(tokens: Column, i: Column, tag: str) -> Column:
    """Inner HTML of the element that token `i` opens; an unclosed one runs to the end."""
    opens = rf"(?i)^<{tag}\b"

    def step(acc: Column, t: Column) -> Column:
        done = (acc["n"] > 0) & (acc["depth"] <= 0)
        return F.when(done, acc).otherwise(F.struct(
            (acc["depth"] + F.when(t.rlike(opens), 1).otherwise(-1)).alias("depth"), (acc["n"] + 1).alias("n")))

    def content(after: Column) -> Column:
        end = F.aggregate(after, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n")), step)
        length = let(end, lambda e: F.when(e["depth"] <= 0, e["n"] - 1).otherwise(e["n"]))
        return F.concat_ws("", F.slice(after, F.lit(1), length))

    # the next tag closes it: most elements, and no need to look at all that follows
    plain = F.coalesce(F.get(tokens, i).rlike(opens) & F.startswith(F.get(tokens, i + 1), F.lit("</")), F.lit(False))
    inner = F.when(plain, F.get(tokens, i)).otherwise(let(F.slice(tokens, i + 1, F.size(tokens)), content))
    return F.regexp_replace(inner, r"(?s)^<[^>]*>", "")


def _positions(tokens: Column, test) -> Column:
    return F.filter(F.transform(tokens, lambda t, i: F.when(test(t), i)), lambda i: i.isNotNull())


def element(html, tag: str, attributes: str) -> Column:
    """Inner HTML of the first `tag` whose opening tag matches `attributes`; `''` if none."""
    opening = rf"(?is)<{tag}\b[^>]*{attributes}"
    first = lambda tokens: F.get(_positions(tokens, lambda t: t.rlike(f"{opening[:5]}^{opening[5:]}")), F.lit(0))
    found = lambda tokens: let(first(tokens), lambda i: F.coalesce(_inner(tokens, i, tag), F.lit("")))
    return F.when(col(html).rlike(opening), let(_tokens(html, tag), found)).otherwise("")


def any_element(html, attributes: str) -> Column:
    """Inner HTML of the first element, whatever its tag, whose opening tag matches `attributes`; `''` if none."""
    opening = rf"(?is)<({_NAME})\b[^>]*{attributes}"

    def found(page: Column, tag: Column) -> Column:
        tokens = F.split(page, F.concat(F.lit("(?i)(?=</?"), tag, F.lit(r"\b)")))
        first = lambda t: F.get(_positions(t, lambda x: x.rlike(f"{opening[:5]}^{opening[5:]}")), F.lit(0))
        return let(tokens, lambda t: let(first(t), lambda i: _closed(t, i)))

    return let(col(html), lambda page: let(F.lower(F.regexp_extract(page, opening, 1)), lambda tag: F.when(
        tag != "", F.coalesce(found(page, tag), F.lit(""))).otherwise("")))


#: A tag that can hold text.
_NAME = r"(?!(?:area|base|br|col|embed|hr|img|input|link|meta|source|track|wbr)\b)[a-z][a-z0-9]*"


def _closed(tokens: Column, i: Column) -> Column:
    """Inner HTML of the element that token `i` opens, the tokens cut at the tags of its name."""
    def step(acc: Column, t: Column) -> Column:
        done = (acc["n"] > 0) & (acc["depth"] <= 0)
        return F.when(done, acc).otherwise(F.struct(
            (acc["depth"] + F.when(F.substring(t, 2, 1) != "/", 1).otherwise(-1)).alias("depth"), (acc["n"] + 1).alias("n")))

    def content(after: Column) -> Column:
        end = F.aggregate(after, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n")), step)
        length = let(end, lambda e: F.when(e["depth"] <= 0, e["n"] - 1).otherwise(e["n"]))
        return F.concat_ws("", F.slice(after, F.lit(1), length))

    return F.regexp_replace(let(F.slice(tokens, i + 1, F.size(tokens)), content), r"(?s)^<[^>]*>", "")


def id_like(pattern: str) -> str:
    """An id in which `pattern` (lower or upper case) is found."""
    return rf"\sid\s*=\s*[\"'][^\"']*(?:{pattern})[^\"']*[\"']"


def class_like(pattern: str) -> str:
    """A class list in which `pattern` (lower or upper case) is found."""
    return rf"\sclass\s*=\s*[\"'][^\"']*(?:{pattern})[^\"']*[\"']"


def with_id(name: str) -> str:
    return rf"\sid\s*=\s*[\"']{name}[\"']"


def with_class(name: str) -> str:
    return rf"\sclass\s*=\s*[\"'](?:[^\"']*\s)?{name}[\s\"']"


def id_spans(html, wanted: str) -> Column:
    """`(id, text)` of spans whose id matches `wanted`; nested spans belong to the outer text."""
    def spans(tokens: Column) -> Column:
        return F.transform(
            _positions(tokens, lambda t: _span_id(t).rlike(wanted)),
            lambda i: F.struct(_span_id(F.get(tokens, i)).alias("id"),
                               text_of(_inner(tokens, i, "span")).alias("text")))

    return let(_tokens(without_noise(html), "span"), spans)


def _span_id(token: Column) -> Column:
    return F.regexp_extract(token, r"""(?is)^<span\b[^>]*?\sid\s*=\s*["']?([^"'\s>]+)""", 1)


def span_value(spans: Column, span_id) -> Column:
    """Text of the first span with this id, or null."""
    wanted = span_id if isinstance(span_id, Column) else F.lit(span_id)
    return F.get(F.filter(spans, lambda s: s["id"] == wanted), F.lit(0))["text"]


def numbered(spans: Column, kinds: list[tuple[str, str]], limit: int | None = None) -> Column:
    """Texts of the spans `prefix` + number + `suffix` for every `(prefix, suffix)` of `kinds`, an array per number.

    Numbers run from 0 to before the first that has no span of the first kind, `limit` numbers at most. A span that
    is missing gives an empty text, of several with one id the first counts. The spans are sorted by number once,
    so the work grows with their count and not with its square.
    """
    def of_kind(k: int, prefix: str, suffix: str) -> Column:
        number = rf"^{re.escape(prefix)}(0|[1-9][0-9]{{0,8}}){re.escape(suffix)}\z"
        entries = F.transform(spans, lambda s, at: F.struct(
            F.regexp_extract(s["id"], number, 1).try_cast("int").alias("n"),
            F.lit(k).alias("kind"), at.alias("at"), s["text"].alias("text")))
        return F.filter(entries, lambda e: e["n"].isNotNull())

    def texts(entries: Column, count: Column) -> Column:
        known = F.filter(entries, lambda e: e["n"] < count)
        blank = F.flatten(F.transform(F.sequence(F.lit(0), count - 1), lambda n: F.array(*[F.struct(
            n.alias("n"), F.lit(k).alias("kind"), F.lit(2**31 - 1).alias("at"), F.lit("").alias("text"))
            for k in range(len(kinds))])))
        first = lambda e, i, ordered: (i == 0) | (F.get(ordered, i - 1)["n"] != e["n"]) | (
            F.get(ordered, i - 1)["kind"] != e["kind"])
        firsts = let(F.array_sort(F.concat(known, blank)),
                     lambda ordered: F.filter(ordered, lambda e, i: first(e, i, ordered)))
        return let(firsts, lambda f: F.transform(F.sequence(F.lit(0), count - 1), lambda n: F.array(
            *[F.get(f, n * len(kinds) + k)["text"] for k in range(len(kinds))])))

    def run(entries: Column) -> Column:
        numbers = F.array_sort(F.array_distinct(F.transform(F.filter(entries, lambda e: e["kind"] == 0), lambda e: e["n"])))
        length = F.size(F.filter(numbers, lambda n, i: n == i))
        count = length if limit is None else F.least(length, F.lit(limit))
        return let(count, lambda c: F.when(c > 0, texts(entries, c)).otherwise(F.array().cast("array<array<string>>")))

    return let(F.concat(*[of_kind(k, *kind) for k, kind in enumerate(kinds)]), run)


# --- links -------------------------------------------------------------------------

HREF = r"""(?is)^<a\b[^>]*?\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""


def href_of(anchor: Column) -> Column:
    return decode_entities(F.concat(*[F.regexp_extract(anchor, HREF, g) for g in (1, 2, 3)]))


def links(html, path: str = "") -> Column:
    """Ordered `(href, text)` anchors whose href matches `path`."""
    anchors = F.regexp_extract_all(without_noise(html), F.lit(r"(?is)<a\b[^>]*>.*?</a\s*>"), 0)
    pairs = F.transform(anchors, lambda a: F.struct(href_of(a).alias("href"), text_of(a).alias("text")))
    return F.filter(pairs, lambda p: (p["href"] != "") & p["href"].rlike(path))


def is_pager_text(text) -> Column:
    t = col(text)
    return (t == "") | t.rlike("(?U)^[\\d›»<>]+\\z") | F.lower(t).isin("next", "prev", "previous")


def title_case(c: Column) -> Column:
    """Every letter after a non-letter in upper case, the others in lower case."""
    return F.concat_ws("", F.transform(F.split(c, r"(?<=\P{L})(?=\p{L})"), F.initcap))


def classed(html: Column, name: str) -> Column:
    """Text of the first element whose class list contains `name`, up to its next closing tag."""
    return text_of(F.regexp_extract(
        html, rf"""(?is)<\w+\b[^>]*\sclass\s*=\s*["'][^"']*{name}[^"']*["'][^>]*>(.*?)</""", 1))
