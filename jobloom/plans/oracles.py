"""The same answers in plain SQL for the check engine (written independently of the Spark code)."""

from __future__ import annotations

from . import standins as S

WS = (r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def clean(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{WS}+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^{WS}+|{WS}+$', '', 'g')"


def first(*xs: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({x}, '')" for x in xs) + ", '')"


def ex(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract({x}, {q(pattern)}, {group})"


def sub(x: str, pattern: str, to: str = "", flags: str = "g") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, '{flags}')"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


# --- merge ------------------------------------------------------------------------------

_NAMES = {"s0": "University of Georgia", "s1": "Georgia Institute of Technology", "s3": "Georgia State University"}
_SAME = {c: clean(c) for c in ["job_id", "job_title", "department", "location", "posted_date", "full_part_time",
                               "salary", "job_summary", "responsibilities", "required_qualifications",
                               "apply_link", "posting_url", "scraped_at"]}
_S0 = "source_key = 's0'"

MASTER = f"""
SELECT ord, source_key, source_rank, {", ".join(f"{v} AS {k}" for k, v in _SAME.items())},
  CASE source_key WHEN 's0' THEN {q(_NAMES['s0'])} WHEN 's3' THEN {q(_NAMES['s3'])}
    WHEN 's1' THEN coalesce(nullif({clean('institution')}, ''), {q(_NAMES['s1'])}) ELSE {clean('institution')} END
    AS institution,
  CASE WHEN {_S0} THEN {clean('close_date')} ELSE '' END AS close_date,
  CASE WHEN {_S0} THEN '' ELSE {clean('regular_temporary')} END AS regular_temporary,
  CASE WHEN {_S0} THEN {clean('employment_type')} ELSE '' END AS employment_type,
  '' AS about_us, '' AS preferred_qualifications, '' AS knowledge_skills,
  CASE WHEN {_S0} THEN array_to_string(list_filter([{clean('special_instructions')},
      CASE WHEN fte <> '' THEN 'FTE: ' || fte ELSE '' END, CASE WHEN flsa <> '' THEN 'FLSA: ' || flsa ELSE '' END],
      lambda p: p <> ''), ' | ') ELSE {clean('special_instructions')} END AS other_information,
  CASE WHEN {_S0} THEN array_to_string(list_filter([
      CASE WHEN lower(position_of_trust) = 'yes' THEN 'Position of Trust' ELSE '' END,
      CASE WHEN lower(p_card_required) = 'yes' THEN 'P-Card Required' ELSE '' END], lambda p: p <> ''), ' | ')
    ELSE '' END AS background_check,
  CASE WHEN {_S0} THEN '' ELSE {clean('extra_sections')} END AS extra_sections,
  CASE source_key WHEN 's0' THEN 'UGA (PeopleAdmin)' WHEN 's1' THEN 'Georgia Tech (OneHCM)'
    WHEN 's2' THEN 'USG OneHCM' ELSE 'Georgia State University' END AS source
FROM ({S.plain(S.RAW)}) raw
"""

MERGED = f"""
SELECT * EXCLUDE (rn, k) FROM (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY source_rank, ord) AS rn
  FROM (SELECT *, coalesce(nullif(posting_url, ''), nullif(job_id, ''), '#' || ord) AS k
        FROM ({MASTER}) m WHERE job_title <> '') keyed
) ranked WHERE rn = 1
"""

# --- site ---------------------------------------------------------------------------------

_FORMATS = [("%m/%d/%Y", r"/\d{4}$"), ("%Y-%m-%d", r"^\d{4}-"), ("%B %d, %Y", r", \d{4}$"), ("%b %d, %Y", r", \d{4}$"),
            ("%m-%d-%Y", r"-\d{4}$"), ("%Y/%m/%d", r"^\d{4}/"), ("%m/%d/%y", r"/\d{2}$")]


def typed_date(x: str) -> str:
    s = strip(x)
    tries = ", ".join(f"CASE WHEN {has(s, guard)} THEN try_strptime({s}, '{f}') END" for f, guard in _FORMATS)
    return f"CAST(coalesce({tries}) AS DATE)"


def parse_date(x: str) -> str:
    fallback = ex(strip(x), r"^(\d{4}-\d{2}-\d{2})", 1)
    return f"coalesce(strftime({typed_date(x)}, '%Y-%m-%d'), {fallback})"


def cut(x: str, n: int) -> str:
    return f"({sub(f'substring({x}, 1, {n})', ' [^ ]*$')} || '…')"


def truncate(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) > {n} THEN {cut(x, n)} ELSE {x} END"


_AMOUNT = r"\$?\s*[\d,]+(?:\.\d+)?"
_RANGE_END = r"(?:\s*[-–]\s*\$?[\d,]+(?:\.\d+)?)?"
_PHRASE = (rf"(?i)salary\s*range\s*:?\s*{_AMOUNT}{_RANGE_END}(?:\s*(?:annually|per\s+year|/yr))?"
           rf"|salary\s*:\s*{_AMOUNT}{_RANGE_END}"
           rf"|minimum\s+(?:hourly\s+rate|salary|monthly\s+salary)\s+(?:is:?\s*)?{_AMOUNT}(?:/\w+)?"
           r"|\$\s*[\d,]+(?:\.\d+)?\s*(?:per\s+(?:hour|month)|/hr|/hour)")
_BLOB = (r"(?i)(?:Salary\s*:|Anticipated Hiring Range\s*:)\s*\$?([\d,]+(?:\.\d+)?)(?:\s*\([^)]*\))?\s*[-–]\s*"
         r"\$?([\d,]+(?:\.\d+)?)")
_SECTION = (r"(?i)(?:^|\|\|)\s*\[\s*(?:proposed salary|salary range|salary|pay range|shift/salary/benefits|"
            r"compensation)[^\]]*\]\s*([^|]*[^|\s])")
_IS_BLOB = "source = 'Georgia State University'"


def _full_part(x: str) -> str:
    return (f"CASE WHEN contains(lower({x}), 'full') THEN 'Full-Time' "
            f"WHEN contains(lower({x}), 'part') THEN 'Part-Time' ELSE '' END")


_SUMMARY = (f"CASE WHEN length(job_summary) < 100 THEN trim(job_summary || ' ' || responsibilities) "
            f"ELSE job_summary END")
_PAY_RAW = first(
    "salary", f"substring({ex('extra_sections', _SECTION, 1)}, 1, 200)",
    f"CASE WHEN {_IS_BLOB} AND {ex('department', _BLOB, 1)} <> '' "
    f"THEN '$' || {ex('department', _BLOB, 1)} || ' - $' || {ex('department', _BLOB, 2)} ELSE '' END",
    *[f"substring(trim({ex(c, _PHRASE)}), 1, 200)"
      for c in ("other_information", "extra_sections", "job_summary", "responsibilities")])
_TAIL = ex("pay_raw", r"(?s)\$\s*[\d,].*")
_HEAD = ex(_TAIL, r"(?s)^(.{1,199}?\.)(?:[ \t\n\r]|$)", 1)
_SHORT = f"trim({first(_HEAD, _TAIL)})"
_PAY = (f"CASE WHEN length(pay_raw) <= 120 THEN pay_raw WHEN {_TAIL} = '' THEN {cut('pay_raw', 120)} "
        f"WHEN length({_SHORT}) > 150 THEN {cut(_SHORT, 120)} ELSE {_SHORT} END")
_NOISE = " OR ".join(
    [f"starts_with(lower(department), {q(p)})" for p in
     ("beginning of the main content", "return to the home page", "- description:",
      "qualifications college/business unit")]
    + [has("substring(lower(department), 1, 80)", r"\b\d{5,}\b.*\bdescription\b")])
_HOURLY = r"\bper\s+hours?\b|/hr\b|/hour\b|\bhourly\b|\ban\s+hour\b"

SITE = f"""
SELECT source_rank, ord, id, title, institution, department, location, remote, posted, closes, type, employment, salary,
  CASE WHEN {has('lower(salary)', _HOURLY)} THEN 'Hourly' WHEN {has('salary', r'[$][ ]*[0-9,]+')} THEN 'Annual'
    WHEN {has('salary', r'(?:^|[^0-9A-Za-z_])[0-9]{5,}(?:[^0-9A-Za-z_]|$)')} THEN 'Annual' ELSE '' END AS salary_type,
  summary, view, apply, source
FROM (SELECT *, {_PAY} AS salary FROM (
  SELECT source_rank, ord, job_id AS id, job_title AS title, institution,
    CASE WHEN {_NOISE} THEN '' ELSE department END AS department, location,
    contains(lower(location), 'remote') AS remote, {parse_date('posted_date')} AS posted,
    {parse_date('close_date')} AS closes,
    coalesce(nullif({_full_part('full_part_time')}, ''),
      CASE WHEN {_IS_BLOB} THEN {_full_part(ex('department', r'(?i)Job Type\s*:\s*(Full[- ]?Time|Part[- ]?Time)', 1))}
      ELSE '' END) AS type,
    CASE WHEN contains(lower(regular_temporary), 'regular') OR contains(lower(regular_temporary), 'perm')
      THEN 'Regular' WHEN contains(lower(regular_temporary), 'temp') OR contains(lower(regular_temporary), 'contract')
      THEN 'Temporary' ELSE '' END AS employment,
    {_PAY_RAW} AS pay_raw, {truncate(f'({_SUMMARY})', 700)} AS summary,
    {first('posting_url', 'apply_link')} AS view,
    CASE WHEN starts_with(apply_link, 'http') THEN apply_link ELSE {first('posting_url', 'apply_link')} END AS apply,
    source
  FROM ({MERGED}) merged WHERE job_id <> '') parsed) priced
"""

_NEWEST = "coalesce(nullif(posted, ''), '0000-00-00') DESC, source_rank, ord"


def _facet(column: str, limit: str = "") -> str:
    return f"""
SELECT {column} AS value, count(*) AS count FROM (
  SELECT *, row_number() OVER (ORDER BY {_NEWEST}) AS place FROM ({SITE}) s) ranked
WHERE {column} <> '' GROUP BY {column} ORDER BY count(*) DESC, min(place) {limit}"""


def _facet_list(column: str, limit: str = "") -> str:
    return f"""(SELECT string_agg(value, ' / ' ORDER BY n DESC, place) FROM (
  SELECT {column} AS value, count(*) AS n, min(place) AS place FROM (
    SELECT *, row_number() OVER (ORDER BY {_NEWEST}) AS place FROM site) ranked
  WHERE {column} <> '' GROUP BY {column} ORDER BY n DESC, place {limit}) f)"""


MASTER_NAMES = ["job_id", "job_title", "institution", "department", "location", "posted_date", "close_date",
                "full_part_time", "regular_temporary", "employment_type", "salary", "about_us", "job_summary",
                "responsibilities", "required_qualifications", "preferred_qualifications", "knowledge_skills",
                "other_information", "background_check", "extra_sections", "apply_link", "posting_url", "source",
                "scraped_at"]

# --- pages --------------------------------------------------------------------------------

_NOISE_HTML = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"


def page_text(x: str, sep: str = " ") -> str:
    out = sub(x, r"(?s)<[^>]*>", sep)
    for name, char in (("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"),
                       ("&middot;", "·"), ("&amp;", "&")):
        out = f"replace({out}, {q(name)}, {q(char)})"
    return clean(out)


_QUIET = sub("html", _NOISE_HTML + r"|<title\b.*?</title\s*>", " ")
_CUT = sub(sub(_QUIET, r"(?i)(<h[1-4]\b)", "\x02\\1"), r"(?i)(</h[1-4]\s*>)", "\\1\x02")
# Inside a heading nothing is cut; elsewhere each block tag starts a new run.
BLOCKS = f"""
SELECT page_id, part, run, lower(CASE WHEN heading THEN regexp_extract(body, '^<([hH][1-4])', 1)
    ELSE regexp_extract(body, '^<([a-zA-Z]+)', 1) END) AS rawtag, body, heading,
  {page_text('body')} AS text
FROM (
  SELECT page_id, part, heading, unnest(pieces) AS body, generate_subscripts(pieces, 1) AS run FROM (
    SELECT page_id, part, {has('seg', '(?i)^<h[1-4]')} AS heading,
      CASE WHEN {has('seg', '(?i)^<h[1-4]')} THEN [seg]
        ELSE string_split({sub('seg', r'(?i)(</?(?:p|ul|ol|li|div|strong|b)\b[^>]*>)', chr(3) + chr(92) + '1')}, chr(3))
        END AS pieces
    FROM (SELECT page_id, unnest(segs) AS seg, generate_subscripts(segs, 1) AS part
          FROM (SELECT page_id, string_split({_CUT}, chr(2)) AS segs FROM pages) a) b) c) d
"""
_BLOCK_TAGS = "('p','ul','ol','li','div','strong','b')"
# Text counts where a container, a paragraph or an item is open; the last word on each is the latest mark.
ORDERED_BLOCKS = f"""
WITH marks AS (SELECT *, CASE WHEN heading THEN rawtag ELSE lower(regexp_extract(body, '^<(/?[a-zA-Z]+)', 1)) END AS mark FROM ({BLOCKS}) m),
states AS (SELECT *,
  sum(CASE WHEN heading THEN 0 WHEN mark IN ('ul','ol','div','strong','b') THEN 1
    WHEN mark IN ('/ul','/ol','/div','/strong','/b') THEN -1 ELSE 0 END) OVER w AS depth,
  last_value(CASE WHEN mark = 'p' THEN true WHEN heading OR mark IN ('/p','ul','ol','div','/ul','/ol','/div') THEN false END IGNORE NULLS) OVER w AS p,
  last_value(CASE WHEN mark = 'li' THEN true WHEN mark IN ('/li','/ul','/ol') THEN false END IGNORE NULLS) OVER w AS li
  FROM marks WINDOW w AS (PARTITION BY page_id ORDER BY part, run ROWS UNBOUNDED PRECEDING))
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY part, run) - 1 AS INT) AS ord,
  CASE WHEN heading OR rawtag IN {_BLOCK_TAGS} THEN rawtag ELSE '' END AS tag, text
FROM states WHERE text <> '' AND (heading OR depth > 0 OR coalesce(p, false) OR coalesce(li, false))
"""
_BOLD_HEAD = "(tag IN ('b','strong') AND length(text) < 80 AND ends_with(text, ':'))"
_HEAD_COL = f"""CASE lower(trim(heading, ': '))
  WHEN 'job summary' THEN 'job_summary' WHEN 'overview' THEN 'job_summary' WHEN 'summary' THEN 'job_summary'
  WHEN 'description' THEN 'job_summary' WHEN 'about us' THEN 'about_us'
  WHEN 'responsibilities' THEN 'responsibilities' WHEN 'duties' THEN 'responsibilities'
  WHEN 'qualifications' THEN 'required_qualifications' ELSE CASE WHEN heading = '' THEN 'job_summary' END END"""
SECTIONS = f"""
SELECT page_id, sec, any_value(head) AS heading, min(CASE WHEN is_head THEN ord END) AS start, string_agg(text, ' ' ORDER BY ord) FILTER (WHERE NOT is_head) AS content
FROM (
  SELECT *, coalesce(max(CASE WHEN is_head THEN CASE WHEN tag LIKE 'h_' THEN text ELSE rtrim(text, ':') END END)
    OVER (PARTITION BY page_id, sec), '') AS head
  FROM (SELECT *, sum(CAST(is_head AS INT)) OVER (PARTITION BY page_id ORDER BY ord) AS sec
        FROM (SELECT *, tag LIKE 'h_' OR {_BOLD_HEAD} AS is_head FROM ({ORDERED_BLOCKS}) o) h) s) t
GROUP BY page_id, sec HAVING count(*) FILTER (WHERE NOT is_head) > 0
"""
_SEC_COLS = ["about_us", "job_summary", "responsibilities", "required_qualifications", "preferred_qualifications",
             "knowledge_skills_abilities", "other_information", "background_check"]
PAGE_SECTIONS = f"""
SELECT p.page_id, {", ".join(
    (f"CASE WHEN count(sec) = 0 THEN any_value({page_text(_QUIET)}) ELSE " if c == "job_summary" else "")
    + f"coalesce(string_agg(content, ' ' ORDER BY sec) FILTER (WHERE col = '{c}'), '')" + (" END" if c == "job_summary" else "")
    + f" AS {c}" for c in _SEC_COLS)},
  coalesce(string_agg('[' || heading || '] ' || content, ' || ' ORDER BY sec) FILTER (WHERE col IS NULL AND sec IS NOT NULL), '')
    AS extra_sections
FROM pages p LEFT JOIN (SELECT *, {_HEAD_COL} AS col FROM ({SECTIONS}) x) s ON p.page_id = s.page_id GROUP BY p.page_id
"""
LINKS = f"""
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INT) AS ord, href, text FROM (
  SELECT page_id, i, replace({ex('a', r'''(?is)^<a\b[^>]*?\shref\s*=\s*"([^"]*)"''', 1)}, '&amp;', '&') AS href,
    {page_text('a')} AS text
  FROM (SELECT page_id, unnest(anchors) AS a, generate_subscripts(anchors, 1) AS i
        FROM (SELECT page_id, regexp_extract_all({_QUIET}, {q(r'(?is)<a[^a-zA-Z].*?</a\s*>')}) AS anchors FROM pages) x) y) z
WHERE href <> ''
"""

# --- label tables ---------------------------------------------------------------------------

_LONG = S.plain(S.LONG)
_LONG_FIELD = """CASE label WHEN 'Date Posted' THEN 'posting_date' WHEN 'Working Title:' THEN 'working_title'
  WHEN 'Job Description' THEN 'position_summary' WHEN 'Advertised Salary:' THEN 'salary' WHEN 'Pay Range' THEN 'salary'
  WHEN 'Minimum Requirements' THEN 'minimum_qualifications' WHEN 'Dept Name' THEN 'department' END"""
RESOLVED = f"SELECT *, {_LONG_FIELD} AS field FROM ({_LONG}) l"
_FIELDS = ["posting_date", "working_title", "position_summary", "salary", "minimum_qualifications"]
_IN_FIELDS = "field IN (" + ", ".join(q(f) for f in _FIELDS) + ") AND value <> ''"


def _pivot(agg: str) -> str:
    cols = ", ".join(f"coalesce({agg} FILTER (WHERE field = '{f}'), '') AS {f}" for f in _FIELDS)
    return f"SELECT page_id, {cols} FROM ({RESOLVED}) r WHERE {_IN_FIELDS} GROUP BY page_id"


_KEYWORDS = {"Employing Unit": "department", "Campus :": "location", "Type of Position": "full_part_time",
             "Employee Status:": "regular_temporary", "Opening Date": "posted_date",
             "Application Deadline": "close_note", "Department / Location": "department"}


def _case(x: str, table: dict[str, str]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items()) + " END"


# --- incremental ------------------------------------------------------------------------------

_CARDS, _STORED, _FETCHED = (S.plain(x) for x in (S.CARDS, S.STORED, S.FETCHED))


def _last(sql: str, key: str) -> str:
    return (f"SELECT * FROM (SELECT *, {key} AS k FROM ({sql}) a) b WHERE k <> '' "
            f"QUALIFY row_number() OVER (PARTITION BY k ORDER BY ord DESC) = 1")


def _dual(sql: str) -> str:
    """Rows by number and url in one table, the last row of a value holding it."""
    return f"""
SELECT * EXCLUDE (place) FROM (
  SELECT r.*, {_CANON} AS k, place FROM ({sql}) r JOIN (
    SELECT max(ord) AS holder, min(place) AS place FROM (
      SELECT ord, ord * 2 AS place, {strip('number')} AS v FROM ({sql}) a
      UNION ALL SELECT ord, ord * 2 + 1, {strip('url')} FROM ({sql}) b) f WHERE v <> '' GROUP BY v) h ON r.ord = h.holder) x
QUALIFY row_number() OVER (PARTITION BY k ORDER BY place) = 1"""


_CANON = f"coalesce(nullif({strip('number')}, ''), {strip('url')})"
_DETAIL = f"""SELECT job_id, job_title, department, apply_link FROM ({S.plain(S.LINE_DETAILS)}) l
QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) = 1"""
_ENRICHED = f"""
SELECT c.job_id, c.url, {first('d.job_title', 'c.job_title')} AS job_title,
  {first('c.department', 'd.department')} AS department, {first('d.apply_link', 'c.url')} AS apply_link,
  c.url AS posting_url, d.job_id IS NULL AS stub
FROM ({S.plain(S.ORDER_CARDS)}) c LEFT JOIN ({_DETAIL}) d ON c.job_id = d.job_id
"""

# --- events -----------------------------------------------------------------------------------

_EVENTS, _CUSTOMERS = S.plain(S.EVENTS), S.plain(S.CUSTOMERS)
_STATUS = """CASE WHEN type = 'checkout.session.completed' AND mode = 'subscription' AND customer <> '' THEN 'active'
  WHEN type = 'customer.subscription.updated' THEN CASE WHEN status = 'active' THEN 'active' ELSE 'cancelled' END
  WHEN type = 'customer.subscription.deleted' THEN 'cancelled'
  WHEN type = 'invoice.payment_failed' AND customer <> '' THEN 'past_due' END"""
_ENDS = "CASE WHEN type = 'customer.subscription.updated' THEN nullif(current_period_end, 0) END"
_EFFECTS = f"SELECT *, {_STATUS} AS effect, {_ENDS} AS ends FROM ({_EVENTS}) e"
_LATEST = f"""
SELECT user_id, customer, effect AS subscription_status, CAST(ends AS BIGINT) AS ends,
  strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at
FROM ({_EFFECTS}) e JOIN ({_CUSTOMERS}) c USING (customer) WHERE effect IS NOT NULL AND user_id <> ''
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
"""

_ARRIVED = _LATEST.replace("ORDER BY ts DESC, event_id DESC", "ORDER BY CAST(event_id AS BIGINT), ts DESC")

_RAW = S.plain(S.RAW)
_LANDED = f"""(SELECT * FROM ({_RAW}) a UNION ALL
  SELECT * REPLACE (-1 - doc_id AS doc_id) FROM ({_RAW}) b WHERE doc_id % 5 = 3) r"""
_IN = "doc_id >= 0"
_PAGE_URL = "'https://jobs.example.org/p/' || job_id || CASE WHEN doc_id < 0 THEN '/new' ELSE '' END"


def _landed(value: str, otherwise: str = "''") -> str:
    return f"CASE WHEN {_IN} THEN {value} ELSE {otherwise} END"


_SIMILAR = """
SELECT CAST(query_id AS BIGINT) AS query_id, id, CAST(rank AS INT) AS rank, round(score, 5) AS score FROM (
  SELECT q.label AS query_id, v.vec_id AS id, list_dot_product(q.e, CAST(v.embedding AS DOUBLE[])) AS score,
    row_number() OVER (PARTITION BY q.label
      ORDER BY list_dot_product(q.e, CAST(v.embedding AS DOUBLE[])) DESC, v.vec_id) AS rank
  FROM (SELECT label, CAST(arg_min(embedding, vec_id) AS DOUBLE[]) AS e FROM embeddings GROUP BY label) q, embeddings v) s
WHERE rank <= 5
"""

_DOC_TITLE = clean("split_part(text, chr(10), 1)")
_KIND = f"""
SELECT doc_id, {_DOC_TITLE} AS title, {clean('text')} AS body,
  CASE doc_id % 5 WHEN 0 THEN lower(split_part(text, chr(10), 1)) || '  Dept Georgia State University ' || {clean('text')}
    WHEN 1 THEN 'Welcome. You are not signed in ' || source WHEN 2 THEN ''
    WHEN 3 THEN 'Beginning of the main content section. ' || {clean('text')} ELSE {clean('text')} END AS summary,
  {clean("replace(text, '|', ' ')")} AS flat
FROM documents
"""
_CUT_TITLE = ("CASE WHEN title <> '' AND starts_with(lower(summary), lower(title)) "
              "THEN ltrim(substring(summary, length(title) + 1)) ELSE summary END")
_AT = f"instr({_CUT_TITLE}, 'Georgia State University ')"
_HEADLESS = (f"CASE WHEN {_AT} BETWEEN 1 AND 400 THEN trim(substring({_CUT_TITLE}, {_AT} + 25)) ELSE {_CUT_TITLE} END")

ORACLES = {
    "to_master_rows": f"SELECT ord, source_key, {', '.join(MASTER_NAMES)} FROM ({MASTER}) m",
    "merge_dedup": f"SELECT ord, source_key, {', '.join(MASTER_NAMES)} FROM ({MERGED}) m",
    "count_by_institution": f"SELECT institution, count(*) AS jobs FROM ({MERGED}) m GROUP BY institution",
    "count_by_source": f"SELECT source, count(*) AS jobs FROM ({MERGED}) m GROUP BY source",
    "loaded_counts": f"SELECT source_key, count(*) AS loaded FROM ({MERGED}) m GROUP BY source_key",
    "dedup_listing": f"SELECT min(ord) AS ord, arg_min(job_id, ord) AS job_id, title FROM ({_CARDS}) c "
                     "WHERE title <> '' GROUP BY title",
    "union_portals": f"""SELECT job_id, title, url, portal FROM (
  SELECT CAST(doc_id AS VARCHAR) AS job_id, {clean('job_title')} AS title,
    'https://jobs.example.org/detail?job=' || doc_id || '&lang=en' AS url, 'rows' AS portal, doc_id AS page_id, 0 AS p
  FROM ({S.plain(S.RAW)}) r WHERE {clean('job_title')} <> ''
  UNION ALL SELECT CAST(doc_id AS VARCHAR), {clean('job_title')}, 'https://jobs.example.org/postings/' || doc_id, 'cards', doc_id, 1
  FROM ({S.plain(S.RAW)}) r
  UNION ALL SELECT '7' || doc_id, 'Other', 'https://other.example.org/postings/7' || doc_id, 'cards', doc_id, 1
  FROM ({S.plain(S.RAW)}) r) u
QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY p, page_id, CASE title WHEN 'Other' THEN 1 ELSE 0 END) = 1""",
    "portal_counts": "SELECT CASE event_type WHEN 'click' THEN 'Taleo PanthTemps' WHEN 'view' THEN 'Taleo Staff' "
                     "WHEN 'error' THEN 'Faculty Careers' ELSE 'Unknown' END AS portal, count(*) AS jobs "
                     "FROM events GROUP BY 1",
    "site_rows": SITE,
    "newest_first": f"SELECT source_rank, ord, id, posted, row_number() OVER (ORDER BY {_NEWEST}) - 1 AS row_index FROM ({SITE}) s",
    "facet_institutions": _facet("institution"),
    "facet_locations": _facet("location", "LIMIT 40"),
    "facet_titles": _facet("title", "LIMIT 40"),
    "top_institutions": f"""SELECT institution, count(*) AS jobs FROM (
  SELECT *, row_number() OVER (ORDER BY {_NEWEST}) AS place FROM ({SITE}) s) ranked
GROUP BY institution ORDER BY count(*) DESC, min(place) LIMIT 10""",
    "quality_by_source": f"""SELECT source, count(*) AS n, count(*) FILTER (WHERE salary <> '') AS with_salary,
  count(*) FILTER (WHERE type <> '') AS with_type, count(*) FILTER (WHERE employment <> '') AS with_employment,
  count(*) FILTER (WHERE posted <> '') AS with_date FROM ({SITE}) s GROUP BY source""",
    "site_meta": f"""WITH site AS ({SITE}) SELECT '2026-01-01' AS last_updated, (SELECT count(*) FROM site) AS total,
  {_facet_list('institution')} AS institutions, {_facet_list('location', 'LIMIT 40')} AS locations""",
    "parse_dates": f"SELECT o_orderkey, raw, {parse_date('raw')} AS parsed, {typed_date('raw')} AS typed "
                   f"FROM ({S.plain(S.DATES)}) d",
    "job_text": f"""SELECT ord, array_to_string(list_filter([trim(title), trim(title), trim(title), trim(department),
  trim(summary)], lambda p: p <> ''), ' ') AS job_text FROM ({SITE}) s""",
    "text_scalars": f"""SELECT doc_id, {clean('text')} AS cleaned, {truncate(clean('text'), 600)} AS cut,
  rtrim(lower({clean('text')} || ' ::'), ':') AS label,
  rtrim(lower({clean('text')} || ' ::'), ': ') AS label_spaced,
  CAST(len(list_filter(regexp_split_to_array(text, '{WS}+'), lambda w: w <> '')) AS INT) AS words,
  source AS facet_name, n_chars AS facet_count, CAST(0 AS BIGINT) AS facet_none, CAST(doc_id AS VARCHAR) AS url_id,
  'https://jobs.example.org/postings/' || doc_id AS absolute, 'https://jobs.example.org/a/' || source AS relative,
  'https://jobs.example.org/detail?job=' || doc_id || '&lang=en' AS detail,
  lang || '  Close date: ' || source AS noted FROM documents""",
    "summary_repair": f"""SELECT doc_id, summary = '' OR starts_with(summary, 'Welcome. You') AS nav,
  CASE WHEN doc_id % 5 = 3 THEN body ELSE summary END AS unmarked,
  CASE WHEN length({_HEADLESS}) > 50 THEN {_HEADLESS} ELSE summary END AS unheaded,
  CASE WHEN doc_id % 2 = 0 THEN
    CASE WHEN doc_id % 5 IN (1, 2) THEN '[A] one ||  || [B] two'
      ELSE '[A] one || [Job Description - T - 12] Job Description T - 12 Description : ' || flat || ' || [B] two' END
    ELSE '' END AS new_extra,
  CASE WHEN doc_id % 5 IN (1, 2) AND doc_id % 2 = 0 THEN CASE WHEN length(flat) > 50 THEN flat ELSE summary END
    WHEN doc_id % 5 = 1 THEN '' ELSE summary END AS new_summary
FROM ({_KIND}) k""",
    "new_only_single": f"""SELECT ord, number, url FROM ({_CARDS}) c WHERE number = '' OR NOT EXISTS (
  SELECT 1 FROM ({_STORED}) s WHERE s.number = c.number)""",
    "new_only_dual": f"""SELECT ord, number, url FROM ({_CARDS}) c
WHERE NOT EXISTS (SELECT 1 FROM ({_STORED}) s WHERE s.number <> '' AND s.number = c.number)
  AND NOT EXISTS (SELECT 1 FROM ({_STORED}) s WHERE s.url <> ' ' AND s.url = c.url)""",
    "upsert_newest": f"""WITH n AS ({_last(_FETCHED, strip('url'))}), o AS ({_last(_STORED, strip('url'))})
SELECT * EXCLUDE (k) FROM n UNION ALL SELECT * EXCLUDE (k) FROM o WHERE k NOT IN (SELECT k FROM n)""",
    "upsert_canonical": f"""WITH n AS ({_last(_FETCHED, _CANON)}), o AS ({_dual(_STORED)})
SELECT * EXCLUDE (k), false AS carried FROM n
UNION ALL SELECT * EXCLUDE (k), true AS carried FROM o WHERE k NOT IN (SELECT k FROM n)""",
    "append_new": f"""SELECT * FROM ({_STORED}) s UNION ALL
SELECT * FROM ({_FETCHED}) f WHERE job_id NOT IN (SELECT job_id FROM ({_STORED}) s)""",
    "merge_accounting": f"""SELECT count(*) FILTER (WHERE n) AS total_listed, count(*) FILTER (WHERE n AND NOT e) AS new,
  count(*) FILTER (WHERE n AND e) AS skipped, count(*) FILTER (WHERE e AND NOT n) AS carried_over, count(*) AS total_after
FROM (SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AS e, b.k IS NOT NULL AS n
  FROM (SELECT DISTINCT url AS k FROM ({_STORED}) s WHERE trim(url) <> '') a
  FULL OUTER JOIN (SELECT DISTINCT url AS k FROM ({_FETCHED}) f WHERE trim(url) <> '') b ON a.k = b.k) j""",
    "dedup_dual_keyed": f"SELECT * EXCLUDE (k) FROM ({_dual(_CARDS)}) c",
    "expire_missing": f"SELECT * FROM ({_STORED}) s WHERE job_id IN (SELECT job_id FROM ({_FETCHED}) f)",
    "load_existing": f"SELECT * EXCLUDE (k) FROM ({_last(_CARDS, strip('url'))}) c",
    "enrich_listing": _ENRICHED,
    "stub_missing": f"""SELECT c.job_id, c.url, c.job_title, c.department, c.url AS apply_link, c.url AS posting_url
FROM ({S.plain(S.ORDER_CARDS)}) c WHERE c.job_id NOT IN (SELECT CAST(l_orderkey AS VARCHAR) FROM lineitem)""",
    "resolve_labels_exact": f"""SELECT page_id, ord, label, CASE label WHEN 'Job Summary' THEN 'job_summary'
  WHEN 'About Us' THEN 'about_us' WHEN 'Key Responsibilities' THEN 'responsibilities' END AS field
FROM ({S.plain(S.SECTION_LONG)}) l""",
    "resolve_labels_rules": f"SELECT page_id, ord, label, field FROM ({RESOLVED}) r",
    "resolve_labels_once": f"SELECT page_id, ord, label, field FROM ({RESOLVED}) r",
    "resolve_section_rules": f"""SELECT page_id, ord, label, CASE label WHEN 'Job Summary' THEN 'job_summary'
  WHEN 'About Us' THEN 'about_us' WHEN 'Key Responsibilities' THEN 'responsibilities'
  WHEN 'Compensation Range' THEN 'salary' END AS field
FROM ({S.plain(S.SECTION_LONG)}) l WHERE label NOT IN ('Location', 'USG Core Values') AND value <> ''""",
    "classify_keywords_table": f"SELECT page_id, ord, label, {_case('label', _KEYWORDS)} AS field "
                               f"FROM ({S.plain(S.KEYWORD_LONG)}) l",
    "classify_keywords_list": "SELECT page_id, ord, label, " + _case('label', {
        k: v for k, v in _KEYWORDS.items() if k != "Employee Status:"}) + f" AS field FROM ({S.plain(S.KEYWORD_LONG)}) l",
    "pivot_first": _pivot("arg_min(value, ord)"),
    "pivot_last": _pivot("arg_max(value, ord)"),
    "pivot_append": _pivot("string_agg(value, ' ' ORDER BY ord)"),
    "pivot_append_shifted": _pivot("string_agg(value, ' ' ORDER BY ord)"),
    "pack_extra": f"""SELECT page_id,
  string_agg('[' || label || '] ' || value, ' || ' ORDER BY ord) AS extra_sections
FROM ({RESOLVED}) r WHERE field IS NULL AND value <> '' GROUP BY page_id""",
    "join_duties": f"""WITH d AS (SELECT page_id, ord, label LIKE 'Duties%' AS duty, {clean('value')} AS v
  FROM ({S.plain(S.DUTIES)}) x),
g AS (SELECT *, sum(CAST(duty AS INT)) OVER (PARTITION BY page_id ORDER BY ord) AS grp FROM d WHERE v <> ''),
t AS (SELECT page_id, grp, string_agg(CASE WHEN duty THEN v ELSE '  [' || v || '% of time]' END, '' ORDER BY ord) AS txt
  FROM g WHERE grp > 0 GROUP BY page_id, grp)
SELECT page_id, string_agg(txt, ' | ' ORDER BY grp) AS duties_responsibilities
FROM t GROUP BY page_id""",    "join_duties_sparse": f"""WITH d AS (SELECT page_id, ord, label LIKE 'Duties%' AS duty, {clean('value')} AS v
  FROM ({S.plain(S.DUTIES)}) x),
g AS (SELECT *, sum(CAST(duty AS INT)) OVER (PARTITION BY page_id ORDER BY ord) AS grp FROM d WHERE v <> ''),
t AS (SELECT page_id, grp, string_agg(CASE WHEN duty THEN v ELSE '  [' || v || '% of time]' END, '' ORDER BY ord) AS txt
  FROM g WHERE grp > 0 GROUP BY page_id, grp)
SELECT page_id, string_agg(txt, ' | ' ORDER BY grp) AS duties_responsibilities
FROM t GROUP BY page_id""",
    "attach_followers": """SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN turn END)
  OVER (PARTITION BY conv_id ORDER BY turn) AS owner FROM conversations""",
    "take_while": """SELECT * EXCLUDE (stopped) FROM (SELECT *, max(CAST(starts_with(lower(text), 'a')
  OR starts_with(lower(text), 'e') OR starts_with(lower(text), 'the') OR starts_with(lower(text), 'un') AS INT))
  OVER (PARTITION BY conv_id ORDER BY turn) AS stopped FROM conversations) t WHERE stopped = 0""",
    "listing_valid": f"""WITH c AS (SELECT source || '-' || lang AS listing,
  CASE WHEN lang = 'de' THEN lang ELSE split_part(text, chr(10), 1) END AS title FROM documents),
t AS (SELECT listing, title, count(*) AS n FROM c GROUP BY listing, title)
SELECT listing, max(n) <= sum(n) * 0.5 AND coalesce(sum(n) FILTER (WHERE
  len(list_filter(regexp_split_to_array(title, '{WS}+'), lambda w: w <> '')) <= 2), 0) <= sum(n) * 0.5
  AS valid FROM t GROUP BY listing""",
    "fill_rate": f"""SELECT ord, CAST({' + '.join(f"CAST({c} <> '' AS INT)" for c in MASTER_NAMES)} AS INT) AS filled,
  24 AS columns, job_summary <> '' AS has_job_summary, required_qualifications <> '' AS has_required_qualifications,
  apply_link <> '' AS has_apply_link FROM ({MERGED}) m""",
    "fill_share": "SELECT " + ", ".join(f"round(avg(CAST({c} <> '' AS INT)), 6) AS {c}" for c in MASTER_NAMES)
                  + f" FROM ({MERGED}) m",
    "page_blocks": ORDERED_BLOCKS,
    "page_sections": PAGE_SECTIONS,
    "segment_by_heading": f"""SELECT page_id, coalesce(start, -1) AS section, heading, content
FROM ({SECTIONS}) s""",
    "page_real_content": f"""SELECT page_id, {' OR '.join(
        f"(length({c}) > 80 AND NOT contains({c}, 'Beginning of the main content section'))"
        for c in [*_SEC_COLS, 'extra_sections'])} AS real FROM ({PAGE_SECTIONS}) s""",
    "page_links": LINKS,
    "page_links_kept": f"SELECT * FROM ({LINKS}) l WHERE NOT (text = '' OR {has('text', '^[0-9›»<>]+$')} "
                       "OR lower(text) IN ('next', 'prev', 'previous'))",
    "page_apply_link": f"""SELECT p.page_id, coalesce(CASE WHEN starts_with(href, '/') THEN 'https://jobs.example.org' || href
  ELSE href END, p.url) AS apply_link FROM pages p LEFT JOIN (SELECT page_id, arg_min(href, ord) AS href
  FROM ({LINKS}) l WHERE {has('href', '(?i)/the')} GROUP BY page_id) a ON p.page_id = a.page_id""",
    "page_gate": """SELECT page_id, url FROM pages
WHERE length(html) > 5000 AND (contains(html, '<article>') OR contains(html, '<table>'))""",
    "page_shell": f"""SELECT page_id, contains(substring({strip(
        f"lower(substring(replace(replace(replace(replace(replace({sub(sub('html', _NOISE_HTML), '(?s)<[^>]*>')}, '&copy;', '©'), "
        "'&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), 1, 200))")}, 1, 100), 'the') AS shell FROM pages""",
    "page_label_values": f"""SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INT) AS ord, label, value
FROM (SELECT doc_id AS page_id, unnest([
  {{'i': 0, 'label': 'posting number', 'value': job_id}}, {{'i': 1, 'label': 'job title', 'value': {clean('job_title')}}},
  {{'i': 2, 'label': 'working title', 'value': 'second title'}}, {{'i': 3, 'label': 'percentage of time', 'value': '99'}},
  {{'i': 4, 'label': 'duties/responsibilities', 'value': {clean('responsibilities')}}},
  {{'i': 5, 'label': 'percentage of time', 'value': '40'}},
  {{'i': 6, 'label': 'duties/responsibilities', 'value': 'Second duty'}},
  {{'i': 7, 'label': 'percentage of time', 'value': '60'}}, {{'i': 8, 'label': 'advertised salary', 'value': salary}},
  {{'i': 9, 'label': 'position summary', 'value': {clean('job_summary')}}},
  {{'i': 10, 'label': 'unknown thing', 'value': 'dropped'}}], recursive := true) FROM ({_RAW}) r) u WHERE value <> ''""",
    "page_cell_values": f"""SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INT) AS ord, label, value
FROM (SELECT doc_id AS page_id, unnest([
  {{'i': 0, 'label': 'organization', 'value': institution}}, {{'i': 1, 'label': 'campus', 'value': {clean('location')}}},
  {{'i': 2, 'label': 'closing date', 'value': 'soon'}}, {{'i': 3, 'label': 'description', 'value': {clean('job_summary')}}},
  {{'i': 4, 'label': 'duties', 'value': {clean('responsibilities')}}}, {{'i': 5, 'label': 'work hours', 'value': 'nineto five'}}],
  recursive := true) FROM ({_RAW}) r) u WHERE value <> ''""",
    "page_list_values": f"""SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INT) AS ord, label, value
FROM (SELECT doc_id AS page_id, unnest([{{'i': 0, 'label': 'rank', 'value': full_part_time}},
  {{'i': 1, 'label': 'open date', 'value': posted_date}}, {{'i': 2, 'label': 'deadline', 'value': 'none'}}],
  recursive := true) FROM ({_RAW}) r) u WHERE value <> ''""",
    "page_indexed_fields": f"""SELECT doc_id AS page_id, CAST(i - 1 AS INT) AS ord, ['Job Summary', 'Position Overview',
  'USG Core Values', 'Conditions', 'Shift'][i] AS label, ['Old summary', {clean('job_summary')}, 'boilerplate',
  department, {clean('responsibilities')}][i] AS value FROM ({_RAW}) r, range(1, 6) t(i)""",
    "listing_spans": f"""SELECT doc_id AS page_id, 0 AS ord, job_id, {clean('job_title')} AS job_title, institution,
  '' AS department, {clean('location')} AS location, posted_date FROM ({_RAW}) r
UNION ALL SELECT doc_id, 1, job_id || 'b', 'Second', '', '', '', '' FROM ({_RAW}) r""",
    "listing_cards": f"""SELECT doc_id AS page_id, 0 AS ord, CAST(doc_id AS VARCHAR) AS job_id,
  'https://jobs.example.org/postings/' || doc_id AS url, {clean('job_title')} AS title, institution AS department,
  {first(clean('location'), "'Atlanta, Georgia'")} AS location FROM ({_RAW}) r
UNION ALL SELECT doc_id, 1, '7' || doc_id, 'https://other.example.org/postings/7' || doc_id, 'Other', '',
  'Atlanta, Georgia' FROM ({_RAW}) r""",
    "listing_rows": f"""SELECT doc_id AS page_id, 0 AS ord, CAST(doc_id AS VARCHAR) AS job_id,
  'https://jobs.example.org/detail?job=' || doc_id || '&lang=en' AS url, {clean('job_title')} AS title,
  coalesce(nullif(institution, ''), posted_date) AS department,
  {clean('location')} AS location, posted_date FROM ({_RAW}) r WHERE {clean('job_title')} <> ''""",
    "listing_grid": f"""SELECT doc_id AS page_id, 0 AS ord, CAST(doc_id AS VARCHAR) AS posting_id,
  'https://jobs.example.org/postings/' || doc_id AS posting_url, {clean('job_title')} AS working_title,
  job_id AS posting_number, institution AS department, 'Staff' AS position_type, {clean('close_date')} AS close_date
FROM ({_RAW}) r""",
    "listing_links": f"""SELECT page_id, ord, job_id, url, title, 'Atlanta, Georgia' AS location FROM (
  SELECT doc_id AS page_id, 0 AS ord, CAST(doc_id AS VARCHAR) AS job_id, 'https://jobs.example.org/postings/' || doc_id AS url,
    {clean('job_title')} AS title FROM ({_RAW}) r
  UNION ALL SELECT doc_id, 1, '7' || doc_id, 'https://other.example.org/postings/7' || doc_id, 'Other' FROM ({_RAW}) r) x
WHERE NOT (title = '' OR {has('title', '^[0-9›»<>]+$')} OR lower(title) IN ('next', 'prev', 'previous'))""",
    "postings_tables": f"""SELECT doc_id AS page_id, {_landed('job_id')} AS posting_number,
  {_landed(first(clean('job_title'), "'second title'"))} AS working_title, close_date, {_landed('salary')} AS salary,
  {_landed(clean('job_summary'))} AS position_summary,
  {_landed(f"{clean('responsibilities')} || '  [40% of time] | Second duty  [60% of time]'")} AS duties_responsibilities,
  '' AS department, {_landed("'https://jobs.example.org/pre_apply/' || job_id || '?a=1&b=2'")} AS apply_link,
  {_PAGE_URL} AS posting_url, NOT ({_IN}) AS stub FROM {_LANDED}""",
    "postings_spans": f"""SELECT doc_id AS page_id, job_id, {_landed(first(clean('job_title'), "'Card title'"), "'Card title'")}
  AS job_title, {_landed('full_part_time')} AS full_part_time, {_landed(clean('job_summary'))} AS job_summary,
  '' AS about_us, {_landed(f"'[Conditions] ' || {clean('department')} || ' || [Shift] ' || {clean('responsibilities')}")}
  AS extra_sections, {_PAGE_URL} AS apply_link, {_PAGE_URL} AS posting_url, NOT ({_IN}) AS stub FROM {_LANDED}""",
    "postings_cells": f"""SELECT doc_id AS page_id, 'Card title' AS job_title,
  {_landed(first('institution', 'department'), 'department')} AS department, {_landed(clean('location'))} AS location,
  {_landed(clean('job_summary'))} AS job_summary, {_landed(clean('responsibilities'))} AS responsibilities,
  {_landed("'Close date: soon'")} AS other_information, {_landed("'[Work Hours] nine to five'")} AS extra_sections,
  {_PAGE_URL} AS apply_link, NOT ({_IN}) AS stub FROM {_LANDED}""",
    "postings_lists": f"""SELECT doc_id AS page_id, {_landed(first(clean('job_title'), "'Card title'"), "'Card title'")}
  AS job_title, 'Atlanta, Georgia' AS location, {_landed('full_part_time')} AS full_part_time,
  {_landed('posted_date')} AS posted_date, {_landed(clean('job_summary'))} AS job_summary,
  {_landed(f"{clean('required_qualifications')} || ' Degree'")} AS required_qualifications,
  {_landed("'Close date: none'")} AS other_information, {_landed("'[Our Town] nice'")} AS extra_sections,
  {_landed("'https://jobs.example.org/postings/1/apply'", _PAGE_URL)} AS apply_link, NOT ({_IN}) AS stub FROM {_LANDED}""",
    "pages_to_master": f"""SELECT doc_id AS ord, source_key,
  CASE WHEN source_key = 's0' THEN 'Card' WHEN source_key = 's3' OR NOT ({_IN}) OR {clean('job_title')} = '' THEN 'Card'
    ELSE {clean('job_title')} END AS job_title,
  CASE source_key WHEN 's0' THEN {q(_NAMES['s0'])} WHEN 's3' THEN {q(_NAMES['s3'])}
    WHEN 's1' THEN coalesce(nullif({clean('institution')}, ''), {q(_NAMES['s1'])}) ELSE {clean('institution')} END AS institution,
  CASE WHEN source_key = 's0' THEN '' ELSE posted_date END AS posted_date,
  {_landed(clean('job_summary'))} AS job_summary,
  {_landed(f"CASE source_key WHEN 's0' THEN {clean('responsibilities')} || ' [40% of time] | Second duty [60% of time]' "
           f"WHEN 's3' THEN {clean('responsibilities')} ELSE '' END")} AS responsibilities,
  {_PAGE_URL} AS posting_url, CASE WHEN source_key = 's0' THEN
    {_landed("'https://jobs.example.org/pre_apply/' || job_id || '?a=1&b=2'")} ELSE {_PAGE_URL} END AS apply_link,
  CASE source_key WHEN 's0' THEN 'UGA (PeopleAdmin)' WHEN 's1' THEN 'Georgia Tech (OneHCM)'
    WHEN 's2' THEN 'USG OneHCM' ELSE 'Georgia State University' END AS source,
  '2026-01-01T00:00:00+00:00' AS scraped_at FROM {_LANDED}""",
    "l2_normalise_vectors": """SELECT vec_id, CAST(i - 1 AS INT) AS dim, round(CAST(CAST(CASE WHEN n = 0 THEN 0 ELSE v[i] / n END AS FLOAT) AS DOUBLE), 5) AS x
FROM (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM (SELECT vec_id,
  list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(CAST(x * (vec_id % 7) AS FLOAT) AS DOUBLE)) AS v FROM embeddings) a) b,
  range(1, 65) t(i)""",
    "similar_top5": _SIMILAR,
    "similar_top5_blocks": _SIMILAR,
    "similar_indexed": """SELECT count(*) AS queries, count(*) * least(5, (SELECT count(*) FROM embeddings)) AS wanted,
  true AS reached FROM embeddings WHERE vec_id % 50 = 0""",
    "publish_and_search": f"SELECT id AS query_id, CAST(1.0 AS DOUBLE) AS score FROM ({SITE}) s",
    "row_index": """SELECT conv_id AS id, max(place) AS row_index FROM (SELECT conv_id,
  row_number() OVER (ORDER BY length(text), conv_id, turn) - 1 AS place FROM conversations) r GROUP BY conv_id""",
    "write_vectors": """SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row_index, CAST(vec_id AS VARCHAR) AS id,
  CAST(len(embedding) AS INT) AS dimensions FROM embeddings""",
    "csv_roundtrip": f"""SELECT job_id, '"T", ' || job_title AS job_title, institution, location, salary, job_summary,
  '' AS missing FROM ({_RAW}) r""",
    "csv_sources": f"""SELECT source_key, count(*) AS loaded FROM (SELECT *, row_number() OVER (PARTITION BY
  coalesce(nullif(posting_url, ''), job_id) ORDER BY source_rank, ord) AS rn FROM ({MASTER}) m
  WHERE job_title <> '' AND source_key IN ('s0', 's2')) r WHERE rn = 1 GROUP BY source_key""",
    "records_roundtrip": f"SELECT job_id, job_title, institution, location, salary, job_summary FROM ({_RAW}) r",
    "listing_documents": """SELECT CAST(doc_id AS VARCHAR) AS job_id, coalesce(source, '') AS job_title,
  coalesce(text, '') AS job_summary, '' AS salary FROM documents""",
    "site_documents": "SELECT CAST(doc_id AS VARCHAR) AS job_id, source AS job_title, text AS job_summary FROM documents",
    "input_order": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents",
    "site_published": f"""SELECT source, count(*) AS jobs FROM ({SITE}) s GROUP BY source
UNION ALL SELECT 'total', count(*) FROM ({SITE}) s""",
    "feed_roundtrip": """SELECT CAST(doc_id AS VARCHAR) AS posting_id,
  CASE WHEN lang = 'en' THEN 'https://feed.example.org/' ELSE 'https://jobs.example.org/postings/' END || doc_id AS posting_url,
  'Job in ' || lang || ' ' || source AS working_title,
  CASE WHEN lang = 'en' THEN '2026-01-02' ELSE '2026-02-03' END AS published FROM documents WHERE lang <> 'de'""",
    "resumable_append": f"SELECT ord, version FROM ({_STORED}) s UNION ALL SELECT ord, version FROM ({_FETCHED}) f "
                        f"UNION ALL SELECT ord, version FROM ({_STORED}) t",
    "event_status": f"SELECT event_id, effect AS status, CAST(ends AS BIGINT) AS ends FROM ({_EFFECTS}) e",
    "profile_status": _LATEST,
    "status_stream": f"""SELECT event_id, user_id, effect AS subscription_status FROM ({_EFFECTS}) e
JOIN ({_CUSTOMERS}) c USING (customer) WHERE effect IS NOT NULL AND user_id <> ''""",
    "profile_stream": f"""SELECT c.user_id, coalesce(l.customer, '') AS customer,
  coalesce(l.subscription_status, 'free') AS subscription_status, l.ends, l.at
FROM ({_CUSTOMERS}) c LEFT JOIN ({_LATEST}) l ON c.user_id = l.user_id WHERE c.user_id <> ''""",
    "profile_stream_arrival": f"""SELECT c.user_id, coalesce(l.customer, '') AS customer,
  coalesce(l.subscription_status, 'free') AS subscription_status, l.ends, l.at
FROM ({_CUSTOMERS}) c LEFT JOIN ({_ARRIVED}) l ON c.user_id = l.user_id WHERE c.user_id <> ''""",
    "ingest_stream": f"SELECT DISTINCT customer || '-' || type AS job_id FROM ({_EVENTS}) e",
    "ingest_restart": f"SELECT DISTINCT customer || '-' || type AS job_id FROM ({_EVENTS}) e",
    "dedup_stream": f"SELECT event_id, type FROM ({_EVENTS}) e",
}
