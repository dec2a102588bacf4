"""Posting-shaped inputs derived from the given tables, as SQL both engines run.

Every text reads whole tables. `{name}` stands for a table; Spark gets a DataFrame
there, the check engine a view name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.mapping import conform
from ..schemas import SOURCES, strings

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def run(spark: SparkSession, sf: str, sql: str, **frames: DataFrame) -> DataFrame:
    """A template over given tables (and named frames)."""
    inputs = {t: table(spark, sf, t) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **inputs, **frames)


def plain(sql: str) -> str:
    """The template over view names."""
    return sql.format(**{t: t for t in TABLES})


# --- raw postings -------------------------------------------------------------------

RAW = """
SELECT doc_id AS ord, doc_id, source_key, CAST(substring(source_key, 2) AS INT) AS source_rank,
  'P' || CAST(doc_id AS STRING) AS job_id,
  CASE WHEN doc_id % 50 = 0 THEN ' ' ELSE split_part(text, chr(10), 1) END AS job_title,
  CASE WHEN source_key = 's1' AND doc_id % 3 = 0 THEN '' ELSE source END AS institution,
  CASE WHEN source_key = 's3' AND doc_id % 5 = 1
       THEN 'Main Office - 123456 Description: Job Type: Part-Time Anticipated Hiring Range: $79,400- $103,200'
       WHEN source_key = 's3' AND doc_id % 5 = 2
       THEN 'Return to the home page Salary : $50,000 (minimum) - $60,000 Job Type: Full Time'
       ELSE lang END AS department,
  CASE doc_id % 7 WHEN 0 THEN 'Remote' WHEN 1 THEN 'Atlanta,' || chr(160) || ' Georgia'
       WHEN 2 THEN ' Athens ' WHEN 3 THEN '' WHEN 4 THEN 'Fully remote (US)' WHEN 5 THEN 'Macon'
       ELSE 'Savannah' END AS location,
  CASE doc_id % 8
    WHEN 0 THEN substring(ds, 6, 2) || '/' || substring(ds, 9, 2) || '/' || substring(ds, 1, 4)
    WHEN 1 THEN ds
    WHEN 2 THEN substring('JanFebMarAprMayJunJulAugSepOctNovDec', (CAST(substring(ds, 6, 2) AS INT) - 1) * 3 + 1, 3)
                || ' ' || substring(ds, 9, 2) || ', ' || substring(ds, 1, 4)
    WHEN 3 THEN substring(ds, 6, 2) || '-' || substring(ds, 9, 2) || '-' || substring(ds, 1, 4)
    WHEN 4 THEN substring(ds, 1, 4) || '/' || substring(ds, 6, 2) || '/' || substring(ds, 9, 2)
    WHEN 5 THEN substring(ds, 6, 2) || '/' || substring(ds, 9, 2) || '/' || substring(ds, 3, 2)
    WHEN 6 THEN ds || 'T10:00:00'
    ELSE '' END AS posted_date,
  CASE doc_id % 3 WHEN 0 THEN 'Open until filled' WHEN 1 THEN ' ' || ds ELSE '02/30/2026' END AS close_date,
  CASE doc_id % 5 WHEN 0 THEN 'Full Time' WHEN 1 THEN 'part-time' WHEN 2 THEN 'Full/Part' WHEN 3 THEN ''
       ELSE 'Flexible' END AS full_part_time,
  CASE doc_id % 3 WHEN 0 THEN 'Regular' WHEN 1 THEN 'Contract' ELSE '' END AS regular_temporary,
  'Employee' AS employment_type,
  CASE doc_id % 6 WHEN 1 THEN '$52,000 - $61,000' WHEN 2 THEN '$18.50 per hour'
       WHEN 3 THEN 'Pay for this position is set by experience, education and market data reviewed each year. '
                || 'The range is $47,040 to $57,300. Benefits are listed separately.'
       ELSE '' END AS salary,
  CASE WHEN doc_id % 6 = 4 THEN '[Notes] n/a || [Salary Range] $47,040 to $57,300' ELSE '' END AS extra_sections,
  CASE WHEN doc_id % 11 = 0 THEN 'Short summary.'
       WHEN doc_id % 6 = 5 THEN 'Salary: $79,400 - $103,200. ' || text ELSE text END AS job_summary,
  CASE WHEN doc_id % 12 = 0 THEN 'Cleans the hall for $15.67 /hr.' ELSE 'Duties of ' || source END AS responsibilities,
  lang || ' required' AS required_qualifications,
  CASE WHEN doc_id % 4 = 1 THEN 'Apply  early' ELSE '' END AS special_instructions,
  CASE WHEN doc_id % 3 = 1 THEN '1.0' ELSE '' END AS fte,
  CASE WHEN doc_id % 2 = 1 THEN 'Exempt' ELSE '' END AS flsa,
  CASE WHEN doc_id % 2 = 0 THEN 'Yes' ELSE 'No' END AS position_of_trust,
  CASE WHEN doc_id % 3 = 0 THEN 'YES' ELSE '' END AS p_card_required,
  CASE doc_id % 3 WHEN 0 THEN '?apply=true' WHEN 1 THEN ''
       ELSE 'https://jobs.example.org/apply/' || CAST(doc_id AS STRING) END AS apply_link,
  CASE WHEN doc_id % 9 = 0 THEN '' ELSE 'https://jobs.example.org/postings/' || md5(text) END AS posting_url,
  ds || 'T00:00:00+00:00' AS scraped_at
FROM (
  SELECT doc_id, text, lang, source,
         's' || CAST(CAST(substring(source, 4) AS INT) % 4 AS STRING) AS source_key,
         CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INT) AS STRING) AS ds
  FROM {documents}
) d
"""

# Raw columns that carry another name in the first source.
S0_NAMES = {
    "posting_number": "job_id", "working_title": "job_title", "posting_date": "posted_date",
    "position_summary": "job_summary", "duties_responsibilities": "responsibilities",
    "minimum_qualifications": "required_qualifications",
}


def raw_postings(spark, sf) -> DataFrame:
    return run(spark, sf, RAW)


def raw_sources(spark, sf) -> dict[str, DataFrame]:
    """The stand-in split into the four source tables, each in its own columns."""
    raw = raw_postings(spark, sf)
    out = {}
    for key, source in SOURCES.items():
        names = S0_NAMES if key == "s0" else {"other_information": "special_instructions"}
        rows = raw.where(F.col("source_key") == key)
        for new, old in names.items():
            rows = rows.withColumn(new, F.col(old))
        out[key] = conform(rows, strings(source.columns), keep=("ord",))
    return out


# --- incremental stand-ins -------------------------------------------------------------

_POSTING = """doc_id AS ord, 'P' || CAST(doc_id AS STRING) AS job_id,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'P' || CAST(doc_id AS STRING) END AS number,
  CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE 'https://jobs.example.org/postings/' || md5(text) END AS url,
  split_part(text, chr(10), 1) AS title"""

CARDS = f"SELECT {_POSTING} FROM {{documents}}"

# A document with a label counts as stored; a low-quality one is fetched again.
STORED = f"SELECT {_POSTING}, 'old' AS version FROM {{documents}} JOIN {{labels}} USING (doc_id)"
FETCHED = (f"SELECT {_POSTING}, 'new' AS version FROM {{documents}} LEFT JOIN {{labels}} USING (doc_id) "
           "WHERE quality IS NULL OR quality = 0")

ORDER_CARDS = """
SELECT CAST(o_orderkey AS STRING) AS job_id,
  CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderpriority END AS job_title,
  o_orderstatus AS department, 'https://jobs.example.org/o/' || CAST(o_orderkey AS STRING) AS url
FROM {orders}
"""
LINE_DETAILS = """
SELECT CAST(l_orderkey AS STRING) AS job_id,
  CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag || ' flag' END AS job_title,
  CASE WHEN l_linestatus = 'O' THEN '' ELSE 'line ' || l_linestatus END AS department,
  CASE WHEN l_returnflag = 'R' THEN 'https://jobs.example.org/l/' || CAST(l_partkey AS STRING) ELSE '' END AS apply_link,
  l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus
FROM {lineitem}
"""

DATES = """
SELECT o_orderkey, CASE o_orderkey % 9
    WHEN 0 THEN substring(ds, 6, 2) || '/' || substring(ds, 9, 2) || '/' || substring(ds, 1, 4)
    WHEN 1 THEN ds
    WHEN 2 THEN substring('JanFebMarAprMayJunJulAugSepOctNovDec', (CAST(substring(ds, 6, 2) AS INT) - 1) * 3 + 1, 3)
                || ' ' || substring(ds, 9, 2) || ', ' || substring(ds, 1, 4)
    WHEN 3 THEN substring(ds, 6, 2) || '-' || substring(ds, 9, 2) || '-' || substring(ds, 1, 4)
    WHEN 4 THEN ' ' || substring(ds, 1, 4) || '/' || substring(ds, 6, 2) || '/' || substring(ds, 9, 2) || ' '
    WHEN 5 THEN substring(ds, 6, 2) || '/' || substring(ds, 9, 2) || '/' || substring(ds, 3, 2)
    WHEN 6 THEN ds || 'T10:00:00'
    WHEN 7 THEN substring(ds, 9, 2) || '.' || substring(ds, 6, 2) || '.' || substring(ds, 1, 4)
    ELSE substring(ds, 9, 2) || '/31/' || substring(ds, 1, 4) END AS raw
FROM (SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS STRING) AS ds FROM {orders}) o
"""

# --- label tables ----------------------------------------------------------------------

LONG = """
SELECT conv_id AS page_id, turn AS ord, text AS value,
  CASE WHEN role = 'system' THEN 'Date Posted' ELSE
  CASE turn WHEN 0 THEN 'Working Title:' WHEN 1 THEN 'Job Description' WHEN 2 THEN 'Advertised Salary:'
    WHEN 3 THEN 'Pay Range' WHEN 4 THEN 'Something Else' WHEN 5 THEN 'Minimum Requirements'
    WHEN 6 THEN 'Dept Name' ELSE 'Closing Note' END END AS label
FROM {conversations}
"""
KEYWORD_LONG = """
SELECT conv_id AS page_id, turn AS ord, text AS value,
  CASE WHEN role = 'system' THEN 'Employing Unit' ELSE
  CASE turn WHEN 0 THEN 'Campus :' WHEN 1 THEN 'Type of Position' WHEN 2 THEN 'Employee Status:'
    WHEN 3 THEN 'Opening Date' WHEN 4 THEN 'Application Deadline' WHEN 5 THEN 'Department / Location'
    ELSE 'Hobby' END END AS label
FROM {conversations}
"""
SECTION_LONG = """
SELECT conv_id AS page_id, turn AS ord, text AS value,
  CASE WHEN role = 'system' THEN 'Location' ELSE
  CASE turn WHEN 0 THEN 'Job Summary' WHEN 1 THEN 'USG Core Values' WHEN 2 THEN 'About Us'
    WHEN 3 THEN 'Key Responsibilities' WHEN 4 THEN 'Compensation Range' ELSE 'Notes' END END AS label
FROM {conversations}
"""
DUTIES = """
SELECT conv_id AS page_id, turn AS ord,
  CASE role WHEN 'user' THEN 'Duties/Responsibilities:' ELSE 'Percentage Of Time' END AS label,
  CASE role WHEN 'user' THEN text ELSE CAST(10 + turn * 5 AS STRING) END AS value
FROM {conversations}
"""

# --- events ----------------------------------------------------------------------------

EVENTS = """
SELECT CAST(event_id AS STRING) AS event_id, CAST(ts AS TIMESTAMP) AS ts,
  CASE event_type WHEN 'signup' THEN 'checkout.session.completed'
    WHEN 'purchase' THEN 'customer.subscription.updated' WHEN 'error' THEN 'invoice.payment_failed'
    WHEN 'view' THEN 'customer.subscription.deleted' ELSE 'customer.created' END AS type,
  CASE WHEN event_id % 2 = 0 THEN 'subscription' ELSE 'payment' END AS mode,
  CAST(user_id AS STRING) AS customer,
  CASE WHEN value >= 20 THEN 'active' ELSE 'canceled' END AS status,
  CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id * 1000 END AS current_period_end
FROM {events}
"""
CUSTOMERS = """
SELECT CAST(c_custkey AS STRING) AS customer,
  CASE WHEN c_acctbal < 0 THEN '' ELSE 'u' || CAST(c_custkey AS STRING) END AS user_id
FROM {customer}
"""

# --- pages built from postings -----------------------------------------------------------


def _esc(c: str) -> str:
    return f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _tr(label: str, value: str, tags: tuple[str, str] = ("th", "td")) -> str:
    a, b = tags
    return f"'<tr><{a}>{label}</{a}><{b} class=\"v\">' || {value} || '</{b}></tr>'"


def _span(span_id: str, value: str) -> str:
    return f"'<span id=\"{span_id}\" class=\"t\">' || {value} || '</span>'"


_URL = "'https://jobs.example.org/p/' || job_id"

TABLE_PAGES = f"""
SELECT doc_id AS page_id, {_URL} AS url, '<html><head><title>t</title></head><body><table>'
  || {_tr('Posting Number:', 'job_id')} || {_tr('Job Title', _esc('job_title'))}
  || {_tr('Working Title', "'second title'")} || {_tr('Percentage of Time', "'99'")}
  || {_tr('Duties/Responsibilities', _esc('responsibilities'))} || {_tr('Percentage Of Time:', "'40'")}
  || {_tr('Duties/Responsibilities', "'Second duty'")} || {_tr('Percentage Of Time:', "'60'")}
  || {_tr('Dept Name', "''")} || {_tr('Advertised Salary', _esc('salary'))}
  || {_tr('Position Summary', _esc('job_summary'))} || {_tr('Unknown thing', "'dropped'")}
  || '</table><a href="/help">Help</a><a class="b" href="/pre_apply/' || job_id || '?a=1&amp;b=2">Apply</a></body></html>' AS html
FROM ({RAW}) r
"""

SPAN_PAGES = f"""
SELECT doc_id AS page_id, {_URL} AS url, '<html><body>'
  || {_span('HRS_SCH_WRK2_POSTING_TITLE', _esc('job_title'))}
  || {_span('HRS_SCH_WRK_HRS_FULL_PART_TIME', 'full_part_time')}
  || {_span('HRS_SCH_WRK_DESCR100$0lbl', "'Job Summary'")}
  || {_span('HRS_SCH_PSTDSC_DESCRLONG$0', "'<span>Old</span> summary'")}
  || {_span('HRS_SCH_WRK_DESCR100$1lbl', "'Position Overview'")}
  || {_span('HRS_SCH_PSTDSC_DESCRLONG$1', "'<p><span class=\"q\">' || " + _esc('job_summary') + " || '</span></p>'")}
  || {_span('HRS_SCH_WRK_DESCR100$2lbl', "'USG Core Values'")}
  || {_span('HRS_SCH_PSTDSC_DESCRLONG$2', "'boilerplate'")}
  || {_span('HRS_SCH_WRK_DESCR100$3lbl', "'Conditions'")}
  || {_span('HRS_SCH_PSTDSC_DESCRLONG$3', "department")}
  || {_span('HRS_SCH_WRK_DESCR100$4lbl', "'Shift'")}
  || {_span('HRS_SCH_PSTDSC_DESCRLONG$4', _esc('responsibilities'))}
  || {_span('HRS_SCH_WRK_DESCR100$6lbl', "'Behind the gap'")}
  || {_span('HRS_SCH_PSTDSC_DESCRLONG$6', "'never read'")}
  || '</body></html>' AS html
FROM ({RAW}) r
"""

CELL_PAGES = f"""
SELECT doc_id AS page_id, {_URL} AS url, '<html><body><table>'
  || {_tr('Organization :', "'<b>' || lang_name || '</b>'", ('td', 'td'))}
  || {_tr('Campus', 'location', ('td', 'td'))} || {_tr('Closing Date', "'soon'", ('td', 'td'))}
  || {_tr('Description', "'<p>' || " + _esc('job_summary') + " || '</p>'", ('th', 'td'))}
  || {_tr('Duties', _esc('responsibilities'), ('td', 'td'))}
  || {_tr('work hours', "'nine<br>to five'", ('td', 'td'))}
  || '</table></body></html>' AS html
FROM (SELECT r0.*, institution AS lang_name FROM ({RAW}) r0) r
"""

LIST_PAGES = f"""
SELECT doc_id AS page_id, {_URL} AS url, '<html><body><nav>x</nav><h1 class="posting-header">' || {_esc('job_title')}
  || '</h1><dl class="dl-horizontal"><dt>Rank:</dt><dd>' || full_part_time || '</dd><dt>Open Date</dt><dd>'
  || posted_date || '</dd><dt>Deadline</dt><dd>none</dd></dl><div class="posting-description"><div><p>'
  || {_esc('job_summary')} || '</p></div><b>Qualifications:</b><ul><li>' || {_esc('required_qualifications')}
  || '</li><li>Degree</li></ul><h3>Our Town</h3><p>nice</p></div><a href="/postings/1/apply">Go</a></body></html>' AS html
FROM ({RAW}) r
"""

# One listing page per posting, with two cards and a gap.
SPAN_LISTINGS = f"""
SELECT doc_id AS page_id, '' AS url, '<html><body>'
  || {_span('SCH_JOB_TITLE$0', _esc('job_title'))} || {_span('HRS_APP_JBSCH_I_HRS_JOB_OPENING_ID$0', 'job_id')}
  || {_span('HRS_BU_DESCR$0', 'institution')} || {_span('LOCATION$0', 'location')}
  || {_span('SCH_OPENED$0', 'posted_date')}
  || {_span('SCH_JOB_TITLE$1', "'Second'")} || {_span('HRS_APP_JBSCH_I_HRS_JOB_OPENING_ID$1', "job_id || 'b'")}
  || {_span('SCH_JOB_TITLE$3', "'Behind the gap'")}
  || '</body></html>' AS html
FROM ({RAW}) r
"""

BLOCK_LISTINGS = f"""
SELECT doc_id AS page_id, '' AS url, '<html><body><div class="row posting"><h3 class="posting-title"><a href="/postings/'
  || CAST(doc_id AS STRING) || '">' || {_esc('job_title')} || '</a></h3><div class="posting-category-department">'
  || institution || '</div><div class="posting-category-location">' || location
  || '</div></div><div class="posting-block"><a href="https://other.example.org/postings/7' || CAST(doc_id AS STRING)
  || '">Other</a></div><div class="row posting">no link</div></body></html>' AS html
FROM ({RAW}) r
"""

ROW_LISTINGS = f"""
SELECT doc_id AS page_id, '' AS url, '<table><tr class="ftlrow"><td><div id="9">template</div></td></tr>'
  || '<tr class="ftlcopy ftlrow" id="x.row"><td><div class="iconcontentpanel" id="' || CAST(doc_id AS STRING)
  || '"><a id="a.reqTitleLink.row1">' || {_esc('job_title')} || '</a><span id="a.reqBasicLocation.row1">' || location
  || '</span><span>Department Name</span><span>:</span><span>' || institution
  || '</span><span id="a.reqPostingDate.row1">' || posted_date || '</span></div></td></tr></table>' AS html
FROM ({RAW}) r
"""

GRID_LISTINGS = f"""
SELECT doc_id AS page_id, '' AS url, '<div class="row head"><div class="col-md-2">Title</div></div><div class="job row"><div class="col-md-2"><a href="/postings/'
  || CAST(doc_id AS STRING) || '">' || {_esc('job_title')} || '</a></div><div class="col-md-2">' || job_id
  || '</div><div class="col-md-2 x">' || institution || '</div><div class="col-md-2">Staff</div><div class="col-md-2">'
  || close_date || '</div></div>' AS html
FROM ({RAW}) r
"""
