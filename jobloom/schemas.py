"""Column lists, the source registry and source-to-master mappings.

All tables are strings with `''` for "no value"; only the site table's `remote`
is boolean.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Column names and their order in each published table.
# ---------------------------------------------------------------------------

S0_COLUMNS = [
    "posting_number", "working_title", "department", "about_department", "department_website",
    "posting_type", "retirement_plan", "employment_type", "benefits_eligibility",
    "full_part_time", "work_schedule", "schedule_info", "salary", "posting_date",
    "open_until_filled", "close_date", "proposed_start_date", "special_instructions", "location",
    "classification_title", "flsa", "fte", "minimum_qualifications", "preferred_qualifications",
    "position_summary", "knowledge_skills_abilities", "physical_demands", "driving_required",
    "position_of_trust", "financial_responsibility", "p_card_required", "children_interaction",
    "security_access", "duties_responsibilities", "contact_name", "contact_email",
    "contact_phone", "apply_link", "posting_url", "scraped_at",
]

S1_COLUMNS = [
    "job_id", "job_title", "institution", "department", "location", "posted_date",
    "full_part_time", "regular_temporary", "salary", "location_detail", "about_us",
    "job_summary", "responsibilities", "required_qualifications", "preferred_qualifications",
    "knowledge_skills_abilities", "other_information", "background_check", "extra_sections",
    "apply_link", "posting_url", "scraped_at",
]

S3_COLUMNS = [
    "job_id", "job_title", "institution", "department", "location", "posted_date",
    "full_part_time", "regular_temporary", "location_detail", "about_us", "job_summary",
    "responsibilities", "required_qualifications", "preferred_qualifications",
    "knowledge_skills_abilities", "other_information", "background_check", "salary",
    "extra_sections", "apply_link", "posting_url", "scraped_at",
]

MASTER_COLUMNS = [
    "job_id", "job_title", "institution", "department", "location", "posted_date", "close_date",
    "full_part_time", "regular_temporary", "employment_type", "salary", "about_us",
    "job_summary", "responsibilities", "required_qualifications", "preferred_qualifications",
    "knowledge_skills", "other_information", "background_check", "extra_sections", "apply_link",
    "posting_url", "source", "scraped_at",
]

SITE_COLUMNS = [
    "id", "title", "institution", "department", "location", "remote", "posted", "closes", "type",
    "employment", "salary", "salary_type", "summary", "view", "apply", "source",
]

SECTION_COLUMNS = [
    "about_us", "job_summary", "responsibilities", "required_qualifications",
    "preferred_qualifications", "knowledge_skills_abilities", "other_information",
    "background_check",
]

CARD_COLUMNS = ["job_id", "job_title", "institution", "department", "location", "posted_date"]

# ---------------------------------------------------------------------------
# Institution and source display names.
# ---------------------------------------------------------------------------

INSTITUTIONS = {
    "s0": "University of Georgia",
    "s1": "Georgia Institute of Technology",
    "s3": "Georgia State University",
}

SOURCE_LABELS = {
    "s0": "UGA (PeopleAdmin)",
    "s1": "Georgia Tech (OneHCM)",
    "s2": "USG OneHCM",
    "s3": "Georgia State University",
}

# Fixed value: the one source whose department column may hold a whole description.
BLOB_SOURCE = SOURCE_LABELS["s3"]


def strings(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


MASTER_SCHEMA = strings(MASTER_COLUMNS)

SITE_SCHEMA = T.StructType([
    T.StructField(c, T.BooleanType() if c == "remote" else T.StringType()) for c in SITE_COLUMNS
])

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("type", T.StringType()),
    T.StructField("mode", T.StringType()),
    T.StructField("customer", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("current_period_end", T.LongType()),
])

PROFILE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("subscription_status", T.StringType()),
    T.StructField("stripe_customer_id", T.StringType()),
    T.StructField("subscription_end", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])


@dataclass(frozen=True)
class Source:
    """One source table: its columns and how they become master columns.

    `renames` maps a master column to the raw column it is cleaned from; master
    columns named nowhere keep their own name, `blank` ones are always `''`.
    """

    key: str
    rank: int
    columns: list[str]
    renames: dict[str, str] = field(default_factory=dict)
    blank: tuple[str, ...] = ()
    institution: str = "row"          # row | default | constant


_TALL = {"knowledge_skills": "knowledge_skills_abilities"}

SOURCES = {
    "s0": Source("s0", 0, S0_COLUMNS, institution="constant",
                 blank=("regular_temporary", "extra_sections"),
                 renames=_TALL | {
                     "job_id": "posting_number",
                     "job_title": "working_title",
                     "posted_date": "posting_date",
                     "about_us": "about_department",
                     "job_summary": "position_summary",
                     "responsibilities": "duties_responsibilities",
                     "required_qualifications": "minimum_qualifications",
                 }),
    "s1": Source("s1", 1, S1_COLUMNS, _TALL, ("close_date", "employment_type"), "default"),
    "s2": Source("s2", 2, S1_COLUMNS, _TALL, ("close_date", "employment_type"), "row"),
    "s3": Source("s3", 3, S3_COLUMNS, _TALL, ("close_date", "employment_type"), "constant"),
}
