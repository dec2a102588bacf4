"""Label tables and their lookup expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import any_of, col, contains_any, lookup

# ---------------------------------------------------------------------------
# Labels of the first source's detail tables.
# ---------------------------------------------------------------------------

TABLE_LABELS = {
    "posting number": "posting_number",
    "working title": "working_title",
    "department": "department",
    "about the college/unit/department": "about_department",
    "college/unit/department website": "department_website",
    "posting type": "posting_type",
    "retirement plan": "retirement_plan",
    "employment type": "employment_type",
    "benefits eligibility": "benefits_eligibility",
    "full/part time": "full_part_time",
    "work schedule": "work_schedule",
    "additional schedule information": "schedule_info",
    "advertised salary": "salary",
    "posting date": "posting_date",
    "job posting date": "posting_date",
    "open until filled": "open_until_filled",
    "closing date": "close_date",
    "proposed starting date": "proposed_start_date",
    "special instructions to applicants": "special_instructions",
    "location of vacancy": "location",
    "classification title": "classification_title",
    "flsa": "flsa",
    "fte": "fte",
    "minimum qualifications": "minimum_qualifications",
    "preferred qualifications": "preferred_qualifications",
    "position summary": "position_summary",
    "knowledge, skills, abilities and/or competencies": "knowledge_skills_abilities",
    "physical demands": "physical_demands",
    "is driving a responsibility of this position?": "driving_required",
    "is this a position of trust?": "position_of_trust",
    "does this position have operation, access, or control of financial resources?":
        "financial_responsibility",
    "does this position require a p-card?": "p_card_required",
    "is having a p-card an essential function of this position?": "p_card_required",
    "does this position have direct interaction or care of children under the age of 18 or "
    "direct patient care?": "children_interaction",
    "does this position have security access (e.g., public safety, it security, personnel "
    "records, patient records, or access to chemicals and medications)": "security_access",
    "recruitment contact name": "contact_name",
    "recruitment contact email": "contact_email",
    "recruitment contact phone": "contact_phone",
}

TABLE_RULES = [
    (r"(?:job\s+)?posting\s+date|date\s+(?:of\s+)?post(?:ed|ing)|"
     r"position\s+post(?:ed|ing)\s+date|date\s+posted", "posting_date"),
    (r"clos(?:e|ing)\s+date|application\s+(?:deadline|close(?:\s+date)?)|\bdeadline\b|"
     r"closes\s+(?:on\b|date)", "close_date"),
    (r"advertised\s+salary|salary(?:\s+range)?|pay\s+(?:rate|range|grade|scale)|"
     r"compensation(?:\s+range)?|\bwage(?:s)?\b", "salary"),
    (r"proposed\s+start(?:ing)?\s+date|expected\s+start(?:\s+date)?|"
     r"anticipated\s+start(?:\s+date)?|start\s+date", "proposed_start_date"),
    (r"open\s+until\s+fill(?:ed)?", "open_until_filled"),
    (r"^posting\s+type$|^position\s+type$|^job\s+type$", "posting_type"),
    (r"posting\s+(?:number|#|no\.?|id)\b", "posting_number"),
    (r"(?:working|job|position)\s+title|title\s+of\s+(?:the\s+)?position", "working_title"),
    (r"^dep(?:t|artment)(?:\s+name)?$", "department"),
    (r"about\s+the\s+(?:college|unit|department|dept)|college[/\s]+unit[/\s]+department",
     "about_department"),
    (r"(?:college|unit|dept|department)\s+(?:web\s*site|url|link)", "department_website"),
    (r"employment\s+type|type\s+of\s+(?:employment|position)", "employment_type"),
    (r"retirement\s+plan", "retirement_plan"),
    (r"benefits?\s+eligib", "benefits_eligibility"),
    (r"full[\s\-]*time[\s/\-]+part[\s\-]*time|full[/\s\-]+part[/\s\-]+time|"
     r"employment\s+(?:status|basis)\b", "full_part_time"),
    (r"work\s+schedule|hours?\s+(?:per\s+week|schedule)|schedule\s+type", "work_schedule"),
    (r"additional\s+schedule|schedule\s+information", "schedule_info"),
    (r"location\s+of\s+vacanc|vacanc[y]\s+location|work(?:ing)?\s+location|job\s+location|"
     r"^location$", "location"),
    (r"classification\s+title|job\s+class(?:ification)?", "classification_title"),
    (r"^flsa(?:\s+status)?$", "flsa"),
    (r"^fte(?:\s*[:\-].*)?$", "fte"),
    (r"minimum\s+(?:qualifications?|requirements?)|required\s+qualifications?|"
     r"minimum\s+education", "minimum_qualifications"),
    (r"preferred\s+(?:qualifications?|requirements?|experience)", "preferred_qualifications"),
    (r"position\s+summary|job\s+summary|position\s+description|job\s+description|role\s+summary",
     "position_summary"),
    (r"knowledge[,\s]+skills?[,\s&/]+abilit|ksa\b", "knowledge_skills_abilities"),
    (r"physical\s+(?:demands?|requirements?|effort)", "physical_demands"),
    (r"special\s+instructions?(?:\s+to\s+applicants?)?", "special_instructions"),
    (r"driv(?:ing|e)\s+(?:a\s+)?responsibilit", "driving_required"),
    (r"position\s+of\s+trust", "position_of_trust"),
    (r"financial\s+resource|operation.*access.*financial|financial\s+responsibilit",
     "financial_responsibility"),
    (r"p[\s\-]?card", "p_card_required"),
    (r"direct\s+(?:interaction|care).*child|child.*direct\s+(?:interaction|care)|"
     r"direct\s+patient\s+care", "children_interaction"),
    (r"security\s+access|public\s+safety.*it\s+security|personnel\s+records|"
     r"access\s+to\s+chemicals", "security_access"),
    (r"(?:recruitment\s+)?contact\s+(?:person\s+)?(?:name|person)(?!\s+(?:email|phone))",
     "contact_name"),
    (r"(?:recruitment\s+)?contact\s+e?[-\s]?mail", "contact_email"),
    (r"(?:recruitment\s+)?contact\s+(?:phone|telephone|tel\.?\b)", "contact_phone"),
]

# ---------------------------------------------------------------------------
# Section names of the second and third sources.
# ---------------------------------------------------------------------------

SECTION_LABELS = {
    "about us": "about_us",
    "job summary": "job_summary",
    "responsibilities": "responsibilities",
    "required qualifications": "required_qualifications",
    "preferred qualifications": "preferred_qualifications",
    "knowledge, skills, & abilities": "knowledge_skills_abilities",
    "knowledge, skills, abilities": "knowledge_skills_abilities",
    "knowledge, skills and abilities": "knowledge_skills_abilities",
    "other information": "other_information",
    "background check": "background_check",
    "proposed salary": "salary",
    "salary range": "salary",
    "salary": "salary",
    "pay range": "salary",
    "shift/salary/benefits": "salary",
    "compensation": "salary",
}

SECTION_RULES = [
    (r"(?:job|role|position)\s+(?:summary|description|overview)|^overview$|^description$|"
     r"^summary$", "job_summary"),
    (r"(?:essential\s+)?(?:duties|responsibilities|functions)|key\s+responsibilities|"
     r"primary\s+duties", "responsibilities"),
    (r"(?:minimum|required)\s+(?:qualifications?|requirements?)|^qualifications?$|"
     r"^requirements?$", "required_qualifications"),
    (r"preferred\s+(?:qualifications?|requirements?|experience)", "preferred_qualifications"),
    (r"knowledge[,\s]+skills?[,\s&/]+abilit|ksa\b", "knowledge_skills_abilities"),
    (r"about\s+(?:us|the\s+(?:university|institution|department|college|unit|school))",
     "about_us"),
    (r"salary(?:\s+range)?|advertised\s+salary|proposed\s+salary|"
     r"pay\s+(?:rate|range|grade|scale)|compensation(?:\s+range)?|wage(?:s)?\b|shift/salary",
     "salary"),
    (r"background\s+(?:check|investigation|screening)", "background_check"),
    (r"other\s+information|additional\s+information|^benefits?$|supplemental\s+information",
     "other_information"),
]

SKIPPED_SECTIONS = ["location", "usg core values", "equal employment opportunity"]

# ---------------------------------------------------------------------------
# Headings and table labels of the fourth source.
# ---------------------------------------------------------------------------

HEADING_LABELS = {
    "job summary": "job_summary",
    "overview": "job_summary",
    "position summary": "job_summary",
    "summary": "job_summary",
    "description": "job_summary",
    "position description": "job_summary",
    "about us": "about_us",
    "about georgia state": "about_us",
    "about gsu": "about_us",
    "responsibilities": "responsibilities",
    "duties": "responsibilities",
    "essential duties": "responsibilities",
    "essential functions": "responsibilities",
    "key responsibilities": "responsibilities",
    "qualifications": "required_qualifications",
    "required qualifications": "required_qualifications",
    "minimum qualifications": "required_qualifications",
    "minimum requirements": "required_qualifications",
    "requirements": "required_qualifications",
    "preferred qualifications": "preferred_qualifications",
    "preferred requirements": "preferred_qualifications",
    "knowledge, skills, & abilities": "knowledge_skills_abilities",
    "knowledge, skills, abilities": "knowledge_skills_abilities",
    "knowledge, skills and abilities": "knowledge_skills_abilities",
    "skills": "knowledge_skills_abilities",
    "other information": "other_information",
    "additional information": "other_information",
    "benefits": "other_information",
    "background check": "background_check",
    "background investigation": "background_check",
    "salary": "salary",
    "salary range": "salary",
    "proposed salary": "salary",
    "pay range": "salary",
    "compensation": "salary",
}

# Ordered keyword groups: the first group with a keyword inside the label names the column.
TABLE_GROUPS = [
    (["department", "organization", "college", "unit", "school"], "department"),
    (["location", "city", "address", "campus"], "location"),
    (["position type"], "full_part_time"),
    (["regular", "temporary", "employee status", "job status"], "regular_temporary"),
    (["posted", "open date", "opening date"], "posted_date"),
    (["closing", "close date", "deadline"], "close_note"),
]

LIST_GROUPS = [
    (["department", "unit", "college", "school", "division"], "department"),
    (["location", "campus", "city"], "location"),
    (["position type", "appointment type", "rank", "type"], "full_part_time"),
    (["open date", "posted", "opening"], "posted_date"),
    (["close date", "closing", "deadline"], "close_note"),
]

# Labels that describe the posting rather than hold a section of its text.
META_KEYWORDS = ["department", "organization", "college", "unit", "school", "location", "city",
                 "address", "campus", "position type", "regular", "temporary", "employee status",
                 "posted", "open date", "closing", "deadline"]

DUTY_LABEL = "duties/responsibilities"
DUTY_SHARE_LABEL = "percentage of time"

# ---------------------------------------------------------------------------


def resolve_exact(label, labels: dict[str, str]) -> Column:
    """The column an exact label names, or null."""
    return lookup(labels, label)


def resolve_rules(label, labels: dict[str, str], rules: list[tuple[str, str]]) -> Column:
    """Exact first, then the first matching rule, else null."""
    fuzzy = [F.when(col(label).rlike(f"(?iu){pattern}"), name) for pattern, name in rules]
    return F.coalesce(resolve_exact(label, labels), *fuzzy)


def classify_keywords(label, groups) -> Column:
    """The column of the first group with a keyword in the label, or null."""
    c = col(label)
    tests = []
    for keywords, name in groups:
        hit = contains_any(c, keywords)
        if keywords == ["position type"]:
            hit = hit | (c.contains("type") & c.contains("position"))
        tests.append(F.when(hit, name))
    return F.coalesce(*tests)


def is_meta_label(label) -> Column:
    return any_of(col(label).contains(k) for k in META_KEYWORDS)
