"""Pay expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import BLOB_SOURCE
from .text import clean, col, contains_any, cut_at_word, first_non_empty, non_empty, norm_full_part

# ---------------------------------------------------------------------------
# Pay labels, pay phrases and hourly wording.
# ---------------------------------------------------------------------------

PAY_LABELS = ["proposed salary", "salary range", "salary", "pay range", "shift/salary/benefits",
              "compensation"]

PAY_PHRASES = [
    r"salary\s*range\s*:?\s*\$?\s*[\d,]+(?:\.\d+)?(?:\s*[-\u2013]\s*\$?[\d,]+(?:\.\d+)?)?"
    r"(?:\s*(?:annually|per\s+year|/yr))?",
    r"salary\s*:\s*\$?\s*[\d,]+(?:\.\d+)?(?:\s*[-\u2013]\s*\$?[\d,]+(?:\.\d+)?)?",
    r"minimum\s+(?:hourly\s+rate|salary|monthly\s+salary)\s+(?:is:?\s*)?\$?\s*[\d,]+(?:\.\d+)?"
    r"(?:/\w+)?",
    r"\$\s*[\d,]+(?:\.\d+)?\s*(?:per\s+(?:hour|month)|/hr|/hour)",
]

BLOB_PAY = (r"(?iuU)(?:Salary\s*:|Anticipated Hiring Range\s*:)\s*\$?([\d,]+(?:\.\d+)?)"
            r"(?:\s*\([^)]*\))?\s*[-\u2013]\s*\$?([\d,]+(?:\.\d+)?)")
BLOB_TYPE = r"(?iuU)Job Type\s*:\s*(Full[- ]?Time|Part[- ]?Time)"

HOURLY = r"(?U)\bper\s+hours?\b|/hr\b|/hour\b|\bhourly\b|\ban\s+hour\b"
DOLLARS = r"(?U)\$\s*[\d,]+"
BIG_NUMBER = r"(?U)\b\d{5,}\b"

# ---------------------------------------------------------------------------

_ANY_PHRASE = "(?iuU)" + "|".join(f"(?:{p})" for p in PAY_PHRASES)
_PAY_SECTION = (rf"(?is)(?:^|(?<!\|)(?:\|\|)+)\s*\[\s*(?:{'|'.join(PAY_LABELS)})(?:(?!\|\|)[^\]])*\]"
                r"\s*+(?!\|\|)(\S.*?)\s*(?:\|\||\z)")


def trim_pay(c) -> Column:
    """Shorten a long pay text to its amount."""
    s = col(c)
    tail = F.regexp_extract(s, r"(?sU)\$\s*[\d,].*", 0)
    sentence = F.regexp_extract(tail, r"(?s)^(.{1,199}?\.)(?:[ \t\n\r]|\z)", 1)
    amount = F.trim(first_non_empty(sentence, tail))
    return (
        F.when(F.length(s) <= 120, s)
        .when(tail == "", cut_at_word(s, 120))
        .when(F.length(amount) > 150, cut_at_word(amount, 120))
        .otherwise(amount)
    )


def pay_from_sections(extra, pay) -> Column:
    """The pay column, else the first packed section with a pay label and content."""
    found = F.substring(clean(F.regexp_extract(col(extra), _PAY_SECTION, 1)), 1, 200)
    return F.when(col(pay) != "", col(pay)).when(col(extra).contains("["), found).otherwise("")


def _may_hold_pay(c: Column) -> Column:
    """A cheap test every pay phrase passes, so most texts never meet the long pattern."""
    low = F.lower(c)
    return contains_any(low, ["$", "salary", "minimum", "\u017f"])


def pay_from_text(*cols) -> Column:
    """The first explicit pay phrase, columns in order."""
    found = [F.when(_may_hold_pay(col(c)), non_empty(F.regexp_extract(col(c), _ANY_PHRASE, 0))) for c in cols]
    return F.substring(F.trim(F.coalesce(*found, F.lit(""))), 1, 200)


def blob_pay(department, source) -> Column:
    lo, hi = (F.regexp_extract(col(department), BLOB_PAY, g) for g in (1, 2))
    return F.when((col(source) == BLOB_SOURCE) & (lo != ""),
                  F.concat(F.lit("$"), lo, F.lit(" - $"), hi)).otherwise("")


def blob_type(department, source) -> Column:
    return F.when(col(source) == BLOB_SOURCE,
                  norm_full_part(F.regexp_extract(col(department), BLOB_TYPE, 1))).otherwise("")


def add_pay(df: DataFrame, name: str, pay: str, extra: str, department: str, source: str,
            *texts: str) -> DataFrame:
    """Add the resolved pay: column, then packed sections, then the blob, then free text; shortened.

    Each step is a column of its own and looks only at rows the step before left blank.
    """
    steps = df.withColumn("_pay", pay_from_sections(extra, pay))
    steps = steps.withColumn("_pay", F.when(F.col("_pay") != "", F.col("_pay"))
                             .otherwise(blob_pay(department, source)))
    steps = steps.withColumn("_pay", F.when(F.col("_pay") != "", F.col("_pay")).otherwise(pay_from_text(*texts)))
    return steps.withColumn(name, trim_pay("_pay")).drop("_pay")


def pay_type(c) -> Column:
    s = F.lower(col(c))
    return (F.when(s.rlike(HOURLY), "Hourly")
            .when(s.rlike(DOLLARS) | s.rlike(BIG_NUMBER), "Annual").otherwise(""))
