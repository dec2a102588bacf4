"""Input -> expected tables for the column expressions."""

import sys

import pytest
from pyspark.sql import functions as F

from jobloom.functions import dates as D, events as E, html as H, labels as L, pay as P, text as X
from jobloom.functions.vectors import l2_normalise

LONG_PAY = ("Pay for this position is set by experience, education and market data reviewed each year. "
            "The range is $47,040 to $57,300. Benefits are listed separately.")


def check(column, expression, table, schema="x string"):
    assert column(schema, [k for k, _ in table], expression) == [v for _, v in table]


def test_clean_knows_every_unicode_space(column):
    spaces = [chr(i) for i in range(sys.maxunicode) if not 0xD800 <= i < 0xE000 and chr(i).isspace()]
    got = column("x string", [f" a{s}{s} b{s}" for s in spaces], X.clean("x"))
    assert got == ["a b"] * len(spaces)
    others = [c for c in map(chr, range(0x10000)) if not c.isspace() and not 0xD800 <= ord(c) < 0xE000]
    assert column("x string", [f"a{c}b" for c in others], X.clean("x")) == [f"a{c}b" for c in others]
    check(column, X.clean("x"), [(None, ""), ("", ""), ("  ", ""), ("a b", "a b"), ("​x", "​x")])


def test_strip_keeps_inner_space(column):
    check(column, X.strip("x"), [(" a  b ", "a  b"), (None, ""), ("\n", "")])


def test_truncate(column):
    check(column, X.truncate("x", 8), [("short", "short"), ("one two three", "one two…"), ("one twothree", "one…"), ("abcdefghijk", "abcdefgh…"),
                                       ("12345678", "12345678"), ("1234567 9", "1234567…")])


@pytest.mark.parametrize("raw, want", [
    ("03/06/26", "2026-03-06"), ("3/6/2026", "2026-03-06"), ("2026-3-6", "2026-03-06"),
    ("March 6, 2026", "2026-03-06"), ("MARCH 6, 2026", "2026-03-06"), ("Mar  6, 2026", "2026-03-06"),
    ("03-06-2026", "2026-03-06"), ("2026/03/06", "2026-03-06"), ("03/06/75", "1975-03-06"),
    ("03/06/68", "2068-03-06"), ("03/06/69", "1969-03-06"), ("02/30/2026", ""), ("02/29/2024", "2024-02-29"),
    ("Sept 6, 2026", ""), ("3/6/202", ""), ("2026-03-06T10:00:00", "2026-03-06"), ("2026-13-45 junk", "2026-13-45"),
    (" 03/06/26 ", "2026-03-06"), ("", ""), (None, ""), ("13/01/2026", ""), ("May 1, 2026", "2026-05-01"),
])
def test_parse_date(column, raw, want):
    assert column("x string", [raw], D.parse_date("x")) == [want]


def test_typed_date_is_null_when_unchecked(column):
    got = column("x string", ["2026-13-45 junk", "2026-03-06"], D.typed_date("x"))
    assert got[0] is None and str(got[1]) == "2026-03-06"


def test_job_types(column):
    check(column, X.norm_full_part("x"), [("Full/Part", "Full-Time"), ("part-time", "Part-Time"), ("Employee", ""),
                                          ("", "")])
    check(column, X.norm_regular_temp("x"), [("Permanent", "Regular"), ("Contract", "Temporary"), ("", ""),
                                             ("Temporary", "Temporary")])


def test_pay_text(column):
    check(column, P.pay_from_text("x"), [
        ("Salary Range: $71,813 - $97,665 annually ok", "Salary Range: $71,813 - $97,665 annually"),
        ("the salary: $53,000 – $60,000.", "salary: $53,000 – $60,000"),
        ("Minimum hourly rate is: $15.50/hour", "Minimum hourly rate is: $15.50/hour"),
        ("pays $15.67 /hr", "$15.67 /hr"), ("grant of $5,000,000", ""), ("", ""), ("no pay here", "")])


def test_pay_sections(column):
    extra = "[Notes] n/a || [Salary Range] $1 to $2"
    rows = [((extra, ""), "$1 to $2"), ((extra, "$9"), "$9"), (("[Salary] || [Pay Range (x)] 5 | 6", ""), "5 | 6"),
            (("[Salaries] a", ""), ""), (("[ Compensation ] c || [B] d", ""), "c"), (("", ""), ""),
            (("[Notes] [salary] x", ""), ""), (("[Proposed Salary - FY] " + "9" * 300, ""), "9" * 200)]
    check(column, P.pay_from_sections("e", "p"), rows, "e string, p string")


def test_trim_pay(column):
    check(column, P.trim_pay("x"), [
        ("$1 to $2.", "$1 to $2."), (LONG_PAY, "$47,040 to $57,300."),
        ("word " * 30, "word " * 23 + "word…"), ("x" * 130, "x" * 120 + "…"),
        ("a" * 100 + " $5 " + "b " * 100, "$5 " + "b " * 57 + "b…"),
        ("a" * 118 + " $50.25 per hour", "$50.25 per hour")])


def test_pay_type(column):
    check(column, P.pay_type("x"), [("$18 per hour", "Hourly"), ("$52,000", "Annual"), ("business hours", ""),
                                    ("52000", "Annual"), ("an hour", "Hourly"), ("", "")])


def test_blob(column):
    rows = [(("Job Type: Part Time Salary : $79,400 (minimum) - $103,200", "Georgia State University"),
             ("$79,400 - $103,200", "Part-Time")),
            (("Anticipated Hiring Range: $1- $2", "Georgia State University"), ("$1 - $2", "")),
            (("Job Type: Full Time", "other"), ("", ""))]
    got = column("d string, s string", [r for r, _ in rows], F.struct(P.blob_pay("d", "s"), P.blob_type("d", "s")))
    assert [tuple(g) for g in got] == [w for _, w in rows]


def test_garbled(column):
    check(column, X.is_garbled("x"), [
        ("Return to the home page x", True), ("- Description: y", True), ("Math", False), ("", False),
        ("Tutor - 123456 Description: z", True), ("Tutor - 1234 Description: z", False),
        ("x" * 80 + " 123456 description", False)])


def test_links(column):
    check(column, X.fix_link("a", "v"), [(("?apply=true", "http://a"), "http://a"), (("", ""), ""), (("/x", ""), "/x"),
                                         (("https://b", "http://a"), "https://b")], "a string, v string")
    check(column, X.absolute_url("https://h.org/a/b", F.col("x")), [
        ("https://q", "https://q"), ("/r", "https://h.org/r"), ("c", "https://h.org/a/c"), ("?p=1", "https://h.org/a/b?p=1"),
        ("//z/y", "https://z/y"), ("../d", "https://h.org/d"), ("./d/../e?x=../y", "https://h.org/a/e?x=../y"),
        ("/../..", "https://h.org/"), ("/p/./q", "https://h.org/p/q"), ("mailto:x", "mailto:x"), ("", "https://h.org/a/b")])
    check(column, X.absolute_url("https://h.org", F.col("x")), [("c", "https://h.org/c"), ("/c", "https://h.org/c")])
    check(column, X.url_id("x"), [("/postings/12?x", "12"), ("/posting/12", ""), ("https://h/postings/7", "7")])


def test_labels(column):
    check(column, X.norm_label("x"), [(" Working  Title: ", "working title"), ("A::", "a"), ("B :", "b ")])
    check(column, X.norm_label("x", spaces=True), [("B : ", "b")])
    check(column, X.facet_name("x"), [("Name Here (12)", "Name Here"), ("Name", "Name")])
    check(column, X.facet_count("x"), [("Name Here (12)", 12), ("Name", 0)])
    check(column, H.title_case(F.col("x")), [("work hours/week's", "Work Hours/Week'S"), ("fte", "Fte")])


def test_label_rules(column):
    rules = L.resolve_rules("x", L.TABLE_LABELS, L.TABLE_RULES)
    check(column, rules, [
        ("working title", "working_title"), ("date posted", "posting_date"), ("dept name", "department"),
        ("dept names", None), ("position posting date", "posting_date"), ("contact name", "contact_name"), ("contact person", "contact_name"),
        ("contact telephone", "contact_phone"), ("hours per week", "work_schedule"),
        ("advertised pay scale", "salary"), ("fte: 1", "fte"), ("lunch", None), ("p card", "p_card_required"),
        # the salary rule stands before the start date rule
        ("salary start date", "salary")])
    sections = L.resolve_rules("x", L.SECTION_LABELS, L.SECTION_RULES)
    check(column, sections, [("qualifications", "required_qualifications"), ("job overview", "job_summary"),
                             ("about the school", "about_us"), ("benefits", "other_information"), ("xyz", None)])
    assert len(L.TABLE_RULES) == 36 and len(L.SECTION_RULES) == 9


def test_keyword_groups(column):
    check(column, L.classify_keywords(F.col("x"), L.TABLE_GROUPS), [
        ("college location", "department"), ("city", "location"), ("type of position", "full_part_time"),
        ("job status", "regular_temporary"), ("open date", "posted_date"), ("deadline", "close_note"), ("x", None)])


def test_summary_repair(column):
    body = "b" * 60
    check(column, X.strip_header("s", "t"), [
        ((f"Cook  {body}", "cook"), body), (("Cook short", "cook"), "Cook short"),
        ((f"Dept Georgia State University {body}", ""), body),
        (("x" * 401 + f" Georgia State University {body}", ""), "x" * 401 + f" Georgia State University {body}")],
        "s string, t string")
    check(column, X.strip_nav_marker("x"), [
        ("Beginning of the main content section. Text", "Text"), ("A Beginning", "A Beginning")])
    extra = f"[A] x || [Job Description - T - 12] Job Description T - 12 Description : {body} || [B] y"
    for summary, want in [("", body), ("Welcome. You are not signed in", body), ("real text", "real text")]:
        e, s = X.promote_section("e", "s")
        got = column("e string, s string", [(extra, summary)], F.struct(e, s))[0]
        assert tuple(got) == (("[A] x ||  || [B] y" if want == body else extra), want)
    e, s = X.promote_section("e", "s")
    assert tuple(column("e string, s string", [("", "You have been signed out")], F.struct(e, s))[0]) == ("", "")


def test_notes_and_parts(column):
    check(column, X.append_note("a", X.close_note("b")), [
        (("x", "May"), "x  Close date: May"), (("", "May"), "Close date: May"), (("x", ""), "x")], "a string, b string")
    check(column, X.job_text("t", "d", "s"), [((" A ", "", "z"), "A A A z"), ((None, "d", ""), "d")],
          "t string, d string, s string")
    check(column, X.short_summary_fill("a", "b"), [(("s", "r"), "s r"), (("", "r"), "r"), (("x" * 100, "r"), "x" * 100)],
          "a string, b string")


def test_vectors_and_epochs(column):
    got = column("v array<float>", [([3.0, 4.0],), ([0.0, 0.0],)], l2_normalise("v"))
    assert [round(x, 6) for x in got[0]] == [0.6, 0.8] and got[1] == [0.0, 0.0]
    stamps = column("x bigint", [0, None, 1700000000], F.date_format(D.epoch_to_ts("x"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    assert stamps == [None, None, "2023-11-14T22:13:20Z"]


def test_event_status(column):
    rows = [(("checkout.session.completed", "subscription", "", "c"), "active"),
            (("checkout.session.completed", "payment", "", "c"), None),
            (("checkout.session.completed", "subscription", "", ""), None),
            (("customer.subscription.updated", "", "active", "c"), "active"),
            (("customer.subscription.updated", "", "paused", "c"), "cancelled"),
            (("customer.subscription.deleted", "", "", "c"), "cancelled"),
            (("invoice.payment_failed", "", "", "c"), "past_due"),
            (("invoice.payment_failed", "", "", None), None), (("other", "", "", "c"), None)]
    check(column, E.event_status("t", "m", "s", "c"), rows, "t string, m string, s string, c string")


def test_entities(column):
    check(column, H.decode_entities(F.col("x")), [
        ("a &amp; b", "a & b"), ("&amp;lt;", "&lt;"), ("&#39;&#x2019;&#128512;", "'’😀"), ("&#xD800;", "�"),
        ("&#12 x", "&#12 x"), ("no", "no"), ("&nbsp;", " "), ("AT&T", "AT&T")])
