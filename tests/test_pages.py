"""Hand-written pages of every layout."""

from jobloom.functions import html as H
from jobloom.operators import pages, quality
from jobloom.schemas import S0_COLUMNS, S1_COLUMNS

BASE = "https://h.example.org"


def frame(spark, *htmls):
    return spark.createDataFrame([(i, f"{BASE}/p/{i}", h) for i, h in enumerate(htmls)],
                                 "page_id bigint, url string, html string")


def test_blocks_once_and_in_order(spark):
    html = ("<title>no</title><!-- <p>no</p> --><h2>A <b>B</b></h2><div>x<p>y</p>z</div><script>'<p>'</script>"
            "<P CLASS='q'>t &amp; u<br>v</P><ul><li>1<li>2</ul><pre>code</pre>")
    rows = pages.page_blocks(frame(spark, html)).orderBy("ord").collect()
    assert [(r.tag, r.text) for r in rows] == [
        ("h2", "A B"), ("div", "x"), ("p", "y"), ("", "z"), ("p", "t & u v"), ("li", "1"), ("li", "2")]


def test_text_outside_listed_tags(spark):
    html = ("<nav>Menu Jobs Home</nav><h1>Title</h1><p>Real <b>bold</b> text</p>loose<footer>Foot</footer>"
            "<ul><li>one<ul><li>two</ul>tail</ul>after<p>open<p>next<div>in</div>out")
    rows = pages.page_blocks(frame(spark, html)).orderBy("ord").collect()
    assert [r.text for r in rows] == ["Title", "Real", "bold", "text", "one", "two", "tail", "open", "next", "in"]
    out = pages.page_sections(frame(spark, "<nav>Menu Jobs Home</nav><h1>Title</h1><p>Real text</p><footer>Foot</footer>")).first()
    assert out.job_summary == "" and out.extra_sections == "[Title] Real text"


def test_sections(spark):
    html = ("<p>Intro</p><h3>Responsibilities:</h3><p>do</p><div><b>Qualifications:</b> need</div><h3></h3><p>loose</p>"
            "<b>just bold</b><h1>Duties</h1><li>more</li><h2>Town</h2><p>nice</p><h2>Empty</h2>")
    out = pages.page_sections(frame(spark, html, "plain <i>text</i>", "")).orderBy("page_id").collect()
    assert out[0].job_summary == "Intro loose just bold" and out[0].responsibilities == "do more"
    assert out[0].required_qualifications == "need" and out[0].extra_sections == "[Town] nice"
    assert out[1].job_summary == "plain text" and out[2].job_summary == ""


TABLE = """<table><tr><th>Working Title:</th><td>Sous Chef</td></tr><tr><th>Job Title</th><td>Other</td></tr>
<tr><th>Percentage Of Time</th><td>5</td></tr><tr><th>Duties/Responsibilities</th><td>A</td></tr>
<tr><th>Percentage Of Time</th><td>40</td></tr><tr><th>Duties/Responsibilities</th><td>B</td></tr>
<tr><td>no</td><td>label</td></tr><tr><th>Salary Range</th><td> </td></tr><tr><th>Pay Rate</th><td>$9</td></tr></table>
<a href='/postings/3/pre_apply'>Go</a>"""


def test_table_posting(spark):
    df = frame(spark, TABLE)
    cards = spark.createDataFrame([(0, f"{BASE}/p/0", "", "2026-01-01"), (9, f"{BASE}/p/9", "Card", "")],
                                  "page_id bigint, url string, working_title string, posting_date string")
    rows = {r.page_id: r for r in pages.page_to_posting(df, cards, "tables", base=BASE).collect()}
    got = rows[0]
    assert got.working_title == "Sous Chef" and got.salary == "$9" and got.posting_date == "2026-01-01"
    assert got.duties_responsibilities == "A  [40% of time] | B"
    assert got.apply_link == f"{BASE}/postings/3/pre_apply" and got.posting_url == f"{BASE}/p/0"
    stub = rows[9]
    assert stub.stub and stub.working_title == "Card" and stub.posting_url == f"{BASE}/p/9"
    assert stub.apply_link == "" and stub.salary == ""
    source = pages.to_source(pages.page_to_posting(df, cards, "tables", base=BASE), "s0")
    assert source.columns == ["page_id", "stub", *S0_COLUMNS]
    assert source.first().scraped_at.endswith("+00:00") and len(source.first().scraped_at) == 32


def span(name, text):
    return f'<span class="x" id="{name}">{text}</span>'


def test_span_posting_stops_at_gap(spark):
    lbl, txt = "HRS_SCH_WRK_DESCR100${}lbl", "HRS_SCH_PSTDSC_DESCRLONG${}"
    parts = [("Job Summary", "a <span>b</span> c"), ("Location", "skip"), ("Job Summary", "second"), ("Odd One", "o"),
             ("Blank", "")]
    html = "<div>" + span("HRS_SCH_WRK2_POSTING_TITLE", "Title <span>two</span> three") + "after" + "".join(
        span(lbl.format(i), a) + span(txt.format(i), b) for i, (a, b) in enumerate(parts))
    html += span(lbl.format(7), "About Us") + span(txt.format(7), "behind the gap")
    df = frame(spark, html)
    row = pages.postings_from_spans(df, S1_COLUMNS).first()
    assert row.job_title == "Title two three" and row.job_summary == "second" and row.about_us == ""
    assert row.extra_sections == "[Odd One] o" and row.job_id == ""
    long = pages.page_indexed_fields(df).orderBy("ord").collect()
    assert [(r.label, r.value) for r in long][0] == ("Job Summary", "a b c") and len(long) == 5
    many = "".join(span(lbl.format(i), f"L{i}") + span(txt.format(i), "x") for i in range(40))
    assert pages.page_indexed_fields(frame(spark, many)).count() == 40
    assert pages.page_indexed_fields(frame(spark, many), most=30).count() == 30


def test_span_listing(spark):
    html = "".join(span(f"SCH_JOB_TITLE${i}", f"T{i}") + span(f"HRS_APP_JBSCH_I_HRS_JOB_OPENING_ID${i}", str(i))
                   for i in (0, 1, 3))
    rows = pages.listing_from_spans(frame(spark, html, "none")).orderBy("ord").collect()
    assert [(r.page_id, r.ord, r.job_id, r.job_title, r.location) for r in rows] == [(0, 0, "0", "T0", ""), (0, 1, "1", "T1", "")]


def test_cell_posting(spark):
    table = """<table><tr><td>Organization</td><td>Arts</td></tr><tr><td>Department</td><td>later</td></tr>
    <tr><td>Closing date</td><td>May</td></tr><tr><td>Deadline</td><td>June</td></tr>
    <tr><td>Description:</td><td><h3>Overview</h3><p>Sum</p><h3>Other</h3><p>left out</p></td></tr>
    <tr><td>Salary</td><td>$5</td></tr><tr><td>work hours</td><td>9<br>5</td></tr></table>"""
    body = ("<div id='maincontent'><div id='job_menubar'><ul><li>Menu</li></ul></div>"
            "Beginning of the main content section. <h1>Job Description - Cook - 12</h1><p>Job Description Cook - 12 "
            "Description : " + "real words " * 12 + "</p></div><p>footer</p>")
    cards = spark.createDataFrame([(0, f"{BASE}/0", "Cook", "Card dept"), (1, f"{BASE}/1", "Cook", "Card dept"),
                                   (2, f"{BASE}/2", "Cook", "Card dept")],
                                  "page_id bigint, url string, title string, department string")
    out = {r.page_id: r for r in pages.page_to_posting(frame(spark, table, body), cards, "cells").collect()}
    assert out[0].department == "Arts" and out[0].job_summary == "Sum" and out[0].salary == "$5"
    assert out[0].other_information == "Close date: May  Close date: June"
    assert out[0].extra_sections == "[Work Hours] 9 5"
    assert out[1].department == "Card dept" and out[1].job_summary == ("real words " * 12).strip()
    assert out[1].extra_sections == "" and out[2].stub and out[2].job_title == "Cook"


def test_list_posting(spark):
    html = """<h1>Header</h1><h1 class="posting-header">Dean <i>of</i> Law</h1><dl><dt>Division:</dt><dd>Law</dd>
    <dt>Rank</dt><dt>Opening</dt><dd>1/2/2026</dd><dt>Close Date</dt><dd>soon</dd></dl>
    <div class="posting-requirements"><b>Requirements:</b><div>phd</div></div>
    <div class="x posting-description"><div>Lead <div>deep</div></div> end</div><p>outside</p>
    <div id="apply-button-top"><a class="b" href="go?x=1&amp;y=2">Now</a></div>"""
    cards = spark.createDataFrame([(0, f"{BASE}/0", "Card", "", "Here")],
                                  "page_id bigint, url string, title string, department string, location string")
    row = pages.page_to_posting(frame(spark, html), cards, "lists", base=BASE).first()
    assert row.job_title == "Dean of Law" and row.department == "Law" and row.location == "Here"
    assert row.full_part_time == "1/2/2026" and row.posted_date == "1/2/2026"
    assert row.job_summary == "Lead deep end" and row.required_qualifications == "phd"
    assert row.other_information == "Close date: soon" and row.apply_link == f"{BASE}/go?x=1&y=2"


def test_block_and_row_and_grid_listings(spark):
    block = """<div class="row"><a href="/postings/5">not a card</a></div>
    <div class="row posting"><h3><a href="/postings/12">Dean</a></h3><div class="posting-category-department">Law</div>
    </div><article class="posting"><a href="https://o.org/postings/13">Tutor</a><p class="campus">Macon</p></article>"""
    rows = pages.listing_from_cards(frame(spark, block), BASE).orderBy("ord").collect()
    assert [(r.job_id, r.url, r.title, r.department, r.location) for r in rows] == [
        ("12", f"{BASE}/postings/12", "Dean", "Law", "Atlanta, Georgia"),
        ("13", "https://o.org/postings/13", "Tutor", "", "Macon")]
    row = """<tr class="ftlrow"><td><div id="1"><a id="reqTitleLink">t</a></div></td></tr>
    <tr class="ftlrow ftlcopy"><td><div id="77"></div><a id="x.reqTitleLink.r">Cook</a><span>Department Name</span>
    <span>:</span><span>Food</span><span id="reqPostingDate.1">03/06/26</span></td></tr>
    <tr class="ftlcopy ftlrow"><td><div id="78"></div></td></tr>"""
    got = pages.listing_from_table(frame(spark, row), "https://t/{job_id}&x").collect()
    assert [(r.job_id, r.url, r.title, r.department, r.posted_date) for r in got] == [
        ("77", "https://t/77&x", "Cook", "Food", "03/06/26")]
    grid = """<div class="row"><div class="col-md-2">Title</div></div><div class="row job"><div class="col-md-2">
    <a href="/postings/9">Nurse</a></div><div class="col-md-2">N1</div><div class="col-md-2">Care</div></div>"""
    got = pages.listing_from_columns(frame(spark, grid), BASE).collect()
    assert [(r.posting_id, r.working_title, r.posting_number, r.department, r.close_date) for r in got] == [
        ("9", "Nurse", "N1", "Care", "")]


def test_links_and_gates(spark):
    html = "<a name=x>a</a><a href='/postings/1'>One</a><a HREF=\"/postings/2?a=1&amp;b\">2</a><a href=/postings/3>›</a><a href='/q'>next</a>"
    df = frame(spark, html, html)
    links = pages.page_links(df, "/postings/").where("page_id = 0").orderBy("ord").collect()
    assert [(r.href, r.text) for r in links] == [("/postings/1", "One"), ("/postings/2?a=1&b", "2"), ("/postings/3", "›")]
    cards = pages.listing_from_links(df, BASE).collect()
    assert [(c.job_id, c.title, c.page_id) for c in cards] == [("1", "One", 0)]
    none = frame(spark, "<a href='/x'>y</a>")
    assert none.select(pages.apply_link("html", "url", BASE)).first()[0] == f"{BASE}/p/0"
    shells = frame(spark, "<p> Toggle  navigation</p>", "<p>x Toggle navigation y</p>", "<p>" + "z" * 101 + "toggle navigation</p>")
    got = shells.select(quality.page_is_shell("html")).collect()
    assert [r[0] for r in got] == [False, True, False]
    sized = frame(spark, "a" * 10001, "a" * 10001 + "HRS_SCH_PSTDSC_DESCRLONG", "HRS_SCH_PSTDSC_DESCRLONG")
    kept = quality.page_is_complete(sized, quality.SPAN_PAGE_CHARS, quality.SPAN_PAGE_MARKERS)
    assert [r.page_id for r in kept.collect()] == [1]
    assert quality.page_is_complete(sized).count() == 2


def test_named_references(spark, column):
    import html
    from html.entities import html5

    from jobloom.functions.html import decode_entities
    from pyspark.sql import functions as F

    texts = [f"a &{name} z" for name in html5] + [f"&{name[:-1]}z1;" for name in html5 if name.endswith(";")]
    texts += ["M&uuml;ller &agrave;", "&ampamp; &amp;lt; &notit; &notin; &unknown; & &; &#65;&#x42;", "R&D &copy2024"]
    got = column("s string", texts, decode_entities(F.col("s")))
    assert got == [html.unescape(t) for t in texts]


def test_nested_tables(spark):
    page = ("<table><tr><td>A</td><td><table><tr><td>B</td><td>b</td></tr></table>x</td></tr>"
            "<tr><td>C</td><td>c</td></tr></table><table><tr><th>D</th><td>d</td></tr></table>")
    rows = pages.page_label_values(frame(spark, page), "cells").orderBy("ord").collect()
    assert [(r.label, r.value) for r in rows] == [("a", "Bbx"), ("b", "b"), ("c", "c"), ("d", "d")]
    heads = "<table><tr><th>A</th><td><table><tr><th>B</th><td>b</td></tr></table>x</td></tr></table>"
    rows = pages.page_label_values(frame(spark, heads), "table").orderBy("ord").collect()
    assert [(r.label, r.value) for r in rows] == [("a", "Bbx"), ("b", "b")]


def test_containers_of_any_tag(spark):
    html = ["<section class='posting-description'><p>Body</p></section><p>Footer</p>",
            "<section class='x posting-description'>one<section>two</section>three</section><article id=\"posting-requirements\"><b>Requirements:</b>four</article>",
            "<img class='posting-description'><p>Loose</p>"]
    rows = pages.postings_from_lists(frame(spark, *html), BASE).orderBy("page_id").collect()
    assert [r.job_summary for r in rows] == ["Body", "one two three", "Loose"] and rows[1].required_qualifications == "four"
    body = "real words that go on for more than eighty characters, so that it counts as content of its own. "
    cells = [f"<p>no</p><td id='x_JobDesc_1'><p>{body}</p></td><p>no</p>", f"<article class='a jobDescription'>{body}<i>i</i></article>no",
             f"<p>no</p><main id='requisitionDescBody'>{body}</main>", f"<span class='jobTitle'>Job Description - 7</span><h2 class='big jobTitle'>No</h2><div id='maincontent'>{body}</div>",
             "<b class='jobTitle'>Cook <i>II</i></b>"]
    rows = pages.postings_from_cells(frame(spark, *cells)).orderBy("page_id").collect()
    assert [r.job_summary for r in rows[:4]] == [body.strip(), body + "i", body.strip(), body.strip()]
    assert [r.job_title for r in rows] == ["", "", "", "", "Cook II"]


def test_numbered_spans_by_number_and_first_of_an_id(spark):
    span = lambda i, text: f'<span id="{i}">{text}</span>'
    html = "".join([span("L$1lbl", "one"), span("L$0lbl", "zero"), span("L$0lbl", "again"), span("C$1", "<span>in</span> first"),
                    span("C$1", "second"), span("L$3lbl", "beyond"), span("L$01lbl", "no number"), span("C$0", "")])
    spans = H.id_spans("html", r"^[LC]\$")
    df = frame(spark, html)
    kinds = [("L$", "lbl"), ("C$", "")]
    assert df.select(H.numbered(spans, kinds)).head()[0] == [["zero", ""], ["one", "in first"]]
    assert df.select(H.numbered(spans, kinds, 1)).head()[0] == [["zero", ""]]
    assert df.select(H.numbered(spans, [("X$", "")])).head()[0] == []


def test_pages_of_one_file_are_dealt_before_they_are_parsed(spark):
    page = '<h1 class="posting-header">T{0}</h1><dl><dt>Rank:</dt><dd>Staff</dd></dl><div class="posting-description"><p>Text {0}</p></div>'
    landed = spark.createDataFrame([(i, "u", page.format(i)) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    cards = spark.createDataFrame([(i, "u", "Card") for i in range(50)], "page_id long, url string, title string")
    out = pages.page_to_posting(landed, cards, "lists", base="https://x.org")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    dealt = plan.index("RepartitionByExpression")
    assert 0 < plan.index("posting-description") < dealt  # the parse lies above the exchange
    assert {(r.page_id, r.job_title, r.job_summary) for r in out.collect()} == {
        (i, f"T{i}" if i < 40 else "Card", f"Text {i}" if i < 40 else "") for i in range(50)}
