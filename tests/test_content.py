"""Composed content on small hand-written pages."""

from conftest import pages_df

from pagefold.operators import content as C
from pagefold.operators import documents as DOC

BIKES = """<html lang=en><head><title>Rental &amp; repair</title></head><body>
<header><nav><a href='/bikes'>All bikes</a> <a href="mailto:desk@velo.example">Write us</a></nav></header>
<h1>City bikes</h1> Open all year.
<ul><li class=offer><h3>Three-speed</h3> now $ 12 . 50 per day, helmet and lock included
  <a href="three#sizes">Sizes</a> <a href="JavaScript:void 0">popup</a> <a href=' # '>top</a> <a name=x>anchor</a></li>
<li class=offer><b>Cargo bike</b> carries two children or ninety kilograms of shopping.<a href="//cargo.example.net/rent">Rent at partner</a></li></ul>
<h2 class="product-title">Opening hours of the workshop</h2>
<table class="pricing-table"><caption>Hours</caption><tr><th>Day</th><th>From</th></tr>
<tr><td>Mon <table><tr><td>odd weeks</td></tr></table> only</td><td>9</td></tr></table>
<footer>Imprint <a href="/legal">Legal</a></footer></body></html>"""
URL = "https://velo.example/rental/index.html"


def test_links_and_kinds(spark):
    links = {r.text: r for r in C.links(pages_df(spark, [(1, URL, BIKES)])).collect()}
    assert set(links) == {"All bikes", "Write us", "Sizes", "Rent at partner", "Legal"}
    assert links["Sizes"].absolute_url == "https://velo.example/rental/three#sizes" and links["Sizes"].same_site
    assert links["Rent at partner"].absolute_url == "https://cargo.example.net/rent"
    assert (links["Rent at partner"].kind, links["Rent at partner"].same_site) == ("external", False)
    assert (links["All bikes"].kind, links["Legal"].kind) == ("nav", "footer")


def test_items_are_cards_not_headings_or_tables(spark):
    items = C.items(pages_df(spark, [(1, URL, BIKES)])).orderBy("item_no").collect()
    assert [i.title for i in items] == ["Three-speed", "Cargo bike carries two children or ninety kilograms of shopping."]
    assert "now $12.50 per day" in items[0].text and [i.source_section for i in items] == ["City bikes", "Three-speed"]


def test_sections_tables_markdown(spark):
    p = pages_df(spark, [(1, URL, BIKES)])
    secs = {(r.heading, r.level) for r in C.sections(p).collect()}
    assert {("City bikes", 1), ("Three-speed", 3), ("Opening hours of the workshop", 2)} <= secs
    rows = C.table_cells(p).orderBy("row_no").collect()
    assert rows[0].cells == ["Day", "From"] and rows[0].caption == "Hours"
    assert [r.cells for r in rows[1:]] == [["Mon odd weeks only", "odd weeks", "9"], ["odd weeks"]]
    md = DOC.content_markdown(p).collect()[0].markdown
    assert md.startswith("# Rental & repair\n\nURL: ") and "\n\n\n" not in md
    assert "## City bikes\n" in md and "#### Three-speed\n" in md and "| Day | From |  |\n| --- | --- | --- |\n" in md
    assert "- [Rent at partner](https://cargo.example.net/rent) — external, source: Three-speed\n" in md
    assert md.endswith("\n") and not md.endswith("\n\n")


def test_nothing_is_cut_by_default(spark):
    words = " ".join(f"word{i}" for i in range(40000))
    links = "".join(f"<p><a href='/l{i}'>{'long label ' * 30}{i}</a></p>" for i in range(1200))
    cards = "".join(f"<article>Card number {i} with enough text to count</article>" for i in range(350))
    rows = "".join(f"<tr><td>{'c' * 1100}{i}</td></tr>" for i in range(130))
    buttons = "".join(f"<button>{i}</button>" for i in range(600))
    head = "<h2>" + "h" * 1500 + "</h2>"
    p = pages_df(spark, [(1, URL, f"<body>{head}<p>{words}</p>{links}{cards}<table>{rows}</table>{buttons}</body>")])
    assert max(r.text for r in C.paragraphs(p).collect() if r.text.startswith("word")) == words
    assert words in C.visible_text(p).collect()[0].text
    found = C.links(p).collect()
    assert len(found) == 1200 and all(len(r.text) > 240 for r in found)
    assert C.link_scope_counts(p, listed=200).collect()[0].n_omitted == 1000
    assert (C.items(p).count(), C.actions(p).count()) == (350, 600)
    cells = C.table_cells(p).collect()
    assert len(cells) == 130 and all(len(r.cells[0]) > 1100 for r in cells)
    assert len(C.first_heading(p).collect()[0].first_heading) == 1500
    cut = C.CAPTURE_LIMITS
    assert sum(len(r.text) + 1 for r in C.paragraphs(p, cut).collect()) <= cut.text + 1
    limited = C.links(p, cut).collect()
    assert len(limited) == 1000 and all(len(r.text) == 240 for r in limited)
    assert (C.items(p, cut).count(), C.actions(p, cut).count(), C.table_cells(p, cut).count()) == (300, 500, 100)


def test_hidden_and_dedupe(spark):
    html = ('<body><p>same</p><p>same</p><h2>H</h2><p>same</p><div hidden>secret one</div>'
            '<p style="display:none">gone two</p><a href="/x1">X</a><a href="/x1">X</a></body>')
    p = pages_df(spark, [(1, "https://a.example.com/", html)])
    paras = [r.text for r in C.paragraphs(p).orderBy("para_no").collect()]
    assert paras == ["same", "same", "X X"]
    assert [r.text for r in C.links(p).collect()] == ["X"]
    assert "secret" not in C.visible_text(p).collect()[0].text


def test_empty_page_warnings(spark):
    p = pages_df(spark, [(1, "https://a.example.com/", "<body></body>")])
    codes = [r.code for r in DOC.content_warnings(p).collect()]
    assert codes == ["content_empty"]


def test_links_in_headings_and_tables_not_collected(spark):
    html = ('<body><h2><a href="/inhead">In heading</a></h2><table><tr><td><a href="/intable">T</a></td></tr></table>'
            '<li>This list item is certainly long enough.</li></body>')
    p = pages_df(spark, [(1, "https://a.example.com/", html)])
    assert C.links(p).count() == 0
    assert [i.text for i in C.items(p).collect()] == ["This list item is certainly long enough."]


def test_inline_frames(spark):
    parent = '<body><h1>Top</h1><p>before</p><iframe src="/frame-inner.html"></iframe><iframe src="https://other.test/x"></iframe></body>'
    inner = '<body><h2>Inner</h2><p>inside text</p></body>'
    p = pages_df(spark, [(1, "http://127.0.0.1:8080/index.html", parent), (2, "http://127.0.0.1:8080/frame-inner.html", inner)])
    rows = [(r.page_id, r.entry_no, r.kind, r.level, r.text) for r in C.inline_frame_flow(p).orderBy("page_id", "entry_no").collect()]
    assert rows == [(1, 0, "heading", 3, "Frame: http://127.0.0.1:8080/frame-inner.html"), (1, 1, "heading", 2, "Inner"),
                    (1, 2, "paragraph", None, "inside text")]
    w = [(r.page_id, r.code) for r in DOC.content_warnings(p).collect()]
    assert w == [(1, "iframe_cross_origin")]


def test_content_json_document(spark):
    doc = DOC.content_json(pages_df(spark, [(1, URL, BIKES + "<iframe src='//maps.example.net/'></iframe>")])).collect()[0]
    assert doc.schema_version == 1 and doc.page.title == "Rental & repair"
    assert [(s.heading, s.level) for s in doc.sections] == [("Page", 1), ("City bikes", 1), ("Three-speed", 3), ("Opening hours of the workshop", 2)]
    assert any("now $12.50 per day" in t for s in doc.sections for t in s.text)
    assert [l.text for s in doc.sections for l in s.links] == ["All bikes", "Write us", "Sizes", "Rent at partner", "Legal"]
    assert [(i.title, i.source_section) for i in doc.items][0] == ("Three-speed", "City bikes")
    assert [list(r) for r in doc.tables[0].rows] == [["Day", "From"], ["Mon odd weeks only", "odd weeks", "9"], ["odd weeks"]]
    assert [w.code for w in doc.warnings] == ["iframe_cross_origin"]


def test_card_links_in_headings_and_tables_and_not_merged(spark):
    html = ("<body><h1>Shop</h1><a href='/out'>out</a><article><h3><a href='/h'>Head</a></h3> enough text for a card here "
            "<a name=x>no target <a href='/in'>inner</a></a><table><tr><td><a href='/t'>Cell</a></td></tr></table>"
            "<a href='/h'>Head</a><ul><li>nested <a href='/n' hidden>gone</a><a href='/deep'>Deep</a></li></ul></article><a href='/after'>after</a></body>")
    p = pages_df(spark, [(1, URL, html)])
    (card,) = C.items(p).collect()
    assert [(l.text, l.absolute_url.rsplit("/", 1)[1], l.source_section) for l in card.links] == [
        ("Head", "h", "Shop"), ("inner", "in", "Shop"), ("Cell", "t", "Shop"), ("Head", "h", "Shop"), ("Deep", "deep", "Shop")]
    (cut,) = C.items(p, C.Limits(item_links=2)).collect()
    assert [l.text for l in cut.links] == ["Head", "inner"]
    doc = DOC.content_json(p).collect()[0]
    assert [l.text for l in doc["items"][0].links] == ["Head", "inner", "Cell", "Head", "Deep"]


SITE = "http://site.test/a/"


def frame_site(spark):
    page = lambda name, body: (SITE + name, f"<body>{body}</body>")
    pages = [page("top", "<h1>Top</h1><p>before</p><iframe src='one'></iframe><p>after</p><a href='x'>own</a>"),
             page("one", "<p>one text</p><h2>One</h2><iframe src='../a/two'></iframe><article>a card in a frame, long enough <a href='x'>framed</a></article><p>tail</p>"),
             page("two", "<p>two text</p><table><tr><td>cell</td></tr></table><iframe src='top'></iframe><iframe src='//else.test/z'></iframe>"),
             page("loop", "<iframe src='loop'></iframe><p>self</p>")]
    return pages_df(spark, [(i, u, h) for i, (u, h) in enumerate(pages)])


def test_frames_in_frames_are_spliced_and_the_section_resumes(spark):
    p = frame_site(spark)
    paras = [(r.section_no, r.text) for r in C.paragraphs(p, frames=True).where("page_id = 0").orderBy("para_no").collect()]
    assert paras == [(1, "before"), (2, "one text"), (4, "two text"), (3, "a card in a frame, long enough framed"), (3, "tail"), (1, "after"), (1, "own")]
    secs = {r.section_no: (r.heading, r.level) for r in C.sections(p, frames=True).where("page_id = 0").collect()}
    assert secs == {1: ("Top", 1), 2: (f"Frame: {SITE}one", 3), 3: ("One", 2), 4: (f"Frame: {SITE}two", 3)}
    doc = {r.page_id: r for r in DOC.content_json(p, frames=True).collect()}[0]
    assert [(w.code, w.detail.split(": ")[1]) for w in doc.warnings] == [("iframe_unavailable", SITE + "top"), ("iframe_cross_origin", "http://else.test/z")]
    assert [(l.text, l.source_section) for l in doc.links] == [("framed", "One"), ("own", "Top")]
    assert [l.text for l in doc["items"][0].links] == ["framed"] and doc.tables[0].source_section == f"Frame: {SITE}two"
    md = {r.page_id: r.markdown for r in DOC.content_markdown(p, frames=True).collect()}
    assert f"#### Frame: {SITE}two\n\ntwo text\n\n| cell |\n| --- |\n\na card in a frame" in md[0]


def test_a_frame_of_itself_is_not_entered(spark):
    p = frame_site(spark).where("page_id = 3")
    assert [r.text for r in C.paragraphs(p, frames=True).collect()] == ["self"]
    assert [w.code for w in DOC.content_warnings(p, frames=True).collect()] == ["iframe_unavailable"]


def test_pages_without_html_have_documents(spark):
    p = pages_df(spark, [(1, URL, None), (2, URL, ""), (3, URL, "<title>T</title>")])
    docs = {r.page_id: r for r in DOC.content_json(p).collect()}
    assert sorted(docs) == [1, 2, 3] and docs[3].page.title == "T"
    assert all([w.code for w in d.warnings] == ["content_empty"] and not d.sections for d in docs.values())


def test_one_exchange_of_the_pages_and_no_checkpoint(spark):
    plan = DOC.page_parts(pages_df(spark, [(1, URL, BIKES)]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(page_id" in plan


def test_page_partitions_follow_the_html_not_its_compressed_size(spark, tmp_path):
    from pagefold.operators import html as H
    spark.range(48).repartition(4).selectExpr("id AS page_id", "'u' AS url", "repeat(sha2(CAST(id AS STRING), 256), 16384) AS html").write.parquet(f"{tmp_path}/pages")
    p = spark.read.parquet(f"{tmp_path}/pages")
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 48 << 18
    assert H.page_partitions(p) == 12 and H.page_partitions(p.where("page_id < 4")) == 2 * spark.sparkContext.defaultParallelism


def test_documents_with_frames_tokenize_the_pages_once(spark, monkeypatch):
    from pagefold.operators import html as H
    calls = []
    monkeypatch.setattr(C, "html_tokens", lambda *a, **k: calls.append(1) or H.html_tokens(*a, **k))
    DOC.content_json(frame_site(spark).where("page_id = 3"), frames=True)
    assert len(calls) == 1
