"""Wrapper induction: what counts as a copy, layouts, and names that differ by page."""

from tidemark.llm.html_extract import extract


def texts(spark, pages):
    rows = [(i, f"http://a.com/{i}", h) for i, h in enumerate(pages)]
    return {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_a_long_shared_script_is_no_content(spark):
    page = "<html><head><script>{0}</script></head><body><div>Site name</div><div><p>Text {1} of its own.</p></div><footer>{0}</footer></body></html>"
    got = texts(spark, [page.format("var shared = 1; " * 20, i) for i in range(5)])
    assert got == {i: f"Text {i} of its own." for i in range(5)}


def test_layouts_copies_and_names_by_page(spark):
    old = "<html><body><div class='old'><div>Old site</div><p>First {0} of its own.</p></div></body></html>"
    new = "<html><body class='page postid-{0}'><div id='post-{0}'><div>New site</div><p>Second {0} of its own.</p></div></body></html>"
    copy = "<html><body><div class='old'><div>Old site</div><p>The same.</p></div></body></html>"
    pages = [old.format(i) for i in range(8)] + [new.format(i) for i in range(8)] + [copy] * 40
    got = texts(spark, pages)
    assert got == {**{i: f"First {i} of its own." for i in range(8)}, **{8 + i: f"Second {i} of its own." for i in range(8)}, **{16 + i: "The same." for i in range(40)}}
