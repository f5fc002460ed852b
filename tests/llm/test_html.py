"""Pages that are deep, and hosts with more than one template."""

from pathloom.llm import html_extract


def texts(spark, pages):
    found = html_extract.main_text(spark.createDataFrame(pages, "page_id long, url string, html string"))
    return {r.page_id: r.text for r in found.collect()}


def test_page_200_deep(spark):
    deep = "<div>" * 200 + "<article><p>below</p></article>" + "</div>" * 200
    inside = "<article><p>one</p>" + "<div>" * 200 + "two" + "</div>" * 200 + "<p>three</p></article><p>out</p>"
    advert = "<article>" + "<div>" * 100 + "<div class=ad>" + "<div>" * 100 + "buy" + "</div>" * 201 + "<p>text</p></article>"
    unclosed = "<article>" + "<div>x" * 100 + "<p>end</article><p>out</p>"
    plain = "<article><p>plain</p></article>"
    pages = [(1, "http://h/1", deep), (2, "http://h/2", inside), (3, "http://h/3", advert), (4, "http://h/4", unclosed), (5, "http://h/5", plain)]
    assert texts(spark, pages) == {1: "below", 2: "one\ntwo\nthree", 3: "text", 4: "\n".join(["x"] * 100 + ["end"]), 5: "plain"}


def test_host_with_two_templates(spark):
    """Most pages have an article, the others hold their prose in divs; a page whose article is empty has no text."""
    pages = [(i, f"http://h/{i}", f"<div class=x><div>side</div></div><article><p>text {i}</p></article>") for i in range(6)]
    pages += [(i, f"http://h/{i}", f"<nav>menu</nav><div>top {i}</div><section><div><p>long prose of page {i}</p><p>more of it</p></div></section>") for i in range(6, 9)]
    pages += [(9, "http://h/9", "<div>side</div><article></article>"), (10, "http://h/10", "<div>unlike any other</div>")]
    want = {i: f"text {i}" for i in range(6)} | {i: f"long prose of page {i}\nmore of it" for i in range(6, 9)} | {9: "", 10: "unlike any other"}
    assert texts(spark, pages) == want


def test_template_under_neutral_names(spark):
    """A block that all pages of a host share goes whatever its class; copies of one page make no template."""
    welcome = "<div class=x1><p>welcome to these pages</p><ul><li>first link</li><li>second link</li></ul></div>"
    pages = [(i, "http://h/", f"<article><h1>Title</h1>{welcome}<p>prose of page {i}</p><p>more {i}</p></article>") for i in range(20)]
    pages += [(100 + i, "http://copies/", "<article><p>the same page again</p></article>") for i in range(30)]
    pages += [(200 + i, "http://copies/", f"<article><p>another {i}</p></article>") for i in range(6)]
    pages += [(300 + i, "http://few/", f"<article><p>shared by few</p><p>own {i}</p></article>") for i in range(4)]
    want = {i: f"Title\nprose of page {i}\nmore {i}" for i in range(20)} | {100 + i: "the same page again" for i in range(30)}
    want |= {200 + i: f"another {i}" for i in range(6)} | {300 + i: f"shared by few\nown {i}" for i in range(4)}
    assert texts(spark, pages) == want
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    for n in (1, 7):
        assert {r.page_id: r.text for r in html_extract.main_text(frame.repartition(n), broadcast_bytes=-1 if n == 7 else 1 << 25).collect()} == want


def test_odd_tables(spark):
    assert texts(spark, [(1, None, "no tags  at\nall"), (2, "odd", None), (3, "http://h/", "<article><p>a <math><mi>x</mi><mo>+</mo></math> b</article>")]) == {1: "no tags at all", 2: "", 3: "a x+ b"}
    frame = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.main_text(frame).count() == 0
    rows = spark.createDataFrame([(1, "http://h/", "<p>one</p>"), (1, "http://h/", "<p>two</p>"), (None, None, "<p>three</p>")], "page_id long, url string, html string").selectExpr("*", "'x' as text", "'y' as host", "'z' as role", "1 as salt")
    assert sorted(r.text for r in html_extract.main_text(rows).collect()) == ["one", "three", "two"]


def test_alignment():
    a, b = list("xaybzbq"), list("aybbqx")
    pairs = html_extract.matches(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and [x for x, _ in pairs] == sorted({x for x, _ in pairs}) and [y for _, y in pairs] == sorted({y for _, y in pairs})
    assert "".join(a[i] for i, _ in pairs) == "aybbq"
    html_extract.align([[f"p{i % 50}", True, False, False, 1, 1, 0] for i in range(4000)], [[f"p{i % 47}", True, False, False, 1, 1, 0] for i in range(4000)])


def test_odd_pages_take_little_time():
    """5 MB of what never ends, in seconds: the scanner looks at each character a bounded number of times."""
    import time

    size = 5 << 20
    for unit, tail in (("<a ", ""), ('<p title="x ', ""), ("<p title='x>", ""), ("<a ", '="' + ">" * size), ('="', ""), ("<nav>", ""), ("<div><p>x</p>", ""), ("<svg>", ""), ("<script>", ""), ("</div>", ""), ("<!--", ""), ("<!", ""), ("<", ""), ("&#x", ""), ("class   ", ">x"), ("<ul><li>", "")):
        page = ("<p " if unit in ('="', "class   ") else "") + unit * (size // len(unit)) + tail
        began = time.process_time()
        html_extract.parse(page)
        assert time.process_time() - began < 60, unit


def test_quotes_and_tags_that_do_not_end():
    text = lambda page: [t for _, t in html_extract.parse(page)]
    assert text("<article><p title=it's>Hello</p><p>It's ok</p><p>bye</p></article>") == ["Hello", "It's ok", "bye"]
    assert text("<p title=\"a > b\" class='x>y' id = \"z>\">one</p>") == ["one"] and text("<p a\"b>two</p>") == ["two"]
    assert text('<p>kept</p><p title="open>lost</p><p>x</p>') == ["kept", "lost", "x"]  # no quote closes it
    assert text("<p>kept</p><a href=never") == ["kept"] and text("<p>1 < 2 <3</p>") == ["1 < 2 <3"]
    assert text("<p>a</p><!-- x > y --><p>b</p><!bogus><?php z ?><p>c</p><!-- open <p>d</p>") == ["a", "b", "c"]
    assert text("<p>a</p><script>if (a<b && s == \"</p>\") { x = '<'; }</script><p>b</p><style>p::after{content:'<'}") == ["a", "b"]


def test_names_say_nothing_about_prose(spark):
    page = "<article><h2 class='social'>Social policy</h2><p class='related-work'>Related</p><h2 class='comments-policy'>Rules</h2><div class=ad>buy</div><p>end</p></article>"
    assert texts(spark, [(1, "http://h/", page)]) == {1: "Social policy\nRelated\nRules\nend"}
