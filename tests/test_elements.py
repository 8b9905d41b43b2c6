"""Elements, nested text and selectors of pages."""

import random
import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import elements as E
from shelfspark.functions import urls as U

PAGE = """<!doctype html><html><head><title>Red &amp; blue</title><style>h1{}</style></head><body>
<!-- <a href="/hidden">no</a> --><header><nav class="main"><a href="/c/a"><b>Shoes</b> sale</a>
<a href="/c/b" aria-label="Bags"><img src="x.png"></a><a>none</a></nav></header>
<h1><span>Red Shoe</span></h1><div class="price big"><span>12,50</span> EUR</div>
<div class="breadcrumb"><div><a href="/">Home</a></div><div><a href="/c/a">Shoes</a></div></div>
<ul><li class="card" data-product-id="7"><div><div>x</div><a href="/i/7">Seven</a></div><li class="card"><a href='/i/8'>Eight</ul>
<select class="currency"><option value="USD">d<option selected value="GBP">p</select><script>var a = "<h1>no</h1>";</script>
<a href="/c/a"><b>Shoes</b> sale</a></body></html>"""


@pytest.fixture(scope="module")
def page(spark):
    return E.with_elements(spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id long, html string"))


def first(page, column):
    return page.where("page_id = 1").select(column.alias("v")).first().v


@pytest.mark.parametrize("texts, want", [
    (["h1"], ["Red Shoe"]), ([".price"], ["12,50 EUR"]), (["div.big.price span"], ["12,50"]), (["title"], ["Red & blue"]),
    ([".none", "[data-product-id] a[href]"], ["Seven"]), ([".currency option[selected]@value"], ["GBP"]),
    ([".currency option[selected]"], ["p"]), ([".breadcrumb a"], ["Home", "Shoes"]), (["li.card a@href"], ["/i/7", "/i/8"]),
    (["h1 > span", "a:first-child", "li"], ["xSeven", "Eight"]), (["a[href*='/i/']"], ["Seven", "Eight"]), (["ul div div"], ["x"]),
])
def test_values(page, texts, want):
    assert first(page, E.first_values(F.col("dom"), E.selectors(texts))) == want


def test_links(page):
    groups = F.array(E.selectors(["header nav a[href]", "nav a[href]"]), E.selectors(["a"]), E.selectors([".nothing a"]))
    nav, everything, none = first(page, E.links(F.col("dom"), groups))
    assert [(x.href, x.text) for x in nav] == [("/c/a", "Shoes sale"), ("/c/b", "Bags")]
    assert [(x.href, x.text) for x in everything] == [("/c/a", "Shoes sale"), ("/c/b", "Bags"), ("/", "Home"), ("/c/a", "Shoes"), ("/i/7", "Seven"), ("/i/8", "Eight")]
    assert none == []
    assert first(page, E.first_href(F.col("dom"), E.selectors(["a[rel='next']", "nav a"]))) == "/c/a"


def test_pages_without_markup(page):
    for row in page.where("page_id > 1").select(E.first_values(F.col("dom"), E.selectors(["h1"])).alias("v"),
                                                E.first_href(F.col("dom"), E.selectors(["a"])).alias("h")).collect():
        assert (row.v, row.h) == ([], "")


def test_selectors_may_differ_by_row(spark, page):
    rules = spark.createDataFrame([(1, '["h1"]'), (2, "[]")], "page_id long, rule string")
    parsed = rules.withColumn("chosen", F.when(F.col("page_id") == 1, E.selectors(["h1"])).otherwise(E.selectors([])))
    got = {r.page_id: r.v for r in page.join(parsed, "page_id").select("page_id", E.first_values(F.col("dom"), F.col("chosen")).alias("v")).collect()}
    assert got == {1: ["Red Shoe"], 2: []}


def test_unbalanced_markup():
    dom = E.parse("<div><p>a<div>b</div></section>c</div>d<p>e<p>f")
    spans = [(e["tag"], e["pos"], e["until"], dom["text"][e["start"]:e["end"]]) for e in dom["elements"]]
    assert spans == [("div", 0, 3, "abc"), ("p", 1, 2, "a"), ("div", 2, 3, "b"), ("p", 3, 4, "e"), ("p", 4, 5, "f")]
    assert E.parse_selector("a > b") is None and E.parse_selector("a:hover") is None and E.parse_selector("") is None


def test_many_cards_take_time_in_proportion(spark):
    """Containers are found once a selector, not once an element."""
    n = 4000
    html = "<ul>" + "".join(f"<li class='card'><div class='card'>é{i}<a href='/i/{i}'>Item {i % 10}</a></div><a href='/i/{i}'>Item {i % 10}</a>" for i in range(n)) + "</ul><a href='/out'>x</a>"
    page = E.with_elements(spark.createDataFrame([(1, html)], "page_id long, html string"))
    start = time.monotonic()
    got = first(page, E.links(F.col("dom"), F.array(E.selectors(["[class*='card'] .card a[href]", "li.card a"]))))[0]
    assert [(x.href, x.text) for x in got] == [(f"/i/{i}", f"Item {i % 10}") for i in range(n)]
    assert time.monotonic() - start < 60


def test_links_keep_texts_that_are_absent(spark):
    page = E.with_elements(spark.createDataFrame([(1, "<a href='1:2=é'></a><a href='1:2=é' aria-label='='></a><a href='1:2=é'></a><a href='1'>2:=</a>")], "page_id long, html string"))
    assert [(x.href, x.text) for x in first(page, E.links(F.col("dom"), F.array(E.selectors(["a"]))))[0]] == [("1:2=é", ""), ("1:2=é", "="), ("1", "2:=")]


def test_steps_look_at_indexed_elements(spark):
    """Tags, classes and attributes name their elements, each once and in order; any kind of
    step finds what a pass over the whole page finds, a link matched by several selectors once."""
    html = "<DIV class='b a b' id='x'><a href='/1' class='a'>1</a><p id='y'>p<a rel=next>2</a></p></DIV><a href='/3'>3</a>"
    index = dict(E.in_pieces(E.parse(html))["index"])
    assert index == {"div": [0], ".a": [0, 1], ".b": [0], "[class": [0, 1], "[id": [0, 2], "a": [1, 3, 4], "[href": [1, 4], "p": [2], "[rel": [3]}
    page = E.with_elements(spark.createDataFrame([(1, html)], "page_id long, html string"))
    texts = ["#y", "p#y a", "#z a", ".a", "a.a", "*", "#x *", "[rel]", ".b a[href]", ".none a", "div p a[rel='next']"]
    whole = {"#y": [2], "p#y a": [3], "#z a": [], ".a": [0, 1], "a.a": [1], "*": [0, 1, 2, 3, 4], "#x *": [1, 2, 3], "[rel]": [3], ".b a[href]": [1],
             ".none a": [], "div p a[rel='next']": [3]}
    got = first(page, F.transform(E.selectors(texts), lambda s: F.transform(E.select(F.col("dom"), s), lambda e: e["pos"])))
    assert dict(zip(texts, got)) == whole
    links = first(page, E.links(F.col("dom"), F.array(E.selectors(["a[href='/3']", "a", ".a"]))))[0]
    assert [(x.href, x.text) for x in links] == [("/3", "3"), ("/1", "1")]


def test_pages_are_parsed_in_batches_of_bounded_size(monkeypatch):
    """A batch from Spark may hold thousands of pages, some with a whole shop."""
    monkeypatch.setattr(E, "MOST_CHARS", 10)
    assert [*E._by_size(["x" * 4, "x" * 4, "x" * 4, None, "x" * 30, "", "x"])] == [(0, 2), (2, 4), (4, 5), (5, 7)]
    assert [*E._by_size([])] == []


def test_plain_hrefs_resolve_as_the_stages_do(spark):
    """Queries, fragments and absolute URLs do without the staged resolver, with its results."""
    ends = ["", "?", "?utm_campaign=x", "?a=1&utm_x=2&b=", "?a=1&gclid=2", "?page=2#top", "#top", "?a=1&utm_x=2&b", "?a=+1", "?a=%20&UTM_s=1", "?x=a b", "?q=1?utm_x=1", "#?utm_x=1"]
    hrefs = [head + end for head in ("/p/1", "/", "https://a.test/p/1", "HTTP://a.test/p", "https://a.test", "//b.test/x", "x/../y", "/a/./b", "?page=2", "", "/é", "mailto:x",
                                     "https://a.test:443/x", " /p", "/p\n") for end in ends]
    for page in ("https://shop.test/c/x?y=1", "https://u@Shop.test:8080/", ""):
        rows = spark.createDataFrame([(page, list(enumerate(hrefs)))], "page string, raw array<struct<pos:int,href:string>>").select("raw", U.base_parts("page").alias("base"))
        staged = U.project(U.resolve_stages(F.col("raw"), F.col("base")), "pos", "href", "url")
        got = rows.select(U.resolve_links(F.col("raw"), F.col("base"), keep=("pos",)).alias("links"), staged.alias("staged"),
                          F.transform("raw", lambda x: U._plain_url(x["href"], F.col("base"))).alias("plain")).first()
        want = {x.href: x.url for x in got.staged if not x.href.endswith("\n")}
        assert {hrefs[x.pos]: x.url for x in got.links if hrefs[x.pos] in want} == want
        plain = dict(zip(hrefs, got.plain))
        assert page == "" or (None not in [plain["/p/1" + e] for e in ends[:7]] and plain["/p/1?a=+1"] is plain["x/../y"] is None)


def card_page(n):
    return "<ul>" + "".join(f'<li class="product-item" data-product-id="{i}"><div class="box"><div class="pic"><img src="/img/{i}.jpg"></div><div class="info">'
                            f'<a href="/p/{i}"><span>Item</span> {i}</a></div></div></li>' for i in range(n)) + "</ul>"


def test_a_page_takes_memory_in_proportion_to_its_markup():
    """Elements of a page that lists a whole shop are no objects of their own."""
    html = card_page(20_000)
    tracemalloc.start()
    try:
        page = E.scan(html)
        links = E.linked(page, E.compiled(E.selector_texts(["[data-product-id] a[href]", ".none a"])))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(links) == 20_000 and E.link_of(page, links[-1]) == ("/p/19999", "Item 19999")
    assert most < 3 * len(html)


def test_selectors_find_the_same_where_a_page_is_parsed(spark, page):
    """Of nested, unclosed and repeated elements, over any kind of step."""
    rnd = random.Random(5)
    bits = ["<div class='a b'>", "</div>", "<p id=x>", "<li class=b>", "<ul>", "</ul>", "<a href='/1'>one", "<a class='a' href=''>", "<a href='/2?x=1' rel=next>two  &amp;</a>", "</a>",
            "<img src='i.png' class='b'>", "text  é ", "<span itemprop='name'>", "</span>", "<script>var x='<a>'</script>", "<a href='/3' aria-label=' label '></a>"]
    htmls = [None, "", PAGE, *["".join(rnd.choices(bits, k=rnd.randrange(1, 60))) for _ in range(40)]]
    texts = ["a", "*", "div a[href]", ".a .b", "li", "ul li a", "#x a@href", "[id] [href]", "a[rel='next']", "a[href*='?']", "[itemprop='name']", "img@src", ".b@class", "div div", ".none a", "div.a.b *"]
    pages = E.with_elements(spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string"))
    dom, one = F.col("dom"), [E.selectors([t]) for t in texts]
    rows = pages.select("page_id", *[F.struct(F.transform(E.select(dom, s[0]), lambda e: e["pos"]).alias("places"), E.first_values(dom, s).alias("texts"), E.first_href(dom, s).alias("href"),
                                              F.transform(E.link_places(dom, s), lambda p: E.link_at(dom, p)).alias("links")).alias(f"s{i}") for i, s in enumerate(one)],
                        E.first_values(dom, E.selectors(texts[8:])).alias("first"), E.link_places(dom, E.selectors(texts)).alias("every")).collect()
    for row in rows:
        parsed = E.scan(htmls[row.page_id])
        for i, t in enumerate(texts):
            own, want = E.compiled(E.selector_texts([t])), row[f"s{i}"]
            assert list(E.places(parsed, own[0])) == want.places, (htmls[row.page_id], t)
            assert [*E.texts(parsed, own)] == want.texts and E.first_link(parsed, own) == want.href
            assert [(p, *E.link_of(parsed, p)) for p in E.linked(parsed, own)] == [tuple(x) for x in want.links]
        assert [*E.texts(parsed, E.compiled(E.selector_texts(texts[8:])))] == row["first"]
        assert list(E.linked(parsed, E.compiled(E.selector_texts(texts)))) == row.every
