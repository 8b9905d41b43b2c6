import pytest
from pyspark.sql import functions as F

from shelfspark.functions import scoring as S
from shelfspark.operators.extract import category_path_from_url

SHOP = "https://garden.example"


def test_product_url_points(spark):
    points = {
        f"{SHOP}/p/spade-7": 5,
        f"{SHOP}/item?pid=44": 5,
        f"{SHOP}/hose-1234567.html": 5,
        f"{SHOP}/hose-P88.aspx": 4,
        f"{SHOP}/soil-mix-20l-bag": 4,  # slug with a number and a further part
        f"{SHOP}/Product-ShowQuickView?sku=9": 2,  # 5 - 3
        f"{SHOP}/cart": -6,
        f"{SHOP}/": 0,
        "": 0,
    }
    df = spark.createDataFrame([(u,) for u in points], ["url"])
    got = {r.url: r.s for r in df.select("url", S.score_product_url("url").alias("s")).collect()}
    assert got == points


@pytest.mark.parametrize(("path", "text", "score"), [
    ("/c/tools", "Tools", 5),  # include pattern
    ("/plants-C14.aspx", "Plants", 5),
    ("/x", "New arrivals", 3),  # keyword
    ("/c/p/spade", "Spade", 0),  # include pattern, but a product
    ("/account/c/", "Mine", None),  # excluded path
    ("/stores", "Find us", None),  # store locator
    ("/c/tools", "Help", None),  # excluded text
    ("/c/tools", "T", None),  # too short
])
def test_category_link_points(spark, path, text, score):
    df = spark.createDataFrame([(SHOP + path, text)], ["url", "text"])
    assert df.select(S.score_category_link("url", "text")).first()[0] == score


def test_category_path_from_url(spark):
    # two segments give a path only where both are of the fixed category words
    paths = {"/plants-C14.aspx": ["Plants"], "/en_GB/women/accessories": ["Women", "Accessories"], "/en_GB/tools/hoes": []}
    df = spark.createDataFrame([(SHOP + p,) for p in paths], ["url"])
    assert [r[0] for r in df.select(category_path_from_url(F.col("url"))).collect()] == list(paths.values())


def test_page_type_rules(spark):
    rows = [("search", "search", "/find", 9, 9, True, True, True),  # a requested search comes first
            ("search", None, "/Search?q=hoe", 0, 9, False, False, False),
            ("pdp", "pdp", "/p/hoe", 0, 7, False, True, True),  # a requested product page before many links
            ("plp", None, "/c/soil", 0, 6, True, False, False),  # six products outweigh product markup
            ("plp", "plp", "/c/soil", 0, 3, False, False, False),
            ("unknown", None, "/c/soil", 0, 3, False, False, False),
            ("pdp", None, "/x", 0, 0, True, False, False),
            ("home", None, "/", 4, 0, False, True, False),  # a cart without a price is no purchase
            ("plp", "plp", "/c/empty", 0, 0, False, False, False)]
    df = spark.createDataFrame(rows, "want string, req string, url string, ncat int, nprod int, ld boolean, cart boolean, price boolean")
    got = df.select("want", S.page_type("req", "url", "ncat", "nprod", "ld", "cart", "price").alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_contextual_links_get_minimum_score(spark):
    from shelfspark.operators import links as L
    html = (f'<html><body><div class="tile product-card"><a href="/tools/fork">Fork</a></div>'
            f'<div class="footer"><a href="/imprint">Imprint</a></div>'
            f'<li data-product-id="31"><a href="/p/31">Hoe</a></li></body></html>')
    pages = spark.createDataFrame([(1, "garden.example", f"{SHOP}/c/tools", html, 1)],
                                  "page_id long, site string, url string, html string, seq long")
    got = sorted((r.url, r.score) for r in L.contextual_links(pages).collect())
    assert got == [(f"{SHOP}/p/31", 5), (f"{SHOP}/tools/fork", 4)]
