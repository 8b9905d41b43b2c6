"""Listing crawl: two sites share a category name; chains end only on a revisit or a missing page."""

from shelfspark.operators import listing as LI

SCHEMA = "category string, page_no int, pos long, page_url string, next_href string, href string, text string"


def _links(spark):
    rows = []
    for host, pages in (("one.example", 5), ("two.example", 2)):
        for n in range(1, pages + 1):
            nxt = f"?page={n + 1}" if n < pages else "?page=1"
            for k in range(2):
                href = "/cart" if n == 2 else f"/p/{n}{k}"  # the second page has no product
                rows.append(("Women", n, n * 10 + k, f"https://{host}/c/women?page={n}", nxt, href, f"Item {n}{k}"))
    return spark.createDataFrame(rows, SCHEMA)


def test_chain_reads_every_page_per_site(spark):
    links = _links(spark)
    chain = LI.pagination_chain(LI.categories_from_listing(links), LI.listing_pages(links)).collect()
    depths = {s: sorted(r["depth"] for r in chain if r["site"] == s) for s in ("one.example", "two.example")}
    assert depths == {"one.example": [1, 2, 3, 4, 5], "two.example": [1, 2]}
    bounded = LI.pagination_chain(LI.categories_from_listing(links), LI.listing_pages(links), 2)
    assert bounded.count() == 4


def test_links_are_counted_per_site(spark):
    links = _links(spark)
    cats = LI.categories_from_listing(links)
    collected, counts = LI.category_product_links(cats, links)
    assert {r["site"]: (r["links_discovered"], r["pages_visited"]) for r in counts.collect()} == {
        "one.example": (8, 5), "two.example": (2, 2)}
    assert sorted(r["rank"] for r in collected.collect() if r["site"] == "one.example") == list(range(1, 9))


def test_limit_stops_the_crawl(spark):
    links = _links(spark)
    collected, counts = LI.category_product_links(LI.categories_from_listing(links), links, per_category=3)
    got = {r["site"]: (r["links_discovered"], r["pages_visited"]) for r in counts.collect()}
    assert got == {"one.example": (4, 3), "two.example": (2, 2)}
    urls = {r["rank"]: r["url"] for r in collected.collect() if r["site"] == "one.example"}
    assert urls == {1: "https://one.example/p/10", 2: "https://one.example/p/11", 3: "https://one.example/p/30"}
