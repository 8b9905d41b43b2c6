"""The composed crawl against a sequential replay, rules by site, resuming."""

import random

import pytest
from pyspark.sql import functions as F

from shelfspark.functions.text import fold_text
from shelfspark.operators import crawl as C
from shelfspark.operators import storefront as SF
from shelfspark.operators.storefront import page_facts

HOST = "https://shop.test"


def page_row(n, site, path, body):
    return (n, f"{site}.test", n, f"https://{site}.test{path}", f"<html><body>{body}</body></html>")


def shop(site, first, rnd):
    """Pages of one shop with shared menu targets, listing cycles and missing pages."""
    names = [f"Line {c}" for c in "ABCDEF"]
    link = lambda i: f'<a href="/c/{i}">{names[i]}</a>'
    rows, n = [page_row(first, site, "/", "<nav>" + "".join(link(i) for i in range(4)) + "</nav>")], first + 1
    for i in range(6):
        if i == 3 and site == "two":
            continue  # its page is missing
        menu = "".join(link(rnd.randrange(6)) for _ in range(4))
        for k in range(1, 4):
            items = "".join(f'<div class="product-card"><div><i>x</i></div><a href="{rnd.choice(["/p/", "/q/"])}{rnd.randrange(12)}">P</a></div>' for _ in range(rnd.randrange(4)))
            following = rnd.choice([f"/c/{i}?page={k + 1}", f"/c/{i}", f"/c/{(i + 1) % 6}", "", f"/c/{i}?page={k}"])
            rows.append(page_row(n, site, f"/c/{i}" + (f"?page={k}" if k > 1 else ""), f'<nav>{menu}</nav>{items}' + (f'<a rel="next" href="{following}">n</a>' if following else "")))
            n += 1
    for kind in "pq":
        for i in range(11):
            rows.append(page_row(n, site, f"/{kind}/{i}", f"<h1><b>Item</b> {i % 5}</h1><p class=sku>S{i % 7}</p>" + (f'<p class="price"><b>{i}</b>,50 €</p>' if i % 3 else "")))
            n += 1
    return rows


def replay(facts, most_categories, most_sub, most_pages, per_category):
    """One site's crawl step by step, over the facts of its pages."""
    entry = min(facts.values(), key=lambda f: f.seq)
    top = [(c.text, c.url, [c.text]) for c in entry.categories][:3 * most_categories] or [("catalog", entry.page_url, ["catalog"])]
    todo = []
    for name, url, path in top[:most_categories]:
        todo.append((name, url, path))
        menu = facts[url].categories if url in facts else []
        subs = [c for c in menu if c.url != url and c.url.startswith(f"https://{entry.site}")]
        todo += [(c.text, c.url, [*path, c.text]) for c in subs[:2 * most_sub][:most_sub]]
    seen, categories, visits = set(), [], []
    for name, url, path in todo:
        if url in seen:
            continue
        seen.add(url)
        links, visited, at = [], set(), url
        for _ in range(most_pages):
            if not at or at in visited or at not in facts:
                break
            visited.add(at)
            links += [p.url for p in facts[at].products if p.url not in links]
            if len(links) >= per_category:
                break
            at = facts[at].next_url
        categories.append((name, url, " > ".join(path), len(links), len(visited)))
        visits += [(url, p) for p in links[:per_category]]
    return categories, visits


@pytest.fixture(scope="module")
def shops(spark):
    rnd = random.Random(11)
    rows = shop("one", 0, rnd) + shop("two", 1000, rnd) + [page_row(5000, "three", "/", '<a href="/about">About us</a><div class="product-card"><a href="/q/1">P</a></div>'),
                                                            page_row(5001, "three", "/q/1", "<title>Only a title</title>")]
    rows += [(r[0] + 20_000, *r[1:4], r[4].replace("Item", "Later")) for r in rows[5:9]]  # seen again later: the first counts
    return spark.createDataFrame(rows, "page_id long, site string, seq long, url string, html string").repartition(6)


@pytest.mark.parametrize("limits", [(4, 2, 3, 3), (3, 4, 2, 2), (10, 10, 50, 1000)])
def test_crawl_like_replay(spark, shops, tmp_path_factory, limits):
    root = str(tmp_path_factory.mktemp("crawl"))
    most, sub, pages, per = limits
    catalog = C.build_catalog(shops, root=root, max_categories=most, max_subcategories=sub, max_pages=pages, products_per_category=per)
    facts = {}
    for f in catalog.facts.collect():
        facts.setdefault(f.site, {})[f.page_url] = f
    got_categories, got_visits = {}, {}
    for r in sorted(catalog.categories.collect(), key=lambda r: (r.place, r["sub"])):
        got_categories.setdefault(r.site, []).append((r.name, r.url, " > ".join(r.path), r.links_discovered, r.pages_visited))
    for r in sorted(catalog.visits.collect(), key=lambda r: r.visit):
        got_visits.setdefault(r.site, []).append((r.category_url, r.product_url))
    for site, own in facts.items():
        categories, visits = replay(own, most, sub, pages, per)
        assert got_categories[site] == categories
        assert got_visits.get(site, []) == visits
    assert sorted(facts) == ["one.test", "three.test", "two.test"]
    # fields of a merged product are those of the last visit that has them
    last = {}
    sightings = sorted(catalog.sightings.collect(), key=lambda r: r.seq)
    for r in sightings:
        own = last.setdefault((r.site, r.sku), {})
        for c in ("name", "price", "product_url", "category_path"):
            own[c] = r[c] or own.get(c, "")
    assert {(p.site, p.product_key): {c: p[c] for c in ("name", "price", "product_url", "category_path")} for p in catalog.products.collect()} == last
    codes = {(r.site, r.code) for r in catalog.warnings.collect()}
    assert {("three.test", "no_categories_detected"), ("two.test", "page_not_found"), ("three.test", "missing_price")} <= codes
    # another run over the same folder reads what is there: no page is needed any more
    again = C.build_catalog(shops.where(F.raise_error(F.lit("pages read again")).isNull()), root=root, max_categories=most, max_subcategories=sub, max_pages=pages, products_per_category=per)
    assert sorted(again.products.collect(), key=str) == sorted(catalog.products.collect(), key=str)


def test_listing_chain_of_cycles_and_long_chains(spark):
    nexts = {f"a{i}": f"a{i + 1}" for i in range(37)} | {"a37": "", "b": "c", "c": "d", "d": "c", "e": "e", "g": "gone"}
    pages = spark.createDataFrame(list(nexts.items()), "page_url string, next_url string")
    starts = spark.createDataFrame([(u,) for u in ("a0", "a35", "b", "e", "g", "gone")], "url string")
    for most in (None, 1, 2, 3, 9):
        want = set()
        for start in ("a0", "a35", "b", "e", "g"):
            at, seen = start, []
            while at in nexts and at not in seen and (most is None or len(seen) < most):
                seen.append(at)
                at = nexts[at]
            want |= {(start, p, d) for d, p in enumerate(seen, 1)}
        assert {tuple(r) for r in C.listing_chain(starts, pages, most).select("url", "page_url", "depth").collect()} == want


def test_name_matches_like_a_scan(spark):
    rnd = random.Random(12)
    words = ["Zapatos", "Éclair", "sale", "ab", "Größe", "x", "Ñandú", "bags", "a b"]
    cats = [(f"s{rnd.randrange(3)}", n, " ".join(rnd.choices(words, k=rnd.randrange(1, 4)))) for n in range(60)]
    asked = [(f"s{rnd.randrange(4)}", n, v) for n, v in enumerate(["ZAPA", "ec", "e", "ale", "", "  ", "nandu  BAGS", "zzz", "A", "b s", "tos sale", "ø", "apatos"] * 3)]
    fold = {r.v: r.f for r in spark.createDataFrame([(v,) for v in {c[2] for c in cats} | {a[2] for a in asked}], "v string").select("v", fold_text("v").alias("f")).collect()}
    want = {}
    for site, req, value in asked:
        hits = [n for s, n, name in cats if s == site and fold[value] and fold[value] in fold[name]]
        if hits:
            want[site, req] = min(hits)
    categories = spark.createDataFrame([(s, n, name, f"u{n}", [name]) for s, n, name in cats], "site string, rank int, name string, url string, path array<string>")
    got = C.name_matches(categories, spark.createDataFrame(asked, "site string, req_no int, value string")).collect()
    assert {(r.site, r.req_no): r["rank"] for r in got} == want


def test_rules_of_one_site_change_that_site_only(spark):
    body = ('<div class="side"><a href="/x/1">Lamps</a></div><nav><a href="/c/2">Chairs</a><a href="/c/hidden">Hidden</a></nav>'
            '<a class="more" href="/more">m</a><p class="title">Lamp <b>one</b></p><h1>Heading</h1>')
    pages = spark.createDataFrame([page_row(1, "a", "/", body), page_row(2, "b", "/", body)], "page_id long, site string, seq long, url string, html string")
    rules = spark.createDataFrame([("a.test", [".side a", "a:hover"], ["/x/"], [], [".more"], ["p.title"], None), ("c.test", None, None, None, None, None, None)],
                                  "site string, category_selectors array<string>, include_patterns array<string>, exclude_patterns array<string>, pagination_selectors array<string>, name_selectors array<string>, price_selectors array<string>")
    got = {r.site: ([c.url for c in r.categories], r.next_url, r["name"]) for r in page_facts(pages, rules).collect()}
    assert got == {"a.test": (["https://a.test/x/1"], "https://a.test/more", "Lamp one"),
                   "b.test": (["https://b.test/c/2", "https://b.test/c/hidden"], "", "Heading")}


def test_facts_make_the_columns_that_are_asked_for(spark):
    """Queries of links alone do not extract product fields; a link that is in several kinds
    stands in each, in the order of its selectors."""
    body = ('<div class="menu"><a href="/c/b?utm_x=1">Bags sale</a><a href="/c/a">Line sale</a><a href="/c/b">Bags sale</a></div><a href="/p/9">Nine</a>'
            '<div class="product-card"><a href="/q/1#x">One</a><a href="https://s.test/p/2">Two</a></div><a href="https://else.test/p/3">x</a><a rel="next" href="?page=2">n</a>')
    facts = page_facts(spark.createDataFrame([page_row(1, "s", "/c/x", body)], "page_id long, site string, seq long, url string, html string"))
    plan = facts.select("categories", "products", "next_url")._jdf.queryExecution().optimizedPlan().toString()
    assert "variant" not in plan.lower() and "canonical" not in plan
    row = facts.first()
    assert [(c.url, c.text, c.score) for c in row.categories] == [("https://s.test/c/b", "Bags sale", 8), ("https://s.test/c/a", "Line sale", 8)]
    assert [(p.url, p.by_card) for p in row.products] == [("https://s.test/p/9", False), ("https://s.test/p/2", False), ("https://s.test/q/1", True)]
    assert row.next_url == "https://s.test/c/x?page=2"


def test_pages_in_parts_have_the_facts_of_whole_ones(spark, shops, tmp_path, monkeypatch):
    """Links of one page stand in several rows until they are put in order; a page that comes
    twice stays two pages."""
    monkeypatch.setattr(SF, "RUN", 2)
    monkeypatch.setattr(SF, "MOST_RUNS", 2)
    cards = "".join(f'<li class="product-item"><a href="/{"pq"[i % 2]}/{i % 17}">Item {i}</a></li>' for i in range(40))
    whole = [page_row(1, "s", "/", f'<title>All</title><nav><a href="/c/a">Line sale</a></nav><ul>{cards}</ul><a rel="next" href="?page=2">n</a>'), page_row(2, "s", "/c/a", cards * 2)]
    pages = shops.unionByName(spark.createDataFrame([*whole, whole[0]], shops.schema)).coalesce(3)
    SF.page_parts(pages).write.parquet(f"{tmp_path}/parts")
    parts = spark.read.parquet(f"{tmp_path}/parts")
    assert parts.where("page_id < 3 and site = 's.test'").agg(F.max("parts")).first()[0] > 5 and parts.agg(F.max(F.size("links"))).first()[0] <= 8
    want = page_facts(pages)
    got = SF.whole_pages(parts).select(*want.columns)
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
