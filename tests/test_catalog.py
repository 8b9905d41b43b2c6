from pyspark.sql import functions as F

from shelfspark.operators import categories as C
from shelfspark.operators import extract as E
from shelfspark.operators import products as PR
from shelfspark.operators import quality as Q
from shelfspark.sources import tables as TB

RAW = ("seq long, site string, product_id string, sku string, name string, description string, brand string, "
       "price string, currency string, product_url string, category_path string, category_trail array<string>, "
       "all_category_paths array<string>, image_urls array<string>, source_site string, source_type string, "
       "source_confidence double")
A, B, D = "https://img.example/a.png", "https://img.example/b.png", "https://img.example/d.png"


def raw(spark, *rows):
    """Sightings from (seq, id, changed fields)."""
    names = [f.split()[0] for f in RAW.split(", ")]
    blank = dict.fromkeys(names, "") | {"site": "s", "category_trail": None, "all_category_paths": [], "image_urls": [], "source_confidence": 0.5}
    return spark.createDataFrame([tuple((blank | {"seq": seq, "product_id": pid} | more)[n] for n in names) for seq, pid, more in rows], RAW)


def test_canonical_product(spark):
    df = raw(spark, (4, " spade-1 ", {
        "name": " Border  Spade ", "product_url": "https://garden.example/p/spade-1?utm_campaign=x", "category_path": "Tools > Spades",
        "all_category_paths": ["Tools > Spades", "Gifts", "Tools > Spades"], "image_urls": [B, A, B], "source_site": None, "source_confidence": None}))
    p = PR.canonical_product(df).collect()[0]
    assert (p.product_id, p.name, p.source_confidence) == ("spade-1", "Border Spade", 0.0)
    assert p.product_url == "https://garden.example/p/spade-1" and p.source_site == "https://garden.example"
    assert p.category_trail == ["Tools", "Spades"] and p.all_category_paths == ["Tools > Spades", "Gifts"]
    assert p.image_urls == [B, A]


EX = ("page_id long, url string, category string, name string, description string, sku string, brand string, "
      "price string, currency string, images array<string>, breadcrumb array<string>, body_text string, "
      "title string, canonical_url string, has_jsonld boolean")


def test_normalize_extraction(spark):
    rows = [(1, "https://garden.example/p/hoe", "Soil", "  Dutch Hoe ", "<ul><li>Ash handle</li></ul>", "HOE-77", " Greenway",
             "24,90 EUR", "EUR", ["/media/hoe.png"], ["Home", "Tools", "Hoes"], "", "Hoe", "", True),
            (2, "https://garden.example/quick?pid=HOE_9", "Soil", "", "", "", "", "", "", [], [], "", "Hoe nine", "", False)]
    a, b = sorted(E.normalize_extraction(spark.createDataFrame(rows, EX), "USD").collect(), key=lambda r: r.page_id)
    assert (a.name, a.description, a.brand, a.price, a.currency) == ("Dutch Hoe", "Ash handle", "Greenway", "24.90", "EUR")
    assert (a.category_path, a.source_type, a.source_confidence) == ("Tools > Hoes", "jsonld+dom", 0.8)
    assert a.image_urls == ["https://garden.example/media/hoe.png"]
    # nothing but the URL and the title: SKU from the query, name from the title, category of the listing
    assert (b.sku, b.product_id, b.name, b.category_path, b.currency) == ("HOE_9", "hoe-9", "Hoe nine", "Soil", "USD")


def test_jsonld_texts_zero_and_false_are_values(spark):
    def page(n, product):
        return (n, f"https://garden.example/p/{n}", "c", f'<html><script type="application/ld+json">{product}</script><h1>Shown</h1></html>')

    rows = [page(1, '{"@type":"Product","name":"0","sku":"false","offers":{"price":"0","lowPrice":"5"}}'),
            page(2, '{"@type":"Product","name":false,"sku":"k","offers":{"price":0,"lowPrice":"5"}}'),
            page(3, '{"@type":"Product","name":"","sku":null,"mpn":"m","offers":{"price":0.0,"lowPrice":7}}')]
    got = E.extraction(spark.createDataFrame(rows, "page_id long, url string, category string, html string"))
    assert [tuple(r) for r in got.orderBy("page_id").select("name", "sku", "price").collect()] == [
        ("0", "false", "0"), ("Shown", "k", "5"), ("Shown", "m", "7")]


def test_merge_and_tree(spark):
    prods = PR.canonical_product(raw(
        spark, (1, "fork", {"name": "Fork", "category_path": "Tools > Forks", "all_category_paths": ["Tools > Forks"], "image_urls": [D]}),
        (2, "fork", {"description": "Four tines", "category_path": "Gifts", "all_category_paths": ["Gifts"], "image_urls": [A, D]})))
    merged = PR.merge_products(prods)
    m, = merged.collect()
    assert (m.name, m.description) == ("Fork", "Four tines")
    assert m.image_urls == [D, A] and m.all_category_paths == ["Tools > Forks", "Gifts"]
    tree = {r.full_path: (r.id, r.parent_id, r.depth) for r in C.category_tree(merged).collect()}
    assert tree == {"Tools": ("tools", "", 1), "Tools > Forks": ("tools-forks", "tools", 2), "Gifts": ("gifts", "", 1)}


def test_merge_is_order_insensitive(spark):
    prods = PR.canonical_product(raw(
        spark, (3, "k", {"name": "C", "category_path": "A > B", "all_category_paths": ["A > B"], "image_urls": [D]}),
        (1, "k", {"name": "A", "image_urls": [A]}), (2, "k", {"category_path": "C", "all_category_paths": ["C"], "image_urls": [B]})))
    once = PR.merge_products(prods).collect()[0]
    parts = PR.combine_partial(PR.partial_merge(prods.where("seq >= 2")).unionByName(
        PR.partial_merge(prods.where("seq < 2"))))
    assert PR.finish_merge(parts).collect()[0] == once
    assert once.name == "C" and once.image_urls[0] == A


def test_assignments_of_products_with_equal_ids_stay_apart(spark):
    df = spark.createDataFrame([("s", "a-1", 1, "X > Y", ["X > Y"]), ("s", "a-1", 2, "", ["Z"])],
                               "site string, product_id string, first_seq long, category_path string, all_category_paths array<string>")
    got = C.category_assignments(df, carry=("first_seq",)).orderBy("first_seq", "ord").collect()
    assert [(r.first_seq, r.category_id, r.primary) for r in got] == [
        (1, "all", False), (1, "x-y", True), (1, "x", False), (2, "all", False), (2, "z", True)]


def test_profile_join_has_one_row_a_site(spark):
    sites = spark.createDataFrame([("www.x.example",), ("x.example",), ("y.example",)], "site string")
    profiles = spark.createDataFrame([("x.example", "x.example", "b"), ("x.example", "www.x.example", "a")], "domain string, site string, platform_hint string")
    got = sorted((r.site, r.platform_hint) for r in TB.site_profile_join(sites, profiles).collect())
    assert got == [("www.x.example", "a"), ("x.example", "a"), ("y.example", None)]


def test_validate_catalog(spark):
    full = {"name": "N", "price": "3.00", "product_url": "https://garden.example/p/n", "category_path": "T", "image_urls": [A]}
    rows = [(1, "full", full), (2, "no-price", full | {"price": ""}), (3, "no-image", full | {"image_urls": []}), (4, "no-name", full | {"name": ""})]
    prods = PR.canonical_product(raw(spark, *rows)).withColumn("product_key", F.col("product_id"))
    s = Q.catalog_summary(prods).collect()[0]
    assert (s.product_count, s.products_with_errors, s.valid_products) == (4, 1, 3)
    assert (s.price_coverage, s.image_coverage, s.category_coverage) == (0.75, 0.75, 1.0)
    issues = Q.product_issues(prods).where("product_key = 'no-name'").orderBy("rule_no").collect()
    assert (issues[0].field, issues[0].level) == ("name", "error")
