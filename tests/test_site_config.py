"""Config files and the levels of settings."""

import json

from shelfspark.sources import site_config as SC


def test_config_files(spark, tmp_path):
    assert SC.read_site_configs(spark, str(tmp_path / "none")).collect() == []
    files = {"a/one.json": {"name": "one", "entryUrl": "https://Shop.test/es", "currency": "EUR", "categoryDiscovery": {"selectors": ["nav a"], "excludePatterns": []},
                            "productExtraction": {"price": [".p", ".q"]}, "maxCategories": 7, "unknown": 1},
             "b.json": {"name": "two", "entryUrl": "https://shop.test/"}, "c.json": {"name": "three"}, "d.json": {"entryUrl": "https://other.test"}}
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(json.dumps(content, indent=2))
    got = {r.site: r for r in SC.read_site_configs(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["other.test", "shop.test"]
    one = got["shop.test"]
    assert (one.name, one.currency, one.category_selectors, one.exclude_patterns, one.price_selectors, one.max_categories) == ("one", "EUR", ["nav a"], [], [".p", ".q"], 7)
    assert one.include_patterns is None and one.product_selectors is None and got["other.test"].name is None


def test_levels(spark):
    sites = spark.createDataFrame([("a",), ("b",), ("a",)], "site string")
    explicit = spark.createDataFrame([("a", "", "JPY", []), ("x", "https://x/", "XXX", ["n"])], "site string, entry_url string, currency string, category_names array<string>")
    config = spark.createDataFrame([("a", "https://a/", "CHF", ["Shoes", ""], [], 9)],
                                   "site string, entry_url string, currency string, category_names array<string>, exclude_patterns array<string>, max_pages int")
    profile = spark.createDataFrame([("a", ["p"], ["q"]), ("b", None, ["r"])], "site string, exclude_patterns array<string>, include_patterns array<string>")
    got = {(r.site, r.key): (r.value, r.source) for r in SC.resolve(sites, explicit, config, profile).collect()}
    assert {s for s, _ in got} == {"a", "b"}
    assert got["a", "entry_url"] == (["https://a/"], "config") and ("b", "entry_url") not in got
    assert got["a", "currency"] == (["JPY"], "explicit") and got["b", "currency"] == (["USD"], "default")
    assert got["a", "category_names"] == (["Shoes", ""], "config") and got["b", "category_names"] == ([], "default")
    assert got["a", "exclude_patterns"] == ([], "config") and got["b", "exclude_patterns"][1] == "default"
    assert got["a", "include_patterns"] == (["q"], "profile") and got["b", "include_patterns"] == (["r"], "profile")
    assert got["a", "max_pages"] == (["9"], "config")
    rules = {r.site: r for r in SC.site_rules(SC.resolve(sites, explicit, config, profile)).collect()}
    assert (rules["a"].exclude_patterns, rules["a"].include_patterns, rules["a"].category_selectors) == ([], ["q"], None)
    assert rules["b"].include_patterns == ["r"] and rules["b"].exclude_patterns is None
