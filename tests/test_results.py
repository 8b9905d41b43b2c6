"""Passes merged one by one against one merge over everything."""

import random

from pyspark.sql import functions as F

from shelfspark.operators import products as PR
from shelfspark.operators import quality as QY
from shelfspark.operators import results as RS


def test_three_passes_like_one(spark):
    rnd = random.Random(21)
    raw = [(f"https://s{rnd.randrange(3)}.test", n, f"P{rnd.randrange(25)}" if rnd.random() < 0.9 else "", rnd.choice(["", "Name", "Other"]), rnd.choice(["", "1.50", "2.00"]),
            rnd.choice([[], ["https://i.test/1.jpg"]]), rnd.choice(["", "A > B", "C"])) for n in range(300)]
    rows = spark.createDataFrame(raw, "site string, seq long, sku string, name string, price string, image_urls array<string>, category_path string")
    blank = [F.lit("").alias(c) for c in ("description", "brand", "currency", "product_url", "source_type")]
    sightings = PR.canonical_product(rows.select("*", F.lower("sku").alias("product_id"), *blank, F.lit(None).cast("array<string>").alias("category_trail"),
                                                 F.lit(None).cast("array<string>").alias("all_category_paths"), F.col("site").alias("source_site"), F.lit(0.5).alias("source_confidence")))
    cats = spark.createDataFrame([("s", 0, "One", "u1", ["One"], 3), ("s", 1, "", "u1", [], 9), ("s", 2, "Uno", "u1", [], 1), ("t", 1, "One", "u1", ["x"], None),
                                  ("s", 2, "No url", "", ["a", "b"], 0), ("s", 0, "", None, None, 5)], "site string, seq int, name string, url string, path array<string>, links_discovered int")
    so_far = None
    for i in range(3):
        told = spark.createDataFrame([("s", "code", "same"), ("s", "code", f"pass {i}")], "site string, code string, subject string")
        so_far = RS.merge_pass(so_far, sightings.where(F.col("seq").between(i * 100, i * 100 + 99)), cats.where(F.col("seq") == i), told)
    whole = PR.merge_products(PR.drop_unidentified(sightings))
    row = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert row(so_far.products) == row(whole)
    assert row(so_far.summary) == row(QY.catalog_summary(whole))
    assert sorted(tuple(r) for r in so_far.categories.collect()) == [
        ("s", "a > b", "No url", "", ["a", "b"], 0), ("s", "u1", "Uno", "u1", ["One"], 9), ("t", "u1", "One", "u1", ["x"], 0)]
    told = {(r.site, r.code, r.subject) for r in so_far.warnings.collect()}
    assert {("s", "code", "same"), *[("s", "code", f"pass {i}") for i in range(3)]} <= told
