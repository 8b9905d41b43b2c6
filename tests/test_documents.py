"""Pricebooks by hand, and digests that see the order of lines."""

import re

from shelfspark.operators import products as PR
from shelfspark.sources import sinks as K
from shelfspark.streaming.merge import fresh_root
from pyspark.sql import functions as F


def catalog(spark, rows):
    raw = spark.createDataFrame(rows, "site string, seq long, sku string, price string, currency string")
    blank = [F.lit("").alias(c) for c in ("description", "product_url", "category_path", "source_type")]
    none = F.lit(None).cast("array<string>")
    sightings = PR.canonical_product(raw.select("*", F.col("sku").alias("product_id"), F.col("sku").alias("name"), F.lit("Acme").alias("brand"), *blank,
                                                none.alias("category_trail"), none.alias("all_category_paths"), none.alias("image_urls"),
                                                F.col("site").alias("source_site"), F.lit(1.0).alias("source_confidence")))
    return PR.merge_products(sightings)


def written(spark, fragments):
    path = fresh_root(spark, "documents")
    K._write_document(fragments, path)
    return K.document_lines(spark, path)


def test_books_of_all_currencies_in_order(spark):
    products = catalog(spark, [("https://a.test", 5, "p1", "2.00", "GBP"), ("https://a.test", 7, "p2", "", "CHF"), ("https://a.test", 2, "p3", "9.00", "GBP"),
                               ("https://a.test", 9, "p0", "1.00", "EUR"), ("https://b.test", 1, "q", "3.00", "USD"), ("https://b.test", 2, "r", "4.00", "EUR")])
    text = {}
    for r in sorted(written(spark, K.pricebook_fragments(products)).collect(), key=lambda r: r.position):
        text.setdefault(r.site, []).append(r.line)
    books = {}
    for site, lines in text.items():
        assert lines[0].startswith("<?xml") and lines[1].startswith("<pricebooks") and lines[-1] == "</pricebooks>"
        for line in lines[2:-1]:
            if found := re.search("<currency>(.*)</currency>", line):
                books.setdefault(site, []).append((found[1], []))
                assert f"Pricebook generado desde {site}</description>" in line
            elif found := re.search('product-id="(.*)"><amount quantity="1">(.*)</amount>', line):
                books[site][-1][1].append(found.groups())
            else:
                assert line == "</price-tables></pricebook>"
    assert books == {
        "https://a.test": [("GBP", [("p3", "9.00"), ("p1", "2.00")]), ("CHF", []), ("EUR", [("p0", "1.00")]), ("USD", [("p3", "9.00"), ("p1", "2.00"), ("p0", "1.00")])],
        "https://b.test": [("USD", [("q", "3.00"), ("r", "4.00")]), ("EUR", [("r", "4.00")])]}


def test_digest_changes_with_the_order_of_lines(spark):
    lines = spark.createDataFrame([("s", i, f"line {i}") for i in range(1, 9)], "site string, position long, line string")
    swapped = lines.withColumn("position", F.when(F.col("position") == 3, 4).when(F.col("position") == 4, 3).otherwise(F.col("position")))
    one, two = K.document_digests(lines).first(), K.document_digests(swapped).first()
    assert one.lines == two.lines == 8 and one.digest != two.digest
    assert K.document_digests(lines.repartition(5)).first().digest == one.digest
