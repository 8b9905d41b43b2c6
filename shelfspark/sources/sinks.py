"""Sinks: flat CSV, commerce CSV, commerce XML documents, JSON summaries.

Documents are written per site (``partitionBy("site")``).  XML documents are
ordered fragment rows -- ``(site, section, k1, k2, line)`` -- range
partitioned and sorted, so each site folder holds part files whose name order
is document order; no document is ever assembled on the driver or in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.text import xml_escape
from shelfspark.operators import categories as C
from shelfspark.operators import exports as X
from shelfspark.operators.ordering import positions, stored

# CSV writer options matching the reference quoting (quote only
# when needed, quotes doubled, empty strings unquoted).
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "emptyValue": "", "nullValue": "",
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "encoding": "UTF-8"}
CATALOG_NS = "http://www.demandware.com/xml/impex/catalog/2006-10-31"
PRICEBOOK_NS = "http://www.demandware.com/xml/impex/pricebook/2006-10-31"
INVENTORY_NS = "http://www.demandware.com/xml/impex/inventory/2007-05-31"
XML_DECL = '<?xml version="1.0" encoding="UTF-8"?>'


def _csv(df: DataFrame, path: str) -> None:
    writer = df.write.mode("overwrite").partitionBy("site")
    for k, v in CSV_OPTIONS.items():
        writer = writer.option(k, v)
    writer.csv(path)


def write_generic_csv(products: DataFrame, path: str) -> None:
    _csv(X.generic_csv_rows(products), path)


def write_b2b_csv(products: DataFrame, path: str) -> None:
    _csv(X.b2b_csv_rows(products), path)


def _write_document(fragments: DataFrame, path: str) -> None:
    """``fragments(site, section, k1, k2, line)`` -> ordered text per site; how many
    parts there are follows the amount of text."""
    order = ["site", "section", "k1", "k2"]
    ordered = fragments.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.select("site", "line").write.mode("overwrite").partitionBy("site").text(path)


def document_lines(spark, path: str) -> DataFrame:
    """``(site, position, line)`` of the documents below `path`, read back in order:
    by file name, place of the split, and row."""
    rows = spark.read.text(path).select(
        "site", F.col("value").alias("line"), F.col("_metadata.file_name").alias("__file"),
        F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__row"))
    return positions(stored(rows, "document-lines"), ["site"], ["__file", "__block", "__row"]).select("site", "position", "line")


def document_digests(lines: DataFrame) -> DataFrame:
    """``(site, lines, digest)``: a sum over the lines of a hash of place and text, which
    any number of tasks add up and which changes when two lines change places."""
    hashed = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("position").cast("string"), "line")), 1, 10), 16, 10).cast("bigint")
    return lines.groupBy("site").agg(F.count("*").alias("lines"), F.sum(hashed).alias("digest"))


def _frag(df: DataFrame, section: int, k1, k2, line) -> DataFrame:
    return df.select("site", F.lit(section).alias("section"), k1.cast("string").alias("k1"),
                     k2.cast("string").alias("k2"), line.alias("line"))


def catalog_fragments(products: DataFrame) -> DataFrame:
    brand = X.catalog_brand(products)
    images = X.shared_image_dir(products)
    head = brand.join(images, "site", "left")
    header = F.when(F.col("https_url").isNull(), F.lit("<header />")).otherwise(F.concat(
        F.lit("<header><image-settings><external-location><http-url>"), xml_escape("http_url"),
        F.lit("</http-url><https-url>"), xml_escape("https_url"),
        F.lit("</https-url></external-location><view-types><view-type>hi-res</view-type><view-type>large</view-type>"
              "<view-type>medium</view-type><view-type>small</view-type></view-types>"
              "<alt-pattern>${productname}</alt-pattern><title-pattern>${productname}</title-pattern>"
              "</image-settings></header>")))
    opening = F.concat(F.lit(XML_DECL + f'\n<catalog xmlns="{CATALOG_NS}" catalog-id="'),
                       xml_escape("catalog_id"), F.lit('">'))
    nodes = C.catalog_categories(products)
    cats = X.category_xml(nodes)
    prods = X.product_xml(products)
    asg = X.assignment_xml(C.category_assignments(products, carry=("first_seq",)))
    return (_frag(head, 0, F.lit(""), F.lit(""), F.concat(opening, F.lit("\n"), header))
            .unionByName(_frag(cats, 1, F.lpad(F.col("depth").cast("string"), 4, "0"), F.col("id"), F.col("xml")))
            .unionByName(_frag(prods, 2, F.lpad(F.col("first_seq").cast("string"), 20, "0"), F.lit(""), F.col("xml")))
            .unionByName(_frag(asg, 3, F.lpad(F.col("first_seq").cast("string"), 20, "0"),
                               F.lpad(F.col("ord").cast("string"), 6, "0"), F.col("xml")))
            .unionByName(_frag(head, 9, F.lit(""), F.lit(""), F.lit("</catalog>"))))


def pricebook_fragments(products: DataFrame, lang: str = "x-default") -> DataFrame:
    """A book for each currency of a site's products, in order of first sight and also
    where no product of it has a price, then the mirror book where USD is none of
    them; entries in order of the products."""
    brand = X.catalog_brand(products)
    currency = X.effective_currency().alias("currency")
    first = products.select("site", currency, "first_seq").groupBy("site", "currency").agg(F.min("first_seq").alias("first"))
    mirror = X.catalog_currencies(products).where("mirrored").select("site", "currency", F.lit(None).cast("bigint").alias("first"))
    place = F.coalesce(F.lpad(F.col("first").cast("string"), 20, "0"), F.lit("9" * 20))
    books = first.unionByName(mirror).withColumn("k1", place).join(brand.select("site", "pricebook_id", "pricebook_name"), "site")
    book_open = F.concat(
        F.lit('<pricebook><header pricebook-id="'), xml_escape(F.concat("pricebook_id", F.lit("-"), F.lower("currency"))), F.lit('"><currency>'),
        xml_escape("currency"), F.lit(f'</currency><display-name xml:lang="{lang}">'),
        xml_escape(F.concat(F.col("pricebook_name"), F.lit(" "), F.col("currency"))),
        F.lit(f'</display-name><description xml:lang="{lang}">'), xml_escape(F.concat(F.lit("Pricebook generado desde "), F.col("site"))),
        F.lit("</description><online-flag>true</online-flag><feed-based>false</feed-based></header>"
              "<price-tables>"))
    priced = products.where("price <> ''").select("site", currency, "product_id", "price", "first_seq")
    entries = priced.where(F.col("currency") != X.MIRROR_CURRENCY).unionByName(priced.withColumn("currency", F.lit(X.MIRROR_CURRENCY)))
    listed = entries.join(books.select("site", "currency", "k1"), ["site", "currency"])
    rows = F.concat(F.lit('<price-table product-id="'), xml_escape("product_id"),
                    F.lit('"><amount quantity="1">'), xml_escape("price"), F.lit("</amount></price-table>"))
    sites = brand.select("site")
    return (_frag(sites, 0, F.lit(""), F.lit(""), F.lit(XML_DECL + f'\n<pricebooks xmlns="{PRICEBOOK_NS}">'))
            .unionByName(_frag(books, 1, F.col("k1"), F.lit("0"), book_open))
            .unionByName(_frag(listed, 1, F.col("k1"), F.concat(F.lit("1"), F.lpad(F.col("first_seq").cast("string"), 20, "0")), rows))
            .unionByName(_frag(books, 1, F.col("k1"), F.lit("2"), F.lit("</price-tables></pricebook>")))
            .unionByName(_frag(sites, 9, F.lit(""), F.lit(""), F.lit("</pricebooks>"))))


def inventory_fragments(products: DataFrame) -> DataFrame:
    brand = X.catalog_brand(products)
    opening = F.concat(F.lit(XML_DECL + f'\n<inventory xmlns="{INVENTORY_NS}"><inventory-list><header list-id="'),
                       xml_escape("inventory_list_id"),
                       F.lit('"><default-instock>true</default-instock><description>'),
                       xml_escape(F.concat(F.lit("Inventario perpetuo generado para "), F.col("brand_name"))),
                       F.lit("</description><use-bundle-inventory-only>false</use-bundle-inventory-only>"
                             "<on-order>false</on-order></header><records>"))
    rec = F.concat(F.lit('<record product-id="'), xml_escape("product_id"),
                   F.lit('"><perpetual>true</perpetual></record>'))
    return (_frag(brand, 0, F.lit(""), F.lit(""), opening)
            .unionByName(_frag(products, 1, F.lpad(F.col("first_seq").cast("string"), 20, "0"), F.lit(""), rec))
            .unionByName(_frag(brand, 9, F.lit(""), F.lit(""),
                               F.lit("</records></inventory-list></inventory>"))))


def write_b2c(products: DataFrame, path: str) -> dict[str, str]:
    """Catalog, pricebooks and inventory documents per site."""
    out = {"catalog": f"{path}/catalog", "pricebooks": f"{path}/pricebooks", "inventory": f"{path}/inventory"}
    _write_document(catalog_fragments(products), out["catalog"])
    _write_document(pricebook_fragments(products), out["pricebooks"])
    _write_document(inventory_fragments(products), out["inventory"])
    return out


def read_csv(spark, path: str, columns) -> DataFrame:
    """Read a per-site CSV export back (every value a string, '' kept)."""
    from pyspark.sql.types import StringType, StructField, StructType
    schema = StructType([StructField(c, StringType()) for c in columns] + [StructField("site", StringType())])
    # empty fields are written unquoted (as the reference does) and come back
    # as NULL; they were '' when written
    df = spark.read.option("header", "true").option("escape", '"').schema(schema).csv(path)
    return df.fillna("", [c for c in columns])


def write_run_summary(summary: DataFrame, path: str) -> None:
    summary.write.mode("overwrite").json(path)


def write_site_profiles(profiles: DataFrame, path: str) -> None:
    profiles.write.mode("overwrite").partitionBy("domain").json(path)


FORMATS = ("generic", "b2c", "b2b")


def export_all(products: DataFrame, path: str, formats=FORMATS) -> dict[str, str]:
    """Materialise the merged catalog once, then one write per requested
    format; the preview cards are always written.

    The catalog is checkpointed (reliable, into ``spark.checkpoint.dir``):
    every export reads the written table, so losing an executor during the
    exports never re-runs the extraction and merge lineage."""
    from shelfspark.session import checkpoint_dir
    checkpoint_dir(products.sparkSession)
    products = products.checkpoint(eager=True)
    out: dict[str, str] = {}
    if "generic" in formats:
        out["generic"] = f"{path}/generic-csv"
        write_generic_csv(products, out["generic"])
    if "b2b" in formats:
        out["b2b"] = f"{path}/commerce-csv"
        write_b2b_csv(products, out["b2b"])
    if "b2c" in formats:
        out.update(write_b2c(products, f"{path}/b2c"))
    out["cards"] = f"{path}/cards"
    X.catalog_cards(products).write.mode("overwrite").partitionBy("site").parquet(out["cards"])
    return out
