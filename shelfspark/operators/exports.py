"""Export-side operators: brand context, pricebooks, image settings, image
groups, CSV row shapes, preview cards and XML fragments.

Everything is per site (one export per site) and computed with partial
aggregates or row-local projections; no export is built on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.text import fold_text, html_escape, shorten, slugify, xml_escape
from shelfspark.functions.urls import url_host, url_origin, url_path

# Export defaults (run defaults of the reference CLI).
DEFAULTS = {
    "currency": "USD",
    "lang": "x-default",
    "catalog_id": "demo-catalog",
    "pricebook_id": "demo-pricebook",
    "pricebook_name": "Demo Price Book",
    "inventory_list_id": "inventory-list",
}
MIRROR_CURRENCY = "USD"
IMAGE_SERVER_DIR = "/is/image/"
VIEW_TYPES = ("hi-res", "large")
GENERIC_CSV_COLUMNS = ("product_id", "name", "description", "sku", "price", "currency", "brand", "category",
                       "subcategory", "category_path", "all_category_paths", "product_url", "image_1",
                       "image_2", "image_3", "source_site")
B2B_CSV_COLUMNS = ("Product Name", "Product SKU", "Product Description", "Category Name Path",
                   "Price Book Name", "Price Book Entry Name", "List Price", "Currency ISO Code",
                   "Product Status", "Primary Image URL", "Secondary Image URL", "Tertiary Image URL",
                   "External ID", "Product URL")


def _s(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def brand_id(value, brand_slug) -> Column:
    """``slug(value)`` (``catalog`` if empty) prefixed with the brand slug
    unless it already contains it."""
    v = slugify(value)
    v = F.when(v == "", F.lit("catalog")).otherwise(v)
    b = _s(brand_slug)
    return F.when((b == "") | v.contains(b), v).otherwise(F.concat(b, F.lit("-"), v))


def brand_name(value, brand) -> Column:
    v, b = _s(value), _s(brand)
    return F.when((b == "") | fold_text(v).contains(fold_text(b)), v) \
        .otherwise(F.trim(F.concat(b, F.lit(" "), v)))


def catalog_brand(products: DataFrame) -> DataFrame:
    """Per site: first non-empty brand (by first sighting), its slug, and the
    brand-aware catalog / pricebook / inventory ids."""
    first = products.groupBy("site").agg(
        F.expr("min_by(brand, first_seq) FILTER (WHERE brand <> '')").alias("_b"))
    b = F.coalesce(F.col("_b"), F.lit("Brand"))
    out = first.select("site", b.alias("brand_name"))
    out = out.withColumn("brand_slug", F.when(slugify("brand_name") != "", slugify("brand_name"))
                         .otherwise(F.lit("brand")))
    return out.select(
        "site", "brand_name", "brand_slug",
        brand_id(F.lit(DEFAULTS["catalog_id"]), "brand_slug").alias("catalog_id"),
        brand_id(F.lit(DEFAULTS["pricebook_id"]), "brand_slug").alias("pricebook_id"),
        brand_id(F.lit(DEFAULTS["inventory_list_id"]), "brand_slug").alias("inventory_list_id"),
        brand_name(F.lit(DEFAULTS["pricebook_name"]), "brand_name").alias("pricebook_name"))


def effective_currency() -> Column:
    return F.when(F.col("currency") != "", F.col("currency")).otherwise(F.lit(DEFAULTS["currency"]))


def catalog_currencies(products: DataFrame) -> DataFrame:
    """``(site, currency, mirrored)``: distinct product currencies, plus the
    USD mirror when a site has no USD products."""
    orig = products.select("site", effective_currency().alias("currency")).where(F.col("currency") != "") \
        .distinct()
    have_usd = orig.groupBy("site").agg(F.bool_or(F.col("currency") == MIRROR_CURRENCY).alias("_u"))
    mirror = have_usd.where(~F.col("_u")).select("site", F.lit(MIRROR_CURRENCY).alias("currency"))
    return orig.withColumn("mirrored", F.lit(False)) \
        .unionByName(mirror.withColumn("mirrored", F.lit(True)))


def pricebook_entries(products: DataFrame, brand: DataFrame | None = None) -> DataFrame:
    """``(site, pricebook_id, currency, product_id, price)``.

    A product is listed in its own currency's book, and every priced product
    is also listed in the USD book (original or mirror), with the same
    number.  Both halves are projections of the product table -- no join of
    products with currencies is needed."""
    priced = products.where(F.col("price") != "").select(
        "site", "product_id", "price", effective_currency().alias("cur"))
    own = priced.where(F.col("cur") != MIRROR_CURRENCY).select("site", F.col("cur").alias("currency"),
                                                              "product_id", "price")
    usd = priced.select("site", F.lit(MIRROR_CURRENCY).alias("currency"), "product_id", "price")
    entries = own.unionByName(usd)
    brand = catalog_brand(products) if brand is None else brand
    return entries.join(brand.select("site", "pricebook_id"), "site").select(
        "site", F.concat(F.col("pricebook_id"), F.lit("-"), F.lower("currency")).alias("pricebook_id"),
        "currency", "product_id", "price")


def shared_image_dir(products: DataFrame) -> DataFrame:
    """Per site: ``(http_url, https_url)`` of the shared image directory.

    The first image (by first sighting, then position) picks the origin; the
    longest common prefix of a set of strings is the prefix common to its
    minimum and maximum, so two partial aggregates replace a fold."""
    imgs = products.select("site", "first_seq", F.posexplode("image_urls").alias("pos", "img"))
    first = imgs.groupBy("site").agg(F.min_by("img", F.struct("first_seq", "pos")).alias("first_img"))
    first = first.select("site", "first_img", url_origin("first_img").alias("origin"),
                         url_host("first_img").alias("host_port"))
    # min / max path per (site, origin) first -- a partial aggregate, so a
    # hot site never sends all its image rows to one task -- then keep the
    # first image's origin with a join of two per-site-sized tables
    spans = imgs.groupBy("site", url_origin("img").alias("origin")).agg(
        F.min(url_path("img")).alias("lo"), F.max(url_path("img")).alias("hi"))
    j = first.join(spans, ["site", "origin"], "left")
    lcp_len = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.least(F.length("lo"), F.length("hi")), F.lit(1))),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")),
        lambda acc, i: F.when(acc["go"] & (F.substring("lo", i, 1) == F.substring("hi", i, 1))
                              & (i <= F.least(F.length("lo"), F.length("hi"))),
                              F.struct(i.alias("n"), F.lit(True).alias("go")))
        .otherwise(F.struct(acc["n"].alias("n"), F.lit(False).alias("go"))))["n"]
    prefix = F.substring("lo", 1, lcp_len)
    last_slash = F.length(prefix) - F.coalesce(F.locate("/", F.reverse(prefix)), F.lit(0)) + 1
    last_slash = F.when(F.locate("/", prefix) == 0, F.lit(0)).otherwise(last_slash)
    common_dir = F.when(F.col("lo").isNull() | (last_slash <= 1), F.lit("/")) \
        .otherwise(F.substring(prefix, 1, last_slash))
    shared = F.when(url_path("first_img").contains(IMAGE_SERVER_DIR), F.lit(IMAGE_SERVER_DIR)) \
        .otherwise(F.when(common_dir.endswith("/"), common_dir).otherwise(F.concat(common_dir, F.lit("/"))))
    host = F.regexp_extract("first_img", r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)
    return j.select("site", F.concat(F.lit("http://"), F.lower(host), shared).alias("http_url"),
                    F.concat("origin", shared).alias("https_url"))


def image_path(col) -> Column:
    """Image path relative to the image server (``/is/image/`` aware), query kept."""
    u = F.coalesce(_s(col), F.lit(""))
    path = url_path(u)
    query = F.regexp_extract(u, r"^[^?#]*(\?[^#]*)?", 1)
    after = F.coalesce(F.try_element_at(F.split(path, IMAGE_SERVER_DIR), F.lit(2)), F.lit(""))
    rel = F.when(path.contains(IMAGE_SERVER_DIR), after).otherwise(F.regexp_replace(path, "^/+", ""))
    return F.concat(rel, query)


def image_groups(products: DataFrame) -> DataFrame:
    """``(site, product_id, view_type, pos, path)``: every image in every view."""
    views = F.array(*[F.lit(v) for v in VIEW_TYPES])
    imgs = products.select("site", "product_id", F.explode(views).alias("view_type"),
                           F.posexplode("image_urls").alias("pos", "img"))
    return imgs.select("site", "product_id", "view_type", (F.col("pos") + 1).cast("int").alias("pos"),
                       image_path("img").alias("path"))


def generic_csv_rows(products: DataFrame) -> DataFrame:
    img = [F.coalesce(F.try_element_at("image_urls", F.lit(i)), F.lit("")).alias(f"image_{i}") for i in (1, 2, 3)]
    return products.select(
        "site", "product_id", "name", "description", "sku", "price", "currency", "brand", "category",
        "subcategory", "category_path", F.array_join("all_category_paths", " | ").alias("all_category_paths"),
        "product_url", *img, "source_site")


def b2b_csv_rows(products: DataFrame, brand: DataFrame | None = None) -> DataFrame:
    img = [F.coalesce(F.try_element_at("image_urls", F.lit(i)), F.lit("")) for i in (1, 2, 3)]
    return products.select(
        "site",
        F.col("name").alias("Product Name"),
        F.when(F.col("sku") != "", F.col("sku")).otherwise(F.col("product_id")).alias("Product SKU"),
        F.col("description").alias("Product Description"),
        F.col("category_path").alias("Category Name Path"),
        F.lit(DEFAULTS["pricebook_name"]).alias("Price Book Name"),
        F.col("name").alias("Price Book Entry Name"),
        F.col("price").alias("List Price"),
        effective_currency().alias("Currency ISO Code"),
        F.lit("Active").alias("Product Status"),
        img[0].alias("Primary Image URL"), img[1].alias("Secondary Image URL"),
        img[2].alias("Tertiary Image URL"),
        F.col("product_id").alias("External ID"),
        F.col("product_url").alias("Product URL"))


def price_label() -> Column:
    return F.when(F.col("price") == "", F.lit("Sin precio")).otherwise(
        F.trim(F.concat(F.col("price"), F.lit(" "), F.col("currency"))))


def catalog_cards(products: DataFrame) -> DataFrame:
    """Preview card per product: lower-cased search text, price label,
    shortened description, up to three thumbnails."""
    search = F.lower(F.concat_ws(" ", *[F.when(F.col(c) != "", F.col(c)) for c in
                                        ("name", "sku", "description", "category_path", "brand")]))
    return products.select(
        "site", "product_id",
        search.alias("search"),
        F.col("category_path").alias("category"),
        F.when(F.col("name") != "", F.col("name")).otherwise(F.col("product_id")).alias("title"),
        price_label().alias("price_label"),
        F.when(F.col("sku") != "", F.col("sku")).otherwise(F.col("product_id")).alias("sku_chip"),
        F.when(F.col("category_path") != "", F.col("category_path")).otherwise(F.lit("Sin categoría"))
        .alias("category_chip"),
        F.when(F.col("brand") != "", F.col("brand")).otherwise(F.lit("Sin marca")).alias("brand_chip"),
        shorten(F.when(F.col("description") != "", F.col("description")).otherwise(F.lit("Sin descripción")))
        .alias("description"),
        F.slice("image_urls", 1, 3).alias("thumbs"),
        "product_url", "first_seq")


def search_cards(cards: DataFrame, query: str = "", category: str = "") -> DataFrame:
    """Cards whose search text contains the (trimmed, lower-cased) query and
    whose category equals the chosen one; empty filters match all."""
    q = query.strip().lower()
    cond = F.lit(True)
    if q:
        cond = cond & F.col("search").contains(q)
    if category:
        cond = cond & (F.col("category") == category)
    return cards.where(cond)


def catalog_stats(products: DataFrame, warnings: DataFrame | None = None) -> DataFrame:
    """Per site: products, distinct category paths, warnings."""
    s = products.groupBy("site").agg(F.count("*").alias("products"),
                                     F.count_distinct(F.when(F.col("category_path") != "",
                                                             F.col("category_path"))).alias("category_paths"))
    if warnings is not None:
        w = warnings.groupBy("site").agg(F.count("*").alias("warnings"))
        s = s.join(w, "site", "left").fillna(0, ["warnings"])
    return s


# ------------------------------------------------------------ XML fragments
def product_xml(products: DataFrame) -> DataFrame:
    """``(site, first_seq, xml)``: one ``<product>`` element per product."""
    name, desc = xml_escape("name"), xml_escape(F.when(F.col("description") != "", F.col("description"))
                                                .otherwise(F.col("name")))
    imgs = F.transform("image_urls", lambda u: F.concat(
        F.lit('<image path="'), xml_escape(image_path(u)), F.lit('"><alt xml:lang="x-default">'), name,
        F.lit('</alt><title xml:lang="x-default">'), name, F.lit("</title></image>")))
    groups = F.array_join(F.transform(F.array(*[F.lit(v) for v in VIEW_TYPES]), lambda v: F.concat(
        F.lit('<image-group view-type="'), v, F.lit('">'), F.array_join(imgs, ""), F.lit("</image-group>"))), "")
    images = F.when(F.size("image_urls") > 0, F.concat(F.lit("<images>"), groups, F.lit("</images>"))) \
        .otherwise(F.lit(""))
    brand = F.when(F.col("brand") != "", F.concat(F.lit("<brand>"), xml_escape("brand"), F.lit("</brand>"))) \
        .otherwise(F.lit(""))
    xml = F.concat(
        F.lit('<product product-id="'), xml_escape("product_id"), F.lit('">'),
        F.lit('<display-name xml:lang="x-default">'), name, F.lit("</display-name>"),
        F.lit('<short-description xml:lang="x-default">'), desc, F.lit("</short-description>"),
        F.lit('<long-description xml:lang="x-default">'), desc, F.lit("</long-description>"),
        F.lit("<online-flag>true</online-flag><available-flag>true</available-flag>"
              "<searchable-flag>true</searchable-flag>"),
        images, brand,
        F.lit("<page-attributes /><pinterest-enabled-flag>false</pinterest-enabled-flag>"
              "<facebook-enabled-flag>false</facebook-enabled-flag><store-attributes>"
              "<force-price-flag>false</force-price-flag><non-inventory-flag>false</non-inventory-flag>"
              "<non-revenue-flag>false</non-revenue-flag><non-discountable-flag>false</non-discountable-flag>"
              "</store-attributes></product>"))
    return products.select("site", "first_seq", xml.alias("xml"))


def category_xml(nodes: DataFrame) -> DataFrame:
    """``(site, depth, id, xml)`` for catalog category nodes."""
    parent = F.when(F.col("effective_parent") != "", F.concat(
        F.lit("<parent>"), xml_escape("effective_parent"), F.lit("</parent>"))).otherwise(F.lit(""))
    xml = F.concat(
        F.lit('<category category-id="'), xml_escape("id"), F.lit('">'),
        F.lit('<display-name xml:lang="x-default">'), xml_escape("name"), F.lit("</display-name>"),
        F.lit('<description xml:lang="x-default">'), xml_escape(F.array_join("path", " > ")),
        F.lit("</description><online-flag>true</online-flag>"), parent,
        F.lit('<template /><page-attributes /><custom-attributes><custom-attribute attribute-id="showInMenu">'
              "true</custom-attribute></custom-attributes></category>"))
    return nodes.select("site", "depth", "id", xml.alias("xml"))


def assignment_xml(assignments: DataFrame) -> DataFrame:
    xml = F.concat(F.lit('<category-assignment category-id="'), xml_escape("category_id"),
                   F.lit('" product-id="'), xml_escape("product_id"), F.lit('"><primary-flag>'),
                   F.when(F.col("primary"), F.lit("true")).otherwise(F.lit("false")),
                   F.lit("</primary-flag></category-assignment>"))
    return assignments.select("site", "first_seq", "product_id", "ord", xml.alias("xml"))


__all__ = ["html_escape"]
