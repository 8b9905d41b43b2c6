"""Inputs Spark derives from the driver's tables (FIXTURES.md part B).

* ``product_observations`` (F2): five sightings per part built from
  ``events`` x ``part``, with empty names, four price spellings, repeated
  and empty category paths and rotating images, plus ``site``,
  ``product_url``, ``brand`` and ``description`` columns.
* ``listing_links`` (F4): product links on four listing pages per part type.
* ``product_pages`` (F3): one HTML product page per part (JSON-LD variants).

Every derivation is a join/projection of the whole tables, so its size
grows with them; the same text is spelled in DuckDB SQL by the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.session import dealt
from shelfspark.sources.tables import read_table


def _lpad(col, n):
    return F.lpad(col.cast("string"), n, "0")


def product_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(seq, site, sku, name, price_text, category_path, image, product_url,
    brand, description, ts)`` -- one row per event."""
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_retailprice")
    events = dealt(read_table(spark, sf_dir, "events").select("event_id", "ts"))
    n = part.select(F.count("*").cast("bigint")).scalar()
    rounds = F.floor(F.col("event_id") / n).cast("bigint")
    b = events.select(
        F.col("event_id").alias("seq"), "ts",
        (F.col("event_id") + rounds).alias("v"),
        ((F.col("event_id") * 7) % n).alias("pk"),
        rounds.alias("rounds"),
    ).join(part, F.col("pk") == F.col("p_partkey"))
    c = 3 * F.round(F.col("p_retailprice") * 100).cast("bigint") + 100 * F.col("rounds")
    g = b.select("*", F.floor(c / 100).cast("bigint").alias("i"), _lpad(c % 100, 2).alias("d"))
    gi = F.when(F.col("i") >= 1000, F.concat(F.floor(F.col("i") / 1000).cast("bigint").cast("string"),
                                             F.lit("#"), _lpad(F.col("i") % 1000, 3))) \
        .otherwise(F.col("i").cast("string"))
    h = g.select("*", gi.alias("gi"))
    v, pk = F.col("v"), F.col("pk")
    price = (F.when(v % 6 == 0, F.concat(F.replace("gi", F.lit("#"), F.lit(".")), F.lit(","), "d", F.lit(" EUR")))
             .when(v % 6 == 1, F.concat(F.lit("$"), F.replace("gi", F.lit("#"), F.lit(",")), F.lit("."), "d"))
             .when(v % 6 == 2, F.concat(F.col("i").cast("string"), F.lit("."), "d"))
             .when(v % 6 == 3, F.replace("gi", F.lit("#"), F.lit(",")))
             .when(v % 6 == 4, F.lit("on request"))
             .otherwise(F.lit("")))
    site = F.concat(F.lit("https://"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))), F.lit(".example.com"))
    return h.select(
        "seq",
        site.alias("site"),
        F.concat(F.lit("SKU-"), pk.cast("string")).alias("sku"),
        F.when((pk % 25 == 24) | (v % 7 == 0), F.lit("")).otherwise(F.col("p_name")).alias("name"),
        F.when(pk % 10 == 9, F.lit("")).otherwise(price).alias("price_text"),
        F.when(F.col("seq") % 3 == 0, F.concat("p_type", F.lit(" > "), "p_brand"))
        .when(F.col("seq") % 3 == 1, F.concat(F.lit("Sale > "), "p_type")).otherwise(F.lit(""))
        .alias("category_path"),
        F.when(v % 5 == 4, F.lit("")).otherwise(F.concat(
            F.lit("https://cdn.example.com/is/image/"), pk.cast("string"), F.lit("-"),
            (v % 5).cast("string"), F.lit(".jpg"))).alias("image"),
        F.when(pk % 20 == 19, F.lit("")).otherwise(F.concat(
            site, F.lit("/p/"), pk.cast("string"), F.lit("?utm_source=feed#top"))).alias("product_url"),
        F.when(pk % 11 == 10, F.lit("")).otherwise(F.col("p_brand")).alias("brand"),
        F.concat(F.col("p_name"), F.lit(" "), F.col("p_type")).alias("description"),
        "ts",
    )


# Oracle text of the same fixture (DuckDB).
PRODUCT_OBSERVATIONS_SQL = """
obs AS (
  WITH n AS (SELECT count(*) AS n FROM part),
  b AS (SELECT e.event_id AS seq, e.ts, e.event_id + CAST(floor(e.event_id / n.n) AS BIGINT) AS v,
               p.p_partkey AS pk, p.p_name, p.p_brand, p.p_type,
               3 * CAST(round(p.p_retailprice * 100) AS BIGINT) + 100 * CAST(floor(e.event_id / n.n) AS BIGINT) AS c
        FROM events e, n JOIN part p ON p.p_partkey = (e.event_id * 7) % n.n),
  g AS (SELECT *, CAST(floor(c / 100) AS BIGINT) AS i, lpad(CAST(c % 100 AS VARCHAR), 2, '0') AS d FROM b),
  h AS (SELECT *, CASE WHEN i >= 1000 THEN CAST(CAST(floor(i / 1000) AS BIGINT) AS VARCHAR) || '#' ||
                  lpad(CAST(i % 1000 AS VARCHAR), 3, '0') ELSE CAST(i AS VARCHAR) END AS gi,
               'https://' || lower(replace(p_brand, '#', '-')) || '.example.com' AS site FROM g)
  SELECT seq, site, 'SKU-' || CAST(pk AS VARCHAR) AS sku,
    CASE WHEN pk % 25 = 24 OR v % 7 = 0 THEN '' ELSE p_name END AS name,
    CASE WHEN pk % 10 = 9 THEN '' ELSE
      CASE v % 6 WHEN 0 THEN replace(gi, '#', '.') || ',' || d || ' EUR'
                 WHEN 1 THEN '$' || replace(gi, '#', ',') || '.' || d
                 WHEN 2 THEN CAST(i AS VARCHAR) || '.' || d
                 WHEN 3 THEN replace(gi, '#', ',') WHEN 4 THEN 'on request' ELSE '' END END AS price_text,
    CASE seq % 3 WHEN 0 THEN p_type || ' > ' || p_brand WHEN 1 THEN 'Sale > ' || p_type ELSE '' END AS category_path,
    CASE WHEN v % 5 = 4 THEN '' ELSE 'https://cdn.example.com/is/image/' || CAST(pk AS VARCHAR) || '-' ||
         CAST(v % 5 AS VARCHAR) || '.jpg' END AS image,
    CASE WHEN pk % 20 = 19 THEN '' ELSE site || '/p/' || CAST(pk AS VARCHAR) || '?utm_source=feed#top' END AS product_url,
    CASE WHEN pk % 11 = 10 THEN '' ELSE p_brand END AS brand,
    p_name || ' ' || p_type AS description, ts
  FROM h)"""


def listing_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(category, page_no, pos, page_url, next_href, href, text)``."""
    part = dealt(read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"))
    pk = F.col("p_partkey")
    page_no = (pk % 4 + 1)
    href = (F.when(pk % 6 == 0, F.concat(F.lit("/p/"), pk.cast("string"), F.lit("?utm_source=x")))
            .when(pk % 6 == 1, F.concat(F.lit("https://shop.example.com/p/"), pk.cast("string"), F.lit("#top")))
            .when(pk % 6 == 2, F.concat(F.lit("../p/"), pk.cast("string")))
            .when(pk % 6 == 3, F.concat(F.lit("https://other.example.net/p/"), pk.cast("string")))
            .when(pk % 6 == 4, F.concat(F.lit("/x-"), (F.lit(100000) + pk).cast("string"), F.lit(".html")))
            .otherwise(F.lit("/cart")))
    return part.select(
        F.col("p_type").alias("category"),
        page_no.alias("page_no"),
        pk.alias("pos"),
        F.concat(F.lit("https://shop.example.com/c/"), F.lower("p_type"), F.lit("?page="),
                 page_no.cast("string")).alias("page_url"),
        F.when(pk % 4 < 3, F.concat(F.lit("?page="), (pk % 4 + 2).cast("string"))).otherwise(F.lit(""))
        .alias("next_href"),
        href.alias("href"),
        F.col("p_name").alias("text"),
    )


LISTING_LINKS_SQL = """
f4 AS (
  SELECT p_type AS category, p_partkey % 4 + 1 AS page_no, p_partkey AS pos,
    'https://shop.example.com/c/' || lower(p_type) || '?page=' || CAST(p_partkey % 4 + 1 AS VARCHAR) AS page_url,
    CASE WHEN p_partkey % 4 < 3 THEN '?page=' || CAST(p_partkey % 4 + 2 AS VARCHAR) ELSE '' END AS next_href,
    CASE p_partkey % 6 WHEN 0 THEN '/p/' || CAST(p_partkey AS VARCHAR) || '?utm_source=x'
      WHEN 1 THEN 'https://shop.example.com/p/' || CAST(p_partkey AS VARCHAR) || '#top'
      WHEN 2 THEN '../p/' || CAST(p_partkey AS VARCHAR)
      WHEN 3 THEN 'https://other.example.net/p/' || CAST(p_partkey AS VARCHAR)
      WHEN 4 THEN '/x-' || CAST(100000 + p_partkey AS VARCHAR) || '.html' ELSE '/cart' END AS href,
    p_name AS text
  FROM part)"""


def _price_text(col):
    cents = F.round(col * 100).cast("bigint")
    return F.concat(F.floor(cents / 100).cast("bigint").cast("string"), F.lit("."), _lpad(cents % 100, 2))


def product_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(page_id, url, category, html)`` -- one product page per part.

    Variant by ``p_partkey % 6``: 0 Product with offers array, brand object,
    image array; 1 Product with an offer object carrying ``lowPrice`` (a
    number), brand string, image string; 2 ``@graph`` holding a
    BreadcrumbList and a Product with an image object; 3 ``@type`` array and a
    zero price falling through to ``lowPrice``; 4 broken JSON-LD with DOM
    fallback (``itemprop``, ``og:image``, SKU in the body text); 5 no JSON-LD,
    ``class="price"`` text with a euro sign, canonical link and breadcrumb."""
    part = dealt(read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type",
                                                         "p_retailprice"))
    pk = F.col("p_partkey")
    k = pk.cast("string")
    name, brand, typ = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    price = _price_text(F.col("p_retailprice"))
    ld_open = F.lit('<script type="application/ld+json">')
    ld_close = F.lit("</script>")

    def cat(*parts):
        return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])

    v0 = cat(ld_open, '{"@context":"https://schema.org","@type":"Product","name":"', name, '","sku":"SKU-', k,
             '","brand":{"@type":"Brand","name":"', brand, '"},"image":["/img/', k,
             '-1.jpg","https://cdn.example.com/img/', k, '-2.jpg"],"offers":[{"@type":"Offer","price":"', price,
             '","priceCurrency":"EUR"}],"description":"<p>A <b>fine</b> ', name, '</p>"}', ld_close,
             "<h1>", name, "</h1>")
    v1 = cat(ld_open, '{"@type":"Product","name":"', name, '","mpn":"MPN-', k, '","brand":"', brand,
             '","image":"https://cdn.example.com/img/', k, '.jpg","offers":{"@type":"AggregateOffer","lowPrice":',
             price, ',"priceCurrency":"usd"}}', ld_close)
    v2 = cat(ld_open, '{"@context":"https://schema.org","@graph":[{"@type":"BreadcrumbList","itemListElement":['
             '{"@type":"ListItem","position":1,"name":"Home"},{"@type":"ListItem","position":2,"item":{"name":"', typ,
             '"}},{"@type":"ListItem","position":3,"name":"', brand, '"}]},{"@type":"Product","name":"', name,
             '","sku":"SKU-', k, '","image":{"@type":"ImageObject","url":"https://cdn.example.com/img/', k,
             '.jpg"},"offers":{"price":"', price, '","priceCurrency":"GBP"}}]}', ld_close)
    v3 = cat(ld_open, '{"@type":["Product","Thing"],"name":"', name, '","sku":"SKU-', k,
             '","offers":[{"price":"0","lowPrice":"', price, '"}]}', ld_close,
             '<img class="productImage" src="/assets/layout/logo.png">')
    v4 = cat(ld_open, '{"@type":"Product","name": }', ld_close, '<h1 itemprop="name">', name,
             '</h1><span itemprop="price">€', price, '</span><meta property="og:image" content="/img/', k,
             '.jpg"><p>SKU: SKU-', k, "</p>")
    v5 = cat("<h1>", name, '</h1><div class="price">', price, ' €</div><link rel="canonical" href="/p/', k,
             '?utm_source=canon"><div class="breadcrumb"><a href="/">Home</a> <a href="/c/x">', typ,
             "</a></div><p>Ref ", k, "</p>")
    body = (F.when(pk % 6 == 0, v0).when(pk % 6 == 1, v1).when(pk % 6 == 2, v2).when(pk % 6 == 3, v3)
            .when(pk % 6 == 4, v4).otherwise(v5))
    html = cat("<html><head><title>", name, " | Shop</title></head><body>", body, "</body></html>")
    return part.select(pk.alias("page_id"), cat("https://shop.example.com/p/", k).alias("url"),
                       typ.alias("category"), html.alias("html"))


PRODUCT_PAGES_SQL = """
f3 AS (
  SELECT p_partkey AS page_id, 'https://shop.example.com/p/' || CAST(p_partkey AS VARCHAR) AS url, p_type AS category,
    '<html><head><title>' || p_name || ' | Shop</title></head><body>' || CASE p_partkey % 6
    WHEN 0 THEN '<script type="application/ld+json">{"@context":"https://schema.org","@type":"Product","name":"' || p_name ||
      '","sku":"SKU-' || CAST(p_partkey AS VARCHAR) || '","brand":{"@type":"Brand","name":"' || p_brand ||
      '"},"image":["/img/' || CAST(p_partkey AS VARCHAR) || '-1.jpg","https://cdn.example.com/img/' || CAST(p_partkey AS VARCHAR) ||
      '-2.jpg"],"offers":[{"@type":"Offer","price":"' || pr || '","priceCurrency":"EUR"}],"description":"<p>A <b>fine</b> ' ||
      p_name || '</p>"}</script><h1>' || p_name || '</h1>'
    WHEN 1 THEN '<script type="application/ld+json">{"@type":"Product","name":"' || p_name || '","mpn":"MPN-' ||
      CAST(p_partkey AS VARCHAR) || '","brand":"' || p_brand || '","image":"https://cdn.example.com/img/' ||
      CAST(p_partkey AS VARCHAR) || '.jpg","offers":{"@type":"AggregateOffer","lowPrice":' || pr ||
      ',"priceCurrency":"usd"}}</script>'
    WHEN 2 THEN '<script type="application/ld+json">{"@context":"https://schema.org","@graph":[{"@type":"BreadcrumbList","itemListElement":[' ||
      '{"@type":"ListItem","position":1,"name":"Home"},{"@type":"ListItem","position":2,"item":{"name":"' || p_type ||
      '"}},{"@type":"ListItem","position":3,"name":"' || p_brand || '"}]},{"@type":"Product","name":"' || p_name ||
      '","sku":"SKU-' || CAST(p_partkey AS VARCHAR) || '","image":{"@type":"ImageObject","url":"https://cdn.example.com/img/' ||
      CAST(p_partkey AS VARCHAR) || '.jpg"},"offers":{"price":"' || pr || '","priceCurrency":"GBP"}}]}</script>'
    WHEN 3 THEN '<script type="application/ld+json">{"@type":["Product","Thing"],"name":"' || p_name || '","sku":"SKU-' ||
      CAST(p_partkey AS VARCHAR) || '","offers":[{"price":"0","lowPrice":"' || pr || '"}]}</script>' ||
      '<img class="productImage" src="/assets/layout/logo.png">'
    WHEN 4 THEN '<script type="application/ld+json">{"@type":"Product","name": }</script><h1 itemprop="name">' || p_name ||
      '</h1><span itemprop="price">€' || pr || '</span><meta property="og:image" content="/img/' ||
      CAST(p_partkey AS VARCHAR) || '.jpg"><p>SKU: SKU-' || CAST(p_partkey AS VARCHAR) || '</p>'
    ELSE '<h1>' || p_name || '</h1><div class="price">' || pr || ' €</div><link rel="canonical" href="/p/' ||
      CAST(p_partkey AS VARCHAR) || '?utm_source=canon"><div class="breadcrumb"><a href="/">Home</a> <a href="/c/x">' ||
      p_type || '</a></div><p>Ref ' || CAST(p_partkey AS VARCHAR) || '</p>'
    END || '</body></html>' AS html
  FROM (SELECT *, CAST(floor(CAST(round(p_retailprice * 100) AS BIGINT) / 100) AS BIGINT)::VARCHAR || '.' ||
               lpad(CAST(CAST(round(p_retailprice * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0') AS pr FROM part))"""
