"""Storefront pages derived from ``part``: a shop per brand, as page rows.

One text in the SQL that Spark and DuckDB share ($part: the table; $join(x, o):
the texts x of a group in the order o).  Every shop has an entry page, for each
type three listing pages (plain ``?page=n`` links; in shops of even number the
last one leads back to the first) and two pages of narrower choice, and one page
per product:

* menus stand in ``header nav`` or, by brand number b, in ``role=navigation``
  (b % 5 = 1) or in no marked place (b % 5 = 2, with a category whose page is
  missing); b % 5 = 3 has no categories and lists its products on the entry page;
* a listing page's menu also leads to the shop's next type, so that categories
  are reached twice; the narrower pages are missing where b % 4 = 3;
* products stand in cards of nested blocks; a quarter of the links look like no
  product URL, some lead to another site;
* product pages by pk % 3: JSON-LD; nested markup with containers; little more
  than a title, without a price where pk % 7 = 0.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.urls import url_host
from shelfspark.session import dealt
from shelfspark.sources.tables import read_table

SHOPS_SQL = """
shop_parts AS (
  SELECT p_partkey AS pk, p_name AS name, p_brand AS brand, p_type AS type, p_size <= 25 AS compact,
    CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS b, 'https://' || lower(replace(p_brand, '#', '-')) || '.store.example' AS site,
    CASE p_type WHEN 'ECONOMY' THEN 'Économie' WHEN 'STANDARD' THEN 'Estándar'
      ELSE substr(p_type, 1, 1) || lower(substr(p_type, 2)) END AS label,
    CAST(floor(CAST(round(p_retailprice * 100) AS BIGINT) / 100) AS BIGINT) AS units,
    lpad(CAST(CAST(round(p_retailprice * 100) AS BIGINT) % 100 AS STRING), 2, '0') AS cents FROM $part),
shop_links AS (
  SELECT *, CASE WHEN pk % 4 = 2 THEN '/items/i' ELSE '/p/' END || CAST(pk AS STRING) AS path,
    CAST(floor(pk / 6) AS BIGINT) % 3 + 1 AS page_no FROM shop_parts),
shop_types AS (
  SELECT site, b, type, label, row_number() OVER (PARTITION BY site ORDER BY type) AS t,
    count(*) OVER (PARTITION BY site) AS n_types FROM (SELECT DISTINCT site, b, type, label FROM shop_parts))"""

PAGES_SQL = SHOPS_SQL + """,
cards AS (
  SELECT site, type, compact, page_no, pk, '<li class="product-item" data-product-id="' || CAST(pk AS STRING) ||
    '"><div class="box"><div class="pic"><img src="/img/' || CAST(pk AS STRING) || '.jpg"></div><div class="info"><a href="' ||
    CASE pk % 4 WHEN 0 THEN path || '?utm_campaign=x' WHEN 1 THEN site || path || '#top' ELSE path END ||
    '"><span>Item</span> ' || CAST(pk AS STRING) || '</a>' ||
    CASE WHEN pk % 10 = 7 THEN '<a href="https://elsewhere.example/p/' || CAST(pk AS STRING) || '">Partner</a>' ELSE '' END ||
    '</div></div></li>' AS html FROM shop_links),
menus AS (
  SELECT site, b, max(n_types) AS n_types, $join('<a href="/c/' || lower(type) || '?utm_source=menu"><span>' || label || '</span> <b>sale</b></a>', t) AS html
  FROM shop_types GROUP BY site, b),
entries AS (
  SELECT m.site, m.b AS page_id, m.site || '/' AS url, '<html><head><title>Entry</title></head><body>' ||
    CASE WHEN m.b % 5 = 3 THEN '<a href="/">Home</a><ul>' || coalesce(c.html, '') || '</ul>'
      WHEN m.b % 5 = 2 THEN '<div><a href="/">Home</a>' || m.html || '<a href="/cart">Cart</a></div><a href="/c/outside">Outside collection</a>'
      WHEN m.b % 5 = 1 THEN '<div role="navigation"><a href="/">Home</a>' || m.html || '<a href="/cart">Cart</a></div><a href="/c/outside">Outside collection</a>'
      ELSE '<header><nav><ul><li><a href="/">Home</a><li>' || m.html || '<li><a href="/cart">Cart</a></ul></nav></header><a href="/c/outside">Outside collection</a>' END ||
    '</body></html>' AS html
  FROM menus m LEFT JOIN (SELECT site, $join(html, pk) AS html FROM cards GROUP BY site) c ON c.site = m.site),
submenus AS (
  SELECT s.site, s.b, s.type, s.t, '<nav><a href="/">Home</a><a href="/c/' || lower(s.type) || '">' || s.label || ' sale</a><a href="/c/' || lower(s.type) ||
    '/compact">Compact sale</a><a href="/c/' || lower(s.type) || '/bulky"><i>Bulky</i> sale</a><a href="/c/' || lower(n.type) || '">' || n.label ||
    ' sale</a><a href="/cart">Cart</a></nav>' AS html
  FROM shop_types s JOIN shop_types n ON n.site = s.site AND n.t = s.t % s.n_types + 1),
listings AS (
  SELECT m.site, 1000 + (m.b * 100 + m.t) * 10 + n.page_no AS page_id,
    m.site || '/c/' || lower(m.type) || CASE WHEN n.page_no = 1 THEN '' ELSE '?page=' || CAST(n.page_no AS STRING) END AS url,
    '<html><head><title>' || m.type || '</title></head><body>' || m.html || '<ul>' || coalesce(c.html, '') || '</ul>' ||
    CASE WHEN n.page_no = 3 AND m.b % 2 = 1 THEN '<span class="next">End</span>'
      WHEN m.b % 3 = 0 THEN '<div class="pagination"><a class="next" href="' || '/c/' || lower(m.type) || CASE WHEN n.page_no = 3 THEN '' ELSE '?page=' || CAST(n.page_no + 1 AS STRING) END || '">Next</a></div>'
      WHEN m.b % 3 = 1 THEN '<a rel="next" href="' || CASE WHEN n.page_no = 3 THEN '/c/' || lower(m.type) ELSE '?page=' || CAST(n.page_no + 1 AS STRING) END || '">Next</a>'
      ELSE '<span class="next"><b><a href="' || CASE WHEN n.page_no = 3 THEN '/c/' || lower(m.type) ELSE '?page=' || CAST(n.page_no + 1 AS STRING) END || '">Next</a></b></span>' END ||
    '</body></html>' AS html
  FROM submenus m CROSS JOIN (SELECT 1 AS page_no UNION ALL SELECT 2 UNION ALL SELECT 3) n
  LEFT JOIN (SELECT site, type, page_no, $join(html, pk) AS html FROM cards GROUP BY site, type, page_no) c
    ON c.site = m.site AND c.type = m.type AND c.page_no = n.page_no WHERE m.b % 5 <> 3),
narrow AS (
  SELECT m.site, 1000000 + (m.b * 100 + m.t) * 10 + CASE WHEN c.compact THEN 1 ELSE 2 END AS page_id,
    m.site || '/c/' || lower(m.type) || CASE WHEN c.compact THEN '/compact' ELSE '/bulky' END AS url,
    '<html><body>' || m.html || '<section>' || c.html || '</section></body></html>' AS html
  FROM submenus m JOIN (SELECT site, type, compact, $join(html, pk) AS html FROM cards GROUP BY site, type, compact) c
    ON c.site = m.site AND c.type = m.type WHERE m.b % 5 <> 3 AND m.b % 4 <> 3),
details AS (
  SELECT site, 100000000 + pk AS page_id, site || path AS url, '<html><head><title>' || name || ' | Store</title></head><body><img src="/assets/layout/logo.png">' ||
    CASE pk % 3
    WHEN 0 THEN '<script type="application/ld+json">{"@type":"Product","name":"' || name || '","sku":"SKU-' || CAST(pk AS STRING) ||
      '","brand":{"@type":"Brand","name":"' || brand || '"},"image":["/img/' || CAST(pk AS STRING) || '.jpg"],"description":"<p>A <b>fine</b> ' || name ||
      '</p>","offers":[{"price":"' || CAST(units AS STRING) || '.' || cents || '","priceCurrency":"EUR"}]}</script><h1>Other</h1>'
    WHEN 1 THEN '<div class="breadcrumb"><div><a href="/">Home</a></div><div><a href="/c/' || lower(type) || '"><span>' || label ||
      '</span></a></div></div><h1 itemprop="name"><span>' || name || '</span> <em>' || type || '</em></h1><div class="product-detail"><div><img src="/img/' ||
      CAST(pk AS STRING) || '-1.jpg"></div><div><img src="/img/' || CAST(pk AS STRING) || '-2.jpg"></div></div><div class="sales"><s>old</s><span class="value"><b>' ||
      CAST(units AS STRING) || ',' || cents || '</b> EUR</span></div><p>No. <span class="sku">SKU-<i>' || CAST(pk AS STRING) ||
      '</i></span></p><div class="product-description"><p>A <b>fine</b> ' || name ||
      '</p></div><select class="currency"><option value="usd">Dollar<option value="gbp" selected>Pound</select>'
    ELSE '<img src="/img/' || CAST(pk AS STRING) || '-1.jpg">' || CASE WHEN pk % 7 = 0 THEN '<p>On request</p>' ELSE '<div class="price"><span>' || CAST(units AS STRING) || '.' || cents ||
      '</span> €</div>' END END || '</body></html>' AS html
  FROM shop_links)
SELECT CAST(page_id AS BIGINT) AS page_id, url, html FROM entries
UNION ALL SELECT CAST(page_id AS BIGINT), url, html FROM listings
UNION ALL SELECT CAST(page_id AS BIGINT), url, html FROM narrow
UNION ALL SELECT CAST(page_id AS BIGINT), url, html FROM details"""

REQUESTS_SQL = SHOPS_SQL + """
SELECT site, CAST(req_no AS INT) AS req_no, kind, value FROM (
  SELECT site, 1 AS req_no, 'url' AS kind, site || '/c/' || lower(type) || '/bulky-c12.html?utm_source=q' AS value FROM shop_types WHERE t = 3
  UNION ALL SELECT site, 2, 'name', upper(substr(label, 3)) FROM shop_types WHERE t = 2
  UNION ALL SELECT site, 3, 'name', 'ULKY' FROM shop_types WHERE t = 1
  UNION ALL SELECT site, 4, 'name', 'e' FROM shop_types WHERE t = 1
  UNION ALL SELECT site, 5, 'name', '  Zz unmatched ' FROM shop_types WHERE t = 1
  UNION ALL SELECT site, 6, 'name', label || '   Sale' FROM shop_types WHERE t = 2)"""

CONFIGS_SQL = SHOPS_SQL + """
SELECT DISTINCT site, b FROM shop_types"""

_JOIN = re.compile(r"\$join\((.*), (\w+)\) AS")


def duck_sql(text: str) -> str:
    return _JOIN.sub(r"string_agg(\1, '' ORDER BY \2) AS", text).replace("$part", "part")


def _spark_rows(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    view = f"part_{uuid.uuid4().hex}"
    dealt(read_table(spark, sf_dir, "part")).createOrReplaceTempView(view)
    return spark.sql("WITH " + _JOIN.sub(r"listagg(\1, '') WITHIN GROUP (ORDER BY \2) AS", text).replace("$part", view).strip())


def storefront_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page(page_id, site, url, html, seq)`` of the shops."""
    pages = _spark_rows(spark, sf_dir, PAGES_SQL)
    return pages.select("page_id", url_host("url").alias("site"), "url", "html", F.col("page_id").alias("seq"))


def category_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(site, req_no, kind, value)``: per shop a category URL, inner parts of
    names in other spelling (of a menu entry, of narrower pages alone, of one
    letter), a name that no category has, and a whole name."""
    rows = _spark_rows(spark, sf_dir, REQUESTS_SQL)
    return rows.withColumn("site", url_host("site"))


def site_settings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the caller gives (shops with b % 4 = 0), config files (b % 3 = 0, as rows of
    their JSON) and stored profiles (b % 2 = 0)."""
    shops = _spark_rows(spark, sf_dir, CONFIGS_SQL).withColumnRenamed("site", "url").withColumn("site", url_host("url"))
    explicit = shops.where("b % 4 = 0").select("site", F.lit("").alias("entry_url"), F.lit("JPY").alias("currency"), F.array(F.lit("Large")).alias("category_names"))
    texts = lambda *t: F.array(*map(F.lit, t))
    config = shops.where("b % 3 = 0").select(
        F.concat(F.lit("shop-"), "b").alias("name"), F.concat("url", F.lit("/")).alias("entryUrl"), F.lit("CHF").alias("currency"),
        F.array().cast("array<string>").alias("categoryNames"), F.array(F.concat("url", F.lit("/c/outside"))).alias("categoryUrls"),
        F.struct(texts("a[href]").alias("selectors"), texts("/items/").alias("includePatterns"), F.array().cast("array<string>").alias("excludePatterns")).alias("categoryDiscovery"),
        F.struct(texts("title").alias("name")).alias("productExtraction"), F.col("site").alias("folder"))
    profile = shops.where("b % 2 = 0").select("site", texts(".menu a[href]").alias("category_selectors"), texts("/c/", "-x").alias("include_patterns"))
    return explicit, config, profile
