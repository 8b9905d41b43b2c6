"""DuckDB SQL of the storefront queries, from what the shops are made of.

Nothing here reads html: each query states what a crawl of the shops must find,
directly from ``part`` (``sources.storefronts`` says how a shop is laid out)."""

from __future__ import annotations

from shelfspark.sources.storefronts import REQUESTS_SQL, SHOPS_SQL, duck_sql

HOST = "replace({0}, 'https://', '')"

# pages that exist, with what their menus hold
_MENUS = """,
menu_pages AS (
  SELECT 1000 + (b * 100 + t) * 10 + page_no AS page_id, site, b, type, label, t, n_types FROM shop_types, range(1, 4) r(page_no) WHERE b % 5 <> 3
  UNION ALL SELECT DISTINCT 1000000 + (s.b * 100 + s.t) * 10 + CASE WHEN p.compact THEN 1 ELSE 2 END, s.site, s.b, s.type, s.label, s.t, s.n_types
  FROM shop_types s JOIN shop_parts p ON p.site = s.site AND p.type = s.type WHERE s.b % 5 <> 3 AND s.b % 4 <> 3),
menu_links AS (
  SELECT b AS page_id, t AS rank, site || '/c/' || lower(type) AS url, label || ' sale' AS text, 8 AS score FROM shop_types WHERE b % 5 <> 3
  UNION ALL SELECT DISTINCT b, n_types + 1, site || '/c/outside', 'Outside collection', 8 FROM shop_types WHERE b % 5 = 2
  UNION ALL SELECT page_id, 1, site || '/c/' || lower(type), label || ' sale', 8 FROM menu_pages
  UNION ALL SELECT page_id, 2, site || '/c/' || lower(type) || '/compact', 'Compact sale', 8 FROM menu_pages
  UNION ALL SELECT page_id, 3, site || '/c/' || lower(type) || '/bulky', 'Bulky sale', 8 FROM menu_pages
  UNION ALL SELECT m.page_id, 4, m.site || '/c/' || lower(n.type), n.label || ' sale', 8 FROM menu_pages m
    JOIN shop_types n ON n.site = m.site AND n.t = m.t % m.n_types + 1 WHERE m.n_types > 1
  UNION ALL SELECT 100000000 + pk, 1, site || '/c/' || lower(type), label, 5 FROM shop_parts WHERE pk % 3 = 1)"""

_LISTED = """,
listed AS (
  SELECT b AS page_id, * FROM shop_links WHERE b % 5 = 3
  UNION ALL SELECT 1000 + (l.b * 100 + t.t) * 10 + l.page_no, l.* FROM shop_links l JOIN shop_types t ON t.site = l.site AND t.type = l.type WHERE l.b % 5 <> 3
  UNION ALL SELECT 1000000 + (l.b * 100 + t.t) * 10 + CASE WHEN l.compact THEN 1 ELSE 2 END, l.* FROM shop_links l
    JOIN shop_types t ON t.site = l.site AND t.type = l.type WHERE l.b % 5 <> 3 AND l.b % 4 <> 3)"""

# categories in processing order without requests and limits; paths joined
_CATEGORIES = """,
claimed AS (
  SELECT s.site, CASE WHEN s.t = 1 THEN 1 ELSE s.t - 1 END AS place, CASE WHEN s.t = 1 THEN 0 ELSE 3 END AS sub, s.label || ' sale' AS name,
    s.site || '/c/' || lower(s.type) AS url, CASE WHEN s.t = 1 THEN '' ELSE p.label || ' sale > ' END || s.label || ' sale' AS path,
    s.type, NULL::BOOLEAN AS compact, 3 AS pages FROM shop_types s LEFT JOIN shop_types p ON p.site = s.site AND p.t = s.t - 1 WHERE s.b % 5 <> 3
  UNION ALL SELECT s.site, s.t, CASE WHEN k.compact THEN 1 ELSE 2 END, k.name, s.site || '/c/' || lower(s.type) || k.tail, s.label || ' sale > ' || k.name,
    s.type, k.compact, CASE WHEN s.b % 4 <> 3 AND e.site IS NOT NULL THEN 1 ELSE 0 END
  FROM shop_types s CROSS JOIN (VALUES (true, 'Compact sale', '/compact'), (false, 'Bulky sale', '/bulky')) k(compact, name, tail)
  LEFT JOIN (SELECT DISTINCT site, type, compact FROM shop_parts) e ON e.site = s.site AND e.type = s.type AND e.compact = k.compact WHERE s.b % 5 <> 3
  UNION ALL SELECT DISTINCT site, n_types + 1, 0, 'Outside collection', site || '/c/outside', 'Outside collection', NULL, NULL::BOOLEAN, 0 FROM shop_types WHERE b % 5 = 2
  UNION ALL SELECT DISTINCT site, 1, 0, 'catalog', site || '/', 'catalog', NULL, NULL::BOOLEAN, 1 FROM shop_types WHERE b % 5 = 3),
found AS (
  SELECT c.*, l.pk, CASE WHEN c.compact IS NULL AND c.type IS NOT NULL THEN l.page_no ELSE 1 END AS depth
  FROM claimed c JOIN shop_links l ON l.site = c.site AND (c.type IS NULL OR l.type = c.type) AND (c.compact IS NULL OR l.compact = c.compact) WHERE c.pages > 0)"""

_PRODUCTS = """,
contexts AS (
  SELECT pk, arg_max(path, place * 10 + sub) AS last_path, string_agg(path, ' | ' ORDER BY place, sub) AS paths, count(*) AS sightings FROM found GROUP BY pk),
products AS (
  SELECT l.*, c.sightings, CASE WHEN l.pk % 3 = 1 THEN label ELSE c.last_path END AS category_path, CASE WHEN l.pk % 3 = 1 THEN label ELSE c.paths END AS paths,
    CASE WHEN l.pk % 3 = 2 THEN regexp_replace(lower(l.site || l.path), '[^a-z0-9]+', '-', 'g') ELSE 'SKU-' || l.pk END AS sku,
    CASE WHEN l.pk % 3 = 2 AND l.pk % 7 = 0 THEN '' ELSE l.units || '.' || l.cents END AS price
  FROM shop_links l JOIN contexts c ON c.pk = l.pk)"""


def _query(*parts: str) -> str:
    return "WITH " + duck_sql("".join(parts)).strip()


def select_field_sql() -> str:
    return _query(SHOPS_SQL, """
SELECT 100000000 + pk AS page_id, CASE pk % 3 WHEN 0 THEN 'Other' WHEN 1 THEN name || ' ' || type ELSE '' END AS name,
  CASE WHEN pk % 3 = 1 THEN 'A fine ' || name ELSE '' END AS description, CASE WHEN pk % 3 = 1 THEN 'SKU-' || pk ELSE '' END AS sku,
  CASE WHEN pk % 3 = 1 THEN units || ',' || cents || ' EUR' WHEN pk % 3 = 2 AND pk % 7 <> 0 THEN units || '.' || cents || ' €' ELSE '' END AS price,
  CASE WHEN pk % 3 = 1 THEN 'gbp' ELSE '' END AS currency,
  CASE pk % 3 WHEN 0 THEN '/assets/layout/logo.png' WHEN 1 THEN '/img/' || pk || '-1.jpg /img/' || pk || '-2.jpg'
    ELSE '/assets/layout/logo.png /img/' || pk || '-1.jpg' END AS images FROM shop_links""")


def dom_breadcrumb_sql() -> str:
    return _query(SHOPS_SQL, "\nSELECT 100000000 + pk AS page_id, CASE WHEN pk % 3 = 1 THEN 'Home > ' || label ELSE '' END AS breadcrumb FROM shop_links")


def menu_links_sql() -> str:
    return _query(SHOPS_SQL, _MENUS, "\nSELECT page_id, CAST(rank AS INT) AS rank, url, text, score FROM menu_links")


def product_links_sql() -> str:
    return _query(SHOPS_SQL, _LISTED, """
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pk % 4 = 2, pk) AS INT) AS rank, site || path AS url,
  CASE WHEN pk % 4 = 2 THEN 4 ELSE 5 END AS score, pk % 4 = 2 AS by_card FROM listed""")


def next_page_sql() -> str:
    return _query(SHOPS_SQL, """
SELECT 1000 + (b * 100 + t) * 10 + page_no AS page_id, CASE WHEN page_no < 3 THEN site || '/c/' || lower(type) || '?page=' || (page_no + 1)
  WHEN b % 2 = 1 THEN '' ELSE site || '/c/' || lower(type) END AS next_url FROM shop_types, range(1, 4) r(page_no) WHERE b % 5 <> 3""")


def requested_sql(tiers: tuple[int, ...] = (0, 1, 2)) -> str:
    return _query(SHOPS_SQL, f"""
SELECT {HOST.format('site')} AS site, tier * 2147483648 + req_no AS place, name, url, path FROM (
  SELECT site, 0 AS tier, 1 AS req_no, 'Bulky' AS name, site || '/c/' || lower(type) || '/bulky-c12.html' AS url, '' AS path FROM shop_types WHERE t = 3
  UNION ALL SELECT site, 1, 2, label || ' sale', site || '/c/' || lower(type), label || ' sale' FROM shop_types WHERE t = 2 AND b % 5 <> 3
  UNION ALL SELECT site, 1, 4, label || ' sale', site || '/c/' || lower(type), label || ' sale' FROM shop_types WHERE t = 1 AND b % 5 <> 3
  UNION ALL SELECT site, 2, 3, 'Bulky sale', site || '/c/' || lower(type) || '/bulky', label || ' sale > Bulky sale' FROM shop_types WHERE t = 1 AND b % 5 <> 3)
WHERE tier IN ({', '.join(map(str, tiers))})""")


def subcategories_sql() -> str:
    return _query(SHOPS_SQL, f"""
SELECT {HOST.format('s.site')} AS site, s.site || '/c/' || lower(s.type) AS url, k.sub, coalesce(k.name, n.label || ' sale') AS sub_name,
  s.site || '/c/' || coalesce(lower(s.type) || k.tail, lower(n.type)) AS sub_url, s.label || ' sale > ' || coalesce(k.name, n.label || ' sale') AS sub_path
FROM shop_types s CROSS JOIN (VALUES (1, 'Compact sale', '/compact'), (2, 'Bulky sale', '/bulky'), (3, NULL, NULL)) k(sub, name, tail)
JOIN shop_types n ON n.site = s.site AND n.t = s.t % s.n_types + 1 WHERE s.b % 5 <> 3 AND (k.sub < 3 OR s.n_types > 1)""")


def unmatched_sql() -> str:
    return "WITH q AS (WITH " + duck_sql(REQUESTS_SQL).strip() + f""")
SELECT {HOST.format('site')} AS site, 'unmatched_category_name' AS code, value AS subject FROM q
WHERE kind = 'name' AND (req_no = 5 OR CAST(regexp_extract(site, 'brand-([0-9]+)', 1) AS INT) % 5 = 3)"""


def first_visit_sql() -> str:
    return _query(SHOPS_SQL, _CATEGORIES, f"\nSELECT {HOST.format('site')} AS site, CAST(place AS BIGINT) AS place, sub, name, url, path FROM claimed")


def category_links_sql() -> str:
    return _query(SHOPS_SQL, _CATEGORIES, f"""
SELECT {HOST.format('f.site')} AS site, f.url, l.site || l.path AS product_url, f.depth,
  row_number() OVER (PARTITION BY f.url ORDER BY f.depth, l.pk % 4 = 2, l.pk) AS rank FROM found f JOIN shop_links l ON l.pk = f.pk""")


def categories_sql() -> str:
    return _query(SHOPS_SQL, _CATEGORIES, f"""
SELECT {HOST.format('c.site')} AS site, CAST(place AS BIGINT) AS place, sub, name, c.url, path, coalesce(n, 0) AS links_discovered, CAST(pages AS BIGINT) AS pages_visited
FROM claimed c LEFT JOIN (SELECT url, count(*) AS n FROM found GROUP BY url) k ON k.url = c.url""")


def products_sql() -> str:
    return _query(SHOPS_SQL, _CATEGORIES, _PRODUCTS, f"""
SELECT {HOST.format('site')} AS site, sku AS product_key, lower(sku) AS product_id, sku,
  CASE pk % 3 WHEN 0 THEN name WHEN 1 THEN name || ' ' || type ELSE name || ' | Store' END AS name,
  CASE WHEN pk % 3 = 2 THEN '' ELSE 'A fine ' || name END AS description, CASE WHEN pk % 3 = 0 THEN brand ELSE '' END AS brand, price,
  CASE WHEN pk % 3 = 0 THEN 'EUR' WHEN pk % 3 = 1 THEN 'GBP' WHEN price = '' THEN 'USD' ELSE 'EUR' END AS currency, site || path AS product_url,
  split_part(category_path, ' > ', 1) AS category, split_part(category_path, ' > ', 2) AS subcategory, category_path, category_path AS category_trail,
  paths AS all_category_paths, CASE pk % 3 WHEN 0 THEN site || '/img/' || pk || '.jpg' WHEN 1 THEN site || '/img/' || pk || '-1.jpg | ' || site || '/img/' || pk || '-2.jpg'
    ELSE site || '/img/' || pk || '-1.jpg' END AS image_urls, site AS source_site, CASE WHEN pk % 3 = 0 THEN 'jsonld+dom' ELSE 'dom' END AS source_type,
  CASE WHEN pk % 3 = 0 THEN 0.8::DOUBLE ELSE 0.55::DOUBLE END AS source_confidence, sightings FROM products""")


def summary_sql() -> str:
    return _query(SHOPS_SQL, _CATEGORIES, _PRODUCTS, f"""
SELECT {HOST.format('p.site')} AS site, count(*) AS product_count, count(*) AS valid_products, 0::BIGINT AS products_with_errors,
  count(*) FILTER (WHERE price = '') AS products_with_warnings, 0::BIGINT AS error_count, count(*) FILTER (WHERE price = '') AS warning_count,
  round(count(*) FILTER (WHERE price <> '') / count(*)::DOUBLE, 4) AS price_coverage, 1.0::DOUBLE AS image_coverage, 1.0::DOUBLE AS category_coverage,
  any_value(n) AS categories_processed
FROM products p JOIN (SELECT site, count(*) AS n FROM claimed GROUP BY site) k ON k.site = p.site GROUP BY p.site""")


def issues_sql() -> str:
    return _query(SHOPS_SQL, _CATEGORIES, _PRODUCTS, f"""
SELECT {HOST.format('site')} AS site, sku AS product_key, lower(sku) AS report_key, 4 AS rule_no, 'warning' AS level, 'price' AS field FROM products WHERE price = ''""")


def warnings_sql() -> str:
    return _query(SHOPS_SQL, _CATEGORIES, _PRODUCTS, f"""
SELECT {HOST.format('site')} AS site, code, subject FROM (
  SELECT DISTINCT site, 'no_categories_detected' AS code, site || '/' AS subject FROM shop_types WHERE b % 5 = 3
  UNION ALL SELECT site, 'page_not_found', url FROM claimed WHERE pages = 0
  UNION ALL SELECT site, 'no_products_in_category', url FROM claimed c WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.url = c.url)
  UNION ALL SELECT site, 'missing_price', site || path FROM products WHERE price = ''
  UNION ALL SELECT site, 'low_price_coverage', CAST(floor(round(count(*) FILTER (WHERE price <> '') / count(*)::DOUBLE, 4) * 100 + 0.5) AS BIGINT) || '%'
    FROM products GROUP BY site HAVING count(*) FILTER (WHERE price <> '') / count(*)::DOUBLE < 0.5)""")


def site_config_sql() -> str:
    return _query(SHOPS_SQL, f"""
SELECT DISTINCT {HOST.format('site')} AS site, 'shop-' || b AS name, site || '/' AS entry_url, 'CHF' AS currency, site || '/c/outside' AS category_urls,
  'a[href]' AS category_selectors, '/items/' AS include_patterns, '' AS exclude_patterns, 'title' AS name_selectors, NULL::VARCHAR AS price_selectors
FROM shop_types WHERE b % 3 = 0""")


def config_precedence_sql() -> str:
    patterns = "/c/ cgid= /collections/ /category/ /departments/ /shop/"
    return _query(SHOPS_SQL, f""",
shops AS (SELECT DISTINCT site, b FROM shop_types),
settings AS (
  SELECT site, 'entry_url' AS key, site || '/' AS value, 'config' AS source FROM shops WHERE b % 3 = 0
  UNION ALL SELECT site, 'currency', CASE WHEN b % 4 = 0 THEN 'JPY' WHEN b % 3 = 0 THEN 'CHF' ELSE 'USD' END,
    CASE WHEN b % 4 = 0 THEN 'explicit' WHEN b % 3 = 0 THEN 'config' ELSE 'default' END FROM shops
  UNION ALL SELECT site, 'category_names', CASE WHEN b % 4 = 0 THEN 'Large' ELSE '' END, CASE WHEN b % 4 = 0 THEN 'explicit' ELSE 'default' END FROM shops
  UNION ALL SELECT site, 'category_urls', CASE WHEN b % 3 = 0 THEN site || '/c/outside' ELSE '' END, CASE WHEN b % 3 = 0 THEN 'config' ELSE 'default' END FROM shops
  UNION ALL SELECT site, 'category_selectors', CASE WHEN b % 3 = 0 THEN 'a[href]' WHEN b % 2 = 0 THEN '.menu a[href]'
    ELSE 'header nav a[href] nav a[href] [role=''navigation''] a[href] .menu a[href] .navigation a[href]' END,
    CASE WHEN b % 3 = 0 THEN 'config' WHEN b % 2 = 0 THEN 'profile' ELSE 'default' END FROM shops
  UNION ALL SELECT site, 'include_patterns', CASE WHEN b % 3 = 0 THEN '/items/' WHEN b % 2 = 0 THEN '/c/ -x' ELSE '{patterns}' END,
    CASE WHEN b % 3 = 0 THEN 'config' WHEN b % 2 = 0 THEN 'profile' ELSE 'default' END FROM shops
  UNION ALL SELECT site, 'exclude_patterns', CASE WHEN b % 3 = 0 THEN '' ELSE '/account /login /cart /checkout /wishlist /search /blog' END,
    CASE WHEN b % 3 = 0 THEN 'config' ELSE 'default' END FROM shops
  UNION ALL SELECT site, 'name_selectors', CASE WHEN b % 3 = 0 THEN 'title' ELSE
    '[itemprop=''name''] .productName .product-name h1 meta[property=''og:title'']@content meta[name=''twitter:title'']@content' END,
    CASE WHEN b % 3 = 0 THEN 'config' ELSE 'default' END FROM shops
  UNION ALL SELECT site, 'max_pages', '3', 'default' FROM shops)
SELECT {HOST.format('site')} AS site, key, value, source FROM settings""")


def site_config_discovery_sql() -> str:
    return _query(SHOPS_SQL, """
SELECT b AS page_id, CAST(t AS INT) AS rank, site || '/c/' || lower(type) AS url, CASE WHEN b % 3 = 0 THEN 3 ELSE 8 END AS score FROM shop_types WHERE b % 5 <> 3
UNION ALL SELECT DISTINCT b, CAST(n_types + 1 AS INT), site || '/c/outside', CASE WHEN b % 3 = 0 THEN 3 ELSE 8 END FROM shop_types
  WHERE b % 5 <> 3 AND (b % 5 = 2 OR b % 3 = 0 OR b % 2 = 0)
UNION ALL SELECT b, CAST(row_number() OVER (PARTITION BY site ORDER BY pk) AS INT), site || path, 5 FROM shop_links WHERE b % 5 = 3 AND b % 3 = 0 AND pk % 4 = 2""")
