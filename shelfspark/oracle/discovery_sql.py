"""Oracle SQL (DuckDB) for category discovery and name matching."""

from __future__ import annotations

from shelfspark.oracle import links_sql as LQ
from shelfspark.oracle import sqlfn as Q


def ctes() -> list[str]:
    entry_clean = Q.stages("(SELECT site, url FROM pg WHERE page_id IN (SELECT page_id FROM entry))",
                           *Q.normalise_steps("url", "u"), *Q.clean_steps("unorm", "entry_url", "ec"))
    return [
        "entry AS (SELECT site, arg_min(page_id, page_id) AS page_id FROM pg GROUP BY site)",
        ("cand AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY category_score DESC, pos) AS rn "
         "FROM sc WHERE page_id IN (SELECT page_id FROM entry) AND product_score < 3 AND category_score >= 3)"),
        ("topcat AS (SELECT site, page_id, CAST(r AS INTEGER) AS rank, text AS name, url, [text] AS path, "
         "CAST(category_score AS INTEGER) AS score FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY "
         "category_score DESC, pos) AS r FROM cand WHERE rn = 1))"),
        f"entryu AS (SELECT site, entry_url FROM {entry_clean})",
        ("cats AS (SELECT site, rank, name, url, path FROM topcat UNION ALL "
         "SELECT e.site, 1, 'catalog', e.entry_url, ['catalog'] FROM entryu e WHERE e.site NOT IN (SELECT site FROM topcat))"),
        ("reqs AS (SELECT site, 1 AS req_no, upper(substr(" + Q.fold("name") + ", 1, 3)) AS name FROM cats WHERE rank = 1 "
         "UNION ALL SELECT DISTINCT site, 2, 'Zz-unmatched' FROM cats)"),
        (f"nm AS (SELECT c.site, r.req_no, r.name AS request, c.rank, c.name, c.url, c.path FROM cats c JOIN reqs r "
         f"ON c.site = r.site WHERE {Q.fold('r.name')} <> '' AND contains({Q.fold('c.name')}, {Q.fold('r.name')}))"),
        ("nmatch AS (SELECT site, req_no, request, min(rank) AS rank, arg_min(name, rank) AS name, "
         "arg_min(url, rank) AS url, arg_min(path, rank) AS path FROM nm GROUP BY site, req_no, request)"),
    ]


def with_discovery(*extra: str) -> str:
    return LQ.with_links(*ctes(), *extra)


def top_categories_sql() -> str:
    return with_discovery() + "SELECT site, page_id, rank, name, url, array_to_string(path, ' > ') AS path, score FROM topcat WHERE rank <= 12"


def discover_categories_sql() -> str:
    return with_discovery() + "SELECT site, rank, name, url, array_to_string(path, ' > ') AS path FROM cats"


def fallback_catalog_category_sql() -> str:
    return with_discovery() + ("SELECT site, 'no_categories_detected' AS code, entry_url AS url FROM entryu "
                               "WHERE site NOT IN (SELECT site FROM topcat)")


def category_name_match_sql() -> str:
    return with_discovery() + ("SELECT site, req_no, request, rank, name, url, array_to_string(path, ' > ') AS path "
                               "FROM nmatch")


def category_name_fallback_sql() -> str:
    return with_discovery() + ("SELECT r.site, r.req_no, r.name FROM reqs r WHERE NOT EXISTS "
                               "(SELECT 1 FROM nmatch m WHERE m.site = r.site AND m.req_no = r.req_no)")


def discover_subcategories_sql() -> str:
    clean = Q.stages("(SELECT page_id, site, url FROM pg)", *Q.normalise_steps("url", "u"),
                     *Q.clean_steps("unorm", "clean_url", "cu"))
    origin = Q.rx_extract("c.url", r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    return with_discovery(
        f"pclean AS (SELECT page_id, site, clean_url FROM {clean})",
        ("subc AS (SELECT c.site, c.url AS parent_url, c.path AS parent_path, s.page_id, s.url, s.text, "
         "s.category_score, s.pos FROM cats c JOIN pclean p ON p.site = c.site AND p.clean_url = c.url "
         "JOIN sc s ON s.page_id = p.page_id WHERE s.product_score < 3 AND s.category_score >= 3 "
         f"AND s.url <> c.url AND starts_with(s.url, {origin}))"),
        ("subbest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parent_url, page_id, url "
         "ORDER BY category_score DESC, pos) AS rn FROM subc) WHERE rn = 1)"),
    ) + (
        "SELECT site, parent_url, CAST(r AS INTEGER) AS rank, text AS name, url, "
        "array_to_string(list_append(parent_path, text), ' > ') AS path FROM (SELECT *, row_number() OVER "
        "(PARTITION BY parent_url, page_id ORDER BY category_score DESC, pos) AS r FROM subbest)")
