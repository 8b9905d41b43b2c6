"""Oracle SQL (DuckDB) for listing pages, pagination and product links."""

from __future__ import annotations

from shelfspark.oracle import sqlfn as Q
from shelfspark.sources.fixtures import LISTING_LINKS_SQL


def ctes(per_category: int | None = None) -> list[str]:
    pages_src = Q.stages("(SELECT DISTINCT page_url, next_href FROM f4)", *Q.normalise_steps("page_url", "b"),
                         *Q.resolve_steps("next_href", "b", "nx"))
    links_src = Q.stages("(SELECT page_url, pos, href, text FROM f4)", *Q.normalise_steps("page_url", "b"),
                         *Q.resolve_steps("href", "b", "url"))
    stop = "" if per_category is None else f" WHERE before < {per_category}"
    cut = "" if per_category is None else f" WHERE rank <= {per_category}"
    return [
        LISTING_LINKS_SQL.strip(),
        ("cats AS (SELECT DISTINCT regexp_extract(page_url, '^https?://([^/?#]+)', 1) AS site, category AS name, "
         "page_url AS url FROM f4 WHERE page_no = 1)"),
        f"lpages AS (SELECT page_url, CASE WHEN next_href <> '' THEN nx ELSE '' END AS next_url FROM {pages_src})",
        ("chain AS (SELECT site, url AS category_url, name, 1 AS depth, url AS page_url, [url] AS seen FROM cats "
         "WHERE url IN (SELECT page_url FROM lpages) UNION ALL "
         "SELECT c.site, c.category_url, c.name, c.depth + 1, p.next_url, list_append(c.seen, p.next_url) "
         "FROM chain c JOIN lpages p ON c.page_url = p.page_url WHERE p.next_url <> '' "
         "AND NOT list_contains(c.seen, p.next_url) AND p.next_url IN (SELECT page_url FROM lpages))"),
        (f"plinks AS (SELECT page_url, url, -min(struct_pack(n := -score, p := pos, t := text)).n AS score, "
         f"min(struct_pack(n := -score, p := pos, t := text)).p AS pos, "
         f"min(struct_pack(n := -score, p := pos, t := text)).t AS text FROM ("
         f"SELECT page_url, pos, url, {Q.ws('text')} AS text, {Q.score_product('url')} AS score FROM {links_src} "
         f"WHERE url <> '' AND {Q.same_domain('url', 'page_url')}) WHERE score >= 3 GROUP BY page_url, url)"),
        ("firsto AS (SELECT category_url, url, min(struct_pack(d := depth, n := -score, p := pos)) AS f FROM chain "
         "JOIN plinks USING (page_url) GROUP BY category_url, url)"),
        "first AS (SELECT category_url, url, f.d AS depth, -f.n AS score, f.p AS pos FROM firsto)",
        ("steps AS (SELECT ch.category_url, ch.depth, count(f.url) AS links FROM chain ch LEFT JOIN first f "
         "ON f.category_url = ch.category_url AND f.depth = ch.depth GROUP BY ch.category_url, ch.depth)"),
        ("visited AS (SELECT * FROM (SELECT *, coalesce(sum(links) OVER (PARTITION BY category_url ORDER BY depth "
         f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM steps){stop})"),
        ("collected AS (SELECT site, category_url, name, CAST(rank AS INTEGER) AS rank, url, score, depth FROM ("
         "SELECT c.site, c.name, f.*, row_number() OVER (PARTITION BY f.category_url ORDER BY f.depth, f.score DESC, "
         "f.pos, f.url) AS rank FROM first f JOIN visited v ON f.category_url = v.category_url AND f.depth = v.depth "
         f"JOIN cats c ON c.url = f.category_url){cut})"),
        ("counts AS (SELECT c.site, c.url AS category_url, c.name, CAST(coalesce(sum(v.links), 0) AS BIGINT) AS "
         "links_discovered, coalesce(max(v.depth), 0) AS pages_visited FROM cats c LEFT JOIN visited v "
         "ON v.category_url = c.url GROUP BY c.site, c.url, c.name)"),
    ]


def with_listing(*extra: str, per_category: int | None = None) -> str:
    return "WITH RECURSIVE " + ",\n".join([*ctes(per_category), *extra]) + "\n"


def pagination_chain_sql() -> str:
    return with_listing() + "SELECT site, category_url, name, depth, page_url FROM chain"


def products_per_category_sql(per_category: int = 10) -> str:
    return with_listing(per_category=per_category) + (
        "SELECT site, category_url, name, rank, url, CAST(score AS INTEGER) AS score, depth FROM collected")


def links_per_category_sql() -> str:
    return with_listing() + "SELECT site, category_url, name, links_discovered, pages_visited FROM counts"


def link_filter_product_sql() -> str:
    return with_listing() + "SELECT page_url, url, CAST(score AS INTEGER) AS score, pos, text FROM plinks"


def unprocessed_categories_sql() -> str:
    return with_listing() + ("SELECT name, url FROM cats WHERE url NOT IN "
                             "(SELECT DISTINCT page_url FROM chain WHERE depth > 1)")
