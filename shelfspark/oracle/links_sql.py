"""Oracle SQL (DuckDB) for the link / page family, one row per link."""

from __future__ import annotations

from shelfspark.functions import scoring as S
from shelfspark.functions import urls as U
from shelfspark.oracle import sqlfn as Q

# The anchor pattern without a back-reference (RE2 has none):
# the two quote styles are spelled out.
ANCHOR_RE2 = r"""(?i)<a\b[^>]*href=(?:"([^"\r\n]*)"|'([^'\r\n]*)')[^>]*>([\s\S]*?)</a>"""
HIDDEN_MARKUP_RE = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>"
TITLE_RE = r"(?i)<title[^>]*>([\s\S]*?)</title>"


def pages_cte() -> str:
    return f"pg AS (SELECT page_id, url, {Q.host('url')} AS site, html FROM pages)"


def raw_links_cte() -> str:
    """``raw_links(page_id, site, page_url, pos, href, text)`` + base columns."""
    vis = Q.rx_replace("coalesce(html, '')", HIDDEN_MARKUP_RE, " ")
    base = Q.stages(f"(SELECT page_id, site, url, regexp_extract_all({vis}, {Q.lit(ANCHOR_RE2)}, 0) AS ms FROM pg)",
                    *Q.normalise_steps("url", "b"))
    href = (f"replace({Q.rx_extract('m', ANCHOR_RE2, 1)} || {Q.rx_extract('m', ANCHOR_RE2, 2)}, "
            f"'&amp;', '&')")
    return (f"raw_links AS (SELECT page_id, site, page_url, CAST(pos AS INTEGER) AS pos, {href} AS href, "
            f"{Q.strip_html(Q.rx_extract('m', ANCHOR_RE2, 3))} AS text, bnorm, bscheme, broot, bpath, bquery "
            f"FROM (SELECT page_id, site, url AS page_url, bnorm, bscheme, broot, bpath, bquery, "
            f"unnest(ms) AS m, generate_subscripts(ms, 1) AS pos FROM {base}))")


def links_cte() -> str:
    """``lk(page_id, site, page_url, pos, url, text)``: resolved, cleaned."""
    res = Q.stages("raw_links", *Q.resolve_steps("href", "b", "link_url"))
    return (f"lk AS (SELECT page_id, site, page_url, pos, link_url AS url, {Q.ws('text')} AS text "
            f"FROM {res} WHERE link_url <> '')")


def scored_cte() -> str:
    """``sc``: same-host links with both scores."""
    inner = (f"(SELECT *, {Q.score_product('url')} AS product_score, {Q.fold('text')} AS folded "
             f"FROM lk WHERE {Q.same_domain('url', 'page_url')})")
    return (f"sc AS (SELECT page_id, site, page_url, pos, url, text, product_score, "
            f"{Q.score_category('url', 'text', 'folded', 'product_score')} AS category_score FROM {inner})")


def with_links(*extra: str) -> str:
    ctes = [pages_cte(), raw_links_cte(), links_cte(), scored_cte(), *extra]
    return "WITH " + ",\n".join(ctes) + "\n"


def top_links(score: str, k: int | None = 8, name: str = "top") -> str:
    """CTE ``name(page_id, rank, url, text, score)``: best link per URL, top k."""
    best = (f"(SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY {score} DESC, pos) AS rn_url "
            f"FROM sc WHERE {score} >= 3)")
    ranked = (f"(SELECT page_id, url, text, {score} AS score, row_number() OVER "
              f"(PARTITION BY page_id ORDER BY {score} DESC, pos) AS rnk FROM {best} WHERE rn_url = 1)")
    cut = f" WHERE rnk <= {k}" if k is not None else ""
    return (f"{name} AS (SELECT page_id, CAST(rnk AS INTEGER) AS rank, url, text, CAST(score AS INTEGER) AS score "
            f"FROM {ranked}{cut})")


def top_links_per_page_sql(kind: str = "category", k: int = 8) -> str:
    score = "category_score" if kind == "category" else "product_score"
    return with_links(top_links(score, k)) + "SELECT page_id, rank, url, text, score FROM top"


def extract_links_sql() -> str:
    return ("WITH " + ",\n".join([pages_cte(), raw_links_cte()]) +
            "\nSELECT page_id, page_url, pos, href, text FROM raw_links")


def normalize_links_sql() -> str:
    return ("WITH " + ",\n".join([pages_cte(), raw_links_cte(), links_cte()]) +
            "\nSELECT page_id, site, page_url, pos, url, text FROM lk")


def scored_links_sql() -> str:
    return with_links() + ("SELECT page_id, site, page_url, pos, url, text, category_score, product_score "
                           "FROM sc")


def page_title_sql() -> str:
    return f"SELECT page_id, {Q.strip_html(Q.rx_extract('coalesce(html, ' + Q.EMPTY + ')', TITLE_RE, 1))} AS title FROM pages"


__all__ = ["with_links", "top_links", "top_links_per_page_sql", "extract_links_sql",
           "normalize_links_sql", "scored_links_sql", "page_title_sql", "S", "U"]


CARD_CONTAINER_RE2 = (r"""(?is)<(?:div|li|article|section)\b[^>]*(?:\sdata-product-id=|\sclass=["'][^"']*"""
                      r"""(?:productCard|product-card|productItem|product-item)[^"']*["'])[^>]*>(.*?)"""
                      r"""</(?:div|li|article|section)>""")


def contextual_links_sql() -> str:
    vis = Q.rx_replace("coalesce(html, '')", HIDDEN_MARKUP_RE, " ")
    cards = (f"(SELECT page_id, url AS page_url, unnest(regexp_extract_all({vis}, {Q.lit(CARD_CONTAINER_RE2)}, 1)) AS block "
             f"FROM pages)")
    anchors = (f"(SELECT page_id, page_url, unnest(ms) AS m, generate_subscripts(ms, 1) AS pos FROM "
               f"(SELECT page_id, page_url, regexp_extract_all(block, {Q.lit(ANCHOR_RE2)}, 0) AS ms FROM {cards}))")
    href = (f"replace({Q.rx_extract('m', ANCHOR_RE2, 1)} || {Q.rx_extract('m', ANCHOR_RE2, 2)}, '&amp;', '&')")
    staged = Q.stages(f"(SELECT page_id, page_url, pos, {href} AS href FROM {anchors})",
                      *Q.normalise_steps("page_url", "b"), *Q.resolve_steps("href", "b", "link_url"))
    return (f"SELECT page_id, link_url AS url, greatest({Q.score_product('link_url')}, 4) AS score FROM {staged} "
            f"WHERE link_url <> '' AND {Q.same_domain('link_url', 'page_url')}")
