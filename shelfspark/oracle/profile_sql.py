"""Oracle SQL (DuckDB) for page inspection and site profiles."""

from __future__ import annotations

from shelfspark.functions import scoring as S
from shelfspark.operators import profile as P
from shelfspark.oracle import links_sql as LQ
from shelfspark.oracle import sqlfn as Q


def _signals(h: str) -> dict[str, str]:
    low = f"lower(coalesce({h}, ''))"
    toks = ", ".join(f"CASE WHEN contains({low}, {Q.lit(n)}) THEN {Q.lit(t)} END" for n, t in S.PLATFORM_TOKENS)
    return {
        "has_search_input": Q.rx_match(f"coalesce({h}, '')", S.SEARCH_INPUT_RE),
        "has_jsonld_product": Q.any_contains(low, S.JSONLD_PRODUCT_MARKERS),
        "has_add_to_cart": Q.rx_match(f"coalesce({h}, '')", S.ADD_TO_CART_RE),
        "has_price_nodes": Q.rx_match(f"coalesce({h}, '')", S.PRICE_NODE_RE),
        "has_pagination": Q.rx_match(f"coalesce({h}, '')", S.PAGINATION_RE),
        "platform_tokens": f"list_filter([{toks}], lambda t: t IS NOT NULL)",
    }


def page_type(req: str, url: str, n_cat: str, n_prod: str, jsonld: str, cart: str, price: str) -> str:
    r = f"coalesce({req}, '')"
    purchase = f"({cart} AND {price})"
    return (f"(CASE WHEN {r} = 'search' OR {Q.rx_match(f'coalesce({url}, {Q.EMPTY})', '(?i)search')} THEN 'search' "
            f"WHEN {r} = 'pdp' AND ({jsonld} OR {purchase}) THEN 'pdp' "
            f"WHEN {n_prod} >= 6 OR ({r} = 'plp' AND {n_prod} >= 3) THEN 'plp' "
            f"WHEN {jsonld} OR {purchase} THEN 'pdp' "
            f"WHEN {r} = 'home' OR {n_cat} >= 4 THEN 'home' "
            f"WHEN {r} <> '' THEN {r} ELSE 'unknown' END)")


def profile_ctes() -> list[str]:
    sig = ", ".join(f"{e} AS {n}" for n, e in _signals("html").items())
    clean = Q.stages("(SELECT page_id, site, url, html FROM pg)", *Q.normalise_steps("url", "u"),
                     *Q.clean_steps("unorm", "clean_url", "cu"))
    title = Q.strip_html(Q.rx_extract("coalesce(html, '')", LQ.TITLE_RE, 1))
    return [
        LQ.top_links("category_score", 8, "topc"),
        LQ.top_links("product_score", 8, "topp"),
        (f"pmeta AS (SELECT page_id, site, url, page_id AS seq, clean_url, {title} AS title, {sig} FROM {clean})"),
        ("pp AS (SELECT m.*, CAST(coalesce(c.n, 0) AS INTEGER) AS n_cat, CAST(coalesce(d.n, 0) AS INTEGER) AS n_prod, "
         "coalesce(c.urls, []::VARCHAR[]) AS top_category_urls, coalesce(d.urls, []::VARCHAR[]) AS top_product_urls "
         "FROM pmeta m "
         "LEFT JOIN (SELECT page_id, count(*) AS n, list(url ORDER BY rank) AS urls FROM topc GROUP BY page_id) c USING (page_id) "
         "LEFT JOIN (SELECT page_id, count(*) AS n, list(url ORDER BY rank) AS urls FROM topp GROUP BY page_id) d USING (page_id))"),
        ("home AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY seq, page_id) AS rn FROM pp) "
         "WHERE rn = 1)"),
        ("plp AS (SELECT * EXCLUDE (rn) FROM (SELECT p.*, row_number() OVER (PARTITION BY p.site ORDER BY p.seq, p.page_id) AS rn "
         "FROM pp p JOIN home h ON p.site = h.site AND p.clean_url = h.top_category_urls[1] "
         "WHERE h.top_category_urls[1] <> h.clean_url) WHERE rn = 1)"),
        ("pdp_seed AS (SELECT h.site, h.clean_url AS home_url, l.clean_url AS plp_url, "
         "coalesce(h.top_product_urls[1], l.top_product_urls[1]) AS seed FROM home h LEFT JOIN plp l ON h.site = l.site)"),
        ("pdp AS (SELECT * EXCLUDE (rn) FROM (SELECT p.*, row_number() OVER (PARTITION BY p.site ORDER BY p.seq, p.page_id) AS rn "
         "FROM pp p JOIN pdp_seed s ON p.site = s.site AND p.clean_url = s.seed "
         "WHERE s.seed <> s.home_url AND (s.plp_url IS NULL OR s.seed <> s.plp_url)) WHERE rn = 1)"),
        ("samples0 AS (SELECT * EXCLUDE (rn), 'home' AS type_requested, 'input' AS source, 0 AS slot FROM home "
         "UNION ALL SELECT *, 'plp', 'auto', 1 FROM plp UNION ALL SELECT *, 'pdp', 'auto', 2 FROM pdp)"),
        (f"samples AS (SELECT *, {page_type('type_requested', 'url', 'n_cat', 'n_prod', 'has_jsonld_product', 'has_add_to_cart', 'has_price_nodes')} "
         "AS detected_type FROM samples0)"),
    ] + site_ctes()


def site_ctes() -> list[str]:
    urls = "list_concat([url], top_product_urls, top_category_urls)"
    hay = f"list_concat({urls}, platform_tokens)"

    def any_in(lst: str, pattern: str) -> str:
        return f"bool_or(len(list_filter({lst}, lambda v: {Q.rx_match('v', pattern)})) > 0)"

    aggs = [f"{any_in(hay, p)} AS plat{i}" for i, (_, _, p) in enumerate(P.PLATFORM_RULES)]
    aggs.append(f"bool_or(len(list_filter(platform_tokens, lambda v: {Q.rx_match('v', P.LEGACY_TOKEN_RE)})) > 0 "
                f"OR len(list_filter({urls}, lambda v: {Q.rx_match('v', P.LEGACY_URL_RE)})) > 0) AS legacy")
    aggs += [f"{any_in(urls, p)} AS cat{i}" for i, (_, p) in enumerate(P.CATEGORY_PATTERNS)]
    aggs += [f"{any_in(urls, p)} AS prod{i}" for i, (_, p) in enumerate(P.PRODUCT_PATTERNS)]
    aggs += [
        "arg_min(url, slot) AS entry_url",
        "count(*) FILTER (WHERE type_requested <> 'home') AS typed",
        ("count(*) FILTER (WHERE type_requested <> 'home' AND ((source = 'input' AND type_requested = 'plp') "
         "OR detected_type = type_requested)) AS matches"),
        "bool_or(has_jsonld_product) AS jsonld",
        "bool_or(n_prod > 0 OR n_cat > 0) AS has_candidates",
        "bool_or(detected_type = 'plp') AS has_plp",
        "bool_or(detected_type = 'pdp') AS has_pdp",
        "CAST(count(*) AS INTEGER) AS n_samples",
    ]
    n = len(P.PLATFORM_RULES)
    conds = [f"plat{i}" for i in range(n)] + ["legacy"]
    hints = [h for h, _, _ in P.PLATFORM_RULES] + [P.LEGACY[0]]
    confs = [c for _, c, _ in P.PLATFORM_RULES] + [P.LEGACY[1]]
    hint = "CASE " + " ".join(f"WHEN {c} THEN {Q.lit(h)}" for c, h in zip(conds, hints)) + f" ELSE {Q.lit(P.GENERIC[0])} END"
    conf = "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in zip(conds, confs)) + f" ELSE {P.GENERIC[1]} END"
    catp = "list_filter([" + ", ".join(f"CASE WHEN cat{i} THEN {Q.lit(t)} END" for i, (t, _) in enumerate(P.CATEGORY_PATTERNS)) + "], lambda x: x IS NOT NULL)"
    prodp = "list_filter([" + ", ".join(f"CASE WHEN prod{i} THEN {Q.lit(t)} END" for i, (t, _) in enumerate(P.PRODUCT_PATTERNS)) + "], lambda x: x IS NOT NULL)"
    return [
        f"sagg AS (SELECT site, {', '.join(aggs)} FROM samples GROUP BY site)",
        (f"sp0 AS (SELECT *, {hint} AS platform_hint, CAST({conf} AS DOUBLE) AS platform_confidence, "
         f"{catp} AS category_patterns, {prodp} AS product_patterns FROM sagg)"),
        ("sp AS (SELECT *, round(greatest(0.0, least(1.0, platform_confidence * 0.6 + "
         "(CASE WHEN typed > 0 THEN matches / typed ELSE 0.5 END) * 0.2 + "
         "least(0.2, (len(category_patterns) + len(product_patterns)) * 0.05))), 2) AS confidence FROM sp0)"),
    ]


def with_profiles(*extra: str) -> str:
    return LQ.with_links(*profile_ctes(), *extra)


def page_signals_sql() -> str:
    sig = ", ".join(f"{e} AS {n}" for n, e in _signals("html").items())
    return (f"SELECT page_id, has_search_input, has_jsonld_product, has_add_to_cart, has_price_nodes, "
            f"has_pagination, array_to_string(platform_tokens, ',') AS platform_tokens FROM (SELECT page_id, {sig} FROM pages)")


def page_profile_sql() -> str:
    pt = page_type("NULL", "url", "n_cat", "n_prod", "has_jsonld_product", "has_add_to_cart", "has_price_nodes")
    return with_profiles() + (
        "SELECT page_id, site, title, clean_url, n_cat, n_prod, array_to_string(top_category_urls, ' ') AS top_category_urls, "
        f"array_to_string(top_product_urls, ' ') AS top_product_urls, {pt} AS detected_type FROM pp")


def sample_slots_sql() -> str:
    return with_profiles() + "SELECT site, page_id, type_requested, source, detected_type FROM samples"


def site_profile_sql() -> str:
    defaults = "[" + ", ".join(Q.lit(p) for p in S.DEFAULT_INCLUDE) + "]"
    inc = f"list_concat({defaults}, list_filter(category_patterns, lambda x: NOT list_contains({defaults}, x)))"
    return with_profiles() + (
        "SELECT site, regexp_replace(site, '^www\\.', '') AS domain, entry_url, platform_hint, platform_confidence, "
        "array_to_string(category_patterns, ' ') AS category_patterns, array_to_string(product_patterns, ' ') AS product_patterns, "
        f"array_to_string({inc}, ' ') AS include_patterns, "
        "CASE WHEN jsonld THEN 'jsonld dom' ELSE 'dom' END AS preferred_sources, confidence, has_plp, has_pdp, n_samples FROM sp")


def learning_candidates_sql() -> str:
    return with_profiles() + (
        "SELECT site, type, confidence, pattern FROM ("
        "SELECT site, 'platform-logic-candidate' AS type, CAST(0.65 AS DOUBLE) AS confidence, CAST(NULL AS VARCHAR) AS pattern "
        "FROM sp WHERE platform_hint = 'generic' AND has_candidates "
        "UNION ALL SELECT site, 'product-pattern-candidate', 0.7, product_patterns[1] FROM sp "
        "WHERE platform_hint = 'generic' AND len(product_patterns) > 0 "
        "UNION ALL SELECT site, 'category-pattern-candidate', 0.7, category_patterns[1] FROM sp "
        "WHERE platform_hint = 'generic' AND len(category_patterns) > 0)")


def profile_actions_sql() -> str:
    weak = f"(platform_hint = 'generic' AND confidence < {P.PROFILE_ACTION_MIN_CONFIDENCE})"
    reasons = (f"list_filter([CASE WHEN NOT has_plp THEN 'no_plp' END, CASE WHEN NOT has_pdp THEN 'no_pdp' END, "
               f"CASE WHEN {weak} THEN 'low_confidence' END], lambda x: x IS NOT NULL)")
    inputs = (f"list_filter([CASE WHEN NOT has_plp THEN 'plp_url' END, CASE WHEN NOT has_pdp THEN 'pdp_url' END, "
              f"CASE WHEN {weak} THEN 'search_url' END], lambda x: x IS NOT NULL)")
    return with_profiles() + (
        f"SELECT site, CASE WHEN len(r) > 0 THEN 'needs_user_input' ELSE 'not_needed' END AS status, "
        f"CASE WHEN len(r) = 0 THEN 'none' WHEN NOT has_plp OR NOT has_pdp THEN 'blocking' ELSE 'advisory' END AS severity, "
        f"array_to_string(r, ' ') AS reasons, array_to_string(i, ' ') AS requested_inputs, "
        f"(platform_hint <> 'generic' AND len(r) = 0) AS auto_ready "
        f"FROM (SELECT *, {reasons} AS r, {inputs} AS i FROM sp)")
