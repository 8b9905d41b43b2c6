"""Oracle SQL (DuckDB) for canonical products, merge and catalog quality."""

from __future__ import annotations

from shelfspark.operators import products as PR
from shelfspark.oracle import sqlfn as Q
from shelfspark.sources.fixtures import PRODUCT_OBSERVATIONS_SQL


def parse_price(x: str) -> str:
    cand = Q.rx_replace(f"coalesce({x}, '')", r"[^0-9,.\-]", "")
    return (f"(SELECT CASE WHEN num = '' OR num = '-' OR TRY_CAST(num AS DECIMAL(38,10)) IS NULL THEN '' "
            f"ELSE CAST(CAST(round(TRY_CAST(num AS DECIMAL(38,10)), 2) AS DECIMAL(38,2)) AS VARCHAR) END FROM ("
            f"SELECT regexp_extract(CASE WHEN contains(c, ',') AND contains(c, '.') AND {Q.rx_match('c', ',[^.]*$')} "
            f"THEN regexp_replace(replace(c, '.', ''), '^([^,]*),', '\\1.') "
            f"WHEN contains(c, ',') AND contains(c, '.') THEN replace(c, ',', '') "
            f"ELSE regexp_replace(c, '^([^,]*),', '\\1.') END, {Q.lit(PR.PRICE_PREFIX)}, 0) AS num "
            f"FROM (SELECT {cand} AS c)))")


def normalize_currency(x: str) -> str:
    n = f"upper({Q.ws(x)})"
    whens = " ".join(f"WHEN {n} = {Q.lit(k)} THEN {Q.lit(v)}" for k, v in PR.CURRENCY_MAP)
    whens += " " + " ".join(f"WHEN contains({n}, {Q.lit(k)}) THEN {Q.lit(v)}" for k, v in PR.CURRENCY_CONTAINS)
    return f"(CASE {whens} ELSE {n} END)"


def infer_currency(x: str) -> str:
    c = f"coalesce({x}, '')"
    return "(CASE " + " ".join(f"WHEN contains({c}, {Q.lit(s)}) THEN {Q.lit(v)}" for s, v in PR.CURRENCY_SIGNS) + " ELSE '' END)"


def http_url_steps(src: str, dst: str, p: str) -> list[dict]:
    """Steps computing column ``dst`` = normalise+clean of ``src`` if http."""
    steps = Q.normalise_steps(src, p) + Q.clean_steps(f"{p}norm", f"{p}_cl", f"{p}c")
    steps.append({dst: f"(CASE WHEN {Q.rx_match(f'coalesce({src}, {Q.EMPTY})', '(?i)^https?://')} THEN {p}_cl ELSE '' END)"})
    return steps


def origin(x: str) -> str:
    return Q.rx_extract(f"coalesce({x}, '')", r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)


def domain_slug(x: str) -> str:
    return f"replace(regexp_replace({Q.host(x)}, '^www\\.', ''), '.', '-')"


def products_cte() -> list[str]:
    """``prod``: canonical product per F2 sighting (same columns as Spark)."""
    staged = Q.stages("(SELECT * FROM obs)", *http_url_steps("product_url", "purl", "pu"),
                      *http_url_steps("image", "img", "im"), *Q.normalise_steps("site", "st"))
    sku, name = Q.ws("sku"), Q.ws("name")
    key_src = f"coalesce(nullif({sku}, ''), nullif({name}, ''), purl)"
    pid = f"(CASE WHEN {Q.slug(key_src)} <> '' THEN {Q.slug(key_src)} ELSE {domain_slug('purl')} END)"
    cur = normalize_currency(f"coalesce(nullif(regexp_extract(price_text, '[A-Z]{{3}}', 0), ''), {infer_currency('price_text')})")
    seed = Q.ws("category_path")
    trail = f"list_filter(list_transform(string_split({seed}, '>'), lambda t: {Q.ws('t')}), lambda t: t <> '')"
    return [
        PRODUCT_OBSERVATIONS_SQL.strip(),
        (f"prod AS (SELECT seq, site, {pid} AS product_id, {sku} AS sku, {name} AS name, {Q.ws('description')} AS description, "
         f"{Q.ws('brand')} AS brand, {parse_price('price_text')} AS price, "
         f"(CASE WHEN {cur} <> '' THEN {cur} ELSE {Q.lit(PR.DEFAULT_CURRENCY)} END) AS currency, purl AS product_url, "
         f"coalesce({trail}[1], '') AS category, coalesce({trail}[2], '') AS subcategory, "
         f"{Q.ws(seed)} AS category_path, {trail} AS category_trail, "
         f"(CASE WHEN {Q.ws(seed)} <> '' THEN [{Q.ws(seed)}] ELSE []::VARCHAR[] END) AS all_category_paths, "
         f"(CASE WHEN img <> '' THEN [img] ELSE []::VARCHAR[] END) AS image_urls, "
         f"(CASE WHEN {Q.rx_match('coalesce(site, ' + Q.EMPTY + ')', '(?i)^https?://')} THEN {origin('stnorm')} "
         f"WHEN purl <> '' THEN {origin('purl')} ELSE '' END) AS source_site, "
         f"'dom' AS source_type, CAST({PR.DOM_CONFIDENCE} AS DOUBLE) AS source_confidence FROM {staged})"),
    ]


def merged_cte() -> list[str]:
    scal = ", ".join(f"coalesce(arg_max({c}, seq) FILTER (WHERE {c} <> ''), '') AS {c}" for c in PR.SCALARS)
    return [
        "kp AS (SELECT *, coalesce(nullif(sku, ''), nullif(product_id, ''), product_url) AS product_key FROM prod)",
        (f"mbase AS (SELECT site, product_key, {scal}, arg_max(category_trail, seq) AS category_trail, "
         "arg_max(source_confidence, seq) AS source_confidence, min(seq) AS first_seq, max(seq) AS last_seq, "
         "count(*) AS sightings FROM kp GROUP BY site, product_key)"),
        ("mpath AS (SELECT site, product_key, list(v ORDER BY s, i) AS paths FROM (SELECT site, product_key, v, "
         "arg_min(i, seq * 1000 + i) AS i, min(seq) AS s FROM (SELECT site, product_key, seq, "
         "unnest(all_category_paths) AS v, generate_subscripts(all_category_paths, 1) AS i FROM kp) "
         "GROUP BY site, product_key, v) GROUP BY site, product_key)"),
        ("mimg AS (SELECT site, product_key, list(v ORDER BY s, i) AS imgs FROM (SELECT *, row_number() OVER "
         "(PARTITION BY site, product_key ORDER BY s, i) AS r FROM (SELECT site, product_key, v, "
         "arg_min(i, seq * 1000 + i) AS i, min(seq) AS s FROM (SELECT site, product_key, seq, "
         "unnest(image_urls) AS v, generate_subscripts(image_urls, 1) AS i FROM kp) "
         f"GROUP BY site, product_key, v)) WHERE r <= {PR.MAX_IMAGES} GROUP BY site, product_key)"),
        ("merged AS (SELECT b.*, coalesce(p.paths, []::VARCHAR[]) AS all_category_paths, "
         "coalesce(m.imgs, []::VARCHAR[]) AS image_urls FROM mbase b LEFT JOIN mpath p USING (site, product_key) "
         "LEFT JOIN mimg m USING (site, product_key))"),
    ]


def with_products(*extra: str) -> str:
    return "WITH " + ",\n".join([*products_cte(), *extra]) + "\n"


def with_merged(*extra: str) -> str:
    return with_products(*merged_cte(), *extra)


PRODUCT_COLS = ("site, product_id, sku, name, description, brand, price, currency, product_url, category, "
                "subcategory, category_path, array_to_string(category_trail, ' > ') AS category_trail, "
                "array_to_string(all_category_paths, ' | ') AS all_category_paths, "
                "array_to_string(image_urls, ' | ') AS image_urls, source_site, source_type, source_confidence")


def canonical_product_sql() -> str:
    return with_products() + f"SELECT seq, {PRODUCT_COLS} FROM prod"


def parse_price_sql() -> str:
    return with_products() + f"SELECT seq, price_text, {parse_price('price_text')} AS price FROM obs"


def merge_products_sql() -> str:
    return with_merged() + f"SELECT product_key, {PRODUCT_COLS}, first_seq, last_seq, sightings FROM merged"


# ------------------------------------------------------------ quality
def _fail(field: str) -> str:
    return {
        "productId": "product_id = ''", "name": "name = ''", "sku": "sku = ''", "price": "price = ''",
        "productUrl": "product_url = ''", "imageUrls": "len(image_urls) = 0",
        "categoryPath": "(category_path = '' AND len(all_category_paths) = 0)",
    }[field]


def product_issues_sql() -> str:
    from shelfspark.operators.quality import ISSUE_RULES
    key = "coalesce(nullif(product_id, ''), nullif(sku, ''), nullif(product_url, ''), 'unknown-product')"
    parts = [f"SELECT site, product_key, {key} AS report_key, {n} AS rule_no, '{lvl}' AS level, '{fld}' AS field "
             f"FROM merged WHERE {_fail(fld)}" for n, (lvl, fld) in enumerate(ISSUE_RULES, start=1)]
    return with_merged() + " UNION ALL ".join(parts)


def _validated() -> str:
    from shelfspark.operators.quality import ISSUE_RULES
    err = " + ".join(f"CAST({_fail(f)} AS INTEGER)" for lv, f in ISSUE_RULES if lv == "error")
    warn = " + ".join(f"CAST({_fail(f)} AS INTEGER)" for lv, f in ISSUE_RULES if lv == "warning")
    return f"val AS (SELECT *, {err} AS error_count, {warn} AS warning_count FROM merged)"


def summary_cte() -> str:
    return ("summ AS (SELECT site, count(*) AS product_count, count(*) FILTER (WHERE error_count = 0) AS valid_products, "
            "count(*) FILTER (WHERE error_count > 0) AS products_with_errors, "
            "count(*) FILTER (WHERE warning_count > 0) AS products_with_warnings, "
            "CAST(sum(error_count) AS BIGINT) AS error_count, CAST(sum(warning_count) AS BIGINT) AS warning_count, "
            "round(count(*) FILTER (WHERE price <> '') / count(*), 4) AS price_coverage, "
            "round(count(*) FILTER (WHERE len(image_urls) > 0) / count(*), 4) AS image_coverage, "
            "round(count(*) FILTER (WHERE category_path <> '' OR len(all_category_paths) > 0) / count(*), 4) "
            "AS category_coverage FROM val GROUP BY site)")


def catalog_summary_sql() -> str:
    return with_merged(_validated(), summary_cte()) + "SELECT * FROM summ"


def pct(x: str) -> str:
    return f"CAST(CAST(floor({x} * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%'"


def catalog_warnings_sql() -> str:
    return with_merged(_validated(), summary_cte()) + (
        "SELECT site, 'no_products' AS code, '' AS detail FROM summ WHERE product_count = 0 UNION ALL "
        f"SELECT site, 'low_price_coverage', {pct('price_coverage')} FROM summ WHERE product_count > 0 AND price_coverage < 0.5 UNION ALL "
        f"SELECT site, 'low_image_coverage', {pct('image_coverage')} FROM summ WHERE product_count > 0 AND image_coverage < 0.5 UNION ALL "
        f"SELECT site, 'low_category_coverage', {pct('category_coverage')} FROM summ WHERE product_count > 0 AND category_coverage < 0.5")


def distinct_cats_cte() -> str:
    return ("dcat AS (SELECT site, count(DISTINCT p) AS distinct_categories FROM (SELECT site, "
            "trim(unnest(list_concat([category_path], all_category_paths))) AS p FROM merged) WHERE p <> '' GROUP BY site)")


def distinct_category_count_sql() -> str:
    return with_merged(distinct_cats_cte()) + "SELECT site, distinct_categories FROM dcat"


def quality_actions_sql() -> str:
    def low(c: str) -> str:
        return f"({c} > 0 AND {c} < 0.8)"
    reasons = [("coalesce(d.distinct_categories, 0) = 0", "no_categories", ["plp_url", "home_url"]),
               ("product_count = 0", "no_products", ["plp_url", "pdp_url"]),
               (low("price_coverage"), "low_price_coverage", ["pdp_url"]),
               (low("image_coverage"), "low_image_coverage", ["pdp_url"]),
               (low("category_coverage"), "low_category_coverage", ["plp_url"])]
    rlist = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{code}' END" for c, code, _ in reasons) + "], lambda x: x IS NOT NULL)"
    ilist = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{i}' END" for c, _, ins in reasons for i in ins) + "], lambda x: x IS NOT NULL)"
    return with_merged(_validated(), summary_cte(), distinct_cats_cte()) + (
        "SELECT site, CASE WHEN len(r) > 0 THEN 'needs_user_input' ELSE 'not_needed' END AS status, "
        "CASE WHEN len(r) = 0 THEN 'none' WHEN nc OR np THEN 'blocking' ELSE 'advisory' END AS severity, "
        "array_to_string(r, ' ') AS reasons, "
        "array_to_string(list_filter(i, lambda x, k: NOT list_contains(i[1:k - 1], x)), ' ') AS requested_inputs "
        f"FROM (SELECT s.site, {rlist} AS r, {ilist} AS i, coalesce(d.distinct_categories, 0) = 0 AS nc, "
        "product_count = 0 AS np FROM summ s LEFT JOIN dcat d USING (site))")


# ------------------------------------------------------------ categories
def tree_cte() -> str:
    segs = "list_filter(list_transform(string_split(p, '>'), lambda s: trim(s)), lambda s: s <> '')"
    return ("tree AS (SELECT site, array_to_string(path, ' > ') AS full_path, "
            f"{Q.slug('fp')} AS id, path[-1] AS name, path, CAST(len(path) AS INTEGER) AS depth, "
            f"CASE WHEN len(path) > 1 THEN {Q.slug('array_to_string(path[1:len(path) - 1], ' + Q.lit(' > ') + ')')} ELSE '' END AS parent_id "
            "FROM (SELECT DISTINCT site, path, array_to_string(path, ' > ') AS fp FROM (SELECT site, "
            f"list_slice(segs, 1, unnest(range(1, len(segs) + 1))) AS path FROM (SELECT site, {segs} AS segs FROM "
            "(SELECT site, unnest(all_category_paths) AS p FROM merged))) WHERE len(path) > 0))")


def category_tree_sql() -> str:
    return with_merged(tree_cte()) + "SELECT site, full_path, id, name, array_to_string(path, ' > ') AS path, depth, parent_id FROM tree"


def assignments_cte() -> str:
    primary = ("CASE WHEN category_path <> '' AND list_contains(all_category_paths, category_path) "
               "THEN category_path ELSE all_category_paths[1] END")
    leaves0 = f"list_filter(list_concat([{primary}], all_category_paths), lambda x: x IS NOT NULL AND x <> '')"
    segs = "list_filter(list_transform(string_split(leaf, '>'), lambda s: trim(s)), lambda s: s <> '')"
    expanded = (f"flatten(list_transform(leaves, lambda leaf: list_concat([leaf], list_transform(range(1, len({segs})), "
                f"lambda k: array_to_string({segs}[1:k], ' > ')))))")
    return (
        f"asg0 AS (SELECT site, product_id, pp, list_filter(l0, lambda x, k: NOT list_contains(l0[1:k - 1], x)) AS leaves "
        f"FROM (SELECT site, product_id, {primary} AS pp, {leaves0} AS l0 FROM merged)), "
        f"asg1 AS (SELECT site, product_id, pp, list_concat(['All Products'], {expanded}) AS e0 FROM asg0), "
        "asg2 AS (SELECT site, product_id, pp, unnest(e) AS path, generate_subscripts(e, 1) - 1 AS ord FROM "
        "(SELECT *, list_filter(e0, lambda x, k: NOT list_contains(e0[1:k - 1], x)) AS e FROM asg1)), "
        "asg AS (SELECT a.site, a.product_id, CASE WHEN a.path = 'All Products' THEN 'all' ELSE t.id END AS category_id, "
        "a.path, (a.path = a.pp OR (a.path = 'All Products' AND a.pp IS NULL)) AS \"primary\", CAST(a.ord AS INTEGER) AS ord "
        "FROM asg2 a LEFT JOIN tree t ON a.site = t.site AND a.path = t.full_path "
        "WHERE a.path = 'All Products' OR t.id IS NOT NULL)")


def category_assignments_sql() -> str:
    return with_merged(tree_cte(), assignments_cte()) + 'SELECT site, product_id, category_id, path, "primary", ord FROM asg'


# ------------------------------------------------------------ exports
def brand_cte() -> str:
    from shelfspark.operators.exports import DEFAULTS as D
    slug_b = Q.slug("brand_name")

    def bid(v: str) -> str:
        s = Q.slug(Q.lit(v))
        s = f"(CASE WHEN {s} = '' THEN 'catalog' ELSE {s} END)"
        return f"(CASE WHEN brand_slug = '' OR contains({s}, brand_slug) THEN {s} ELSE brand_slug || '-' || {s} END)"
    pbn = Q.lit(D["pricebook_name"])
    return ("brand0 AS (SELECT site, coalesce(arg_min(brand, first_seq) FILTER (WHERE brand <> ''), 'Brand') AS brand_name "
            "FROM merged GROUP BY site), "
            f"brand1 AS (SELECT site, brand_name, CASE WHEN {slug_b} <> '' THEN {slug_b} ELSE 'brand' END AS brand_slug FROM brand0), "
            f"brand AS (SELECT site, brand_name, brand_slug, {bid(D['catalog_id'])} AS catalog_id, "
            f"{bid(D['pricebook_id'])} AS pricebook_id, {bid(D['inventory_list_id'])} AS inventory_list_id, "
            f"CASE WHEN contains({Q.fold(pbn)}, {Q.fold('brand_name')}) THEN {pbn} ELSE trim(brand_name || ' ' || {pbn}) END "
            "AS pricebook_name FROM brand1)")


def catalog_brand_sql() -> str:
    return with_merged(brand_cte()) + "SELECT * FROM brand"


def _cur() -> str:
    return "CASE WHEN currency <> '' THEN currency ELSE 'USD' END"


def catalog_currencies_sql() -> str:
    return with_merged() + (
        f"SELECT DISTINCT site, {_cur()} AS currency, false AS mirrored FROM merged UNION ALL "
        "SELECT site, 'USD', true FROM merged GROUP BY site HAVING NOT bool_or(" + _cur() + " = 'USD')")


def pricebook_entries_sql() -> str:
    return with_merged(brand_cte()) + (
        "SELECT e.site, b.pricebook_id || '-' || lower(e.currency) AS pricebook_id, e.currency, e.product_id, e.price FROM ("
        f"SELECT site, {_cur()} AS currency, product_id, price FROM merged WHERE price <> '' AND {_cur()} <> 'USD' "
        "UNION ALL SELECT site, 'USD', product_id, price FROM merged WHERE price <> '') e JOIN brand b USING (site)")


def image_path(x: str) -> str:
    u = f"coalesce({x}, '')"
    path = Q.url_path(u)
    query = Q.rx_extract(u, r"^[^?#]*(\?[^#]*)?", 1)
    after = f"coalesce(string_split({path}, '/is/image/')[2], '')"
    return (f"(CASE WHEN contains({path}, '/is/image/') THEN {after} ELSE "
            f"{Q.rx_replace(path, '^/+', '')} END || {query})")


def image_groups_sql() -> str:
    return with_merged() + (
        f"SELECT site, product_id, view_type, CAST(pos AS INTEGER) AS pos, {image_path('img')} AS path FROM ("
        "SELECT site, product_id, unnest(['hi-res', 'large']) AS view_type, image_urls FROM merged), "
        "LATERAL (SELECT unnest(image_urls) AS img, generate_subscripts(image_urls, 1) AS pos)")


def shared_image_dir_sql() -> str:
    origin_re = r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)"
    host_re = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)"
    return with_merged(
        "imgs AS (SELECT site, first_seq, unnest(image_urls) AS img, generate_subscripts(image_urls, 1) AS pos FROM merged)",
        f"firsti AS (SELECT site, arg_min(img, first_seq * 1000 + pos) AS first_img FROM imgs GROUP BY site)",
        f"fo AS (SELECT site, first_img, {Q.rx_extract('first_img', origin_re, 1)} AS origin, "
        f"lower({Q.rx_extract('first_img', host_re, 1)}) AS host FROM firsti)",
        f"mm AS (SELECT i.site, min({Q.url_path('i.img')}) AS lo, max({Q.url_path('i.img')}) AS hi FROM imgs i JOIN fo "
        f"ON i.site = fo.site AND {Q.rx_extract('i.img', origin_re, 1)} = fo.origin GROUP BY i.site)",
    ) + (
        "SELECT site, 'http://' || host || shared AS http_url, origin || shared AS https_url FROM ("
        f"SELECT fo.*, CASE WHEN contains({Q.url_path('first_img')}, '/is/image/') THEN '/is/image/' "
        "ELSE (CASE WHEN ends_with(cd, '/') THEN cd ELSE cd || '/' END) END AS shared FROM fo LEFT JOIN ("
        "SELECT site, CASE WHEN lo IS NULL OR ls <= 1 THEN '/' ELSE prefix[1:ls] END AS cd FROM ("
        "SELECT site, lo, prefix, CASE WHEN strpos(prefix, '/') = 0 THEN 0 ELSE length(prefix) - strpos(reverse(prefix), '/') + 1 END AS ls "
        "FROM (SELECT site, lo, lo[1:coalesce(list_max(list_filter(range(0, least(length(lo), length(hi)) + 1), "
        "lambda k: lo[1:k] = hi[1:k])), 0)] AS prefix FROM mm))) d USING (site))")


def generic_csv_sql() -> str:
    return with_merged() + (
        "SELECT site, product_id, name, description, sku, price, currency, brand, category, subcategory, category_path, "
        "array_to_string(all_category_paths, ' | ') AS all_category_paths, product_url, "
        "coalesce(image_urls[1], '') AS image_1, coalesce(image_urls[2], '') AS image_2, "
        "coalesce(image_urls[3], '') AS image_3, source_site FROM merged")


def b2b_csv_sql() -> str:
    from shelfspark.operators.exports import DEFAULTS as D
    return with_merged() + (
        "SELECT site, name AS \"Product Name\", CASE WHEN sku <> '' THEN sku ELSE product_id END AS \"Product SKU\", "
        "description AS \"Product Description\", category_path AS \"Category Name Path\", "
        f"{Q.lit(D['pricebook_name'])} AS \"Price Book Name\", name AS \"Price Book Entry Name\", price AS \"List Price\", "
        f"{_cur()} AS \"Currency ISO Code\", 'Active' AS \"Product Status\", "
        "coalesce(image_urls[1], '') AS \"Primary Image URL\", coalesce(image_urls[2], '') AS \"Secondary Image URL\", "
        "coalesce(image_urls[3], '') AS \"Tertiary Image URL\", product_id AS \"External ID\", product_url AS \"Product URL\" "
        "FROM merged")


def cards_cte() -> str:
    search = ("lower(concat_ws(' ', " + ", ".join(f"nullif({c}, '')" for c in
                                              ("name", "sku", "description", "category_path", "brand")) + "))")
    desc = Q.ws("CASE WHEN description <> '' THEN description ELSE 'Sin descripción' END")
    short = f"(CASE WHEN length({desc}) <= 220 THEN {desc} ELSE rtrim(substr({desc}, 1, 219)) || '…' END)"
    return (f"cards AS (SELECT site, product_id, {search} AS search, category_path AS category, "
            "CASE WHEN name <> '' THEN name ELSE product_id END AS title, "
            "CASE WHEN price = '' THEN 'Sin precio' ELSE trim(price || ' ' || currency) END AS price_label, "
            "CASE WHEN sku <> '' THEN sku ELSE product_id END AS sku_chip, "
            "CASE WHEN category_path <> '' THEN category_path ELSE 'Sin categoría' END AS category_chip, "
            "CASE WHEN brand <> '' THEN brand ELSE 'Sin marca' END AS brand_chip, "
            f"{short} AS description, array_to_string(image_urls[1:3], ' ') AS thumbs, product_url, first_seq FROM merged)")


def catalog_cards_sql() -> str:
    return with_merged(cards_cte()) + "SELECT * FROM cards"


def search_cards_sql(query: str, category: str) -> str:
    return with_merged(cards_cte()) + (
        f"SELECT * FROM cards WHERE contains(search, {Q.lit(query.strip().lower())}) AND category = {Q.lit(category)}")


def catalog_stats_sql() -> str:
    return with_merged() + ("SELECT site, count(*) AS products, count(DISTINCT nullif(category_path, '')) AS category_paths "
                            "FROM merged GROUP BY site")


def _inventory_rows() -> str:
    """CTEs up to ``rows(site, section, k, line)`` of the inventory document."""
    from shelfspark.sources.sinks import INVENTORY_NS, XML_DECL
    x = Q.xml_escape
    opening = (f"'<inventory xmlns=\"{INVENTORY_NS}\"><inventory-list><header list-id=\"' || {x('inventory_list_id')} || "
               "'\"><default-instock>true</default-instock><description>' || "
               f"{x(Q.lit('Inventario perpetuo generado para ') + ' || brand_name')} || "
               "'</description><use-bundle-inventory-only>false</use-bundle-inventory-only><on-order>false</on-order>"
               "</header><records>'")
    return with_merged(brand_cte(), (
        f"rows AS (SELECT site, 0 AS section, 0::BIGINT AS k, {Q.lit(XML_DECL)} AS line FROM brand UNION ALL SELECT site, 1, 0, {opening} FROM brand UNION ALL "
        f"SELECT site, 2, first_seq, '<record product-id=\"' || {x('product_id')} || '\"><perpetual>true</perpetual></record>' "
        "FROM merged UNION ALL SELECT site, 9, 0, '</records></inventory-list></inventory>' FROM brand)"))


def inventory_lines_sql() -> str:
    return _inventory_rows() + "SELECT site, line FROM rows"


def _digests(order: str) -> str:
    return ("SELECT site, count(*) AS lines, CAST(sum(CAST('0x' || substr(md5(n || ':' || line), 1, 10) AS BIGINT)) AS BIGINT) AS digest FROM ("
            f"SELECT site, line, row_number() OVER (PARTITION BY site ORDER BY {order}) AS n FROM rows) GROUP BY site")


def inventory_digest_sql() -> str:
    return _inventory_rows() + _digests("section, k")


def _pricebook_rows() -> str:
    """CTEs up to ``rows(site, section, k1, k2, line)`` of the pricebook document."""
    from shelfspark.sources.sinks import PRICEBOOK_NS, XML_DECL
    x = Q.xml_escape
    book = ("'<pricebook><header pricebook-id=\"' || " + x("pricebook_id || '-' || lower(currency)") + " || '\"><currency>' || " + x("currency")
            + " || '</currency><display-name xml:lang=\"x-default\">' || " + x("pricebook_name || ' ' || currency")
            + " || '</display-name><description xml:lang=\"x-default\">' || " + x("'Pricebook generado desde ' || site")
            + " || '</description><online-flag>true</online-flag><feed-based>false</feed-based></header><price-tables>'")
    row = f"'<price-table product-id=\"' || {x('product_id')} || '\"><amount quantity=\"1\">' || {x('price')} || '</amount></price-table>'"
    return with_merged(
        brand_cte(), f"firsts AS (SELECT site, {_cur()} AS currency, min(first_seq) AS k1 FROM merged GROUP BY ALL)",
        "bks AS (SELECT * FROM firsts UNION ALL SELECT site, 'USD', 1000000000000000 FROM firsts GROUP BY site HAVING NOT bool_or(currency = 'USD'))",
        "bk AS (SELECT b.*, pricebook_id, pricebook_name FROM bks b JOIN brand USING (site))",
        "rows AS ("
        f"SELECT site, 0 AS section, 0::BIGINT AS k1, 0 AS part, 0::BIGINT AS k2, {Q.lit(XML_DECL)} AS line FROM brand UNION ALL "
        f"SELECT site, 0, 0, 1, 0, '<pricebooks xmlns=\"{PRICEBOOK_NS}\">' FROM brand UNION ALL "
        f"SELECT site, 1, k1, 0, 0, {book} FROM bk UNION ALL "
        f"SELECT m.site, 1, k1, 1, first_seq, {row} FROM merged m JOIN bk ON bk.site = m.site AND (bk.currency = 'USD' OR bk.currency = {_cur().replace('currency', 'm.currency')}) "
        "WHERE price <> '' UNION ALL "
        "SELECT site, 1, k1, 2, 0, '</price-tables></pricebook>' FROM bk UNION ALL "
        "SELECT site, 9, 0, 0, 0, '</pricebooks>' FROM brand)")


def pricebook_lines_sql() -> str:
    return _pricebook_rows() + "SELECT site, line FROM rows"


def pricebook_digest_sql() -> str:
    return _pricebook_rows() + _digests("section, k1, part, k2")


def image_dir_ctes() -> list[str]:
    origin_re = r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)"
    host_re = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)"
    return [
        "imgs AS (SELECT site, first_seq, unnest(image_urls) AS img, generate_subscripts(image_urls, 1) AS pos FROM merged)",
        "firsti AS (SELECT site, arg_min(img, first_seq * 1000 + pos) AS first_img FROM imgs GROUP BY site)",
        (f"fo AS (SELECT site, first_img, {Q.rx_extract('first_img', origin_re, 1)} AS origin, "
         f"lower({Q.rx_extract('first_img', host_re, 1)}) AS host FROM firsti)"),
        (f"mm AS (SELECT i.site, min({Q.url_path('i.img')}) AS lo, max({Q.url_path('i.img')}) AS hi FROM imgs i JOIN fo "
         f"ON i.site = fo.site AND {Q.rx_extract('i.img', origin_re, 1)} = fo.origin GROUP BY i.site)"),
        ("imgdir AS (SELECT site, 'http://' || host || shared AS http_url, origin || shared AS https_url FROM ("
         f"SELECT fo.*, CASE WHEN contains({Q.url_path('first_img')}, '/is/image/') THEN '/is/image/' "
         "ELSE (CASE WHEN ends_with(cd, '/') THEN cd ELSE cd || '/' END) END AS shared FROM fo LEFT JOIN ("
         "SELECT site, CASE WHEN lo IS NULL OR ls <= 1 THEN '/' ELSE prefix[1:ls] END AS cd FROM ("
         "SELECT site, lo, prefix, CASE WHEN strpos(prefix, '/') = 0 THEN 0 ELSE length(prefix) - strpos(reverse(prefix), '/') + 1 END AS ls "
         "FROM (SELECT site, lo, lo[1:coalesce(list_max(list_filter(range(0, least(length(lo), length(hi)) + 1), "
         "lambda k: lo[1:k] = hi[1:k])), 0)] AS prefix FROM mm))) d USING (site)))"),
    ]


def catalog_lines_sql() -> str:
    from shelfspark.sources.sinks import CATALOG_NS, XML_DECL
    x = Q.xml_escape
    header = ("CASE WHEN https_url IS NULL THEN '<header />' ELSE '<header><image-settings><external-location><http-url>' || "
              f"{x('http_url')} || '</http-url><https-url>' || {x('https_url')} || '</https-url></external-location>"
              "<view-types><view-type>hi-res</view-type><view-type>large</view-type><view-type>medium</view-type>"
              "<view-type>small</view-type></view-types><alt-pattern>${productname}</alt-pattern>"
              "<title-pattern>${productname}</title-pattern></image-settings></header>' END")
    nodes = ("nodes AS (SELECT site, id, name, path, parent_id FROM tree UNION ALL "
             "SELECT DISTINCT site, 'root', 'Root', ['Root'], '' FROM merged UNION ALL "
             "SELECT DISTINCT site, 'all', 'All Products', ['All Products'], 'root' FROM merged)")
    eff = "CASE WHEN parent_id <> '' THEN parent_id WHEN id <> 'root' THEN 'root' ELSE '' END"
    cat_line = (f"'<category category-id=\"' || {x('id')} || '\"><display-name xml:lang=\"x-default\">' || {x('name')} || "
                f"'</display-name><description xml:lang=\"x-default\">' || {x("array_to_string(path, ' > ')")} || "
                "'</description><online-flag>true</online-flag>' || CASE WHEN (" + eff + ") <> '' THEN '<parent>' || "
                + x(eff) + " || '</parent>' ELSE '' END || '<template /><page-attributes /><custom-attributes>"
                "<custom-attribute attribute-id=\"showInMenu\">true</custom-attribute></custom-attributes></category>'")
    name = x("name")
    desc = x("CASE WHEN description <> '' THEN description ELSE name END")
    img = (f"'<image path=\"' || {x(image_path('u'))} || '\"><alt xml:lang=\"x-default\">' || {name} || "
           f"'</alt><title xml:lang=\"x-default\">' || {name} || '</title></image>'")
    imgs = f"array_to_string(list_transform(image_urls, lambda u: {img}), '')"
    groups = (f"'<image-group view-type=\"hi-res\">' || {imgs} || '</image-group>' || "
              f"'<image-group view-type=\"large\">' || {imgs} || '</image-group>'")
    prod_line = (f"'<product product-id=\"' || {x('product_id')} || '\"><display-name xml:lang=\"x-default\">' || {name} || "
                 f"'</display-name><short-description xml:lang=\"x-default\">' || {desc} || '</short-description>"
                 f"<long-description xml:lang=\"x-default\">' || {desc} || '</long-description><online-flag>true</online-flag>"
                 "<available-flag>true</available-flag><searchable-flag>true</searchable-flag>' || "
                 f"CASE WHEN len(image_urls) > 0 THEN '<images>' || {groups} || '</images>' ELSE '' END || "
                 f"CASE WHEN brand <> '' THEN '<brand>' || {x('brand')} || '</brand>' ELSE '' END || "
                 "'<page-attributes /><pinterest-enabled-flag>false</pinterest-enabled-flag><facebook-enabled-flag>false"
                 "</facebook-enabled-flag><store-attributes><force-price-flag>false</force-price-flag><non-inventory-flag>"
                 "false</non-inventory-flag><non-revenue-flag>false</non-revenue-flag><non-discountable-flag>false"
                 "</non-discountable-flag></store-attributes></product>'")
    asg_line = (f"'<category-assignment category-id=\"' || {x('a.category_id')} || '\" product-id=\"' || {x('a.product_id')} || "
                "'\"><primary-flag>' || CASE WHEN a.\"primary\" THEN 'true' ELSE 'false' END || "
                "'</primary-flag></category-assignment>'")
    return with_merged(tree_cte(), assignments_cte(), brand_cte(), *image_dir_ctes(), nodes) + (
        f"SELECT site, {Q.lit(XML_DECL)} AS line FROM brand UNION ALL "
        f"SELECT site, '<catalog xmlns=\"{CATALOG_NS}\" catalog-id=\"' || {x('catalog_id')} || '\">' FROM brand UNION ALL "
        f"SELECT b.site, {header} FROM brand b LEFT JOIN imgdir USING (site) UNION ALL "
        f"SELECT site, {cat_line} FROM nodes UNION ALL "
        f"SELECT site, {prod_line} FROM merged UNION ALL "
        f"SELECT a.site, {asg_line} FROM asg a UNION ALL "
        "SELECT site, '</catalog>' FROM brand")
