"""Oracle SQL (DuckDB) for product-page extraction (JSON-LD + DOM subset)."""

from __future__ import annotations

from shelfspark.operators import extract as E
from shelfspark.operators import products as PR
from shelfspark.oracle import products_sql as RQ
from shelfspark.oracle import sqlfn as Q
from shelfspark.sources.fixtures import PRODUCT_PAGES_SQL


def decode(x: str) -> str:
    c = x
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        c = f"replace({c}, {Q.lit(ent)}, {Q.lit(ch)})"
    return c


def select_values(html: str, candidates: list[str], multiple: bool = False) -> str:
    outs = []
    for cand in candidates:
        regs = E.compile_selector(cand)
        if regs is None:
            continue
        parts = [f"regexp_extract_all({html}, {Q.lit(p)}, {g})" for p, g in regs]
        vals = parts[0] if len(parts) == 1 else f"list_concat({', '.join(parts)})"
        vals = f"list_filter(list_transform({vals}, lambda v: {Q.ws(decode('v'))}), lambda v: v <> '')"
        pick = (f"list_filter({vals}, lambda v, k: NOT list_contains({vals}[1:k - 1], v))" if multiple
                else f"{vals}[1:1]")
        outs.append(f"CASE WHEN len({vals}) > 0 THEN {pick} END")
    return f"coalesce({', '.join(outs)}, []::VARCHAR[])"


def dom_breadcrumb(html: str) -> str:
    outs = []
    for cont in E.BREADCRUMB_CONTAINERS:
        regs = E.compile_selector(cont)
        if regs is None:
            continue
        pat = regs[0][0].replace(r"[^>]*>([^<]*)", r"[^>]*>(.*?)</(?:div|nav|ol|ul)>").replace("(?i)", "(?is)")
        block = f"regexp_extract({html}, {Q.lit(pat)}, 1)"
        texts = (f"list_filter(list_transform(regexp_extract_all({block}, {Q.lit('(?is)<a\\b[^>]*>(.*?)</a>')}, 1), "
                 f"lambda t: {Q.ws(decode(Q.strip_tags('t')))}), lambda t: t <> '')")
        outs.append(f"CASE WHEN len({texts}) > 0 THEN {texts} END")
    return f"coalesce({', '.join(outs)}, []::VARCHAR[])"


def js(n: str, key: str) -> str:
    """String of ``n.key`` (key may be a dotted path)."""
    path = "$." + ".".join(f'"{k}"' for k in key.split("."))
    return f"json_extract_string({n}, {Q.lit(path)})"


def jv(n: str, key: str) -> str:
    path = "$." + ".".join(f'"{k}"' for k in key.split("."))
    return f"json_extract({n}, {Q.lit(path)})"


def truthy(n: str, key: str) -> str:
    """Missing, null, false, zero and empty texts are skipped; other texts stay."""
    text = js(n, key)
    return (f"(CASE WHEN {text} <> '' AND (json_type({jv(n, key)}) = 'VARCHAR' OR "
            f"({text} <> 'false' AND coalesce(try_cast({text} AS DOUBLE) <> 0, true))) THEN {text} END)")


def is_type(n: str, t: str) -> str:
    ty = jv(n, "@type")
    return (f"(coalesce({js(n, '@type')} = {Q.lit(t)}, false) OR coalesce(json_type({ty}) = 'ARRAY' AND "
            f"list_contains(json_extract_string({ty}, '$[*]'), {Q.lit(t)}), false))")


def extraction_ctes() -> list[str]:
    ld = f"regexp_extract_all(html, {Q.lit(E.LD_SCRIPT_RE)}, 1)"
    nodes = [
        PRODUCT_PAGES_SQL.strip(),
        (f"s0 AS (SELECT page_id, unnest({ld}) AS s, generate_subscripts({ld}, 1) AS si FROM f3)"),
        ("s1 AS (SELECT page_id, si, CAST(s AS JSON) AS j FROM s0 WHERE json_valid(s) AND json_type(CAST(s AS JSON)) <> 'NULL')"),
        ("s2 AS (SELECT page_id, si, unnest(l) AS j, generate_subscripts(l, 1) AS i1 FROM (SELECT page_id, si, "
         "CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') ELSE [j] END AS l FROM s1))"),
        ("s3 AS (SELECT page_id, si, i1, unnest(l) AS n, generate_subscripts(l, 1) AS i2 FROM (SELECT page_id, si, i1, "
         "CASE WHEN json_type(json_extract(j, '$.\"@graph\"')) = 'ARRAY' THEN json_extract(json_extract(j, '$.\"@graph\"'), '$[*]') "
         "WHEN json_extract(j, '$.\"@graph\"') IS NOT NULL AND json_type(json_extract(j, '$.\"@graph\"')) <> 'NULL' "
         "THEN [json_extract(j, '$.\"@graph\"')] ELSE [j] END AS l FROM s2))"),
        ("nodes AS (SELECT * FROM s3 WHERE n IS NOT NULL AND json_type(n) <> 'NULL')"),
        (f"pnode AS (SELECT page_id, coalesce(arg_min(n, si * 1000000 + i1 * 1000 + i2) FILTER (WHERE {is_type('n', 'Product')}), "
         f"arg_min(n, si * 1000000 + i1 * 1000 + i2) FILTER (WHERE {truthy('n', 'sku')} IS NOT NULL OR "
         f"{truthy('n', 'offers')} IS NOT NULL OR {truthy('n', 'image')} IS NOT NULL)) AS prod, "
         f"arg_min(n, si * 1000000 + i1 * 1000 + i2) FILTER (WHERE {is_type('n', 'BreadcrumbList')}) AS bc "
         "FROM nodes GROUP BY page_id)"),
    ]
    sel = {k: select_values("html", v, multiple=(k == "images")) for k, v in E.FIELD_SELECTORS.items()}

    def first(k):
        return f"{sel[k]}[1]"

    offer = (f"(CASE WHEN json_type({jv('prod', 'offers')}) = 'ARRAY' THEN json_extract(prod, '$.offers[0]') "
             f"ELSE {jv('prod', 'offers')} END)")
    img = jv("prod", "image")
    items = f"(CASE WHEN json_type({img}) = 'ARRAY' THEN json_extract({img}, '$[*]') ELSE [{img}] END)"
    ld_images = (f"list_filter(list_transform({items}, lambda it: coalesce({truthy('it', 'url')}, "
                 f"{truthy('it', 'contentUrl')}, {truthy('it', 'src')}, "
                 f"CASE WHEN json_type(it) = 'VARCHAR' THEN json_extract_string(it, '$') END)), "
                 "lambda v: v IS NOT NULL AND v <> '')")
    excl = " OR ".join(f"contains(lower(v), {Q.lit(t)})" for t in E.EXCLUDED_IMAGE_TOKENS)
    crumbs = (f"list_filter(list_transform(json_extract({jv('bc', 'itemListElement')}, '$[*]'), lambda it: coalesce("
              f"{truthy('it', 'name')}, {truthy('it', 'item.name')}, {truthy('it', 'item')})), "
              "lambda x: x IS NOT NULL)")
    brand_str = f"(CASE WHEN json_type({jv('prod', 'brand')}) = 'VARCHAR' THEN {js('prod', 'brand')} END)"
    body = Q.rx_replace(Q.rx_extract("html", E.BODY_RE, 1), "<[^>]+>", "")
    offer_currency = truthy(offer, "priceCurrency")
    price_sign = RQ.infer_currency(f"coalesce({first('price')}, '')")
    currency = RQ.normalize_currency(f"coalesce({offer_currency}, {first('currency')}, {price_sign})")
    ex = (
        "ex0 AS (SELECT f.page_id, f.url, f.category, f.html, pn.prod, pn.bc FROM f3 f LEFT JOIN pnode pn USING (page_id))",
        (f"ex AS (SELECT page_id, url, category, "
         f"coalesce({truthy('prod', 'name')}, {first('name')}, '') AS name, "
         f"coalesce({truthy('prod', 'description')}, {first('description')}, '') AS description, "
         f"coalesce({truthy('prod', 'sku')}, {truthy('prod', 'mpn')}, {first('sku')}, '') AS sku, "
         f"coalesce({truthy('prod', 'brand.name')}, nullif({brand_str}, ''), '') AS brand, "
         f"coalesce({truthy(offer, 'price')}, {truthy(offer, 'lowPrice')}, {first('price')}, '') AS price, "
         f"{currency} AS currency, "
         f"list_filter(CASE WHEN {truthy('prod', 'image')} IS NOT NULL THEN {ld_images} ELSE {sel['images']} END, "
         f"lambda v: v <> '' AND NOT ({excl})) AS images, "
         f"CASE WHEN bc IS NOT NULL THEN coalesce({crumbs}, []::VARCHAR[]) ELSE {dom_breadcrumb('html')} END AS breadcrumb, "
         f"{decode(body)} AS body_text, trim({decode(Q.rx_extract('html', E.TITLE_RE, 1))}) AS title, "
         f"{Q.rx_extract('html', E.CANONICAL_RE, 1)} AS canonical_href, prod IS NOT NULL AS has_jsonld FROM ex0)"),
    )
    return nodes + list(ex)


def with_extraction(*extra: str) -> str:
    return "WITH " + ",\n".join([*extraction_ctes(), *extra]) + "\n"


def extraction_sql() -> str:
    return with_extraction() + (
        f"SELECT page_id, name, description, sku, brand, {RQ.parse_price('price')} AS price, currency, "
        "array_to_string(images, ' | ') AS images, "
        "array_to_string(breadcrumb, ' | ') AS breadcrumb, title, has_jsonld FROM ex")


__all__ = ["extraction_sql", "with_extraction", "PR"]


def format_label(x: str) -> str:
    c = f"regexp_replace(coalesce({x}, ''), '(?i)-([cp])[0-9]+(\\.[a-z0-9]+)$', '\\2')"
    c = Q.rx_replace(c, "[-_]+", " ")
    c = f"regexp_replace({c}, '(?i)\\.[a-z0-9]+$', '')"
    c = f"trim(regexp_replace({c}, '(?i)\\b(cgid|pid)\\b.*$', ''))"
    return (f"array_to_string(list_transform(list_filter(string_split({c}, ' '), lambda w: w <> ''), "
            f"lambda w: upper(w[1]) || w[2:]), ' ')")


def category_path_from_url(url: str) -> str:
    segs = (f"list_transform(list_filter(string_split({Q.url_path(url)}, '/'), lambda s: s <> ''), "
            f"lambda s: coalesce(TRY(url_decode(s)), s))")
    off = f"(CASE WHEN contains(coalesce({segs}[1], ''), '_') THEN 1 ELSE 0 END)"
    cand = f"list_slice({segs}, {off} + 1, {off} + 2)"
    labels = f"list_transform({cand}, lambda s: {format_label('s')})"
    ok = f"len(list_filter({cand}, lambda s: NOT {Q.rx_match('s', E.CATEGORY_SEGMENT_RE)})) = 0"
    return (f"(CASE WHEN len({cand}) < 2 THEN list_filter({labels}, lambda s: s <> '') "
            f"WHEN {ok} THEN {labels} ELSE []::VARCHAR[] END)")


def normalize_sku(value: str, body: str, url: str) -> str:
    v = Q.ws(value)
    pid = ("(SELECT url_decode(replace(regexp_extract(p, '^[^=]*=(.*)$', 1), '+', ' ')) FROM "
           f"(SELECT list_filter(string_split(regexp_extract(coalesce({url}, ''), '^[^?#]*\\?([^#]*)', 1), '&'), "
           "lambda q: url_decode(replace(split_part(q, '=', 1), '+', ' ')) = 'pid')[1] AS p))")
    return (f"coalesce(nullif({Q.rx_extract(v, E.SKU_OPTION_RE, 1)}, ''), nullif({Q.rx_extract(v, E.SKU_CODE_RE, 1)}, ''), "
            f"CASE WHEN {v} <> '' AND NOT {Q.rx_match(v, '(?i)^https?://')} THEN {v} END, "
            f"nullif({Q.rx_extract(f'coalesce({body}, {Q.EMPTY})', E.SKU_BODY_RE, 1)}, ''), nullif({pid}, ''), "
            f"substr({Q.slug(url)}, 1, 50))")


def extract_products_ctes() -> list[str]:
    crumbs0 = (f"list_filter(list_filter(list_transform(breadcrumb, lambda b: {Q.ws('b')}), lambda b: b <> ''), "
               f"lambda b: NOT ({Q.fold('b')} IN ('home', 'inicio')))")
    staged = Q.stages("(SELECT * FROM ex)", *Q.normalise_steps("url", "b"),
                      *Q.resolve_steps("canonical_href", "b", "canonical_url"))
    img_rows = Q.stages("(SELECT page_id, url, unnest(images) AS href, generate_subscripts(images, 1) AS ii FROM ex)",
                        *Q.normalise_steps("url", "b"), *Q.resolve_steps("href", "b", "img"))
    return [
        f"exu AS (SELECT * FROM {staged})",
        (f"eimg AS (SELECT page_id, list(img ORDER BY ii) FILTER (WHERE img <> '' AND "
         f"{Q.rx_match('img', '(?i)^https?://')}) AS imgs FROM {img_rows} GROUP BY page_id)"),
        (f"en0 AS (SELECT e.*, coalesce(i.imgs, []::VARCHAR[]) AS imgs, {crumbs0} AS crumbs0, "
         f"{category_path_from_url('e.url')} AS url_trail, {normalize_sku('e.sku', 'e.body_text', 'e.url')} AS nsku, "
         f"CASE WHEN canonical_url <> '' THEN canonical_url ELSE url END AS curl FROM exu e LEFT JOIN eimg i USING (page_id))"),
        (f"en1 AS (SELECT *, CASE WHEN len(url_trail) >= 2 THEN url_trail WHEN len(crumbs0) > 0 THEN crumbs0 "
         f"ELSE [category] END AS trail FROM en0)"),
    ] + [
        (f"eprod0 AS (SELECT *, {Q.slug('coalesce(nullif(nsku, ' + Q.EMPTY + '), nullif(name, ' + Q.EMPTY + '), url)')} AS pid0 FROM en1)"),
    ]


def extract_products_sql() -> str:
    clean = Q.stages("(SELECT * FROM eprod0)", *Q.clean_steps("curl", "purl0", "pc"),
                     *RQ.http_url_steps("purl0", "purl", "pv"))
    path = "array_to_string(trail, ' > ')"
    return with_extraction(*extract_products_ctes()) + (
        f"SELECT page_id, CASE WHEN pid0 <> '' THEN pid0 ELSE {RQ.domain_slug('url')} END AS product_id, "
        f"{Q.ws('CASE WHEN name <> ' + Q.EMPTY + ' THEN name ELSE title END')} AS name, "
        f"{Q.ws(Q.strip_tags('description'))} AS description, nsku AS sku, {RQ.parse_price('price')} AS price, "
        f"CASE WHEN currency <> '' THEN currency ELSE 'USD' END AS currency, {Q.ws('brand')} AS brand, "
        f"purl AS product_url, coalesce(trail[1], '') AS category, coalesce(trail[2], '') AS subcategory, "
        f"{Q.ws(path)} AS category_path, array_to_string(trail, ' > ') AS category_trail, "
        f"array_to_string(imgs[1:3], ' | ') AS image_urls, {RQ.origin('url')} AS source_site, "
        f"CASE WHEN has_jsonld THEN 'jsonld+dom' ELSE 'dom' END AS source_type, "
        f"CAST(CASE WHEN has_jsonld THEN 0.8 ELSE 0.55 END AS DOUBLE) AS source_confidence FROM {clean}")
