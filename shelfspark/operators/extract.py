"""Product pages -> extraction records -> canonical products.

Row-local per page (no shuffle): JSON-LD blocks are parsed into VARIANT
(``try_parse_json``, bad JSON skipped), flattened one array level and one
``@graph`` level, and the product / breadcrumb nodes picked in document
order; DOM fallbacks come from a bounded CSS selector subset compiled to
regexes.  Unsupported selectors (descendant combinators, pseudo classes)
are reported by :func:`unsupported_selectors` and skipped, never guessed.
"""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import elements as E
from shelfspark.functions.text import fold_text, normalize_whitespace, slugify, strip_html_tags
from shelfspark.functions.urls import (absolute_url, base_parts, clean_url, is_http_url, query_param,
                                       url_origin, url_path)
from shelfspark.operators.common import fence
from shelfspark.operators.products import (DOM_CONFIDENCE, JSONLD_CONFIDENCE, canonical_product, infer_currency,
                                           normalize_currency, parse_price, product_key_id)
from shelfspark.functions.urls import domain_slug

# Default field selectors, in priority order.
FIELD_SELECTORS = {
    "name": ["[itemprop='name']", ".productName", ".product-name", "h1", "meta[property='og:title']@content",
             "meta[name='twitter:title']@content"],
    "description": ["[itemprop='description']", ".productDescription", ".product-description",
                    "meta[name='description']@content"],
    "sku": ["[itemprop='sku']", "[data-product-id]@data-product-id", ".sku", ".product-id"],
    "price": ["[itemprop='price']", "[itemprop='price']@content", ".sales .value", ".price", ".product-price"],
    "currency": ["[itemprop='priceCurrency']", "[itemprop='priceCurrency']@content",
                 ".currency option[selected]@value", ".currency option[selected]"],
    "images": ["a.additionalImage@href", ".additionalImage@href", "a.fancygallery@href", "#ProductImage@src",
               "img.productImage@src", "[itemprop='image']@src", "meta[property='og:image']@content",
               ".product-detail img@src", ".product img@src", "img@src"],
}
# Breadcrumb containers (first that yields link text wins).
BREADCRUMB_CONTAINERS = [".breadCrumbs", "nav[aria-label*='breadcrumb']", "nav[aria-label*='Breadcrumb']",
                         ".breadcrumb"]
# Layout assets never taken as product images.
EXCLUDED_IMAGE_TOKENS = ("/assets/layout/", "/images/site/", "/app_themes/", "processing.gif", "icon_search",
                         "icon_account", "icon_basket", "heart.png", "nav-arrow")
# Category path from URL (whitelisted first segments).
CATEGORY_SEGMENT_RE = r"(?i)^(hombre|mujer|men|women|unisex|ropa|zapatos|bags-accessories|bolsos-accesorios|accessories)$"
SKU_OPTION_RE = r"(?i)[?&]option=([A-Z0-9-]+)"
SKU_CODE_RE = r"(?i)-([A-Z0-9]{5,}-[0-9]{3})($|[?#/])"
SKU_BODY_RE = r"(?i)\bsku\b[\s:#-]*([A-Z0-9._-]+)"
LD_SCRIPT_RE = r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
TITLE_RE = r"(?is)<title[^>]*>(.*?)</title>"
BODY_RE = r"(?is)<body[^>]*>(.*)</body>"
CANONICAL_RE = r"""(?i)<link\b[^>]*\srel=["']canonical["'][^>]*\shref=["']([^"']*)["']"""
HOME_LABELS = ("home", "inicio")
#: The same, read where a page is parsed: classes and cases of ASCII, word ends of any letter, as on the JVM.
_LD_SCRIPT, _TITLE, _CANONICAL = (re.compile(r.replace(r"\b", r"(?u:\b)").replace("(?is)", "").replace("(?i)", ""), f) for r, f in (
    (LD_SCRIPT_RE, re.A | re.I | re.S), (TITLE_RE, re.A | re.I | re.S), (CANONICAL_RE, re.A | re.I)))
#: Fields that take every value of their selectors, not the first alone.
SEVERAL = ("images",)
PAGE_VALUES = "struct<fields:array<array<string>>,body:string,scripts:array<string>,title:string,link:string>"

_ATTR_VALUE = r"""["']([^"']*)["']"""


def _cond(kind: str, name: str, value: str | None) -> str:
    if kind == "class":
        return r"""\sclass=["'](?:[^"']*\s)?""" + re.escape(name) + r"""(?:\s[^"']*)?["']"""
    if kind == "id":
        return r"""\sid=["']""" + re.escape(name) + r"""["']"""
    if value is None:
        return r"\s" + re.escape(name) + r"(?:=|\s|>|/)"
    if kind == "contains":
        return r"\s" + re.escape(name) + r"""=["'][^"']*""" + re.escape(value) + r"""[^"']*["']"""
    return r"\s" + re.escape(name) + r"""=["']""" + re.escape(value) + r"""["']"""


_SIMPLE = re.compile(r"""^([a-zA-Z][a-zA-Z0-9]*)?(?:\.([\w-]+)|#([\w-]+)|\[([\w-]+)(?:(\*?=)['"]([^'"]*)['"])?\])?$""")


def compile_selector(selector: str) -> list[tuple[str, int]] | None:
    """``selector[@attr]`` -> regexes ``(pattern, group)`` whose matches, in
    order, are the candidate values; None when outside the supported subset
    (tag, ``.class``, ``#id``, ``[attr]``, ``[attr='v']``, ``[attr*='v']``,
    one condition, optional tag, optional ``@attr``)."""
    sel, _, attr = selector.partition("@")
    m = _SIMPLE.match(sel.strip())
    if not m or not sel.strip():
        return None
    tag, cls, ident, aname, op, aval = m.groups()
    tag_re = re.escape(tag.lower()) if tag else r"[a-zA-Z][a-zA-Z0-9]*"
    if cls:
        cond = _cond("class", cls, None)
    elif ident:
        cond = _cond("id", ident, None)
    elif aname:
        cond = _cond("contains" if op == "*=" else "equals", aname, aval)
    else:
        cond = ""
    head = r"(?i)<" + tag_re + r"\b"
    if not attr:
        return [(head + r"[^>]*" + cond + r"[^>]*>([^<]*)" if cond else head + r"[^>]*>([^<]*)", 1)]
    a = r"\s" + re.escape(attr) + "=" + _ATTR_VALUE
    if aname and aname == attr and op is None:
        return [(head + r"[^>]*" + a, 1)]
    if not cond:
        return [(head + r"[^>]*" + a, 1)]
    return [(head + r"[^>]*" + cond + r"[^>]*" + a, 1), (head + r"[^>]*" + a + r"[^>]*" + cond, 1)]


def unsupported_selectors(selectors: dict[str, list[str]] = FIELD_SELECTORS) -> list[str]:
    return [s for cands in selectors.values() for s in cands if compile_selector(s) is None]


def decode_entities(col: Column) -> Column:
    c = col
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(ent), F.lit(ch))
    return c


def select_values(html: Column, candidates: list[str], multiple: bool = False) -> Column:
    """First candidate selector yielding a non-empty value: its first value,
    or (``multiple``) all its distinct values."""
    outs = []
    for cand in candidates:
        regs = compile_selector(cand)
        if regs is None:
            continue
        vals = F.concat(*[F.regexp_extract_all(html, F.lit(p), g) for p, g in regs]) if len(regs) > 1 else \
            F.regexp_extract_all(html, F.lit(regs[0][0]), regs[0][1])
        vals = F.filter(F.transform(vals, lambda v: normalize_whitespace(decode_entities(v))), lambda v: v != "")
        outs.append(F.when(F.size(vals) > 0, F.array_distinct(vals) if multiple else F.slice(vals, 1, 1)))
    return F.coalesce(*outs, F.array().cast("array<string>"))


def dom_breadcrumb(html: Column) -> Column:
    """Link texts inside the first breadcrumb container that has any."""
    outs = []
    for cont in BREADCRUMB_CONTAINERS:
        regs = compile_selector(cont)
        if regs is None:
            continue
        pattern = regs[0][0].replace(r"[^>]*>([^<]*)", r"[^>]*>(.*?)</(?:div|nav|ol|ul)>").replace("(?i)", "(?is)")
        block = F.regexp_extract(html, pattern, 1)
        texts = F.transform(F.regexp_extract_all(block, F.lit(r"(?is)<a\b[^>]*>(.*?)</a>"), 1),
                            lambda t: normalize_whitespace(decode_entities(strip_html_tags(t))))
        texts = F.filter(texts, lambda t: t != "")
        outs.append(F.when(F.size(texts) > 0, texts))
    return F.coalesce(*outs, F.array().cast("array<string>"))


def _vstr(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _truthy(v: Column, path: str) -> Column:
    """Text of a JSON value; NULL where it is missing, null, false, the number
    zero or the empty text.  The texts "0" and "false" are values."""
    text = _vstr(v, path)
    is_text = F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING"
    zero = F.coalesce(F.try_variant_get(v, path, "double") == 0, F.lit(False))
    return F.when((text != "") & (is_text | ~(zero | (text == "false"))), text)


def _is_type(n: Column, t: str) -> Column:
    return (F.coalesce(_vstr(n, "$['@type']") == t, F.lit(False))
            | F.coalesce(F.array_contains(F.try_variant_get(n, "$['@type']", "array<string>"), t), F.lit(False)))


def jsonld_node_array(html: Column) -> Column:
    """All JSON-LD nodes of a page in document order (arrays and ``@graph``
    flattened one level each; bad JSON and null entries skipped)."""
    return _jsonld_nodes(F.regexp_extract_all(html, F.lit(LD_SCRIPT_RE), 1))


def _jsonld_nodes(scripts: Column) -> Column:
    parsed = F.filter(F.transform(scripts, lambda s: F.try_parse_json(s)),
                      lambda v: v.isNotNull() & ~F.is_variant_null(v))
    level1 = F.flatten(F.transform(parsed, lambda v: F.coalesce(
        F.try_variant_get(v, "$", "array<variant>"), F.array(v))))
    level2 = F.flatten(F.transform(level1, lambda n: F.coalesce(
        F.try_variant_get(n, "$['@graph']", "array<variant>"),
        F.when(F.try_variant_get(n, "$['@graph']", "variant").isNotNull(),
               F.array(F.try_variant_get(n, "$['@graph']", "variant"))),
        F.array(n))))
    return F.filter(level2, lambda n: n.isNotNull() & ~F.is_variant_null(n))


def _image_values(img: Column) -> Column:
    """JSON-LD image value -> list of strings (string / array / object)."""
    items = F.coalesce(F.try_variant_get(img, "$", "array<variant>"), F.array(img))
    vals = F.transform(items, lambda it: F.coalesce(
        _truthy(it, "$.url"), _truthy(it, "$.contentUrl"), _truthy(it, "$.src"),
        F.when(F.schema_of_variant(it) == "STRING", _vstr(it, "$"))))
    return F.filter(vals, lambda v: v.isNotNull() & (v != ""))


def likely_product_image(v: Column) -> Column:
    low = F.lower(v)
    bad = F.lit(False)
    for tok in EXCLUDED_IMAGE_TOKENS:
        bad = bad | low.contains(tok)
    return (v != "") & ~bad


def page_values(html: str | None, page: E.Page, fields: list[list[E.Selector]]) -> dict:
    """``PAGE_VALUES`` of a parsed page: values of `fields` (those of ``FIELD_SELECTORS``, then
    the breadcrumb and the body), the page's text without markup, JSON-LD texts, title and canonical link."""
    *own, crumbs, body = fields
    values = [list(dict.fromkeys(E.texts(page, s)) if name in SEVERAL else itertools.islice(E.texts(page, s), 1)) for name, s in zip(FIELD_SELECTORS, own, strict=True)]
    text = next(E.texts(page, body), None) or E.plain_text(page.text)
    first = lambda r: None if html is None else found[1] if (found := r.search(html)) else ""
    return {"fields": [*values, list(E.texts(page, crumbs))], "body": text, "scripts": None if html is None else _LD_SCRIPT.findall(html),
            "title": first(_TITLE), "link": first(_CANONICAL)}


def extraction(pages: DataFrame, read: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``extraction(page_id, url, category, name, description, sku, brand,
    price, currency, images, breadcrumb, body_text, title, canonical_url,
    has_jsonld)`` and the columns of ``keep`` -- one row per page, row-local.

    With ``read`` (a column of ``page_values``) fields come from the page's elements,
    so text may be nested and any selector of that module works."""
    # of facts on parsed pages only the columns that are asked for are made
    add = (lambda df, **c: df.withColumns(c)) if read else fence
    p = add(pages.select("page_id", "url", "category", read or "html", *keep),
            _nodes=_jsonld_nodes(F.col(read)["scripts"]) if read else jsonld_node_array(F.col("html")), _base=base_parts("url"))
    p = add(p,
            _prod=F.coalesce(F.try_element_at(F.filter("_nodes", lambda n: _is_type(n, "Product")), F.lit(1)),
                               F.try_element_at(F.filter("_nodes", lambda n: _truthy(n, "$.sku").isNotNull()
                                                         | _truthy(n, "$.offers").isNotNull()
                                                         | _truthy(n, "$.image").isNotNull()), F.lit(1))),
            _bc=F.try_element_at(F.filter("_nodes", lambda n: _is_type(n, "BreadcrumbList")), F.lit(1)))
    prod = F.col("_prod")
    offer = F.coalesce(F.try_element_at(F.try_variant_get(prod, "$.offers", "array<variant>"), F.lit(1)),
                       F.try_variant_get(prod, "$.offers", "variant"))
    if read:
        got = F.col(read)
        sel = {k: got["fields"][i] for i, k in enumerate(FIELD_SELECTORS)}
        crumb_texts, body_text, title, canonical_href = got["fields"][len(FIELD_SELECTORS)], got["body"], got["title"], got["link"]
    else:
        sel = {k: select_values(F.col("html"), v, multiple=(k == "images")) for k, v in FIELD_SELECTORS.items()}
        crumb_texts = dom_breadcrumb(F.col("html"))
        body_text = decode_entities(F.regexp_replace(F.regexp_extract("html", BODY_RE, 1), "<[^>]+>", ""))
        title, canonical_href = F.regexp_extract("html", TITLE_RE, 1), F.regexp_extract("html", CANONICAL_RE, 1)

    def first(k):
        return F.try_element_at(sel[k], F.lit(1))

    items = F.try_variant_get(F.col("_bc"), "$.itemListElement", "array<variant>")
    crumbs = F.filter(F.transform(items, lambda it: F.coalesce(
        _truthy(it, "$.name"), _truthy(it, "$.item.name"), _truthy(it, "$.item"))),
        lambda x: x.isNotNull())
    brand_obj_name = _truthy(prod, "$.brand.name")
    brand_str = F.when(F.schema_of_variant(F.try_variant_get(prod, "$.brand", "variant")) == "STRING",
                       _vstr(prod, "$.brand"))
    ld_images = _image_values(F.try_variant_get(prod, "$.image", "variant"))
    images = F.when(_truthy(prod, "$.image").isNotNull(), ld_images).otherwise(sel["images"])
    out = p.select(
        "page_id", "url", "category", "_base", *keep,
        F.coalesce(_truthy(prod, "$.name"), first("name"), F.lit("")).alias("name"),
        F.coalesce(_truthy(prod, "$.description"), first("description"), F.lit("")).alias("description"),
        F.coalesce(_truthy(prod, "$.sku"), _truthy(prod, "$.mpn"), first("sku"), F.lit("")).alias("sku"),
        F.coalesce(brand_obj_name, F.nullif(brand_str, F.lit("")), F.lit("")).alias("brand"),
        F.coalesce(_truthy(offer, "$.price"), _truthy(offer, "$.lowPrice"), first("price"),
                   F.lit("")).alias("price"),
        normalize_currency(F.coalesce(_truthy(offer, "$.priceCurrency"), first("currency"),
                                      infer_currency(F.coalesce(first("price"), F.lit(""))))).alias("currency"),
        F.filter(images, likely_product_image).alias("images"),
        F.when(F.col("_bc").isNotNull(), F.coalesce(crumbs, F.array().cast("array<string>")))
        .otherwise(crumb_texts).alias("breadcrumb"),
        body_text.alias("body_text"),
        F.trim(decode_entities(title)).alias("title"),
        canonical_href.alias("_canonical_href"),
        prod.isNotNull().alias("has_jsonld"),
    )
    return add(out, canonical_url=absolute_url(F.col("_canonical_href"), F.col("_base"))).drop("_canonical_href")


def format_category_label(col) -> Column:
    """Normaliser's label: drop ``-c123``/``-p123`` before an extension, dashes
    and underscores -> space, drop the extension and anything from a
    ``cgid``/``pid`` word on, capitalise word starts (rest kept)."""
    c = F.regexp_replace(F.coalesce(col, F.lit("")), r"(?i)-([cp])[0-9]+(\.[a-z0-9]+)$", "$2")
    c = F.regexp_replace(c, "[-_]+", " ")
    c = F.regexp_replace(c, r"(?i)\.[a-z0-9]+$", "")
    c = F.trim(F.regexp_replace(c, r"(?i)\b(cgid|pid)\b.*$", ""))
    words = F.filter(F.split(c, " "), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")


def category_path_from_url(url, label=format_category_label) -> Column:
    segs = F.transform(F.filter(F.split(url_path(url), "/"), lambda s: s != ""),
                       lambda s: F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s))
    offset = F.when(F.coalesce(F.try_element_at(segs, F.lit(1)), F.lit("")).contains("_"), 1).otherwise(0)
    cand = F.slice(segs, offset + 1, 2)
    both_ok = F.forall(cand, lambda s: s.rlike(CATEGORY_SEGMENT_RE))
    labels = F.transform(cand, lambda s: label(s))
    return F.when(F.size(cand) < 2, F.filter(labels, lambda s: s != "")) \
        .when(both_ok, labels).otherwise(F.array().cast("array<string>"))


def normalize_sku(value, body, url) -> Column:
    v = normalize_whitespace(value)
    return F.coalesce(
        F.nullif(F.regexp_extract(v, SKU_OPTION_RE, 1), F.lit("")),
        F.nullif(F.regexp_extract(v, SKU_CODE_RE, 1), F.lit("")),
        F.when((v != "") & ~v.rlike(r"(?i)^https?://"), v),
        F.nullif(F.regexp_extract(F.coalesce(body, F.lit("")), SKU_BODY_RE, 1), F.lit("")),
        F.nullif(query_param(url, "pid"), F.lit("")),
        F.substring(slugify(url), 1, 50))


def normalize_extraction(ex: DataFrame, default_currency: str = "USD", keep: tuple[str, ...] = ()) -> DataFrame:
    """Extraction + page URL + category context -> canonical product.

    The context is the whole path ``context`` where there is such a column,
    else the one name ``category``; the columns of ``keep`` are passed on."""
    if "_base" not in ex.columns:
        ex = fence(ex, _base=base_parts("url"))
    crumbs = F.filter(F.filter(F.transform("breadcrumb", lambda b: normalize_whitespace(b)), lambda b: b != ""),
                      lambda b: ~fold_text(b).isin(*HOME_LABELS))
    ctx = F.col("context") if "context" in ex.columns else F.array("category")
    e = fence(ex, _crumbs=F.when(F.size(crumbs) > 0, crumbs).otherwise(ctx),
              _url_trail=category_path_from_url(F.col("url")),
              _images=F.transform("images", lambda i: absolute_url(i, F.col("_base"))),
              _sku=normalize_sku(F.col("sku"), F.col("body_text"), F.col("url")),
              _purl=clean_url(F.when(F.col("canonical_url") != "", F.col("canonical_url")).otherwise(F.col("url"))))
    path = F.when(F.size("_url_trail") >= 2, F.col("_url_trail")).otherwise(F.col("_crumbs"))
    path_value = F.array_join(path, " > ")
    raw = e.select(
        "page_id", *keep, F.col("url").alias("page_url"),
        product_key_id(F.col("_sku"), F.col("name"), F.col("url")).alias("product_id"),
        normalize_whitespace(F.when(F.col("name") != "", F.col("name")).otherwise(F.col("title"))).alias("name"),
        normalize_whitespace(strip_html_tags("description")).alias("description"),
        F.col("_sku").alias("sku"),
        parse_price("price").alias("price"),
        F.when(F.col("currency") != "", F.col("currency")).otherwise(F.lit(default_currency)).alias("currency"),
        normalize_whitespace("brand").alias("brand"),
        F.col("_purl").alias("product_url"),
        path_value.alias("category_path"),
        path.alias("category_trail"),
        F.when(path_value != "", F.array(path_value)).otherwise(F.array().cast("array<string>"))
        .alias("all_category_paths"),
        F.filter(F.col("_images"), lambda i: (i != "") & is_http_url(i)).alias("image_urls"),
        url_origin("url").alias("source_site"),
        F.when(F.col("has_jsonld"), F.lit("jsonld+dom")).otherwise(F.lit("dom")).alias("source_type"),
        F.when(F.col("has_jsonld"), F.lit(JSONLD_CONFIDENCE)).otherwise(F.lit(DOM_CONFIDENCE)).alias("source_confidence"),
        F.col("has_jsonld"),
    )
    return canonical_product(raw)


def extract_products(pages: DataFrame, default_currency: str = "USD") -> DataFrame:
    """Product pages -> canonical products (row-local, no shuffle)."""
    return normalize_extraction(extraction(pages), default_currency)


__all__ = ["extraction", "extract_products", "normalize_extraction", "compile_selector", "unsupported_selectors",
           "domain_slug"]
