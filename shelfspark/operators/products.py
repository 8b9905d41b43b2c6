"""Canonical products, normalisation scalars and the merge of sightings.

Merge semantics (per ``(site, key)``, ``key = sku || product_id || url``):
scalars take the last non-empty value by ``seq``; ``category_trail`` and the
confidence take the last value even when empty; ``all_category_paths`` is
the ordered distinct union and ``image_urls`` the first three ordered
distinct images.  All of it is built from partial aggregates
(``max_by``/``min``) and per-element de-duplication *before* any collect, so
a product seen millions of times never gathers its sightings in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.text import let, normalize_whitespace, slugify
from shelfspark.functions.urls import (clean_url, domain_slug, is_http_url, normalise_url, url_origin)
from shelfspark.operators.common import fence

DEFAULT_CURRENCY = "USD"
JSONLD_CONFIDENCE = 0.8
DOM_CONFIDENCE = 0.55
MAX_IMAGES = 3
# Currency spellings mapped to ISO codes (after upper-casing).
CURRENCY_MAP = (
    ("€", "EUR"), ("EUR", "EUR"), ("EURO", "EUR"), ("1", "EUR"),
    ("£", "GBP"), ("GBP", "GBP"), ("GREAT BRITISH POUND", "GBP"), ("2", "GBP"),
    ("$", "USD"), ("USD", "USD"), ("DOLLAR", "USD"),
)
CURRENCY_CONTAINS = (("EURO", "EUR"), ("POUND", "GBP"), ("DOLLAR", "USD"))
CURRENCY_SIGNS = (("€", "EUR"), ("£", "GBP"), ("$", "USD"))
PRICE_PREFIX = r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)"

SCALARS = ("product_id", "sku", "name", "description", "brand", "price", "currency", "product_url",
           "category", "subcategory", "category_path", "source_site", "source_type")


def _s(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def parse_price(col) -> Column:
    """Locale-aware price text -> two-decimal string ('' when no number).

    Keep digits , . - ; with both separators the later one is the decimal
    mark; a lone comma (the first) becomes the decimal mark; then the
    leading number is rounded half-up to two decimals."""
    def number(cand):
        both = cand.contains(",") & cand.contains(".")
        comma_last = cand.rlike(r",[^.]*$")
        normalized = (F.when(both & comma_last,
                             F.regexp_replace(F.replace(cand, F.lit("."), F.lit("")), r"^([^,]*),", "$1."))
                      .when(both, F.replace(cand, F.lit(","), F.lit("")))
                      .otherwise(F.regexp_replace(cand, r"^([^,]*),", "$1.")))
        return F.regexp_extract(normalized, PRICE_PREFIX, 0)

    def fmt(num):
        value = num.try_cast("decimal(38,10)")
        rounded = F.round(value, 2).cast("decimal(38,2)").cast("string")
        return F.when((num == "") | (num == "-") | value.isNull(), F.lit("")).otherwise(rounded)

    cand = F.regexp_replace(F.coalesce(_s(col), F.lit("")), r"[^0-9,.\-]", "")
    return let(let(cand, number), fmt)


def normalize_currency(col) -> Column:
    """Symbols and names -> ISO code; unknown text upper-cased as is."""
    def mapped(n):
        out = n
        for needle, code in reversed(CURRENCY_CONTAINS):
            out = F.when(n.contains(needle), F.lit(code)).otherwise(out)
        for key, code in reversed(CURRENCY_MAP):
            out = F.when(n == key, F.lit(code)).otherwise(out)
        return out
    return let(F.upper(normalize_whitespace(col)), mapped)


def infer_currency(col) -> Column:
    c = F.coalesce(_s(col), F.lit(""))
    out = F.lit("")
    for sign, code in reversed(CURRENCY_SIGNS):
        out = F.when(c.contains(sign), F.lit(code)).otherwise(out)
    return out


def clamp_confidence(col) -> Column:
    c = _s(col).cast("double")
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)) \
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def normalize_http_url(col) -> Column:
    """'' unless http(s); otherwise serialised and cleaned."""
    c = _s(col)
    return F.when(is_http_url(c), clean_url(normalise_url(c))).otherwise(F.lit(""))  # each stage binds its input once


def product_key_id(sku, name, url) -> Column:
    """Slug of the first non-empty of sku / name / url, else the domain slug."""
    src = F.coalesce(F.nullif(_s(sku), F.lit("")), F.nullif(_s(name), F.lit("")), _s(url))
    return let(slugify(src), lambda s: F.when(s != "", s).otherwise(domain_slug(url)))


def _split_trail(path: Column) -> Column:
    return F.filter(F.transform(F.split(path, ">"), lambda x: normalize_whitespace(x)), lambda x: x != "")


def canonical_product(df: DataFrame, urls_normalised: bool = False) -> DataFrame:
    """Raw product fields -> canonical product.

    Expects ``product_id, sku, name, description, brand, price, currency,
    product_url, category_path, category_trail ARRAY, all_category_paths
    ARRAY, image_urls ARRAY, source_site, source_type, source_confidence``
    (missing arrays may be NULL) and passes every other column through.
    With ``urls_normalised`` the URL columns are taken as already serialised
    and cleaned (``normalize_http_url``), so they are not normalised again."""
    known = F.array_distinct(F.filter(F.transform(F.coalesce("all_category_paths", F.array().cast("array<string>")),
                                                  lambda x: normalize_whitespace(x)), lambda x: x != ""))
    trail_in = F.filter(F.transform(F.coalesce("category_trail", F.array().cast("array<string>")),
                                    lambda x: normalize_whitespace(x)), lambda x: x != "")
    staged = df.withColumn("_known", known).withColumn("_trail_in", trail_in)
    seed = F.coalesce(F.nullif(normalize_whitespace("category_path"), F.lit("")),
                      F.try_element_at("_known", F.lit(1)), F.array_join("_trail_in", " > "))
    staged = staged.withColumn("_seed", seed)
    trail = F.when(F.size("_trail_in") > 0, F.col("_trail_in")).otherwise(_split_trail(F.col("_seed")))
    staged = staged.withColumn("_trail", trail)
    path = normalize_whitespace(F.when(F.col("_seed") != "", F.col("_seed")).otherwise(F.array_join("_trail", " > ")))
    staged = staged.withColumn("_path", path)
    if urls_normalised:
        url = F.coalesce(F.col("product_url"), F.lit(""))
        images = F.slice(F.array_distinct(F.filter(F.coalesce("image_urls", F.array().cast("array<string>")),
                                                   lambda x: x != "")), 1, MAX_IMAGES)
    else:
        url = normalize_http_url("product_url")
        images = F.slice(F.array_distinct(F.filter(F.transform(
            F.coalesce("image_urls", F.array().cast("array<string>")), lambda x: normalize_http_url(x)),
            lambda x: x != "")), 1, MAX_IMAGES)
    site_in = F.coalesce(F.col("source_site"), F.lit(""))
    out = fence(staged, _url=url, _images=images)
    site_origin = url_origin(site_in) if urls_normalised else url_origin(normalise_url(site_in))
    source_site = F.when(is_http_url(site_in), site_origin) \
        .otherwise(F.when(F.col("_url") != "", url_origin("_url")).otherwise(F.lit("")))
    passthrough = [c for c in df.columns if c not in (
        "product_id", "sku", "name", "description", "brand", "price", "currency", "product_url",
        "category_path", "category_trail", "all_category_paths", "image_urls", "source_site",
        "source_type", "source_confidence", "category", "subcategory")]
    return out.select(
        *passthrough,
        normalize_whitespace("product_id").alias("product_id"),
        normalize_whitespace("sku").alias("sku"),
        normalize_whitespace("name").alias("name"),
        normalize_whitespace("description").alias("description"),
        normalize_whitespace("brand").alias("brand"),
        normalize_whitespace("price").alias("price"),
        normalize_whitespace("currency").alias("currency"),
        F.col("_url").alias("product_url"),
        F.coalesce(F.try_element_at("_trail", F.lit(1)), F.lit("")).alias("category"),
        F.coalesce(F.try_element_at("_trail", F.lit(2)), F.lit("")).alias("subcategory"),
        F.col("_path").alias("category_path"),
        F.col("_trail").alias("category_trail"),
        F.array_distinct(F.filter(F.concat("_known", F.array("_path")), lambda x: x != ""))
        .alias("all_category_paths"),
        F.col("_images").alias("image_urls"),
        source_site.alias("source_site"),
        normalize_whitespace("source_type").alias("source_type"),
        clamp_confidence("source_confidence").alias("source_confidence"),
    )


def products_from_observations(obs: DataFrame, default_currency: str = DEFAULT_CURRENCY) -> DataFrame:
    """F2 sightings -> canonical products (DOM-sourced, confidence 0.55).

    The 3-letter code inside the price text plays the currency selector,
    the sign in the price text the fallback, then the default currency."""
    sku = normalize_whitespace("sku")
    name = normalize_whitespace("name")
    currency = let(normalize_currency(F.coalesce(
        F.nullif(F.regexp_extract("price_text", "[A-Z]{3}", 0), F.lit("")), infer_currency("price_text"))),
        lambda c: F.when(c != "", c).otherwise(F.lit(default_currency)))
    # every URL is normalised exactly once, behind a fence
    obs = fence(obs, _purl=normalize_http_url("product_url"), _img=normalize_http_url("image"),
                _site=F.when(is_http_url("site"), normalise_url("site")).otherwise(F.col("site")))
    raw = obs.select(
        "seq", "site",
        product_key_id(sku, name, F.col("_purl")).alias("product_id"),
        sku.alias("sku"), name.alias("name"), F.col("description"), F.col("brand"),
        parse_price("price_text").alias("price"),
        currency.alias("currency"),
        F.col("_purl").alias("product_url"),
        F.col("category_path"),
        F.lit(None).cast("array<string>").alias("category_trail"),
        F.lit(None).cast("array<string>").alias("all_category_paths"),
        F.array("_img").alias("image_urls"),
        F.col("_site").alias("source_site"),
        F.lit("dom").alias("source_type"),
        F.lit(DOM_CONFIDENCE).alias("source_confidence"),
    )
    return canonical_product(raw, urls_normalised=True)


def merge_key(df: DataFrame | None = None) -> Column:
    """``sku || product_id || product_url`` (first non-empty)."""
    return F.coalesce(F.nullif(F.col("sku"), F.lit("")), F.nullif(F.col("product_id"), F.lit("")),
                      F.col("product_url"))


def partial_merge(products: DataFrame) -> DataFrame:
    """Mergeable partial state of the product merge.

    Rows per ``(site, product_key, kind, v)``: ``kind='base'`` carries, per
    scalar, ``max(struct(seq, value))`` over non-empty values (the last
    non-empty one), the last trail / confidence, first/last ``seq`` and the
    sighting count; ``kind='path'``/``'img'`` rows carry the first
    ``(seq, position)`` of each distinct value.  Every aggregate is a
    max / min / sum, so partial states combine in any order
    (:func:`combine_partial`) -- late or replayed batches cannot change the
    result."""
    keys = ["site", "product_key"]
    keyed = products.withColumn("product_key", merge_key())
    scalar_struct = F.struct(*[F.col(c) for c in SCALARS], "category_trail", "source_confidence")
    null_p = F.lit(None).cast(scalar_struct_type(products))
    rows = F.concat(
        F.array(F.struct(F.lit("base").alias("kind"), F.lit("").alias("v"), F.lit(0).alias("i"),
                         scalar_struct.alias("p"))),
        F.transform("all_category_paths", lambda v, i: F.struct(
            F.lit("path").alias("kind"), v.alias("v"), i.alias("i"), null_p.alias("p"))),
        F.transform("image_urls", lambda v, i: F.struct(
            F.lit("img").alias("kind"), v.alias("v"), i.alias("i"), null_p.alias("p"))))
    ex = keyed.select(*keys, "seq", F.inline(rows))
    return ex.groupBy(*keys, "kind", "v").agg(
        *[F.max(F.when(F.col(f"p.{c}") != "", F.struct(F.col("seq").alias("s"), F.col(f"p.{c}").alias("x"))))
          .alias(c) for c in SCALARS],
        F.max(F.when(F.col("kind") == "base", F.struct(F.col("seq").alias("s"), F.col("p.category_trail").alias("x"))))
        .alias("category_trail"),
        F.max(F.when(F.col("kind") == "base", F.struct(F.col("seq").alias("s"),
                                                       F.col("p.source_confidence").alias("x"))))
        .alias("source_confidence"),
        F.min(F.struct("seq", "i")).alias("first"),
        F.max("seq").alias("last_seq"),
        F.count("*").alias("n"),
    )


def combine_partial(state: DataFrame) -> DataFrame:
    """Combine partial-merge rows (e.g. stored state + a new batch)."""
    return state.groupBy("site", "product_key", "kind", "v").agg(
        *[F.max(c).alias(c) for c in SCALARS],
        F.max("category_trail").alias("category_trail"),
        F.max("source_confidence").alias("source_confidence"),
        F.min("first").alias("first"), F.max("last_seq").alias("last_seq"),
        F.sum("n").alias("n"))


def finish_merge(state: DataFrame) -> DataFrame:
    """Partial state -> one merged product per ``(site, product_key)``; only
    one base row and the distinct values per key reach this aggregation."""
    keys = ["site", "product_key"]
    is_base = F.col("kind") == "base"
    out = state.groupBy(*keys).agg(
        *[F.max(F.when(is_base, F.col(f"{c}.x"))).alias(c) for c in SCALARS],
        F.max(F.when(is_base, F.col("category_trail"))).alias("_trail"),
        F.max(F.when(is_base, F.col("source_confidence.x"))).alias("source_confidence"),
        F.max(F.when(is_base, F.col("first.seq"))).alias("first_seq"),
        F.max(F.when(is_base, F.col("last_seq"))).alias("last_seq"),
        F.max(F.when(is_base, F.col("n"))).alias("sightings"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "path", F.struct("first", "v")))).alias("_p"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "img", F.struct("first", "v")))).alias("_i"),
    )
    return out.select(
        *keys, *SCALARS, F.col("_trail.x").alias("category_trail"),
        F.transform("_p", lambda x: x["v"]).alias("all_category_paths"),
        F.transform(F.slice("_i", 1, MAX_IMAGES), lambda x: x["v"]).alias("image_urls"),
        "source_confidence", "first_seq", "last_seq", "sightings",
    ).na.fill("", list(SCALARS))


def merge_products(products: DataFrame) -> DataFrame:
    """Fold sightings into one product per ``(site, product_key)``.

    One scan, two aggregations (:func:`partial_merge` then
    :func:`finish_merge`): no group ever holds all sightings of a hot
    product; the partial state is also what the streaming merge stores."""
    return finish_merge(partial_merge(products))


def scalar_struct_type(products: DataFrame) -> str:
    """DDL type of the per-sighting scalar struct (for typed NULLs)."""
    fields = {f.name: f.dataType.simpleString() for f in products.schema.fields}
    parts = [f"{c}:{fields[c]}" for c in SCALARS] + [f"category_trail:{fields['category_trail']}",
                                                   f"source_confidence:{fields['source_confidence']}"]
    return "struct<" + ",".join(parts) + ">"


def drop_unidentified(products: DataFrame) -> DataFrame:
    return products.where((F.col("name") != "") | (F.col("sku") != ""))
