"""Page inspection and per-site profiles.

* ``page_profile``: one row per page (row-local: title, signals, top links).
* ``sample_slots``: per site the entry page (``home``, source ``input``), then
  the auto samples the profiler would queue -- the page behind the entry's
  first category link (``plp``) and behind the first product link of the
  entry or that listing (``pdp``) -- found by joining on the cleaned URL.
* ``site_profile``: one ``groupBy(site)`` of partial aggregates
  (``bool_or`` / ``max_by`` / counts) over the samples, so a site with a
  huge share of all pages still combines map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import scoring as S
from shelfspark.functions.urls import clean_url, normalise_url
from shelfspark.operators.links import page_title, page_top_links

# Platform rules in order (hint, confidence, haystack pattern).
PLATFORM_RULES = (
    ("shopify", 0.9, r"(?i)cdn\.shopify\.com|shopify-section|/products/|/collections/"),
    ("sfcc", 0.9, r"(?i)demandware|dwvar_|cgid=|[?&]pid=|on/demandware\.store"),
    ("magento", 0.85, r"(?i)magento|mage/|pricebox|catalog/product"),
)
LEGACY_TOKEN_RE = r"(?i)aspnet-viewstate|aspnet-webforms"
LEGACY_URL_RE = r"(?i)-([a-z0-9-]+-)?[cp][0-9]+\.aspx($|[?#])"
LEGACY = ("legacy-aspnet-store", 0.88)
GENERIC = ("generic", 0.45)
# Learned URL patterns (stored text, detection regex), in order.
CATEGORY_PATTERNS = (
    (r"-C\d+\.aspx$", r"(?i)-c[0-9]+\.aspx($|[?#])"),
    ("/collections/", r"(?i)/collections/"),
    ("cgid=", r"(?i)[?&]cgid="),
    ("/c/", r"(?i)/c/"),
)
PRODUCT_PATTERNS = (
    (r"-P\d+\.aspx$", r"(?i)-p[0-9]+\.aspx($|[?#])"),
    ("/products/", r"(?i)/products/"),
    ("pid=", r"(?i)[?&]pid="),
    ("/p/", r"(?i)/p/"),
)
# Platform-specific link selectors and the defaults after them.
CATEGORY_SELECTORS = {"legacy-aspnet-store": ["a[href*='-C']", "#accordion a[href]"]}
PRODUCT_SELECTORS = {
    "legacy-aspnet-store": ["a[href*='-P']", ".productItemDisplay a[href]"],
    "shopify": ["a[href*='/products/']"],
    "sfcc": ["a[href*='pid=']", "a[href*='/p/']"],
    "magento": [".product-item-link[href]", "a[href$='.html']"],
}
DEFAULT_CATEGORY_SELECTORS = ["header nav a[href]", "nav a[href]", "[role='navigation'] a[href]",
                              ".menu a[href]", ".navigation a[href]"]
DEFAULT_PRODUCT_SELECTORS = ["a[href*='/p/']", "a[href*='/product/']", "a[href*='/products/']",
                             "a[href*='pid=']", "[data-product-id] a[href]", ".product a[href]",
                             ".product-card a[href]"]
PROFILE_ACTION_MIN_CONFIDENCE = 0.7


def page_profiles(pages: DataFrame) -> DataFrame:
    """Row-local page inspection: every column computed in one pass over
    ``pages`` (the link pipeline and the html signals share the scan)."""
    out = page_top_links(pages, 8, extra=(
        "seq", page_title("html").alias("title"), S.page_signals("html").alias("signals"),
        clean_url(normalise_url("url")).alias("clean_url")))
    return out.select(
        "page_id", "site", "url", "seq", "clean_url", "title",
        F.size("top_category_links").alias("n_cat"),
        F.size("top_product_links").alias("n_prod"),
        F.transform("top_category_links", lambda x: x["url"]).alias("top_category_urls"),
        F.transform("top_product_links", lambda x: x["url"]).alias("top_product_urls"),
        "signals")


def detected_type(requested: Column) -> Column:
    return S.page_type(requested, F.col("url"), F.col("n_cat"), F.col("n_prod"),
                       F.col("signals.has_jsonld_product"), F.col("signals.has_add_to_cart"),
                       F.col("signals.has_price_nodes"))


def _first_page(rows: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Earliest row (by ``seq, page_id``) per ``key`` as a partial aggregate:
    map-side combine, so one hot key never lands whole in one task."""
    order = F.struct("seq", "page_id")
    best = rows.groupBy(key).agg(F.min_by(F.struct(*cols), order).alias("_r"))
    return best.select(key, *[F.col("_r." + c).alias(c) for c in cols if c != key])


def sample_slots(profiles: DataFrame) -> DataFrame:
    """Per site: the entry page (first by ``seq``) as ``home``/``input`` and the
    auto ``plp``/``pdp`` samples reached from it, one per type and URL."""
    cols = profiles.columns
    home = _first_page(profiles, "site", cols)
    home = home.withColumn("type_requested", F.lit("home")).withColumn("source", F.lit("input"))

    def fetched(seeds: DataFrame, type_: str) -> DataFrame:
        """Pages whose cleaned URL is the seed of their site (first one)."""
        hit = profiles.join(seeds.select("site", F.col("_seed").alias("clean_url")), ["site", "clean_url"])
        return _first_page(hit, "site", cols) \
            .withColumn("type_requested", F.lit(type_)).withColumn("source", F.lit("auto"))

    plp_seed = home.select("site", F.try_element_at("top_category_urls", F.lit(1)).alias("_seed"),
                           F.col("clean_url").alias("_home_url"))
    plp = fetched(plp_seed.where(F.col("_seed").isNotNull() & (F.col("_seed") != F.col("_home_url"))), "plp")
    plp_first = plp.select("site", F.try_element_at("top_product_urls", F.lit(1)).alias("_plp_prod"),
                           F.col("clean_url").alias("_plp_url"))
    pdp_seed = home.select("site", F.try_element_at("top_product_urls", F.lit(1)).alias("_home_prod"),
                           F.col("clean_url").alias("_home_url")) \
        .join(plp_first, "site", "left") \
        .select("site", "_home_url", "_plp_url", F.coalesce("_home_prod", "_plp_prod").alias("_seed"))
    pdp = fetched(pdp_seed.where(F.col("_seed").isNotNull() & (F.col("_seed") != F.col("_home_url"))
                                 & (F.col("_plp_url").isNull() | (F.col("_seed") != F.col("_plp_url")))),
                  "pdp")
    samples = home.unionByName(plp).unionByName(pdp)
    rank = F.when(F.col("type_requested") == "home", 0).when(F.col("type_requested") == "plp", 1).otherwise(2)
    return samples.withColumn("slot", rank).withColumn("detected_type", detected_type(F.col("type_requested")))


def _first_true(conds, values, default):
    out = F.lit(default)
    for cond, val in reversed(list(zip(conds, values))):
        out = F.when(cond, F.lit(val)).otherwise(out)
    return out


def site_profile(samples: DataFrame) -> DataFrame:
    """One row per site (see module doc)."""
    urls = F.concat(F.array("url"), F.coalesce("top_product_urls", F.array()),
                    F.coalesce("top_category_urls", F.array()))
    tokens = F.coalesce(F.col("signals.platform_tokens"), F.array().cast("array<string>"))
    hay = F.concat(urls, tokens)
    def any_match(arr, pattern):
        return F.exists(arr, lambda v: v.rlike(pattern))

    aggs = [F.bool_or(any_match(hay, p)).alias(f"_plat{i}") for i, (_, _, p) in enumerate(PLATFORM_RULES)]
    aggs.append(F.bool_or(F.exists(tokens, lambda v: v.rlike(LEGACY_TOKEN_RE))
                          | F.exists(urls, lambda v: v.rlike(LEGACY_URL_RE))).alias("_legacy"))
    aggs += [F.bool_or(any_match(urls, p)).alias(f"_cat{i}") for i, (_, p) in enumerate(CATEGORY_PATTERNS)]
    aggs += [F.bool_or(any_match(urls, p)).alias(f"_prod{i}") for i, (_, p) in enumerate(PRODUCT_PATTERNS)]
    typed = F.col("type_requested") != "home"
    trusted = (F.col("source") == "input") & (F.col("type_requested") == "plp")
    aggs += [
        F.min_by("url", "slot").alias("entry_url"),
        F.count_if(typed).alias("_typed"),
        F.count_if(typed & (trusted | (F.col("detected_type") == F.col("type_requested")))).alias("_matches"),
        F.bool_or(F.col("signals.has_jsonld_product")).alias("_jsonld"),
        F.bool_or((F.col("n_prod") > 0) | (F.col("n_cat") > 0)).alias("_has_candidates"),
        F.bool_or(F.col("detected_type") == "plp").alias("has_plp"),
        F.bool_or(F.col("detected_type") == "pdp").alias("has_pdp"),
        F.map_from_entries(F.collect_list(F.struct("type_requested", "url"))).alias("sample_urls"),
        F.count("*").cast("int").alias("n_samples"),
    ]
    g = samples.groupBy("site").agg(*aggs)
    conds = [F.col(f"_plat{i}") for i in range(len(PLATFORM_RULES))] + [F.col("_legacy")]
    hints = [h for h, _, _ in PLATFORM_RULES] + [LEGACY[0]]
    confs = [c for _, c, _ in PLATFORM_RULES] + [LEGACY[1]]
    hint = _first_true(conds, hints, GENERIC[0])
    conf = _first_true(conds, confs, GENERIC[1])
    cat_pats = F.array_compact(F.array(*[F.when(F.col(f"_cat{i}"), F.lit(t)) for i, (t, _) in enumerate(CATEGORY_PATTERNS)]))
    prod_pats = F.array_compact(F.array(*[F.when(F.col(f"_prod{i}"), F.lit(t)) for i, (t, _) in enumerate(PRODUCT_PATTERNS)]))
    g = g.select("*", hint.alias("platform_hint"), conf.cast("double").alias("platform_confidence"),
                 cat_pats.alias("category_patterns"), prod_pats.alias("product_patterns"))
    type_score = F.when(F.col("_typed") > 0, F.col("_matches") / F.col("_typed")).otherwise(F.lit(0.5))
    n_pat = F.size("category_patterns") + F.size("product_patterns")
    raw = F.col("platform_confidence") * 0.6 + type_score * 0.2 + F.least(F.lit(0.2), n_pat * 0.05)
    generic = F.col("platform_hint") == "generic"
    candidates = F.array_compact(F.array(
        F.when(generic & F.col("_has_candidates"), F.struct(
            F.lit("platform-logic-candidate").alias("type"), F.lit(0.65).alias("confidence"),
            F.lit(None).cast("string").alias("pattern"))),
        F.when(generic & (F.size("product_patterns") > 0), F.struct(
            F.lit("product-pattern-candidate").alias("type"), F.lit(0.7).alias("confidence"),
            F.try_element_at("product_patterns", F.lit(1)).alias("pattern"))),
        F.when(generic & (F.size("category_patterns") > 0), F.struct(
            F.lit("category-pattern-candidate").alias("type"), F.lit(0.7).alias("confidence"),
            F.try_element_at("category_patterns", F.lit(1)).alias("pattern")))))
    default_include = F.array(*[F.lit(p) for p in S.DEFAULT_INCLUDE])
    cat_sel = F.coalesce(F.element_at(F.create_map(*[x for k, v in CATEGORY_SELECTORS.items() for x in (
        F.lit(k), F.array(*[F.lit(s) for s in v]))]), F.col("platform_hint")), F.array().cast("array<string>"))
    prod_sel = F.coalesce(F.element_at(F.create_map(*[x for k, v in PRODUCT_SELECTORS.items() for x in (
        F.lit(k), F.array(*[F.lit(s) for s in v]))]), F.col("platform_hint")), F.array().cast("array<string>"))
    return g.select(
        "site",
        F.regexp_replace("site", r"^www\.", "").alias("domain"),
        "entry_url", "platform_hint", "platform_confidence", "sample_urls",
        "category_patterns", "product_patterns",
        F.array_distinct(F.concat(default_include, F.col("category_patterns"))).alias("include_patterns"),
        F.array_distinct(F.concat(cat_sel, F.array(*[F.lit(s) for s in DEFAULT_CATEGORY_SELECTORS])))
        .alias("category_selectors"),
        F.array_distinct(F.concat(prod_sel, F.array(*[F.lit(s) for s in DEFAULT_PRODUCT_SELECTORS])))
        .alias("product_selectors"),
        F.when(F.col("_jsonld"), F.array(F.lit("jsonld"), F.lit("dom"))).otherwise(F.array(F.lit("dom")))
        .alias("preferred_sources"),
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 2).alias("confidence"),
        candidates.alias("learning_candidates"),
        "has_plp", "has_pdp", "n_samples",
    )


def profile_actions(profiles: DataFrame, user_plp: Column | None = None) -> DataFrame:
    """Inputs a site profile still needs (no PLP / no PDP / weak generic)."""
    has_plp = F.col("has_plp") if user_plp is None else (F.col("has_plp") | user_plp)
    weak = (F.col("platform_hint") == "generic") & (F.col("confidence") < PROFILE_ACTION_MIN_CONFIDENCE)
    reasons = F.array_compact(F.array(
        F.when(~has_plp, F.lit("no_plp")), F.when(~F.col("has_pdp"), F.lit("no_pdp")),
        F.when(weak, F.lit("low_confidence"))))
    inputs = F.array_compact(F.array(
        F.when(~has_plp, F.struct(F.lit("plp_url").alias("id"), F.lit(True).alias("required"),
                                  F.lit(True).alias("multiple"))),
        F.when(~F.col("has_pdp"), F.struct(F.lit("pdp_url").alias("id"), F.lit(True).alias("required"),
                                           F.lit(False).alias("multiple"))),
        F.when(weak, F.struct(F.lit("search_url").alias("id"), F.lit(False).alias("required"),
                              F.lit(False).alias("multiple")))))
    status = F.when(F.size(reasons) > 0, "needs_user_input").otherwise("not_needed")
    severity = F.when(F.size(reasons) == 0, "none").when(~has_plp | ~F.col("has_pdp"), "blocking") \
        .otherwise("advisory")
    out = profiles.select("site", status.alias("status"), severity.alias("severity"),
                          reasons.alias("reasons"), inputs.alias("requested_inputs"), "platform_hint")
    return out.withColumn("auto_ready", (F.col("platform_hint") != "generic")
                          & (F.col("status") != "needs_user_input")).drop("platform_hint")
