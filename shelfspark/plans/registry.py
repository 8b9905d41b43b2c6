"""Registered queries: name -> (Spark plan builder, DuckDB oracle SQL builder).

Every plan reads the driver's tables (or data Spark derives from them) in
full; names follow the operator inventory.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions import scoring as S
from shelfspark.oracle import links_sql as LQ
from shelfspark.oracle import profile_sql as PQ
from shelfspark.operators import links as L
from shelfspark.operators import products as PR
from shelfspark.operators import profile as P
from shelfspark.operators import quality as QY
from shelfspark.operators import categories as C
from shelfspark.operators import exports as X
from shelfspark.operators import listing as LI
from shelfspark.oracle import listing_sql as LS
from shelfspark.sources.fixtures import PRODUCT_PAGES_SQL, listing_links, product_pages
from shelfspark.oracle import discovery_sql as DQ
from shelfspark.operators import extract as EX
from shelfspark.oracle import extract_sql as EQ
from shelfspark.oracle import products_sql as RQ
from shelfspark.oracle import sqlfn as SQ
from shelfspark.sources.fixtures import product_observations
from shelfspark.sources.tables import read_pages

Plan = Callable[[SparkSession, str], DataFrame]
_PLANS: dict[str, Plan] = {}
_ORACLE: dict[str, Callable[[], str]] = {}


def register(name: str, oracle: Callable[[], str] | None = None):
    def deco(fn: Plan) -> Plan:
        _PLANS[name] = fn
        if oracle is not None:
            _ORACLE[name] = oracle
        return fn
    return deco


def plans() -> dict[str, Plan]:
    return dict(_PLANS)


def oracle() -> dict[str, str]:
    return {k: v() for k, v in _ORACLE.items()}


# ------------------------------------------------------------------ links
@register("top_links_per_page", LQ.top_links_per_page_sql)
def q_top_links_per_page(spark, sf):
    return L.top_links_per_page(read_pages(spark, sf), "category", 8)


@register("top_product_links_per_page", lambda: LQ.top_links_per_page_sql("product", 8))
def q_top_product_links(spark, sf):
    return L.top_links_per_page(read_pages(spark, sf), "product", 8)


@register("extract_links", LQ.extract_links_sql)
def q_extract_links(spark, sf):
    return L.extract_links(read_pages(spark, sf))


@register("absolute_url", LQ.normalize_links_sql)
def q_absolute_url(spark, sf):
    return L.normalize_links(read_pages(spark, sf))


@register("score_category_link", lambda: LQ.with_links() +
          "SELECT page_id, pos, url, text, category_score FROM sc")
def q_score_category(spark, sf):
    return L.scored_links(read_pages(spark, sf)).select("page_id", "pos", "url", "text", "category_score")


@register("score_product_url", lambda: LQ.with_links() +
          "SELECT page_id, pos, url, product_score FROM sc")
def q_score_product(spark, sf):
    return L.scored_links(read_pages(spark, sf)).select("page_id", "pos", "url", "product_score")


@register("page_title", LQ.page_title_sql)
def q_page_title(spark, sf):
    return read_pages(spark, sf).select("page_id", L.page_title("html").alias("title"))


# ---------------------------------------------------------------- profiles
def _profiles(spark, sf):
    return P.page_profiles(read_pages(spark, sf)).persist()


def _site_profiles(spark, sf):
    return P.site_profile(P.sample_slots(_profiles(spark, sf)))


@register("page_signals", PQ.page_signals_sql)
def q_page_signals(spark, sf):
    s = read_pages(spark, sf).select("page_id", S.page_signals("html").alias("s"))
    return s.select("page_id", "s.has_search_input", "s.has_jsonld_product", "s.has_add_to_cart",
                    "s.has_price_nodes", "s.has_pagination",
                    F.array_join("s.platform_tokens", ",").alias("platform_tokens"))


@register("page_profile", PQ.page_profile_sql)
def q_page_profile(spark, sf):
    pp = P.page_profiles(read_pages(spark, sf))
    return pp.select("page_id", "site", "title", "clean_url", "n_cat", "n_prod",
                     F.array_join("top_category_urls", " ").alias("top_category_urls"),
                     F.array_join("top_product_urls", " ").alias("top_product_urls"),
                     P.detected_type(F.lit(None).cast("string")).alias("detected_type"))


@register("sample_slots", PQ.sample_slots_sql)
def q_sample_slots(spark, sf):
    return P.sample_slots(_profiles(spark, sf)).select(
        "site", "page_id", "type_requested", "source", "detected_type")


@register("site_profile", PQ.site_profile_sql)
def q_site_profile(spark, sf):
    sp = _site_profiles(spark, sf)
    return sp.select("site", "domain", "entry_url", "platform_hint", "platform_confidence",
                     F.array_join("category_patterns", " ").alias("category_patterns"),
                     F.array_join("product_patterns", " ").alias("product_patterns"),
                     F.array_join("include_patterns", " ").alias("include_patterns"),
                     F.array_join("preferred_sources", " ").alias("preferred_sources"),
                     "confidence", "has_plp", "has_pdp", "n_samples")


@register("platform_detect", lambda: PQ.with_profiles() +
          "SELECT site, platform_hint, platform_confidence FROM sp")
def q_platform_detect(spark, sf):
    return _site_profiles(spark, sf).select("site", "platform_hint", "platform_confidence")


@register("url_patterns", lambda: PQ.with_profiles() +
          "SELECT site, array_to_string(category_patterns, ' ') AS category_patterns, "
          "array_to_string(product_patterns, ' ') AS product_patterns FROM sp")
def q_url_patterns(spark, sf):
    return _site_profiles(spark, sf).select(
        "site", F.array_join("category_patterns", " ").alias("category_patterns"),
        F.array_join("product_patterns", " ").alias("product_patterns"))


@register("profile_confidence", lambda: PQ.with_profiles() + "SELECT site, confidence FROM sp")
def q_profile_confidence(spark, sf):
    return _site_profiles(spark, sf).select("site", "confidence")


@register("preferred_sources", lambda: PQ.with_profiles() +
          "SELECT site, CASE WHEN jsonld THEN 'jsonld dom' ELSE 'dom' END AS preferred_sources FROM sp")
def q_preferred_sources(spark, sf):
    return _site_profiles(spark, sf).select(
        "site", F.array_join("preferred_sources", " ").alias("preferred_sources"))


@register("learning_candidates", PQ.learning_candidates_sql)
def q_learning_candidates(spark, sf):
    lc = _site_profiles(spark, sf).select("site", F.inline_outer("learning_candidates"))
    return lc.where(F.col("type").isNotNull()).select("site", "type", "confidence", "pattern")


@register("sample_urls", lambda: PQ.with_profiles() +
          "SELECT site, type_requested AS type, last(url ORDER BY slot) AS url FROM samples GROUP BY site, type_requested")
def q_sample_urls(spark, sf):
    su = _site_profiles(spark, sf).select("site", F.explode_outer("sample_urls").alias("type", "url"))
    return su.where(F.col("type").isNotNull())


@register("profile_actions", PQ.profile_actions_sql)
def q_profile_actions(spark, sf):
    pa = P.profile_actions(_site_profiles(spark, sf))
    return pa.select("site", "status", "severity", F.array_join("reasons", " ").alias("reasons"),
                     F.array_join(F.transform("requested_inputs", lambda x: x["id"]), " ").alias("requested_inputs"),
                     "auto_ready")


@register("profile_auto_ready", lambda: PQ.profile_actions_sql().replace(
    "SELECT site, CASE WHEN len(r)", "SELECT site, auto_ready FROM (SELECT site, CASE WHEN len(r)") + ")")
def q_profile_auto_ready(spark, sf):
    return P.profile_actions(_site_profiles(spark, sf)).select("site", "auto_ready")


# ---------------------------------------------------------------- products
def _flat_products(df, *extra):
    """Products with arrays joined to strings (comparable in both engines)."""
    return df.select(
        *extra, "site", "product_id", "sku", "name", "description", "brand", "price", "currency",
        "product_url", "category", "subcategory", "category_path",
        F.array_join("category_trail", " > ").alias("category_trail"),
        F.array_join("all_category_paths", " | ").alias("all_category_paths"),
        F.array_join("image_urls", " | ").alias("image_urls"),
        "source_site", "source_type", "source_confidence")


def _products(spark, sf):
    return PR.products_from_observations(product_observations(spark, sf))


def _merged(spark, sf):
    return PR.merge_products(PR.drop_unidentified(_products(spark, sf)))


@register("parse_price", RQ.parse_price_sql)
def q_parse_price(spark, sf):
    return product_observations(spark, sf).select("seq", "price_text", PR.parse_price("price_text").alias("price"))


@register("canonical_product", RQ.canonical_product_sql)
def q_canonical_product(spark, sf):
    return _flat_products(_products(spark, sf), "seq")


@register("merge_products", RQ.merge_products_sql)
def q_merge_products(spark, sf):
    return _flat_products(_merged(spark, sf), "product_key", "first_seq", "last_seq", "sightings")


def _catalog(spark, sf):
    """Merged catalog, persisted once: every export reads it."""
    return _merged(spark, sf).persist()


@register("drop_unidentified", lambda: RQ.with_products() + "SELECT seq, site, sku, name FROM prod WHERE name <> '' OR sku <> ''")
def q_drop_unidentified(spark, sf):
    return PR.drop_unidentified(_products(spark, sf)).select("seq", "site", "sku", "name")


@register("product_issues", RQ.product_issues_sql)
def q_product_issues(spark, sf):
    return QY.product_issues(_merged(spark, sf))


@register("catalog_summary", RQ.catalog_summary_sql)
def q_catalog_summary(spark, sf):
    return QY.catalog_summary(_merged(spark, sf))


@register("catalog_warnings", RQ.catalog_warnings_sql)
def q_catalog_warnings(spark, sf):
    return QY.catalog_warnings(QY.catalog_summary(_merged(spark, sf)))


@register("distinct_category_count", RQ.distinct_category_count_sql)
def q_distinct_category_count(spark, sf):
    return QY.distinct_category_count(_merged(spark, sf))


@register("quality_actions", RQ.quality_actions_sql)
def q_quality_actions(spark, sf):
    m = _catalog(spark, sf)
    cats = QY.distinct_category_count(m).withColumn("categories_processed", F.col("distinct_categories"))
    qa = QY.quality_actions(QY.catalog_summary(m), cats)
    return qa.select("site", "status", "severity", F.array_join("reasons", " ").alias("reasons"),
                     F.array_join(F.transform("requested_inputs", lambda x: x["id"]), " ").alias("requested_inputs"))


@register("category_tree", RQ.category_tree_sql)
def q_category_tree(spark, sf):
    t = C.category_tree(_merged(spark, sf))
    return t.select("site", "full_path", "id", "name", F.array_join("path", " > ").alias("path"), "depth", "parent_id")


@register("category_assignments", RQ.category_assignments_sql)
def q_category_assignments(spark, sf):
    return C.category_assignments(_catalog(spark, sf)).withColumn("ord", F.col("ord").cast("int"))


@register("catalog_brand", RQ.catalog_brand_sql)
def q_catalog_brand(spark, sf):
    return X.catalog_brand(_merged(spark, sf))


@register("catalog_currencies", RQ.catalog_currencies_sql)
def q_catalog_currencies(spark, sf):
    return X.catalog_currencies(_catalog(spark, sf))


@register("pricebook_entries", RQ.pricebook_entries_sql)
def q_pricebook_entries(spark, sf):
    return X.pricebook_entries(_catalog(spark, sf))


@register("shared_image_dir", RQ.shared_image_dir_sql)
def q_shared_image_dir(spark, sf):
    return X.shared_image_dir(_catalog(spark, sf))


@register("image_groups", RQ.image_groups_sql)
def q_image_groups(spark, sf):
    return X.image_groups(_merged(spark, sf))


@register("generic_csv_rows", RQ.generic_csv_sql)
def q_generic_csv_rows(spark, sf):
    return X.generic_csv_rows(_merged(spark, sf))


@register("b2b_csv_rows", RQ.b2b_csv_sql)
def q_b2b_csv_rows(spark, sf):
    return X.b2b_csv_rows(_merged(spark, sf))


@register("catalog_cards", RQ.catalog_cards_sql)
def q_catalog_cards(spark, sf):
    return X.catalog_cards(_merged(spark, sf)).withColumn("thumbs", F.array_join("thumbs", " "))


@register("search_cards", lambda: RQ.search_cards_sql("Blue", "Sale > SMALL"))
def q_search_cards(spark, sf):
    cards = X.catalog_cards(_merged(spark, sf)).withColumn("thumbs", F.array_join("thumbs", " "))
    return X.search_cards(cards, "Blue", "Sale > SMALL")


@register("catalog_stats", RQ.catalog_stats_sql)
def q_catalog_stats(spark, sf):
    return X.catalog_stats(_merged(spark, sf))


# ---------------------------------------------------------------- listings
def _listing(spark, sf):
    links = listing_links(spark, sf)
    cats = LI.dedupe_category_targets(LI.categories_from_listing(links))
    return cats, links


@register("pagination_chain", LS.pagination_chain_sql)
def q_pagination_chain(spark, sf):
    cats, links = _listing(spark, sf)
    return LI.pagination_chain(cats, LI.listing_pages(links))


@register("link_filter_product", LS.link_filter_product_sql)
def q_link_filter_product(spark, sf):
    return LI.page_product_links(listing_links(spark, sf))


@register("products_per_category", LS.products_per_category_sql)
def q_products_per_category(spark, sf):
    cats, links = _listing(spark, sf)
    return LI.category_product_links(cats, links, per_category=10)[0]


@register("links_per_category", LS.links_per_category_sql)
def q_links_per_category(spark, sf):
    cats, links = _listing(spark, sf)
    return LI.category_product_links(cats, links)[1]


@register("unprocessed_categories", LS.unprocessed_categories_sql)
def q_unprocessed_categories(spark, sf):
    cats, links = _listing(spark, sf)
    chain = LI.pagination_chain(cats, LI.listing_pages(links)).where(F.col("depth") > 1)
    return LI.unprocessed(cats.select("name", "url"), chain.select(F.col("page_url").alias("url")))


@register("dedupe_category_targets", lambda: LS.with_listing() + "SELECT name, url FROM cats")
def q_dedupe_category_targets(spark, sf):
    return _listing(spark, sf)[0].select("name", "url")


# ---------------------------------------------------------------- product pages
@register("jsonld_product", EQ.extraction_sql)
def q_extraction(spark, sf):
    ex = EX.extraction(product_pages(spark, sf))
    return ex.select("page_id", "name", "description", "sku", "brand", PR.parse_price("price").alias("price"),
                     "currency", F.array_join("images", " | ").alias("images"),
                     F.array_join("breadcrumb", " | ").alias("breadcrumb"), "title", "has_jsonld")


@register("extract_products", EQ.extract_products_sql)
def q_extract_products(spark, sf):
    return _extracted(EX.extract_products(product_pages(spark, sf)))


def _extracted(p):
    return p.select("page_id", "product_id", "name", "description", "sku", "price", "currency", "brand",
                    "product_url", "category", "subcategory", "category_path",
                    F.array_join("category_trail", " > ").alias("category_trail"),
                    F.array_join("image_urls", " | ").alias("image_urls"), "source_site", "source_type",
                    "source_confidence")


# ---------------------------------------------------------------- streaming
@register("stream_merge_products", RQ.merge_products_sql)
def q_stream_merge_products(spark, sf):
    """Sightings arrive as 4 files in shuffled order; the final streamed state
    must equal the batch merge (same oracle)."""
    from shelfspark.streaming import merge as SM
    root = SM.fresh_root(spark, "stream-merge")
    obs = product_observations(spark, sf).drop("ts")
    # arrival order deliberately not seq order: later sightings come first
    SM.write_arrivals(obs.withColumn("_arrival", -F.col("seq")), f"{root}/input", 4, "_arrival")
    state = SM.stream_merge_products(spark, f"{root}/input", root, compact_every=2)
    return _flat_products(state.products(), "product_key", "first_seq", "last_seq", "sightings")


@register("stream_new_links", lambda: LS.with_listing() +
          "SELECT DISTINCT page_url AS url FROM f4")
def q_stream_new_links(spark, sf):
    from shelfspark.streaming import merge as SM
    root = SM.fresh_root(spark, "stream-links")
    links = listing_links(spark, sf).select(F.col("page_url").alias("url"), "pos")
    SM.write_arrivals(links, f"{root}/input", 4, "pos")
    return SM.stream_new_links(spark, f"{root}/input", f"{root}/out").select("url")


@register("stream_page_links", lambda: LQ.with_links() + f"SELECT DISTINCT {SQ.host('page_url')} AS site, url FROM lk")
def q_stream_page_links(spark, sf):
    """Pages arrive as four files; every link of a site is emitted once."""
    from shelfspark.streaming import merge as SM
    from shelfspark.streaming import pages as SP
    root = SM.fresh_root(spark, "stream-pages")
    pages = read_pages(spark, sf).withColumn("seen_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id")))
    SM.write_arrivals(pages, f"{root}/input", 4, "page_id")
    arriving = SP.read_arrivals(spark, f"{root}/input", "page_id long, site string, url string, html string, seq long, seen_at timestamp")
    SP.new_links(arriving, f"{root}/out", "3650 days").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("site", "url")


@register("stream_extract_products", EQ.extract_products_sql)
def q_stream_extract_products(spark, sf):
    """Product pages arrive as four files and are extracted one batch at a time."""
    from shelfspark.streaming import merge as SM
    from shelfspark.streaming import pages as SP
    root = SM.fresh_root(spark, "stream-products")
    SM.write_arrivals(product_pages(spark, sf), f"{root}/input", 4, "page_id")
    SP.arriving_products(SP.read_arrivals(spark, f"{root}/input", "page_id long, url string, category string, html string"), f"{root}/out").awaitTermination()
    return _extracted(spark.read.parquet(f"{root}/out"))


# ---------------------------------------------------------------- sinks
def _sink_root(spark, name):
    from shelfspark.streaming.merge import fresh_root
    return fresh_root(spark, name)


@register("sink_generic_csv", RQ.generic_csv_sql)
def q_sink_generic_csv(spark, sf):
    from shelfspark.sources import sinks as K
    path = _sink_root(spark, "generic-csv")
    K.write_generic_csv(_catalog(spark, sf), path)
    cols = [c for c in X.GENERIC_CSV_COLUMNS]
    return K.read_csv(spark, path, cols)


@register("sink_b2b_csv", RQ.b2b_csv_sql)
def q_sink_b2b_csv(spark, sf):
    from shelfspark.sources import sinks as K
    path = _sink_root(spark, "b2b-csv")
    K.write_b2b_csv(_catalog(spark, sf), path)
    return K.read_csv(spark, path, list(X.B2B_CSV_COLUMNS))


def _xml_lines(spark, sf, kind):
    from shelfspark.sources import sinks as K
    path = _sink_root(spark, f"b2c-{kind}")
    frags = {"catalog": K.catalog_fragments, "pricebooks": K.pricebook_fragments,
             "inventory": K.inventory_fragments}[kind](_catalog(spark, sf))
    K._write_document(frags, path)
    return spark.read.text(path).select("site", F.col("value").alias("line"))


@register("sink_b2c_catalog")
def q_sink_b2c_catalog(spark, sf):
    return _xml_lines(spark, sf, "catalog")


@register("sink_b2c_pricebooks")
def q_sink_b2c_pricebooks(spark, sf):
    return _xml_lines(spark, sf, "pricebooks")


@register("sink_b2c_inventory")
def q_sink_b2c_inventory(spark, sf):
    return _xml_lines(spark, sf, "inventory")


def _document_digests(spark, sf, kind):
    from shelfspark.sources import sinks as K
    path = _sink_root(spark, f"b2c-{kind}-order")
    frags = {"pricebooks": K.pricebook_fragments, "inventory": K.inventory_fragments}[kind](_catalog(spark, sf))
    K._write_document(frags, path)
    return K.document_digests(K.document_lines(spark, path))


@register("b2c_pricebooks_order", RQ.pricebook_digest_sql)
def q_b2c_pricebooks_order(spark, sf):
    """The written document read back: its lines in their order."""
    return _document_digests(spark, sf, "pricebooks")


@register("b2c_inventory_order", RQ.inventory_digest_sql)
def q_b2c_inventory_order(spark, sf):
    return _document_digests(spark, sf, "inventory")


@register("run_summary", lambda: RQ.with_merged(RQ._validated(), RQ.summary_cte(), RQ.distinct_cats_cte()) + (
    "SELECT s.site, CAST(coalesce(d.distinct_categories, 0) AS BIGINT) AS categories, product_count AS products, "
    "valid_products AS valid, products_with_errors AS with_errors, products_with_warnings AS with_warnings, "
    "CAST((CASE WHEN product_count > 0 AND price_coverage < 0.5 THEN 1 ELSE 0 END) + "
    "(CASE WHEN product_count > 0 AND image_coverage < 0.5 THEN 1 ELSE 0 END) + "
    "(CASE WHEN product_count > 0 AND category_coverage < 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS warnings "
    "FROM summ s LEFT JOIN dcat d USING (site)"))
def q_run_summary(spark, sf):
    m = _catalog(spark, sf)
    summ = QY.catalog_summary(m)
    cats = QY.distinct_category_count(m).withColumnRenamed("distinct_categories", "categories_processed")
    return QY.run_summary(summ, cats, QY.catalog_warnings(summ))


@register("sink_run_summary")
def q_sink_run_summary(spark, sf):
    from shelfspark.sources import sinks as K
    path = _sink_root(spark, "run-summary")
    K.write_run_summary(q_run_summary(spark, sf), path)
    return spark.read.json(path)


@register("sink_site_profile")
def q_sink_site_profile(spark, sf):
    from shelfspark.sources import sinks as K
    path = _sink_root(spark, "site-profiles")
    K.write_site_profiles(_site_profiles(spark, sf), path)
    return spark.read.json(path).select("domain", "platform_hint", "confidence")


@register("sink_export_all")
def q_sink_export_all(spark, sf):
    from shelfspark.sources import sinks as K
    path = _sink_root(spark, "export-all")
    out = K.export_all(_merged(spark, sf), path)
    return spark.read.parquet(out["cards"]).select("site", "product_id", "price_label")


# ---------------------------------------------------------------- discovery
def _discovered(spark, sf):
    from shelfspark.operators import discovery as D
    return D.discover_categories(read_pages(spark, sf))


def _requests(cats):
    """Requested names derived from the data: the first three folded letters
    of each site's top category (matches) and one name that matches nothing."""
    from shelfspark.functions.text import fold_text
    first = cats.where(F.col("rank") == 1).select(
        "site", F.lit(1).alias("req_no"), F.upper(F.substring(fold_text("name"), 1, 3)).alias("name"))
    none = cats.select("site").distinct().select("site", F.lit(2).alias("req_no"), F.lit("Zz-unmatched").alias("name"))
    return first.unionByName(none)


@register("top_categories", lambda: DQ.top_categories_sql())
def q_top_categories(spark, sf):
    from shelfspark.operators import discovery as D
    t = D.top_categories(D.entry_pages(read_pages(spark, sf)))
    return t.withColumn("path", F.array_join("path", " > "))


@register("discover_categories", lambda: DQ.discover_categories_sql())
def q_discover_categories(spark, sf):
    cats, _ = _discovered(spark, sf)
    return cats.withColumn("path", F.array_join("path", " > "))


@register("fallback_catalog_category", lambda: DQ.fallback_catalog_category_sql())
def q_fallback_catalog_category(spark, sf):
    return _discovered(spark, sf)[1]


@register("category_name_match", lambda: DQ.category_name_match_sql())
def q_category_name_match(spark, sf):
    from shelfspark.operators import discovery as D
    cats, _ = _discovered(spark, sf)
    cats = cats.persist()
    return D.category_name_match(cats, _requests(cats)).withColumn("path", F.array_join("path", " > "))


@register("category_name_fallback", lambda: DQ.category_name_fallback_sql())
def q_category_name_fallback(spark, sf):
    from shelfspark.operators import discovery as D
    cats, _ = _discovered(spark, sf)
    cats = cats.persist()
    req = _requests(cats)
    return D.unmatched_requests(req, D.category_name_match(cats, req)).select("site", "req_no", "name")


@register("discover_subcategories")
def q_discover_subcategories(spark, sf):
    from shelfspark.operators import discovery as D
    pages = read_pages(spark, sf)
    cats, _ = _discovered(spark, sf)
    return D.discover_subcategories(cats, pages).withColumn("path", F.array_join("path", " > "))


# ---------------------------------------------------------------- scalar functions over real columns
from shelfspark.functions import text as TX  # noqa: E402
from shelfspark.functions import urls as UR  # noqa: E402

_TITLE_SQL = SQ.rx_extract("coalesce(html, '')", LQ.TITLE_RE, 1)
_BODY_RE = r"(?is)<body[^>]*>(.*)</body>"


@register("normalize_whitespace", lambda: f"SELECT page_id, {SQ.ws(SQ.strip_tags(_TITLE_SQL))} AS v FROM pages")
def q_normalize_whitespace(spark, sf):
    t = F.regexp_extract(F.coalesce("html", F.lit("")), L.TITLE_RE, 1)
    return read_pages(spark, sf).select("page_id", TX.normalize_whitespace(TX.strip_html_tags(t)).alias("v"))


@register("strip_html_tags", lambda: (
    f"SELECT page_id, {SQ.strip_tags(SQ.rx_extract('coalesce(html, ' + SQ.EMPTY + ')', _BODY_RE, 1))} AS v FROM pages"))
def q_strip_html_tags(spark, sf):
    b = F.regexp_extract(F.coalesce("html", F.lit("")), _BODY_RE, 1)
    return read_pages(spark, sf).select("page_id", TX.strip_html_tags(b).alias("v"))


@register("fold_text", lambda: LQ.with_links() + f"SELECT page_id, pos, text, {SQ.fold('text')} AS v FROM lk")
def q_fold_text(spark, sf):
    return L.normalize_links(read_pages(spark, sf)).select("page_id", "pos", "text", TX.fold_text("text").alias("v"))


@register("slugify", lambda: LQ.with_links() + f"SELECT page_id, pos, {SQ.slug('text')} AS v FROM lk")
def q_slugify(spark, sf):
    return L.normalize_links(read_pages(spark, sf)).select("page_id", "pos", TX.slugify("text").alias("v"))


@register("clean_url", lambda: "SELECT page_id, url, v FROM " + SQ.stages(
    "(SELECT page_id, url FROM pages)", *SQ.normalise_steps("url", "u"), *SQ.clean_steps("unorm", "v", "c")))
def q_clean_url(spark, sf):
    return read_pages(spark, sf).select("page_id", "url", UR.clean_url(UR.normalise_url("url")).alias("v"))


@register("url_origin", lambda: (
    f"SELECT page_id, {SQ.rx_extract('coalesce(url, ' + SQ.EMPTY + ')', UR.ORIGIN_RE, 1)} AS origin, "
    f"replace({SQ.rx_replace(SQ.host('url'), '^www[.]', '')}, '.', '-') AS domain_slug FROM pages"))
def q_url_origin(spark, sf):
    return read_pages(spark, sf).select("page_id", UR.url_origin("url").alias("origin"),
                                        UR.domain_slug("url").alias("domain_slug"))


@register("url_slug", lambda: LQ.with_links() + f"SELECT page_id, pos, {SQ.url_slug('url')} AS v FROM lk")
def q_url_slug(spark, sf):
    return L.normalize_links(read_pages(spark, sf)).select("page_id", "pos", UR.url_slug("url").alias("v"))


@register("category_label", lambda: LQ.with_links() +
          f"SELECT page_id, pos, {SQ.category_label(SQ.url_slug('url'))} AS v FROM lk")
def q_category_label(spark, sf):
    from shelfspark.operators import discovery as D
    return L.normalize_links(read_pages(spark, sf)).select(
        "page_id", "pos", D.category_label(UR.url_slug("url")).alias("v"))


@register("normalize_currency", lambda: RQ.with_products() + (
    f"SELECT seq, {RQ.normalize_currency('price_text')} AS normalized, "
    f"{RQ.infer_currency('price_text')} AS inferred FROM obs"))
def q_normalize_currency(spark, sf):
    return product_observations(spark, sf).select(
        "seq", PR.normalize_currency("price_text").alias("normalized"),
        PR.infer_currency("price_text").alias("inferred"))


@register("xml_escape", lambda: f"SELECT page_id, {SQ.xml_escape(SQ.strip_html(_TITLE_SQL))} AS v FROM pages")
def q_xml_escape(spark, sf):
    return read_pages(spark, sf).select("page_id", TX.xml_escape(L.page_title("html")).alias("v"))


@register("same_domain", lambda: LQ.with_links() +
          f"SELECT page_id, pos, url, {SQ.same_domain('url', 'page_url')} AS same FROM lk")
def q_same_domain(spark, sf):
    return L.normalize_links(read_pages(spark, sf)).select(
        "page_id", "pos", "url", UR.same_domain("url", "page_url").alias("same"))


# ---------------------------------------------------------------- more inventory rows
@register("src_pages", lambda: (
    f"SELECT page_id, {SQ.host('url')} AS site, url, CAST(length(html) AS INTEGER) AS n_chars FROM pages"))
def q_src_pages(spark, sf):
    return read_pages(spark, sf).select("page_id", "site", "url", F.length("html").alias("n_chars"))


@register("warn_missing_price", lambda: "SELECT page_id, product_url FROM (" + EQ.extract_products_sql() +
          ") WHERE price = ''")
def q_warn_missing_price(spark, sf):
    return EX.extract_products(product_pages(spark, sf)).where(F.col("price") == "").select("page_id", "product_url")


@register("crawl_category_pages", lambda: LS.with_listing() + "SELECT name, page_url FROM chain WHERE depth = 1")
def q_crawl_category_pages(spark, sf):
    cats, links = _listing(spark, sf)
    return LI.pagination_chain(cats, LI.listing_pages(links), 1).select("name", "page_url")


@register("plp_to_pdp", lambda: (
    LS.with_listing(PRODUCT_PAGES_SQL.strip())
    + "SELECT c.site, c.name, c.url, f.page_id FROM collected c JOIN f3 f ON f.url = c.url"))
def q_plp_to_pdp(spark, sf):
    cats, links = _listing(spark, sf)
    collected = LI.category_product_links(cats, links)[0]
    pages = product_pages(spark, sf).select("url", "page_id")
    return collected.join(pages, "url").select("site", "name", "url", "page_id")


@register("order_category_nodes", lambda: RQ.with_merged(RQ.tree_cte()) + (
    "SELECT site, id, depth, row_number() OVER (PARTITION BY site ORDER BY depth, id) AS position FROM ("
    "SELECT site, id, depth FROM tree UNION ALL SELECT DISTINCT site, 'root', 0 FROM merged "
    "UNION ALL SELECT DISTINCT site, 'all', 1 FROM merged)"))
def q_order_category_nodes(spark, sf):
    nodes = C.catalog_categories(_merged(spark, sf)).select("site", "id", "depth")
    return C.order_category_nodes(nodes)


@register("merge_categories", lambda: LS.with_listing() + (
    "SELECT url AS category_key, arg_max(name, seq) AS name, url, array_to_string(arg_max(path, seq), ' > ') AS path, "
    "max(links) AS links_discovered FROM ("
    "SELECT 1 AS seq, c.name, c.url, [c.name] AS path, coalesce(n.links_discovered, 0) AS links FROM cats c "
    "LEFT JOIN counts n ON n.category_url = c.url UNION ALL "
    "SELECT 2, lower(name), url, [lower(name)], 0 FROM cats) GROUP BY url"))
def q_merge_categories(spark, sf):
    cats, links = _listing(spark, sf)
    counts = LI.category_product_links(cats, links)[1]
    first = cats.join(counts.select(F.col("category_url").alias("url"), "links_discovered"), "url", "left").select(
        F.lit(1).alias("seq"), "name", "url", "path",
        F.coalesce("links_discovered", F.lit(0)).alias("links_discovered"))
    second = cats.select(F.lit(2).alias("seq"), F.lower("name").alias("name"), "url",
                         F.array(F.lower("name")).alias("path"), F.lit(0).cast("bigint").alias("links_discovered"))
    m = C.merge_categories(first.unionByName(second))
    return m.withColumn("path", F.array_join("path", " > "))


@register("distinct_warnings", lambda: RQ.with_products() + (
    "SELECT site, sku AS message, min(seq) AS first_seq FROM prod WHERE price = '' GROUP BY site, sku"))
def q_distinct_warnings(spark, sf):
    w = _products(spark, sf).where(F.col("price") == "").select("site", "seq", F.col("sku").alias("message"))
    return QY.distinct_warnings(w)


@register("site_profile_join")
def q_site_profile_join(spark, sf):
    """Profiles are written (sink), read back by domain (source) and joined to
    every site; stored include patterns override the defaults (precedence)."""
    from shelfspark.sources import sinks as K
    from shelfspark.sources import tables as TB
    path = _sink_root(spark, "profiles")
    K.write_site_profiles(_site_profiles(spark, sf), path)
    sites = read_pages(spark, sf).select("site").distinct()
    joined = TB.site_profile_join(sites, TB.read_site_profiles(spark, path))
    joined = joined.withColumn("profile_include_patterns", F.col("include_patterns"))
    resolved = TB.config_precedence(joined, {"include_patterns": list(S.DEFAULT_INCLUDE)})
    return resolved.select("site", "domain", "platform_hint", F.array_join("include_patterns", " ").alias("include"))


# ---------------------------------------------------------------- per-function rows of the inventory
@register("dedupe_links", lambda: LQ.with_links(LQ.top_links("category_score", None)) +
          "SELECT page_id, rank, url, text, score FROM top")
def q_dedupe_links(spark, sf):
    """Best-scoring category link per URL and page, all of them (no cut)."""
    return L.top_links_per_page(read_pages(spark, sf), "category", None)


@register("page_type", lambda: PQ.with_profiles() + (
    f"SELECT page_id, {PQ.page_type('NULL', 'url', 'n_cat', 'n_prod', 'has_jsonld_product', 'has_add_to_cart', 'has_price_nodes')} "
    "AS detected_type FROM pp"))
def q_page_type(spark, sf):
    pp = P.page_profiles(read_pages(spark, sf))
    return pp.select("page_id", P.detected_type(F.lit(None).cast("string")).alias("detected_type"))


@register("category_path_from_url", lambda: (
    f"SELECT page_id, array_to_string({EQ.category_path_from_url('url')}, ' > ') AS path FROM pages"))
def q_category_path_from_url(spark, sf):
    return read_pages(spark, sf).select("page_id", F.array_join(EX.category_path_from_url(F.col("url")), " > ")
                                        .alias("path"))


@register("category_label_product", lambda: LQ.with_links() +
          f"SELECT page_id, pos, {EQ.format_label(SQ.url_slug('url'))} AS v FROM lk")
def q_category_label_product(spark, sf):
    return L.normalize_links(read_pages(spark, sf)).select(
        "page_id", "pos", EX.format_category_label(UR.url_slug("url")).alias("v"))


@register("normalize_sku", lambda: EQ.with_extraction() +
          f"SELECT page_id, {EQ.normalize_sku('sku', 'body_text', 'url')} AS sku FROM ex")
def q_normalize_sku(spark, sf):
    ex = EX.extraction(product_pages(spark, sf))
    return ex.select("page_id", EX.normalize_sku(F.col("sku"), F.col("body_text"), F.col("url")).alias("sku"))


@register("product_key_id", lambda: RQ.with_products() + "SELECT seq, product_id FROM prod")
def q_product_key_id(spark, sf):
    return _products(spark, sf).select("seq", "product_id")


@register("jsonld_nodes", lambda: EQ.with_extraction() + (
    "SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY si, i1, i2) AS INTEGER) AS pos, "
    "json_extract_string(n, '$.\"@type\"') AS type FROM nodes"))
def q_jsonld_nodes(spark, sf):
    pages = product_pages(spark, sf)
    nodes = pages.select("page_id", F.posexplode_outer(EX.jsonld_node_array(F.col("html"))).alias("p", "n")) \
        .where(F.col("n").isNotNull())
    return nodes.select("page_id", (F.col("p") + 1).cast("int").alias("pos"),
                        F.try_variant_get("n", "$['@type']", "string").alias("type"))


@register("merge_results", RQ.merge_products_sql)
def q_merge_results(spark, sf):
    """Two scrape passes (odd and even sightings) merged separately, then the
    passes folded together: must equal one merge over everything."""
    prods = PR.drop_unidentified(_products(spark, sf))
    first = PR.partial_merge(prods.where(F.col("seq") % 2 == 0))
    second = PR.partial_merge(prods.where(F.col("seq") % 2 == 1))
    merged = PR.finish_merge(PR.combine_partial(first.unionByName(second)))
    return _flat_products(merged, "product_key", "first_seq", "last_seq", "sightings")


def _passes(spark, sf):
    """Three passes: sightings by their number, categories as listed, in small letters,
    and without name but with more links; a warning per category."""
    from shelfspark.operators import results as RS
    sightings = _products(spark, sf)
    cats, links = _listing(spark, sf)
    found = LI.category_product_links(cats, links)[1].select(F.col("category_url").alias("url"), "links_discovered")
    listed = cats.join(found, "url", "left").select("site", "name", "url", "path", "links_discovered")
    passes = [listed, listed.select("site", F.lower("name").alias("name"), "url", F.array(F.lower("name")).alias("path"), F.lit(0).alias("links_discovered")),
              listed.select("site", F.lit("").alias("name"), "url", F.array().cast("array<string>").alias("path"), F.lit(40).alias("links_discovered"))]
    so_far = None
    for i, seen in enumerate(passes):
        told = seen.select("site", F.lit("no_products_in_category").alias("code"), F.col("url").alias("subject"))
        so_far = RS.merge_pass(so_far, sightings.where(F.col("seq") % 3 == i), seen.withColumn("seq", F.lit(i)), told)
    return so_far


@register("merge_results_summary", RQ.catalog_summary_sql)
def q_merge_results_summary(spark, sf):
    """Counts kept by difference over three passes equal one count over everything."""
    return _passes(spark, sf).summary


@register("merge_results_categories", lambda: LS.with_listing() + (
    f"SELECT {SQ.host('c.url')} AS site, c.url AS category_key, lower(c.name) AS name, c.url, lower(c.name) AS path, "
    "greatest(coalesce(n.links_discovered, 0), 40) AS links_discovered FROM cats c LEFT JOIN counts n ON n.category_url = c.url"))
def q_merge_results_categories(spark, sf):
    return _passes(spark, sf).categories.withColumn("path", F.array_join("path", " > "))


@register("order_category_paths", lambda: RQ.with_merged() + (
    "SELECT site, category_path, row_number() OVER (PARTITION BY site ORDER BY category_path) AS position "
    "FROM (SELECT DISTINCT site, category_path FROM merged WHERE category_path <> '')"))
def q_order_category_paths(spark, sf):
    return C.order_category_paths(_merged(spark, sf))


@register("order_category_paths_locale", lambda: RQ.with_merged() + (
    "SELECT site, category_path, row_number() OVER (PARTITION BY site ORDER BY " + SQ.fold("category_path") + ", lower(category_path), "
    "translate(category_path, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz'), category_path) "
    "AS position FROM (SELECT DISTINCT site, category_path FROM merged WHERE category_path <> '')"))
def q_order_category_paths_locale(spark, sf):
    return C.order_category_paths(_merged(spark, sf), locale=True)


@register("is_http_url", lambda: RQ.with_products() + (
    f"SELECT seq, {SQ.rx_match('coalesce(product_url, ' + SQ.EMPTY + ')', UR.HTTP_ABSOLUTE)} AS product_url_http, "
    f"{SQ.rx_match('coalesce(image, ' + SQ.EMPTY + ')', UR.HTTP_ABSOLUTE)} AS image_http FROM obs"))
def q_is_http_url(spark, sf):
    return product_observations(spark, sf).select("seq", UR.is_http_url("product_url").alias("product_url_http"),
                                                 UR.is_http_url("image").alias("image_http"))


@register("link_contextual", LQ.contextual_links_sql)
def q_link_contextual(spark, sf):
    return L.contextual_links(read_pages(spark, sf)).select("page_id", "url", "score")


@register("union_link_sources", lambda: LQ.with_links() + (
    "SELECT page_id, url, CAST(max(score) AS INTEGER) AS score FROM (SELECT page_id, url, product_score AS score "
    "FROM sc WHERE product_score >= 3 UNION ALL SELECT page_id, url, score FROM (" + LQ.contextual_links_sql() +
    ")) GROUP BY page_id, url"))
def q_union_link_sources(spark, sf):
    pages = read_pages(spark, sf)
    selector = L.scored_links(pages).where(F.col("product_score") >= 3) \
        .select("page_id", "url", F.col("product_score").alias("score"), "pos")
    return L.union_link_sources(selector, L.contextual_links(pages))


def _run_summary_sql():
    return RQ.with_merged(RQ._validated(), RQ.summary_cte(), RQ.distinct_cats_cte()) + (
        "SELECT s.site, CAST(coalesce(d.distinct_categories, 0) AS BIGINT) AS categories, product_count AS products, "
        "valid_products AS valid, products_with_errors AS with_errors, products_with_warnings AS with_warnings, "
        "CAST((CASE WHEN product_count > 0 AND price_coverage < 0.5 THEN 1 ELSE 0 END) + "
        "(CASE WHEN product_count > 0 AND image_coverage < 0.5 THEN 1 ELSE 0 END) + "
        "(CASE WHEN product_count > 0 AND category_coverage < 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS warnings "
        "FROM summ s LEFT JOIN dcat d USING (site)")


_ORACLE["sink_run_summary"] = _run_summary_sql
_ORACLE["sink_site_profile"] = lambda: PQ.with_profiles() + (
    "SELECT regexp_replace(site, '^www[.]', '') AS domain, platform_hint, confidence FROM sp")
_ORACLE["site_profile_join"] = lambda: PQ.with_profiles() + (
    "SELECT site, regexp_replace(site, '^www[.]', '') AS domain, platform_hint, "
    "array_to_string(list_concat(['/c/', 'cgid=', '/collections/', '/category/', '/departments/', '/shop/'], "
    "list_filter(category_patterns, lambda x: NOT list_contains(['/c/', 'cgid=', '/collections/', '/category/', "
    "'/departments/', '/shop/'], x))), ' ') AS include FROM sp")
_ORACLE["sink_export_all"] = lambda: RQ.with_merged(RQ.cards_cte()) + "SELECT site, product_id, price_label FROM cards"


_ORACLE["sink_b2c_inventory"] = RQ.inventory_lines_sql
_ORACLE["sink_b2c_pricebooks"] = RQ.pricebook_lines_sql
_ORACLE["sink_b2c_catalog"] = RQ.catalog_lines_sql
_ORACLE["discover_subcategories"] = DQ.discover_subcategories_sql


from shelfspark.plans import storefront  # noqa: E402,F401  registers its queries

__all__ = ["plans", "oracle", "register", "F"]
