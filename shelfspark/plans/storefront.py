"""Registered queries of the composed crawl, over the shops made from ``part``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions import elements as E
from shelfspark.operators import crawl as CR
from shelfspark.operators import extract as EX
from shelfspark.operators.ordering import stored
from shelfspark.operators.storefront import page_facts
from shelfspark.oracle import storefront_sql as Q
from shelfspark.plans.registry import _flat_products, _sink_root, register
from shelfspark.session import LARGE_VALUES, dealt
from shelfspark.sources import site_config as SC
from shelfspark.sources.storefronts import category_requests, site_settings, storefront_pages

DETAILS_FROM = 100_000_000  # page ids of product pages


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    # dealt, as pages that list a whole shop are work for many and small when compressed
    return stored(dealt(storefront_pages(spark, sf)), "storefront-pages", **LARGE_VALUES)


def _catalog(spark: SparkSession, sf: str, requests: bool = False) -> CR.Catalog:
    return CR.build_catalog(_pages(spark, sf), category_requests(spark, sf) if requests else None)


def _joined(df: DataFrame) -> DataFrame:
    return df.withColumn("path", F.array_join("path", " > "))


@register("select_field", Q.select_field_sql)
def q_select_field(spark, sf):
    details = E.with_elements(_pages(spark, sf).where(F.col("page_id") >= DETAILS_FROM))
    groups = F.array(*[E.selectors(t) for t in EX.FIELD_SELECTORS.values()])
    got = details.select("page_id", F.transform(groups, lambda s: E.first_values(F.col("dom"), s)).alias("v"))
    first = [F.coalesce(F.try_element_at(F.col("v")[i], F.lit(1)), F.lit("")).alias(name)
             for i, name in enumerate(EX.FIELD_SELECTORS) if name != "images"]
    return got.select("page_id", *first, F.array_join(F.array_distinct(F.col("v")[list(EX.FIELD_SELECTORS).index("images")]), " ").alias("images"))


@register("dom_breadcrumb", Q.dom_breadcrumb_sql)
def q_dom_breadcrumb(spark, sf):
    details = E.with_elements(_pages(spark, sf).where(F.col("page_id") >= DETAILS_FROM))
    crumbs = E.first_values(F.col("dom"), E.selectors([f"{c} a" for c in EX.BREADCRUMB_CONTAINERS]))
    return details.select("page_id", F.array_join(crumbs, " > ").alias("breadcrumb"))


@register("link_filter_category", Q.menu_links_sql)
def q_link_filter_category(spark, sf):
    facts = page_facts(_pages(spark, sf)).select("page_id", F.posexplode_outer("categories").alias("i", "c")).where("c is not null")
    return facts.select("page_id", (F.col("i") + 1).alias("rank"), "c.url", "c.text", "c.score")


@register("page_product_links", Q.product_links_sql)
def q_page_product_links(spark, sf):
    """Links by selector and by card in one order: the contextual ones have rows here."""
    facts = page_facts(_pages(spark, sf)).select("page_id", F.posexplode_outer("products").alias("i", "p")).where("p is not null")
    return facts.select("page_id", (F.col("i") + 1).alias("rank"), "p.url", "p.score", "p.by_card")


@register("link_contextual_cards", lambda: f"SELECT page_id, url, score FROM ({Q.product_links_sql()}) WHERE by_card")
def q_link_contextual_cards(spark, sf):
    """Links that only their card makes product links, in cards of nested blocks."""
    facts = page_facts(_pages(spark, sf)).select("page_id", F.explode_outer("products").alias("p")).where("p.by_card")
    return facts.select("page_id", "p.url", "p.score")


@register("next_listing_page", Q.next_page_sql)
def q_next_listing_page(spark, sf):
    listings = _pages(spark, sf).where(F.col("page_id").between(1000, 999_999))
    return page_facts(listings).select("page_id", "next_url")


@register("shop_subcategories", Q.subcategories_sql)
def q_shop_subcategories(spark, sf):
    """Menu links of each top-level category's own page."""
    catalog = _catalog(spark, sf)
    below = CR.subcategories(catalog.top.drop("name"), catalog.facts)
    return below.select("site", "url", "sub", "sub_name", "sub_url", F.array_join("sub_path", " > ").alias("sub_path"))


@register("requested_categories", Q.requested_sql)
def q_requested_categories(spark, sf):
    catalog = _catalog(spark, sf)
    return _joined(CR.requested_categories(catalog.top, catalog.facts, category_requests(spark, sf))[0])


@register("select_requested_categories", lambda: Q.requested_sql((0, 1)))
def q_select_requested_categories(spark, sf):
    """Category URLs and names of the first tier."""
    catalog = _catalog(spark, sf)
    nothing_below = catalog.facts.withColumn("categories", F.slice("categories", 1, 0))
    return _joined(CR.requested_categories(catalog.top, nothing_below, category_requests(spark, sf))[0])


@register("unmatched_category_names", Q.unmatched_sql)
def q_unmatched_category_names(spark, sf):
    catalog = _catalog(spark, sf)
    return CR.requested_categories(catalog.top, catalog.facts, category_requests(spark, sf))[1]


@register("first_category_visit", Q.first_visit_sql)
def q_first_category_visit(spark, sf):
    return _joined(_catalog(spark, sf).claims).drop("nth")


@register("category_product_links", Q.category_links_sql)
def q_category_product_links(spark, sf):
    catalog = _catalog(spark, sf)
    return CR.category_product_links(catalog.claims, catalog.facts)[0].select("site", "url", "product_url", "depth", "rank")


@register("build_catalog", Q.products_sql)
def q_build_catalog(spark, sf):
    return _flat_products(_catalog(spark, sf).products, "product_key", "sightings")


@register("build_catalog_categories", Q.categories_sql)
def q_build_catalog_categories(spark, sf):
    return _joined(_catalog(spark, sf).categories)


@register("build_catalog_warnings", Q.warnings_sql)
def q_build_catalog_warnings(spark, sf):
    return _catalog(spark, sf).warnings


@register("build_catalog_summary", Q.summary_sql)
def q_build_catalog_summary(spark, sf):
    return _catalog(spark, sf).summary


@register("validate_catalog", Q.issues_sql)
def q_validate_catalog(spark, sf):
    return _catalog(spark, sf).issues


def _settings(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Explicit settings, config files written and read back, profiles."""
    explicit, config, profile = site_settings(spark, sf)
    path = _sink_root(spark, "site-configs")
    config.repartition("folder").write.partitionBy("folder").option("maxRecordsPerFile", 1).json(path)
    return explicit, SC.read_site_configs(spark, path), profile


@register("src_site_config", Q.site_config_sql)
def q_src_site_config(spark, sf):
    config = _settings(spark, sf)[1]
    lists = ("category_urls", "category_selectors", "include_patterns", "exclude_patterns", "name_selectors", "price_selectors")
    return config.select("site", "name", "entry_url", "currency", *[F.array_join(c, " ").alias(c) for c in lists])


@register("config_precedence", Q.config_precedence_sql)
def q_config_precedence(spark, sf):
    explicit, config, profile = _settings(spark, sf)
    sites = _pages(spark, sf).select("site")
    resolved = SC.resolve(sites, explicit, config, profile)
    shown = ("entry_url", "currency", "category_names", "category_urls", "category_selectors", "include_patterns", "exclude_patterns", "name_selectors", "max_pages")
    return resolved.where(F.col("key").isin(*shown)).withColumn("value", F.array_join("value", " "))


@register("site_config_discovery", Q.site_config_discovery_sql)
def q_site_config_discovery(spark, sf):
    """Categories of the entry pages where each site's settings apply."""
    entries = _pages(spark, sf).where(F.col("page_id") < 1000)
    rules = SC.site_rules(SC.resolve(entries.select("site"), *_settings(spark, sf)))
    facts = page_facts(entries, rules).select("page_id", F.posexplode_outer("categories").alias("i", "c")).where("c is not null")
    return facts.select("page_id", (F.col("i") + 1).alias("rank"), "c.url", "c.score")
