"""Configuration per site: reading files, and which level a setting comes from.

Settings are rows, not code.  A level (what the caller gives, the site's config
file, its stored profile, the defaults) is a table of ``site`` and one column per
setting; ``resolve`` stacks the levels as ``(site, key, value)`` rows and keeps,
by site and key, the row of the highest level that defines it, with the level's
name.  ``site_rules`` turns the result into the rules of ``storefront.page_facts``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.urls import url_host
from shelfspark.operators.storefront import PATTERN_RULES, SELECTOR_RULES

_LIST = "array<string>"
# Fields of a config file.
CONFIG_SCHEMA = (
    "name string, entryUrl string, currency string, lang string, categoryNames array<string>, categoryUrls array<string>, "
    "maxCategories int, maxSubcategoriesPerCategory int, productsPerCategory int, maxPaginationPages int, "
    f"categoryDiscovery struct<selectors:{_LIST},includePatterns:{_LIST},excludePatterns:{_LIST}>, "
    f"productDiscovery struct<selectors:{_LIST}>, pagination struct<selectors:{_LIST}>, "
    f"productExtraction struct<name:{_LIST},description:{_LIST},sku:{_LIST},price:{_LIST},currency:{_LIST},images:{_LIST}>")
# Setting -> field of a config file.
FIELDS = {
    "entry_url": "entryUrl", "currency": "currency", "lang": "lang", "category_names": "categoryNames", "category_urls": "categoryUrls",
    "max_categories": "maxCategories", "max_subcategories": "maxSubcategoriesPerCategory", "products_per_category": "productsPerCategory",
    "max_pages": "maxPaginationPages", "category_selectors": "categoryDiscovery.selectors", "include_patterns": "categoryDiscovery.includePatterns",
    "exclude_patterns": "categoryDiscovery.excludePatterns", "product_selectors": "productDiscovery.selectors",
    "pagination_selectors": "pagination.selectors",
    **{f"{f}_selectors": f"productExtraction.{f}" for f in ("name", "description", "sku", "price", "currency", "images")},
}
# Defaults besides selectors and patterns.
DEFAULTS = {"currency": ["USD"], "lang": ["x-default"], "max_categories": ["4"], "max_subcategories": ["2"], "products_per_category": ["10"], "max_pages": ["3"],
            "category_names": [], "category_urls": [], **SELECTOR_RULES, **PATTERN_RULES}
LEVELS = ("explicit", "config", "profile", "default")
#: Settings that an empty value leaves to the next level; others are defined by any value.
FALL_THROUGH = ("entry_url", "category_names", "category_urls")


def read_site_configs(spark: SparkSession, path: str) -> DataFrame:
    """Config files below `path` (one JSON object each) -> ``site``, ``name`` and a
    column per setting; an absent path has no configs.  Of several files for one
    site the first by name counts."""
    try:
        raw = spark.read.schema(CONFIG_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        raw = spark.createDataFrame([], CONFIG_SCHEMA)
    wide = raw.select(url_host("entryUrl").alias("site"), "name", *[F.col(f).alias(k) for k, f in FIELDS.items()]).where("site <> ''")
    own = [c for c in wide.columns if c != "site"]
    return wide.groupBy("site").agg(F.min(F.struct(*own)).alias("c")).select("site", "c.*")


def _value(df: DataFrame, key: str) -> Column:
    """A setting as an array of texts; null where the level does not define it."""
    kind = dict(df.dtypes)[key]
    value = F.col(key).cast(_LIST) if kind.startswith("array") else F.when(F.col(key).isNotNull(), F.array(F.col(key).cast("string")))
    if key in FALL_THROUGH:
        return F.when(F.size(F.filter(value, lambda v: v != "")) > 0, value)
    return value


def _rows(df: DataFrame, level: int) -> DataFrame:
    keys = [k for k in FIELDS if k in df.columns]
    rows = df.select("site", F.inline(F.array(*[F.struct(F.lit(k).alias("key"), _value(df, k).alias("value")) for k in keys])))
    return rows.where("value is not null").withColumn("level", F.lit(level))


def resolve(sites: DataFrame, explicit: DataFrame | None = None, config: DataFrame | None = None,
            profile: DataFrame | None = None) -> DataFrame:
    """``(site, key, value ARRAY<STRING>, source)`` for every site of `sites`."""
    known = sites.select("site").distinct()
    defaults = known.select("site", F.inline(F.array(*[
        F.struct(F.lit(k).alias("key"), F.array(*map(F.lit, v)).cast(_LIST).alias("value")) for k, v in DEFAULTS.items()])))
    rows = defaults.withColumn("level", F.lit(3))
    for level, df in enumerate((explicit, config, profile)):
        if df is not None:
            rows = rows.unionByName(_rows(df.join(known, "site", "left_semi"), level))
    best = rows.groupBy("site", "key").agg(F.min(F.struct("level", "value")).alias("r"))
    return best.select("site", "key", "r.value", F.get(F.array(*map(F.lit, LEVELS)), F.col("r.level")).alias("source"))


def site_rules(resolved: DataFrame) -> DataFrame:
    """Selectors and patterns that are not the defaults, one row per site that has any."""
    rules = [*SELECTOR_RULES, *PATTERN_RULES]
    own = resolved.where((F.col("source") != "default") & F.col("key").isin(rules))
    return own.groupBy("site").agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in rules])
