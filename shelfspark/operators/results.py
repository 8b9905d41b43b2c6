"""Merging the results of crawl passes, with counts kept by difference.

``Results`` holds what passes have found so far: the partial states of products and
categories, the warnings, and per site the counts that the summary is made of.
``merge_pass`` folds in another pass.  Only the products that the pass touches are
merged and validated again: their old rows are subtracted from the counts and their
new ones added, so that the work follows the pass and not the catalog.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.operators import products as PR
from shelfspark.operators import quality as QY
from shelfspark.operators.ordering import stored

KEY = ["site", "product_key"]
COUNTS = ["product_count", "valid_products", "products_with_errors", "products_with_warnings", "error_count", "warning_count",
          "with_price", "with_image", "with_category"]


@dataclass
class Results:
    state: DataFrame
    counts: DataFrame
    category_state: DataFrame
    told: DataFrame

    @property
    def products(self) -> DataFrame:
        return PR.finish_merge(self.state)

    @property
    def categories(self) -> DataFrame:
        """``(site, category_key, name, url, path, links_discovered)``."""
        return self.category_state.select("site", "category_key", *[F.coalesce(f"{c}.x", F.lit("")).alias(c) for c in ("name", "url")],
                                          F.coalesce("path.x", F.array().cast("array<string>")).alias("path"), "links_discovered")

    @property
    def summary(self) -> DataFrame:
        share = lambda c: F.when(F.col("product_count") > 0, F.round(F.col(c) / F.col("product_count"), 4)).otherwise(F.lit(0.0))
        return self.counts.select("site", *COUNTS[:6], share("with_price").alias("price_coverage"), share("with_image").alias("image_coverage"),
                                  share("with_category").alias("category_coverage"))

    @property
    def warnings(self) -> DataFrame:
        """``(site, code, subject)``: those of the passes and of the present summary."""
        low = QY.catalog_warnings(self.summary).withColumnRenamed("detail", "subject")
        return self.told.select("site", "code", "subject").unionByName(low)


def _counts(products: DataFrame, sign: int) -> DataFrame:
    v = QY.product_validation(products)
    has_category = (F.col("category_path") != "") | (F.size("all_category_paths") > 0)
    one = lambda c: F.when(c, F.lit(sign)).otherwise(F.lit(0)).cast("bigint")
    return v.select("site", one(F.lit(True)).alias("product_count"), one(F.col("valid")).alias("valid_products"),
                    one(F.col("error_count") > 0).alias("products_with_errors"), one(F.col("warning_count") > 0).alias("products_with_warnings"),
                    (F.col("error_count") * sign).cast("bigint").alias("error_count"), (F.col("warning_count") * sign).cast("bigint").alias("warning_count"),
                    one(F.col("price") != "").alias("with_price"), one(F.size("image_urls") > 0).alias("with_image"), one(has_category).alias("with_category"))


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("site").agg(*[F.sum(c).alias(c) for c in COUNTS])


def category_key() -> Column:
    """The URL of a category, else its path, else its name."""
    path = F.array_join(F.coalesce("path", F.array().cast("array<string>")), " > ")
    return F.coalesce(F.nullif(F.col("url"), F.lit("")), F.nullif(path, F.lit("")), F.nullif(F.col("name"), F.lit("")))


def _category_state(categories: DataFrame) -> DataFrame:
    """Mergeable state of ``(site, seq, name, url, path, links_discovered)``: the last
    non-empty name, URL and path and the most links of a site's category."""
    last = lambda c, given: F.max(F.when(given, F.struct(F.col("seq").alias("s"), F.col(c).alias("x")))).alias(c)
    keyed = categories.withColumn("category_key", category_key()).where("category_key is not null")
    return keyed.groupBy("site", "category_key").agg(
        last("name", F.col("name") != ""), last("url", F.col("url") != ""), last("path", F.size("path") > 0),
        F.max(F.coalesce("links_discovered", F.lit(0)).cast("bigint")).alias("links_discovered"))


def merge_pass(so_far: Results | None, sightings: DataFrame, categories: DataFrame, warnings: DataFrame) -> Results:
    """`so_far` and one pass: canonical sightings (``site, seq, ...``), categories ``(site,
    seq, name, url, path, links_discovered)`` and warnings ``(site, code, subject)``.
    ``seq`` orders sightings over all passes."""
    part = stored(PR.partial_merge(PR.drop_unidentified(sightings)), "pass-products")
    seen = _category_state(categories)
    told = warnings.select("site", "code", "subject").distinct()
    if so_far is None:
        return Results(part, stored(_summed(_counts(PR.finish_merge(part), 1)), "pass-counts"), stored(seen, "pass-categories"), stored(told, "pass-warnings"))
    touched = part.select(*KEY).distinct()
    old = stored(so_far.state.join(touched, KEY, "left_semi"), "pass-old")
    new = stored(PR.combine_partial(old.unionByName(part)), "pass-new")
    state = stored(so_far.state.join(touched, KEY, "left_anti").unionByName(new), "pass-state")
    change = _counts(PR.finish_merge(old), -1).unionByName(_counts(PR.finish_merge(new), 1))
    both = so_far.category_state.unionByName(seen).groupBy("site", "category_key").agg(
        *[F.max(c).alias(c) for c in ("name", "url", "path", "links_discovered")])
    return Results(state, stored(_summed(so_far.counts.unionByName(_summed(change))), "pass-counts"), stored(both, "pass-categories"),
                   stored(so_far.told.unionByName(told).distinct(), "pass-warnings"))
