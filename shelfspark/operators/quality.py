"""Product issues, catalog summary / warnings and quality actions (per site)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.text import percent_label

# Issue rules in order (level, field).
ISSUE_RULES = (
    ("error", "productId"),
    ("error", "name"),
    ("warning", "sku"),
    ("warning", "price"),
    ("warning", "productUrl"),
    ("warning", "imageUrls"),
    ("warning", "categoryPath"),
)
WARN_COVERAGE = 0.5
ACTION_COVERAGE = 0.8


def _failed(field: str) -> Column:
    if field == "productId":
        return F.col("product_id") == ""
    if field == "name":
        return F.col("name") == ""
    if field == "sku":
        return F.col("sku") == ""
    if field == "price":
        return F.col("price") == ""
    if field == "productUrl":
        return F.col("product_url") == ""
    if field == "imageUrls":
        return F.size("image_urls") == 0
    return (F.col("category_path") == "") & (F.size("all_category_paths") == 0)


def report_key() -> Column:
    """``product_id || sku || product_url || 'unknown-product'``."""
    return F.coalesce(F.nullif(F.col("product_id"), F.lit("")), F.nullif(F.col("sku"), F.lit("")),
                      F.nullif(F.col("product_url"), F.lit("")), F.lit("unknown-product"))


def issue_array() -> Column:
    return F.array_compact(F.array(*[
        F.when(_failed(field), F.struct(F.lit(n).alias("rule_no"), F.lit(level).alias("level"),
                                        F.lit(field).alias("field")))
        for n, (level, field) in enumerate(ISSUE_RULES, start=1)]))


def product_issues(products: DataFrame) -> DataFrame:
    """``issue(site, product_key, report_key, rule_no, level, field)``."""
    ex = products.select("site", "product_key", report_key().alias("report_key"),
                         F.explode_outer(issue_array()).alias("issue"))
    return ex.where(F.col("issue").isNotNull()).select(
        "site", "product_key", "report_key", F.col("issue.rule_no").alias("rule_no"),
        F.col("issue.level").alias("level"), F.col("issue.field").alias("field"))


def product_validation(products: DataFrame) -> DataFrame:
    """Per product: error / warning counts and validity (row-local)."""
    issues = issue_array()
    return products.select(
        "*",
        F.size(F.filter(issues, lambda i: i["level"] == "error")).alias("error_count"),
        F.size(F.filter(issues, lambda i: i["level"] == "warning")).alias("warning_count"),
    ).withColumn("valid", F.col("error_count") == 0)


def catalog_summary(products: DataFrame) -> DataFrame:
    """One row per site: counts and coverage ratios (4 decimals)."""
    v = product_validation(products)
    n = F.count("*")
    has_cat = (F.col("category_path") != "") | (F.size("all_category_paths") > 0)
    return v.groupBy("site").agg(
        n.alias("product_count"),
        F.count_if("valid").alias("valid_products"),
        F.count_if(F.col("error_count") > 0).alias("products_with_errors"),
        F.count_if(F.col("warning_count") > 0).alias("products_with_warnings"),
        F.sum("error_count").cast("bigint").alias("error_count"),
        F.sum("warning_count").cast("bigint").alias("warning_count"),
        F.round(F.count_if(F.col("price") != "") / n, 4).alias("price_coverage"),
        F.round(F.count_if(F.size("image_urls") > 0) / n, 4).alias("image_coverage"),
        F.round(F.count_if(has_cat) / n, 4).alias("category_coverage"),
    )


def catalog_warnings(summary: DataFrame) -> DataFrame:
    """``(site, code, detail)``: empty catalog, or coverage below 0.5."""
    rules = [
        (F.col("product_count") == 0, "no_products", F.lit("")),
        ((F.col("product_count") > 0) & (F.col("price_coverage") < WARN_COVERAGE), "low_price_coverage",
         percent_label("price_coverage")),
        ((F.col("product_count") > 0) & (F.col("image_coverage") < WARN_COVERAGE), "low_image_coverage",
         percent_label("image_coverage")),
        ((F.col("product_count") > 0) & (F.col("category_coverage") < WARN_COVERAGE), "low_category_coverage",
         percent_label("category_coverage")),
    ]
    arr = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(code).alias("code"), d.alias("detail")))
                                    for c, code, d in rules]))
    out = summary.select("site", F.inline_outer(arr))
    return out.where(F.col("code").isNotNull())


def distinct_category_count(products: DataFrame) -> DataFrame:
    """Distinct trimmed paths over ``category_path`` and ``all_category_paths``."""
    paths = products.select("site", F.explode(F.concat(F.array("category_path"), "all_category_paths")).alias("p"))
    paths = paths.select("site", F.trim("p").alias("p")).where(F.col("p") != "")
    # distinct first (partial aggregate), then count per site
    return paths.distinct().groupBy("site").agg(F.count("*").alias("distinct_categories"))


def quality_actions(summary: DataFrame, categories: DataFrame, category_urls_given: bool = False) -> DataFrame:
    """Per site: reasons, requested inputs (deduped by id, first wins) and
    severity, from the catalog summary and the category count.

    ``summary``: ``catalog_summary``; ``categories``: ``(site,
    categories_processed, distinct_categories)``."""
    s = summary.join(categories, "site", "left").fillna(0, ["categories_processed", "distinct_categories"])
    no_cat = F.col("categories_processed") == 0
    no_prod = F.col("product_count") == 0

    def low(c):
        return (F.col(c) > 0) & (F.col(c) < ACTION_COVERAGE)

    base_reasons = [
        (no_cat, "no_categories", [("plp_url", True), ("home_url", False)]),
        (no_prod, "no_products", [("plp_url", True), ("pdp_url", True)]),
        (low("price_coverage"), "low_price_coverage", [("pdp_url", True)]),
        (low("image_coverage"), "low_image_coverage", [("pdp_url", True)]),
        (low("category_coverage"), "low_category_coverage", [("plp_url", True)]),
    ]
    any_base = F.lit(False)
    for cond, _, _ in base_reasons:
        any_base = any_base | cond
    extra = (~any_base) & F.lit(category_urls_given) & ~no_prod & (F.col("distinct_categories") < 2)
    reasons = base_reasons + [(extra, "few_categories", [("additional_plp_url", False)])]
    reason_arr = F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code, _ in reasons]))
    inputs = F.array_compact(F.array(*[
        F.when(c, F.struct(F.lit(i).alias("id"), F.lit(req).alias("required")))
        for c, _, ins in reasons for i, req in ins]))
    # dedupe by id keeping the first occurrence
    inputs = F.filter(inputs, lambda x, i: ~F.exists(F.slice(inputs, 1, i), lambda y: y["id"] == x["id"]))
    status = F.when(F.size(reason_arr) > 0, "needs_user_input").otherwise("not_needed")
    severity = F.when(F.size(reason_arr) == 0, "none").when(no_cat | no_prod, "blocking").otherwise("advisory")
    return s.select("site", status.alias("status"), severity.alias("severity"),
                    reason_arr.alias("reasons"), inputs.alias("requested_inputs"))


def run_summary(summary: DataFrame, categories: DataFrame, warnings: DataFrame) -> DataFrame:
    """Per site: categories processed, products, valid products, products
    with errors / warnings and the number of catalog warnings."""
    w = warnings.groupBy("site").agg(F.count("*").alias("warnings"))
    out = summary.join(categories, "site", "left").join(w, "site", "left")
    return out.select("site", F.coalesce("categories_processed", F.lit(0)).cast("bigint").alias("categories"),
                      F.col("product_count").alias("products"), F.col("valid_products").alias("valid"),
                      F.col("products_with_errors").alias("with_errors"),
                      F.col("products_with_warnings").alias("with_warnings"),
                      F.coalesce("warnings", F.lit(0)).cast("bigint").alias("warnings"))


def distinct_warnings(warnings: DataFrame, message_col: str = "message") -> DataFrame:
    """Ordered de-duplication of warning messages: first ``seq`` per message."""
    return warnings.groupBy("site", message_col).agg(F.min("seq").alias("first_seq"))
