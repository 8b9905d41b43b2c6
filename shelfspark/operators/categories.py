"""Category trees, assignments and requested-category matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.text import fold_text, normalize_whitespace, slugify
from shelfspark.operators.ordering import positions, stored

ALL_PRODUCTS = "All Products"


def _segments(path: Column) -> Column:
    return F.filter(F.transform(F.split(path, ">"), lambda s: F.trim(s)), lambda s: s != "")


def category_tree(products: DataFrame) -> DataFrame:
    """``category_node(site, full_path, id, name, path, depth, parent_id)``:
    every prefix of every known path, distinct per site."""
    segs = products.select("site", F.explode("all_category_paths").alias("p")) \
        .select("site", _segments(F.col("p")).alias("segs"))
    prefixes = segs.select("site", F.explode(F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("segs"), F.lit(1))),
        lambda i: F.slice("segs", 1, i))).alias("path")).where(F.size("path") > 0)
    nodes = prefixes.select("site", "path").distinct()  # map-side partial dedupe
    full = F.array_join("path", " > ")
    parent = F.array_join(F.slice("path", 1, F.size("path") - 1), " > ")
    return nodes.select(
        "site", full.alias("full_path"), slugify(full).alias("id"),
        F.try_element_at("path", F.lit(-1)).alias("name"), "path",
        F.size("path").alias("depth"),
        F.when(F.size("path") > 1, slugify(parent)).otherwise(F.lit("")).alias("parent_id"))


def synthetic_categories(sites: DataFrame) -> DataFrame:
    """Root and All Products nodes for every site."""
    return sites.select("site").distinct().select("site", F.inline(F.array(
        F.struct(F.lit("Root").alias("full_path"), F.lit("root").alias("id"), F.lit("Root").alias("name"),
                 F.array(F.lit("Root")).alias("path"), F.lit(0).alias("depth"), F.lit("").alias("parent_id")),
        F.struct(F.lit(ALL_PRODUCTS).alias("full_path"), F.lit("all").alias("id"),
                 F.lit(ALL_PRODUCTS).alias("name"), F.array(F.lit(ALL_PRODUCTS)).alias("path"),
                 F.lit(1).alias("depth"), F.lit("root").alias("parent_id")))))


def catalog_categories(products: DataFrame) -> DataFrame:
    """Synthetic + tree nodes with the effective parent (``root`` for tops)."""
    nodes = synthetic_categories(products).unionByName(category_tree(products))
    eff = F.when(F.col("parent_id") != "", F.col("parent_id")) \
        .when(F.col("id") != "root", F.lit("root")).otherwise(F.lit(""))
    return nodes.withColumn("effective_parent", eff)


def primary_path() -> Column:
    cp, allp = F.col("category_path"), F.col("all_category_paths")
    return F.when((cp != "") & F.array_contains(allp, cp), cp).otherwise(F.try_element_at(allp, F.lit(1)))


def category_assignments(products: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(site, product_id, category_id, path, primary, ord)`` and the columns
    of ``carry``: ``all``, each leaf path and each strict ancestor.

    A site's tree holds every prefix of its products' trimmed paths, so a path
    has a node exactly if it equals its own trimmed, re-joined segments; no
    join is needed, and rows of one product stay its own."""
    p = products.select("site", "product_id", *carry, "all_category_paths", primary_path().alias("primary_path"))
    leaves = F.filter(F.array_distinct(F.concat(F.array("primary_path"), "all_category_paths")),
                      lambda x: x.isNotNull() & (x != ""))
    p = p.withColumn("leaves", leaves)
    # sequence(1, 0) counts down; keep only proper ancestors
    expanded = F.flatten(F.transform("leaves", lambda leaf: F.concat(
        F.array(leaf),
        F.transform(F.filter(F.sequence(F.lit(0), F.size(_segments(leaf)) - 1), lambda i: i > 0),
                    lambda i: F.array_join(F.slice(_segments(leaf), 1, i), " > ")))))
    paths = F.array_distinct(F.concat(F.array(F.lit(ALL_PRODUCTS)), expanded))
    rows = p.select("site", "product_id", *carry, "primary_path", F.posexplode(paths).alias("ord", "path"))
    everything = F.col("path") == ALL_PRODUCTS
    rows = rows.where(everything | (F.array_join(_segments(F.col("path")), " > ") == F.col("path")))
    return rows.select(
        "site", "product_id", *carry, F.when(everything, F.lit("all")).otherwise(slugify("path")).alias("category_id"), "path",
        ((F.col("path") == F.col("primary_path")) | (everything & F.col("primary_path").isNull())).alias("primary"), "ord")


__all__ = ["category_tree", "category_assignments", "catalog_categories", "normalize_whitespace"]


def merge_categories(categories: DataFrame) -> DataFrame:
    """Fold category sightings ``(seq, name, url, path, links_discovered)``:
    key = url || path || name; last non-empty name / url / path by ``seq``,
    the largest link count (partial aggregates)."""
    key = F.coalesce(F.nullif(F.col("url"), F.lit("")),
                     F.nullif(F.array_join(F.coalesce("path", F.array().cast("array<string>")), " > "), F.lit("")),
                     F.nullif(F.col("name"), F.lit("")))
    keyed = categories.withColumn("category_key", key).where(F.col("category_key").isNotNull())
    return keyed.groupBy("category_key").agg(
        F.expr("max_by(name, seq) FILTER (WHERE name <> '')").alias("name"),
        F.expr("max_by(url, seq) FILTER (WHERE url <> '')").alias("url"),
        F.expr("max_by(path, seq) FILTER (WHERE size(path) > 0)").alias("path"),
        F.max(F.coalesce("links_discovered", F.lit(0))).alias("links_discovered"))


def order_category_nodes(nodes: DataFrame) -> DataFrame:
    """Export order of category nodes per site: depth, then id."""
    return positions(stored(nodes, "category-nodes"), ["site"], ["depth", "id"])


def locale_keys(col: str) -> dict[str, Column]:
    """Sort keys of a text as readers expect: letters without accents and case, then
    accents, then small letters before capitals."""
    small, large = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return {"__letters": fold_text(col), "__accents": F.lower(col), "__case": F.translate(col, small + large, large + small)}


def order_category_paths(products: DataFrame, locale: bool = False) -> DataFrame:
    """``(site, category_path, position)``: distinct non-empty paths of each site in
    order, by code point or by ``locale_keys``; a site's paths may span many tasks."""
    paths = products.where(F.col("category_path") != "").select("site", "category_path").distinct()
    keys = locale_keys("category_path") if locale else {}
    order = [*keys, "category_path"]
    return positions(stored(paths.withColumns(keys), "category-paths"), ["site"], order).select("site", "category_path", "position")
