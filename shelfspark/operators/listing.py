"""Listing pages (PLP): pagination chains and product links per category.

Set-at-a-time form of the per-category crawl loop:

* ``pagination_chain``: from each category URL follow ``next`` links, stopping
  on a revisit or a missing page -- one equi-join on the page URL a level.
  Without ``max_pages`` the levels go on until no category has a next page.
* ``category_product_links``: product links of the chained pages, first
  occurrence per URL wins (partial ``min`` per category and URL).  With
  ``per_category`` the crawl stops after the page where so many distinct links
  were reached, and the first so many in crawl order are kept; without it all
  links of all pages count.

A category is ``(site, category_url, name)``: equal names on two sites are two
categories.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions import scoring as S
from shelfspark.functions.text import normalize_whitespace
from shelfspark.functions.urls import absolute_url, base_parts, same_domain, url_host
from shelfspark.operators.common import fence
from shelfspark.session import checkpoint_dir

CATEGORY = ["site", "category_url", "name"]


def listing_pages(links: DataFrame) -> DataFrame:
    """Distinct listing pages ``(page_url, next_url)`` of an F4-shaped table;
    ``next_url`` is the resolved ``next_href`` ('' when none)."""
    pages = links.groupBy("page_url").agg(F.min_by("next_href", F.struct("pos", "next_href")).alias("next_href"))
    pages = fence(pages, _b=base_parts("page_url"))
    nxt = F.when(F.col("next_href") != "", absolute_url("next_href", "_b")).otherwise(F.lit(""))
    return fence(pages.select("page_url", "next_href", "_b"), next_url=nxt).select("page_url", "next_url")


def categories_from_listing(links: DataFrame) -> DataFrame:
    """Category targets: first page of each category, ``seq`` by name."""
    first = links.where(F.col("page_no") == 1).select("category", F.col("page_url").alias("url")).distinct()
    return first.select(url_host("url").alias("site"), F.col("category").alias("name"), "url", F.array("category").alias("path"))


def dedupe_category_targets(categories: DataFrame, order_col: str = "name") -> DataFrame:
    """One category per URL: the first by ``order_col`` (partial aggregate)."""
    best = categories.groupBy("url").agg(F.min_by(F.struct(*categories.columns), order_col).alias("c"))
    return best.select("c.*")


def pagination_chain(categories: DataFrame, pages: DataFrame, max_pages: int | None = None) -> DataFrame:
    """``(site, category_url, name, depth, page_url)``: pages visited per
    category, from depth 1.  Unbounded, each level is checkpointed: the next one
    starts from it, and the loop asks only whether any page is left."""
    checkpoint_dir(categories.sparkSession)
    frontier = categories.select("site", F.col("url").alias("category_url"), "name", F.lit(1).alias("depth"),
                                 F.col("url").alias("page_url"), F.array("url").alias("seen"))
    if max_pages is None:
        pages = pages.checkpoint()
    levels = []
    while True:
        # only pages that exist are visited (a missing page ends the chain)
        hit = frontier.join(pages, "page_url")
        if max_pages is None:
            hit = hit.checkpoint()
        levels.append(hit.select(*CATEGORY, "depth", "page_url"))
        if len(levels) == max_pages:
            break
        frontier = hit.where((F.col("next_url") != "") & ~F.array_contains("seen", F.col("next_url"))) \
            .select(*CATEGORY, (F.col("depth") + 1).alias("depth"), F.col("next_url").alias("page_url"),
                    F.concat("seen", F.array("next_url")).alias("seen"))
        if max_pages is None and frontier.isEmpty():
            break
    return reduce(DataFrame.unionByName, levels)


def page_product_links(links: DataFrame) -> DataFrame:
    """Product links of each listing page: resolved, same host, product score
    >= 3, best per URL on the page (ties: document order)."""
    res = fence(links.select("page_url", "pos", "href", "text"), _b=base_parts("page_url"))
    res = fence(res, url=absolute_url("href", "_b"), text=normalize_whitespace("text"))
    res = res.where((F.col("url") != "") & same_domain("url", "page_url"))
    res = fence(res, score=S.score_product_url("url")).where(F.col("score") >= S.PRODUCT_LIKE_MIN)
    best = res.groupBy("page_url", "url").agg(
        F.min(F.struct((-F.col("score")).alias("neg"), "pos", "text")).alias("b"))
    return best.select("page_url", "url", (-F.col("b.neg")).cast("int").alias("score"),
                       F.col("b.pos").alias("pos"), F.col("b.text").alias("text"))


def category_product_links(categories: DataFrame, links: DataFrame, max_pages: int | None = None,
                           per_category: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Returns ``(collected, counts)``.

    ``collected(site, category_url, name, rank, url, score, depth)``: the product
    URLs in crawl order, the first ``per_category`` where given;
    ``counts(site, category_url, name, links_discovered, pages_visited)``: all
    distinct links on the pages visited before the stop, 0 where there is none.
    """
    chain = pagination_chain(categories, listing_pages(links), max_pages)
    first = chain.join(page_product_links(links), "page_url").groupBy(*CATEGORY, "url").agg(
        F.min(F.struct("depth", (-F.col("score")).alias("neg"), "pos")).alias("f"))
    first = first.select(*CATEGORY, "url", F.col("f.depth").alias("depth"), (-F.col("f.neg")).alias("score"),
                         F.col("f.pos").alias("pos"))
    per_depth = first.groupBy(*CATEGORY, "depth").agg(F.count("*").alias("links"))
    # one row per visited page of a category, also where it has no new link
    steps = chain.join(per_depth, [*CATEGORY, "depth"], "left") \
        .select(*CATEGORY, "depth", F.coalesce("links", F.lit(0)).alias("links"))
    earlier = Window.partitionBy(*CATEGORY).orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    visited = steps.withColumn("before", F.coalesce(F.sum("links").over(earlier), F.lit(0)))
    if per_category is not None:
        visited = visited.where(F.col("before") < per_category)
    found = visited.groupBy(*CATEGORY).agg(F.sum("links").alias("links_discovered"), F.max("depth").alias("pages_visited"))
    counts = categories.select("site", F.col("url").alias("category_url"), "name").join(found, CATEGORY, "left").select(
        *CATEGORY, F.coalesce("links_discovered", F.lit(0)).alias("links_discovered"),
        F.coalesce("pages_visited", F.lit(0)).alias("pages_visited"))
    kept = first.join(visited.select(*CATEGORY, "depth"), [*CATEGORY, "depth"])
    rank = Window.partitionBy(*CATEGORY).orderBy("depth", F.desc("score"), "pos", "url")
    collected = kept.withColumn("rank", F.row_number().over(rank))
    if per_category is not None:
        collected = collected.where(F.col("rank") <= per_category)
    return collected.select(*CATEGORY, F.col("rank").cast("int").alias("rank"), "url", "score", "depth"), counts


def unprocessed(new: DataFrame, done: DataFrame, key: str = "url") -> DataFrame:
    """Rows of ``new`` whose key was not processed yet (left anti join)."""
    return new.join(done.select(key).distinct(), key, "left_anti")
