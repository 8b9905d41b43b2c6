"""Category discovery from entry pages, listing-page subcategories and
requested-name matching -- per site, set at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.text import fold_text
from shelfspark.functions.urls import clean_url, normalise_url, url_origin
from shelfspark.operators.links import page_top_links

MAX_CATEGORIES = 4  # of the top-k report alone
FALLBACK_NAME = "catalog"


def entry_pages(pages: DataFrame) -> DataFrame:
    """The entry (first by ``seq``) page of every site.  Only the ids are
    aggregated; html is read for the chosen pages and never sorted."""
    first = pages.groupBy("site").agg(F.min(F.struct("seq", "page_id")).alias("p")).select("site", "p.page_id")
    return pages.join(first, ["site", "page_id"], "left_semi").select(*pages.columns)


def top_categories(pages: DataFrame, max_categories: int | None = MAX_CATEGORIES) -> DataFrame:
    """``(site, page_id, rank, name, url, path, score)``: category candidates of
    each page (same host, not product-like, score >= 3), best per URL,
    ordered by score then position, cut to ``3k`` unless k is None."""
    k = None if max_categories is None else max_categories * 3
    top = page_top_links(pages, k, category_filter=lambda x: x["product_score"] < 3)
    ex = top.select("site", "page_id", F.posexplode_outer("top_category_links").alias("r", "l")) \
        .where(F.col("l").isNotNull())
    return ex.select("site", "page_id", (F.col("r") + 1).cast("int").alias("rank"), F.col("l.text").alias("name"),
                     F.col("l.url").alias("url"), F.array("l.text").alias("path"), F.col("l.score").alias("score"))


def discover_categories(pages: DataFrame, max_categories: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Per site, categories discovered on its entry page; a site with none
    gets one ``catalog`` category for its entry URL and a warning row.

    Returns ``(categories(site, rank, name, url, path), warnings(site, code, url))``."""
    entries = entry_pages(pages)
    found = top_categories(entries, max_categories).select("site", "rank", "name", "url", "path")
    missing = entries.join(found.select("site").distinct(), "site", "left_anti")
    fallback = missing.select("site", F.lit(1).alias("rank"), F.lit(FALLBACK_NAME).alias("name"),
                              clean_url(normalise_url("url")).alias("url"),
                              F.array(F.lit(FALLBACK_NAME)).alias("path"))
    warnings = missing.select("site", F.lit("no_categories_detected").alias("code"),
                              clean_url(normalise_url("url")).alias("url"))
    return found.unionByName(fallback), warnings


def discover_subcategories(categories: DataFrame, pages: DataFrame,
                           max_sub: int | None = None) -> DataFrame:
    """Children of each category found on its own page (same host, not the
    category itself, not product-like, same origin), all or ``2k`` per parent;
    path = parent path + link text."""
    cat_pages = pages.withColumn("_u", clean_url(normalise_url("url"))) \
        .join(categories.select("site", F.col("url").alias("_u"), F.col("path").alias("parent_path"),
                                F.col("url").alias("parent_url")), ["site", "_u"])
    top = page_top_links(cat_pages.drop("_u"), None, extra=("parent_path", "parent_url"),
                         category_filter=lambda x: (x["product_score"] < 3) & (x["url"] != F.col("parent_url"))
                         & x["url"].startswith(url_origin(F.col("parent_url"))))
    found = F.col("top_category_links") if max_sub is None else F.slice("top_category_links", 1, max_sub * 2)
    ex = top.select("site", "parent_url", "parent_path",
                    F.posexplode_outer(found).alias("r", "l")).where(F.col("l").isNotNull())
    return ex.select("site", "parent_url", (F.col("r") + 1).cast("int").alias("rank"), F.col("l.text").alias("name"),
                     F.col("l.url").alias("url"), F.concat("parent_path", F.array("l.text")).alias("path"))


def category_name_match(categories: DataFrame, requests: DataFrame) -> DataFrame:
    """Per site and request, the first category (by ``rank``) whose folded
    name contains the folded request.  Joined on ``site`` (both sides are
    bounded per site: links of one entry page, a few requests), theta condition as
    a filter; ``min_by`` picks the first."""
    cats = categories.select("site", "rank", "name", "url", "path", fold_text("name").alias("_f"))
    req = requests.select("site", "req_no", F.col("name").alias("request"), fold_text("name").alias("_r"))
    hits = cats.join(req, "site").where((F.col("_r") != "") & F.col("_f").contains(F.col("_r")))
    best = hits.groupBy("site", "req_no", "request").agg(
        F.min_by(F.struct("rank", "name", "url", "path"), "rank").alias("m"))
    return best.select("site", "req_no", "request", F.col("m.rank").alias("rank"), F.col("m.name").alias("name"),
                       F.col("m.url").alias("url"), F.col("m.path").alias("path"))


def unmatched_requests(requests: DataFrame, matches: DataFrame) -> DataFrame:
    return requests.join(matches.select("site", "req_no"), ["site", "req_no"], "left_anti")


# Discovery label aliases (folded label -> display label).
LABEL_ALIASES = {
    "bags accessories": "Accesorios", "bolsos accesorios": "Accesorios", "men": "Hombre", "women": "Mujer",
    "hombre": "Hombre", "mujer": "Mujer", "ropa": "Ropa", "zapatos": "Zapatos", "unisex": "Unisex",
    "accessories": "Accesorios",
}


def category_label(col) -> F.Column:
    """Discovery label: drop ``-c123``/``-p123`` before an extension, dashes
    and underscores -> space, drop the extension; alias table on the folded
    label, else Title Case words."""
    c = F.regexp_replace(F.coalesce(col, F.lit("")), r"(?i)-([cp])[0-9]+(\.[a-z0-9]+)$", "$2")
    c = F.regexp_replace(c, "[-_]+", " ")
    c = F.trim(F.regexp_replace(c, r"(?i)\.[a-z0-9]+$", ""))
    alias = F.element_at(F.create_map(*[x for k, v in LABEL_ALIASES.items() for x in (F.lit(k), F.lit(v))]),
                         fold_text(c))
    words = F.filter(F.split(c, " "), lambda w: w != "")
    title = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)),
                                                               F.lower(F.substr(w, F.lit(2))))), " ")
    return F.coalesce(alias, title)
