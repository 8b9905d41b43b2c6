"""Link extraction, normalisation, scoring, dedupe and top-k.

Two shapes are offered:

* row-local (``page_links``): each page keeps its links as an array column and
  all per-page work (filter, score, dedupe, top-k) runs with higher-order
  array functions inside the scan stage -- no shuffle at any scale;
* exploded (``extract_links`` / ``normalize_links``): one row per link, for
  per-site work that must shuffle by ``site`` or by URL anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions import scoring
from shelfspark.functions.text import fold_text, normalize_whitespace, strip_html
from shelfspark.functions.urls import base_parts, project, resolve_links, same_domain, stage

# Anchor pattern (quote style matched by back-reference) and the
# markup whose content a DOM never exposes as links.
ANCHOR_RE = r"""(?i)<a\b[^>]*href=(["'])(.*?)\1[^>]*>([\s\S]*?)</a>"""
HIDDEN_MARKUP_RE = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>"
TITLE_RE = r"(?i)<title[^>]*>([\s\S]*?)</title>"


def visible_html(html) -> Column:
    h = F.col(html) if isinstance(html, str) else html
    return F.regexp_replace(F.coalesce(h, F.lit("")), HIDDEN_MARKUP_RE, " ")


def _href(match: Column) -> Column:
    return F.replace(F.regexp_extract(match, ANCHOR_RE, 2), F.lit("&amp;"), F.lit("&"))


def page_links(pages: DataFrame, extra: tuple = ()) -> DataFrame:
    """``(page_id, site, url, base, links ARRAY<STRUCT<pos,url,text>>)``
    plus the named ``extra`` columns computed in the same pass.

    ``links`` holds every anchor of the page in document order, resolved
    against the page URL and cleaned; anchors that do not resolve are
    dropped.  Runs inside the scan stage (narrow)."""
    matches = F.regexp_extract_all(visible_html("html"), F.lit(ANCHOR_RE), 0)
    raw = pages.select(
        "page_id", "site", "url", *extra,
        base_parts("url").alias("base"),
        F.transform(matches, lambda m, i: F.struct(
            (i + 1).cast("int").alias("pos"),
            _href(m).alias("href"),
            strip_html(F.regexp_extract(m, ANCHOR_RE, 3)).alias("text"))).alias("raw"),
    )
    resolved = resolve_links(F.col("raw"), F.col("base"))
    names = [c for c in raw.columns if c not in ("page_id", "site", "url", "base", "raw")]
    return raw.select("page_id", "site", "url", *names, "base",
                      F.filter(resolved, lambda x: x["url"] != "").alias("links"))


def extract_links(pages: DataFrame) -> DataFrame:
    """``link_raw(page_id, page_url, pos, href, text)``: one row per anchor."""
    matches = F.regexp_extract_all(visible_html("html"), F.lit(ANCHOR_RE), 0)
    exploded = pages.select("page_id", F.col("url").alias("page_url"),
                            F.posexplode_outer(matches).alias("pos0", "m")).where(F.col("m").isNotNull())
    return exploded.select(
        "page_id", "page_url", (F.col("pos0") + 1).cast("int").alias("pos"),
        _href(F.col("m")).alias("href"),
        strip_html(F.regexp_extract("m", ANCHOR_RE, 3)).alias("text"))


def normalize_links(pages: DataFrame) -> DataFrame:
    """``link(page_id, site, page_url, pos, url, text)``: resolved, cleaned,
    unusable anchors dropped."""
    per_page = page_links(pages)
    # *_outer + filter: an inner generator would let the optimizer push a
    # size(links) > 0 filter below the projection and compute links twice
    out = per_page.select("page_id", "site", F.col("url").alias("page_url"), F.inline_outer("links"))
    return out.where(F.col("url").isNotNull())


def _scored_by_url(links: Column, score_field: str) -> Column:
    """Links with ``score >= 3`` as ``(url, -score, pos, text)``, sorted, so
    the first entry of each URL run is its best (ties: document order)."""
    scored = F.transform(links, lambda x: F.struct(
        x["url"].alias("url"), (-x[score_field]).alias("neg"), x["pos"].alias("pos"),
        x["text"].alias("text")))
    return F.array_sort(F.filter(scored, lambda x: x["neg"] <= -3))


def score_stages(links: Column) -> Column:
    """Append ``product_score`` and ``category_score`` to every link."""
    a = stage(links, folded=lambda x: fold_text(x["text"]),
              product_score=lambda x: scoring.score_product_url(x["url"]))
    return stage(a, category_score=lambda x: scoring.score_category_link(
        x["url"], x["text"], folded=x["folded"], product_score=x["product_score"]))


def _best_ordered(by_url: str, k: int | None) -> Column:
    """First entry per URL run of column ``by_url``, ordered by score desc
    then position, cut to ``k``.  ``by_url`` must be a materialised column so
    the lambda reads it instead of recomputing it per element."""
    arr = F.col(by_url)
    best = F.filter(arr, lambda x, i: (i == 0) | (F.get(arr, i - 1)["url"] != x["url"]))
    ordered = F.array_sort(F.transform(best, lambda x: F.struct(
        x["neg"].alias("neg"), x["pos"].alias("pos"), x["url"].alias("url"), x["text"].alias("text"))))
    if k is not None:
        ordered = F.slice(ordered, 1, k)
    return F.transform(ordered, lambda x: F.struct(
        x["pos"].alias("pos"), x["url"].alias("url"), x["text"].alias("text"),
        (-x["neg"]).cast("int").alias("score")))


def same_site_links(per_page: DataFrame, entry_col: str = "url") -> Column:
    return F.filter("links", lambda x: same_domain(x["url"], F.col(entry_col)))


def page_top_links(pages: DataFrame, k: int | None = 8, extra: tuple = (),
                   category_filter=None) -> DataFrame:
    """Per page: best ``k`` category links and best ``k`` product links among
    same-host links (row-local, no shuffle); ``extra`` columns ride along.
    ``category_filter(link)`` further restricts category candidates."""
    per_page = page_links(pages, extra)
    keep = [c for c in per_page.columns if c not in ("base", "links")]
    local = per_page.select(*keep, score_stages(same_site_links(per_page)).alias("links"))
    if category_filter is not None:
        local = local.withColumn("cat_links", F.filter("links", category_filter))
    else:
        local = local.withColumn("cat_links", F.col("links"))
    sorted_ = local.select(
        *keep,
        _scored_by_url(F.col("cat_links"), "category_score").alias("cat_by_url"),
        _scored_by_url(F.col("links"), "product_score").alias("prod_by_url"))
    return sorted_.select(
        *keep,
        _best_ordered("cat_by_url", k).alias("top_category_links"),
        _best_ordered("prod_by_url", k).alias("top_product_links"),
    )


def top_links_per_page(pages: DataFrame, kind: str = "category", k: int = 8) -> DataFrame:
    """``(page_id, rank, url, text, score)``: the page's top ``k`` links."""
    col = "top_category_links" if kind == "category" else "top_product_links"
    top = page_top_links(pages, k).select("page_id", F.posexplode_outer(col).alias("rank0", "l")) \
        .where(F.col("l").isNotNull())
    return top.select("page_id", (F.col("rank0") + 1).cast("int").alias("rank"),
                      F.col("l.url").alias("url"), F.col("l.text").alias("text"),
                      F.col("l.score").alias("score"))


def scored_links(pages: DataFrame) -> DataFrame:
    """Every same-host link with both scores (NULL category score = rejected)."""
    per_page = page_links(pages)
    local = per_page.select("page_id", "site", F.col("url").alias("page_url"),
                            project(score_stages(same_site_links(per_page)), "pos", "url", "text",
                                    "category_score", "product_score").alias("links"))
    return local.select("page_id", "site", "page_url", F.inline_outer("links")) \
        .where(F.col("url").isNotNull())


def dedupe_links(links: DataFrame, score_col: str, partition=("page_id",)) -> DataFrame:
    """Best-scoring row per ``partition + url``; ties by document position."""
    w = Window.partitionBy(*partition, "url").orderBy(F.desc(score_col), "pos")
    return links.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def page_title(html) -> Column:
    h = F.col(html) if isinstance(html, str) else html
    return strip_html(F.regexp_extract(F.coalesce(h, F.lit("")), TITLE_RE, 1))


# Product-card containers whose links are product links by context.
CARD_CONTAINER_RE = (r"""(?is)<(?:div|li|article|section)\b[^>]*(?:\sdata-product-id=|\sclass=["'][^"']*"""
                     r"""(?:productCard|product-card|productItem|product-item)[^"']*["'])[^>]*>(.*?)"""
                     r"""</(?:div|li|article|section)>""")
CONTEXTUAL_MIN_SCORE = 4


def contextual_links(pages: DataFrame) -> DataFrame:
    """Links inside product-card containers (the first closing container tag
    ends a card), resolved against the page, same host, scored
    ``max(product score, 4)``: ``(page_id, card, pos, url, score)``."""
    blocks = F.regexp_extract_all(visible_html("html"), F.lit(CARD_CONTAINER_RE), 1)
    cards = pages.select("page_id", F.col("url").alias("page_url"), base_parts("url").alias("base"),
                         F.posexplode_outer(blocks).alias("card", "block")).where(F.col("block").isNotNull())
    raw = cards.select("page_id", "page_url", "base", "card", F.transform(
        F.regexp_extract_all("block", F.lit(ANCHOR_RE), 0), lambda m, i: F.struct(
            (i + 1).cast("int").alias("pos"), _href(m).alias("href"),
            strip_html(F.regexp_extract(m, ANCHOR_RE, 3)).alias("text"))).alias("raw"))
    links = raw.select("page_id", "page_url", "card", F.inline_outer(resolve_links(F.col("raw"), F.col("base"))))
    links = links.where(F.col("pos").isNotNull() & (F.col("url") != "") & same_domain("url", "page_url"))
    return links.select("page_id", "card", "pos", "url",
                        F.greatest(scoring.score_product_url("url"), F.lit(CONTEXTUAL_MIN_SCORE)).alias("score"))


def union_link_sources(selector_links: DataFrame, contextual: DataFrame) -> DataFrame:
    """Selector-found product links plus contextual ones; best score per
    ``(page_id, url)`` (a page's own links, so the group is bounded)."""
    both = selector_links.select("page_id", "url", "score", F.lit(0).alias("src"), "pos") \
        .unionByName(contextual.select("page_id", "url", "score", F.lit(1).alias("src"), "pos"))
    best = both.groupBy("page_id", "url").agg(F.min(F.struct((-F.col("score")).alias("neg"), "src", "pos")).alias("b"))
    return best.select("page_id", "url", (-F.col("b.neg")).cast("int").alias("score"))
