"""Pages -> catalog: the composed crawl as joins over page facts.

``build_catalog`` takes a table of fetched pages through entry pages, menus,
requested categories, narrower categories, listing pages and product pages to
merged products, processed categories, warnings and a summary.  A level is a join
of the keys found so far with the page facts (those of ``storefront.page_facts``); html is
read once, before the first level.  Every level is written below a folder, and a
run that is given the folder of an earlier one goes on from the levels that are
complete there.

Order matters only where the result depends on it, and is carried as a key: a
category URL belongs to its first place in processing order, a product URL of a
category to its first listing page, a merged product's fields to the last visit
that has them.  First claims are order-keyed minima, so no level runs through a
site's rows one by one.

Pages that are not in the table cannot be visited: they end a chain, give no
products, and are reported.  Limits are parameters; None is no limit.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.text import fold_text
from shelfspark.functions.urls import clean_url, normalise_url, url_origin, url_path
from shelfspark.operators import extract as EX
from shelfspark.operators import products as PR
from shelfspark.operators import quality as QY
from shelfspark.operators.common import fence
from shelfspark.operators.discovery import FALLBACK_NAME, category_label
from shelfspark.operators.ordering import positions, running, stored
from shelfspark.operators.storefront import page_parts, whole_pages
from shelfspark.session import LARGE_VALUES, scratch_path

CATEGORY = ["site", "url"]
GRAM = 3


class Levels:
    """Written levels of one run below `root`; complete ones are read, not made."""

    def __init__(self, spark, root: str | None = None):
        self.spark, self.root = spark, root or scratch_path(spark, f"crawl-{uuid.uuid4().hex}")

    def _complete(self, path: str) -> bool:
        marker = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return marker.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(marker)

    def keep(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.root}/{name}"
        if not self._complete(path):
            make().write.mode("overwrite").options(**LARGE_VALUES).parquet(path)
        return self.spark.read.parquet(path)


# ---------------------------------------------------------------- categories
def known_pages(facts: DataFrame) -> DataFrame:
    """One row per cleaned URL: the page seen first."""
    first = facts.groupBy("page_url").agg(F.min(F.struct("seq", "page_id")).alias("p")).select("page_url", "p.seq", "p.page_id")
    return facts.join(first, ["page_url", "seq", "page_id"], "left_semi").dropDuplicates(["page_url"])


def top_level(facts: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(site, rank, name, url, path)``: categories of each site's entry page, its
    first page, best first (3 x `most` where given); a site without any gets its
    entry URL as the one category, and a warning ``(site, code, subject)``."""
    first = facts.groupBy("site").agg(F.min(F.struct("seq", "page_id", "page_url")).alias("p")).select("site", "p.page_url")
    entries = facts.join(first, ["site", "page_url"], "left_semi").select("site", "page_url", "categories")
    found = entries.where(F.size("categories") > 0).select("site", F.posexplode("categories").alias("i", "c")).select(
        "site", (F.col("i") + 1).alias("rank"), F.col("c.text").alias("name"), F.col("c.url").alias("url"), F.array("c.text").alias("path"))
    none = entries.where(F.size("categories") == 0)
    fallback = none.select("site", F.lit(1).alias("rank"), F.lit(FALLBACK_NAME).alias("name"), F.col("page_url").alias("url"),
                           F.array(F.lit(FALLBACK_NAME)).alias("path"))
    warnings = none.select("site", F.lit("no_categories_detected").alias("code"), F.col("page_url").alias("subject"))
    if most is not None:
        found = found.where(F.col("rank") <= 3 * most)
    return found.unionByName(fallback), warnings


def subcategories(categories: DataFrame, facts: DataFrame, most: int | None = None) -> DataFrame:
    """``(<columns of categories>, sub, sub_name, sub_url, sub_path)``: menu links of
    each category's own page under the same origin, without itself (2 x `most`)."""
    menus = facts.select(F.col("page_url").alias("url"), F.col("categories").alias("menu"))
    joined = categories.join(menus, "url").withColumn("menu", F.filter("menu", lambda c: (c["url"] != F.col("url"))
                                                                       & c["url"].startswith(url_origin(F.col("url")))))
    out = joined.select(*categories.columns, F.posexplode("menu").alias("i", "c")).select(
        *categories.columns, (F.col("i") + 1).alias("sub"), F.col("c.text").alias("sub_name"), F.col("c.url").alias("sub_url"),
        F.concat("path", F.array("c.text")).alias("sub_path"))
    return out if most is None else out.where(F.col("sub") <= 2 * most)


def _grams(folded: Column, sizes: Column) -> Column:
    """Distinct substrings of the given sizes."""
    return F.array_distinct(F.flatten(F.transform(sizes, lambda n: F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(folded) - n + 1)), lambda i: i + n - 1 <= F.length(folded)),
        lambda i: F.substr(folded, i, n)))))


def name_matches(categories: DataFrame, requests: DataFrame) -> DataFrame:
    """``(site, req_no, rank, name, url, path)``: per request ``(site, req_no, value)``
    the first category ``(site, rank, name, url, path)`` whose folded name contains
    the folded request.

    Names are indexed by their substrings of up to three characters.  A request
    looks up the rarest of its own; where one of them is in no name, nothing
    matches.  Only the names under that substring are compared."""
    named = categories.select("site", "rank", "name", "url", "path", fold_text("name").alias("folded"))
    postings = named.select("*", F.explode(_grams(F.col("folded"), F.sequence(F.lit(1), F.lit(GRAM)))).alias("gram"))
    counts = postings.groupBy("site", "gram").agg(F.count("*").alias("names"))
    asked = requests.select("site", "req_no", fold_text("value").alias("wanted")).where("wanted <> ''")
    parts = asked.select("*", F.explode(_grams(F.col("wanted"), F.array(F.least(F.length("wanted"), F.lit(GRAM))))).alias("gram"))
    rarest = parts.join(counts, ["site", "gram"], "left").groupBy("site", "req_no", "wanted").agg(
        F.min(F.struct(F.coalesce("names", F.lit(0)).alias("names"), "gram")).alias("r")).where("r.names > 0")
    hits = rarest.select("site", "req_no", "wanted", F.col("r.gram").alias("gram")).join(postings, ["site", "gram"]) \
        .where(F.contains("folded", "wanted"))
    best = hits.groupBy("site", "req_no").agg(F.min_by(F.struct("rank", "name", "url", "path"), F.struct("rank", "url")).alias("m"))
    return best.select("site", "req_no", "m.*")


def requested_categories(top: DataFrame, facts: DataFrame, requests: DataFrame, most: int | None = None,
                         most_sub: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Requests ``(site, req_no, kind 'url' | 'name', value)`` -> categories ``(site,
    place, name, url, path)`` and warnings of names that none has.

    A URL is taken as it is, named and placed by its path.  A name takes the first
    top-level category that contains it, else the first category in the menus of
    the first `most` top-level pages.  Order: URLs, names of the first tier, names
    of the second; of equal URLs the first stays."""
    value = clean_url(normalise_url("value"))
    urls = fence(requests.where("kind = 'url'"), url=value).where("url <> ''")
    segments = F.filter(F.split(url_path("url"), "/"), lambda s: s != "")
    slug = F.coalesce(F.try_element_at(segments, F.lit(-1)), F.lit("category"))
    by_url = urls.select("site", F.lit(0).alias("tier"), "req_no", category_label(slug).alias("name"), "url",
                         EX.category_path_from_url(F.col("value"), category_label).alias("path"))
    names = requests.where("kind = 'name'").select("site", "req_no", "value")
    first = stored(name_matches(top, names), "requested-first")
    rest = names.join(first.select("site", "req_no"), ["site", "req_no"], "left_anti")
    open_sites = rest.select("site").distinct()
    pool = top if most is None else top.where(F.col("rank") <= most)
    pool = subcategories(pool.join(open_sites, "site", "left_semi"), facts, most_sub)
    pool = pool.select("site", (F.col("rank").cast("bigint") * (1 << 31) + F.col("sub")).alias("rank"), F.col("sub_name").alias("name"),
                       F.col("sub_url").alias("url"), F.col("sub_path").alias("path"))
    second = stored(name_matches(pool, rest), "requested-second")
    unmatched = rest.join(second.select("site", "req_no"), ["site", "req_no"], "left_anti")
    chosen = by_url.unionByName(first.select("site", F.lit(1).alias("tier"), "req_no", "name", "url", "path")) \
        .unionByName(second.select("site", F.lit(2).alias("tier"), "req_no", "name", "url", "path"))
    placed = chosen.withColumn("place", F.col("tier").cast("bigint") * (1 << 31) + F.col("req_no"))
    one = placed.groupBy("site", "url").agg(F.min_by(F.struct("place", "name", "path"), "place").alias("c"))
    return (one.select("site", "c.place", "c.name", "url", "c.path"),
            unmatched.select("site", F.lit("unmatched_category_name").alias("code"), F.col("value").alias("subject")))


def first_category_visit(candidates: DataFrame) -> DataFrame:
    """``(site, place, sub, name, url, path)`` -> one row per category URL, that of its
    first place in processing order (place, then sub)."""
    first = candidates.groupBy("site", "url").agg(F.min_by(F.struct("place", "sub", "name", "path"), F.struct("place", "sub", "name")).alias("c"))
    return first.select("site", "c.place", "c.sub", "c.name", "url", "c.path")


# ---------------------------------------------------------------- listings
def listing_chain(starts: DataFrame, pages: DataFrame, most: int | None = None) -> DataFrame:
    """``(url, page_url, depth)``: listing pages reached from each start URL along
    ``next_url``, from depth 1, each once.

    Distances double: after k rounds every start has its pages up to 2^k apart,
    and a table of jumps leads from each page 2^k pages on.  A chain of n pages
    takes log2(n) + 1 rounds; a cycle adds no new page and so ends it."""
    jumps = stored(pages.where("next_url <> ''").select("page_url", "next_url")
                   .join(pages.select(F.col("page_url").alias("next_url")), "next_url").select("page_url", "next_url"), "jumps")
    reached = stored(starts.select("url").distinct().join(pages.select(F.col("page_url").alias("url")), "url")
                     .select("url", F.col("url").alias("page_url"), F.lit(1).alias("depth")), "chain")
    step, n = 1, reached.count()
    while most is None or step < most:
        farther = reached.join(jumps, "page_url").select("url", F.col("next_url").alias("page_url"), (F.col("depth") + step).alias("depth"))
        reached = stored(reached.unionByName(farther).groupBy("url", "page_url").agg(F.min("depth").alias("depth")), "chain")
        before, n = n, reached.count()
        if n == before:
            break
        onward = jumps.select(F.col("page_url").alias("next_url"), F.col("next_url").alias("end"))
        jumps = stored(jumps.join(onward, "next_url").select("page_url", F.col("end").alias("next_url")), "jumps")
        step *= 2
    return reached if most is None else reached.where(F.col("depth") <= most)


def category_product_links(categories: DataFrame, facts: DataFrame, most_pages: int | None = None,
                           per_category: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(links, counts)`` of categories ``(site, url, ...)``.

    ``links(site, url, product_url, rank, score, by_card, depth)``: product links of
    the listing pages, by selector and by card, each once, in crawl order;
    ``counts(site, url, links_discovered, pages_visited)`` for every category.  With
    `per_category` the crawl stops after the page on which so many were reached,
    and the first so many are ranked."""
    chain = listing_chain(categories.select("url"), facts.select("page_url", "next_url"), most_pages)
    on_page = facts.select("page_url", F.posexplode("products").alias("place", "p"))
    seen = chain.join(on_page, "page_url").groupBy("url", F.col("p.url").alias("product_url")).agg(
        F.min(F.struct("depth", "place", "p.score", "p.by_card")).alias("f"))
    seen = seen.select("url", "product_url", "f.*")
    new = chain.groupBy("url", "depth").agg(F.lit(1).alias("one")).join(
        seen.groupBy("url", "depth").agg(F.count("*").alias("links")), ["url", "depth"], "left").fillna(0, ["links"])
    if per_category is not None:
        # a category has as many rows here as pages
        before = running(stored(new, "listing-steps"), ["url"], ["depth"], {"before": ("links", "sum")})
        new = before.where(F.col("before") < per_category)
        seen = seen.join(new.select("url", "depth"), ["url", "depth"], "left_semi")
    totals = new.groupBy("url").agg(F.sum("links").alias("links_discovered"), F.max("depth").alias("pages_visited"))
    counts = categories.select(*CATEGORY).join(totals, "url", "left").select(
        *CATEGORY, F.coalesce("links_discovered", F.lit(0)).alias("links_discovered"), F.coalesce("pages_visited", F.lit(0)).alias("pages_visited"))
    ranked = positions(stored(seen, "listing-links"), ["url"], ["depth", "place"], "rank")
    if per_category is not None:
        ranked = ranked.where(F.col("rank") <= per_category)
    links = categories.select(*CATEGORY).join(ranked, "url").select(*CATEGORY, "product_url", "rank", "score", "by_card", "depth")
    return links, counts


# ---------------------------------------------------------------- the whole
def validate_catalog(products: DataFrame, sites: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(issues, summary, warnings)`` of merged products; `sites` adds the sites
    without any product."""
    summary = QY.catalog_summary(products)
    if sites is not None:
        counts = [c for c in summary.columns if c != "site"]
        summary = sites.select("site").distinct().join(summary, "site", "left").fillna(0, counts)
    return QY.product_issues(products), summary, QY.catalog_warnings(summary)


class Catalog:
    """The levels of one crawl, each made when it is first asked for.

    * ``products``: merged products by ``(site, product_key)``;
    * ``categories(site, place, sub, name, url, path, links_discovered, pages_visited)``: processed ones;
    * ``visits(site, category_url, product_url, visit)``: product pages in visiting order;
    * ``warnings(site, code, subject)``: each once;
    * ``issues``, ``summary``: the validation."""

    def __init__(self, pages: DataFrame, requests: DataFrame | None = None, rules: DataFrame | None = None, root: str | None = None,
                 max_categories: int | None = None, max_subcategories: int | None = None, max_pages: int | None = None,
                 products_per_category: int | None = None, currency: str = PR.DEFAULT_CURRENCY):
        self._levels = Levels(pages.sparkSession, root)
        self._pages, self._requests, self._rules, self._currency = pages, requests, rules, currency
        self._max_categories, self._max_subcategories = max_categories, max_subcategories
        self._max_pages, self._per_category = max_pages, products_per_category

    @cached_property
    def facts(self) -> DataFrame:
        parts = self._levels.keep("page_parts", lambda: page_parts(self._pages, self._rules))
        return self._levels.keep("facts", lambda: known_pages(whole_pages(parts)))

    @cached_property
    def top(self) -> DataFrame:
        return self._levels.keep("top", lambda: top_level(self.facts, self._max_categories)[0])

    @cached_property
    def _asked(self) -> tuple[DataFrame, DataFrame]:
        return requested_categories(self.top, self.facts, self._requests, self._max_categories, self._max_subcategories)

    @cached_property
    def chosen(self) -> DataFrame:
        """``(site, place, name, url, path)``: the requested categories of sites that ask
        for some, the top-level ones of the others."""
        top = self.top if self._max_categories is None else self.top.where(F.col("rank") <= self._max_categories)
        plain = top.select("site", F.col("rank").cast("bigint").alias("place"), "name", "url", "path")
        if self._requests is None:
            return plain
        asked = self._levels.keep("requested", lambda: self._asked[0].select(*plain.columns))
        return plain.join(self._requests.select("site").distinct(), "site", "left_anti").unionByName(asked)

    @cached_property
    def claims(self) -> DataFrame:
        below = subcategories(self.chosen, self.facts, self._max_subcategories)
        if self._max_subcategories is not None:
            below = below.where(F.col("sub") <= self._max_subcategories)
        candidates = self.chosen.withColumn("sub", F.lit(0)).unionByName(below.select(
            "site", "place", F.col("sub_name").alias("name"), F.col("sub_url").alias("url"), F.col("sub_path").alias("path"), "sub"))
        return self._levels.keep("claims", lambda: positions(stored(first_category_visit(candidates), "claims"), ["site"], ["place", "sub"], "nth"))

    @cached_property
    def _listed(self) -> tuple[DataFrame, DataFrame]:
        links, counts = category_product_links(self.claims, self.facts, self._max_pages, self._per_category)
        return self._levels.keep("links", lambda: links), self._levels.keep("counts", lambda: counts)

    @cached_property
    def categories(self) -> DataFrame:
        return self._listed[1].join(self.claims, CATEGORY).select("site", "place", "sub", "name", "url", "path", "links_discovered", "pages_visited")

    @cached_property
    def _visits(self) -> DataFrame:
        return self._levels.keep("visits", lambda: positions(stored(
            self._listed[0].join(self.claims.select(*CATEGORY, "nth", "path"), CATEGORY).select(
                "site", "nth", "rank", F.col("url").alias("category_url"), "product_url", F.col("path").alias("context")),
            "visits"), ["site"], ["nth", "rank"], "visit"))

    @property
    def visits(self) -> DataFrame:
        return self._visits.select("site", "category_url", "product_url", "visit")

    @cached_property
    def sightings(self) -> DataFrame:
        """Canonical products as each visit saw them, ``seq`` being the visit."""
        details = self.facts.drop("site", "seq", "categories", "products", "next_url").withColumnRenamed("page_url", "product_url")
        seen = self._visits.select("site", "product_url", F.col("visit").alias("seq"), "context").join(details, "product_url")
        return self._levels.keep("sightings", lambda: EX.normalize_extraction(
            seen.withColumn("url", F.col("product_url")), self._currency, keep=("site", "seq")))

    @cached_property
    def products(self) -> DataFrame:
        return self._levels.keep("products", lambda: PR.merge_products(PR.drop_unidentified(self.sightings)))

    @cached_property
    def _validation(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return validate_catalog(self.products, self.facts)

    @property
    def issues(self) -> DataFrame:
        return self._validation[0]

    @property
    def summary(self) -> DataFrame:
        totals = self.claims.groupBy("site").agg(F.count("*").alias("categories_processed"))
        return self._validation[1].join(totals, "site", "left").fillna(0, ["categories_processed"])

    @cached_property
    def warnings(self) -> DataFrame:
        def told(df: DataFrame, code: str, subject: str) -> DataFrame:
            return df.select("site", F.lit(code).alias("code"), F.col(subject).alias("subject"))

        known = self.facts.select(F.col("page_url").alias("product_url"))
        counts = self._listed[1]
        parts = [top_level(self.facts)[1], told(counts.where("links_discovered = 0"), "no_products_in_category", "url"),
                 told(counts.where("pages_visited = 0"), "page_not_found", "url"),
                 told(self._visits.join(known, "product_url", "left_anti"), "page_not_found", "product_url"),
                 told(self.sightings.where("price = ''"), "missing_price", "page_url"),
                 told(self.sightings.where("name = '' and sku = ''"), "dropped_unidentified", "page_url"),
                 self._validation[2].withColumnRenamed("detail", "subject")]
        if self._requests is not None:
            parts.append(self._asked[1])
        return reduce(DataFrame.unionByName, parts).distinct()


def build_catalog(pages: DataFrame, requests: DataFrame | None = None, **options) -> Catalog:
    """``page(page_id, site, url, html, seq)`` and perhaps requests ``(site, req_no, kind,
    value)`` -> the catalog; `options` are those of ``Catalog``."""
    return Catalog(pages, requests, **options)
