"""What a crawl needs of each page, read from its elements in one pass.

``page_facts`` parses a page once and keeps a narrow row: category links of the
menus, product links (by selector and by card), the next listing page and the
extracted product fields.  Everything after it works on these rows; html is
neither joined nor shuffled.

A page may list a whole shop.  Its elements never become a row: the selectors are
applied where it is parsed, one page at a time, and its links come in runs of
``RUN``, which are resolved and scored one after the other.  ``page_parts`` gives a
page of more than ``MOST_RUNS`` of them as several rows, and ``whole_pages`` puts the
found links, not the markup, together again.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import elements as E
from shelfspark.functions import scoring
from shelfspark.functions.text import let
from shelfspark.functions.urls import absolute_url, base_parts, clean_url, normalise_url, resolve_links, stage, url_host
from shelfspark.operators import extract as EX
from shelfspark.operators.links import CONTEXTUAL_MIN_SCORE

# Default selectors of menus, product links, product cards and
# next-page links.
CATEGORY_SELECTORS = ["header nav a[href]", "nav a[href]", "[role='navigation'] a[href]", ".menu a[href]", ".navigation a[href]"]
PRODUCT_SELECTORS = ["a[href*='/p/']", "a[href*='/product/']", "a[href*='/products/']", "a[href*='pid=']", "[data-product-id] a[href]",
                     ".product a[href]", ".product-card a[href]"]
CARD_SELECTORS = ["[data-product-id] a[href]", "[class*='productCard'] a[href]", "[class*='product-card'] a[href]",
                  "[class*='productItem'] a[href]", "[class*='product-item'] a[href]", ".product-card a[href]", ".product-item a[href]"]
NEXT_SELECTORS = ["a[rel='next']", ".pagination-next a[href]", ".next a[href]", ".pagination a.next[href]"]

#: Rules that a site may set, with their defaults; texts of selectors and patterns.
SELECTOR_RULES = {"category_selectors": CATEGORY_SELECTORS, "product_selectors": PRODUCT_SELECTORS, "pagination_selectors": NEXT_SELECTORS,
                  **{f"{field}_selectors": texts for field, texts in EX.FIELD_SELECTORS.items()}}
PATTERN_RULES = {"include_patterns": list(scoring.DEFAULT_INCLUDE), "exclude_patterns": list(scoring.DEFAULT_EXCLUDE)}
#: Rules of all sites are broadcast up to this many characters, else joined.
MOST_RULE_CHARS = 16 << 20


def parsed_rules(rules: DataFrame) -> DataFrame:
    """``(site, rules STRUCT)`` from ``(site, <rule> ARRAY<STRING> ...)``, selectors as texts for
    ``elements.compiled``; a rule that is null or not a column keeps its default."""
    names = [n for n in SELECTOR_RULES if n in rules.columns]

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name in names:
                frame[name] = [None if texts is None else E.selector_texts(texts) for texts in frame[name]]
            yield frame

    own = rules.select("site", *names, *[n for n in PATTERN_RULES if n in rules.columns])
    kinds = ", ".join(f"{c} {'string' if c in names else t}" for c, t in own.dtypes)
    texts = own.mapInPandas(parse, kinds)
    return texts.select("site", F.struct(*[n for n in own.columns if n != "site"], F.lit(1).alias("known")).alias("rules"))


def _with_rules(pages: DataFrame, rules: DataFrame | None) -> tuple[DataFrame, dict[str, Column]]:
    """`pages` with the rules of their site, and a column for each rule of patterns."""
    default = {n: F.array(*map(F.lit, t)) for n, t in PATTERN_RULES.items()}
    if rules is None:
        return pages, default
    parsed = parsed_rules(rules).checkpoint()
    chars = parsed.agg(F.sum(F.length(F.to_json("rules")))).first()[0] or 0
    # pages carry their html: shuffle them only for rules that are too large to send out
    joined = pages.join(F.broadcast(parsed) if chars <= MOST_RULE_CHARS else parsed, "site", "left")
    own = parsed.schema["rules"].dataType.fieldNames()
    return joined, {n: F.coalesce(F.col(f"rules.{n}"), d) if n in own else d for n, d in default.items()}


MENU, LISTED, CARD = range(3)
KINDS = ("menu", "listed", "card")

#: Links that are resolved and scored together, and such runs in one part of a page.
RUN, MOST_RUNS = 2048, 16

_RUNS = f"array<array<struct<place:int,href:string,text:string,{','.join(f'{k}:int' for k in KINDS)}>>>"
READ = f"struct<next_href:string,runs:{_RUNS},values:{EX.PAGE_VALUES}>"
_VALUES = pa.struct([("fields", pa.list_(pa.list_(pa.string()))), ("body", pa.string()), ("scripts", pa.list_(pa.string())), ("title", pa.string()), ("link", pa.string())])


class _Links:
    """Links of parts of pages, a column for each of their values."""

    def __init__(self) -> None:
        self.href: list[str] = []
        self.text: list[str] = []
        self.place, *self.kinds = (array("i") for _ in range(1 + len(KINDS)))
        self.runs, self.parts = array("i", (0,)), array("i", (0,))

    def add(self, page: E.Page, ranks: list[array], positions: array) -> None:
        """One part: links at `positions`, with their place among those of each kind, or -1."""
        first = len(self.place)
        for pos in positions:
            href, text = E.link_of(page, pos)
            self.place.append(pos)
            self.href.append(href)
            self.text.append(text)
            for kind, rank in zip(self.kinds, ranks, strict=True):
                kind.append(rank[pos])
        self.runs.extend(range(first + RUN, len(self.place), RUN))
        if len(self.place) > first:
            self.runs.append(len(self.place))
        self.parts.append(len(self.runs) - 1)

    def column(self) -> pa.Array:
        ints = lambda a: pa.Array.from_buffers(pa.int32(), len(a), [None, pa.py_buffer(a)])
        links = pa.StructArray.from_arrays([ints(self.place), pa.array(self.href, pa.string()), pa.array(self.text, pa.string()), *map(ints, self.kinds)],
                                           names=["place", "href", "text", *KINDS])
        return pa.ListArray.from_arrays(ints(self.parts), pa.ListArray.from_arrays(ints(self.runs), links))


def _ranks(page: E.Page, menu: list[E.Selector], listed: list[E.Selector], cards: list[E.Selector], anchors: list[E.Selector]) -> tuple[list[array], array]:
    """For each kind the place of each element among its links, or -1, and the elements of any
    kind; menus and listings without a match take all anchors."""
    found = [E.linked(page, s) for s in (menu, listed, cards)]
    if not found[MENU] or not found[LISTED]:
        every = E.linked(page, anchors)
        found = [found[MENU] or every, found[LISTED] or every, found[CARD]]
    ranks = []
    for positions in found:
        ranks.append(rank := array("i", (-1,)) * len(page.tags))
        for i, pos in enumerate(positions):
            rank[pos] = i
    return ranks, array("i", (pos for pos in page.index.get("[href", ()) if any(rank[pos] >= 0 for rank in ranks)))


def _read(pages: DataFrame, ids: list[str], most_runs: int | None) -> DataFrame:
    """`ids` and, as ``read``, what selectors find on the page of ``html``: a row for each
    `most_runs` runs of links, all but the first without values.  ``page`` tells pages apart,
    ``part`` their rows, of which there are ``parts``.

    One page is parsed at a time, and a batch ends after ``elements.MOST_CHARS`` of markup."""
    default = {n: E.selector_texts(t) for n, t in SELECTOR_RULES.items()}
    cards, anchors, crumbs, body = (E.selector_texts(t) for t in (CARD_SELECTORS, ["a"], [f"{c} a" for c in EX.BREADCRUMB_CONTAINERS], ["body"]))
    ruled = "rules" in ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            html = batch["html"]
            own = batch["rules"] if ruled else None
            kept = batch.select(ids)
            links, rows, chars = _Links(), [], 0

            def made() -> pa.RecordBatch:
                of, page, part, parts, nexts, values = zip(*rows, strict=True)  # noqa: B023
                read = pa.StructArray.from_arrays([pa.array(nexts, pa.string()), links.column(), pa.array(values, _VALUES)], names=["next_href", "runs", "values"])  # noqa: B023
                return pa.RecordBatch.from_arrays([*kept.take(pa.array(of, pa.int32())).columns, pa.array(page, pa.int64()), pa.array(part, pa.int32()),  # noqa: B023
                                                   pa.array(parts, pa.int32()), read], names=[*ids, "page", "part", "parts", "read"])

            for n in range(len(html)):
                text = html[n].as_py()
                rules = own[n].as_py() or {} if ruled else {}
                chosen = lambda name: E.compiled(rules.get(name) or default[name])  # noqa: B023, E731
                page = E.scan(text)
                ranks, positions = _ranks(page, chosen("category_selectors"), chosen("product_selectors"), E.compiled(cards), E.compiled(anchors))
                following = E.first_link(page, chosen("pagination_selectors"))
                values = EX.page_values(text, page, [*[chosen(f"{f}_selectors") for f in EX.FIELD_SELECTORS], E.compiled(crumbs), E.compiled(body)])
                most = RUN * most_runs if most_runs else max(1, len(positions))
                parts = max(1, -(-len(positions) // most))
                for part in range(parts):
                    links.add(page, ranks, positions[part * most:(part + 1) * most])
                    rows.append((n, number, part, parts, following, values))
                    values, chars = None, chars + len(text or "") // parts
                    if chars >= E.MOST_CHARS:
                        yield made()
                        links, rows, chars = _Links(), [], 0
                number += 1
                del page, text, ranks, positions
            if rows:
                yield made()

    kinds = ", ".join(f"`{c}` {t}" for c, t in pages.select(*ids).dtypes)
    return pages.select(*ids, "html").mapInArrow(run, f"{kinds}, page bigint, part int, parts int, read {READ}")


def _first_entries(ordered: Column) -> Column:
    """Of links sorted by URL and kind, the first entry of each URL: the one that counts."""
    return F.filter(ordered, lambda x, i: (i == 0) | (F.get(ordered, i - 1)["url"] != x["url"]) | (F.get(ordered, i - 1)["product"] != x["product"]))


def _scored(run: Column, base: Column, page: Column, include: Column, exclude: Column) -> Column:
    """Links of the page's own host as ``(product, url, kind, neg, pos, text)``, sorted, each URL
    once, where ``neg`` is the negative score of the kind; those below its limit are left out."""
    links = resolve_links(run, base, keep=("place", "text", *KINDS))
    own = let(url_host(page), lambda host: F.filter(links, lambda x: (x["url"] != "") & (host != "") & (url_host(x["url"]) == host)))
    scored = stage(own, product=lambda x: scoring.score_product_url(x["url"]))

    def entries(x: Column) -> Column:
        scores = (F.when(x["product"] < scoring.PRODUCT_LIKE_MIN, scoring.score_category_link(
                      x["url"], x["text"], include=include, exclude=exclude, product_score=x["product"])),
                  F.when(x["product"] >= scoring.PRODUCT_LIKE_MIN, x["product"]), F.greatest(x["product"], F.lit(CONTEXTUAL_MIN_SCORE)))
        return F.array(*[F.struct(F.lit(0 if kind == MENU else 1).alias("product"), x["url"].alias("url"), F.lit(kind).alias("kind"),
                                  F.when(x[KINDS[kind]] >= 0, -score).alias("neg"), x[KINDS[kind]].alias("pos"), x["text"].alias("text"))
                         for kind, score in enumerate(scores)])

    counting = F.filter(F.flatten(F.transform(scored, entries)), lambda z: F.coalesce(z["neg"] <= -scoring.CATEGORY_MIN, F.lit(False)))
    return let(F.array_sort(counting), _first_entries)


def _read_and_scored(pages: DataFrame, rules: DataFrame | None, most_runs: int | None = None) -> DataFrame:
    """Pages, or parts of them, with their ``values`` and ``links``."""
    given, rule = _with_rules(pages.select("page_id", "site", "seq", "url", "html"), rules)
    ids = ["page_id", "site", "seq", "url", *(["rules"] if rules is not None else [])]
    # no fence from here on, so that columns nobody asks for are not made
    found = _read(given, ids, most_runs).select("*", base_parts("url").alias("base"), clean_url(normalise_url("url")).alias("page_url"))
    return found.select(
        "page_id", "site", "seq", "url", "page_url", "page", "part", "parts", F.lit("").alias("category"), F.col("read.values").alias("values"),
        F.when(F.col("read.next_href") != "", absolute_url("read.next_href", "base")).otherwise("").alias("next_url"),
        F.flatten(F.transform("read.runs", lambda r: _scored(r, F.col("base"), F.col("url"), rule["include_patterns"], rule["exclude_patterns"]))).alias("links"))


def _with_best(scored: DataFrame) -> DataFrame:
    """``links`` of whole pages -> ``categories`` and ``products``, each URL once, best first."""
    ordered = scored.withColumn("links", F.when(F.size("links") > 1, F.array_sort("links")).otherwise(F.col("links")))
    best = ordered.withColumn("links", F.array_sort(F.transform(_first_entries(F.col("links")), lambda x: F.struct(
        x["product"].alias("product"), x["neg"].alias("neg"), x["kind"].alias("kind"), x["pos"].alias("pos"), x["url"].alias("url"), x["text"].alias("text")))))
    return best.select(
        *[c for c in scored.columns if c != "links"],
        F.transform(F.filter("links", lambda x: x["product"] == 0),
                    lambda x: F.struct(x["url"].alias("url"), x["text"].alias("text"), (-x["neg"]).cast("int").alias("score"))).alias("categories"),
        F.transform(F.filter("links", lambda x: x["product"] == 1),
                    lambda x: F.struct(x["url"].alias("url"), (-x["neg"]).cast("int").alias("score"), (x["kind"] == CARD).alias("by_card"))).alias("products"))


def page_facts(pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """One narrow row per page: ``site, seq, page_id, page_url`` (cleaned),
    ``categories ARRAY<STRUCT<url, text, score>>`` (candidates of the menus, best
    first; of all anchors where no menu matches), ``products ARRAY<STRUCT<url, score,
    by_card>>`` (by_card: by no selector), ``next_url`` and the
    fields of ``extract.extraction``.

    Links count for their own host only.  `rules` may give selectors and patterns
    by site (``parsed_rules``)."""
    return EX.extraction(_with_best(_read_and_scored(pages, rules)), read="values",
                         keep=("site", "seq", "page_url", "next_url", "categories", "products")).drop("category")


PART = ("page", "part", "parts")


def page_parts(pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """``page_facts`` before its links are put in order: a row for each ``MOST_RUNS`` runs of
    the links of a page, for ``whole_pages``.  To be written: it is read twice."""
    return EX.extraction(_read_and_scored(pages, rules, MOST_RUNS), read="values", keep=("site", "seq", "page_url", "next_url", "links", *PART)).drop("category")


def whole_pages(parts: DataFrame) -> DataFrame:
    """``page_facts`` of written ``page_parts``.  Only pages of several parts are grouped, by
    a number of their own, as pages may have an id twice."""
    own = [c for c in parts.columns if c not in (*PART, "links")]
    several = parts.where("parts > 1").groupBy("page").agg(
        *[F.first(F.when(F.col("part") == 0, F.col(c)), ignorenulls=True).alias(c) for c in own], F.flatten(F.collect_list("links")).alias("links"))
    return _with_best(parts.where("parts = 1").select(*own, "links").unionByName(several.drop("page")))
