"""Benchmark decontamination with spaced seeds (DataFrame functions only).

A seed is a fixed mask over consecutive word positions; positions outside the
mask are ignored, so a substituted word spoils only the windows in which it
falls on a used position.  Masked windows of the benchmark items and of the
documents are hashed and joined.  A hit fixes an alignment (document position
minus item position); along it the whole item is compared word by word.  Words
that are inserted or dropped move the rest of an item to another alignment, so
the item's words that agree inside the hit windows are also united over all
alignments of the document.  A document is contaminated by an item where at
least `min_overlap` of the item's words agree in either count.  The comparison happens where the hit is found, on the document's
own word array, so texts are never shuffled.

The benchmark side is broadcast only when its counted windows are at most
`broadcast_windows`; beyond that the windows are joined by shuffle, and hits
meet their item's words in a second join.  Either way gives the same rows.

Defined results: null texts count as empty and match nothing; items without a
word match nothing; items of up to 10 words are also matched by masks of
their own length, of which one substitution leaves one whole; repeated items each match; repeated document rows with the
same id count once; null ids are kept as null; further columns are ignored;
empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import materialise, text_or_empty

#: Used positions are 1.  Two masks of weight 6 over 9 and 10 words.
SEEDS = ("110100111", "1110010101")
#: Items up to this length have masks of their own.
SHORT = 10
MIN_OVERLAP = 0.6
BROADCAST_WINDOWS = 200_000


def word_hashes(col: Column) -> Column:
    """64-bit hashes of the lower-cased runs of letters and digits."""
    found = F.filter(F.split(F.lower(col), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(found, lambda w: F.xxhash64(w))


def _window(hashes: Column, mask: str, start: Column) -> Column:
    return F.xxhash64(F.lit(mask), *[F.get(hashes, start + i) for i, used in enumerate(mask) if used == "1"])


def _windows(hashes: Column, masks: list[str]) -> Column:
    """Array of (pos, key, size) over all masks that fit."""
    def fitting(mask: str) -> Column:
        last = F.size(hashes) - len(mask)
        starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda p: F.struct(p.alias("pos"), _window(hashes, mask, p).alias("key"), F.lit(len(mask)).alias("size")))

    return F.concat(*map(fitting, masks))


def short_masks(n: int) -> list[str]:
    """Masks of `n` positions: any one position is outside one of them, where an item
    with one other word can still reach the least overlap."""
    if n < 3:
        return ["1" * n]
    if n == 3:
        return ["110", "101", "011"]
    return ["1" * (n // 2) + "0" * (n - n // 2), "0" * (n // 2) + "1" * (n - n // 2)]


def _contained(docs: DataFrame, benchmark: DataFrame, min_overlap: float, seeds: tuple[str, ...], broadcast_windows: int) -> DataFrame:
    """(doc_id, doc_key, item_id, best): the items that each row contains; rows are
    told apart by id and text, as `doc_key` hashes the text."""
    span = min(len(s) for s in seeds)
    items = materialise(benchmark.select("item_id", word_hashes(text_or_empty()).alias("item_words")).filter(F.size("item_words") > 0), "bench-items")
    # short lengths get masks of their own (at most SHORT values)
    lengths = [r[0] for r in items.filter(F.size("item_words") <= max(SHORT, span - 1)).select(F.size("item_words").alias("n")).distinct().orderBy("n").collect()]
    masks = list(seeds) + [m for n in lengths for m in short_masks(n)]

    long_windows = items.filter(F.size("item_words") >= span).select("item_id", "item_words", F.explode(_windows(F.col("item_words"), list(seeds))).alias("w"))
    short_windows = [items.filter(F.size("item_words") == n).select("item_id", "item_words", F.explode(_windows(F.col("item_words"), short_masks(n))).alias("w")) for n in lengths]
    for more in short_windows:
        long_windows = long_windows.unionByName(more)
    bench = materialise(long_windows.select(F.col("w.key").alias("key"), F.col("w.pos").alias("item_pos"), F.col("w.size").alias("size"), "item_id", "item_words"), "bench-windows")

    hashed = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("doc_key"), word_hashes(text_or_empty()).alias("words"))
    doc_windows = hashed.select("doc_id", "doc_key", "words", F.explode(_windows(F.col("words"), masks)).alias("w")).select(
        "doc_id", "doc_key", "words", F.col("w.pos").alias("doc_pos"), F.col("w.key").alias("key"))
    if bench.count() <= broadcast_windows:
        hits = doc_windows.join(F.broadcast(bench), "key")
    else:
        # narrow windows first; documents with a hit then meet their words again
        found = doc_windows.drop("words").join(bench.select("key", "item_pos", "size", "item_id"), "key").select("doc_id", "doc_key", "doc_pos", "item_pos", "size", "item_id").distinct()
        # a null id is hashed as itself, so that null ids find their rows too
        row = hashed.select(F.col("doc_id").alias("__id"), F.col("doc_key").alias("__key"), "words").dropDuplicates(["__id", "__key"])
        hits = (found.join(row, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("doc_key") == F.col("__key"))).drop("__id", "__key")
                .join(items.withColumnRenamed("item_id", "__item"), F.col("item_id").eqNullSafe(F.col("__item"))).drop("__item"))

    shift = F.col("doc_pos") - F.col("item_pos")
    n = F.size("item_words")
    agree = lambda i: F.get("words", F.col("shift") + i).eqNullSafe(F.get("item_words", i))
    aligned = (hits.withColumn("shift", shift)
               .withColumn("n_equal", F.size(F.filter(F.sequence(F.lit(0), n - 1), agree)))
               .withColumn("inside", F.filter(F.sequence(F.col("item_pos"), F.col("item_pos") + F.col("size") - 1), agree)))
    # rows that share an id may have other words, whose alignments are not united
    united = (aligned.groupBy("doc_id", "item_id", "doc_key", F.xxhash64("item_words").alias("item_key"))
              .agg(F.max(F.struct("n_equal", (-F.col("shift")).alias("neg"), n.alias("n_words"))).alias("best"),
                   F.size(F.array_distinct(F.flatten(F.collect_set("inside")))).alias("n_united"))
              .select("doc_id", "doc_key", "item_id", F.struct(F.greatest("best.n_equal", "n_united").alias("n_equal"), "best.neg", "best.n_words").alias("best")))
    return united.filter(F.col("best.n_equal") >= F.lit(min_overlap) * F.col("best.n_words"))


def overlaps(docs: DataFrame, benchmark: DataFrame, min_overlap: float = MIN_OVERLAP, seeds: tuple[str, ...] = SEEDS,
             broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, item_id, doc_word, n_words, n_equal, overlap): the best alignment
    of each contaminated document with each item it contains; `n_equal` counts the
    item's words over all alignments where that is more."""
    return (_contained(docs, benchmark, min_overlap, seeds, broadcast_windows)
            .groupBy("doc_id", "item_id").agg(F.max("best").alias("best"))
            .select("doc_id", "item_id", (-F.col("best.neg")).cast("long").alias("doc_word"),
                    F.col("best.n_words").cast("long").alias("n_words"), F.col("best.n_equal").cast("long").alias("n_equal"),
                    (F.col("best.n_equal") / F.col("best.n_words")).alias("overlap")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the rows that contain a benchmark item; a clean row stays
    even where another row of its id goes."""
    bad = _contained(docs.select("doc_id", "text"), benchmark, MIN_OVERLAP, SEEDS, BROADCAST_WINDOWS)
    bad = materialise(bad.select(F.col("doc_id").alias("__id"), F.col("doc_key").alias("__key")).distinct(), "bench-bad")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(text_or_empty()) == F.col("__key"))
    return docs.join(bad, same, "left_anti")
