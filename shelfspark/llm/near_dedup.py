"""Near-duplicate detection by Order MinHash, verified by banded alignment.

A document is its sequence of lower-cased words.  Its five-word k-mers are
labelled with their occurrence number; each of `SAMPLES` random orders picks
the `PICKED` smallest labelled k-mers, and the k-mers are kept in the order in
which they stand in the text.  Equal samples make candidates, so texts with the
same k-mers in another order meet less often than under plain MinHash.

Exact copies are folded first.  Within a bucket every text is first compared
with the two leaders of the bucket - the smallest id and the smallest hashed
id.  What the leaders leave apart is compared pair by pair: two texts of a
bucket that are not yet in one class meet, in the first bucket that they share,
unless their lengths or their counts of words prove that they are not similar.
The likeliest pairs of each text are taken first and their links contracted, so
that texts joined meanwhile are not compared again; then all pairs that are left.  A large bucket is split
in both directions into tiles over tasks.
Candidates are verified by an alignment of the word sequences along a band of
diagonals that widens until the distance is known or exceeds 20 % of the longer
text: similarity is 1 - edits / words of the longer text.  Verified links are
contracted to classes by alternating large-star and small-star steps, each
written to the shared folder; links never reach the driver.

A leader of a large group has a pair with every text of it.  The tables with
one row per key (leaders, texts, least neighbours) are written before they are
joined, so that both sides of a join come straight from an exchange and adaptive
execution can split the hot key over tasks.

Defined results: null and empty texts are copies of one another; texts under
five words have one k-mer, all their words; rows that share an id are one
document; rows without an id are grouped by equal words only and have a null
class where no copy has an id; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import materialise, maybe_in, text_or_empty, words

SHINGLE = 5
SAMPLES = 20
PICKED = 2
SIMILARITY = 0.8
RANKS = 2_000_000  # computed at once
LEAST_BINS, MOST_BINS = 128, 4096  # counts of words per text, by the highest bits of the hash
TILE = 512  # texts of each side of a tile
FIRST_ROUND = 32  # pairs of a text in a tile; the second round takes all that are left
PAIRS = 1 << 16  # looked at together
COUNTS = 1 << 23  # compared together
ALIGNED = 500  # pairs worth a task

_SEEDS = np.random.default_rng(20240229).integers(1, 2**63, SAMPLES, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (public splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the runs of SHINGLE words; of all words where there are fewer."""
    if not len(hashes):
        return hashes
    size = min(SHINGLE, len(hashes))
    out = np.zeros(len(hashes) - size + 1, np.uint64)
    for i in range(size):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i:len(hashes) - size + 1 + i])
    return out


def order_min_hash(hashes: np.ndarray) -> list[int]:
    """One key per sample: the picked k-mers in text order."""
    kmers = shingles(hashes)
    if not len(kmers):
        return []
    order = np.argsort(kmers, kind="stable")
    ordered = kmers[order]
    new = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    occurrence = np.empty(len(kmers), np.uint64)
    occurrence[order] = np.arange(len(kmers)) - np.repeat(new, np.diff(np.r_[new, len(kmers)]))
    labelled = _mix(kmers + occurrence * np.uint64(0xD6E8FEB86659FD93))
    picked = min(PICKED, len(kmers))
    places = np.concatenate([  # of all samples at once, of a few where the text is long
        np.argpartition(_mix(labelled ^ seeds[:, None]), picked - 1, axis=1)[:, :picked]
        for seeds in np.array_split(_SEEDS, min(SAMPLES, 1 + len(kmers) * SAMPLES // RANKS))])
    places.sort(axis=1)
    keys = np.arange(SAMPLES, dtype=np.uint64)
    for n in range(picked):
        keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + kmers[places[:, n]])
    return keys.view(np.int64).tolist()


def word_bag(hashes: np.ndarray) -> bytes:
    """How many words fall into each class, at most 255 of each; there are two to
    four classes a word, within the bounds."""
    bins = min(MOST_BINS, max(LEAST_BINS, 2 << max(0, len(hashes) - 1).bit_length()))
    counts = np.bincount((hashes >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64), minlength=bins)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def folded(bag: np.ndarray, bins: int) -> np.ndarray:
    """The counts of a bag by fewer classes."""
    return bag.reshape(bins, -1).sum(axis=1, dtype=np.int16)


def _lists(column: pa.ListArray) -> Iterator[np.ndarray]:
    values = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    bounds = column.offsets.to_numpy()
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        yield values[low:high]


def _first_difference(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning, read in growing steps."""
    at, step, end = 0, 32, min(len(a), len(b))
    while at < end:
        size = min(step, end - at)
        differs = a[at:at + size] != b[at:at + size]
        first = int(differs.argmax())
        if differs[first]:
            return at + first
        at, step = at + size, step * 4
    return end


def _without_equal_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = _first_difference(a, b)
    a, b = a[start:], b[start:]
    end = _first_difference(a[::-1], b[::-1])
    return a[:len(a) - end], b[:len(b) - end]


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Edits between two sequences if at most `most`, along a widening band.

    With d edits, reach[d + k] is how far in `a` one gets on the diagonal
    k = i - j; all diagonals of the band move on together."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    _, numbers = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = np.append(numbers[:n], -1), np.append(numbers[n:], -2)  # an end mark equals nothing
    goal, nowhere = n - m, -2 - n - m
    reach = np.array([_first_difference(a, b)])
    for d in range(most + 1):
        if abs(goal) <= d and reach[d + goal] >= n:
            return d
        around = np.full(2 * d + 5, nowhere)
        around[2:-2] = reach
        k = np.arange(-d - 1, d + 2)
        reach = np.minimum(np.maximum(np.maximum(around[1:-1], around[:-2]) + 1, around[2:]), np.minimum(n, m + k))
        on = reach >= np.maximum(0, k)
        reach[~on] = nowhere
        live = on.nonzero()[0]
        for _ in range(8):
            i = reach[live]
            live = live[a[i] == b[i - k[live]]]
            if not len(live):
                break
            reach[live] += 1
        for x in live:  # few diagonals run on for long
            i = reach[x]
            reach[x] = i + _first_difference(a[i:], b[i - k[x]:])
    return None


def _shared(values: np.ndarray, n: int) -> int:
    """Values that the first `n` and the others have in common, with their numbers."""
    size = int(values.max(initial=-1)) + 1
    return int(np.minimum(np.bincount(values[:n], minlength=size), np.bincount(values[n:], minlength=size)).sum())


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether 1 - edits / words of the longer text is at least `similarity`.

    An edit changes one word and at most two pairs of neighbours, so common words
    and common pairs bound the edits before the alignment is made."""
    most = int((1 - similarity) * max(len(a), len(b)) + 1e-9)
    a, b = _without_equal_ends(a, b)
    n, longer = len(a), max(len(a), len(b))
    if longer <= most:
        return True
    if abs(n - len(b)) > most:
        return False
    known, values = np.unique(np.concatenate([a, b]), return_inverse=True)
    if _shared(values, n) < longer - most:
        return False
    if longer - 1 > 2 * most:
        pairs = np.delete(values[:-1] * len(known) + values[1:], n - 1) if n else values[:0]  # not the one across
        if _shared(np.unique(pairs, return_inverse=True)[1], n - 1) < longer - 1 - 2 * most:
            return False
    return edit_distance(values[:n], values[n:], most) is not None


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.transform(words(text_or_empty()), lambda w: F.xxhash64(w)).alias("w"))


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, fp, keys, bag): 128-bit fingerprint of the words, sample
    keys, and the numbers of words by the highest bits of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = list(_lists(batch["w"]))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([len(t) for t in texts], pa.int32()),
                 pa.array([hashlib.blake2b(t.tobytes(), digest_size=16).digest() for t in texts], pa.binary()),
                 pa.array([order_min_hash(t) for t in texts], pa.list_(pa.int64())),
                 pa.array([word_bag(t) for t in texts], pa.binary())],
                names=["doc_id", "n_words", "fp", "keys", "bag"])

    return _hashed(docs).mapInArrow(run, "doc_id long, n_words int, fp binary, keys array<long>, bag binary")


def candidates(texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b), a < b: each text with the leaders of its buckets, lengths allowing."""
    each = texts.select(F.struct("node", "n_words").alias("text"), F.explode("keys").alias("key"))
    leaders = each.groupBy("key").agg(F.min("text").alias("first"), F.min_by("text", F.xxhash64("text.node")).alias("second"), F.count("*").alias("n")).filter("n > 1")
    leaders = materialise(leaders.drop("n"), "near-leaders")
    pair = each.join(leaders, "key").select("text", F.explode(F.array("first", "second")).alias("leader"))
    shorter, longer = F.least("text.n_words", "leader.n_words"), F.greatest("text.n_words", "leader.n_words")
    return (pair.filter((F.col("text.node") != F.col("leader.node")) & (shorter >= longer * similarity - 1e-9))
            .select(F.least("text.node", "leader.node").alias("a"), F.greatest("text.node", "leader.node").alias("b")).distinct())


def least_edits(bags: list[np.ndarray], x: np.ndarray, y: np.ndarray, differs: np.ndarray) -> np.ndarray:
    """A lower bound of the edits between texts x and y, whose lengths differ by `differs`.

    An edit changes the numbers of words by one up and one down at most.  Bags of
    different sizes are compared by the classes of the smaller one."""
    sizes = np.array([len(b) for b in bags])
    bins, out = np.minimum(sizes[x], sizes[y]), np.zeros(len(x), np.int64)
    for size in np.unique(bins).tolist():
        here = (bins == size).nonzero()[0]
        used, at = np.unique(np.concatenate([x[here], y[here]]), return_inverse=True)
        counts = np.stack([folded(bags[t], size) for t in used.tolist()])
        left, right = at[:len(here)], at[len(here):]
        step = max(1, COUNTS // size)
        for low in range(0, len(here), step):
            apart = np.abs(counts[left[low:low + step]] - counts[right[low:low + step]]).sum(axis=1, dtype=np.int64)
            out[here[low:low + step]] = apart
    return (out + differs + 1) // 2


def _pairs_of_tile(node: np.ndarray, n_words: np.ndarray, group: np.ndarray, bags: list[np.ndarray], keys: np.ndarray, key: int,
                   is_rest: np.ndarray, rest: np.ndarray, other: np.ndarray, most: int, similarity: float) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs of a text left apart (`rest`) and a text of the other side, of two classes,
    that may be similar: the `most` likeliest of each text, and whether there were more."""
    left, right = rest.nonzero()[0], other.nonzero()[0]
    found = []
    step = max(1, PAIRS // max(1, len(right)))
    for at in range(0, len(left), step):
        x, y = (i.ravel() for i in np.meshgrid(left[at:at + step], right, indexing="ij"))
        longer = np.maximum(n_words[x], n_words[y])
        # the allowed edits are those of similar()
        edits = ((1 - similarity) * longer + 1e-9).astype(np.int64)
        differs = np.abs(n_words[x] - n_words[y])
        may = (group[x] != group[y]) & (differs <= edits) & (~is_rest[y] | (node[x] < node[y]))
        x, y, longer, edits, differs = x[may], y[may], longer[may], edits[may], differs[may]
        first = (keys[x] == keys[y]).argmax(axis=1)  # of the samples that they share
        may = keys[x, first] == key
        x, y, longer, edits, differs = x[may], y[may], longer[may], edits[may], differs[may]
        least = least_edits(bags, x, y, differs)
        may = least <= edits
        x, y, share = x[may], y[may], least[may] / np.maximum(1, longer[may])
        order = np.lexsort((share, x))
        found.append((x[order], y[order]))
    x, y = (np.concatenate([f[i] for f in found]) if found else left[:0] for i in (0, 1))
    rank = np.arange(len(x)) - np.searchsorted(x, x)
    a, b = node[x[rank < most]], node[y[rank < most]]
    return np.minimum(a, b), np.maximum(a, b), bool((rank >= most).any())


def _mixed_buckets(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(key, home, down, across): buckets of several classes, their most frequent class,
    and the tiles that their other texts and all their texts fill."""
    sized = (texts.join(found, "node", "left").select(F.coalesce("class", "node").alias("class"), F.explode("keys").alias("key"))
             .groupBy("key", "class").agg(F.count("*").alias("n")))
    return (sized.groupBy("key").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("class", F.struct("n", "class")).alias("home"), F.count("*").alias("classes"))
            .filter("n > 2 and classes > 1")
            .select("key", "home", F.ceil((F.col("n") - F.col("most")) / TILE).cast("int").alias("down"), F.ceil(F.col("n") / TILE).cast("int").alias("across")))


def left_apart(texts: DataFrame, found: DataFrame, most: int, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b, more), a < b: pairs of a bucket that are not in one class and may be
    similar, of each text and tile the `most` likeliest; `more` where some are left.

    Each bucket has a home class; its other texts are dealt to rows of tiles, all its
    texts to columns, so that a tile has a bounded number of either.  Buckets of two
    texts were compared by their leaders."""
    grouped = texts.join(found, "node", "left").select("node", "n_words", "bag", "keys", F.coalesce("class", "node").alias("class"), F.explode("keys").alias("key"))
    mixed = materialise(_mixed_buckets(texts, found), "near-mixed")
    row = F.pmod(F.xxhash64("node", F.lit(1)), F.col("down")).cast("int")
    column = F.pmod(F.xxhash64("node", F.lit(2)), F.col("across")).cast("int")
    is_rest = F.col("class") != F.col("home")
    # a text left apart stands in all tiles of its row, any text in all tiles of its column
    along = F.when(is_rest, F.transform(F.sequence(F.lit(0), F.col("across") - 1), lambda c: F.struct(row.alias("r"), c.alias("c")))).otherwise(F.array().cast("array<struct<r:int,c:int>>"))
    down = F.transform(F.sequence(F.lit(0), F.col("down") - 1), lambda r: F.struct(r.alias("r"), column.alias("c")))
    rows = (maybe_in(grouped, "key", mixed).join(mixed, "key")
            .select("key", "node", "n_words", "class", "bag", "keys", is_rest.alias("is_rest"), row.alias("row"), column.alias("column"),
                    F.explode(F.array_distinct(F.concat(along, down))).alias("tile"))
            .select("key", F.col("tile.r").alias("r"), F.col("tile.c").alias("c"), "node", "n_words", "class", "bag", "keys", "is_rest",
                    (F.col("is_rest") & (F.col("row") == F.col("tile.r"))).alias("rest"), (F.col("column") == F.col("tile.c")).alias("other"))
            .repartition("key", "r", "c").sortWithinPartitions("key", "r", "c", "node"))

    def pairs(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        column = lambda name: t[name].to_numpy()
        bags = [np.frombuffer(b, np.uint8) for b in t["bag"].to_pylist()]
        keys = np.array(t["keys"].to_pylist(), np.int64)
        a, b, more = _pairs_of_tile(column("node"), column("n_words").astype(np.int64), column("class"), bags, keys, column("key")[0],
                                    column("is_rest").astype(bool), column("rest").astype(bool), column("other").astype(bool), most, similarity)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.full(len(a), more), pa.bool_())], names=["a", "b", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.stack([batch[name].to_numpy().astype(np.int64) for name in ("key", "r", "c")])
            starts = np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1
            for low, high in zip([0, *starts.tolist()], [*starts.tolist(), batch.num_rows], strict=True):
                if tuple(at[:, low]) != last and held:
                    yield pairs(held)
                    held = []
                last = tuple(at[:, low])
                held.append(batch.slice(low, high - low))
        if held:
            yield pairs(held)

    return rows.mapInArrow(run, "a long, b long, more boolean")


def all_classes(texts: DataFrame, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, class) as if all pairs of each bucket had been compared."""
    compared = materialise(candidates(texts, similarity), "near-pairs")
    found = classes(verified(compared, docs, similarity))
    most = FIRST_ROUND
    while True:
        listed = materialise(left_apart(texts, found, most, similarity).groupBy("a", "b").agg(F.max("more").alias("more")), "near-apart")
        new = materialise(listed.drop("more").join(compared, ["a", "b"], "left_anti"), "near-pairs")
        if not new.isEmpty():
            links = found.select(F.col("node").alias("u"), F.col("class").alias("v"))
            found = classes(links.unionByName(verified(new, docs, similarity)).distinct())
            compared = compared.unionByName(new)
        if listed.filter("more").isEmpty():
            return found
        most = TILE * TILE


def verified(pairs: DataFrame, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a written table) whose alignment is similar enough, as links (u, v), u > v.

    Pairs are dealt by their number, as their few bytes say little of the work."""
    tasks = min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + pairs.count() // ALIGNED)
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    known = materialise(maybe_in(_hashed(docs), "doc_id", nodes).groupBy("doc_id").agg(F.max("w").alias("w")), "near-texts")
    both = (pairs.join(known.withColumnsRenamed({"doc_id": "a", "w": "wa"}), "a")
            .join(known.withColumnsRenamed({"doc_id": "b", "w": "wb"}), "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(x, y, similarity) for x, y in zip(_lists(batch["wa"]), _lists(batch["wb"]), strict=True)]
            links = pa.RecordBatch.from_arrays([batch["b"], batch["a"]], names=["u", "v"])
            yield links.filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "wa", "wb").repartition(tasks, "a", "b").mapInArrow(run, "u long, v long")


def classes(links: DataFrame) -> DataFrame:
    """(node, class): smallest node of each connected component, for linked nodes.

    Alternating large-star and small-star steps until the links are stars; every
    step is written to the shared folder."""
    links = materialise(links, "near-links")
    state = None
    while True:
        total = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if total == state:
            return links.select(F.col("u").alias("node"), F.col("v").alias("class"))
        state = total
        around = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "near-least")
        large = around.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialise(large, "near-large")
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "near-least")
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        links = materialise(small.select("x.u", "x.v").filter("u <> v").distinct(), "near-small")


def near_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, copy_of, class_id, n_words, kept), one row per document: the
    smallest id with the same words, and the smallest id of its class."""
    sketched = materialise(sketches(docs), "near-sketches")
    texts = materialise(sketched.groupBy("fp").agg(F.min("doc_id").alias("node"), *[F.first(c).alias(c) for c in ("n_words", "keys", "bag")]), "near-nodes")
    found = all_classes(texts.filter("node is not null").drop("fp"), docs, similarity)
    nodes = texts.select("fp", F.col("node").alias("copy_of"))
    return (sketched.select("doc_id", "n_words", "fp").join(nodes, "fp")
            .join(found.withColumnRenamed("node", "copy_of"), "copy_of", "left")
            .select("doc_id", "copy_of", F.coalesce("class", "copy_of").alias("class_id"), F.col("n_words").cast("long").alias("n_words"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id"))))


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """`docs` with one document of each class; all columns stay.  Where ids repeat,
    every row is a document of its own, so that only rows that are copies go."""
    if not docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        keyed = materialise(docs.withColumn("__row", F.monotonically_increasing_id()), "near-rows")
        rows = keyed.filter("doc_id is not null")
        found = near_classes(rows.select(F.col("__row").alias("doc_id"), "text"), similarity).select(F.col("doc_id").alias("__row"), "class_id")
        first = found.join(rows.select("__row", "doc_id"), "__row").groupBy("class_id").agg(F.min(F.struct("doc_id", "__row")).alias("first"))
        stays = materialise(first.select("first.__row"), "near-kept")
        return rows.join(stays, "__row", "left_semi").unionByName(keyed.filter("doc_id is null")).select(*docs.columns)
    dropped = materialise(near_classes(docs.select("doc_id", "text"), similarity).filter("not kept").select(F.col("doc_id").alias("__id")).distinct(), "near-dropped")
    return docs.join(dropped, F.col("doc_id") == F.col("__id"), "left_anti")
