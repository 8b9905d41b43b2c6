"""Katz backoff language model, learned and evaluated as Spark jobs.

The model has order two: P(w | h) is the Good-Turing discounted bigram estimate
where (h, w) was seen in training, else alpha(h) P(w), and P(w) is the
discounted unigram estimate, whose left-over mass is that of the one unknown
word.  With d(r) the discount of a count r (1 above 5):

    P(w | h) = d(c(h w)) c(h w) / m(h)                     if c(h w) > 0
             = alpha(h) P(w)                               if c(h) > 0
             = P(w)                                        otherwise
    alpha(h) = (1 - sum of P(w | h) over seen w) / (1 - sum of P(w) over seen w)
    m(h)     = c(h), or c(h) + 1 where h has no discounted follower or is one of
               the hot histories, so that every history leaves mass

so that the probabilities after any history sum to exactly one.  Each text is
a start, its tokens and an end.

1. Words of training texts are counted: the unigram table.
2. Texts are read once more, in blocks of about `BLOCK_TOKENS` tokens.  A block
   sorts its (history, word, document, count) entries and sends them, packed, to
   the partition of their history; the entries of a hot history (one training
   token in 2048 and at least 1000) are dealt by history and word instead, so
   that no history fills a task.  A partition knows c(h) and c(h w) for all it
   holds: it adds up what it can score, per document, and hands on bigram and
   history tables and the unseen pairs.
3. Histories get their exact backoff weights by joining the rarer followers with
   the unigram table; the most frequent words are broadcast, at most
   `HEAD_WORDS`.  Unseen pairs join the weight of their history and the
   probability of their word: the recursion, one level down.
4. Sums meet per block of documents.

Words are told apart by 64-bit hashes after they have been counted as texts.

Defined results: null and empty texts hold the end alone; null ids count as an
empty id for the training fold; repeated rows are scored row by row; a corpus
without training rows gives the unknown word all probability and all scores
zero; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import materialise, most_frequent, text_or_empty

BLOCK_TOKENS = 400_000
PART_TOKENS = 1_300_000  # of a partition of histories
HEAD_WORDS = 131_072
COUNTER_WORDS = 200_000
KATZ = 5  # counts above are not discounted
HOT_SHARE, HOT_LEAST = 2048, 1000
FIXED = float(1 << 34)  # partial sums travel as whole multiples of 1 / FIXED
START, END = 1, 2  # hashes of the text's start and end
MOST_DOCS = 65_535  # documents of a block

_BLOB = "kind string, part int, block long, blob binary"


def _pack(value) -> bytes:
    return zstandard.ZstdCompressor(1).compress(pickle.dumps(value, 5))


def _unpack(blob: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def _planes(a: np.ndarray) -> tuple[str, int, bytes]:
    """An array with its low bytes first, then the next: packs better."""
    return a.dtype.str, len(a), a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def _from_planes(packed: tuple[str, int, bytes]) -> np.ndarray:
    dtype, n, data = packed
    size = np.dtype(dtype).itemsize
    return np.frombuffer(data, np.uint8).reshape(size, n).T.copy().view(dtype).reshape(n)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tokens(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode().lower().split()


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 == 2


def discounts(n: dict[int, int]) -> list[float]:
    """d(1) .. d(KATZ) from counts of counts; below one and above zero each.

    Good-Turing where the counts of counts give such a discount, else the
    absolute discount n1 / (n1 + 2 n2) of the same counts."""
    n1, n2 = n.get(1, 0), n.get(2, 0)
    absolute = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    common = (KATZ + 1) * n.get(KATZ + 1, 0) / n1 if n1 else 1.0
    out = []
    for r in range(1, KATZ + 1):
        d = 1.0
        if common < 1 and n.get(r):
            d = ((r + 1) * n.get(r + 1, 0) / (r * n[r]) - common) / (1 - common)
        out.append(d if 0 < d < 1 else 1 - absolute / r)
    return out


@dataclass
class Unigrams:
    """What every task knows of the unigram level (bounded by HEAD_WORDS)."""

    n: int  # training tokens, ends included
    v: int
    texts: int  # training texts = count of the end
    d: list[float]
    unknown: float  # probability of the unknown word
    total: int  # the denominator
    head: np.ndarray  # sorted hashes of the most frequent words
    counts: np.ndarray
    hot_from: int  # training count from which a history is dealt by word too

    def prob(self, c: np.ndarray) -> np.ndarray:
        d = np.array([0.0, *self.d])
        return np.where(c == 0, self.unknown, np.where(c <= KATZ, d[np.minimum(c, KATZ)], 1.0) * c / max(self.total, 1))

    def prob_column(self, c: Column) -> Column:
        small = F.get(F.array(*[F.lit(x) for x in [0.0, *self.d]]), F.least(c, F.lit(KATZ)).cast("int"))
        return F.when(c.isNull(), F.lit(self.unknown)).otherwise(F.when(c <= KATZ, small).otherwise(F.lit(1.0)) * c / F.lit(float(max(self.total, 1))))

    @property
    def hot(self) -> np.ndarray:
        return self.counts >= self.hot_from


def count_words(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The unigram table (word, h, c) of training texts, and the token count of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            words = list(counts)
            return pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)), pa.array(list(counts.values()), pa.int64())], names=["word", "h", "c"])

        counts, everything = Counter(), 0
        for batch in batches:
            for held, text in zip(batch["held"].to_pylist(), batch["t"].to_pylist(), strict=True):
                found = tokens(text)
                everything += len(found) + 1
                if not held:
                    counts.update(found)
                if len(counts) >= COUNTER_WORDS:
                    yield rows()
                    counts = Counter()
        yield rows()
        # the token count travels as a row without a word
        yield pa.RecordBatch.from_pydict({"word": pa.array([None], pa.binary()), "h": pa.array([0], pa.int64()), "c": pa.array([everything], pa.int64())})

    counted = docs.mapInArrow(run, "word binary, h long, c long").groupBy("word", "h").agg(F.sum("c").alias("c"))
    table = materialise(counted, "lm-unigrams")
    return table.filter("word is not null"), table.filter("word is null")


def unigrams(table: DataFrame, texts: int) -> Unigrams:
    stats = table.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n"), *[F.count_if(F.col("c") == r).alias(f"n{r}") for r in range(1, KATZ + 2)]).first()
    n_r = {r: stats[f"n{r}"] + (texts == r) for r in range(1, KATZ + 2)}
    d = discounts(n_r)
    n = stats["n"] + texts
    left = sum((1 - d[r - 1]) * r * n_r[r] for r in range(1, KATZ + 1))
    total = n if left > 0 else n + 1
    head = most_frequent(table.select("h", "c"), "c", HEAD_WORDS).toPandas()
    order = np.argsort(head["h"].to_numpy().view(np.uint64))
    return Unigrams(n, stats["v"] + (texts > 0), texts, d, (left if left > 0 else 1) / total, total,
                    head["h"].to_numpy().view(np.uint64)[order], head["c"].to_numpy()[order].astype(np.int64), max(HOT_LEAST, n // HOT_SHARE))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for sizes[0] places, then starts[1] ..."""
    total = int(sizes.sum())
    first = np.cumsum(sizes) - sizes
    return np.repeat(starts - first, sizes) + np.arange(total)


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key and whether it is there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def _block_rows(block: int, ids: list, held: list[bool], texts: list[list[bytes]], known: Unigrams, parts: int) -> Iterator[tuple]:
    """The packed entries of one block for each partition, and its documents."""
    flat = [t for text in texts for t in text]
    local = {t: i for i, t in enumerate(dict.fromkeys(flat))}
    n_words, n_docs = len(local), len(texts)
    seq = np.fromiter(map(local.__getitem__, flat), np.int64, len(flat))
    lens = np.fromiter(map(len, texts), np.int64, n_docs)
    hashes = np.concatenate([np.fromiter(map(xxhash.xxh64_intdigest, local), np.uint64, n_words), np.array([START, END], np.uint64)])
    ends = np.cumsum(lens)
    history, word = np.insert(seq, ends - lens, n_words), np.insert(seq, ends, n_words + 1)
    entry = ((history * (n_words + 2) + word) << 16) | np.repeat(np.arange(n_docs), lens + 1)
    entry.sort()
    new = np.flatnonzero(np.r_[True, entry[1:] != entry[:-1]])
    counts = np.diff(np.r_[new, len(entry)])
    entry = entry[new]
    pair, doc = entry >> 16, (entry & 0xFFFF).astype(np.uint16)
    start = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
    size = np.diff(np.r_[start, len(pair)])
    h, w = np.divmod(pair[start], n_words + 2)

    at, there = _find(known.head, hashes)
    hot = np.zeros(len(hashes), bool)
    hot[there] = known.hot[at[there]]
    hot[n_words] = True
    spread = np.where(hot[h], _mix(hashes[h] ^ _mix(hashes[w])), _mix(hashes[h]))
    part = (spread % np.uint64(parts)).astype(np.int64)
    # words as places in the head, one above: 0 is a rarer word, named by its hash
    place = np.where(there, at + 1, 0).astype(np.uint32)
    place[n_words + 1] = len(known.head) + 1
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    for p in range(parts):
        own = order[bounds[p]:bounds[p + 1]]
        if not len(own):
            continue
        entries = _ranges(start[own], size[own])
        heads = np.flatnonzero(np.r_[True, h[own][1:] != h[own][:-1]])
        yield "entries", p, block, _pack((
            n_docs, np.packbits(held).tobytes(), hashes[h[own][heads]], _planes(np.diff(np.r_[heads, len(own)]).astype(np.uint32)), _planes(place[w[own]]), hashes[w[own]][place[w[own]] == 0],
            _planes(size[own].astype(np.uint16)), _planes(doc[entries]), _planes(counts[entries].astype(np.uint32))))
    yield "docs", block % parts, block, _pack((ids, held, lens))


def _score_part(rows: pd.DataFrame, known: Unigrams) -> Iterator[tuple]:
    """What one partition of histories adds to the tables and to each document."""
    hs, ws, sizes, docs, counts, blocks, held, offset = [], [], [], [], [], [], [], 0
    words = np.concatenate([np.zeros(1, np.uint64), known.head, np.array([END], np.uint64)])
    for block, blob in zip(rows["block"], rows["blob"], strict=True):
        n_docs, held_bits, h, runs, place, rare, size, doc, count = _unpack(blob)
        place = _from_planes(place)
        w = words[place]
        w[place == 0] = rare
        hs.append(np.repeat(h, _from_planes(runs)))
        ws.append(w)
        sizes.append(_from_planes(size).astype(np.int64))
        docs.append(_from_planes(doc).astype(np.int32) + offset)
        counts.append(_from_planes(count).astype(np.int64))
        held.append(np.unpackbits(np.frombuffer(held_bits, np.uint8), count=n_docs).astype(bool))
        blocks.append((block, offset, n_docs))
        offset += n_docs
    # each list goes as soon as it is joined: a worker holds the entries once
    h, w, size = np.concatenate(hs), np.concatenate(ws), np.concatenate(sizes)
    del hs, ws, sizes
    first = np.cumsum(size) - size
    order = np.lexsort((w, h))
    h, w = h[order], w[order]
    entries = _ranges(first[order], size[order])
    size = size[order]
    del first, order
    doc, held = np.concatenate(docs)[entries], np.concatenate(held)
    del docs
    count = np.concatenate(counts)[entries]
    del counts, entries

    learned = np.add.reduceat(np.where(held[doc], 0, count), np.cumsum(size) - size)  # per (pair, block)
    pair_at = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (w[1:] != w[:-1])])
    c_pair = np.add.reduceat(learned, pair_at)
    pair_h, pair_w = h[pair_at], w[pair_at]
    pair_entries = np.add.reduceat(size, pair_at)
    del h, w, size, learned, pair_at
    h_at = np.flatnonzero(np.r_[True, pair_h[1:] != pair_h[:-1]])
    own_h, fan = pair_h[h_at], np.diff(np.r_[h_at, len(pair_h)])
    c_h = np.add.reduceat(c_pair, h_at)
    at, there = _find(known.head, own_h)
    hot = np.zeros(len(own_h), bool)
    hot[there] = known.hot[at[there]]
    c_h[hot] = known.counts[at[hot]]
    c_h[own_h == START], hot[own_h == START] = known.texts, True
    small = [np.add.reduceat((c_pair == r).astype(np.int64), h_at) for r in range(1, KATZ + 1)]
    m_h = c_h + (hot | (sum(small) == 0))

    # followers' unigram probabilities, where the words are in the head
    at, there = _find(known.head, pair_w)
    c_w = np.where(there, known.counts[at] if len(known.head) else 0, np.where(pair_w == END, known.texts, 0))
    here = there | (pair_w == END)
    p_w = np.where(here, known.prob(c_w), 0.0)
    seen = c_pair > 0
    followers = np.add.reduceat(np.where(seen, p_w, 0.0), h_at)
    exists = c_h > 0
    yield "histories", 0, _pack((own_h[exists], c_h[exists], m_h[exists], *[s[exists] for s in small], followers[exists]))
    place = np.where(there, at + 1, np.where(pair_w == END, len(known.head) + 1, 0)).astype(np.uint32)
    yield "bigrams", 0, _pack((own_h, _planes(fan), _planes(place), pair_w[place == 0], _planes(c_pair)))
    yield "counts", 0, _pack(np.bincount(np.minimum(c_pair, KATZ + 2), minlength=KATZ + 3))

    # per entry
    h_of_pair = np.repeat(np.arange(len(own_h)), fan)
    per = lambda x: np.repeat(x, pair_entries)  # noqa: E731  of pairs, for their entries
    c_own, r = c_h[h_of_pair], c_pair
    real = pair_h != START
    with np.errstate(divide="ignore"):
        gain = np.where(seen, np.where(r > KATZ, np.log10(np.maximum(r, 1)), 0.0) - np.log10(np.maximum(m_h[h_of_pair], 1)), np.where(here, np.log10(np.where(here, p_w, 1.0)), 0.0))
    total = lambda x: np.bincount(doc, per(x) * count, minlength=offset)
    sums = np.stack([total(np.where(real, np.log10(c_own + 1), 0.0)), total(real & exists[h_of_pair]), total(gain), *[total(r == k) for k in range(1, KATZ + 1)]])
    sums[[0, 2]] *= FIXED
    sums = np.round(sums).astype(np.int64)
    for block, low, n in blocks:
        yield "sums", block, _pack(_planes(sums[:, low:low + n].reshape(-1).copy()))

    # unseen pairs: the history's weight, and the word's probability if it is rare
    unseen = per(~seen)
    if unseen.any():
        block_of = np.repeat([b for b, _, _ in blocks], [n for _, _, n in blocks])
        local = doc - np.repeat([low for _, low, _ in blocks], [n for _, _, n in blocks])[doc]
        for kind, which, key in (("weights", unseen & per(exists[h_of_pair]), pair_h), ("words", unseen & per(~here), pair_w)):
            if which.any():
                yield kind, 0, _pack((per(key)[which], block_of[doc[which]], local[which], count[which]))


def _unpacked(table: DataFrame, kind: str, schema: str, names: list[str], take=lambda x: x) -> DataFrame:
    """The rows of one kind of the packed tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch["blob"].to_pylist():
                columns = take(_unpack(blob))
                for low in range(0, len(columns[0]), 500_000):
                    part = [c[low:low + 500_000] for c in columns]
                    yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in part], names=names)

    return table.filter(F.col("kind") == kind).select("blob").mapInArrow(run, schema)


def _rare_followers(bigrams) -> list[np.ndarray]:
    """(h, w) of the seen pairs whose word is not in the head."""
    own_h, fan, place, rare, counts = bigrams
    is_rare, counts = _from_planes(place) == 0, _from_planes(counts)
    seen = counts[is_rare] > 0
    return [np.repeat(own_h, _from_planes(fan))[is_rare][seen], rare[seen]]


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held"), text_or_empty().alias("t"))
    words, everything = count_words(source.select("held", "t"))
    known = unigrams(words, source.filter(~F.col("held")).count())
    n_all = everything.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    parts = max(1, math.ceil(n_all / PART_TOKENS))
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, task, number = shared.value, TaskContext.get().partitionId(), 0
        ids, held, texts, size = [], [], [], 0

        def rows() -> Iterator[pa.RecordBatch]:
            for kind, part, block, blob in _block_rows((task << 24) | number, ids, held, texts, known, parts):
                yield pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([part], pa.int32()), pa.array([block], pa.int64()), pa.array([blob], pa.binary())], names=["kind", "part", "block", "blob"])

        for batch in batches:
            for doc_id, fold, text in zip(*(batch[c].to_pylist() for c in ("doc_id", "held", "t")), strict=True):
                found = tokens(text)
                if texts and (size + len(found) > BLOCK_TOKENS or len(texts) == MOST_DOCS):
                    yield from rows()
                    number += 1
                    ids, held, texts, size = [], [], [], 0
                ids.append(doc_id)
                held.append(fold)
                texts.append(found)
                size += len(found) + 1
        if texts:
            yield from rows()

    def reduce(rows: pd.DataFrame) -> pd.DataFrame:
        entries, other = rows[rows["kind"] == "entries"], rows[rows["kind"] == "docs"]
        out = [("docs", b, x) for b, x in zip(other["block"], other["blob"], strict=True)]
        if len(entries):
            out += _score_part(entries.sort_values("block"), shared.value)
        return pd.DataFrame(out, columns=["kind", "block", "blob"])

    dealt = source.mapInArrow(blocks, _BLOB).repartition(parts, "part")
    tables = materialise(dealt.groupBy("part").applyInPandas(reduce, "kind string, block long, blob binary"), "lm-tables")

    # bigram discounts
    n_r: Counter = Counter()
    sums = _unpacked(tables, "counts", "r long, n long", ["r", "n"], lambda x: [np.arange(len(x)), x]).groupBy("r").agg(F.sum("n").alias("n"))
    n_r.update({r["r"]: r["n"] for r in sums.collect()})  # at most KATZ + 3 rows
    d = discounts(n_r)

    # the backoff table: histories with exact weights
    small = [f"n{r}" for r in range(1, KATZ + 1)]
    histories = _unpacked(tables, "histories", "h long, c long, m long, " + "".join(f"{s} long, " for s in small) + "followers double", ["h", "c", "m", *small, "followers"])
    histories = histories.groupBy("h").agg(F.max("c").alias("c"), F.max("m").alias("m"), *[F.sum(s).alias(s) for s in small], F.sum("followers").alias("followers"))
    rare = (_unpacked(tables, "bigrams", "h long, w long", ["h", "w"], _rare_followers)
            .join(words.select(F.col("h").alias("w"), "c"), "w").groupBy("h").agg(F.sum(known.prob_column(F.col("c"))).alias("rare")))
    kept = F.col("c") - sum((F.lit(1 - d[r - 1]) * r * F.col(f"n{r}") for r in range(1, KATZ + 1)), F.lit(0.0))
    alpha = (F.lit(1.0) - kept / F.col("m")) / (F.lit(1.0) - F.col("followers") - F.coalesce("rare", F.lit(0.0)))
    backoffs = materialise(histories.join(rare, "h", "left").select("h", F.log10(alpha).alias("log_alpha")), "lm-backoffs")

    # unseen pairs, one level down
    columns = ["k", "block", "doc", "n"]
    schema = "k long, block long, doc long, n long"
    weights = _unpacked(tables, "weights", schema, columns).join(backoffs.withColumnRenamed("h", "k"), "k").select("block", "doc", (F.col("n") * F.col("log_alpha")).alias("x"))
    below = _unpacked(tables, "words", schema, columns).join(words.select(F.col("h").alias("k"), "c"), "k", "left").select("block", "doc", (F.col("n") * F.log10(known.prob_column(F.col("c")))).alias("x"))
    unseen = weights.unionByName(below).groupBy("block", "doc").agg(F.sum("x").alias("x"))

    constants = np.log10(np.array(d) * np.arange(1, KATZ + 1))
    base_total, texts, n = math.log10(known.n + known.v + 1), known.texts, known.n

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        ids, held, lens = _unpack(rows.loc[rows["kind"] == "docs", "blob"].iloc[0])
        s = np.zeros((3 + KATZ, len(ids)), np.int64)
        for blob in rows.loc[rows["kind"] == "sums", "blob"]:
            s += _from_planes(_unpack(blob)).reshape(s.shape)
        return pd.DataFrame({
            "block": rows["block"].iloc[0], "doc": np.arange(len(ids)), "doc_id": pd.array(ids, "Int64"), "held_out": held, "n_tokens": lens + 1,
            "n_known": s[1] + (texts > 0), "train_tokens": n,
            "base_score": s[0] / FIXED + math.log10(texts + 1) - (lens + 1) * base_total, "partial": s[2] / FIXED + constants @ s[3:]})

    gathered = tables.filter("kind in ('docs', 'sums')").groupBy("block").applyInPandas(
        gather, "block long, doc long, doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, partial double")
    return gathered.join(unseen, ["block", "doc"], "left").select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", (F.col("partial") + F.coalesce("x", F.lit(0.0))).alias("score"))
