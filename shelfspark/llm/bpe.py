"""BPE encoding and decoding through a minimal acyclic transducer lexicon.

The most frequent words of the corpus (counted over all of it) are compiled
into a minimal acyclic automaton: words share prefixes and suffixes, each
transition carries how many words precede it, so walking a word yields its
number, and the number selects its token ids from one flat array.  The
automaton is a file in the shared folder; Spark hands it to every executor and
tasks memory-map it.  Words outside it are merged exactly by the merge ranks.
The lexicon only saves merging: results are the same with any lexicon.

Text is normalised and split as the vocabulary file says (NFC, white space,
lower case; contractions, letter runs, single digits, other runs; byte-level
characters; an end mark on the last).  Texts of Latin letters take a regular
expression; others go through the library's own normaliser and splitter.

Defined results: null and empty texts have no ids and decode to an empty text;
the control tokens' strings in a text are those tokens, as in the library;
repeated rows and null ids are encoded row by row; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import mmap
import sys
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.common import materialise, most_frequent, scratch, text_or_empty

LEXICON_WORDS = 65_536
COUNTER_WORDS = 500_000  # distinct words a task holds before it hands its counts on
MEMO_RUNS = 200_000  # runs between white space whose ids a worker remembers, twice
MEMO_WORDS = 100_000  # words besides, twice
LONGEST_KEPT = 64  # longer ones are encoded each time

# The splitting rule of the vocabulary, for characters below U+0250.
_SIMPLE = regex.compile(r"[\x00-\u024f]*")
# Of these characters str.split() cuts at the white space of the rule and nowhere else.
_SPLIT = regex.compile(r"[\x00-\x1b\x20-\u024f]*")
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r \x85\xa0\p{L}\p{N}]+")


@lru_cache(maxsize=1)
def byte_chars() -> list[str]:
    """A printable character for every byte: itself, or one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b if b in plain else next(other)) for b in range(256)]


class Merges:
    """Vocabulary and exact merging, from the text of a vocabulary file."""

    def __init__(self, spec: str) -> None:
        parsed = json.loads(spec)
        model = parsed["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.spec, self.size = spec, len(vocab)
        # a pair of ids as one number -> its rank, and the id it merges to
        self.ranks, self.merged = {}, {}
        for rank, m in enumerate(model["merges"]):
            left, right = m if isinstance(m, list) else m.split(" ")
            pair = vocab[left] * self.size + vocab[right]
            self.ranks[pair], self.merged[pair] = rank, vocab[left + right]
        self.single = [vocab[c] for c in byte_chars()]
        self.last = [vocab[c + end] for c in byte_chars()]
        self.special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        self.names = {i: t for t, i in (vocab | self.special).items()}
        self.special_at = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self._library = None

    def words(self, text: str) -> list[str]:
        """The words of a text without control tokens."""
        if _SIMPLE.fullmatch(text):
            return _WORDS.findall(text.lower())
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.spec)
            self._bytes = {c: b for b, c in enumerate(byte_chars())}
        pieces = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))
        return [bytes(map(self._bytes.__getitem__, p)).decode() for p, _ in pieces]

    def merge(self, word: str) -> list[int]:
        data = word.encode()
        ids = [*map(self.single.__getitem__, data[:-1]), self.last[data[-1]]]
        return self._few(ids) if len(ids) <= 64 else self._many(ids)

    def _few(self, ids: list[int]) -> list[int]:
        size, none = self.size, 1 << 30
        rank, merged = self.ranks.get, self.merged
        ranks = [rank(a * size + b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (best := min(ranks)) < none:
            at = ranks.index(best)
            ids[at:at + 2] = [merged[ids[at] * size + ids[at + 1]]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank(ids[at - 1] * size + ids[at], none)
            if at < len(ranks):
                ranks[at] = rank(ids[at] * size + ids[at + 1], none)
        return ids

    def _many(self, ids: list[int]) -> list[int]:
        """The same merges by a queue, for words of any length."""
        n, size = len(ids), self.size
        after, before, own = [*range(1, n), -1], [*range(-1, n - 1)], list(ids)

        def entry(i: int, j: int) -> tuple[int, int, int] | None:
            pair = own[i] * size + own[j]
            return (self.ranks[pair], i, pair) if pair in self.ranks else None

        queue = [e for i in range(n - 1) if (e := entry(i, i + 1))]
        heapq.heapify(queue)
        while queue:
            _, i, pair = heapq.heappop(queue)
            j = after[i]
            if own[i] < 0 or j < 0 or own[i] * size + own[j] != pair:
                continue
            own[i], own[j] = self.merged[pair], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if e := entry(i, k):
                    heapq.heappush(queue, e)
            if (h := before[i]) >= 0 and (e := entry(h, i)):
                heapq.heappush(queue, e)
        return [i for i in own if i >= 0]

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(map(self.names.__getitem__, ids))


def compile_lexicon(entries: dict[str, list[int]]) -> bytes:
    """The minimal acyclic transducer of word -> ids as one block of bytes.

    Words are added in sorted order; the states of the last word that the next
    one cannot share are merged with equal ones (same finality, same edges)."""
    words = sorted((w.encode(), ids) for w, ids in entries.items())
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []  # frozen: (final, ((label, state), ...))
    path: list[list] = [[False, []]]  # open states of the last word: [final, edges]

    def freeze(keep: int) -> None:
        while len(path) > keep + 1:
            final, edges = path.pop()
            key = (final, tuple(edges))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            parent = path[-1][1]
            parent[-1] = (parent[-1][0], register[key])

    last = b""
    for word, _ in words:
        common = next((i for i, (a, b) in enumerate(zip(last, word, strict=False)) if a != b), min(len(last), len(word)))
        freeze(common)
        for b in word[common:]:
            path[-1][1].append((b, -1))
            path.append([False, []])
        path[-1][0] = True
        last = word
    freeze(0)
    states.append((path[0][0], tuple(path[0][1])))

    below = [0] * len(states)  # words reachable from a state; children are frozen first
    first, labels, targets, skips = [0], [], [], []
    for i, (final, edges) in enumerate(states):
        count = int(final)
        for label, target in edges:
            labels.append(label)
            targets.append(target)
            skips.append(count)
            count += below[target]
        below[i] = count
        first.append(len(labels))
    offsets = np.cumsum([0, *(len(ids) for _, ids in words)])
    numbers = [[len(states) - 1], first, targets, skips, [int(f) for f, _ in states], offsets, [i for _, ids in words for i in ids]]
    numbers = [np.array(x, "<u4") for x in numbers]
    return np.array([len(labels), *map(len, numbers)], "<u4").tobytes() + b"".join(x.tobytes() for x in numbers) + bytes(labels)


class Lexicon:
    """A compiled lexicon over a buffer, for instance a memory-mapped file."""

    def __init__(self, buffer: bytes | mmap.mmap) -> None:
        view = memoryview(buffer)
        sizes = view[:32].cast("I")
        at, numbers = 32, []
        for n in sizes[1:]:
            numbers.append(view[at:at + 4 * n].cast("I"))
            at += 4 * n
        root, self.first, self.targets, self.skips, self.final, self.offsets, self.ids = numbers
        self.root, self.labels, self.find = root[0], at, buffer.find

    @classmethod
    def open(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def get(self, word: str) -> list[int] | None:
        state, number, base = self.root, 0, self.labels
        first, find = self.first, self.find
        for label in map(_ONE.__getitem__, word.encode()):
            edge = find(label, base + first[state], base + first[state + 1]) - base
            if edge < 0:
                return None
            number += self.skips[edge]
            state = self.targets[edge]
        if not self.final[state]:
            return None
        return self.ids[self.offsets[number]:self.offsets[number + 1]].tolist()


_ONE = [bytes([b]) for b in range(256)]


def vocabulary(path: str | None = None) -> str:
    """The vocabulary file's text; the installed public one unless a path is given."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def frequent_words(docs: DataFrame, spec, top: int) -> list[str]:
    """The most frequent words of all texts, at most `top`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, counts, pieces = Merges(spec.value), Counter(), Counter()

        def handed_on() -> pa.RecordBatch:
            for piece, n in pieces.items():  # no word crosses white space
                for word in _WORDS.findall(piece):
                    counts[word] += n
            out = pa.RecordBatch.from_pydict({"word": list(counts), "n": list(counts.values())})
            counts.clear()
            pieces.clear()
            return out

        for batch in batches:
            for text in batch["t"].to_pylist():
                if _SPLIT.fullmatch(text):
                    pieces.update(text.lower().split())
                else:
                    counts.update(merges.words(text))
                if len(counts) + len(pieces) >= COUNTER_WORDS:
                    yield handed_on()
        if counts or pieces:
            yield handed_on()

    counted = docs.select(text_or_empty().alias("t")).mapInArrow(count, "word string, n long")
    totals = materialise(counted.groupBy("word").agg(F.sum("n").alias("n")), "bpe-words")
    return [r["word"] for r in most_frequent(totals, "n", top).select("word").collect()]


def share_file(spark: SparkSession, data: bytes, name: str) -> str:
    """Write `data` below the shared folder and have Spark hand it to every
    executor, also to ones that start later; gives the name for SparkFiles."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch(spark, name))
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()
    spark.sparkContext.addFile(path.toString())
    return path.getName()


def _little(ids: array) -> bytes:
    if sys.byteorder == "big":
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()


class Memo:
    """Values by text in two generations: what is still asked for moves to the young
    one, and when that is full the old one goes."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def put(self, text: str, value: bytes) -> bytes:
        if len(text) <= LONGEST_KEPT:
            if len(self.young) >= self.size:
                self.old, self.young = self.young, {}
            self.young[text] = value
        return value


class Encoder:
    """Encodes with a lexicon; remembers ids, between the tasks of a worker too: of
    whole runs between white space, and of words."""

    def __init__(self, merges: Merges, known: Lexicon) -> None:
        self.merges, self.known = merges, known
        self.words, self.runs = Memo(MEMO_WORDS), Memo(MEMO_RUNS)

    def _word(self, word: str) -> bytes:
        memo = self.words
        found = memo.young.get(word)
        if found is None:
            found = memo.old.get(word)
            memo.put(word, found := found or array("I", self.known.get(word) or self.merges.merge(word)).tobytes())
        return found

    def _run(self, run: str) -> bytes:
        found = self.runs.old.get(run)
        return self.runs.put(run, found or b"".join(map(self._word, _WORDS.findall(run))))

    def _plain(self, text: str) -> list[bytes]:
        if _SPLIT.fullmatch(text):
            get, add = self.runs.young.get, self._run
            return [get(r) or add(r) for r in text.lower().split()]
        return [self._word(w) for w in self.merges.words(text)]

    def ids(self, text: str) -> array:
        merges, out = self.merges, array("I")
        if not merges.special_at or not merges.special_at.search(text):
            out.frombytes(b"".join(self._plain(text)))
            return out
        at = 0
        for m in merges.special_at.finditer(text):
            out.frombytes(b"".join(self._plain(text[at:m.start()])))
            out.append(merges.special[m[0]])
            at = m.end()
        out.frombytes(b"".join(self._plain(text[at:])))
        return out


_ENCODERS: dict[str, Encoder] = {}


def _encoder(lexicon: str, spec) -> Encoder:
    """The worker's encoder for a lexicon file; the last one is kept."""
    if lexicon not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[lexicon] = Encoder(Merges(spec.value), Lexicon.open(SparkFiles.get(lexicon)))
    return _ENCODERS[lexicon]


def encode(docs: DataFrame, path: str | None = None, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, ids, decoded): `ids` are little-endian unsigned 32-bit integers."""
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(vocabulary(path))
    merges = Merges(spec.value)
    lexicon = share_file(spark, compile_lexicon({w: merges.merge(w) for w in frequent_words(docs, spec, lexicon_words)}), "bpe-lexicon")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(lexicon, spec)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                done = [encoder.ids(t) for t in part["t"].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(map(_little, done), pa.binary()), pa.array(map(encoder.merges.decode, done), pa.string())],
                    names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("t")).mapInArrow(run, "doc_id long, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
