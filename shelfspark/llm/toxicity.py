"""Toxicity by Levenshtein automata over a lexicon trie.

The lexicon - words and word beginnings that mark toxic documents - is learned
from labelled documents.  Each word of a text is matched against the lexicon
trie by a Levenshtein automaton of distance one, swapped neighbours included
(states: position, edits left), so misspelled terms are caught.  A forward and a backward trie are used: one
edit leaves one half of the word untouched, so the walk starts behind an
untouched half.  Every hit is weighted by its context window: quoted hits count
less, and words around hits carry learned weights for abuse or report.  A
logistic model over the summed hits gives the score; it is fitted on documents
read with a lexicon that other documents taught, near copies teaching once.

Only the classifier is fitted on a bounded sample: at most `max_toxic` and
`max_clean` labelled documents, taken in hash order, whose crc32(doc_id) mod 5
is not 0.  The class balance comes from all such labels.  Scoring reads every
word of every text in tasks; nothing of the corpus reaches the driver.

Defined results: null and empty texts have no hit and a low score; labels that
are null or whose document is missing teach nothing, and a document labelled
twice is toxic if either label says so; without labels of both kinds every
score is the share of toxic labels, 0 where there are none; rows are scored
one by one, so repeated rows and null ids are scored like others; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import SPACES, materialise, text_or_empty

MAX_TOXIC, MAX_CLEAN = 8_000, 16_000
LEXICON_TERMS = 3_000
MIN_DOCUMENTS = 3  # toxic documents of the sample that a term needs
MIN_LOG_ODDS = 3.0
FUZZY_LOG_ODDS = 4.0  # that a term needs to be matched with an edit
PREFIXES = (4, 5, 6)
CONTEXT_WORDS = 3
CONTEXT_TERMS = 2_000
QUOTED = 0.25  # share of a hit's weight that counts in a quotation
EDITED = 0.9  # share that counts where the word is misspelled
MEMO_WORDS = 400_000
#: Characters cut from both ends of a word.
EDGES = ".,;:!?\"'()[]{}|<>*_~`«»“”„‘’"
#: Opening and closing quotation marks.
OPENING, CLOSING = "\"'«“„‘", "\"'»”“’"

_SPLIT = re.compile(SPACES)
_END = ""


def _add(trie: dict, term: str, value: tuple) -> None:
    for c in term:
        trie = trie.setdefault(c, {})
    trie[_END] = value


def _descend(trie: dict, part: str) -> dict | None:
    for c in part:
        trie = trie.get(c)
        if trie is None:
            return None
    return trie


def _walk(node: dict, word: str, i: int, edits: int, found: list) -> None:
    """The automaton's states (i, edits) run along the trie below `node`; states
    wait in a list, so that words and terms may have any length."""
    waiting = [(node, i, edits)]
    while waiting:
        node, i, edits = waiting.pop()
        if i == len(word):
            if _END in node:
                found.append(node[_END])
        elif (child := node.get(word[i])) is not None:
            waiting.append((child, i + 1, edits))
        if edits:
            if i < len(word):
                waiting.append((node, i + 1, 0))  # a letter too many
            for c, child in node.items():
                if c != _END:
                    waiting.append((child, i, 0))  # a letter missing
                    if i < len(word) and c != word[i]:
                        waiting.append((child, i + 1, 0))  # another letter
            if i + 1 < len(word) and (below := _descend(node, word[i + 1] + word[i])) is not None:
                waiting.append((below, i + 2, 0))  # two letters swapped


@dataclass
class Lexicon:
    """Terms with weights; those ending in * match by their beginning."""

    weights: dict[str, float]
    fuzzy_from: int = 5  # letters a term needs to be matched with an edit
    forward: dict = field(default_factory=dict)
    backward: dict = field(default_factory=dict)
    prefixes: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for term, weight in self.weights.items():
            if term.endswith("*"):
                self.prefixes[term[:-1]] = weight
            elif len(term) >= self.fuzzy_from and weight >= FUZZY_LOG_ODDS:
                _add(self.forward, term, (term, weight))
                _add(self.backward, term[::-1], (term, weight))

    def match(self, word: str) -> tuple[float, int]:
        """Weight of the best term for a word and its edits; (0, 0) for none."""
        best = self.weights.get(word, 0.0)
        for n in PREFIXES:
            best = max(best, self.prefixes.get(word[:n], 0.0))
        if best > 0:
            return best, 0
        if len(word) >= self.fuzzy_from - 1:
            found: list = []
            half = len(word) // 2
            node = _descend(self.forward, word[:half])
            if node:
                _walk(node, word, half, 1, found)
            back = word[::-1]
            node = _descend(self.backward, back[:len(word) - half])
            if node:
                _walk(node, back, len(word) - half, 1, found)
            swapped = word[:half - 1] + word[half] + word[half - 1] + word[half + 1:]  # across the halves
            if len(swapped) >= self.fuzzy_from and self.weights.get(swapped, 0.0) >= FUZZY_LOG_ODDS:
                found.append((swapped, self.weights[swapped]))
            if found:
                return max(w for _, w in found), 1
        return 0.0, 0


@dataclass
class Model:
    lexicon: dict[str, float]
    context: dict[str, float]
    weights: list[float]  # logistic weights, the constant last
    constant: float | None = None  # score where nothing could be learned


class Reader:
    """Finds the hits of texts; remembers words it has seen."""

    def __init__(self, lexicon: dict[str, float], context: dict[str, float]) -> None:
        self.lexicon, self.context = Lexicon(lexicon), context
        self.seen: set[str] = set()
        self.hits: dict[str, tuple[float, int]] = {}

    def places(self, text: str) -> tuple[list[str], list[int]]:
        """The words of a text and the numbers of those that hit."""
        words = [w for w in _SPLIT.split(text.lower()) if w]
        distinct = set(words)
        for raw in distinct - self.seen:
            found = self.lexicon.match(raw.strip(EDGES))
            if found[0] > 0:
                self.hits[raw] = found
        self.seen |= distinct
        if len(self.seen) > MEMO_WORDS:
            self.seen, self.hits = set(), {w: h for w, h in self.hits.items() if w in distinct}
        if distinct.isdisjoint(self.hits):
            return words, []
        return words, [i for i, w in enumerate(words) if w in self.hits]

    @staticmethod
    def quoted(words: list[str], i: int) -> bool:
        opened = any(w[0] in OPENING for w in words[max(0, i - CONTEXT_WORDS):i + 1])
        return opened and any(w.rstrip(".,;:!?")[-1:] in tuple(CLOSING) for w in words[i:i + CONTEXT_WORDS + 1])

    def window(self, words: list[str], i: int) -> list[str]:
        return [w.strip(EDGES) for w in words[max(0, i - CONTEXT_WORDS):i] + words[i + 1:i + 1 + CONTEXT_WORDS]]

    def features(self, text: str) -> list[float]:
        words, places = self.places(text)
        own = abuse = quoted = fuzzy = around = 0.0
        for i in places:
            weight, edits = self.hits[words[i]]
            weight *= EDITED if edits else 1.0
            score = sum(self.context.get(w, 0.0) for w in self.window(words, i))
            if self.quoted(words, i):
                quoted += weight
                weight *= QUOTED
            own = max(own, weight)
            abuse += weight
            fuzzy += edits
            around += score
        n = max(len(places), 1)
        return [math.log1p(abuse), own, abuse / math.sqrt(len(words) + 1), math.log1p(quoted), fuzzy / n, around / n]


def learns(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 != 0


def labelled(labels: DataFrame) -> DataFrame:
    return (labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & learns(F.col("doc_id")))
            .groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")))


def count_terms(sample: DataFrame) -> DataFrame:
    """(term, fold, toxic documents a, clean documents b) over words and beginnings."""
    distinct = F.array_distinct(F.transform(F.split(F.lower("t"), SPACES), lambda w: F.btrim(w, F.lit(EDGES))))
    words = F.filter(distinct, lambda w: F.length(w) >= 3)
    terms = F.array_distinct(F.concat(words, *[_beginnings(words, n) for n in PREFIXES]))
    exploded = sample.select("toxic", "fold", F.explode(terms).alias("term"))
    return exploded.groupBy("term", "fold").agg(F.sum("toxic").alias("a"), F.count_if(F.col("toxic") == 0).alias("b"))


def mine_lexicon(counted: DataFrame, n_toxic: int, n_clean: int, top: int = LEXICON_TERMS) -> dict[str, float]:
    """Terms with their log odds, the most telling first."""
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    odds = F.log(a / (n_toxic + 1) / (b / (n_clean + 1)))
    ranked = (counted.groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
              .filter(F.col("a") >= MIN_DOCUMENTS).withColumn("odds", odds).filter(F.col("odds") >= MIN_LOG_ODDS)
              .orderBy(F.desc(F.col("odds") * F.col("a")), "term").limit(top))
    return {r["term"]: float(r["odds"]) for r in ranked.select("term", "odds").collect()}


def without_copies(sample: DataFrame) -> DataFrame:
    """The sample with one document of most families of near copies: those that
    share a smallest five-word hash under one of three seeds teach once."""
    hashes = F.transform(F.filter(F.split(F.lower("t"), SPACES), lambda w: w != ""), lambda w: F.xxhash64(w))
    last = F.greatest(F.size("w") - 5, F.lit(0))

    def smallest(seed: int) -> Column:
        return F.array_min(F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.lit(seed), F.slice("w", i + 1, 5))))

    keyed = materialise(sample.select("doc_id", hashes.alias("w")).select("doc_id", *[smallest(k).alias(f"k{k}") for k in range(3)]), "toxic-keys")
    for k in range(3):
        first = keyed.groupBy(f"k{k}").agg(F.min("doc_id").alias("doc_id"))
        keyed = keyed.join(first, ["doc_id", f"k{k}"], "left_semi")
    return sample.join(F.broadcast(keyed.select("doc_id").distinct()), "doc_id", "left_semi")  # ids of the bounded sample


def _beginnings(words: Column, n: int) -> Column:
    longer = F.filter(words, lambda w: F.length(w) > n)
    return F.transform(longer, lambda w: F.concat(F.left(w, F.lit(n)), F.lit("*")))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights by Newton steps with a small ridge."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.diag([0.3] * (x.shape[1] - 1) + [1e-6])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + ridge @ w
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + ridge
        w -= np.linalg.solve(hessian, gradient)
    return w


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    known = labelled(labels)
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = known.filter("toxic = 1").orderBy(*order).limit(max_toxic).unionByName(known.filter("toxic = 0").orderBy(*order).limit(max_clean))
    # at most max_toxic + max_clean rows of two numbers
    sample = materialise(docs.select("doc_id", text_or_empty().alias("t")).join(F.broadcast(chosen), "doc_id"), "toxic-labelled")
    sample = materialise(without_copies(sample).withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")), "toxic-sample")
    sizes = {(r["toxic"], r["fold"]): r["n"] for r in sample.groupBy("toxic", "fold").agg(F.count("*").alias("n")).collect()}
    toxic, clean = [[sizes.get((kind, fold), 0) for fold in (0, 1)] for kind in (1, 0)]
    if not sum(toxic) or not sum(clean):
        return Model({}, {}, [], counts.get(1, 0) / max(1, sum(counts.values())))
    counted = materialise(count_terms(sample), "toxic-terms")
    lexicon = mine_lexicon(counted, sum(toxic), sum(clean))
    # what a document teaches must not judge it: each half is read with the other half's lexicon
    halves = [mine_lexicon(counted.filter(F.col("fold") == 1 - f), toxic[1 - f], clean[1 - f]) for f in (0, 1)]

    def around(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        readers = [Reader(half, {}) for half in halves]
        for batch in batches:
            rows = []
            for kind, fold, text in zip(batch["toxic"], batch["fold"], batch["t"], strict=True):
                words, places = readers[fold].places(text)
                rows += [(w, int(fold), int(kind)) for i in places for w in set(readers[fold].window(words, i)) | ({'"'} if readers[fold].quoted(words, i) else set())]
            yield pd.DataFrame(rows, columns=["w", "fold", "toxic"])

    near = sample.mapInPandas(around, "w string, fold int, toxic int").groupBy("w").agg(
        *[F.count_if((F.col("fold") == f) & (F.col("toxic") == t)).alias(f"n{f}{t}") for f in (0, 1) for t in (0, 1)], F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(CONTEXT_TERMS).collect()
    context = _context_weights({r["w"]: (r["n01"] + r["n11"], r["n00"] + r["n10"]) for r in near})
    contexts = [_context_weights({r["w"]: (r[f"n{1 - f}1"], r[f"n{1 - f}0"]) for r in near}) for f in (0, 1)]

    def numbers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        readers = [Reader(half, around) for half, around in zip(halves, contexts, strict=True)]
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"], "x": [readers[f].features(t) for f, t in zip(batch["fold"], batch["t"], strict=True)]})

    rows = sample.mapInPandas(numbers, "toxic int, x array<double>").collect()  # the bounded sample's numbers
    x, y = np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows], float)
    # each class weighs as much as it has of all labels
    weight = np.where(y == 1, counts[1] / sum(toxic), counts[0] / sum(clean))
    return Model(lexicon, context, list(_logistic(x, y, weight * len(y) / weight.sum())))


def _context_weights(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Log odds of hits with a word beside them against all hits, within two."""
    toxic, clean = (sum(n[k] for n in counts.values()) + 1 for k in (0, 1))
    share = toxic / (toxic + clean)
    odds = {w: math.log((a + 5 * share) / (b + 5 * (1 - share)) * (1 - share) / share) for w, (a, b) in counts.items()}
    return {w: max(-2.0, min(2.0, x)) for w, x in odds.items()}


def score(model: Model):
    """A column function: text column -> probability that it is toxic."""
    if model.constant is not None:
        return lambda text: F.lit(float(model.constant))

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader, w = Reader(model.lexicon, model.context), np.array(model.weights)
        for texts in batches:
            x = np.array([reader.features(t) for t in texts]).reshape(len(texts), len(w) - 1)
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30))))

    return scored


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per document."""
    judge = score(fit(docs, labels))
    return (docs.select("doc_id", text_or_empty().alias("t"))
            .select("doc_id", F.coalesce(~learns(F.col("doc_id")), F.lit(False)).alias("held_out"), judge(F.col("t")).alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` without those judged toxic; all columns stay."""
    judge = score(fit(docs.select("doc_id", "text"), labels))
    return docs.withColumn("__score", judge(text_or_empty())).filter("__score < 0.5").drop("__score")
