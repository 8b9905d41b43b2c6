"""Information-theoretic sanitisation of personal data.

Base spans are the e-mail addresses, IP addresses, card and phone numbers of a
text; their values are the protected entities.  A term that stands in the text of
an entity may give it away even when the entity is masked, so co-occurrence over
the whole corpus measures how much each term reveals: with document counts
n(e), n(t), n(e, t) of N documents,

    disclosure(t, e) = log2(n(e, t) N / (n(e) n(t))) / log2(N / n(e)),

the share of the entity's information that the term carries: 1 where the term
only occurs beside the entity.  Terms at or above `remove_at` are removed, those
at or above `generalise_at` are generalised, wherever they stand in a text with
that entity; both need `support` documents.  These are the added spans.

An entity of fewer documents has no such pair: it is left out before terms are
paired with entities.  Counts go (entity, term) and (term) over all documents,
combined per task before each shuffle; flagged pairs are handed back by joins that Spark can
split, so an address that a third of all documents carry is no hot task.

Defined results: a null text counts as empty and has no span; rows that repeat
id and text each get their spans, and are one document where pairs are counted; null ids
stay null; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from shelfspark.llm.common import SPACES, materialise, text_or_empty

#: The kinds in their listed order; the last two are added by the method.
KINDS = ("email", "ip", "card", "phone", "generalise", "remove")
SUPPORT = 3
GENERALISE_AT, REMOVE_AT = 0.6, 0.9
#: Characters cut from both ends of a term.
EDGES = ".,;:!?\"'()[]{}|"

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\x20\x09-\x0D]+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """All matches of local@domain from the @ signs outwards: linear in the text."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def find_spans(text: str) -> list[tuple[int, int, int]]:
    """Base spans as (kind, start, end) by kind, then start."""
    spans = [(0, s, e) for s, e in _emails(text)]
    spans += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37:  # 19 digits and 18 separators
            digits = re.sub("[^0-9]", "", m[0])
            if 16 <= len(digits) <= 19 and _luhn(digits):
                spans.append((2, *m.span()))
    spans += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return spans


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def _lower_ascii(word: str) -> str:
    return word.encode().lower().decode()


def entities(text: str, spans: list[tuple[int, int, int]]) -> list[str]:
    """The entities of a text, each once."""
    return list(dict.fromkeys(hashlib.md5(f"{KINDS[k]}:{_lower_ascii(text[s:e])}".encode()).hexdigest() for k, s, e in spans))


def term_places(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    """(term, start, end) for all words of a text outside its spans."""
    covered = sorted((s, e) for _, s, e in spans)
    cover_starts = [s for s, _ in covered]
    reach, most = [], 0  # furthest end of the spans so far, as spans of two kinds may overlap
    for _, e in covered:
        most = max(most, e)
        reach.append(most)
    out = []
    for m in _TERM.finditer(text):
        word, a = m[0], m.start()
        a += len(word) - len(word.lstrip(EDGES))
        word = word.strip(EDGES)
        k = bisect_left(cover_starts, a + len(word))
        if any(c.isalpha() for c in word) and not (k and reach[k - 1] > a):
            out.append((_lower_ascii(word), a, a + len(word)))
    return out


_PLACES = "array<struct<term:string,start:int,end:int>>"


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, doc_key, n_*, base_sha256, base, entities, places): base spans, the
    entities, and the terms of the texts that have any."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", text_or_empty()).alias("doc_key"), text_or_empty().alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["t"].to_pylist()
            spans = [find_spans(t) for t in texts]
            base = [joined(s) for s in spans]
            held = [entities(t, s) for t, s in zip(texts, spans, strict=True)]
            found = [term_places(t, s) if s else [] for t, s in zip(texts, spans, strict=True)]
            columns = [pa.array([x[i] for f in found for x in f], k) for i, k in enumerate((pa.string(), pa.int32(), pa.int32()))]
            ends = pa.array([0, *accumulate(map(len, found))], pa.int32())
            places = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(columns, ["term", "start", "end"]))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["doc_key"], *[pa.array([sum(x[0] == k for x in s) for s in spans], pa.int64()) for k in range(4)],
                 pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string()), pa.array(base, pa.string()),
                 pa.array(held, pa.list_(pa.string())), places],
                names=["doc_id", "doc_key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "entities", "places"])

    return source.mapInArrow(run, f"doc_id long, doc_key long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, "
                                  f"entities array<string>, places {_PLACES}")


def document_terms(text: Column) -> Column:
    """The terms of a text, as `term_places` spells them."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.transform(F.split(low, SPACES), lambda w: F.btrim(w, F.lit(EDGES))))


def supported_entities(scanned: DataFrame, n_docs: int, support: int = SUPPORT) -> DataFrame:
    """(doc_key, entity, n_e) of the entities of at least `support` documents, but not of all."""
    held = scanned.select("doc_key", F.explode("entities").alias("entity")).distinct()
    n_e = held.groupBy("entity").agg(F.count("*").alias("n_e")).filter((F.col("n_e") >= support) & (F.col("n_e") < n_docs))
    return held.join(n_e, "entity").select("doc_key", "entity", "n_e")


def revealing_terms(docs: DataFrame, held: DataFrame, n_docs: int, support: int = SUPPORT, generalise_at: float = GENERALISE_AT,
                    remove_at: float = REMOVE_AT) -> DataFrame:
    """(entity, term, disclosure, kind) of the pairs over a threshold; `held` has
    (doc_key, entities ARRAY<STRUCT<entity, n_e>>, places), one row per document."""
    terms = F.array_distinct(F.transform("places", lambda p: p["term"]))
    each = held.select("entities", F.explode(terms).alias("term")).select("term", F.inline("entities"))
    pairs = materialise(each.groupBy("entity", "n_e", "term").agg(F.count("*").alias("n_et")).filter(F.col("n_et") >= support), "pii-pairs")
    # all terms are counted, combined per task; the pairs meet the counts alone
    n_t = docs.select(F.explode(document_terms(text_or_empty())).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    total = F.lit(float(max(n_docs, 1)))
    information = F.log2(total / F.col("n_e"))
    disclosure = F.log2(F.col("n_et") * total / (F.col("n_e") * F.greatest("n_t", "n_et"))) / information
    return (pairs.join(n_t, "term").withColumn("disclosure", disclosure).filter(F.col("disclosure") >= generalise_at)
            .select("entity", "term", "disclosure", F.when(F.col("disclosure") >= remove_at, F.lit(5)).otherwise(F.lit(4)).alias("kind")))


def sanitise(docs: DataFrame) -> DataFrame:
    """(doc_id, doc_key, n_email, n_ip, n_card, n_phone, base_sha256, spans), one
    row per document; `spans` has the base spans and the terms to change."""
    scanned = materialise(scan(docs), "pii-scan")
    n_docs = scanned.count()
    of_docs = supported_entities(scanned, n_docs).groupBy("doc_key").agg(F.collect_list(F.struct("entity", "n_e")).alias("entities"))
    places = scanned.filter(F.size("entities") > 0).select("doc_key", "places")
    held = materialise(places.join(of_docs, "doc_key").dropDuplicates(["doc_key"]), "pii-held")
    flagged = materialise(revealing_terms(docs, held, n_docs), "pii-flagged")
    # a place beside several entities takes the strongest action
    wanted = held.select("doc_key", F.inline("entities")).join(flagged, "entity").groupBy("doc_key", "term").agg(F.max("kind").alias("kind"))
    found = held.select("doc_key", F.inline("places")).join(wanted, ["doc_key", "term"])
    added = found.groupBy("doc_key").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("added"))
    names = F.array(*[F.lit(k) for k in KINDS])
    added = added.select(
        "doc_key", F.array_join(F.transform("added", lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",").alias("added"))
    return scanned.drop("entities", "places").join(added, "doc_key", "left").select(
        "doc_id", "doc_key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256",
        F.when(F.col("added").isNull(), F.col("base")).otherwise(F.concat_ws(",", "base", "added")).alias("spans"))


def redact(docs: DataFrame, sanitised: DataFrame) -> DataFrame:
    """(doc_id, text) with base spans replaced by <kind>, generalised terms by
    <term> and removed terms by nothing."""

    @F.pandas_udf(StringType())
    def apply(texts, spans):
        import pandas as pd

        out = []
        for text, listed in zip(texts, spans, strict=True):
            places = sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in listed.split(",") if x))
            parts, at = [], 0
            for s, e, k in places:
                if s >= at:
                    parts += [text[at:s], {"generalise": "<term>", "remove": ""}.get(k, f"<{k}>")]
                at = max(at, e)
            out.append("".join(parts) + text[at:])
        return pd.Series(out, dtype=object)

    changed = sanitised.select("doc_key", "spans").filter("spans <> ''").dropDuplicates(["doc_key"])
    keyed = docs.select("doc_id", F.xxhash64("doc_id", text_or_empty()).alias("doc_key"), text_or_empty().alias("t"))
    return keyed.join(changed, "doc_key", "left").select("doc_id", apply("t", F.coalesce("spans", F.lit(""))).alias("text"))
