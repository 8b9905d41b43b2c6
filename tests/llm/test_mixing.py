"""Mixing sources against a replay of the rules."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

from shelfspark.llm import mixing


def shares(sizes, budget):
    """Targets by resharing the excess until no source is above twice its size."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    capped = set()
    while True:
        left = budget - sum(2 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        total = sum(weight[s] for s in free)
        above = {s for s in free if left * weight[s] / total >= 2 * sizes[s]}
        if not above:
            return {s: 2 * sizes[s] if s in capped else left * weight[s] / total for s in names}
        capped |= above


def replay(rows, quality):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by_source = defaultdict(list)
    for i, s, t in rows:
        digest = hashlib.md5((t or "").encode()).hexdigest()
        u = (int(hashlib.md5(f"mix-1:{'' if i is None else i}:{digest}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        by_source[s].append((-math.log(u) / (1 + 3 * quality.get(i, 0.5)), i is not None, i or 0, digest, i, size(t)))
    sizes = {s: sum(r[-1] for r in own) for s, own in by_source.items()}
    targets = shares(sizes, 1.5 * sum(sizes.values()))
    out = []
    for s, own in by_source.items():
        epochs = int(targets[s] // sizes[s]) if sizes[s] else 0
        left = round(targets[s]) - epochs * sizes[s]
        for *_, i, n in sorted(own):
            part = max(0, min(n, left))
            left -= part
            out.append((i, n, sizes[s], round(targets[s], 6), epochs * n + part))
    return Counter(out)


def make(spark, rows):
    return spark.createDataFrame([(i, s, t, "x", 1.0, 2) for i, s, t in rows], "doc_id long, source string, text string, key string, size double, target int")


def test_mix_like_replay(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["a", "a", "a", "Z", "é", "big", None]), " ".join("w" * rnd.randint(1, 3) for _ in range(rnd.randint(0, 30)))) for i in range(400)]
    rows += [(900, "big", "long " * 40_000), (901, "empty", ""), (902, "empty", None), (903, "one", "a  b\tc\n"), (None, None, "x y"), (None, "a", None)]
    rows += [(5, "a", "same text here")] * 40 + [(7, None, "q")]
    labels = spark.createDataFrame([(i, rnd.choice([0, 1, None]), 0) for i in range(0, 500, 2)] + [(5, 1, 0), (5, 0, 1)], "doc_id long, quality int, toxic int")
    known = defaultdict(list)
    for r in labels.collect():
        known[r.doc_id] += [r.quality] if r.quality is not None else []
    want = replay(rows, {i: sum(q) / len(q) for i, q in known.items() if q})
    mixture = mixing.mix(make(spark, rows), labels)
    got = Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in mixture.collect())
    assert got == want
    by_source = Counter()
    for r in mixture.collect():
        assert r.taken <= 2 * r["size"]
        by_source[r.source, r.target] += r.taken
    assert all(abs(n - target) <= 0.5 for (_, target), n in by_source.items())
    words = Counter()
    for r in mixing.mixed_texts(make(spark, rows), mixture).collect():
        words[r.source] += len(r.text.split())
    assert +words == Counter({s: n for (s, _), n in by_source.items() if n})


def test_good_documents_are_taken_more_often(spark):
    rows = [(i, "a", "w " * 10) for i in range(2000)] + [(5000, "b", "w " * 1)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(2000)], "doc_id long, quality int, toxic int")
    taken = Counter()
    for r in mixing.mix(make(spark, rows), labels).where("source_size > 1").collect():
        taken[r.doc_id % 2] += r.taken - r["size"]  # one epoch is complete
    assert taken[1] > 1.5 * taken[0] > 0


def test_no_documents(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string, text string"), labels).collect() == []
    alone = mixing.mix(make(spark, [(1, None, None)]), labels).collect()
    assert [(r.target, r.taken) for r in alone] == [(0.0, 0)]
