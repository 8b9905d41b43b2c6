"""Exact, line and near deduplication and decontamination against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import decontaminate, exact_dedup, line_dedup, near_dedup

EDGE = [(1, "a  b\tc"), (2, "a b c"), (3, None), (4, ""), (None, "a b c"), (5, "z"), (5, "z"), (6, "y " * 60_000), (7, "é ß")]


def exact_brute(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    out, seen = [], set()
    for i, t in norm:
        ids = [j for j, u in norm if u == t and j is not None]
        keep = min(ids) if ids else None
        kept = i == keep and (i, t) not in seen
        seen |= {(i, t)} if kept else set()
        out.append((i, keep, sum(u == t for _, u in norm), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [exact_dedup.content_hash, lambda c: F.unhex(F.lit("00"))], ids=["md5", "all collide"])
def test_exact_groups(frame, digest):
    got = [tuple(r) for r in exact_dedup.exact_groups(frame(EDGE), digest).collect()]
    assert sorted(got, key=str) == exact_brute(EDGE)


def test_exact_stage(frame):
    docs = frame(EDGE)
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5, 6, 7]
    assert exact_dedup.drop_exact_copies(frame([])).collect() == []


def line_brute(rows):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        lines = (t or "").split("\n")
        trimmed = [x.strip(line_dedup.BLANKS) for x in lines]
        gone = set()
        for p in range(len(lines) - 2):
            w = tuple(trimmed[p:p + 3])
            if any(w):
                gone |= {p, p + 1, p + 2} if w in seen else set()
                seen.add(w)
        out.append((i, "\n".join(x for p, x in enumerate(lines) if p not in gone), len(lines), len(gone), ",".join(map(str, sorted(gone)))))
    return sorted(out, key=str)


def test_line_dedup(frame):
    rnd = random.Random(5)
    rows = [(i, "\n".join(rnd.choice(["a", "b ", "c", "", "d"]) for _ in range(rnd.randint(0, 12)))) for i in range(60)] + [(None, "a\nb\nc\na"), (100, None), (101, "q\n" * 20_000)]
    got = [tuple(r) for r in line_dedup.dedup_lines(frame(rows)).collect()]
    assert sorted(got, key=str) == line_brute(rows)
    assert line_dedup.dedup_lines(frame([])).collect() == []


def levenshtein(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def test_banded_alignment():
    rnd = random.Random(3)
    for _ in range(600):
        a = [rnd.randint(0, 3) for _ in range(rnd.randint(0, 14))]
        b = list(a) if rnd.random() < 0.5 else [rnd.randint(0, 3) for _ in range(rnd.randint(0, 14))]
        for _ in range(rnd.randint(0, 4)):
            b.insert(rnd.randint(0, len(b)), rnd.randint(0, 3))
        most, true = rnd.randint(0, 12), levenshtein(a, b)
        assert near_dedup.edit_distance(np.array(a, np.uint64), np.array(b, np.uint64), most) == (true if true <= most else None)


def test_order_matters():
    a = np.arange(300, dtype=np.uint64)
    swapped = np.concatenate([a[150:], a[:150]])
    moved = len(set(near_dedup.order_min_hash(a)) & set(near_dedup.order_min_hash(swapped)))
    assert moved < near_dedup.SAMPLES
    assert not near_dedup.similar(a, swapped)


def test_near_classes_find_all_pairs(frame):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    rows, passage = [], " ".join(word() for _ in range(40))
    for family in range(25):
        base = [word() for _ in range(rnd.randint(60, 200))]
        for _ in range(rnd.randint(1, 4)):
            copy = list(base)
            for _ in range(len(base) // 50):
                copy[rnd.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + k, passage + " " + " ".join(word() for _ in range(80))) for k in range(20)]
    rows += [(900, None), (901, ""), (902, "one two"), (903, "One  two"), (None, "one two"), (904, rows[0][1].upper())]
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(frame(rows)).collect()}
    split = {i: (t or "").lower().split() for i, t in rows}
    parent = {i: i for i in split if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(parent)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            longer = max(len(split[a]), len(split[b]))
            if split[a] == split[b] or levenshtein(split[a], split[b]) <= 0.2 * longer + 1e-9:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {i: found[i] for i in ids} == {i: root(i) for i in ids}
    assert found[None] == 902


def test_near_classes_of_a_star(frame, monkeypatch):
    """Variants are similar to their base and not to one another; the base leads no bucket."""
    monkeypatch.setattr(near_dedup, "TILE", 16, raising=False)
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(100)]
    rows = []
    for i in range(90):
        at = rnd.randint(5, 95)
        rows.append((i, " ".join(base[:at] + [word() for _ in range(13)] + base[at:])))
    rows[40] = 40, " ".join(base)
    passage = [word() for _ in range(60)]
    rows += [(100 + i, " ".join(passage + [word() for _ in range(60)])) for i in range(40)]
    split = {i: t.split() for i, t in rows}
    assert all(levenshtein(split[40], split[i]) <= 0.2 * 113 for i in range(90))
    assert levenshtein(split[0], split[1]) > 0.2 * 113
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(frame(rows)).collect()}
    assert found == {i: 0 if i < 90 else i for i, _ in rows}


def test_word_counts_bound_the_edits():
    rnd = np.random.default_rng(9)
    texts = [rnd.integers(0, 2**63, 400, dtype=np.uint64)[rnd.integers(0, 400, n)] for n in (1, 5, 60, 128, 129, 300, 3000)]
    for t in list(texts):
        copy = t.copy()
        copy[rnd.integers(0, len(t), max(1, len(t) // 9))] = rnd.integers(0, 2**63)
        texts += [copy, np.append(t, t[:1 + len(t) // 8]), np.delete(t, slice(0, len(t) // 8))]
    texts.append(np.zeros(700, np.uint64))  # more of one word than a bag counts
    texts.append(np.zeros(600, np.uint64))
    bags = [np.frombuffer(near_dedup.word_bag(t), np.uint8) for t in texts]
    assert len({len(b) for b in bags}) > 3
    pairs = [(x, y) for x in range(len(texts)) for y in range(x) if min(len(texts[x]), len(texts[y])) >= 0.8 * max(len(texts[x]), len(texts[y]))]
    x, y = (np.array([p[i] for p in pairs]) for i in (0, 1))
    differs = np.array([abs(len(texts[a]) - len(texts[b])) for a, b in pairs])
    known = 0
    for a, b, least in zip(x, y, near_dedup.least_edits(bags, x, y, differs), strict=True):
        true = near_dedup.edit_distance(texts[a], texts[b], int(least) - 1) if least else None
        assert true is None
        known += least > 0
    assert known > 20


def test_near_stage(frame):
    docs = frame([(1, "a b c d e f g h i j"), (2, "a b c d e f g h i j"), (3, None)])
    kept = near_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
    assert near_dedup.near_classes(frame([])).collect() == []


def test_near_stage_with_repeated_ids(frame):
    """Two texts under one id: only the one that is a copy of another document goes."""
    rnd = random.Random(14)
    a, b = ([f"w{rnd.randrange(10**6)}" for _ in range(80)] for _ in range(2))
    near = " ".join(a[:40] + ["other"] + a[41:])
    docs = frame([(1, " ".join(a)), (1, " ".join(b)), (0, near), (2, "q r s"), (None, "q r s")])
    kept = near_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(0, near), (1, " ".join(b)), (2, "q r s"), (None, "q r s")], key=str)


def overlap_brute(docs, items, least=decontaminate.MIN_OVERLAP):
    split = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    out = set()
    for i, t in docs:
        d = split(t)
        for j, u in items:
            w = split(u)
            for shift in range(-len(w), len(d) + 1):
                same = sum(0 <= shift + k < len(d) and d[shift + k] == x for k, x in enumerate(w))
                if w and same >= least * len(w):
                    out.add((i, j))
    return out


@pytest.mark.parametrize("broadcast", [decontaminate.BROADCAST_WINDOWS, 0], ids=["broadcast", "shuffle"])
def test_decontamination(spark, frame, broadcast):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    items = [(k, " ".join(word() for _ in range(rnd.randint(12, 40)))) for k in range(12)] + [(50, "alpha beta gamma"), (51, None), (52, "")]
    docs = []
    for i in range(60):
        text = [word() for _ in range(rnd.randint(0, 80))]
        if i % 3 == 0:
            item = items[i % 12][1].split()
            for _ in range(i % 4):
                item[rnd.randrange(len(item))] = word()
            at = rnd.randint(0, len(text))
            text[at:at] = item
        docs.append((i, " ".join(text)))
    docs += [(None, "x " + items[3][1]), (77, None), (78, "so Alpha, beta; gamma!"), (79, items[0][1].upper()), (79, items[0][1].upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.overlaps(frame(docs), bench, broadcast_windows=broadcast).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == overlap_brute(docs, items)
    assert len(rows) == len({(r["doc_id"], r["item_id"]) for r in rows})
    docs_frame = frame(docs)
    kept = decontaminate.drop_contaminated(docs_frame, bench)
    bad = {i for i, _ in overlap_brute(docs, items)}
    assert kept.columns == docs_frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _ in docs if i not in bad)
    assert decontaminate.overlaps(frame([]), bench).collect() == []
    assert decontaminate.overlaps(frame(docs), bench.limit(0)).collect() == []


@pytest.mark.parametrize("broadcast", [decontaminate.BROADCAST_WINDOWS, 0], ids=["broadcast", "shuffle"])
def test_decontamination_over_alignments(spark, frame, broadcast):
    """A word inserted or dropped inside an item, and one other word in a short item."""
    rnd = random.Random(13)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    items = [(n, [word() for _ in range(n)]) for n in [*range(3, 11), 39]]
    around = lambda words: " ".join([word() for _ in range(9)] + words + [word() for _ in range(9)])
    long = items[-1][1]
    docs, want = [(0, around(long[:20] + ["new"] + long[20:])), (1, around(long[:19] + long[20:])), (2, around(long[:20])), (None, around(long[:20])), (None, around(long[20:]))], {(0, 39), (1, 39)}
    for n, words in items[:-1]:
        for at in range(n):
            docs.append((len(docs), around(words[:at] + ["other"] + words[at + 1:])))
            want.add((docs[-1][0], n))
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items], "item_id long, text string")
    rows = decontaminate.overlaps(frame(docs), bench, broadcast_windows=broadcast).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want
    assert {r["doc_id"]: r["n_equal"] for r in rows if r["item_id"] == 39} == {0: 39, 1: 38}


def test_clean_rows_stay_where_their_id_is_contaminated(frame, spark):
    item = " ".join(f"w{i}" for i in range(30))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(None, f"x {item} y"), (None, "clean text of a row"), (5, item), (5, "another clean text"), (5, item), (6, "also clean")]
    kept = decontaminate.drop_contaminated(frame(rows), bench).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == [("5", "another clean text"), ("6", "also clean"), ("None", "clean text of a row")]
