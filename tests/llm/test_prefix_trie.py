"""The prefix trie against one built turn by turn."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from shelfspark.llm import prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, role, digest, text))
    plain = {c: [(r[2], r[4]) for r in sorted(t)] for c, t in own.items()}
    rebuilt = {}
    for c, t in plain.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = plain.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + t[h:]
    members = defaultdict(list)
    for c, t in rebuilt.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = Counter()
    below = {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        kids = [below[k] for k in children[node]]
        below[node] = (sum(k[0] for k in kids) or 1, sum(k[1] for k in kids) + (len(members[node]) - 1) * words)
    for node, own_ in members.items():
        ends = ",".join(str(c) for c in sorted(own_) if len(rebuilt[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out[min(own_), len(node), parent, len(own_), len(children[node]), *below[node], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def make(spark, rows):
    return spark.createDataFrame([(c, t, r, x, 1, "z", 3) for c, t, r, x in rows], "conv_id long, turn long, role string, text string, depth int, digest string, d1 int")


def test_trie_like_brute_force(spark):
    rnd = random.Random(7)
    rows = []
    for c in [*range(140), 205, 206, 209, -7, -41]:
        opening = rnd.choice([["hi there"], ["hi there", "how do you do"], ["a b c", "d"], [f"own {c}"]])
        texts = opening + [rnd.choice(["yes", "no", f"w{rnd.randrange(90)} x"]) for _ in range(rnd.randrange(5))]
        rows += [(c, i, rnd.choice(["user", "assistant"]) if rnd.random() < 0.1 else ["user", "assistant"][i % 2], t) for i, t in enumerate(texts)]
    rows += [(400, 0, "user", "one"), (401, 0, "user", "two"), (402, None, None, None), (402, None, None, None), (402, 3, "u", "x " * 30_000), (None, 0, "user", "lost")]
    rows += [(500, i, "user", f"turn {i}") for i in range(60)] + [(501 + k, i, "user", f"turn {i}") for k in range(9) for i in range(60)]
    got = Counter(tuple(r[c] for c in COLUMNS) for r in prefix_trie.trie(make(spark, rows)).collect())
    assert got == brute(rows)


def test_many_equal_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    rows = [(c, i, "user", f"turn {i}") for c in range(100, 160) for i in range(3)]
    got = Counter(tuple(r[c] for c in COLUMNS) for r in prefix_trie.trie(make(spark, rows)).collect())
    assert got == brute(rows)


def test_equal_turns_follow_role_then_text(spark):
    rnd = random.Random(5)
    rows = [(c, rnd.choice([None, 0, 1]), rnd.choice(["user", None]), rnd.choice(["a", "b c", "", None, "d e f", "é"])) for c in range(60) for _ in range(rnd.randrange(2, 6))]
    order = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    got = Counter(tuple(r[c] for c in COLUMNS) for r in prefix_trie.trie(make(spark, rows)).collect())
    assert got == brute([(c, i, r, t) for i, (c, _, r, t) in enumerate(order)])


def test_no_conversations(spark):
    assert prefix_trie.trie(make(spark, [])).collect() == []


@pytest.mark.parametrize("width", [12, 6])
def test_sketch_never_takes_a_shared_digest_for_a_single(spark, width):
    rnd = random.Random(8)
    digests = [(rnd.randrange(-1 << 63, 1 << 63), rnd.randrange(-1 << 63, 1 << 63)) for _ in range(300)]
    rows = digests + digests[:100]
    once = prefix_trie.singles(spark.createDataFrame(rows, "d1 long, d2 long").repartition(5), width)
    d = np.array(digests, np.int64)
    at = prefix_trie.cells(d[:, 0], d[:, 1], width)
    proven = ((once[at >> 6] >> (at & 63)) & 1).any(axis=0)
    assert not proven[:100].any()
    assert width < 12 or proven[100:].mean() > 0.95
