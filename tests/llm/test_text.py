"""Chat formatting, BPE, secrets, personal data, language model, toxicity."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from shelfspark.llm import bpe, chat, language_model, pii, secrets, toxicity

PIECES = ["[", "<", "\\", "/", "s>", "INST]", "SYS>>", "ROLE ", "]", "</s>", "[INST]", "<<SYS>>", "a", " ", "[/ROLE]", "\n"]


def test_grammar_round_trip():
    rnd = random.Random(1)
    for _ in range(8000):
        turns = [(rnd.choice(["user", "assistant", "system", "tool", "a]b%", ""]), "".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 7)))) for _ in range(rnd.randint(0, 4))]
        assert chat.parse("".join(chat.render(*t)[0] for t in turns)) == turns
    assert not chat.render("user", "plain [text]")[3]
    assert chat.render("user", chat.CONFLICT)[3]


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "yes </s>"), (1, 0, "user", "hi"), (2, 0, None, None), (2, 0, None, None), (None, 3, "system", "x" * 70_000), (1, None, "tool", "[ROLE z]")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(chat.with_conflict(table))).collect()}
    rows += [(-1, 0, "user", chat.CONFLICT), (-1, 1, "assistant", chat.CONFLICT)]
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        assert got[conv]["n_turns"] == len(own)
        assert got[conv]["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert len(got) == 4
    assert chat.read_back(chat.format_turns(table.limit(0))).collect() == []


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_str(bpe.vocabulary())


def test_bpe_like_library(frame, library):
    rnd = random.Random(2)
    alphabet = "abcdeé'sİΣς ßüñ12½²<|>\n\t\x1c\x85\xa0 日本éÅﬁ😀'll.,$"
    rows = [(i, "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60)))) for i in range(400)]
    rows += [(900, None), (901, ""), (902, "x" * 3000), (903, "a<|startoftext|>b <|endoftext|>"), (None, "abc " * 30_000), (904, "abc"), (904, "abc")]
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(bpe.encode(frame(rows), lexicon_words=300)).collect())
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        data = b"".join(x.to_bytes(4, "little") for x in ids)
        decoded = library.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
    assert got == want
    assert bpe.encode(frame([])).collect() == []


def test_lexicon_is_minimal():
    merges = bpe.Merges(bpe.vocabulary())
    words = {a + b for a in ("walk", "talk", "balk") for b in ("", "s", "ed", "ing")}
    lexicon = bpe.Lexicon(bpe.compile_lexicon({w: merges.merge(w) for w in words}))
    assert all(lexicon.get(w) == merges.merge(w) for w in words)
    assert lexicon.get("wal") is None and lexicon.get("walked ") is None and lexicon.get("zebra") is None
    # as many states as the words' prefixes have different sets of endings
    prefixes = {w[:n] for w in words for n in range(len(w) + 1)}
    assert len(lexicon.final) == len({frozenset(w[len(p):] for w in words if w.startswith(p)) for p in prefixes})


def secret_spans(text):
    spans = []
    for kind, (pattern, group, least) in secrets.KINDS.items():
        spans += [(m.start(), list(secrets.KINDS).index(kind), kind, m.end(), m[group]) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return spans


def test_secrets(spark):
    key, shared = "AKIA" + "Z9" * 9, "f3" * 20
    texts = ["é token = \"" + shared + "\" x", f"api-key no, API_KEY:'{key}'", "token=ab secret=short12 passwd : longer_1", None, "", "😀 " + "0a" * 15 + " and Zz09" * 6,
             "x" * 50_000 + " password=hunter22", "see " + "Q7w8" * 6 + " there"]
    rows = [(i, t, f"s{i}") for i, t in enumerate(texts)] + [(20 + k, f"secret: {shared}", f"o{k}") for k in range(3)] + [(30, "see " + "Q7w8" * 6 + " there", None), (None, "token:abcdef", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in secrets.scan_secrets(docs).collect()}
    owners = defaultdict(set)
    found = {}
    for i, t, owner in rows:
        spans = secret_spans(t or "")
        base = [s for s in spans if s[2] != "bare"]
        bare = [s for s in spans if s[2] == "bare" and re.search("[0-9]", s[4]) and re.search("[A-Za-z]", s[4]) and not any(b[0] < s[3] and s[0] < b[3] for b in base)]
        found[i] = base, bare
        for s in base + bare:
            owners[s[4]].add(owner)
    for i, (base, bare) in found.items():
        own = [s for s in bare if len(owners[s[4]]) <= secrets.MAX_OWNERS]
        text = lambda xs: ",".join(f"{k}:{a}:{e}" for a, _, k, e, _ in sorted(xs))
        assert got[i]["spans"] == text(base + own)
        assert got[i]["base_sha256"] == hashlib.sha256(text(base).encode()).hexdigest()
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) == tuple(sum(s[2] == k for s in base) for k in secrets.BASE)
        assert got[i]["n_example"] == sum(len(owners[s[4]]) > secrets.MAX_OWNERS for s in base)
    assert secrets.scan_secrets(docs.limit(0)).collect() == []


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def pii_brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])

    def luhn(s):
        return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(s))) % 10 == 0

    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]


def test_pii_base_spans():
    rnd = random.Random(4)
    for _ in range(6000):
        text = "".join(rnd.choice(["a", "@", ".", "-", "é", " ", "1", "25", "4111 1111 1111 1111", "+", "(", ")", "x.org", "256", "\n"]) for _ in range(rnd.randint(0, 14)))
        assert pii.find_spans(text) == pii_brute(text)
    assert pii.find_spans("a" * 300_000 + "9" * 300_000) == []


def test_pii_terms(spark, frame):
    rows = [(i, f"call Zorblax now at bob@x.org please the {i}") for i in range(5)] + [(10 + i, "the please now call text") for i in range(40)] + [(90, None), (91, ""), (None, "me@y.org")]
    docs = frame(rows)
    result = pii.sanitise(docs)
    got = {r["doc_id"]: r for r in result.collect()}
    assert len(got) == len(rows)
    for i, t in rows[:5]:
        at = t.index("Zorblax")
        assert f"remove:{at}:{at + 7}" in got[i]["spans"].split(",")
        assert got[i]["spans"].startswith("email:")
        assert got[i]["base_sha256"] == hashlib.sha256(pii.joined(pii_brute(t)).encode()).hexdigest()
    assert all(got[i]["spans"] == "" for i, _ in rows[5:47])
    assert got[None]["n_email"] == 1
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs, result).collect()}
    assert "Zorblax" not in clean[0] and "<email>" in clean[0] and clean[10] == "the please now call text"
    assert pii.sanitise(frame([])).collect() == []


def test_pii_terms_far_from_the_entity(spark, frame):
    far = " ".join(f"the now w{i}" for i in range(40))
    rows = [(i, f"Zorblax, {far} {i} bob@x.org {far} Quuxen") for i in range(4)] + [(10 + i, far) for i in range(40)] + [(4, f"{far} Zorblax")]
    got = {r["doc_id"]: r["spans"] for r in pii.sanitise(frame(rows)).collect()}
    for i, t in rows[:4]:
        at = t.index("Quuxen")
        assert got[i] == f"email:{t.index('bob')}:{t.index('bob') + 9},remove:0:7,remove:{at}:{at + 6}"
    assert all(got[i] == "" for i in [*range(10, 50), 4])


def katz(rows, lm=language_model):
    seqs = [(i, (t or "").encode().lower().split()) for i, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    start, end = ("start",), ("end",)
    uni, bi, hist, follow = Counter(), Counter(), Counter(), defaultdict(list)
    for (_, s), h in zip(seqs, held, strict=True):
        if not h:
            uni.update([*s, end])
            for a, b in zip([start, *s], [*s, end], strict=True):
                bi[a, b] += 1
                hist[a] += 1
    n, v = sum(uni.values()), len(uni)
    du, db = lm.discounts(Counter(uni.values())), lm.discounts(Counter(bi.values()))
    kept = lambda c, d: (d[c - 1] if c <= lm.KATZ else 1) * c
    left = n - sum(kept(c, du) for c in uni.values())
    total, unknown = (n, left / n) if left > 1e-9 else (n + 1, 1 / (n + 1))
    p1 = lambda w: kept(uni[w], du) / total if uni[w] else unknown
    for (a, b), c in bi.items():
        follow[a].append((b, c))
    hot = {w for w, c in uni.items() if w != end and c >= max(lm.HOT_LEAST, n // lm.HOT_SHARE)} | {start}
    mass = lambda h: hist[h] + (h in hot or all(c > lm.KATZ for _, c in follow[h]))
    alpha = {h: (1 - sum(kept(c, db) for _, c in follow[h]) / mass(h)) / (1 - sum(p1(w) for w, _ in follow[h])) for h in hist}

    def p2(h, w):
        c = bi.get((h, w), 0)
        return kept(c, db) / mass(h) if c else alpha.get(h, 1.0) * p1(w)

    for h in list(alpha)[:30]:
        assert sum(p2(h, w) for w in uni) + alpha[h] * unknown == pytest.approx(1)
    out = []
    for (i, s), h in zip(seqs, held, strict=True):
        known = sum(uni[w] > 0 for w in [*s, end])
        base = sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in [*s, end])
        out.append((i, h, len(s) + 1, known, n, base, sum(math.log10(p2(a, b)) for a, b in zip([start, *s], [*s, end], strict=True))))
    return out


def test_language_model(spark, frame, monkeypatch):
    for name, value in {"BLOCK_TOKENS": 300, "PART_TOKENS": 700, "HEAD_WORDS": 40, "HOT_LEAST": 30, "HOT_SHARE": 100}.items():
        monkeypatch.setattr(language_model, name, value)
    rnd = random.Random(6)
    words = [f"w{i}É" for i in range(300)]
    rows = [(i, " ".join(rnd.choices(words, [1 / (k + 1) for k in range(300)], k=rnd.randint(0, 40)))) for i in range(150)]
    rows += [(500, None), (501, ""), (None, "w0É never"), (502, "w1É " * 900), (503, "A a\x0bA"), (503, "A a\x0bA")]
    got = sorted(map(tuple, language_model.score(frame(rows)).collect()), key=str)
    for g, w in zip(got, sorted(katz(rows), key=str), strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)
    assert language_model.score(frame([])).collect() == []


def test_automaton_matches_like_brute_force():
    rnd = random.Random(8)
    terms = {"".join(rnd.choice("abc") for _ in range(rnd.randint(3, 8))): 5.0 for _ in range(40)}
    lexicon = toxicity.Lexicon(terms)

    def near(word):
        cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
        made = {a + b[1:] for a, b in cuts if b} | {a + c + b for a, b in cuts for c in "abc"} | {a + c + b[1:] for a, b in cuts if b for c in "abc"}
        made |= {a + b[1] + b[0] + b[2:] for a, b in cuts if len(b) > 1}
        return any(t in made for t in terms if len(t) >= 5)

    for _ in range(4000):
        word = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 9)))
        want = (5.0, 0) if word in terms else ((5.0, 1) if near(word) else (0.0, 0))
        assert lexicon.match(word) == want


def test_toxicity_learns(spark, frame):
    rnd = random.Random(9)
    plain = ["stone", "river", "cloud", "table", "green", "walks", "under", "seven"]
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 1
        text = [rnd.choice(plain) + rnd.choice("aeiou") for _ in range(30)]
        for _ in range(4 if bad else 0):
            text.insert(rnd.randint(0, len(text)), rnd.choice(["grumblax", "snorkfel", "zubbwort"]))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(bad)))
    extra = [(1000, None), (1001, ""), (1002, "you grumblxa and snorkfell"), (None, "river river"), (1003, "word " * 40_000)]
    marks = spark.createDataFrame(labels + [(5000, 0, 1), (2, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    docs = frame(rows + extra)
    got = {r["doc_id"]: r for r in toxicity.scores(docs, marks).collect()}
    assert len(got) == len(rows) + len(extra)
    assert all(r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    right = [got[i]["predicted"] == int(i % 5 == 1) for i in range(400) if got[i]["held_out"]]
    assert sum(right) >= 0.95 * len(right)
    assert got[1002]["predicted"] == 1 and not any(got[i]["predicted"] for i in (1000, 1001, None, 1003))
    kept = toxicity.drop_toxic(docs, marks)
    assert kept.columns == docs.columns and 1002 not in {r["doc_id"] for r in kept.collect()}
    assert {r["score"] for r in toxicity.scores(docs, marks.limit(0)).collect()} == {0.0}
    assert toxicity.scores(frame([]), marks).collect() == []


def test_quotation_counts_less():
    reader = toxicity.Reader({"grumblax": 6.0}, {})
    said, meant = reader.features('he said "grumblax" aloud'), reader.features("he is grumblax aloud")
    assert said[0] < meant[0] and said[3] > meant[3] == 0


def test_terms_and_words_of_any_length():
    term = "".join(chr(97 + i * i % 23) for i in range(3000))
    lexicon = toxicity.Lexicon({term: 5.0, "offal": 5.0})
    for word in (term[:1500] + term[1501:], term[:40] + "z" + term[40:], term[:2990] + "zz"[:1] + term[2991:]):
        assert lexicon.match(word) == (5.0, 1)
    assert lexicon.match(term) == (5.0, 0) and lexicon.match("x" * 5000) == (0.0, 0) and lexicon.match("ofal") == (5.0, 1)


def test_spans_of_a_text_with_many_secrets(spark):
    """Blocks of matches give the places that one pass gives."""
    from pyspark.sql import functions as F

    for n in (1, 255, 256, 257, 20_000):
        text = "x".join("token=abcdef%d " % (i % 7) * (i % 5 != 3) + "pw token=a " for i in range(n))
        want = [m.span() for m in re.finditer(r"token=([A-Za-z0-9+/_.=-]+)", text) if len(m[1]) >= 6]
        row = spark.createDataFrame([(text,)], "t string").select(secrets.find_spans(F.col("t"), "assign").alias("s")).first()
        assert [(s.start, s.end) for s in row.s] == want
