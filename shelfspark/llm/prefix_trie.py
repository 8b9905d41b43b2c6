"""Conversation prefix trie, with count-min screening of prefix digests.

A conversation is rebuilt from the first turns of its base conversation and its
own later turns.  Every prefix of a rebuilt conversation has a 128-bit digest:
the exclusive or of hashes of (depth, turn), so that the digests of a
conversation are running totals, which any number of tasks can add up.

Each task counts the digests of its rows in a count-min sketch of small
saturating counters; Spark merges the sketches word by word.  Where the estimate
of a digest is one, no other conversation has that prefix: its node is complete
as it stands and is emitted from its row.  Only prefixes that may be shared go
through the exact grouping.  The sketch has at least four counters a row and
hash function up to ``WIDEST``; beyond that more prefixes pass as possibly
shared, and the grouping, which is exact, settles them.

Subtree sums need no walk over levels.  A leaf is one childless node, owned by
its smallest member: a node has as many leaves as members that own one.  What a
node saves is owned by its smallest member as well; added up along that
conversation from its end, it gives each of its prefixes what it holds below.

Defined results: rows without conv_id belong to no conversation; null role and
text are empty; null turns come first, equal turns are ordered by role, then by
text; a conversation that is left without turns is a member
of the root; without conversations there are no nodes; repeated rows are turns of
their own; further columns are ignored.  A conversation or a node may hold any
share of the rows; the digest of the members that end at one node is sequential,
so that the last of its two steps streams pieces of 4,096 ids through one task
per node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import materialise, text_or_empty
from shelfspark.operators.ordering import positions, running

#: Every conversation starts with turns of the one whose id is the next lower multiple of this.
BASE_EVERY = 20
#: At most one turn less than this is taken over.
SHARED_TURNS = 4
HASHES = 3
NARROWEST, WIDEST = 12, 24  # bits of the sketch's width
PIECE = 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = ["depth", "d1", "d2"]


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, digest, words): the turns of each conversation, numbered from 1."""
    role, text = text_or_empty("role"), text_or_empty("text")
    named = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"))
    rows = materialise(named.drop("text"), "trie-turns")
    # texts are carried only where they decide the order
    step = ["conv_id", "turn", "role"]
    tied = materialise(rows.groupBy(*step).agg(F.min("digest").alias("least"), F.max("digest").alias("most")).where("least <> most")
                       .select(*[F.col(c).alias(f"t_{c}") for c in step]), "trie-tied")
    same = (F.col("conv_id") == F.col("t_conv_id")) & F.col("turn").eqNullSafe(F.col("t_turn")) & (F.col("role") == F.col("t_role"))
    keyed = rows.withColumn("text", F.lit("")) if tied.isEmpty() else materialise(
        rows.join(tied, same, "left_anti").withColumn("text", F.lit("")).unionByName(named.join(tied, same, "left_semi")), "trie-keyed")
    numbered = positions(keyed, ["conv_id"], ["turn", "role", "text"], "place")
    return numbered.select("conv_id", "place", "digest", "words")


def heads(own: DataFrame) -> DataFrame:
    """(conv_id, base, skipped, given, length): `given` turns come from the base
    conversation, and the first `skipped` of a conversation's own are left out."""
    counted = own.groupBy("conv_id").agg(F.count("*").alias("n"))
    skipped = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED_TURNS).alias("skipped")
    convs = counted.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % BASE_EVERY).alias("base"), skipped)
    bases = counted.where(F.col("conv_id") % BASE_EVERY == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    given = F.least(F.col("skipped"), F.coalesce("base_n", F.lit(0)))
    return convs.join(bases, "base", "left").select(
        "conv_id", "base", "skipped", given.alias("given"), (given + F.greatest(F.lit(0), F.col("n") - F.col("skipped"))).alias("length"))


def prefixes(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, length, words, d1, d2, p1, p2), one row per rebuilt turn with
    the digests of the prefix that ends there and of the one before; and `heads`."""
    own = materialise(turns(conversations), "trie-own")
    convs = materialise(heads(own), "trie-heads")
    columns = ["conv_id", "depth", "length", "digest", "words"]
    later = own.join(convs, "conv_id").where("place > skipped").withColumn("depth", F.col("given") + F.col("place") - F.col("skipped"))
    first = own.where((F.col("conv_id") % BASE_EVERY == 0) & (F.col("place") < SHARED_TURNS)).withColumnRenamed("conv_id", "base")
    taken = first.join(convs, "base").where("place <= given").withColumn("depth", F.col("place"))
    rows = later.select(*columns).unionByName(taken.select(*columns))
    hashed = rows.select("conv_id", "depth", "length", "words", *[F.xxhash64(F.lit(i), "depth", "digest").alias(f"e{i}") for i in (1, 2)])
    mixed = running(materialise(hashed, "trie-rebuilt"), ["conv_id"], ["depth"], {"p1": ("e1", "xor"), "p2": ("e2", "xor")})
    out = mixed.select("conv_id", "depth", "length", "words", F.col("p1").bitwiseXOR(F.col("e1")).alias("d1"),
                       F.col("p2").bitwiseXOR(F.col("e2")).alias("d2"), "p1", "p2")
    return materialise(out, "trie-prefixes"), convs


def cells(d1: np.ndarray, d2: np.ndarray, width: int) -> np.ndarray:
    """The counters of each digest, one row per hash function."""
    a, b = d1.astype(np.int64).view(np.uint64), d2.astype(np.int64).view(np.uint64) | np.uint64(1)
    with np.errstate(over="ignore"):
        hashed = [(a + np.uint64(i) * b) & np.uint64((1 << width) - 1) for i in range(HASHES)]
    return np.stack(hashed).astype(np.int64) + (np.arange(HASHES, dtype=np.int64) << width)[:, None]


def singles(rows: DataFrame, width: int) -> np.ndarray:
    """Count-min sketch of the digests of `rows`: for each counter, whether it is one."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counters = np.zeros(HASHES << width, np.uint8)  # 2 stands for any more
        for frame in frames:
            at, n = np.unique(cells(frame["d1"].to_numpy(), frame["d2"].to_numpy(), width), return_counts=True)
            counters[at] = np.minimum(2, counters[at] + np.minimum(n, 2))
        used = np.flatnonzero(counters.reshape(-1, 64).any(axis=1))
        for start in range(0, len(used), 50_000):
            words = counters.reshape(-1, 64)[used[start:start + 50_000]]
            packed = [np.packbits(words >= least, axis=1, bitorder="little").view(np.int64).ravel() for least in (1, 2)]
            yield pd.DataFrame({"word": used[start:start + 50_000], "seen": packed[0], "again": packed[1]})

    each = rows.select("d1", "d2").mapInPandas(count, "word long, seen long, again long")
    merged = F.aggregate(
        F.collect_list(F.struct("seen", "again")), F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(0).cast("bigint").alias("again")),
        lambda x, y: F.struct(x["seen"].bitwiseOR(y["seen"]).alias("seen"), x["again"].bitwiseOR(y["again"]).bitwiseOR(x["seen"].bitwiseAND(y["seen"])).alias("again")))
    total = each.groupBy("word").agg(merged.alias("c"))  # a list has one entry per task at most
    once = total.select("word", F.col("c.seen").bitwiseAND(F.bitwise_not(F.col("c.again"))).alias("once")).where("once <> 0").toArrow()
    out = np.zeros((HASHES << width) // 64, np.int64)  # 6 MB at the widest
    out[once["word"].to_numpy()] = once["once"].to_numpy()
    return out


def screened(rows: DataFrame) -> DataFrame:
    """`rows` with alone and parent_alone: the sketch proves that no other
    conversation has this prefix, or the one before."""
    width = min(WIDEST, max(NARROWEST, (4 * rows.count()).bit_length()))
    once = rows.sparkSession.sparkContext.broadcast(singles(rows, width))

    def proven(d1: pd.Series, d2: pd.Series) -> np.ndarray:
        at = cells(d1.to_numpy(), d2.to_numpy(), width)
        return ((once.value[at >> 6] >> (at & 63)) & 1).any(axis=0)

    def mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(alone=proven(frame["d1"], frame["d2"]), parent_alone=proven(frame["p1"], frame["p2"]) & (frame["depth"] > 1).to_numpy())

    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return materialise(rows.mapInPandas(mark, f"{kinds}, alone boolean, parent_alone boolean"), "trie-screened")


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, d1, d2, ends_sha256) from rows (depth, d1, d2, conv_id): SHA-256 of
    the comma-joined ids of each node, numerically ascending."""

    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, ids = None, []

        def piece() -> pd.DataFrame:
            return pd.DataFrame([[*node, ids[0], ",".join(map(str, ids))]], columns=[*NODE, "first", "ids"])

        for frame in frames:
            done = []
            for *key, conv in zip(*(frame[c] for c in [*NODE, "conv_id"]), strict=True):
                if ids and (key != node or len(ids) == PIECE):
                    done.append(piece())
                    ids = []
                node = key
                ids.append(conv)
            if done:
                yield pd.concat(done)
        if ids:
            yield piece()

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, sha = None, None
        for frame in frames:
            done = []
            for *key, ids in zip(*(frame[c] for c in [*NODE, "ids"]), strict=True):
                if key == node:
                    sha.update(f",{ids}".encode())
                    continue
                if sha is not None:
                    done.append([*node, sha.hexdigest()])
                node, sha = key, hashlib.sha256(ids.encode())
            yield pd.DataFrame(done, columns=[*NODE, "ends_sha256"])
        if sha is not None:
            yield pd.DataFrame([[*node, sha.hexdigest()]], columns=[*NODE, "ends_sha256"])

    kinds = "depth long, d1 long, d2 long"
    by_id = ends.select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    pieces = by_id.mapInPandas(join, f"{kinds}, first long, ids string")
    in_order = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first")
    return in_order.select(*NODE, "ids").mapInPandas(digest, f"{kinds}, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256), one row per node."""
    rows, convs = prefixes(conversations)
    marked = screened(rows)
    zero = F.lit(0).cast("bigint")
    member = ["conv_id", "depth", "length", "words", "d1", "d2", "p1", "p2"]
    roots = convs.select("conv_id", "length", *[zero.alias(c) for c in ("depth", "words", "d1", "d2", "p1", "p2")])
    shared = marked.where(~F.col("alone")).select(*member).unionByName(roots)
    tails = marked.where("alone")
    nodes = materialise(shared.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if(F.col("depth") == F.col("length")).alias("n_ends"),
        F.max("words").alias("words"), F.max("p1").alias("p1"), F.max("p2").alias("p2")), "trie-nodes")

    # sums over subtrees, by members
    owned = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("value"))
    leaves = nodes.where("n_ends = n_convs").select("conv_id").unionByName(tails.where("depth = length").select("conv_id"))
    credited = (shared.select("conv_id", *NODE).join(owned, ["conv_id", "depth"], "left")
                .join(leaves.withColumn("leaf", F.lit(1)), "conv_id", "left")
                .select("conv_id", *NODE, (-F.col("depth")).alias("up"), F.coalesce("value", zero).alias("value"), F.coalesce("leaf", F.lit(0)).alias("leaf")))
    below = running(materialise(credited, "trie-credited"), ["conv_id"], ["up"], {"deeper": ("value", "sum")})
    sums = below.groupBy(*NODE).agg(F.sum("leaf").alias("n_leaves"), F.sum(F.col("deeper") + F.col("value")).alias("saved_tokens"))

    parent = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("d1"), F.col("p2").alias("d2")]
    tops = tails.where(~F.col("parent_alone"))
    children = nodes.where("depth > 0").select(*parent).unionByName(tops.select(*parent)).groupBy(*NODE).agg(F.count("*").alias("n_children"))
    ends = end_digests(shared.where("depth = length"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    step = ["depth", "p1", "p2"]

    inner = (nodes.join(above, step, "left").join(sums, NODE, "left").join(children, NODE, "left").join(ends, NODE, "left")
             .select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"),
                     "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")))

    def single(df: DataFrame) -> DataFrame:
        ending = F.col("depth") == F.col("length")
        one = F.lit(1).cast("bigint")
        return df.select("conv_id", "depth", "parent_conv_id", one.alias("n_convs"), F.when(ending, zero).otherwise(one).alias("n_children"), one.alias("n_leaves"),
                         zero.alias("saved_tokens"), F.when(ending, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"))

    lower = tails.where("parent_alone").withColumn("parent_conv_id", F.col("conv_id"))
    return inner.unionByName(single(tops.join(above, step, "left"))).unionByName(single(lower))


ORACLE_SQL = r"""
with t as (select cast(conv_id as bigint) as conv_id, turn, coalesce(role, '') as role, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) as digest,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as words from conversations where conv_id is not null),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, digest) as place from t),
k as (select conv_id, count(*) as n, conv_id - conv_id % 20 as base,
             xor(4294967295, list_reduce(list_concat([4294967295::bigint], list_transform(string_split(cast(conv_id as varchar), ''), lambda c: ord(c)::bigint)),
                 lambda acc, b: list_reduce(list_concat([xor(acc, b)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]),
                     lambda x, i: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end))) % 4 as skipped
      from o group by conv_id),
h as (select k.conv_id, k.base, k.skipped, least(k.skipped, coalesce(b.n, 0)) as given,
             least(k.skipped, coalesce(b.n, 0)) + greatest(0, k.n - k.skipped) as length from k left join k b on b.conv_id = k.base),
r as (select h.conv_id, given + place - skipped as depth, length, digest, words from o join h on h.conv_id = o.conv_id where place > skipped
      union all select h.conv_id, place, length, digest, words from o join h on h.base = o.conv_id where place <= given),
p as (select conv_id, depth, length, words, string_agg(digest, '/') over (partition by conv_id order by depth) as path from r
      union all select conv_id, 0, length, 0, '' from h),
m as (select *, case when depth = 0 then null when depth = 1 then '' else left(path, length(path) - 33) end as parent from p),
nd as (select path, depth, max(parent) as parent, min(conv_id) as conv_id, count(*) as n_convs, max(words) as words,
              sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where depth = length), '')) as ends_sha256 from m group by path, depth),
ch as (select parent, count(*) as n_children from nd where parent is not null group by parent),
fu as (select nd.*, coalesce(n_children, 0) as n_children from nd left join ch on ch.parent = nd.path),
su as (select a.path, count(*) filter (where b.n_children = 0) as n_leaves, sum((b.n_convs - 1) * b.words) as saved_tokens
       from fu a join fu b on a.path = '' or b.path = a.path or starts_with(b.path, a.path || '/') group by a.path)
select cast(fu.conv_id as bigint) as conv_id, cast(fu.depth as bigint) as depth, cast(up.conv_id as bigint) as parent_conv_id, cast(fu.n_convs as bigint) as n_convs,
       cast(fu.n_children as bigint) as n_children, cast(su.n_leaves as bigint) as n_leaves, cast(su.saved_tokens as bigint) as saved_tokens, fu.ends_sha256
from fu join su on su.path = fu.path left join fu up on up.path = fu.parent
"""
