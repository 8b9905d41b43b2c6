"""Exact deduplication: group by a 128-bit content hash, keep the smallest id,
compare bytes inside groups.

Every row gets (hash, digest of the normalised text); only those narrow rows
are grouped.  Texts of groups with two or more rows are then compared as bytes:
per hash the smallest and the largest text must be the same string.  Hashes
where they differ (collisions) are split by the text itself, so equality is
always that of the texts and never only that of the hash.

Defined results: a null text counts as empty, all empty texts form one group;
null ids are kept only where a group has no other; rows repeating both id and
text are copies of which one stays; an empty table gives an empty result;
further columns are ignored.  A group may hold any share of the rows: counts
and minima are combined before each shuffle, and the join that hands them back
is one that Spark can split.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import SPACES, materialise, maybe_in, text_or_empty


def normalise(col: Column) -> Column:
    return F.regexp_replace(col, SPACES, " ")


def content_hash(col: Column) -> Column:
    return F.unhex(F.md5(col))


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of `docs`.

    `digest` gives the 128-bit hash; tests put a weak one in its place."""
    keyed = docs.select(F.col("doc_id"), normalise(text_or_empty()).alias("t")).select("doc_id", digest(F.col("t")).alias("h"), "t")
    # one row per (hash, text digest, id): repeated rows are counted here
    rows = materialise(keyed.groupBy("h", F.unhex(F.sha2("t", 256)).alias("sha"), "doc_id").agg(F.count("*").alias("n")), "exact-rows")
    groups = rows.groupBy("h").agg(F.sum("n").alias("size"), F.min("doc_id").alias("keep_id"))

    # byte comparison within hashes that more than one row has
    shared = groups.filter("size > 1").select("h")
    collided = materialise(
        maybe_in(keyed, "h", shared).groupBy("h").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
        .filter("lo <> hi").select("h"), "exact-collisions")
    sound = groups.join(collided, "h", "left_anti")
    plain = rows.join(sound, "h").select("doc_id", "sha", "n", "keep_id", F.col("size").alias("group_size"))

    apart = maybe_in(keyed, "h", collided).join(collided, "h", "left_semi").groupBy("h", "t", "doc_id").agg(F.count("*").alias("n"))
    by_text = apart.groupBy("h", "t").agg(F.sum("n").alias("group_size"), F.min("doc_id").alias("keep_id"))
    split = apart.join(by_text, ["h", "t"]).select("doc_id", F.unhex(F.sha2("t", 256)).alias("sha"), "n", "keep_id", "group_size")

    copy = F.posexplode(F.sequence(F.lit(1), F.col("n"))).alias("copy", "i")
    return (plain.unionByName(split).select("*", copy)
            .select("doc_id", "keep_id", "group_size",
                    (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 0)).alias("kept"),
                    F.lower(F.hex("sha")).alias("text_sha256")))


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """`docs` without exact copies; all columns stay, and of repeated rows one."""
    groups = materialise(exact_groups(docs.select("doc_id", "text")), "exact-groups")
    marked = docs.withColumn("__sha", F.sha2(normalise(text_or_empty()), 256))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("text_sha256"))
    ids = [F.col("doc_id").alias("__id"), "text_sha256"]
    copies = groups.filter(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(*ids).distinct()
    stays = marked.join(copies, same, "left_anti")
    repeated = groups.groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n")).filter("n > 1").select(*ids)
    if not repeated.isEmpty():
        # rows that repeat id and text: any one of them stays
        one = stays.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "__sha"])
        stays = stays.join(repeated, same, "left_anti").unionByName(one)
    return stays.drop("__sha")


ORACLE_SQL = r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = min(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from n
"""
