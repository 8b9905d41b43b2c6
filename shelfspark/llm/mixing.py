"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a target number of words.  A source whose target exceeds its
size gives complete epochs first; what is left of the target is filled by a
weighted sample without replacement: each document draws u in (0, 1) from its
id and text, its key is -ln(u) / weight (an exponential with the document's
quality weight as rate), documents are sorted by key within the source, and
their sizes are added up until the budget is full.  The document in which the
budget ends gives its first words up to it, so that a source's words are its
target rounded to a word.

Texts are read once; what is sorted are narrow rows, range-partitioned by
(source, key), so that a source may hold any share of them.  One row per source
passes through one task (ranks by name and the shares).

Defined results: a null text has size 0; null is a source of its own, the last;
a source without words has target 0; documents without a known quality get the
middle weight; rows that repeat id and text are documents of their own with the
same key; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import materialise, text_or_empty
from shelfspark.operators.ordering import running

#: Weights of the sources in order of their names, repeating.
SOURCE_WEIGHTS = (3.0, 1.0, 2.0)
#: Words of the mix as a multiple of all words.
BUDGET = 1.5
#: No source gives more than this many times its words.
MOST_EPOCHS = 2.0
#: Weight of a document of quality 0 and what quality 1 adds.
BASE_QUALITY, QUALITY_GAIN = 1.0, 3.0
UNKNOWN_QUALITY = 0.5
SEED = "mix-1"


def document_weight(quality: Column) -> Column:
    return F.lit(BASE_QUALITY) + F.lit(QUALITY_GAIN) * F.coalesce(quality, F.lit(UNKNOWN_QUALITY))


def uniform(doc_id: Column, digest: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from 52 bits of a hash of the id and the text's digest."""
    named = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), digest))
    return (F.conv(F.substring(named, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def keyed(docs: DataFrame, labels: DataFrame, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, digest, key), one narrow row per document."""
    quality = labels.groupBy(F.col("doc_id").alias("__id")).agg(F.avg(F.col("quality").cast("double")).alias("quality"))
    text = text_or_empty()
    narrow = docs.select("doc_id", F.col("source").cast("string").alias("source"),
                         F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("size"), F.md5(text).alias("digest"))
    weighed = narrow.join(quality, F.col("doc_id") == F.col("__id"), "left")
    key = -F.ln(uniform(F.col("doc_id"), F.col("digest"), seed)) / document_weight(F.col("quality"))
    return weighed.select("doc_id", "source", "size", "digest", key.alias("key"))


def targets(sizes: DataFrame, weights: Sequence[float] = SOURCE_WEIGHTS, budget: float = BUDGET, most: float = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sharing by weight and resharing what exceeds a cap ends at min(cap, level *
    weight) with one level for all sources.  In order of cap / weight, a source
    stays at its cap while the level of it and all later ones reaches that."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.select("source", "source_size", F.get(cycle, place).alias("weight"), (F.col("source_size") * F.lit(most)).alias("cap"))
    ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    rest = ratio.rowsBetween(0, Window.unboundedFollowing)
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    levels = weighed.select(
        "*", ((F.sum("source_size").over(everything) * F.lit(budget) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
              / F.sum("weight").over(rest)).alias("level"))
    # levels fall from the first source that stays below its cap onwards
    open_level = F.max(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.col("level"))).over(everything)
    return levels.select("source", "source_size", F.least("cap", F.coalesce(open_level * F.col("weight"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, labels: DataFrame, weights: Sequence[float] = SOURCE_WEIGHTS, budget: float = BUDGET,
        most: float = MOST_EPOCHS, seed: str = SEED) -> DataFrame:
    """(doc_id, size, source, source_size, target, epochs, part, taken): a document
    is in the mix `epochs` times in full, then with its first `part` words."""
    rows = materialise(keyed(docs, labels, seed), "mix-keys")
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = materialise(sources.select(
        F.col("source").alias("__source"), "source_size", "target", epochs.alias("epochs"),
        (F.round("target").cast("bigint") - epochs * F.col("source_size")).alias("budget")), "mix-targets")
    sorted_ = running(rows, ["source"], ["key", "doc_id", "digest"], {"before": ("size", "sum")})
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("before")))
    return (sorted_.join(plan, F.col("source").eqNullSafe(F.col("__source")))
            .select("doc_id", "size", "source", "digest", "source_size", "target", "epochs", part.cast("bigint").alias("part"))
            .withColumn("taken", F.col("epochs") * F.col("size") + F.col("part")))


def mixed_texts(docs: DataFrame, mixture: DataFrame) -> DataFrame:
    """The texts of a mix, (doc_id, source, copy, text): whole copies from 1, then
    the part of a document as copy 0.  Rows that repeat id, source and text are
    matched one to one."""
    same_row = ["__id", "__source", "__digest"]
    nth = F.row_number().over(Window.partitionBy(*same_row).orderBy("__part"))
    chosen = mixture.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("digest").alias("__digest"),
                            F.col("epochs").alias("__epochs"), F.col("part").alias("__part"), F.col("size").alias("__size")).withColumn("__nth", nth)
    texts = docs.select("doc_id", F.col("source").cast("string").alias("source"), text_or_empty().alias("text"))
    own = Window.partitionBy("doc_id", "source", "digest").orderBy("doc_id")
    texts = texts.withColumn("digest", F.md5("text")).withColumn("nth", F.row_number().over(own))
    same = (F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source"))
            & (F.col("digest") == F.col("__digest")) & (F.col("nth") == F.col("__nth")))
    full = (F.col("__epochs") + F.when((F.col("__part") == F.col("__size")) & (F.col("__size") > 0), 1).otherwise(0)).cast("int")
    none = F.array().cast("array<int>")
    copies = F.concat(F.when(full > 0, F.sequence(F.lit(1), full)).otherwise(none),
                      F.when(F.col("__part").between(F.lit(1), F.col("__size") - 1), F.array(F.lit(0))).otherwise(none))
    head = F.regexp_extract("text", r"^[\x20\x09-\x0D]*", 0)
    tokens = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    return (texts.join(chosen, same).select("doc_id", "source", "text", "__part", F.explode(copies).alias("copy"))
            .select("doc_id", "source", "copy", F.when(F.col("copy") > 0, F.col("text")).otherwise(
                F.concat(head, F.array_join(F.slice(tokens, 1, F.col("__part").cast("int")), ""))).alias("text")))


ORACLE_SQL = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
                  md5(coalesce(text, '')) as digest from documents),
q as (select doc_id, avg(cast(quality as double)) as quality from labels group by doc_id),
k as (select d.*, -ln((cast(concat('0x', substr(md5(concat('mix-1:', coalesce(cast(d.doc_id as varchar), ''), ':', digest)), 1, 13)) as bigint) + 0.5)
             / 4503599627370496.0) / (1.0 + 3.0 * coalesce(q.quality, 0.5)) as key
      from d left join q on q.doc_id = d.doc_id),
s as (select source, cast(sum(size) as bigint) as source_size from k group by source),
w as (select *, 2.0 * source_size as cap, [3.0, 1.0, 2.0][1 + (row_number() over (order by source nulls last) - 1) % 3]::double as weight from s),
l as (select *, ((select 1.5 * sum(source_size) from s) - coalesce(sum(cap) over (r rows between unbounded preceding and 1 preceding), 0))
             / sum(weight) over (r rows between current row and unbounded following) as level
      from w window r as (order by cap / weight, source nulls last)),
t as (select source, source_size, cast(least(cap, coalesce((select max(level) from l where level * weight < cap) * weight, cap)) as double) as target from l),
e as (select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as epochs from t),
p as (select k.doc_id, k.size, e.source_size, e.target, e.epochs, cast(round(e.target) as bigint) - e.epochs * e.source_size as budget,
             coalesce(sum(k.size) over (partition by k.source order by key, k.doc_id, digest rows between unbounded preceding and 1 preceding), 0) as before
      from k join e on e.source is not distinct from k.source)
select doc_id, cast(size as bigint) as size, source_size, target,
       cast(epochs * size + greatest(0, least(size, budget - before)) as bigint) as taken
from p
"""
