"""Running totals and positions inside groups of any size.

A window over a group puts the whole group into one task.  Here the rows are
range-partitioned by (group, order) instead, so that a group of any size spans
many tasks; each task adds up its own part of a group, and what lies before a
part is added from a table of one row per (group, task).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.session import scratch_path

PART = "__part"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """`df` written to the shared scratch folder and read back: lineage ends
    there and later readers do not compute it again."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _fold(kind: str, col: Column) -> Column:
    return F.bit_xor(col) if kind == "xor" else F.sum(col)


def running(df: DataFrame, group: list[str], order: list[str], totals: dict[str, tuple[str, str]]) -> DataFrame:
    """`df` with, for each ``name: (column, kind)`` of `totals`, the fold of
    `column` over the earlier rows of its group in `order` (0 for the first).

    kind is "sum" or "xor".  Null keys are one group; `order` sorts null first
    and ascending.  Rows equal in group and order stand in any order, so give a
    full order where that matters.  `df` is read twice (range bounds, then
    rows): pass a stored table, and a narrow one, as its rows are shuffled."""
    dealt = stored(df.repartitionByRange(*[F.col(c) for c in [*group, *order]])
                   .withColumn(PART, F.spark_partition_id()), "running")
    earlier = Window.partitionBy(PART, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.select("*", *[F.coalesce(_fold(kind, F.col(c)).over(earlier), F.lit(0)).alias(name)
                                 for name, (c, kind) in totals.items()])
    parts = dealt.groupBy(PART, *group).agg(*[_fold(kind, F.col(c)).alias(f"__{name}")
                                              for name, (c, kind) in totals.items()])
    before = Window.partitionBy(*group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col(PART).alias("__p"), *[F.col(c).alias(f"__g_{c}") for c in group],
                         *[F.coalesce(_fold(kind, F.col(f"__{name}")).over(before), F.lit(0)).alias(f"__{name}")
                           for name, (_, kind) in totals.items()])
    same = F.col(PART) == F.col("__p")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"__g_{c}"))
    plus = [(F.col(name).bitwiseXOR(F.col(f"__{name}")) if kind == "xor" else F.col(name) + F.col(f"__{name}")).alias(name)
            for name, (_, kind) in totals.items()]
    return inside.join(parts, same).select(*df.columns, *plus)


def positions(df: DataFrame, group: list[str], order: list[str], name: str = "position") -> DataFrame:
    """`df` with the row's place in its group, from 1, as a long."""
    numbered = running(df.withColumn("__one", F.lit(1).cast("bigint")), group, order, {name: ("__one", "sum")})
    return numbered.withColumn(name, F.col(name) + 1).drop("__one")
