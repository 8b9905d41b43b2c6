"""Small DataFrame helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fence(df: DataFrame, **exprs: Column) -> DataFrame:
    """Add expensive computed columns behind a one-row generator.

    A filter on a computed column is normally pushed below the projection
    that defines it, with the defining expression substituted -- for the URL
    pipelines that means evaluating them again in every filter.  Predicates
    cannot move below a ``Generate`` that produces the columns they read, so
    emitting the values through ``inline(array(struct(...)))`` keeps each
    expression evaluated once per row, in one narrow projection.
    """
    keep = [c for c in df.columns if c not in exprs]
    packed = F.array(F.struct(*[e.alias(n) for n, e in exprs.items()]))
    return df.select(*keep, F.inline(packed))
