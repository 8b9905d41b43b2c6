"""Running totals and positions against a plain replay."""

import random

from pyspark.sql import functions as F

from shelfspark.operators.ordering import positions, running


def test_running_totals_of_a_large_group_and_null_keys(spark):
    random.seed(3)
    rows = [(random.choice(["a", "a", "a", None, "b"]), i * 7919 % 1009, random.randrange(1 << 60)) for i in range(1009)]
    df = spark.createDataFrame(rows, "g string, o long, v long").repartition(5)
    got = {(r.g, r.o): (r.before, r.mixed) for r in
           running(df, ["g"], ["o"], {"before": ("o", "sum"), "mixed": ("v", "xor")}).collect()}
    state = {}
    for g, o, v in sorted(rows, key=lambda r: r[1]):
        total, mixed = state.get(g, (0, 0))
        assert got[g, o] == (total, mixed)
        state[g] = (total + o, mixed ^ v)
    assert len(got) == len(rows)


def test_positions_without_group_ties_and_empty(spark):
    df = spark.createDataFrame([("x",), ("x",), (None,), ("a",)], "o string")
    assert sorted((r.position, r.o) for r in positions(df, [], ["o"]).collect()) == [(1, None), (2, "a"), (3, "x"), (4, "x")]
    assert positions(df.where(F.lit(False)), [], ["o"]).collect() == []
