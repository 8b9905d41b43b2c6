"""Embedding whitening with an exact scatter matrix from bit planes.

Entries become integers x = floor(256 c).  Every distinct vector counts once.
Each task packs its share of these: per block of rows and dimension the values
are shifted to start at 0, and bit b of all rows of the block becomes one plane
of 64-bit words.  The sum over rows of x_i x_j is then the sum over planes a, b
of 2^(a+b) times the number of ones in (plane a of i AND plane b of j), plus
what the shifts add: integers throughout, whatever the order of rows or tasks.

Partial sums of the tasks (one row per pair of dimensions) are added by Spark as
decimals; the driver gets one row per pair, centres them as integers, n G - S S',
and takes the eigenvectors of the covariance.  Vectors are then projected where
they are read.

Defined results: vectors that are null, empty, or hold null or non-finite
entries are dropped, as are those whose length is not the most frequent one
(of equally frequent ones the longest); components of eigenvalue 0 (fewer
distinct vectors than dimensions) have no rows; a deviation beyond a 64-bit
integer is null; entries beyond 2^63 / 256 count as the largest integer; an
empty table gives an empty result; repeated rows each get their rows; further
columns are ignored.  The driver holds matrices of dimension x dimension.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import materialise

SCALE = 256.0
COMPONENTS = 4
#: Rows whose bits are packed together; a multiple of 64.
BLOCK_ROWS = 8192
#: Eigenvalues up to this share of the largest are rounding of 0.
ZERO = 1e-12
INF = float("inf")


def integer_vectors(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, x) of the usable rows, x as array of long."""
    v = F.col(vector).cast("array<double>")
    broken = F.exists(v, lambda c: F.coalesce(F.isnan(c) | (F.abs(c) == F.lit(INF)), F.lit(True)))
    usable = embeddings.select("vec_id", v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & ~broken)
    return usable.select("vec_id", F.transform("v", lambda c: F.floor(c * F.lit(SCALE)).cast("bigint")).alias("x"))


def block_scatter(x: np.ndarray) -> np.ndarray:
    """Sum over rows of x_i x_j as Python integers, from the bit planes of `x`."""
    rows, dims = x.shape
    low = x.min(axis=0)
    shifted = (x.astype(object) - low.astype(object)).astype(np.uint64) if x.max() - float(x.min()) >= 2.0**62 else (x - low).astype(np.uint64)
    bits = int(shifted.max()).bit_length()
    padded = np.zeros((dims, -(-rows // 64) * 64), np.uint64)
    padded[:, :rows] = shifted.T
    # planes[i, b]: bit b of dimension i, 64 rows a word
    planes = np.stack([np.packbits(((padded >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), axis=1).view(np.uint64) for b in range(bits)], axis=1) if bits else np.zeros((dims, 0, 1), np.uint64)
    out = np.zeros((dims, dims), object)
    weight = np.array([[1 << (a + b) for b in range(bits)] for a in range(bits)], object if bits > 24 else np.int64)
    for i in range(dims):
        ones = np.stack([np.bitwise_count(planes[i:] & planes[i, a]).sum(axis=2, dtype=np.int64) for a in range(bits)]) if bits else np.zeros((0, dims - i, 0), np.int64)
        products = (ones.transpose(1, 0, 2) * weight).sum(axis=(1, 2))  # of shifted values, i with i and all later dimensions
        out[i, i:] = out[i:, i] = products
    low, sums = low.astype(object), shifted.astype(object).sum(axis=0) if bits > 40 else shifted.sum(axis=0).astype(object)
    return out + np.outer(low, sums) + np.outer(sums, low) + rows * np.outer(low, low)


def _sums_frame(i, j, totals) -> pd.DataFrame:
    """Totals of any size as two decimals that Spark can add up: total = high 2^60 + low."""
    whole = [int(t) for t in totals]
    return pd.DataFrame({"i": i, "j": j, "high": [Decimal(t >> 60) for t in whole], "low": [Decimal(t & ((1 << 60) - 1)) for t in whole]})


def partial_sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row (i, j, high, low) per pair of dimensions, (i, -1) for sums, (-1, -1) for rows."""
    held, waiting, rows, sums, scatter = [], 0, 0, None, None

    def flush() -> None:
        nonlocal held, waiting, rows, sums, scatter
        x = np.concatenate(held)
        for start in range(0, len(x), BLOCK_ROWS):
            block = x[start:start + BLOCK_ROWS]
            own = block_scatter(block)
            total = block.astype(object).sum(axis=0) if np.abs(block.astype(float)).max() > 2.0**40 else block.sum(axis=0).astype(object)
            sums, scatter = (total, own) if sums is None else (sums + total, scatter + own)
        rows, held, waiting = rows + len(x), [], 0

    for frame in frames:
        if len(frame):
            held.append(np.stack(frame["x"].to_numpy()).astype(np.int64))
            waiting += len(frame)
            if waiting >= BLOCK_ROWS:
                flush()
    if held:
        flush()
    if rows:
        i, j = np.triu_indices(len(sums))
        yield _sums_frame([-1], [-1], [rows])
        yield _sums_frame(np.arange(len(sums)), -1, sums)
        for k in range(0, len(i), 50_000):
            yield _sums_frame(i[k:k + 50_000], j[k:k + 50_000], scatter[i[k:k + 50_000], j[k:k + 50_000]])


class Whitening(NamedTuple):
    """What the fit found; `project` maps centred vectors to components."""

    n: int
    sums: list[int]
    project: np.ndarray
    explained: np.ndarray


def fit(distinct: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on the vectors `x` of a table, each row once; None without rows."""
    pairs = distinct.select("x").mapInPandas(partial_sums, "i int, j int, high decimal(38,0), low decimal(38,0)").groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    totals = {(r["i"], r["j"]): (int(r["high"]) << 60) + int(r["low"]) for r in pairs.collect()}
    if not totals:
        return None
    n = totals[-1, -1]
    sums = [totals[i, -1] for i in range(len(totals)) if (i, -1) in totals]
    dims = len(sums)
    covariance = np.zeros((dims, dims))
    for i in range(dims):
        for j in range(i, dims):
            covariance[i, j] = covariance[j, i] = (n * totals[i, j] - sums[i] * sums[j]) / (n * n)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    order = [k for k in order if values[k] > ZERO * max(values.max(), 0.0)]
    values, vectors = values[order], vectors[:, order]
    for k in range(len(order)):  # either sign will do; reruns take the same one
        vectors[:, k] *= np.sign(vectors[np.argmax(np.abs(vectors[:, k])), k])
    return Whitening(n, sums, vectors / np.sqrt(values), values / np.trace(covariance) if len(values) else values)


def centred(x: np.ndarray, model: Whitening) -> tuple[np.ndarray, list[int]]:
    """n x - S, as doubles, and the exact sums of its squares by row."""
    most = model.n * float(np.abs(x.astype(float)).max(initial=0)) + max(map(abs, model.sums))
    small = most < 2.0**52 and most * most * x.shape[1] < 2.0**62
    own = (model.n * x - np.array(model.sums)) if small else model.n * x.astype(object) - np.array(model.sums, object)
    return own.astype(float), [int(s) for s in (own * own).sum(axis=1)]


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest entry of |covariance of the whitened fit vectors - identity|, measured."""
    k = model.project.shape[1]

    def products(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k + 1, k))
        for frame in frames:
            if len(frame):
                w = centred(np.stack(frame["x"].to_numpy()).astype(np.int64), model)[0] / model.n @ model.project
                total += np.vstack([w.sum(axis=0), w.T @ w])
        yield pd.DataFrame({"i": np.repeat(np.arange(k + 1), k), "j": np.tile(np.arange(k), k + 1), "total": total.ravel()})

    rows = distinct.select("x").mapInPandas(products, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect()
    total = np.zeros((k + 1, k))
    for r in rows:
        total[r["i"], r["j"]] = r["total"]
    mean = total[0] / model.n
    return float(np.abs(total[1:] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(embeddings: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), one
    row per usable vector and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = embeddings.sparkSession
    usable = integer_vectors(embeddings, vector)
    lengths = usable.groupBy(F.size("x").alias("length")).agg(F.count("*").alias("n"))
    common = lengths.agg(F.max(F.struct("n", "length")).alias("m")).first()["m"]
    if common is None:
        return spark.createDataFrame([], schema)
    usable = usable.where(F.size("x") == common["length"])
    distinct = materialise(usable.select("x").distinct(), "whitening-fit")
    model = fit(distinct, components)
    if not len(model.explained):
        return spark.createDataFrame([], schema)
    error = identity_error(distinct, model)
    k = len(model.explained)

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                own, squares = centred(np.stack(frame["x"].to_numpy()).astype(np.int64), model)
                deviation = pd.array([s if s < 1 << 63 else None for s in squares], "Int64")
                yield pd.DataFrame({
                    "vec_id": np.repeat(frame["vec_id"].to_numpy(object), k), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(frame)),
                    "n": model.n, "deviation": np.repeat(deviation, k), "whitened": (own / model.n @ model.project).ravel(),
                    "explained": np.tile(model.explained, len(frame)), "identity_error": error})

    # ids travel as text: pandas has no exact column of integers with nulls
    named = usable.select(F.col("vec_id").cast("string").alias("vec_id"), "x")
    return named.mapInPandas(apply, schema.replace("vec_id long", "vec_id string")).withColumn("vec_id", F.col("vec_id").cast("long"))
