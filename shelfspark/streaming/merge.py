"""Incremental catalog merge and new-link discovery with Structured Streaming.

``stream_merge_products``: sightings arrive as parquet files; every
micro-batch is reduced to partial-merge rows and combined with the stored
state (``max(struct(seq, value))`` / ``min(struct(seq, pos))`` per field, so
batch order, late files and replays cannot change the result).  The state is
log-structured under ``spark.checkpoint.dir``: each batch appends only its own
partial rows (O(batch) per micro-batch) and commits a marker named after the
batch id, which makes a re-delivered batch a no-op (exactly-once together
with the stream checkpoint); periodic compaction folds the deltas.

``stream_new_links``: discovered URLs are de-duplicated by the streaming
state store (``dropDuplicates``) so each URL is emitted once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.operators import products as PR
from shelfspark.session import dealt, scratch_path


def _hadoop_fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _hadoop_fs(spark, path)
    return fs.exists(p)


def _touch(spark: SparkSession, path: str) -> None:
    fs, p, _ = _hadoop_fs(spark, path)
    fs.create(p, True).close()


class CatalogState:
    """Log-structured partial-merge state in a shared folder.

    Every micro-batch writes only its own partial rows to
    ``deltas/batch=<id>`` (O(batch), overwritten if the batch is replayed
    before its commit marker exists) and commits a marker; every
    ``compact_every`` batches the compacted base and the newer deltas are
    combined into ``compacted/v=<id>``.  Reads combine the latest compacted
    base with the committed deltas after it; max/min state makes the
    combination order-free."""

    def __init__(self, spark: SparkSession, root: str, compact_every: int = 8):
        self.spark = spark
        self.root = root.rstrip("/")
        self.compact_every = compact_every

    def _ids(self, folder: str) -> list[int]:
        fs, p, _ = _hadoop_fs(self.spark, f"{self.root}/{folder}")
        if not fs.exists(p):
            return []
        return sorted(int(st.getPath().getName()) for st in fs.listStatus(p))

    def committed(self, batch_id: int) -> bool:
        return _exists(self.spark, f"{self.root}/_commits/{batch_id}")

    def read(self) -> DataFrame | None:
        compacted = self._ids("_compactions")
        upto = compacted[-1] if compacted else -1
        paths = [f"{self.root}/deltas/batch={i}" for i in self._ids("_commits") if i > upto]
        parts = []
        if compacted:
            parts.append(self.spark.read.parquet(f"{self.root}/compacted/v={upto}"))
        if paths:
            parts.append(self.spark.read.parquet(*paths))
        if not parts:
            return None
        state = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return PR.combine_partial(state)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        if self.committed(batch_id):
            return  # replayed batch: already folded in
        part = PR.partial_merge(PR.drop_unidentified(PR.products_from_observations(dealt(batch))))
        part.write.mode("overwrite").parquet(f"{self.root}/deltas/batch={batch_id}")
        _touch(self.spark, f"{self.root}/_commits/{batch_id}")
        if (batch_id + 1) % self.compact_every == 0:
            self.compact(batch_id)

    def compact(self, batch_id: int) -> None:
        state = self.read()
        if state is None:
            return
        state.write.mode("overwrite").parquet(f"{self.root}/compacted/v={batch_id}")
        _touch(self.spark, f"{self.root}/_compactions/{batch_id}")

    def products(self) -> DataFrame:
        state = self.read()
        if state is None:
            raise RuntimeError("no committed state yet")
        return PR.finish_merge(state)


def stream_merge_products(spark: SparkSession, source_dir: str, root: str,
                          files_per_trigger: int = 1, compact_every: int = 8) -> CatalogState:
    """Run the incremental merge over every file in ``source_dir`` (until no
    more data) and return the state handle."""
    schema = spark.read.parquet(source_dir).schema
    state = CatalogState(spark, root, compact_every)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source_dir)
    q = (stream.writeStream
         .foreachBatch(lambda df, bid: state.apply(df, bid))
         .option("checkpointLocation", f"{root}/_stream_checkpoint")
         .trigger(availableNow=True)
         .start())
    q.awaitTermination()
    return state


def write_arrivals(df: DataFrame, path: str, batches: int, order_col: str = "seq") -> None:
    """Write ``df`` as ``batches`` files (range-partitioned by ``order_col``)
    to play the role of arriving data."""
    df.repartitionByRange(batches, order_col).write.mode("overwrite").parquet(path)


def stream_new_links(spark: SparkSession, source_dir: str, out_dir: str, key: str = "url") -> DataFrame:
    """Emit each distinct ``key`` once across all arriving files."""
    schema = spark.read.parquet(source_dir).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source_dir)
    q = (stream.dropDuplicates([key]).writeStream.format("parquet")
         .option("path", out_dir).option("checkpointLocation", out_dir + "_checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out_dir)


def fresh_root(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


__all__ = ["CatalogState", "stream_merge_products", "stream_new_links", "write_arrivals", "fresh_root", "F"]
