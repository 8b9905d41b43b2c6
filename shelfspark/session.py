"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import tempfile

from pyspark import SparkConf
from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Broadcast only what is measured small at run time; everything else shuffles.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32m",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

#: How tables with values of many MB are written: this codec streams, where the default one
#: keeps a value outside the heap, as it is and compressed.
LARGE_VALUES = {"compression": "zstd"}

#: Tasks that `dealt` makes for each core, so that slow ones even out.
TASKS_PER_CORE = 3


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "shelfspark") -> SparkSession:
    """Build (or reuse) a session with the engine's defaults.

    On a cluster the master and sizing come from spark-submit; the
    arguments only matter for local runs and tests.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    given = SparkConf()  # what spark-submit has set stays
    for key, value in _DEFAULTS.items():
        if not given.contains(key):
            builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if master and master.startswith("local"):
        builder = builder.config("spark.driver.memory", os.environ.get("SHELF_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local master
    (tests) may leave it unset and then gets a private scratch folder; on a
    cluster an unset folder is an error, since executors share no local disk.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="shelfspark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def spread(df):
    """`df`, dealt over ``spark.shelfspark.spreadPartitions`` tasks where the
    caller has set that: for small inputs of a single row group, as in tests.
    Unset (the default) the file splits stay as they are, without a shuffle."""
    tasks = df.sparkSession.conf.get("spark.shelfspark.spreadPartitions", None)
    return df.repartition(int(tasks)) if tasks else df


def dealt(df):
    """`df`, dealt evenly over tasks enough for every core, however few splits its
    files have.  For narrow rows that much work hangs on: a small file is one split,
    so that all that follows without a shuffle would be one task.  A number that the
    caller has set for ``spread`` holds here as well."""
    spark = df.sparkSession
    tasks = spark.conf.get("spark.shelfspark.spreadPartitions", None) or max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    return df.repartition(int(tasks))
