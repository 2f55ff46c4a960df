"""Session helpers: a local session for tests and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cpus: str | int = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the library expects on a cluster."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("logquarry")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LOGQUARRY_DRIVER_MEMORY", "12g"))
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Point the context at the cluster's shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir``. Only a local master may go
    without it; there a temporary folder is used.
    """
    sc = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF)
    if folder:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(folder)
        return folder
    if not sc.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a shared folder")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="logquarry-checkpoint-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as compressed columns and read it from there.

    Takes a fraction of the disk of :func:`cut_lineage`, but does not keep the number of partitions.
    Spark is told to remove the shuffle files of what is written.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    spark._jvm.System.gc()
    saved = spark.read.schema(df.schema).parquet(path)
    saved.saved_path = path
    return saved


def drop_written(df: DataFrame) -> None:
    """Delete a written table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.saved_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def task_count(df: DataFrame, rows: int) -> int:
    """How many tasks hold about ``rows`` rows each; as many as there are cores at least. Runs ``df`` to count it.

    Given to ``repartition`` as a number, it is not lowered again when small shuffles are put together,
    which only looks at bytes before the rows are multiplied or sorted.
    """
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def joined(left: DataFrame, right: DataFrame, keys: Sequence[str], tasks: int, how: str = "inner") -> DataFrame:
    """A join on ``keys`` with both sides dealt to ``tasks`` tasks."""
    return left.repartition(tasks, *keys).join(right.repartition(tasks, *keys), list(keys), how)
