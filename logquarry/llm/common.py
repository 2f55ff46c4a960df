"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.session import ensure_checkpoint_dir

BLANKS = r"\x20\x09-\x0D"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Written tables in the shared checkpoint folder; they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
        self.count = 0

    def save(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        saved = self.spark.read.schema(df.schema).parquet(path)
        saved.saved_path = path
        return saved

    def drop(self, *saved: DataFrame | None) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for df in saved:
            if df is not None:
                path = jvm.org.apache.hadoop.fs.Path(df.saved_path)
                path.getFileSystem(conf).delete(path, True)

    def sweep(self) -> None:
        """Let Spark remove the shuffle files of tables that are written and of queries that are over."""
        self.spark._jvm.System.gc()


def raw_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]


def raw_words(text: bytes) -> list[bytes]:
    """Words between blanks (space, tab to carriage return), A-Z in lower case."""
    return text.lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def shingle_set(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``width`` words; the whole text if it has fewer."""
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    k = min(width, len(h))
    acc = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        acc = acc * _STEP + h[i : i + len(acc)]
        acc ^= acc >> np.uint64(29)
    acc *= _MIX
    acc ^= acc >> np.uint64(32)
    return np.unique(acc)


def minwise_pair(text: bytes, width: int) -> tuple[int, int]:
    """Two independent minwise hashes of a text's shingles; zeros without words."""
    found = shingle_set(raw_words(text), width)
    if not len(found):
        return 0, 0
    other = (found ^ (found >> np.uint64(31))) * _STEP
    return int(found[0].view(np.int64)), int(other.min().view(np.int64))


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (node, root), root the least node reached.

    Alternates two star contractions until nothing changes; the number of rounds grows with
    the logarithm of the nodes. Nodes without an edge to another node have no row.
    """
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    # edges may be costly to make and are read several times
    now = scratch.save(edges.where("a <> b").select(hi.alias("u"), lo.alias("v")))
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        before, now = now, scratch.save(small.where("u <> v").distinct())
        scratch.drop(before)
        # done when every edge goes from a leaf with one edge to a root
        ends = now.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("leaf")), F.struct(F.col("v").alias("node"), F.lit(0).alias("leaf")))).alias("e"))
        tied = ends.groupBy("e.node").agg(F.sum("e.leaf").alias("out"), F.count("*").alias("n")).where("out > 1 OR (out = 1 AND n > 1)")
        if tied.isEmpty():
            roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


@contextmanager
def short_batches(spark: SparkSession, rows: int = 1000):
    """Whole texts go to Python workers in batches of few rows, which tasks hold on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` a few at a time, so that few texts are Python strings at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def arrow_batches(fn, schema: pa.Schema):
    """Wrap ``fn(batch) -> dict of columns`` for ``mapInArrow``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = fn(batch)
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)

    return run
