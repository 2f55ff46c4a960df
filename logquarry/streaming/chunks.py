"""Encode a stream into chunks that micro-batches fill together.

Lines of a stream have one running number over all batches, so a chunk holds ``chunk_lines`` lines
however small the batches are. A batch leaves two things for the next one: how many lines there were
(``state``) and the lines of the chunk that is not full yet (``pending``, always less than a chunk).
Both, and the encoded tables of the chunks that became full, lie in folders named by the batch, and a
batch reads only what the batch before it left; one that runs again writes the same rows once more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logquarry.operators import encode as en
from logquarry.operators import tagging as tg
from logquarry.session import cut_lineage
from logquarry.sources.tables import ENCODED_SCHEMAS

_PENDING = "chunk_id long, line_no long, line string"
_STATE = "next_line long"
_ROW_BITS = 33  # of monotonically_increasing_id, below the number of the partition


def _folder(path: str, part: str, batch_id: int) -> str:
    return f"{path}/{part}/batch_id={batch_id}"


def _files(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _exists(spark: SparkSession, path: str) -> bool:
    files, folder = _files(spark, path)
    return files.exists(folder)


def numbered(batch: DataFrame, start: int) -> tuple[DataFrame, int]:
    """``(index, line)`` of a batch in the order of its partitions, from ``start``, and the index after the last.

    Lines stay where they are: a partition's first index is the number of lines in those before it.
    """
    placed = cut_lineage(batch.select("line").withColumn("row", F.monotonically_increasing_id()))
    part = F.shiftright("row", _ROW_BITS)
    counts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    # one row for each partition
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    place = F.col("row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    indexed = placed.withColumn("part", part).join(F.broadcast(offsets), "part")
    return indexed.select((F.lit(start) + F.col("offset") + place).alias("index"), "line"), start + total


def append_batch(batch: DataFrame, batch_id: int, path: str, patterns: tg.Patterns = (), mode: str = "normal", chunk_lines: int = 100_000) -> None:
    """Add the lines (column ``line``) of one micro-batch; full chunks are encoded and written."""
    spark = batch.sparkSession
    start, left = 0, None
    if _exists(spark, _folder(path, "state", batch_id - 1)):
        start = spark.read.schema(_STATE).parquet(_folder(path, "state", batch_id - 1)).first()["next_line"]
        left = spark.read.schema(_PENDING).parquet(_folder(path, "pending", batch_id - 1))
    indexed, after = numbered(batch, start)
    index = F.col("index")
    lines = indexed.select(F.floor(index / chunk_lines).alias("chunk_id"), (index % chunk_lines + 1).alias("line_no"), "line")
    if left is not None:
        lines = left.union(lines)
    lines = cut_lineage(lines)
    open_chunk = after // chunk_lines
    full = tg.tag_lines(lines.where(F.col("chunk_id") < open_chunk), patterns).select("chunk_id", "line_no", "parts")
    if open_chunk > start // chunk_lines:
        for name, df in en.encode(full, mode).tables().items():
            df.write.mode("overwrite").parquet(_folder(path, name, batch_id))
    lines.where(F.col("chunk_id") == open_chunk).write.mode("overwrite").parquet(_folder(path, "pending", batch_id))
    # written last: the next batch starts from it
    spark.createDataFrame([(after,)], _STATE).coalesce(1).write.mode("overwrite").parquet(_folder(path, "state", batch_id))
    # a batch that runs again needs the one before it and no other
    for part in ("pending", "state"):
        files, folder = _files(spark, _folder(path, part, batch_id - 2))
        files.delete(folder, True)


def encode_stream_filled(
    lines: DataFrame, path: str, checkpoint: str, patterns: tg.Patterns = (), mode: str = "normal", chunk_lines: int = 100_000
) -> StreamingQuery:
    """Encode a streaming frame with a column ``line`` into chunks that batches fill together."""

    def write(batch: DataFrame, batch_id: int) -> None:
        append_batch(batch, batch_id, path, patterns, mode, chunk_lines)

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_filled(spark: SparkSession, path: str, patterns: tg.Patterns = (), mode: str = "normal") -> en.Encoded:
    """The encoded tables of all full chunks together with those of the chunk that is still open."""
    files, folder = _files(spark, f"{path}/state")
    batches = [int(s.getPath().getName().split("=")[1]) for s in files.listStatus(folder)] if files.exists(folder) else []
    closed = {
        name: spark.read.schema(schema).parquet(f"{path}/{name}").select(*[c.split()[0] for c in schema.split(", ")])
        if _exists(spark, f"{path}/{name}")
        else spark.createDataFrame([], schema)
        for name, schema in ENCODED_SCHEMAS.items()
    }
    if not batches:
        return en.Encoded(**closed)
    pending = spark.read.schema(_PENDING).parquet(_folder(path, "pending", max(batches)))
    tail = en.encode(tg.tag_lines(pending, patterns), mode)
    return en.Encoded(**{name: df.unionByName(tail.tables()[name]) for name, df in closed.items()})
