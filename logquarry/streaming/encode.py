"""Encode a stream chunk by chunk: a micro-batch is cut into chunks with their own dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logquarry.operators import encode as en
from logquarry.operators import tagging as tg


def encode_stream(
    lines: DataFrame,
    path: str,
    checkpoint: str,
    patterns: tg.Patterns = (),
    mode: str = "normal",
    chunk_lines: int = 100_000,
) -> StreamingQuery:
    """Write the encoded tables of each micro-batch under ``path``.

    ``lines`` is a streaming frame with a column ``line``. Lines are numbered inside the
    batch, so equal lines stay apart: a chunk is a run of at most ``chunk_lines`` lines of
    one input partition, and its number holds batch, partition and run. Every batch has
    its own folder, so one that runs again replaces its own rows only.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        # partition in the upper bits, place in the partition in the lower 33
        row = F.monotonically_increasing_id()
        placed = batch.select("line", row.alias("row"))
        part, place = F.shiftright("row", 33), F.col("row").bitwiseAND(F.lit((1 << 33) - 1))
        run = F.floor(place / chunk_lines)
        chunk_id = F.lit(batch_id << 40).cast("bigint") + F.shiftleft(part, 20) + run
        chunk = placed.select(chunk_id.alias("chunk_id"), (place % chunk_lines + 1).alias("line_no"), "line")
        for name, df in en.encode(tg.tag_lines(chunk, patterns), mode).tables().items():
            df.write.mode("overwrite").parquet(f"{path}/{name}/batch_id={batch_id}")

    return (
        lines.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
