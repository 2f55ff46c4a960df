"""Table sources and sinks: structured logs, templates, encoded chunks and result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.functions import tokens as tk
from logquarry.operators.encode import Encoded, encode

# Columns of a compression and of a decompression result row.
COMPRESSION_RESULT = (
    "timestamp string, log_name string, log_mode string, chunk_lines bigint, threads bigint, "
    "threshold bigint, codec string, mode string, original_bytes bigint, compressed_bytes bigint, "
    "ratio double, seconds double, mb_per_second double"
)
DECOMPRESSION_RESULT = (
    "timestamp string, source string, threads bigint, output_bytes bigint, seconds double, "
    "mb_per_second double, status string"
)


def read_structured(spark: SparkSession, path: str) -> DataFrame:
    """Structured or template CSV: every column a string, missing values empty."""
    return spark.read.option("header", True).option("multiLine", False).csv(path).na.fill("")


def write_structured(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Structured CSV; array columns are written in list form."""
    columns = [
        list_text(F.col(name)).alias(name) if kind.startswith("array") else F.col(name)
        for name, kind in df.dtypes
    ]
    df.select(*columns).write.mode(mode).option("header", True).csv(path)


def list_text(items: Column) -> Column:
    quoted = F.transform(items, lambda i: F.concat(F.lit("'"), i.cast("string"), F.lit("'")))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def template_report(structured: DataFrame, template: str = "template") -> DataFrame:
    """``EventId, EventTemplate, Occurrences`` of a parsed log."""
    return (
        structured.groupBy(F.col(template).alias("EventTemplate"))
        .agg(F.count(F.lit(1)).alias("Occurrences"))
        .select(tk.event_id(F.col("EventTemplate")).alias("EventId"), "EventTemplate", "Occurrences")
    )


def write_encoded(encoded: Encoded, path: str, mode: str = "overwrite") -> None:
    """One Parquet table per part, rows of a chunk kept together and in order."""
    order = {
        "templates": ["chunk_id", "template_id"],
        "line_map": ["chunk_id", "line_no"],
        "tags": ["chunk_id", "tag"],
        "values": ["chunk_id", "tag", "line_no", "var_no"],
        "dictionary": ["chunk_id", "tag", "dict_id"],
    }
    for name, df in encoded.tables().items():
        # by chunk, so neighbouring rows are alike and compress
        df.repartition("chunk_id").sortWithinPartitions(*order[name]).write.mode(mode).option(
            "compression", "zstd"
        ).parquet(f"{path}/{name}")


def encode_and_write(
    tagged: DataFrame, path: str, mode: str = "normal", handlers: dict | None = None
) -> None:
    """Encode and write all tables."""
    write_encoded(encode(tagged, mode, handlers), path)


ENCODED_SCHEMAS = {
    "templates": "chunk_id bigint, template_id bigint, n_lines bigint, first_line_no bigint, "
    "statics array<string>, tags array<string>, template string",
    "line_map": "chunk_id bigint, line_no bigint, template_id bigint",
    "tags": "chunk_id bigint, tag string, storage_type string, n bigint, n_distinct bigint, "
    "min_len bigint, max_len bigint, mask string, id_bytes bigint",
    "values": "chunk_id bigint, tag string, line_no bigint, var_no bigint, num bigint, "
    "dict_id bigint, width bigint",
    "dictionary": "chunk_id bigint, tag string, dict_id bigint, value string, n bigint",
}


def read_encoded(spark: SparkSession, path: str) -> Encoded:
    """Encoded tables, also where one of them has no rows and thus no files."""
    return Encoded(
        *[spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in ENCODED_SCHEMAS.items()]
    )


def append_result(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)
