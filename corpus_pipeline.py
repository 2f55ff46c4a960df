"""Five stages that turn ``documents`` into encoded training text.

Each stage works on all that the one before kept, written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.llm import decontam, neardup, pieces, secret_tags, toxicity
from logquarry.llm.common import Scratch, read_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
PIECES_MODEL = "/opt/tokenizers/piece_bpe_32k.model"

# No SQL: the scores, the tagger and the encoding cannot be said in it.
ORACLE_SQL: str | None = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon model does not reject. Labels teach the model and decide nothing else."""
    return toxicity.reject_toxic(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group on five-word shingles at similarity 0.8."""
    return neardup.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.remove_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced and n_chars counted again."""
    hidden = secret_tags.hide_secrets(docs, secret_tags.fit(docs))
    if "n_chars" in docs.columns:
        hidden = hidden.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return hidden


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as piece ids, with the checksum of the text decoded from them."""
    model = pieces.load(PIECES_MODEL)
    return pieces.with_decoded_crc(pieces.encode(docs, model), model)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_leaks),
    ("secret_scans", hide_secrets),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; what a stage keeps is written to the shared folder."""
    scratch = Scratch(spark)
    docs = read_table(spark, sf_dir, "documents")
    last = None
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
        scratch.drop(last)
        last = docs
    return docs
