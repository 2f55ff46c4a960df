"""Scores of a parsing result against labelled data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.session import cut_lineage


def align(truth: DataFrame, parsed: DataFrame, keys: list[str], value: str = "template") -> DataFrame:
    """Lines present on both sides: ``(keys, truth, parsed)``."""
    a = truth.select(*keys, F.col(value).alias("truth"))
    return a.join(parsed.select(*keys, F.col(value).alias("parsed")), keys)


def cells(aligned: DataFrame) -> DataFrame:
    """Line counts per (truth, parsed) for a known truth.

    Written once, as every score below reads this small table. Unknown truths are
    dropped here: earlier, the filter would run the template expression a second time.
    """
    counts = cut_lineage(aligned.groupBy("truth", "parsed").agg(F.count(F.lit(1)).alias("n")))
    return counts.filter(F.col("truth").isNotNull())


def _pairs(n):
    return n * (n - 1) / 2


def group_accuracy(cell: DataFrame) -> DataFrame:
    """Share of lines in a parsed group with exactly the lines of one truth group."""
    by_truth = cell.groupBy("truth").agg(F.sum("n").alias("truth_n"))
    by_parsed = cell.groupBy("parsed").agg(F.sum("n").alias("parsed_n"))
    joined = cell.join(by_truth, "truth").join(by_parsed, "parsed")
    same = (F.col("n") == F.col("truth_n")) & (F.col("n") == F.col("parsed_n"))
    return joined.agg(
        F.sum("n").alias("n_lines"),
        F.coalesce(F.sum(F.when(same, F.col("n"))), F.lit(0)).alias("n_accurate"),
    ).withColumn(
        "group_accuracy", F.coalesce(F.try_divide("n_accurate", "n_lines"), F.lit(0.0))
    )


def pairwise_scores(cell: DataFrame) -> DataFrame:
    """Precision, recall and F1 over pairs of lines that share a group; 0 where there is no pair."""
    by_truth = cell.groupBy("truth").agg(F.sum("n").alias("n")).select(F.lit("t").alias("side"), "n")
    by_parsed = cell.groupBy("parsed").agg(F.sum("n").alias("n")).select(F.lit("p").alias("side"), "n")
    both = cell.select(F.lit("b").alias("side"), "n")
    pairs = by_truth.unionByName(by_parsed).unionByName(both)

    def total(side: str):
        return F.coalesce(F.sum(F.when(F.col("side") == side, _pairs(F.col("n")))), F.lit(0.0))

    sums = pairs.agg(total("t").alias("true_pairs"), total("p").alias("parsed_pairs"), total("b").alias("common_pairs"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    scored = sums.withColumn("precision", ratio(F.col("common_pairs"), F.col("parsed_pairs"))).withColumn(
        "recall", ratio(F.col("common_pairs"), F.col("true_pairs"))
    )
    p, r = F.col("precision"), F.col("recall")
    return scored.withColumn("pairwise_f1", ratio(2 * p * r, p + r))


def parsing_accuracy(cell: DataFrame) -> DataFrame:
    """Share of lines whose template is the same text."""
    same = F.sum(F.when(F.col("truth").eqNullSafe(F.col("parsed")), F.col("n")).otherwise(0))
    return cell.agg((same / F.sum("n")).alias("parsing_accuracy"))


def template_accuracy(cell: DataFrame) -> DataFrame:
    """Parsed templates that stand for exactly the truth template of the same text.

    ``pta`` is their share of parsed, ``rta`` of true templates, ``fta`` the harmonic mean.
    """
    parsed = cell.groupBy("parsed").agg(
        (F.min("truth").eqNullSafe(F.max("truth")) & F.min("truth").eqNullSafe(F.col("parsed"))).alias("ok")
    )
    counts = parsed.agg(
        F.count(F.lit(1)).alias("n_parsed"), F.count_if("ok").alias("n_correct")
    )
    truth = cell.agg(F.count_distinct("truth").alias("n_truth")).scalar()
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    scored = (
        counts.withColumn("n_truth", truth)
        .withColumn("pta", ratio(F.col("n_correct"), F.col("n_parsed")))
        .withColumn("rta", ratio(F.col("n_correct"), F.col("n_truth")))
    )
    p, r = F.col("pta"), F.col("rta")
    return scored.withColumn("fta", ratio(2 * p * r, p + r))
