"""Benchmark passages in documents by spaced-seed hashing; DataFrame functions only.

A seed is a fixed mask over a window of words: the hash of a window takes the selected
words and ignores the others, so a passage with substituted words still meets its item in
the windows whose ignored places hold the substitutions. Short items have masks of their own
length, one for each choice of ignored places. Equal hashes of documents and items are joined, and every hit is verified along its alignment word by word.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.llm.common import Scratch

# The seeds. 1: the word counts, 0: it is ignored.
MASKS = ("11111", "110100101", "1100010011", "101010011")


@dataclass(frozen=True)
class Settings:
    """A leak holds ``percent`` of an item's words in place, or ``run`` of them in a row.

    Items of up to ``short`` words are found by masks of their own length; ``masks`` meet
    every placing of changes in longer ones.
    """

    masks: tuple[str, ...] = MASKS
    percent: int = 80
    run: int = 13
    short: int = 10
    broadcast_rows: int = 2_000_000


def _tokens(text: Column) -> Column:
    """Hashes of the words (runs of letters and digits, in lower case) of a text."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def own_masks(n: int, s: Settings) -> list[tuple[int, str]]:
    """(place, mask) for an item of ``n`` words: as many words ignored as may differ, each choice in turn.

    Ignored words at the ends are no part of the mask, so they may be cut off in a document.
    """
    changes = min(n * (100 - s.percent) // 100, n - 1)
    masks = ["".join("01"[k not in gone] for k in range(n)) for gone in combinations(range(n), changes)]
    return sorted({(m.index("1"), m.strip("0")) for m in masks})


def _seed(toks: Column, at: Column, mask: str) -> Column:
    """Hash of the window that begins at ``at``; null where it passes the end."""
    chosen = [F.get(toks, at + k) for k, c in enumerate(mask) if c == "1"]
    return F.when(at + len(mask) <= F.size(toks), F.xxhash64(F.lit(mask), *chosen))


def _windows(table: DataFrame, masks: list[str]) -> DataFrame:
    """One row for each window and mask: the table's columns, ``at`` and ``seed``."""
    # the outer form keeps the optimizer from deriving a filter that would split the text twice
    placed = table.withColumn("at", F.explode_outer(F.sequence(F.lit(0), F.greatest(F.size("toks") - 1, F.lit(0)))))
    seeds = F.array(*[_seed(F.col("toks"), F.col("at"), m) for m in masks])
    return placed.withColumn("seed", F.explode_outer(seeds)).where("seed IS NOT NULL")


def _index(texts: DataFrame, s: Settings, lengths: list[int]) -> DataFrame:
    """Seeds of the items' texts: seed, no and the place in the text."""
    out = _windows(texts.where(F.size("toks") > s.short), list(s.masks)).select("seed", "no", F.col("at").alias("place"))
    for n in lengths:
        seeds = [F.struct(_seed(F.col("toks"), F.lit(place), mask).alias("seed"), F.lit(place).alias("place")) for place, mask in own_masks(n, s)]
        own = texts.where(F.size("toks") == n).select("no", F.explode(F.array(*seeds)).alias("x"))
        out = out.union(own.select("x.seed", "no", "x.place"))
    return out.distinct()


def few(ids: DataFrame, most: int) -> DataFrame:
    """``ids``, marked to be sent to all tasks if there are no more than ``most``; they are counted, so they should be cheap."""
    return F.broadcast(ids) if ids.count() <= most else ids


def find_leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Items of ``benchmark`` (item_id, text) inside ``docs`` (doc_id, text).

    One row per document and item: doc_id, item_id, item_words, start (word of the document
    at which the item begins; negative if its beginning is cut off), matched (words in place)
    and longest_run, of the best alignment. Null and blank texts on either side give no row; repeated items give
    a row each; repeated doc_ids are taken as one document.
    """
    s = settings or Settings()
    scratch = Scratch(docs.sparkSession)
    items = benchmark.where("item_id IS NOT NULL").select("item_id", _tokens(F.col("text")).alias("toks")).where(F.size("toks") > 0)
    # equal texts are one item until they are found; numbers given on writing stay the same
    texts = scratch.save(items.select("toks").distinct().withColumn("no", F.monotonically_increasing_id()))
    members = scratch.save(items.join(texts, "toks").select("item_id", "no"))
    # at most one number for each short length
    short = [r[0] for r in texts.where(F.size("toks") <= s.short).select(F.size("toks")).distinct().collect()]
    masks = sorted({*s.masks, *(mask for n in short for _, mask in own_masks(n, s))})
    index = scratch.save(_index(texts, s, short))
    parsed = docs.select("doc_id", _tokens(F.col("text")).alias("toks"))
    words = texts.withColumnRenamed("toks", "words")
    if index.count() <= s.broadcast_rows:
        hits = (
            _windows(parsed, masks)
            .join(F.broadcast(index), "seed")
            .select("doc_id", "no", (F.col("at") - F.col("place")).alias("start"), "toks")
            .join(F.broadcast(words), "no")
        )
    else:
        # written once: it says which documents are read again, and where
        starts = scratch.save(
            _windows(parsed, masks)
            .select("doc_id", "at", "seed")
            .join(index, "seed")
            .select("doc_id", "no", (F.col("at") - F.col("place")).alias("start"))
            .distinct()
        )
        met = few(starts.select("doc_id").distinct(), s.broadcast_rows)
        again = docs.select("doc_id", "text").join(met, "doc_id", "left_semi").select("doc_id", _tokens(F.col("text")).alias("toks"))
        hits = starts.join(words, "no").join(again, "doc_id")
    # no step of the alignment loop below looks at words outside the item's place
    same = F.transform(F.col("words"), lambda w, k: F.coalesce(F.get("toks", F.col("start") + k) == w, F.lit(False)))
    runs = F.aggregate(
        "same",
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("best")),
        lambda acc, hit: F.struct(
            F.when(hit, acc["now"] + 1).otherwise(0).alias("now"),
            F.greatest(acc["best"], F.when(hit, acc["now"] + 1).otherwise(0)).alias("best"),
        ),
        lambda acc: acc["best"],
    )
    rated = (
        hits.select("doc_id", "no", "start", F.size("words").alias("item_words"), same.alias("same"))
        .select("doc_id", "no", "start", "item_words", F.size(F.filter("same", lambda x: x)).alias("matched"), runs.alias("longest_run"))
        .where((F.col("matched") * 100 >= s.percent * F.col("item_words")) | (F.col("longest_run") >= s.run))
    )
    best = F.max(F.struct("matched", (-F.col("start")).alias("before"), "longest_run", "item_words"))
    of_text = rated.groupBy("doc_id", "no").agg(best.alias("x"))
    return of_text.join(members, "no").groupBy("doc_id", "item_id").agg(F.max("x").alias("x")).select(
        "doc_id",
        "item_id",
        F.col("x.item_words").cast("bigint").alias("item_words"),
        (-F.col("x.before")).cast("bigint").alias("start"),
        F.col("x.matched").cast("bigint").alias("matched"),
        F.col("x.longest_run").cast("bigint").alias("longest_run"),
    )


def remove_leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    s = settings or Settings()
    leaking = Scratch(docs.sparkSession).save(find_leaks(docs, benchmark, s).select("doc_id").distinct())
    return docs.join(few(leaking, s.broadcast_rows), "doc_id", "left_anti")
