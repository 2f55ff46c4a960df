"""Templates by greedy similarity of word arrays over a whole corpus, in bounded rounds.

Lines become distinct masked word arrays (forms). Forms of one length that fill no more than one
block are clustered at once, in the order of their first line. More forms are sorted, dealt to
blocks of bounded size and clustered block by block; the templates that survive are forms again, are
sorted another way and dealt again, until one block is enough or rounds bring nothing any more.
So no task sees more than a block, and the result does not depend on how lines are cut into chunks.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.functions import tokens as tk
from logquarry.functions.ranks import positions
from logquarry.operators.templates import is_small, words
from logquarry.session import cut_lineage

WILDCARD = "<*>"
CELLS = 1 << 15  # words of a block; its forms are compared with each other
TASK_FORMS = 50_000  # forms clustered by one task
SEPARATOR = r"^(\s+|[:,=])$"


def similarity(template: Column, seq: Column) -> Column:
    """Share of equal words; wildcards of the template count as different."""
    same = F.zip_with(template, seq, lambda a, b: ((a == b) & (a != WILDCARD)).cast("int"))
    return F.aggregate(same, F.lit(0), lambda s, x: s + x) / F.size(template)


def wildcards(template: Column) -> Column:
    return F.size(F.filter(template, lambda w: w == WILDCARD))


def separator_similarity(template: Column, seq: Column) -> Column:
    """As :func:`similarity` with separators left out; -1 where a separator differs."""

    def one(a: Column, b: Column) -> Column:
        sep = a.rlike(SEPARATOR)
        return (
            F.when(a == WILDCARD, 0).when((a == b) & ~sep, 1).when(a == b, 0).when(sep, -1_000_000).otherwise(0)
        )

    total = F.aggregate(F.zip_with(template, seq, one), F.lit(0), lambda s, x: s + x)
    return F.when(total < 0, -1.0).otherwise(total / F.size(template))


def merged(template: Column, seq: Column) -> Column:
    """Words that differ become wildcards."""
    return F.zip_with(template, seq, lambda a, b: F.when(a == b, a).otherwise(F.lit(WILDCARD)))


_AT_ONCE = 256  # rows compared with all clusters at a time
_WILD = 0  # code of a wildcard


def _against(templates: np.ndarray, template_seps: np.ndarray | None, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each template and row: its rank among templates, and whether the row would change the template."""
    width = codes.shape[1]
    fixed = templates != _WILD
    equal = (templates[:, None] == codes[None]) & fixed[:, None]
    alike = equal.sum(axis=2)
    changes = alike < fixed.sum(axis=1)[:, None]
    if template_seps is not None:
        sep = (template_seps & fixed)[:, None]
        alike = (equal & ~sep).sum(axis=2)
        alike[(sep & ~equal).any(axis=2)] = -width
    # most equal words, then most wildcards, then the oldest cluster
    return alike * (width + 1) + (width - fixed.sum(axis=1))[:, None], changes


def _greedy(codes: np.ndarray, seps: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Cluster number of each row of word codes, rows in order, and the templates of the clusters.

    Each row joins the most similar cluster so far. Rows that neither begin a cluster nor change a
    template are taken together, so the steps are those that do.
    """
    n, width = codes.shape
    templates = np.empty_like(codes)
    template_seps = None if seps is None else np.zeros((n, width), dtype=bool)
    own_seps = lambda of: None if seps is None else template_seps[of]
    used, labels = 0, np.empty(n, np.int64)
    for lo in range(0, n, _AT_ONCE):
        part = codes[lo : lo + _AT_ONCE]
        m = len(part)
        ranks, changes = np.empty((used + m, m), np.int64), np.empty((used + m, m), bool)
        best, top = np.zeros(m, np.int64), np.full(m, np.iinfo(np.int64).min)
        if used:
            ranks[:used], changes[:used] = _against(templates[:used], own_seps(slice(used)), part)
            best = ranks[:used].argmax(axis=0)
            top = ranks[best, np.arange(m)]
        i = 0
        while i < m:
            far = top[i:] // (width + 1) / width < threshold
            if used:
                step = far | changes[best[i:], np.arange(i, m)]
                ahead = int(step.argmax()) if step.any() else m - i
                labels[lo + i : lo + i + ahead] = best[i : i + ahead]
                i += ahead
                if i == m:
                    break
                new = far[ahead]
            else:
                new = True
            k = used if new else int(best[i])
            if new:
                templates[k] = part[i]
                if seps is not None:
                    template_seps[k] = seps[lo + i]
                used += 1
            else:
                templates[k][templates[k] != part[i]] = _WILD
            labels[lo + i] = k
            i += 1
            rank, change = _against(templates[k : k + 1], own_seps(slice(k, k + 1)), part[i:])
            rank = rank[0]
            ranks[k, i:], changes[k, i:] = rank, change[0]
            own = (best[i:] == k) & (not new)
            fell = np.flatnonzero(own & (rank < top[i:])) + i
            better = own | (rank > top[i:]) | ((rank == top[i:]) & (k < best[i:]))
            best[i:][better], top[i:][better] = k, rank[better]
            if len(fell):
                best[fell] = ranks[:used, fell].argmax(axis=0)
                top[fell] = ranks[best[fell], fell]
    return labels, templates[:used]


def _block_rows(n_words: Column, cells: int) -> Column:
    return F.greatest(F.lit(2), F.floor(F.lit(cells) / n_words)).cast("bigint")


# ways to sort forms, so that other ones are neighbours in each round
_SORTS = (
    lambda w: F.array_join(w, " "),
    lambda w: F.array_join(F.reverse(w), " "),
    lambda w: F.array_join(F.array_sort(F.filter(w, lambda x: x != WILDCARD)), " "),
)


def _clustered(table: pa.Table, cells: int, threshold: float, separators: bool) -> pa.RecordBatch:
    """``(words, common)`` of whole blocks, whose rows are together and in order."""
    is_sep = re.compile(SEPARATOR).match
    column = table.column("words").combine_chunks()
    known = column.flatten().dictionary_encode()
    words = [WILDCARD, *known.dictionary.to_pylist()]
    codes = known.indices.to_numpy().astype(np.int32) + 1
    if WILDCARD in words[1:]:
        codes[codes == words.index(WILDCARD, 1)] = _WILD
    seps = np.array([bool(is_sep(w)) for w in words])[codes] if separators else None
    out = np.empty_like(codes)
    width, block = table.column("n_words").to_numpy(), table.column("block").to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], (width[1:] != width[:-1]) | (block[1:] != block[:-1])]))
    at = 0
    for start, end in zip(starts, [*starts[1:], len(width)], strict=True):
        w = int(width[start])
        assert end - start <= max(2, cells // w)
        size = (end - start) * w
        shape = lambda v: v[at : at + size].reshape(-1, w)  # noqa: B023, E731
        labels, templates = _greedy(shape(codes), None if seps is None else shape(seps), threshold)
        out[at : at + size] = templates[labels].ravel()
        at += size
    sizes = np.concatenate([[0], np.cumsum(width)]).astype(np.int32)
    common = pa.ListArray.from_arrays(pa.array(sizes), pa.array(words, pa.string()).take(pa.array(out)))
    return pa.RecordBatch.from_arrays([column, common], names=["words", "common"])


def _round(forms: DataFrame, n_forms: int, sort, cells: int, threshold: float, separators: bool) -> DataFrame:
    """``(words, common)``: the template of each form (words, n_words, at, size) in its block."""

    def cluster(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            width, block = held.column("n_words").to_numpy(), held.column("block").to_numpy()
            # the last block may go on in the next batch
            whole = np.flatnonzero((width != width[-1]) | (block != block[-1])) if len(width) else ()
            if len(whole):
                yield _clustered(held.slice(0, whole[-1] + 1).combine_chunks(), cells, threshold, separators)
                held = held.slice(whole[-1] + 1)
        if held is not None and held.num_rows:
            yield _clustered(held.combine_chunks(), cells, threshold, separators)

    ordered = forms.withColumn("sort", sort(F.col("words")))
    ranked = positions(ordered, ["n_words"], ["sort", "at"])
    one = F.col("size") <= _block_rows(F.col("n_words"), cells)
    block = F.when(one, F.lit(0).cast("bigint")).otherwise(F.floor(F.col("pos") / _block_rows(F.col("n_words"), cells)))
    dealt = ranked.select("words", "n_words", block.alias("block"), "at.chunk_id", "at.line_no")
    tasks = max(forms.sparkSession.sparkContext.defaultParallelism, -(-n_forms // TASK_FORMS))
    in_order = dealt.repartition(tasks, "n_words", "block").sortWithinPartitions("n_words", "block", F.asc_nulls_last("chunk_id"), F.asc_nulls_last("line_no"))
    return in_order.select("words", "n_words", "block").mapInArrow(cluster, "words array<string>, common array<string>")


def _composed(rounds: list[DataFrame]) -> DataFrame:
    """``(words, common)`` of the first round, with what the later ones made of its templates.

    A form of a later round is a template of the one before, so the way from behind leaves the first
    and largest table to the last join.
    """
    found = rounds[-1]
    for named in reversed(rounds[:-1]):
        step = found.select(F.col("words").alias("common"), F.col("common").alias("next"))
        small = is_small(step.select(F.array_join(F.concat("common", "next"), " ").alias("t")), "t")
        found = named.join(F.broadcast(step) if small else step, "common", "left").select("words", F.coalesce("next", "common").alias("common"))
    return found


def _mine(distinct: DataFrame, threshold: float, separators: bool, glue: str, cells: int) -> DataFrame:
    """Templates of ``distinct`` (chunk_id, words, n, first_line_no)."""
    distinct = cut_lineage(distinct)
    at = F.min(F.struct("chunk_id", F.col("first_line_no").alias("line_no"))).alias("at")
    forms = cut_lineage(distinct.groupBy("words").agg(at).withColumn("n_words", F.size("words")))
    rounds: list[DataFrame] = []
    before: dict[int, list[int]] = {}
    turn = 0
    while True:
        # one row for each length of a line
        sizes = {r["n_words"]: r["n"] for r in forms.groupBy("n_words").agg(F.count(F.lit(1)).alias("n")).collect()}
        todo = {}
        for k, n in sizes.items():
            seen = before.setdefault(k, [])
            if n == 1 or (seen and seen[-1] <= max(2, cells // k)):
                continue  # alone, or all of them met in the last round
            if len(seen) >= len(_SORTS) and n > 0.9 * seen[-len(_SORTS)]:
                continue  # no way of sorting brings much any more
            todo[k] = n
            seen.append(n)
        if not todo:
            break
        size = F.create_map(*[F.lit(x) for pair in todo.items() for x in pair])
        open_forms = forms.where(F.col("n_words").isin(list(todo))).withColumn("size", size[F.col("n_words")].cast("bigint"))
        named = cut_lineage(_round(open_forms, sum(todo.values()), _SORTS[turn % len(_SORTS)], cells, threshold, separators))
        rounds.append(named)
        merged_forms = forms.join(named, "words").groupBy(F.col("common").alias("words")).agg(F.min("at").alias("at"))
        rest = forms.where(~F.col("n_words").isin(list(todo))).select("words", "at")
        forms = cut_lineage(rest.union(merged_forms).withColumn("n_words", F.size("words")))
        turn += 1
    if not rounds:
        return distinct.select("chunk_id", "words", F.array_join("words", glue).alias("template"), "n")
    named = _composed(rounds).select("words", F.array_join("common", glue).alias("template"))
    template = F.coalesce("template", F.array_join("words", glue)).alias("template")
    return distinct.join(named, "words", "left").select("chunk_id", "words", template, "n")


def similarity_templates(
    lines: DataFrame, threshold: float = 0.5, masks: list[str] | None = None, text: str = "line", cells: int = CELLS
) -> DataFrame:
    """``(chunk_id, words, template, n)``: the template of every distinct word array of a chunk.

    An event has one template in the whole corpus. A block holds at most ``cells`` words, and two forms
    at least. Forms of a length that still fill several blocks when sorting them anew merges less
    than a tenth of them keep the templates they have.
    """
    distinct = (
        lines.select("chunk_id", "line_no", words(tk.mask_patterns(F.col(text), masks or [])).alias("words"))
        .filter(F.size("words") > 0)
        .groupBy("chunk_id", "words")
        .agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line_no"))
    )
    return _mine(distinct, threshold, False, " ", cells)


def separator_templates(lines: DataFrame, threshold: float = 0.1, text: str = "line", cells: int = CELLS) -> DataFrame:
    """The variant that keeps separators as words and masks numbers and addresses first."""
    parts = tk.mask_number_tokens(tk.separator_tokens(F.trim(text)))
    distinct = (
        lines.select("chunk_id", "line_no", parts.alias("words"))
        .filter(F.size("words") > 0)
        .groupBy("chunk_id", "words")
        .agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line_no"))
    )
    return _mine(distinct, threshold, True, "", cells)


def template_totals(mined: DataFrame) -> DataFrame:
    """One row per template over all chunks."""
    return mined.groupBy("template").agg(F.sum("n").alias("n_lines")).withColumn(
        "event_id", tk.event_id(F.col("template"))
    )
