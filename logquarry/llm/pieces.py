"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut into units (a run of blanks with the word after it), which no piece crosses.
Every substring of a unit up to the longest piece is joined with the piece table; the
matches, grouped by unit, are the lattice, and one fold of a higher-order function over it
gives the path. For a model of merges (BPE) the fold is the greedy one that the model
defines: again and again the best-scored edge over exactly two neighbouring pieces is
taken, leftmost first. A fold for the highest total score is there for unigram models.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.llm.common import Scratch, arrow_batches, short_batches

LONGEST_UNIT = 60  # boundaries of a unit are bits of one long
_LAST_RANK = 2**19 - 1
_LETTER = r"[^\W\d_²³¹¼½¾]"
_LATIN = "A-Za-z" + "".join(c for c in map(chr, range(0xC0, 0x250)) if c.isalpha())


@dataclass(frozen=True)
class Pieces:
    """The piece table of a model: text (blanks as blanks), id, score; and the ids of the 256 bytes."""

    rows: tuple[tuple[str, int, float], ...]
    bytes_at: int
    merges: bool = True

    @property
    def longest(self) -> int:
        return max(len(p) for p, _, _ in self.rows)

    def cut(self) -> str:
        """Pattern of the units. Signs that only stand alone in pieces are units of their own."""
        if any(" " in p.lstrip(" ") for p, _, _ in self.rows):
            raise ValueError("a piece goes across the blank before a word")
        joined = {c for p, _, _ in self.rows if len(p) > 1 for c in p}
        alone = "".join(re.escape(chr(c)) for c in [*range(32), 127] if chr(c) not in joined)
        # marks that no piece has behind a letter end the unit before them
        behind = {b for a, b in self.joints() if re.match(_LETTER, a)}
        marks = "".join(re.escape(c) for c in ",.;:!?|%*#&$" if c not in behind)
        ended = rf" *[^ {alone}{marks}]*{_LETTER}(?=[{marks}])|" if marks else ""
        # most words are plain letters alone, which this finds without going back
        plain = f" *[{_LATIN}]+(?![^ {alone}{marks}])|"
        return plain + ended + f" *[^ {alone}]+|[{alone}]| +"

    def joints(self) -> set[str]:
        """Pairs of neighbouring signs in pieces. Between any other two signs a unit may be cut."""
        return {p[i : i + 2] for p, _, _ in self.rows for i in range(len(p) - 1)}


def load(path: str) -> Pieces:
    """Read a model file with byte fallback."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = []
    for i in range(m.get_piece_size()):
        if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
            rows.append((m.id_to_piece(i).replace("▁", " "), i, m.get_score(i)))
    return Pieces(tuple(rows), m.piece_to_id("<0x00>"))


@dataclass(frozen=True)
class Settings:
    """``frequent`` units of a sample of about ``sample`` documents are kept in a broadcast table.

    Which units those are has no influence on the result. All others are looked up by a join.
    """

    frequent: int = 200_000
    sample: int = 10_000
    block_chars: int = 8_000_000


def _edge_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    ranks = {s: k for k, s in enumerate(sorted({s for _, _, s in pieces.rows}, reverse=True))}
    return spark.createDataFrame([(p, i, ranks[s], float(s)) for p, i, s in pieces.rows], "piece string, id int, rank int, score double")


def _packed(rank: Column, at: Column, size: Column, piece_id: Column) -> Column:
    """An edge as one number, in the order of rank and place: rank, 7 bits place, 7 bits size, 30 bits id + 1."""
    part = lambda c, bits: F.shiftleft(c.cast("bigint"), bits)
    return part(rank, 44) + part(at, 37) + part(size, 30) + F.coalesce(piece_id + 1, F.lit(0))


def lattice(units: DataFrame, pieces: Pieces) -> DataFrame:
    """Edges of distinct ``units`` (unit): rows (unit, edges, scores), each edge one number of ``_packed``.

    Edges are in the order of their rank, edges of one sign last. A sign that is no piece
    has an edge without id. ``scores`` holds (edge, score) where the model is no model of merges.
    """
    table = _edge_table(units.sparkSession, pieces)
    n = F.length("unit")
    placed = units.where(n <= LONGEST_UNIT).withColumn("at", F.explode(F.sequence(F.lit(0), n - 1)))
    sized = placed.withColumn("size", F.explode(F.sequence(F.lit(1), F.least(F.lit(pieces.longest), n - F.col("at")))))
    matched = (
        sized.withColumn("piece", F.substring("unit", F.col("at") + 1, F.col("size")))
        .join(F.broadcast(table), "piece", "left")
        .where("id IS NOT NULL OR size = 1")
    )
    edge = _packed(F.when(F.col("size") > 1, F.col("rank")).otherwise(_LAST_RANK), F.col("at"), F.col("size"), F.col("id"))
    edges = F.sort_array(F.collect_list(edge)).alias("edges")
    if pieces.merges:
        return matched.groupBy("unit").agg(edges)
    return matched.groupBy("unit").agg(edges, F.map_from_entries(F.collect_list(F.struct(edge, "score"))).alias("scores"))


def _at(e: Column) -> Column:
    return F.shiftright(e, 37).bitwiseAND(127).cast("int")


def _size(e: Column) -> Column:
    return F.shiftright(e, 30).bitwiseAND(127).cast("int")


def _id(e: Column) -> Column:
    """The piece's id; -1 for a sign that is no piece."""
    return (e.bitwiseAND((1 << 30) - 1) - 1).cast("int")


def _masks(e: Column) -> Column:
    """The edge with bit masks of the boundaries at and within it."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("bigint"), c)
    to = _at(e) + _size(e)
    return F.struct((bit(_at(e)) + bit(to)).alias("ends"), (bit(to) - bit(_at(e) + 1)).alias("inner"), e.alias("edge"))


def _byte_ids(sign: Column, bytes_at: int) -> Column:
    code = F.hex(F.encode(sign, "UTF-8"))
    return F.transform(
        F.sequence(F.lit(1), F.length(code) - 1, F.lit(2)),
        lambda k: (F.conv(F.substring(code, k, F.lit(2)), 16, 10).cast("int") + bytes_at).cast("int"),
    )


def fold_merges(edges: DataFrame, pieces: Pieces) -> DataFrame:
    """Ids of every unit by greedy merging: state is the mask of boundaries that are left."""
    full = F.expr("shiftleft(bigint(1), length(unit) + 1) - 1")

    def merge(state: Column, _: Column) -> Column:
        mask, joins = state["mask"], state["joins"]
        first = F.slice(F.filter(joins, lambda e: F.bit_count(mask.bitwiseAND(e["inner"])) == 1), 1, 1)
        # an edge that has lost an end, or has nothing left to merge, is never taken any more
        live = lambda m: F.filter(joins, lambda e: (m.bitwiseAND(e["ends"]) == e["ends"]) & (m.bitwiseAND(e["inner"]) != 0))
        masks = F.transform(first, lambda e: mask.bitwiseAND(F.bitwise_not(e["inner"])))
        after = F.transform(masks, lambda m: F.struct(m.alias("mask"), live(m).alias("joins")))
        return F.when(F.size(joins) == 0, state).otherwise(F.coalesce(F.get(after, F.lit(0)), state))

    steps = F.sequence(F.lit(1), F.greatest(F.length("unit") - 1, F.lit(1)))
    mask = F.when(F.size("joins") == 0, full).otherwise(F.aggregate(steps, F.struct(full.alias("mask"), F.col("joins").alias("joins")), merge)["mask"])
    left = edges.withColumn("joins", F.transform(F.filter("edges", lambda e: _size(e) > 1), _masks)).withColumn("mask", mask)
    # the mask is bound once; named inside the filter it may be folded again for every edge
    path = F.get(F.transform(F.array("mask"), lambda m: F.filter("edges", lambda e: _on_path(m, e))), F.lit(0))
    return left.select("unit", _path_ids(path, pieces).alias("ids"))


def _on_path(mask: Column, e: Column) -> Column:
    """Whether the edge goes from one boundary of the mask to the next."""
    shift = lambda name, *c: F.call_function(name, *c)
    one = F.lit(1).cast("bigint")
    ends = shift("shiftleft", one, _size(e)) + 1
    return shift("shiftright", mask, _at(e)).bitwiseAND(shift("shiftleft", one, _size(e) + 1) - 1) == ends


def fold_scores(edges: DataFrame, pieces: Pieces) -> DataFrame:
    """Ids of every unit by the highest total score (Viterbi), for models of single scores.

    The state holds the best path to each boundary. A sign that is no piece scores less
    than any piece. Of equal totals the path whose last piece begins first wins.
    """
    lowest = min(s for _, _, s in pieces.rows) - 10
    by_end = F.sort_array(F.transform("edges", lambda e: F.struct((_at(e) + _size(e)).alias("to"), _at(e).alias("at"), e.alias("edge"), F.coalesce(F.try_element_at("scores", e), F.lit(lowest)).alias("score"))))
    best_kind = "array<struct<total:double,before:int,edge:bigint>>"

    def best(state: Column, x: Column) -> Column:
        total = F.get(state, x["at"])["total"] + x["score"]
        now = F.get(state, x["to"])
        new = F.struct(total.alias("total"), x["at"].alias("before"), x["edge"].alias("edge"))
        return (
            F.when(now.isNull(), F.concat(state, F.array(new)))
            .when(total > now["total"], F.concat(F.slice(state, 1, F.size(state) - 1), F.array(new)))
            .otherwise(state)
        )

    start = F.expr(f"CAST(array(named_struct('total', 0D, 'before', -1, 'edge', -1L)) AS {best_kind})")
    back = F.aggregate(
        F.sequence(F.lit(1), F.length("unit")),
        F.struct(F.length("unit").alias("at"), F.array().cast("array<bigint>").alias("taken")),
        lambda acc, _: F.when(acc["at"] <= 0, acc).otherwise(
            F.struct(F.get("states", acc["at"])["before"].alias("at"), F.concat(F.array(F.get("states", acc["at"])["edge"]), acc["taken"]).alias("taken"))
        ),
        lambda acc: acc["taken"],
    )
    solved = edges.withColumn("ordered", by_end).withColumn("states", F.aggregate("ordered", start, best)).withColumn("taken", back)
    return solved.select("unit", _path_ids(F.col("taken"), pieces).alias("ids"))


def _path_ids(path: Column, pieces: Pieces) -> Column:
    """Ids of the edges of a path, in the order of their places."""
    ordered = F.sort_array(F.transform(path, lambda e: F.struct(_at(e).alias("at"), _id(e).alias("id"))))
    return F.flatten(
        F.transform(
            ordered,
            lambda e: F.when(e["id"] < 0, _byte_ids(F.substring(F.col("unit"), e["at"] + 1, F.lit(1)), pieces.bytes_at)).otherwise(F.array(e["id"])),
        )
    )


def merge_long(unit: str, ranks: dict[str, tuple[int, int]], bytes_at: int) -> list[int]:
    """The merging fold for a unit of any length: a queue of neighbouring pairs, best first."""
    text = list(unit)
    after = list(range(1, len(text) + 1))
    before = list(range(-1, len(text) - 1))
    queue: list[tuple[int, int, str]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < len(text):
            both = text[i] + text[j]
            if both in ranks:
                heapq.heappush(queue, (ranks[both][0], i, both))

    for i in range(len(text) - 1):
        offer(i)
    while queue:
        _, i, both = heapq.heappop(queue)
        j = after[i] if text[i] else len(text)
        if j >= len(text) or text[i] + text[j] != both:
            continue
        text[i], text[j] = both, ""
        after[i] = after[j]
        if after[j] < len(text):
            before[after[j]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    out: list[int] = []
    for p in filter(None, text):
        out += [ranks[p][1]] if p in ranks else [bytes_at + b for b in p.encode()]
    return out


def encode_units(units: DataFrame, pieces: Pieces) -> DataFrame:
    """Ids of distinct ``units`` (unit): rows (unit, ids). Units over 60 signs are folded in a batch function."""
    if not pieces.merges:
        if not units.where(F.length("unit") > LONGEST_UNIT).isEmpty():
            raise ValueError(f"units of more than {LONGEST_UNIT} signs need a model of merges")
        return fold_scores(lattice(units, pieces), pieces)
    short = fold_merges(lattice(units, pieces), pieces)
    order = {s: k for k, s in enumerate(sorted({s for _, _, s in pieces.rows}, reverse=True))}
    ranks = {p: (order[s], i) for p, i, s in pieces.rows}
    bytes_at = pieces.bytes_at
    schema = pa.schema([("unit", pa.string()), ("ids", pa.list_(pa.int32()))])
    fold = lambda batch: {"unit": batch.column("unit"), "ids": [merge_long(u, ranks, bytes_at) for u in batch.column("unit").to_pylist()]}
    long = units.where(F.length("unit") > LONGEST_UNIT).mapInArrow(arrow_batches(fold, schema), "unit string, ids array<int>")
    return short.union(long)


def _dealt(units: DataFrame) -> DataFrame:
    """Distinct units, dealt to all tasks: short rows, but much work each."""
    n = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return units.repartition(n, "unit").distinct()


def _frequent(scratch: Scratch, docs: DataFrame, pieces: Pieces, s: Settings) -> list[tuple[str, list[int]]]:
    """The most frequent units of a sample with their ids; at most ``frequent`` of them."""
    share = min(1.0, s.sample / max(docs.count(), 1))
    drawn = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    cut = pieces.cut()

    def units(batches):
        find = re.compile(cut).findall
        for batch in batches:
            count: dict[str, int] = {}
            for t in batch.column("text").to_pylist():
                for u in find(" " + t.replace("▁", " ")) if t else ():
                    count[u] = count.get(u, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.string()), pa.array(count.values(), pa.int64())], names=["unit", "n"])

    counted = drawn.select("doc_id", "text").mapInArrow(units, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    top = scratch.save(counted.where((F.col("n") > 1) & (F.length("unit") <= LONGEST_UNIT)).orderBy(F.desc("n"), "unit").limit(s.frequent))
    # the most frequent first, so that most codes of documents are small numbers
    ranked = encode_units(_dealt(top.select("unit")), pieces).join(top, "unit").orderBy(F.desc("n"), "unit").select("unit", "ids").collect()
    scratch.drop(top)
    return [(r["unit"], list(r["ids"])) for r in ranked]


def _pressed(numbers: np.ndarray) -> bytes:
    """32-bit numbers, all first bytes before all second ones and so on, compressed."""
    planes = np.ascontiguousarray(np.frombuffer(numbers, np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes)


def _unpressed(body: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view(np.int32).ravel()


def _packed_units(batches, rows: int = 300_000):
    """Rows (block, code, ids) as rows (block, body): codes, sizes and ids of many units of a block in one body."""
    held: list[pa.RecordBatch] = []

    def settle():
        block, code = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in (0, 1))
        lists = pa.concat_arrays([b.column(2) for b in held])
        held.clear()
        order = pa.array(np.argsort(block, kind="stable"))
        block, code, lists = block[order], code[order].astype(np.int32), lists.take(order)
        sizes, values = np.diff(lists.offsets.to_numpy()).astype(np.int32), lists.flatten().to_numpy().astype(np.int32)
        first = np.concatenate([[0], np.cumsum(sizes)])
        numbers, starts = np.unique(block, return_index=True)
        ends = [*starts[1:], len(block)]
        bodies = [_pressed(np.concatenate([np.array([b - a], np.int32), code[a:b], sizes[a:b], values[first[a] : first[b]]])) for a, b in zip(starts, ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(bodies, pa.binary())], names=["block", "body"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield settle()
    if held:
        yield settle()


class _Cuts:
    """Cuts units further, between neighbouring signs that no piece holds side by side."""

    between = "\ud800"  # in no text

    def __init__(self, joints: set[str]):
        signs = {c: k + 1 for k, c in enumerate(sorted(set("".join(joints))))}
        self.kind = np.zeros(0x110000, np.uint16)
        self.kind[[ord(c) for c in signs]] = list(signs.values())
        self.joined = np.zeros((len(signs) + 1,) * 2, bool)
        for a, b in joints:
            self.joined[signs[a], signs[b]] = True

    def parts(self, units: list[str]) -> tuple[list[str], np.ndarray]:
        """The parts of all units in a row, and their number in each unit. No unit is empty."""
        if not units:
            return [], np.empty(0, np.int64)
        line = np.frombuffer(self.between.join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind, gap = self.kind[line], line == ord(self.between)
        at = np.flatnonzero(~(self.joined[kind[:-1], kind[1:]] | gap[:-1] | gap[1:])) + 1
        counts = 1 + np.bincount(np.searchsorted(np.flatnonzero(gap), at), minlength=len(units))
        cut = np.insert(line, at, ord(self.between))
        return cut.tobytes().decode("utf-32-le", "surrogatepass").split(self.between), counts


def _gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, where: np.ndarray) -> np.ndarray:
    """The runs (start, size) of ``values`` that ``where`` names, end to end."""
    total = np.concatenate([[0], np.cumsum(sizes[where])])
    out = np.empty(total[-1], np.int32)
    for at in range(0, len(where), 500_000):
        w = where[at : at + 500_000]
        n = sizes[w]
        shift = np.repeat(starts[w] - (np.cumsum(n) - n), n)
        out[total[at] : total[min(at + 500_000, len(where))]] = values[shift + np.arange(len(shift))]
    return out


class _Codes(dict):
    """Numbers of keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = code = len(self)
        return code


def _index_blocks(docs: DataFrame, shared: Broadcast, pieces: Pieces, s: Settings) -> DataFrame:
    """Documents as codes of units, in blocks of bounded size.

    A block has one row with its documents and one row for each unit outside the list ``shared``
    of known ones: block, code, unit; doc_ids, sizes (units of each document), body (their codes).
    Unknown units are cut further, so a block has fewer and shorter ones.
    """
    cut, joints = pieces.cut(), pieces.joints()
    limit = s.block_chars
    schema = pa.schema([("block", pa.int64()), ("code", pa.int32()), ("unit", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("body", pa.binary())])

    def index(batches):
        find = re.compile(cut).findall
        cuts = _Cuts(joints)
        known = len(shared.value)
        number = TaskContext.get().partitionId() << 32
        codes = _Codes(zip(shared.value, range(known), strict=True))
        ids: list[int] = []
        sizes: list[int] = []
        body = array("i")
        chars = 0

        def block():
            # the last codes first: units met in this block give way to their parts
            parts, counts = cuts.parts([codes.popitem()[0] for _ in range(len(codes) - known)][::-1])
            flat = np.concatenate([np.arange(known), [codes[p] for p in parts]]).astype(np.int32)
            counts = np.concatenate([np.ones(known, np.int64), counts])
            met = np.frombuffer(body, np.int32)
            ends = np.concatenate([[0], np.cumsum(counts[met])])[np.cumsum([0, *sizes])]
            cut_body = _gathered(flat, np.cumsum(counts) - counts, counts, met)
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([None], pa.int32()), pa.array([None], pa.string()), pa.array([ids], pa.list_(pa.int64())), pa.array([np.diff(ends)], pa.list_(pa.int32())), pa.array([_pressed(cut_body)], pa.binary())],
                schema=schema,
            )
            for at in range(known, len(codes), 20_000):
                # the last codes first, and each unit is forgotten with its row
                some = [codes.popitem()[0] for _ in range(min(20_000, len(codes) - known))][::-1]
                n, first = len(some), len(codes)
                none = lambda kind, n=n: pa.nulls(n, kind)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, number)), pa.array(np.arange(first, first + n, dtype=np.int32)), pa.array(some, pa.string()), none(pa.list_(pa.int64())), none(pa.list_(pa.int32())), none(pa.binary())],
                    schema=schema,
                )

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                for doc_id, t in zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist(), strict=True):
                    found = find(" " + t.replace("▁", " ")) if t else []
                    body.extend(map(codes.__getitem__, found))
                    ids.append(doc_id)
                    sizes.append(len(found))
                    chars += len(t or "")
                    if chars >= limit:
                        yield from block()
                        number += 1
                        ids, sizes, body, chars = [], [], array("i"), 0
        if ids:
            yield from block()
        pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text").mapInArrow(
        index, "block long, code int, unit string, doc_ids array<long>, sizes array<int>, body binary"
    )


def encode(docs: DataFrame, pieces: Pieces, settings: Settings | None = None) -> DataFrame:
    """Piece ids of every text of ``docs`` (doc_id, text): rows (doc_id, ids array<int>).

    Equal to the model's own encoding with a blank put in front. Null and empty texts have
    no ids. Repeated rows are encoded each. Signs that are no pieces become byte ids.
    """
    s = settings or Settings()
    spark = docs.sparkSession
    scratch = Scratch(spark)
    frequent = _frequent(scratch, docs, pieces, s)
    known = spark.sparkContext.broadcast([u for u, _ in frequent])  # at most Settings.frequent units
    with short_batches(spark):
        indexed = scratch.save(_index_blocks(docs, known, pieces, s))
    known.unpersist()
    rows = indexed.where("code IS NOT NULL").select("block", "code", "unit")
    found = rows.join(encode_units(_dealt(rows.select("unit")), pieces), "unit").select("block", "code", "ids")
    rare = scratch.save(found.mapInArrow(_packed_units, "block long, body binary"))
    scratch.sweep()
    flat = np.array([i for _, ids in frequent for i in ids], np.int32)
    shared = spark.sparkContext.broadcast((np.array([len(ids) for _, ids in frequent], np.int64), flat))
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def assemble(units: pa.Table, blocks: pa.Table) -> pa.Table:
        known_sizes, known_values = shared.value
        known = len(known_sizes)
        codes, rare_sizes, rare_values = [], [], []
        for body in units.column("body"):
            row = _unpressed(body.as_py())
            n = int(row[0])
            codes.append(row[1 : n + 1])
            rare_sizes.append(row[n + 1 : 2 * n + 1])
            rare_values.append(row[2 * n + 1 :])
        sizes = np.concatenate([known_sizes, *rare_sizes]).astype(np.int64)
        values = np.concatenate([known_values, *rare_values]).astype(np.int32)
        starts = np.cumsum(sizes) - sizes
        place = np.arange(len(sizes))
        if codes:
            place[np.concatenate(codes)] = np.arange(known, len(sizes))
        out = []
        for block in blocks.to_batches():
            for doc_ids, counts, body in zip(block.column("doc_ids"), block.column("sizes"), block.column("body"), strict=True):
                where = place[_unpressed(body.as_py())]
                total = np.concatenate([[0], np.cumsum(sizes[where])])
                ends = np.concatenate([[0], np.cumsum(counts.values.to_numpy())])
                flat = _gathered(values, starts, sizes, where)
                lists = pa.ListArray.from_arrays(pa.array(total[ends].astype(np.int32)), pa.array(flat))
                out.append(pa.Table.from_arrays([doc_ids.values, lists], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    blocks = indexed.where("code IS NULL").select("block", "doc_ids", "sizes", "body")
    return rare.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(assemble, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, pieces: Pieces) -> DataFrame:
    """Texts of ``encoded`` (doc_id, ids): rows (doc_id, text). The blank put in front is taken off.

    Ids outside the model and null ids give nothing; bytes that are no UTF-8 give replacement signs.
    """
    table = _decoding_table(pieces)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    join = lambda batch: {"doc_id": batch.column("doc_id"), "text": [_joined(ids.as_py(), table) for ids in batch.column("ids")]}
    return encoded.select("doc_id", "ids").mapInArrow(arrow_batches(join, schema), "doc_id long, text string")


def with_decoded_crc(encoded: DataFrame, pieces: Pieces) -> DataFrame:
    """``encoded`` with n_pieces and text_crc32, the crc32 of the decoded text's UTF-8 bytes."""
    table = _decoding_table(pieces)
    schema = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids", pa.list_(pa.int32())), ("text_crc32", pa.int64())])

    def check(batch: pa.RecordBatch) -> dict:
        ids = batch.column("ids")
        # one document at a time as Python numbers
        rows = ([] if row is None else row.values.to_numpy(zero_copy_only=False).tolist() for row in map(_values, ids))
        found = [(len(row), zlib.crc32(_joined(row, table).encode())) for row in rows]
        return {"doc_id": batch.column("doc_id"), "n_pieces": [n for n, _ in found], "ids": ids, "text_crc32": [c for _, c in found]}

    return encoded.select("doc_id", "ids").mapInArrow(
        arrow_batches(check, schema), "doc_id long, n_pieces long, ids array<int>, text_crc32 long"
    )


def _values(row: pa.ListScalar) -> pa.ListScalar | None:
    return row if row.is_valid else None


def _decoding_table(pieces: Pieces) -> dict[int, bytes]:
    return {i: p.encode() for p, i, _ in pieces.rows} | {pieces.bytes_at + b: bytes([b]) for b in range(256)}


def _joined(ids: list[int] | None, table: dict[int, bytes]) -> str:
    return b"".join([table.get(i, b"") for i in ids or ()]).decode("utf-8", "replace").removeprefix(" ")
