"""Token ids of a corpus in a compact binary form, and back.

Ids are ranked by their frequency in the whole corpus, so the common ones are small, and a
rank takes one to four bytes. The lengths are kept apart from the data, two bits a rank, so
a reader decodes many ranks at once by looking lengths up in a table.

A segment is one binary value: ``FVB1``, number of documents (u32), number of ids (u64),
document ids (i64 each), ids of each document (u32 each), control bytes (one for four ids),
data bytes; all little-endian. Segments lie in order in a Parquet table with ``part``
(output partition) and ``before`` (ids of the part in front of the segment). ``ranks``
holds the ids by rank, ``parts`` the ids in front of each part.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.llm.common import Scratch

MAGIC = b"FVB1"
_HEAD = "<4sIQ"
#: Lengths of the four values that a control byte describes.
_LENGTHS = ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3).astype(np.uint8) + 1


@dataclass(frozen=True)
class Settings:
    """``end_id`` closes each document. A worker remembers at most ``remembered`` encoded chunks."""

    end_id: int = 0
    segment_ids: int = 1_000_000
    remembered: int = 1_000_000


def pack(ranks: np.ndarray) -> bytes:
    """Control bytes, then data bytes, of non-negative 32-bit numbers."""
    r = np.ascontiguousarray(ranks, dtype="<u4")
    more = ((r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)).astype(np.uint8)
    padded = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    padded[: len(r)] = more
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    data = r.view(np.uint8).reshape(-1, 4)[np.arange(4) <= more[:, None]]
    return control.tobytes() + data.tobytes()


def unpack(packed: bytes | memoryview, n: int) -> np.ndarray:
    """The ``n`` numbers that ``pack`` wrote."""
    controls = -(-n // 4)
    raw = np.frombuffer(packed, np.uint8)
    size = _LENGTHS[raw[:controls]].ravel()[:n]
    data = raw[controls:]
    at = np.cumsum(size, dtype=np.int64) - size
    out = data[at].astype(np.uint32) if n else np.empty(0, np.uint32)
    for k in (1, 2, 3):
        longer = np.nonzero(size > k)[0]
        if not len(longer):
            break
        out[longer] |= data[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


_ODD = re.compile(r" (?:\s|[\x1c-\x1f]|$)")
_ODD_ASCII = [" " + c for c in " \n\t\r\x0b\x0c\x1c\x1d\x1e\x1f"]


def _odd(text: str) -> bool:
    """Whether a blank has a blank or the end behind it."""
    if text.isascii():
        return text.endswith(" ") or any(c in text for c in _ODD_ASCII)
    return _ODD.search(text) is not None


def chunks(text: str) -> tuple[str, list[str]]:
    """The text cut before each blank that a visible sign follows: the first part, and the others without that blank.

    The tokenizer's own pattern always starts a token at such a blank, so the parts can be
    encoded one by one.
    """
    first, *rest = text.split(" ")
    if rest and _odd(text):
        joined: list[str] = []
        for part in rest:
            if part and not part[0].isspace():
                joined.append(part)
            elif joined:
                joined[-1] += " " + part
            else:
                first += " " + part
        return first, joined
    return first, rest


# signs that the tokenizer's pattern cuts only where letters, digits, marks and line ends meet
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ʯ", r"!-&(-/:-@\[-`{-~"
_REGULAR = re.compile(rf"[{_LETTERS}0-9{_MARKS}]+(?:\n[{_LETTERS}0-9{_MARKS}]+)*")
_PART = re.compile(rf"[{_LETTERS}]+|[0-9]+|[{_MARKS}]+|\n")


def _byte_signs() -> dict[int, str]:
    """The sign that byte-level merges have for each byte outside the visible ones, which stand for themselves."""
    hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
    return {b: chr(256 + k) for k, b in enumerate(hidden)}


_SIGNS = _byte_signs()


class Encoder:
    """The library's tokenizer with a bounded memory of chunks that it has encoded."""

    def __init__(self, path: str, remembered: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.merge = self.tokenizer.model.tokenize
        self.remembered = remembered
        self.known = _Remembered(self._chunk)
        self.parts = _Remembered(self._part)

    def _raw(self, parts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _part(self, part: str) -> bytes:
        """Ids of what the tokenizer's pattern never cuts, by the library's merges alone."""
        if part[1:].isascii() and part[0] == " ":
            signs = "Ġ" + part[1:]
        else:
            signs = part.encode().decode("latin-1").translate(_SIGNS)
        return array("I", [t.id for t in self.merge(signs)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a chunk with its blank in front, part by part where it is regular."""
        if not _REGULAR.fullmatch(chunk):
            return self._raw([" " + chunk])[0]
        first, *rest = _PART.findall(chunk)
        if not rest:
            return self._part(" " + first)
        return self.known[first] + b"".join(map(self.parts.__getitem__, rest))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        cut = [chunks(t) for t in texts]
        known = self.known
        heads = self._raw([first for first, _ in cut])
        out = [head + b"".join(map(known.__getitem__, rest)) for head, (_, rest) in zip(heads, cut, strict=True)]
        if len(self.parts) > self.remembered // 4:
            self.parts.clear()
        if len(known) > self.remembered:
            # what was met first is mostly what is frequent
            for p in list(islice(reversed(known), len(known) - self.remembered // 2)):
                del known[p]
        return out


class _Remembered(dict):
    """Values of a function, made when first asked for."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        self[key] = made = self.make(key)
        return made


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def _encoder(path: str, remembered: int) -> Encoder:
    """One encoder for all tasks of a worker process."""
    if (path, remembered) not in _ENCODERS:
        _ENCODERS[path, remembered] = Encoder(path, remembered)
    return _ENCODERS[path, remembered]


def _raw_segments(docs: DataFrame, path: str, s: Settings) -> DataFrame:
    """Segments of plain ids in ascending order of doc_id: part, before, n_ids, doc_ids, sizes, body."""
    schema = pa.schema(
        [("part", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("body", pa.binary())]
    )
    end = np.array([s.end_id], "<u4").tobytes()

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, s.remembered)
        press = zstandard.ZstdCompressor(level=1)
        part, before = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        parts: list[bytes] = []

        def segment() -> pa.RecordBatch:
            nonlocal before
            n = sum(map(len, parts)) // 4
            planes = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 4).T
            row = [[part], [before], [n], [ids], [[len(p) // 4 for p in parts]], [press.compress(np.ascontiguousarray(planes).tobytes())]]
            before += n
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                for doc_id, raw in zip(some.column("doc_id").to_pylist(), encoder.encode([t or "" for t in some.column("text").to_pylist()]), strict=True):
                    ids.append(doc_id)
                    parts.append(raw + end)
                if sum(map(len, parts)) >= 4 * s.segment_ids:
                    yield segment()
                    ids, parts = [], []
        if ids:
            yield segment()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(tokenize, "part int, before long, n_ids long, doc_ids array<long>, sizes array<int>, body binary")


def _plain(body: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _rank_ids(raw: DataFrame) -> np.ndarray:
    """All ids that occur, the most frequent first; at most as many as the vocabulary has."""

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for body in batch.column("body"):
                n = np.bincount(_plain(body.as_py()))
                if len(n) > len(total):
                    total = np.concatenate([total, np.zeros(len(n) - len(total), np.int64)])
                total[: len(n)] += n
        seen = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    counted = raw.select("body").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rows = sorted(((-r["n"], r["id"]) for r in counted.collect()))
    return np.array([i for _, i in rows], np.uint32)


def write_ids(docs: DataFrame, tokenizer_path: str, out: str, settings: Settings | None = None) -> None:
    """Encode every text of ``docs`` (doc_id, text) and write segments, ranks and parts under ``out``.

    Null texts are empty; every row gets its end id. Rows are in ascending order of doc_id,
    null first, repeated ones by text.
    """
    s = settings or Settings()
    spark = docs.sparkSession
    scratch = Scratch(spark)
    raw = scratch.save(_raw_segments(docs, tokenizer_path, s))
    ids = _rank_ids(raw)
    spark.createDataFrame([(int(i), k) for k, i in enumerate(ids)], "id long, rank long").write.parquet(f"{out}/ranks")
    # one row for each output partition
    sizes = raw.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    starts, total = [], 0
    for r in sizes:
        starts.append((r["part"], total))
        total += r["n"]
    spark.createDataFrame(starts, "part int, offset long").write.parquet(f"{out}/parts")
    rank_of = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.uint32)
    rank_of[ids] = np.arange(len(ids), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank_of)  # at most one number for each id of the vocabulary
    schema = pa.schema([("part", pa.int32()), ("before", pa.int64()), ("segment", pa.binary())])

    def encode(batches):
        for batch in batches:
            made = []
            for doc_ids, counts, body in zip(batch.column("doc_ids").to_pylist(), batch.column("sizes").to_pylist(), batch.column("body").to_pylist(), strict=True):
                plain = _plain(body)
                # a null doc_id is written as the least number
                keys = np.array([-(2**63) if i is None else i for i in doc_ids], "<i8")
                made.append(struct.pack(_HEAD, MAGIC, len(keys), len(plain)) + keys.tobytes() + np.array(counts, "<u4").tobytes() + pack(shared.value[plain]))
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("before"), pa.array(made, pa.binary())], schema=schema)

    raw.mapInArrow(encode, "part int, before long, segment binary").write.option("compression", "none").parquet(f"{out}/segments")
    scratch.drop(raw)


def read_segment(segment: bytes, id_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, ids of each document, and all ids of one segment."""
    magic, n_docs, n_ids = struct.unpack_from(_HEAD, segment)
    if magic != MAGIC:
        raise ValueError("not a segment of token ids")
    at = struct.calcsize(_HEAD)
    doc_ids = np.frombuffer(segment, "<i8", n_docs, at)
    sizes = np.frombuffer(segment, "<u4", n_docs, at + 8 * n_docs)
    return doc_ids, sizes, id_of[unpack(memoryview(segment)[at + 12 * n_docs :], n_ids)]


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Documents of a written corpus: doc_id, start (ids in front), n_tokens, ids_crc32, and ids if asked for."""
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    id_of = np.array([r["id"] for r in ranks] or [0], np.uint32)
    offsets = {r["part"]: r["offset"] for r in spark.read.parquet(f"{path}/parts").collect()}
    shared = spark.sparkContext.broadcast((id_of, offsets))  # the vocabulary, and a number for each output partition
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int64()))] * with_ids)

    def decode(batches):
        table, offset = shared.value
        for batch in batches:
            for part, before, segment in zip(batch.column("part").to_pylist(), batch.column("before").to_pylist(), batch.column("segment").to_pylist(), strict=True):
                doc_ids, sizes, ids = read_segment(segment, table)
                ends = np.cumsum(sizes, dtype=np.int64)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                columns = [pa.array(doc_ids, mask=doc_ids == -(2**63)), pa.array(ends - sizes + before + offset[part]), pa.array(sizes.astype(np.int64)), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    kinds = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return spark.read.parquet(f"{path}/segments").mapInArrow(decode, kinds)
