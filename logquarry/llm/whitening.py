"""Whitening of vectors from an exact, bit-sliced scatter matrix.

Entries become integers ``floor(64 c)`` (a constant added to all, such as 1000000, changes nothing below). A task takes the smallest value of each
dimension off, cuts what is left into bit planes and packs every plane over its rows into
64-bit words. The popcount of two planes' AND, weighted by the planes' places, is their share of a
cross-product, so the products of all dimensions are exact integers; Spark adds them up as decimals.
They are centred as integers (``n * sum(x y) - sum(x) sum(y)``) and only then turned into doubles for
the eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.llm.common import Scratch

SCALE = 64
LARGEST = 2.0**44  # entries are held to this after scaling, so that products fit a decimal of 38 digits
COMPONENTS = 32
ROWS = 16_384  # packed at once; a popcount times its weight then fits 63 bits up to 24 planes
MODEL_BYTES = 64 << 20  # of models sent to tasks at once
_FLAT = 1e-12  # eigenvalues below this share of the largest one are rounding


def scaled(vectors: np.ndarray) -> np.ndarray:
    """``floor(64 c)`` as integers."""
    return np.floor(np.clip(vectors.astype(float) * SCALE, -LARGEST, LARGEST)).astype(np.int64)


def _planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed bit planes (plane, word) of non-negative columns, and the first plane of each column."""
    n, dims = y.shape
    counts = np.maximum(1, [int(m).bit_length() for m in y.max(axis=0)])
    first = np.concatenate([[0], np.cumsum(counts)])
    words = np.zeros((first[-1], -(-n // 64)), np.uint64)
    bits = np.zeros((-(-n // 64) * 64), np.uint8)
    for d in range(dims):
        for p in range(counts[d]):
            bits[:n] = y[:, d] >> p & 1
            words[first[d] + p] = np.packbits(bits, bitorder="little").view(np.uint64)
    return words, first


def cross_products(x: np.ndarray) -> np.ndarray:
    """Exact sums of products of all pairs of columns of integers, as an array of Python integers."""
    n, dims = x.shape
    low = x.min(axis=0)
    words, first = _planes(x - low)
    place = np.concatenate([np.arange(b - a) for a, b in zip(first, first[1:], strict=False)])
    small = place.max() < 24 and n <= ROWS
    weight = (np.int64(1) << place) if small else np.array([1 << int(p) for p in place], object)
    cross = np.zeros((dims, dims), np.int64 if small else object)
    for d in range(dims):
        for k in range(first[d], first[d + 1]):
            both = np.bitwise_count(words[first[d] :] & words[k]).sum(axis=1, dtype=np.int64)
            by_dim = np.add.reduceat(both * weight[first[d] :], first[d:-1] - first[d])
            cross[d, d:] += by_dim * weight[k]
    cross = cross.astype(object)
    cross += np.triu(cross, 1).T
    # back from the shifted values to those given
    low, sums = low.astype(object), (x - low).astype(object).sum(axis=0) if not small else (x - low).sum(axis=0).astype(object)
    return cross + np.outer(low, sums) + np.outer(sums, low) + n * np.outer(low, low)


def _usable(column: pa.Array) -> pa.Array:
    """Which vectors are there and hold only finite numbers."""
    flat, of = pc.list_flatten(column), pc.list_parent_indices(column)
    bad = pc.fill_null(pc.invert(pc.is_finite(flat.cast(pa.float64()))), True)
    ok = np.ones(len(column), bool)
    ok[of.filter(bad).to_numpy(zero_copy_only=False)] = False
    return pa.array(ok & column.is_valid().to_numpy(zero_copy_only=False))


def _by_length(batch: pa.RecordBatch, vector: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each length: the rows that have it, and their integers. Empty vectors have no dimension."""
    column = batch.column(vector)
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    ok = _usable(column).to_numpy(zero_copy_only=False)
    for length in np.unique(lengths[ok & (lengths > 0)]):
        at = np.flatnonzero(ok & (lengths == length))
        values = pc.list_flatten(column.take(pa.array(at))).cast(pa.float64()).to_numpy(zero_copy_only=False)
        yield int(length), at, scaled(values.reshape(-1, length))


def scatter(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows (length, i, j, value): exact sums of products for i <= j, sums for j = -1, the count at (-1, -1).

    Vectors of each length are a fit list of their own. A task holds one matrix of a length at a time.
    """
    schema = pa.schema([("length", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("value", pa.decimal128(38, 0))])

    def rows(length: int, n: int, sums: np.ndarray, cross: np.ndarray) -> pa.RecordBatch:
        i, j = np.triu_indices(length)
        values = [*cross[i, j].tolist(), *sums.tolist(), n]
        i, j = [*i, *range(length), -1], [*j, *[-1] * length, -1]
        columns = [[length] * len(i), i, j, [Decimal(v) for v in values]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches):
        kept: dict[int, list] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                for length, _, x in _by_length(batch.slice(start, ROWS), vector):
                    if length not in kept and sum(k * k for k in kept) + length * length > 4_000_000:
                        for k, v in kept.items():
                            yield rows(k, *v)
                        kept = {}
                    now = kept.setdefault(length, [0, np.zeros(length, object), np.zeros((length, length), object)])
                    now[0] += len(x)
                    now[1] += x.sum(axis=0).astype(object) if len(x) < 1 << 18 else x.astype(object).sum(axis=0)
                    now[2] += cross_products(x)
        for k, v in kept.items():
            yield rows(k, *v)

    found = vectors.select(vector).mapInArrow(run, "length int, i int, j int, value decimal(38,0)")
    return found.groupBy("length", "i", "j").agg(F.sum("value").cast("decimal(38,0)").alias("value"))


def _eigen(components: int):
    """For one length: its model from the sums of products."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        length = int(rows["length"].iloc[0])
        sums, cross, n = np.zeros(length, object), np.zeros((length, length), object), 0
        for i, j, v in zip(rows["i"], rows["j"], rows["value"], strict=True):
            if i < 0:
                n = int(v)
            elif j < 0:
                sums[i] = int(v)
            else:
                cross[i, j] = cross[j, i] = int(v)
        centred = n * cross - np.outer(sums, sums)  # n squared times the covariance, exact
        v = np.array([[c / (n * n) for c in row] for row in centred.tolist()], float)
        trace = int(np.trace(centred)) / (n * n)
        values, turned = np.linalg.eigh(v)
        values, turned = values[::-1][:components], turned[:, ::-1][:, :components]
        real = values > _FLAT * max(values[0], 0)
        scale = np.where(real, 1 / np.sqrt(np.where(real, values, 1)), 0.0)
        explained = np.where(real, values / trace if trace else 0.0, 0.0)
        return pd.DataFrame(
            {
                "length": [length], "n": [n], "sums": [[Decimal(int(s)) for s in sums]],
                "turn": [np.ascontiguousarray(turned * scale).tobytes()], "explained": [explained.tolist()],
            }
        )

    return fit


_MODEL = "length int, n long, sums array<decimal(38,0)>, turn binary, explained array<double>"


def _project(vectors: DataFrame, key: str, vector: str, models: dict[int, tuple], emit, schema: pa.Schema, types: str) -> DataFrame:
    """``emit(key column of the rows, x, n, sums, whitened, explained)`` gives the columns for each batch and length."""

    def run(batches):
        for batch in batches:
            for length, at, x in _by_length(batch, vector):
                if length in models:
                    n, sums, turn, explained = models[length]
                    q, r = sums // n, np.array([int(s % n) / n for s in sums])
                    centred = (x - q.astype(np.int64)) - r  # integers first, so that nothing is lost
                    columns = emit(batch.column(key).take(pa.array(at)), x, n, sums, centred @ turn, explained, length)
                    yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name] for f in schema], schema=schema)

    return vectors.select(F.col(key).cast("long").alias(key), vector).mapInArrow(run, types)


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> list:
    """Exact sums of (n x - S) squared."""
    low, high = x.min(axis=0).astype(object), x.max(axis=0).astype(object)
    most = sum(max(abs(n * a - s), abs(n * b - s)) ** 2 for a, b, s in zip(low, high, sums, strict=True))
    if most < 1 << 63:
        d = n * x - sums.astype(np.int64)
        return (d * d).sum(axis=1).tolist()
    d = n * x.astype(object) - sums
    return (d * d).sum(axis=1).tolist()


def _moments(key: pa.Array, x, n, sums, w, explained, length) -> dict:
    """Mean and centred products of the whitened rows of a batch."""
    mean = w.mean(axis=0)
    centred = w - mean
    a, b = np.triu_indices(w.shape[1])
    return {
        "length": [length] * len(a), "a": a, "b": b, "rows": [len(w)] * len(a), "m2": (centred.T @ centred)[a, b],
        "mean_a": mean[a], "mean_b": mean[b],
    }


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per usable vector and component (from 1 by falling eigenvalue): key, component, n, deviation, whitened,
    explained, identity_error.

    Vectors that are null, empty or hold null or non-finite entries have no row; vectors of each length
    are whitened on their own, with at most ``components`` or as many components as they have dimensions.
    Repeated keys and vectors are rows like others; a null key stays null. Components without variance (one
    row, or all rows in fewer directions) have whitened 0 and explained 0, and then identity_error is 1.
    ``deviation`` is exact, and null where it does not fit a long. Entries beyond 2**38 count as 2**38.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    fitted = scratch.save(scatter(vectors, vector).groupBy("length").applyInPandas(_eigen(components), _MODEL))
    out = None
    # distinct lengths are few and bounded by the longest vector; their models go out by bounded shares
    groups: list[list[int]] = [[]]
    size = 0
    for (length,) in fitted.select("length").orderBy("length").collect():
        if groups[-1] and size + 8 * length * components > MODEL_BYTES:
            groups.append([])
            size = 0
        groups[-1].append(length)
        size += 8 * length * components
    for group in groups:
        models = {}
        for r in fitted.where(F.col("length").isin(group)).collect():
            sums = np.array([int(s) for s in r["sums"]], object)
            models[r["length"]] = (r["n"], sums, np.frombuffer(bytes(r["turn"])).reshape(r["length"], -1), np.array(r["explained"]))
        part = _whitened(scratch, vectors, key, vector, models)
        out = part if out is None else out.union(part)
    return out


def _whitened(scratch: Scratch, vectors: DataFrame, key: str, vector: str, models: dict[int, tuple]) -> DataFrame:
    of = [("length", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("rows", pa.int64())]
    schema = pa.schema([*of, *[(c, pa.float64()) for c in ("m2", "mean_a", "mean_b")]])
    types = "length int, a int, b int, rows long, m2 double, mean_a double, mean_b double"
    moments = _project(vectors, key, vector, models, _moments, schema, types)
    n = F.sum("rows")
    mean = lambda c: F.sum(F.col("rows") * F.col(c)) / n
    within = F.sum(F.col("m2") + F.col("rows") * F.col("mean_a") * F.col("mean_b")) / n - mean("mean_a") * mean("mean_b")
    cov = moments.groupBy("length", "a", "b").agg(within.alias("cov"))
    errors = cov.groupBy("length").agg(F.max(F.abs(F.col("cov") - (F.col("a") == F.col("b")).cast("double"))).alias("e"))
    error = {r["length"]: r["e"] for r in errors.collect()}

    def emit(keys: pa.Array, x, n, sums, w, explained, length) -> dict:
        k = w.shape[1]
        exact = [d if d < 1 << 63 else None for d in _deviation(x, n, sums)]
        each = pa.array(np.repeat(np.arange(len(x)), k))
        return {
            key: keys.take(each), "component": np.tile(np.arange(1, k + 1), len(x)), "n": np.full(len(x) * k, n),
            "deviation": pa.array(exact, pa.int64()).take(each), "whitened": w.ravel(), "explained": np.tile(explained, len(x)),
            "identity_error": np.full(len(x) * k, error[length]),
        }

    out = pa.schema([
        (key, pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
        ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64()),
    ])
    types = f"{key} long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return _project(vectors, key, vector, models, emit, out, types)
