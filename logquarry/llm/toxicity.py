"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding lower-cases, maps look-alike letters to Latin ones, turns digits and signs that
stand for letters back into letters, and reduces everything else to single blanks. Terms
are whole words or beginnings of words. A term inside an exception phrase does not count.
The weights come from labelled documents, the summed weight is normalised by the length
of the text, and a logistic curve fitted on the same documents makes it a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.llm.common import Scratch, arrow_batches, minwise_pair, sliced

# Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i",
    "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ո": "n",
}
# Signs written for letters.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
# Common English insults, the lexicon's start where labels are few.
INSULTS = ("bastard", "clown", "cretin", "disgusting", "dumbass", "garbage", "idiot", "imbecile", "jerk", "loser",
           "moron", "pathetic", "scum", "scumbag", "stupid", "trash", "vermin", "worthless")
# Phrases in which a term is harmless.
EXCEPTIONS = ("garbage can", "garbage collection", "garbage collector", "garbage truck", "clown fish", "idiot proof", "jerk chicken",
              "jerk seasoning", "pond scum", "trash bag", "trash can", "white trash bag", "worthless check")


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the labelled documents that the lexicon and the curve are fitted on."""

    sample: int = 6000
    shortest: int = 3
    longest: int = 8
    least_documents: int = 4
    least_ratio: float = 8.0
    least_z: float = 3.5
    gain: float = 1.15
    start_weight: float = 4.0
    length_power: float = 0.25


@dataclass(frozen=True)
class Model:
    """Terms with weights; a term ends in a blank if it is a whole word. ``curve``: logistic slope and offset."""

    terms: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float] = (2.0, -3.0)
    length_power: float = 0.25
    automata: list = field(default_factory=list, compare=False, repr=False)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "automata"} | {"automata": []}

    def automaton(self) -> ahocorasick.Automaton:
        if not self.automata:
            a = ahocorasick.Automaton()
            for phrase in self.exceptions:
                a.add_word(f" {phrase} ", (len(phrase) + 2, None))
            for term, weight in self.terms.items():
                a.add_word(" " + term, (len(term) + 1, weight))
            a.make_automaton()
            self.automata.append(a)
        return self.automata[0]


_LOWER = str.maketrans(LOOKALIKES)
_SIGN = re.compile(r"(?<=[^\W\d_])[013457@$]+(?=[^\W\d_])|\b[013457@$]+(?=[^\W\d_]{2})|(?<=[^\W\d_]{2})[013457@$]+\b")
_SIGN_MAP = str.maketrans(SIGNS)
_OTHER = re.compile(r"[\W\d_]+")


def fold(text: str) -> str:
    """Lower-case Latin-like words between single blanks, with a blank at each end."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(_LOWER)
    text = _SIGN.sub(lambda m: m[0].translate(_SIGN_MAP), text)
    return f" {_OTHER.sub(' ', text).strip()} "


def matches(model: Model, folded: str) -> tuple[float, int]:
    """Summed weight and number of the words that match, each word once with its heaviest term."""
    excused: list[tuple[int, int]] = []
    found: dict[int, float] = {}
    for end, (length, weight) in model.automaton().iter(folded):
        start = end - length + 1
        if weight is None:
            excused.append((start, end))
        elif weight > found.get(start, 0.0):
            found[start] = weight
    if excused:
        found = {s: w for s, w in found.items() if not any(a <= s < b for a, b in excused)}
    return sum(found.values()), len(found)


def feature(model: Model, folded: str) -> tuple[float, int]:
    weight, hits = matches(model, folded)
    return weight / (1 + folded.count(" ")) ** model.length_power, hits


def _sample(docs: DataFrame, labels: DataFrame, s: Settings) -> DataFrame:
    """A bounded number of labelled documents, with near-equal ones taken once."""
    marked = docs.select("doc_id", "text").join(labels.where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id")
    n = marked.count()
    share = min(1.0, s.sample / max(n, 1))
    drawn = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    schema = pa.schema([("toxic", pa.int32()), ("folded", pa.string()), ("m1", pa.int64()), ("m2", pa.int64())])

    def prepare(batch: pa.RecordBatch) -> dict:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        pairs = [minwise_pair(t.encode(), 3) for t in texts]
        return {
            "toxic": [int(v > 0) for v in batch.column("toxic").to_pylist()],
            "folded": [fold(t) for t in texts],
            "m1": [p[0] for p in pairs],
            "m2": [p[1] for p in pairs],
        }

    rows = drawn.mapInArrow(arrow_batches(prepare, schema), "toxic int, folded string, m1 long, m2 long")
    return rows.dropDuplicates(["m1"]).dropDuplicates(["m2"])


def _terms(folded: str, s: Settings) -> set[str]:
    out: set[str] = set()
    for w in set(folded.split()):
        if s.shortest <= len(w):
            out.add(w + " ")
            out.update(w[:k] for k in range(s.shortest, min(s.longest, len(w)) + 1))
    return out


def _counts(sample: DataFrame, s: Settings) -> DataFrame:
    """Rows (term, toxic documents, clean documents)."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        toxic: Counter[str] = Counter()
        clean: Counter[str] = Counter()
        for f in frames:
            for y, t in zip(f["toxic"], f["folded"], strict=True):
                (toxic if y else clean).update(_terms(t, s))
        # a term that no toxic document of this partition holds still counts as clean
        keys = list(toxic.keys() | clean.keys())
        for at in range(0, len(keys), 100_000):
            part = keys[at : at + 100_000]
            yield pd.DataFrame({"term": part, "a": [toxic[k] for k in part], "b": [clean[k] for k in part]})

    parts = sample.select("toxic", "folded").mapInPandas(count, "term string, a long, b long")
    return parts.groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _choose(counted: list, toxic: int, clean: int, s: Settings) -> dict[str, float]:
    """Terms with a log odds ratio that is large and sure.

    A beginning is taken only if it meets clearly more documents than any one of its longer
    terms, and a longer term beside it only if its ratio is clearly higher.
    """
    scored = {}
    for term, a, b in counted:
        ratio = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))
        z = ratio / math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        if z >= s.least_z and ratio >= math.log(s.least_ratio):
            scored[term] = (ratio, a)
    longer: Counter[str] = Counter()  # documents of the most frequent longer term that begins alike
    for term, (_, a) in scored.items():
        for k in range(s.shortest, len(term)):
            longer[term[:k]] = max(longer[term[:k]], a)
    chosen: dict[str, float] = {}
    for term in sorted(scored, key=len):
        ratio, a = scored[term]
        if a <= s.gain * longer[term]:
            continue
        starts = [chosen[term[:k]] for k in range(s.shortest, len(term)) if term[:k] in chosen]
        if not starts or ratio > max(starts) + 1:
            chosen[term] = ratio
    for w in INSULTS:
        if not any(w[:k] in chosen for k in range(s.shortest, len(w) + 1)):
            chosen.setdefault(w + " ", s.start_weight)
    return chosen


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic regression, by Newton steps with a small ridge."""
    w = np.array([1.0, -2.0])
    design = np.column_stack([x, np.ones_like(x)])
    ridge = np.diag([0.05, 0.05])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - y) + ridge @ w
        hess = design.T @ (design * (p * (1 - p))[:, None]) + ridge
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -2, 2)
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Model:
    """Learn lexicon and curve from ``labels`` (doc_id, toxic) of ``docs`` (doc_id, text).

    Only the label decides; unlabelled documents are ignored. Without labels of both kinds
    the model is the fixed insult list with a fixed curve.
    """
    s = settings or Settings()
    scratch = Scratch(docs.sparkSession)
    sample = scratch.save(_sample(docs, labels, s))
    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(size) < 2:
        scratch.drop(sample)
        return Model({w + " ": s.start_weight for w in INSULTS}, length_power=s.length_power)
    # at most the terms of the bounded sample that toxic documents hold far more often
    frequent = _counts(sample, s).where(
        (F.col("a") >= s.least_documents) & (F.col("a") * size[0] >= F.col("b") * size[1] * s.least_ratio)
    )
    terms = _choose(frequent.collect(), size[1], size[0], s)
    model = Model(terms, length_power=s.length_power)
    schema = pa.schema([("toxic", pa.int32()), ("x", pa.float64())])

    def features(batch: pa.RecordBatch) -> dict:
        return {"toxic": batch.column("toxic"), "x": [feature(model, t)[0] for t in batch.column("folded").to_pylist()]}

    points = sample.select("toxic", "folded").mapInArrow(arrow_batches(features, schema), "toxic int, x double").toPandas()
    scratch.drop(sample)
    y = points["toxic"].to_numpy(dtype=float)
    return Model(terms, curve=_curve(points["x"].to_numpy(), y), length_power=s.length_power)


def _probability(m: Model, texts: list[str | None]) -> tuple[np.ndarray, list[int]]:
    slope, offset = m.curve
    found = [feature(m, fold(t or "")) for t in texts]
    x = np.array([v for v, _ in found], float)
    return 1 / (1 + np.exp(-np.clip(x * slope + offset, -30, 30))), [h for _, h in found]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), predicted (score >= 0.5), hits (matching words) for every row of ``docs``.

    Null and empty texts have no match and get the curve's value at zero.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the labelled sample
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("hits", pa.int32())])

    def rate(batch: pa.RecordBatch) -> dict:
        p, hits = _probability(shared.value, batch.column("text").to_pylist())
        return {"doc_id": batch.column("doc_id"), "score": p, "predicted": (p >= 0.5).astype(np.int32), "hits": hits}

    return docs.select("doc_id", "text").mapInArrow(
        arrow_batches(rate, schema), "doc_id long, score double, predicted int, hits int"
    )


def reject_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows predicted as toxic. Rows are tested where they are read, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            toxic = _probability(shared.value, batch.column(at).to_pylist())[0] >= 0.5
            yield batch.filter(pa.array(~toxic))

    return docs.mapInArrow(keep, docs.schema)
