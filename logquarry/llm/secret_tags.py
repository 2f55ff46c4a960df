"""Secrets in texts: fixed patterns, and a linear-chain conditional random field.

The field tags tokens as begin, inside or outside of a secret from their shape, the words
around them and features of the whole text. Only tokens of a possible shape may be tagged
as begin or inside. Every other token is outside in each labelling, so a chain falls apart
at those tokens and Viterbi runs on the stretches between them, with the same result.
"""

from __future__ import annotations

import math
import random
import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.llm.common import arrow_batches

KINDS = ("assign", "access", "hex", "crf")
# The base patterns and the least length of a match or its second group.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
# Words that announce a secret.
CUES = frozenset(
    "access api_key apikey auth authorization aws bearer client_secret credential credentials hash key pass passphrase passwd password "
    "private pwd secret session signature ssh token".split()
)
O, B, I = 0, 1, 2  # noqa: E741
_TOKEN = re.compile(r"\S+")
_CORE = re.compile(r"[A-Za-z0-9+/_=.-]{8,}")
_STRIP = "\"'`,;:!?()[]{}<>%*&#$|."


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the documents and ``stretches`` the stretches that the field is fitted on;
    ``taught`` examples of either kind are added."""

    sample: int = 20_000
    stretches: int = 4000
    taught: int = 400
    epochs: int = 12
    rate: float = 0.2
    decay: float = 1e-4
    hide: float = 0.3
    seed: int = 5


@dataclass(frozen=True)
class Model:
    features: dict[str, int]
    emit: np.ndarray
    step: np.ndarray


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the pattern matches, leftmost and without overlap in a kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _core(token: str) -> tuple[int, str]:
    left = token.lstrip(_STRIP)
    return len(token) - len(left), left.rstrip(_STRIP)


def _possible(token: str) -> bool:
    """Whether a token may be a secret: long enough, of key characters, with letters and digits."""
    if len(token) < 8:
        return False
    core = _core(token)[1]
    value = core.rpartition("=")[2] if "=" in core.rstrip("=") else core
    return bool(_CORE.fullmatch(value)) and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def _shape(value: str) -> list[str]:
    n = len(value)
    digits = sum(c.isdigit() for c in value)
    upper = any(c.isupper() for c in value)
    lower = any(c.islower() for c in value)
    counts = [value.count(c) for c in set(value)]
    entropy = -sum(c / n * math.log2(c / n) for c in counts)
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(value, value[1:], strict=False))
    return [
        f"len={min(n // 8, 6)}",
        f"digits={min(4, 5 * digits // n)}",
        f"case={int(upper)}{int(lower)}",
        f"signs={int(any(c in '+/_=-' for c in value))}",
        f"dots={min(2, value.count('.'))}",
        f"hex={int(all(c in '0123456789abcdef' for c in value))}",
        f"entropy={int(entropy * 2)}",
        f"turns={min(5, 10 * turns // n)}",
    ]


def _word(token: str) -> str:
    return _core(token)[1].lower()


def stretches(text: str) -> list[tuple[list[tuple[int, int]], list[list[str]]]]:
    """Runs of adjacent possible tokens: their spans and their features."""
    if not any(c in text for c in "0123456789"):
        return []
    runs: list = []
    coded = None
    for line_start, line in _digit_lines(text):
        tokens = [(m.start(), m[0]) for m in _TOKEN.finditer(line)]
        last = None
        for k, (start, token) in enumerate(tokens):
            if not _possible(token):
                continue
            if coded is None:
                marks = sum(text.count(c) for c in "={};()")
                coded = [f"code={min(4, 400 * marks // len(text))}", f"begin={int('-----BEGIN' in text)}", f"long={min(4, len(text) // 2000)}"]
            skip, core = _core(token)
            name, eq, value = core.rpartition("=") if "=" in core.rstrip("=") else ("", "", core)
            skip += len(name) + len(eq)
            feats = ["bias", *_shape(value), *coded, f"quoted={int(skip > 0 and token[skip - 1] in chr(34) + chr(39))}"]
            near = [t for _, t in tokens[max(0, k - 3) : k]]
            words = [_word(t) for t in near] + re.split(r"[^A-Za-z_]+", name.lower())
            feats.append(f"near cue={int(any(w in CUES for w in words))}")
            feats.append(f"near given={int(bool(eq) or bool(near) and near[-1][-1] in '=:')}")
            after = tokens[k + 1][1] if k + 1 < len(tokens) else ""
            feats.append(f"near next={'none' if not after else 'word' if after[0].isalpha() else 'other'}")
            span = (line_start + start + skip, line_start + start + skip + len(value))
            if last == k - 1 and runs:
                runs[-1][0].append(span)
                runs[-1][1].append(feats)
            else:
                runs.append(([span], [feats]))
            last = k
    return runs


def _digit_lines(text: str):
    at = 0
    for line in text.split("\n"):
        if any(c in line for c in "0123456789"):
            yield at, line
        at += len(line) + 1


def taught(s: Settings) -> list[tuple[list[list[str]], list[int]]]:
    """Runs made by rule beside those of the corpus: ordinary names with digits, and random keys.

    A corpus may hold no possible token that is harmless, or none without a cue.
    """
    rng = random.Random(s.seed)
    digits = lambda a, b: "".join(rng.choices("0123456789", k=rng.randint(a, b)))
    word = lambda a, b: "".join(rng.choices("aeioubdlmnrst", k=rng.randint(a, b)))
    mixed = string.ascii_letters + string.digits
    key = lambda: "".join(rng.choices(rng.choice([mixed, mixed + "_-", "0123456789abcdef"]), k=rng.randint(20, 48)))
    harmless = [
        lambda: f"user {word(4, 9)}{digits(2, 5)} came",
        lambda: f"version v{digits(1, 1)}.{digits(1, 2)}.{digits(1, 2)}-{rng.choice(['beta', 'alpha', 'rc'])}{digits(1, 1)} of {word(3, 8)}",
        lambda: f"file {word(3, 8)}{digits(2, 6)}.{rng.choice(['png', 'txt', 'csv', 'html'])} is",
        lambda: f"at 20{digits(2, 2)}-{digits(2, 2)}-{digits(2, 2)}T{digits(2, 2)} the",
        lambda: f"{word(5, 12)}_{digits(1, 3)} = {word(4, 8)}-{digits(4, 6)}",
        lambda: f"see {word(3, 8)}.{word(3, 6)}/{word(4, 9)}-{digits(1, 4)} for {word(3, 8)}",
        lambda: f"model {word(3, 7).upper()}-{digits(3, 6)}{word(1, 2).upper()} and",
    ]
    secret = [lambda: f"{rng.choice(sorted(CUES))} {key()} {word(3, 8)}", lambda: f'{word(3, 8)} = "{key()}"', lambda: f"{word(3, 8)} {key()} {word(3, 8)}"]
    runs = []
    for makers, tag in ((harmless, O), (secret, B)):
        for k in range(s.taught):
            found = stretches(f"{word(2, 9)} {word(2, 9)} {makers[k % len(makers)]()} {word(2, 9)}")
            runs += [(feats, [tag] * len(feats)) for _, feats in found]
    return runs


def _labels(spans: list[tuple[int, int]], found: list[tuple[int, int, int]]) -> list[int]:
    """Tags of a run by the pattern matches: a token under the match that covers the one before is inside."""
    tags, before = [], None
    for start, end in spans:
        hit = next((f for f in found if f[0] < end and start < f[2]), None)
        tags.append(O if hit is None else I if hit == before else B)
        before = hit
    return tags


_CLOSED = -1e9


def _start(emit: np.ndarray) -> np.ndarray:
    first = emit[0].copy()
    first[I] = _CLOSED
    return first


def viterbi(emit: np.ndarray, step: np.ndarray) -> list[int]:
    """Best tags of a run whose neighbours are outside."""
    best = _start(emit) + step[O]
    back = []
    for e in emit[1:]:
        all_ways = best[:, None] + step
        all_ways[O, I] = _CLOSED
        back.append(all_ways.argmax(axis=0))
        best = all_ways.max(axis=0) + e
    tag = int((best + step[:, O]).argmax())
    tags = [tag]
    for b in reversed(back):
        tag = int(b[tag])
        tags.append(tag)
    return tags[::-1]


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))


def _expected(emit: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tag probabilities and expected transitions of a run, by forward and backward sums."""
    n = len(emit)
    ways = step.copy()
    ways[O, I] = _CLOSED
    fwd = np.empty((n, 3))
    bwd = np.empty((n, 3))
    fwd[0] = _start(emit) + step[O]
    for k in range(1, n):
        fwd[k] = _log_sum(fwd[k - 1][:, None] + ways, 0) + emit[k]
    bwd[-1] = step[:, O]
    for k in range(n - 2, -1, -1):
        bwd[k] = _log_sum(ways + (emit[k + 1] + bwd[k + 1])[None, :], 1)
    total = _log_sum(fwd[-1] + bwd[-1], 0)
    tags = np.exp(fwd + bwd - total)
    moves = np.zeros((3, 3))
    for k in range(1, n):
        moves += np.exp(fwd[k - 1][:, None] + ways + (emit[k] + bwd[k])[None, :] - total)
    moves[O] += tags[0]
    moves[:, O] += tags[-1]
    return tags, moves


def train(runs: list[tuple[list[list[str]], list[int]]], s: Settings) -> Model:
    """Maximum likelihood by stochastic gradient steps. Cues are hidden at times, so that shapes count too."""
    names = sorted({f for feats, _ in runs for fs in feats for f in fs})
    index = {f: k for k, f in enumerate(names)}
    emit = np.zeros((len(names), 3))
    step = np.zeros((3, 3))
    rng = np.random.default_rng(s.seed)
    coded = [([np.array([index[f] for f in fs]) for fs in feats], [np.array([index[f] for f in fs if not f.startswith("near")]) for fs in feats], tags) for feats, tags in runs]
    for epoch in range(s.epochs):
        rate = s.rate / (1 + epoch)
        for k in rng.permutation(len(coded)):
            full, bare, tags = coded[k]
            feats = bare if rng.random() < s.hide else full
            p, moves = _expected(np.stack([emit[f].sum(axis=0) for f in feats]), step)
            for f, q, t in zip(feats, p, tags, strict=True):
                q = -q
                q[t] += 1
                emit[f] += rate * (q - s.decay * emit[f])
            true = np.zeros((3, 3))
            for a, b in zip([O, *tags], [*tags, O], strict=True):
                true[a, b] += 1
            step += rate * (true - moves)
    return Model(index, emit, step)


def tagged_spans(text: str, model: Model, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that the field finds beside the pattern matches."""
    out = []
    for spans, feats in stretches(text):
        known = [[model.features[f] for f in fs if f in model.features] for fs in feats]
        tags = viterbi(np.stack([model.emit[f].sum(axis=0) for f in known]), model.step)
        begun: list[list[int]] = []
        for (start, end), tag in zip(spans, tags, strict=True):
            if tag == B:
                begun.append([start, end])
            elif tag == I:
                begun[-1][1] = end
        out += [(a, 3, b) for a, b in begun if not any(s < b and a < e for s, _, e in base)]
    return out


def fit(docs: DataFrame, settings: Settings | None = None) -> Model:
    """Fit the field on the pattern matches of a bounded sample of ``docs`` (doc_id, text).

    Runs made by rule are added, so an empty table gives a usable field too.
    """
    s = settings or Settings()
    share = min(1.0, s.sample / max(docs.count(), 1))
    drawn = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    schema = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(pa.struct([("f", pa.list_(pa.list_(pa.string()))), ("t", pa.list_(pa.int32()))])))])

    def examples(batch: pa.RecordBatch) -> dict:
        rows = []
        for t in batch.column("text").to_pylist():
            base = base_spans(t or "")
            rows.append([{"f": feats, "t": _labels(spans, base)} for spans, feats in stretches(t or "")])
        return {"doc_id": batch.column("doc_id"), "runs": rows}

    made = drawn.select("doc_id", "text").mapInArrow(arrow_batches(examples, schema), "doc_id long, runs array<struct<f:array<array<string>>,t:array<int>>>")
    order = F.xxhash64("doc_id", "pos")
    rows = made.select("doc_id", F.posexplode("runs").alias("pos", "run")).orderBy(order).limit(s.stretches).select("run").collect()
    return train([([list(x) for x in r["run"]["f"]], list(r["run"]["t"])) for r in rows] + taught(s), s)


def _spans_of(text: str, model: Model) -> tuple[list, list]:
    base = base_spans(text)
    return base, sorted(base + tagged_spans(text, model, base))


def find_secrets(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, base and spans for every row of ``docs`` (doc_id, text); both list (start, kind, end).

    Positions are code points, ends exclusive. ``base`` holds the pattern matches, ``spans``
    these and what the field adds where no pattern matches. Null texts are taken as empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed set of features
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("base", span), ("spans", span)])
    named = lambda spans: [{"start": a, "kind": k, "end": b} for a, k, b in spans]

    def find(batch: pa.RecordBatch) -> dict:
        found = [_spans_of(t or "", shared.value) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "base": [named(b) for b, _ in found], "spans": [named(a) for _, a in found]}

    kind = "array<struct<start:bigint,kind:int,end:bigint>>"
    return docs.select("doc_id", "text").mapInArrow(arrow_batches(find, schema), f"doc_id long, base {kind}, spans {kind}")


def hide_secrets(docs: DataFrame, model: Model, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced; overlapping spans are replaced as one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def clean(text: str | None) -> str | None:
        spans = _spans_of(text, shared.value)[1] if text else []
        if not spans:
            return text
        out, done = [], 0
        for start, _, end in spans:
            if start >= done:
                out += [text[done:start], mask]
            done = max(done, end)
        return "".join([*out, text[done:]])

    def hide(batches):
        for batch in batches:
            texts = pa.array([clean(t) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if k == at else batch.column(k) for k in range(batch.num_columns)], names=batch.schema.names)

    return docs.mapInArrow(hide, docs.schema)
