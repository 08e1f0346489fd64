"""Quality by a linear-chain conditional random field over lines.

Every line gets features of its own and of its neighbours; the field labels it
good or bad. Forward-backward marginals, weighted by the lines' lengths, give
the document's score. The field is fitted on a bounded sample of labelled
documents, whose lines take the document's label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .wordhash import NOT_SPACE, WordHasher, byte_table, mix, text_pieces

#: Labelled documents that the field is fitted on at most, chosen by a hash of their id.
TRAIN_DOCS = 6_000
STEPS, RATE, PENALTY = 160, 0.15, 1e-3
#: A document scored below this is predicted to be of low quality.
THRESHOLD = 0.3

_COUNTED = {
    "lower": byte_table(range(97, 123)), "upper": byte_table(range(65, 91)), "digit": byte_table(range(48, 58)),
    "symbol": byte_table(map(ord, "#*$%&<>@^~=_\\{}[]")), "bar": byte_table([ord("|")]), "bang": byte_table([ord("!")]),
    "comma": byte_table(map(ord, ",;:")), "stop": byte_table(map(ord, ".?")), "beyond": byte_table(range(128, 256)),
}
#: Features of a line that its neighbours see too.
_SEEN = ("upper", "symbol", "bar", "bang", "digit", "echo", "copy")
OWN = ("bias", "upper", "symbol", "bar", "bang", "digit", "comma", "stop", "beyond", "echo", "copy", "long_words", "short_words", "few", "many", "ends", "capital")
FEATURES = [*OWN, *[f"before_{k}" for k in _SEEN], *[f"after_{k}" for k in _SEEN], "first", "last"]


def line_features(data: np.ndarray, offsets: np.ndarray, hasher: WordHasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines x features) and byte lengths of the lines with words; number of such lines before each text."""
    breaks = np.flatnonzero(data == 10)
    edges = np.unique(np.concatenate([offsets, breaks, breaks + 1]))
    begin, end = edges[:-1], edges[1:]
    h, start, stop, _ = hasher.words(data, offsets)
    first_word = np.searchsorted(start, begin)
    words = np.searchsorted(start, end) - first_word
    some = words > 0
    begin, end, first_word, words = begin[some], end[some], first_word[some], words[some]
    n = len(begin)
    if n == 0:
        return np.zeros((0, len(FEATURES))), np.zeros(0), np.zeros(len(offsets), dtype=np.int64)

    def per_line(flags: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=total[1:])
        return (total[b] - total[a]).astype(np.float64)

    counts = {k: per_line(t[data], begin, end) for k, t in _COUNTED.items()}
    last_word = first_word + words
    size = per_line(NOT_SPACE[data], begin, end)
    letters = counts["lower"] + counts["upper"]
    echo = np.zeros(len(h), dtype=bool)
    echo[1:] = h[1:] == h[:-1]
    widths = stop - start
    places = np.arange(1, len(h) + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    # A line's hash: its words' hashes by place within the line; equal lines of one text are copies.
    local = places - np.repeat(places[first_word], words).astype(np.uint64) if words.sum() == len(h) else None
    whole = np.add.reduceat(mix(h + local), first_word) if local is not None else np.arange(n, dtype=np.uint64)
    text = np.searchsorted(offsets, begin, side="right") - 1
    key = whole + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    seen = np.ones(n, dtype=bool)
    seen[np.unique(key, return_index=True)[1]] = False

    own = np.zeros((n, len(OWN)))
    share = lambda x, of: np.minimum(x / np.maximum(of, 1), 1.0)
    own[:, 0] = 1
    own[:, 1] = share(counts["upper"], letters)
    for k, name in ((2, "symbol"), (3, "bar"), (4, "bang"), (6, "comma"), (7, "stop")):
        own[:, k] = share(counts[name], words)
    own[:, 5] = share(counts["digit"], size)
    own[:, 8] = share(counts["beyond"], size)
    own[:, 9] = per_line(echo, first_word, last_word) / words
    own[:, 10] = seen
    own[:, 11] = per_line(widths > 12, first_word, last_word) / words
    own[:, 12] = per_line(widths < 4, first_word, last_word) / words
    own[:, 13], own[:, 14] = words < 4, np.log1p(words) / 6
    own[:, 15] = _COUNTED["stop"][data[stop[last_word - 1] - 1]]
    own[:, 16] = _COUNTED["upper"][data[start[first_word]]]

    opens = np.ones(n, dtype=bool)
    opens[1:] = text[1:] != text[:-1]
    closes = np.ones(n, dtype=bool)
    closes[:-1] = opens[1:]
    view = own[:, [OWN.index(k) for k in _SEEN]]
    before, after = np.zeros_like(view), np.zeros_like(view)
    before[1:], after[:-1] = view[:-1], view[1:]
    before[opens], after[closes] = 0, 0
    full = np.concatenate([own, before, after, opens[:, None], closes[:, None]], axis=1)
    return full, size, np.searchsorted(text, np.arange(len(offsets)))


@dataclass
class Field:
    """Weights of a line being good, and transition scores [from bad/good][to bad/good]."""

    weights: np.ndarray
    moves: np.ndarray

    def marginals(self, x: np.ndarray, before: np.ndarray) -> np.ndarray:
        return _sigmoid(np.add(*_messages(x @ self.weights, self.moves, before)))


def _sigmoid(r: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(r, -40, 40)))


def _messages(e: np.ndarray, moves: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of good from the lines up to each (itself included), and from those after it. All texts step together."""
    forward, backward = e.copy(), np.zeros_like(e)
    first, n = before[:-1], np.diff(before)
    order = np.argsort(-n, kind="stable")
    first, n = first[order], n[order]
    longest = int(n[0]) if len(n) else 0
    live = np.searchsorted(-n, -np.arange(longest + 1), side="left")  # texts with more lines than each step
    (bb, bg), (gb, gg) = moves
    for t in range(1, longest):
        at = first[: live[t]] + t
        r = forward[at - 1]
        forward[at] += np.logaddexp(gg + r, bg) - np.logaddexp(gb + r, bb)
    for t in range(longest - 2, -1, -1):
        at = first[: live[t + 1]] + t
        r = backward[at + 1] + e[at + 1]
        backward[at] = np.logaddexp(gg + r, gb) - np.logaddexp(bg + r, bb)
    return forward, backward


def fit_field(x: np.ndarray, before: np.ndarray, good: np.ndarray, steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY) -> Field:
    """Maximise the penalised likelihood of the texts' labels by gradient ascent (Adam). ``good`` has a label for each text."""
    y = np.repeat(good.astype(np.float64), np.diff(before))
    inner = np.ones(len(y), dtype=bool)
    inner[before[:-1][np.diff(before) > 0]] = False
    later = np.flatnonzero(inner)
    params = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(params), np.zeros_like(params)
    texts = max(1, len(good))
    for k in range(1, steps + 1):
        w, moves = params[:-4], params[-4:].reshape(2, 2)
        e = x @ w
        f, b = _messages(e, moves, before)
        gradient = np.empty_like(params)
        gradient[:-4] = (y - _sigmoid(f + b)) @ x
        pair = np.stack([moves[i, j] + i * f[later - 1] + j * (e[later] + b[later]) for i in (0, 1) for j in (0, 1)])
        pair = np.exp(pair - pair.max(axis=0))
        expected = (pair / pair.sum(axis=0)).sum(axis=1)
        a, c = y[later - 1], y[later]
        gradient[-4:] = np.array([((1 - a) * (1 - c)).sum(), ((1 - a) * c).sum(), (a * (1 - c)).sum(), (a * c).sum()]) - expected
        gradient = gradient / texts - penalty * params
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        params = params + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
    return Field(params[:-4], params[-4:].reshape(2, 2))


def in_fold(id: Column, folds: int = 5) -> Column:
    """Whether a row belongs to the held-out fold: crc32 of the id as text leaves no remainder."""
    return F.coalesce(F.pmod(F.crc32(id.cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", train_docs: int = TRAIN_DOCS) -> Field | float:
    """The field fitted on labelled documents outside the held-out fold; a constant score where they show one class only.

    At most ``train_docs`` documents are used. Ids labelled twice count once,
    with the smaller label; null ids and labels are left out.
    """
    rows = labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y is not null")
    chosen = rows.where(~in_fold(F.col("id"))).groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(train_docs)
    own = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("t"))
    sample = own.join(F.broadcast(chosen), "id")  # at most train_docs rows
    schema = T.StructType([T.StructField("y", T.IntegerType()), T.StructField("lines", T.LongType()), T.StructField("x", T.BinaryType())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(NOT_SPACE)
        for batch in batches:
            for first, end, data, offsets in text_pieces(batch.column(0)):
                x, _, before = line_features(data, offsets, hasher)
                x = x.astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(first, end - first), pa.array(np.diff(before)), pa.array([x[a:b].tobytes() for a, b in zip(before, before[1:], strict=False)], pa.binary())],
                    names=schema.names,
                )

    got = sample.select("t", "y").mapInArrow(extract, schema).collect()
    got = sorted((r for r in got if r["lines"]), key=lambda r: (r["lines"], bytes(r["x"])))
    good = np.array([r["y"] for r in got]) > 0
    if not len(got) or good.all() or not good.any():
        return float(good.mean()) if len(got) else 0.5
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in got), dtype=np.float32).reshape(-1, len(FEATURES)).astype(np.float64)
    before = np.concatenate([[0], np.cumsum([r["lines"] for r in got])])
    return fit_field(x, before, good)


def document_scores(field: Field | float, column: pa.Array, hasher: WordHasher) -> np.ndarray:
    """Length-weighted share of good lines of each text; 0 for texts without words."""
    out = np.zeros(len(column))
    for first, end, data, offsets in text_pieces(column):
        x, size, before = line_features(data, offsets, hasher)
        good = np.full(len(size), field) if isinstance(field, float) else field.marginals(x, before)
        total = np.concatenate([[0], np.cumsum(size)])
        mass = np.concatenate([[0], np.cumsum(size * good)])
        chars = total[before[1:]] - total[before[:-1]]
        out[first:end] = np.where(chars > 0, (mass[before[1:]] - mass[before[:-1]]) / np.maximum(chars, 1), 0.0)
    return np.clip(out, 0.0, 1.0)


def with_scores(docs: DataFrame, field: Field | float, text: str = "text", score: str = "quality_score") -> DataFrame:
    """``docs`` with the score of every whole text beside its columns (a column of that name is replaced).

    One row per input row; null, empty and blank texts score 0. Scored in the
    scan tasks, in pieces of bounded bytes, without a shuffle.
    """
    left = docs.drop(score)
    schema = T.StructType([*left.schema.fields, T.StructField(score, T.DoubleType())])
    place = left.columns.index(text)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(NOT_SPACE)
        for batch in batches:
            scores = document_scores(field, batch.column(place).cast(pa.string()), hasher)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=schema.names)

    return left.mapInArrow(apply, schema)
