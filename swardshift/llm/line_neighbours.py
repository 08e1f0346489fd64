"""Line dedup by a deletion-neighbourhood join.

Two lines are within one edit exactly if deleting at most one character from
each can give the same string: at the same place (a changed character), or from
one of them (an inserted one). Variants are emitted as hashed keys; equal keys
meet in an aggregation that keeps the earliest line, so no pairs are formed
however many lines share a variant; the winner is verified by edit distance.

More edits take variants with more places: changed characters become blanks
whose places count, and two lines meet if their changes and deletions together
are within the bound (``edits``).

Most lines need no variants: an edit leaves the first or the last half of a
line as it is, so a line that shares neither with another line has no
neighbour. The same holds, with finer pieces, for what is left. Under more
edits one of edits + 1 pieces stays, moved by at most so many places. No sieve
loses anything.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..stages import write_stage
from .wordhash import _Powers, mix

#: Shorter lines (headings, bullets, braces) carry too little to call them near copies.
LEAST_CHARS = 24
_PIECES = 16
#: What a variant is: a deletion with its place, a deletion, the whole line.
SAME_PLACE, CUT, WHOLE = 0, 1, 2
_SALT = np.uint64(0x8CB92BA72F3D8DD7)


#: A value for each code point of the first plane; those beyond add their plane's.
_POINT_VALUES = mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64) * _SALT)
#: Code points of text that are hashed at once (one text at least).
PIECE_POINTS = 1 << 18


class LineHasher:
    """Hashes of any part of a text, from running sums over its code points."""

    def __init__(self) -> None:
        self.powers = (_Powers(), _Powers(0xD1342543DE82EF95))

    def load(self, text: str, both: bool = True) -> np.ndarray:
        """Take in a text; ``both`` also prepares the second, independent hash."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        n = len(points)
        if n and points.max() >> 16:
            value = _POINT_VALUES[points & 0xFFFF] + (points >> 16).astype(np.uint64) * _SALT
        else:
            value = _POINT_VALUES[points]
        self.sums, self.down = [], []
        for powers in self.powers[: 1 + both]:
            up, down = powers.get(n)
            total = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(value * up[:n], out=total[1:])
            self.sums.append(total)
            self.down.append(down)
        return points

    def part(self, a: np.ndarray, b: np.ndarray, which: int = 0) -> np.ndarray:
        """Polynomial hash of the code points a..b, the same wherever they stand."""
        return (self.sums[which][b] - self.sums[which][a]) * self.down[which][a]

    def without(self, a, b, p, q) -> np.ndarray:
        """Hash of a..b with p..q cut out."""
        s = self.sums[0]
        left = s[p] - s[a]
        right = (s[b] - s[q]) * self.down[0][q - p]
        return (left + right) * self.down[0][a]


def line_spans(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every \\n-split line without the ASCII white space at its ends."""
    breaks = np.flatnonzero(points == 10)
    begin, end = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(points)]])
    solid = np.flatnonzero((points != 32) & ((points < 9) | (points > 13)))
    if not len(solid):
        return begin, begin.copy()
    first = np.searchsorted(solid, begin)
    last = np.searchsorted(solid, end)
    some = last > first
    a = np.where(some, solid[np.minimum(first, len(solid) - 1)], begin)
    b = np.where(some, solid[np.maximum(last - 1, 0)] + 1, a)
    return a, b


_STEPS = [1, 2, 3, 4]
while _STEPS[-1] < 1 << 30:
    _STEPS.append(int(_STEPS[-1] * 1.4))
_STEPS = np.array(_STEPS)


def half_of(n: np.ndarray) -> np.ndarray:
    """Length of the end pieces compared for a shared length n: at most half of it, in steps, so that neighbours in length mostly agree."""
    return _STEPS[np.searchsorted(_STEPS, np.maximum(n // 2, _STEPS[0]), side="right") - 1]


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


_LINES = [
    T.StructField("line", T.LongType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()),
    T.StructField("ends", T.ArrayType(T.LongType())),
]


def _hashed_lines(rows: DataFrame, least_chars: int, copy_chars: int) -> DataFrame:
    """(id, line, h1, h2, ends): each line's 128-bit hash and the keys of its end pieces, none where it is too short for near copies."""
    schema = T.StructType([rows.schema["id"], *_LINES])

    def hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = LineHasher()
        for batch in batches:
            held, size = [], 0
            for row, body in enumerate(batch.column(1)):
                held.append((row, body.as_py() or ""))
                size += len(held[-1][1])
                if size >= PIECE_POINTS:
                    yield hash_piece(hasher, batch, held)
                    held, size = [], 0
            if held:
                yield hash_piece(hasher, batch, held)

    def hash_piece(hasher: LineHasher, batch: pa.RecordBatch, held: list[tuple[int, str]]) -> pa.RecordBatch:
        points = hasher.load("\n".join(text for _, text in held))
        a, b = line_spans(points)
        # The first line of each text, by the line breaks that the texts before it hold and end in.
        starts = np.cumsum([0] + [text.count("\n") + 1 for _, text in held])[:-1]
        keep = np.flatnonzero(b - a >= min(least_chars, max(copy_chars, 1)))
        text = np.searchsorted(starts, keep, side="right") - 1
        a, b = a[keep], b[keep]
        n = (b - a).astype(np.uint64)
        h1, h2 = mix(hasher.part(a, b) + n), mix(hasher.part(a, b, 1) ^ (n * _SALT))
        keys, halves = [], [half_of(b - a), half_of(b - a - 1)]
        for m in halves:
            keys.append(mix(hasher.part(a, a + m) + m.astype(np.uint64) * _SALT))
            keys.append(mix(hasher.part(b - m, b) ^ (m.astype(np.uint64) * _SALT + _SALT)))
        keys, mask = np.stack(keys, axis=1), np.ones((len(keep), 4), dtype=bool)
        mask[halves[0] == halves[1], 2:] = False
        mask[b - a < least_chars] = False
        offsets = np.concatenate([[0], np.cumsum(mask.sum(axis=1))]).astype(np.int32)
        rows = np.array([row for row, _ in held])[text]
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(rows, pa.int64())), pa.array((keep - starts[text]).astype(np.int64)), pa.array(_signed(h1)), pa.array(_signed(h2)),
             pa.ListArray.from_arrays(pa.array(offsets), pa.array(_signed(keys[mask])))],
            names=schema.names,
        )

    return rows.mapInArrow(hash_lines, schema)


_WHITE = " \t\n\v\f\r"


def _line_texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, line, body) of the lines in ``wanted`` (id, line), trimmed. Each text is split once."""
    per_text = wanted.groupBy(F.col("id").alias("wid")).agg(F.collect_set("line").alias("numbers"))  # bounded by the text's lines
    schema = T.StructType([rows.schema["id"], T.StructField("line", T.LongType()), T.StructField("body", T.StringType())])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                parts, numbers = batch.column(1)[k].as_py().split("\n"), batch.column(2)[k].as_py()
                numbers = [n for n in numbers if n < len(parts)]
                take = pa.array(np.full(len(numbers), k))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), pa.array(numbers, pa.int64()), pa.array([parts[n].strip(_WHITE) for n in numbers], pa.string())], names=schema.names)

    met = rows.where("t is not null").join(per_text, F.col("id").eqNullSafe(F.col("wid")))
    return met.select("id", "t", "numbers").mapInArrow(pick, schema).dropDuplicates(["id", "line", "body"])


def _emit(lines: DataFrame, kind: str) -> DataFrame:
    """(id, line, key, role): hashed variants of each line's text.

    ``pieces`` cuts out each of 16 pieces, ``deletions`` each single character,
    once with its place (two such lines differ in one character there) and once
    without, to meet the lines that are equal to the rest as a whole.
    """
    schema = T.StructType([
        lines.schema["id"], T.StructField("line", T.LongType()), T.StructField("key", T.LongType()), T.StructField("role", T.IntegerType())
    ])

    def variants(hasher: LineHasher, n: int) -> tuple[np.ndarray, np.ndarray]:
        zero = np.zeros(1, dtype=np.int64)
        if kind == "pieces":
            keys = []
            for shared in (n, n - 1):
                step = -(-shared // _PIECES)
                p = np.minimum(np.arange(_PIECES) * step, shared)
                q = n - np.maximum(shared - (np.arange(_PIECES) + 1) * step, 0)
                keys.append(mix(hasher.without(zero, n, p, q) + (p + (shared << 24)).astype(np.uint64) * _SALT))
            keys = np.unique(np.concatenate(keys))
            return keys, np.full(len(keys), SAME_PLACE, dtype=np.int32)
        p = np.arange(n)
        cut = mix(hasher.without(zero, n, p, p + 1))
        whole = mix(hasher.part(zero, np.full(1, n)))
        placed, cut = mix(cut + (p.astype(np.uint64) + np.uint64(2)) * _SALT), np.unique(cut)
        return np.concatenate([placed, cut, whole]), np.repeat(np.array([SAME_PLACE, CUT, WHOLE], dtype=np.int32), [len(placed), len(cut), 1])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = LineHasher()
        for batch in batches:
            for row, body in enumerate(batch.column(2)):
                hasher.load(body.as_py(), both=False)
                keys, roles = variants(hasher, len(hasher.sums[0]) - 1)
                take = pa.array(np.full(len(keys), row))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(_signed(keys)), pa.array(roles)], names=schema.names)

    return lines.select("id", "line", "body").mapInArrow(emit, schema)


def within_one_edit(x: str, y: str) -> bool:
    """Whether at most one insertion, deletion or change turns one text into the other."""
    if abs(len(x) - len(y)) > 1:
        return False
    if len(x) > len(y):
        x, y = y, x
    k = 0
    while k < len(x) and x[k] == y[k]:
        k += 1
    return x[k + 1 :] == y[k + 1 :] if len(x) == len(y) else x[k:] == y[k + 1 :]


def within_edits(x: str, y: str, edits: int) -> bool:
    """Whether at most ``edits`` insertions, deletions and changes turn one text into the other."""
    if edits == 1:
        return within_one_edit(x, y)
    if abs(len(x) - len(y)) > edits:
        return False
    far = edits + 1
    row = {j: j for j in range(min(edits, len(y)) + 1)}
    for i, c in enumerate(x, 1):
        now: dict[int, int] = {}
        for j in range(max(0, i - edits), min(len(y), i + edits) + 1):
            cost = min(row.get(j, far) + 1, now.get(j - 1, far) + 1)
            now[j] = min(cost, row.get(j - 1, far) + (c != y[j - 1])) if j else cost
        row = now
    return row.get(len(y), far) <= edits


#: Places of a line's edits that are hashed at once.
PLACES = 1 << 16
#: A role is the number of blanks times this and the number of deletions.
_BLANKS = 1 << 8


def _edit_variants(hasher: LineHasher, n: int, edits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and roles of a loaded line with up to ``edits`` characters blanked or deleted."""
    s, (up, down) = hasher.sums[0], hasher.powers[0].get(n)
    for m in range(min(edits, n) + 1):
        places = itertools.combinations(range(n), m)
        while chunk := list(itertools.islice(places, PLACES)):
            at = np.array(chunk, dtype=np.int64).reshape(len(chunk), m)
            for blank in itertools.product((True, False), repeat=m):
                total, begin, gone = np.zeros(len(at), dtype=np.uint64), np.zeros(len(at), dtype=np.int64), 0
                for k, wild in enumerate(blank):
                    total += (s[at[:, k]] - s[begin]) * down[gone]
                    if wild:
                        total += _SALT * up[at[:, k] - gone]
                    begin, gone = at[:, k] + 1, gone + (not wild)
                total += (s[n] - s[begin]) * down[gone]
                blanks = sum(blank)
                keys = np.unique(mix(total + np.uint64(blanks + 3) * _POINT_VALUES[0]))
                yield keys, np.full(len(keys), blanks * _BLANKS + m - blanks, dtype=np.int32)


def _segment_keys(hasher: LineHasher, n: int, edits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys of the pieces that a line within ``edits`` of the loaded one can have unchanged."""
    keys = []
    for length in range(max(n - edits, 0), n + edits + 1):
        ends = np.arange(edits + 2) * length // (edits + 1)
        for k in range(edits + 1):
            size = ends[k + 1] - ends[k]
            a = np.arange(max(ends[k] - edits, 0), min(ends[k] + edits, n - size) + 1)
            keys.append(mix(hasher.part(a, a + size) + np.uint64((length * (edits + 1) + k) * 2 + 1) * _SALT))
    keys = np.unique(np.concatenate(keys))
    yield keys, np.zeros(len(keys), dtype=np.int32)


def _emit_edits(lines: DataFrame, make, edits: int) -> DataFrame:
    """(id, line, key, role) of what ``make`` gives for each line's text."""
    schema = T.StructType([
        lines.schema["id"], T.StructField("line", T.LongType()), T.StructField("key", T.LongType()), T.StructField("role", T.IntegerType())
    ])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = LineHasher()
        for batch in batches:
            for row, body in enumerate(batch.column(2)):
                n = len(hasher.load(body.as_py(), both=False))
                for keys, roles in make(hasher, n, edits):
                    take = pa.array(np.full(len(keys), row))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(take), batch.column(1).take(take), pa.array(_signed(keys)), pa.array(roles)], names=schema.names)

    return lines.select("id", "line", "body").mapInArrow(emit, schema)


def _verified(pairs: DataFrame, edits: int = 1) -> DataFrame:
    """The rows (id, line, body, earlier) whose two texts are within ``edits`` edits."""
    schema = T.StructType([pairs.schema["id"], T.StructField("line", T.LongType())])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [within_edits(x, y, edits) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("id", "line", "body", "earlier").mapInArrow(check, schema)


def _pos() -> Column:
    return F.struct("id", "line")


def repeated_lines(
    docs: DataFrame, id: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS,
    copy_chars: int = 1, edits: int = 1,
) -> DataFrame:
    """(id, line) of every line to drop: an earlier line is equal or within ``edits`` edits.

    Lines are split at \\n, counted from 0, compared without the ASCII white
    space at their ends; those under ``least_chars`` code points are never near
    another. Copies fall from ``copy_chars`` code points on, so by default every
    line that is not blank is compared for equality. Earlier means a smaller (id, line), a null id before all others.
    A first occurrence falls only to a line that stands before it; all later
    occurrences fall. Rows that repeat an id are one document seen twice: their
    lines stand at the same places. Null and empty texts have no lines to drop.
    """
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("t"))
    lines = write_stage(_hashed_lines(rows, least_chars, copy_chars), "lines")
    firsts = write_stage(
        lines.groupBy("h1", "h2").agg(F.min(_pos()).alias("pos"), F.first("ends").alias("ends")), "firsts"
    )
    copies = lines.join(firsts.select("h1", "h2", F.col("pos.id").alias("fid"), F.col("pos.line").alias("fline")), ["h1", "h2"]).where(
        ~(F.col("id").eqNullSafe(F.col("fid")) & (F.col("line") == F.col("fline")))
    ).select("id", "line")

    least = lambda role: F.min(F.when(F.col("role") == role, _pos()))
    if edits == 1:
        keyed = firsts.select("pos.*", F.explode("ends").alias("key"))
        shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
        wanted = keyed.join(shared, "key", "left_semi").select("id", "line").distinct()
    else:
        wanted = firsts.where(F.size("ends") > 0).select("pos.*")
    bodies = write_stage(_line_texts(rows, wanted), "bodies")
    pieces = _emit(bodies, "pieces") if edits == 1 else _emit_edits(bodies, _segment_keys, edits)
    shared = pieces.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    close = pieces.join(shared, "key", "left_semi").select("id", "line").distinct()
    close = write_stage(_null_safe_semi(bodies, close), "close")

    if edits == 1:
        variants = write_stage(_emit(close, "deletions"), "variants")
        best = variants.groupBy("key").agg(
            least(SAME_PLACE).alias("b0"), least(CUT).alias("b1"), least(WHOLE).alias("b2"), F.count(F.lit(1)).alias("n")
        ).where("n > 1")
        partner = F.when(F.col("role") == SAME_PLACE, F.col("b0")).when(F.col("role") == CUT, F.col("b2")).otherwise(F.col("b1"))
    else:
        variants = write_stage(_emit_edits(close, _edit_variants, edits), "variants")
        deleted = lambda d: F.min(F.when(F.col("role") % _BLANKS == d, _pos()))
        best = variants.groupBy("key").agg(*[deleted(d).alias(f"b{d}") for d in range(edits + 1)], F.count(F.lit(1)).alias("n")).where("n > 1")
        spent = F.floor(F.col("role") / _BLANKS) + F.col("role") % _BLANKS
        partner = F.least(F.lit(None), *[F.when(spent + d <= edits, F.col(f"b{d}")) for d in range(edits + 1)])
    beaten = (
        variants.join(best, "key").withColumn("best", partner).where(F.col("best").isNotNull() & (F.col("best") < _pos()))
        .groupBy("id", "line").agg(F.collect_set("best").alias("bests"))  # bounded by the line's variants
        .select("id", "line", F.explode("bests").alias("best"))
    )
    e = close.select(F.col("id").alias("eid"), F.col("line").alias("eline"), F.col("body").alias("earlier"))
    o = close.select(F.col("id").alias("oid"), F.col("line").alias("oline"), "body")
    pairs = beaten.join(e, F.col("best.id").eqNullSafe(F.col("eid")) & (F.col("best.line") == F.col("eline"))).join(
        o, F.col("id").eqNullSafe(F.col("oid")) & (F.col("line") == F.col("oline"))
    )
    near = _verified(pairs, edits)
    return copies.union(near).distinct()


def _null_safe_semi(left: DataFrame, keys: DataFrame) -> DataFrame:
    k = keys.select(F.col("id").alias("kid"), F.col("line").alias("kline"))
    return left.join(k, F.col("id").eqNullSafe(F.col("kid")) & (F.col("line") == F.col("kline")), "left_semi")


def drop_lines(docs: DataFrame, dropped: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the lines in ``dropped`` (id, line) taken out of the text.

    All columns stay. A text that loses every line it had becomes empty; texts
    without dropped lines, null ones included, stay as they are.
    """
    own = dropped.groupBy(F.col("id").alias("__drop_id")).agg(F.collect_set("line").alias("__drop_lines"))
    joined = docs.join(own, docs[id].eqNullSafe(F.col("__drop_id")), "left")
    # A generator holds the split text, so that it is split once; the lines that stay are a difference of numbers.
    parts = F.when(F.col("__drop_lines").isNotNull(), F.split(F.col(text), "\n", -1))
    numbers = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: k.cast("long"))
    stay = F.when(parts.isNotNull(), F.array_except(numbers, "__drop_lines"))
    held = joined.select(*[F.col(f"`{c}`") for c in docs.columns], F.inline(F.array(F.struct(parts.alias("__parts"), stay.alias("__stay")))))
    left = F.array_join(F.transform("__stay", lambda k: F.get("__parts", k.cast("int"))), "\n")
    return held.withColumn(text, F.when(F.col("__parts").isNull(), F.col(text)).otherwise(left)).select(*docs.columns)
