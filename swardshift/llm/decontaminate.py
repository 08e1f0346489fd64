"""Benchmark decontamination by Wu-Manber search over words.

Test items are cut into windows of ``width`` consecutive words (an item of
fewer words is one window). Windows of one length form one search: a shift
table on blocks of two words says how far a search may jump, a shift of zero
leads to the bucket of windows ending in that block, and each of them is
compared with the text, first by its word hashes, then by its words.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..stages import write_stage
from .wordhash import ALNUM, WordHasher, mix, text_pieces

#: Words of the items that one broadcast block holds at most (an item is not split, so one item may exceed it).
BLOCK_WORDS = 1_000_000
#: The search table has this many bits for each window of the block, so few blocks share an entry by accident.
_TABLE_BITS = 5
#: Texts are searched in lanes of so many words, all lanes of a piece in step.
_LANE_WORDS = 512
_STEP = np.uint64(0xA24BAED4963EE407)

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def item_words(text: str | None) -> list[str]:
    """Words of a text, A-Z lower-cased."""
    return WORD.findall((text or "").translate(_ASCII_LOWER))


class _Search:
    """Wu-Manber tables for windows of one length."""

    def __init__(self, length: int, grams: dict[tuple[str, ...], list[int]]) -> None:
        self.length, self.block = length, min(2, length)
        self.words = list(grams)
        self.items = [sorted(set(v)) for v in grams.values()]
        flat = pa.array([w for g in self.words for w in g], pa.large_string())
        hasher = WordHasher(ALNUM)
        hashes = np.concatenate([hasher.words(d, o)[0] for _, _, d, o in text_pieces(flat)])
        self.hashes = hashes.reshape(len(self.words), length)
        bits = max(8, int(len(self.words) * length).bit_length() + _TABLE_BITS)
        self.shift_by = np.uint64(64 - min(bits, 26))
        self.shift = np.full(1 << min(bits, 26), length - self.block + 1, dtype=np.int64)
        for at in range(length - self.block + 1):
            slot = self.slot(self.hashes, at)
            np.minimum.at(self.shift, slot, length - self.block - at)
        ends = self.slot(self.hashes, length - self.block)
        self.order = np.argsort(ends, kind="stable")
        self.ends = ends[self.order]

    def slot(self, rows: np.ndarray, at: int) -> np.ndarray:
        value = rows[:, at] if self.block == 1 else rows[:, at] * _STEP + rows[:, at + 1]
        return (mix(value) >> self.shift_by).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, window) pairs at which the word hashes agree with a window."""
        n, m = len(h), self.length
        if n < m:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        blocks = h if self.block == 1 else h[:-1] * _STEP + h[1:]
        slots = (mix(blocks) >> self.shift_by).astype(np.int64)
        # A lane owns the window starts from its first to the next lane's first.
        begin = np.arange(0, n - m + 1, _LANE_WORDS)
        stop = np.minimum(begin + _LANE_WORDS, n - m + 1)
        at, found = begin, []
        while len(at):
            jump = self.shift[slots[at + m - self.block]]
            zero = jump == 0
            if zero.any():
                found.append(at[zero])
            at = at + np.maximum(jump, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        pos = np.concatenate(found)
        key = slots[pos + m - self.block]
        low, high = np.searchsorted(self.ends, key, "left"), np.searchsorted(self.ends, key, "right")
        return self._confirm(h, pos, low, high)

    def _confirm(self, h, pos, low, high) -> tuple[np.ndarray, np.ndarray]:
        """Compare bucket by bucket member, all positions in step."""
        out_pos, out_win = [], []
        while True:
            live = low < high
            pos, low, high = pos[live], low[live], high[live]
            if not len(pos):
                break
            win = self.order[low]
            same = np.ones(len(pos), dtype=bool)
            for k in range(self.length):
                same &= h[pos + k] == self.hashes[win, k]
            out_pos.append(pos[same])
            out_win.append(win[same])
            low = low + 1
        if not out_pos:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate(out_pos), np.concatenate(out_win)


def build_searches(items: list[tuple], width: int) -> list[_Search]:
    """One search for each window length in ``items`` (index, text)."""
    by_length: dict[int, dict[tuple[str, ...], list[int]]] = defaultdict(lambda: defaultdict(list))
    for index, text in items:
        words = item_words(text)
        size = min(width, len(words))
        for k in range(len(words) - size + 1 if size else 0):
            by_length[size][tuple(words[k : k + size])].append(index)
    return [_Search(n, grams) for n, grams in sorted(by_length.items())]


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def search_piece(searches: list[_Search], hasher: WordHasher, data, offsets) -> Iterator[tuple[int, list, set]]:
    """For each text: number of words, merged hit spans (in words), indexes of the items found."""
    h, start, end, before = hasher.words(data, offsets)
    low = None
    spans: dict[int, list] = defaultdict(list)
    items: dict[int, set] = defaultdict(set)
    for s in searches:
        pos, win = s.find(h)
        if not len(pos):
            continue
        text = np.searchsorted(before, pos, side="right") - 1
        inside = pos + s.length <= before[text + 1]
        low = data.tobytes().lower() if low is None else low  # bytes.lower() maps A-Z only
        for p, w, t in zip(pos[inside].tolist(), win[inside].tolist(), text[inside].tolist(), strict=True):
            own = s.words[w]
            if all(low[start[p + k] : end[p + k]] == own[k].encode() for k in range(s.length)):
                spans[t].append((p - int(before[t]), p - int(before[t]) + s.length))
                items[t].update(s.items[w])
    for t in range(len(offsets) - 1):
        yield int(before[t + 1] - before[t]), _union(spans[t]) if t in spans else [], items.get(t, set())


FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def find_occurrences(
    docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", width: int = 13, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Every document's words covered by a test window: (id, n_words, spans, items).

    ``spans`` are merged half-open ranges of word numbers, ``items`` the sorted
    ids (as strings) of the items found. One row per input row, repeated ids
    included; a null or empty text has no words and no hits, a null item text
    no windows; an item without an id hits words like any other, but has no name
    to be listed by. Extra columns
    of either table are ignored. Texts stream through their scan tasks without
    a shuffle; items are broadcast in blocks of ``block_words``, each a full
    search, and a text's hits in several blocks are merged.
    """
    own = benchmark.select(F.col(item).cast("string").alias("i"), F.col(item_text).alias("t"))
    size = own.agg(F.sum(F.size(F.split(F.coalesce("t", F.lit("")), "[^0-9A-Za-z\\x{80}-\\x{10FFFF}]+"))).alias("n")).first()
    blocks = max(1, -(-int(size["n"] or 0) // block_words))
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("t"))
    if blocks == 1:
        return _search_block(rows, own, docs.schema[id].dataType, id, width)
    keyed = write_stage(rows.withColumn("row", F.monotonically_increasing_id()), "texts")  # the branches must agree on it
    parts = None
    for k in range(blocks):
        block = own.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        found = _search_block(keyed.select(F.struct("id", "row").alias("id"), "t"), block, None, "key", width)
        parts = found if parts is None else parts.unionByName(found)
    return _merge_blocks(parts, id)


def _search_block(rows: DataFrame, items: DataFrame, id_type, id: str, width: int) -> DataFrame:
    listed = [(r["i"], r["t"]) for r in items.toLocalIterator()]
    names = sorted({i for i, _ in listed if i is not None})
    number = {n: k for k, n in enumerate(names)} | {None: -1}
    shared = rows.sparkSession.sparkContext.broadcast(([(number[i], t) for i, t in listed], names))
    id_type = rows.schema["id"].dataType
    schema = T.StructType([T.StructField(id, id_type), *FOUND.fields])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbered, names = shared.value
        searches, hasher = build_searches(numbered, width), WordHasher(ALNUM)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for first, end, data, offsets in text_pieces(texts):
                n, spans, items = [], [], []
                for words, own, found in search_piece(searches, hasher, data, offsets):
                    n.append(words)
                    spans.append([{"begin": a, "end": b} for a, b in own])
                    items.append([names[k] for k in sorted(found) if k >= 0])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, end - first), pa.array(n, pa.int64()),
                     pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
                     pa.array(items, pa.list_(pa.string()))],
                    names=[id, "n_words", "spans", "items"],
                )

    return rows.select("id", "t").mapInArrow(search, schema)


def _merge_blocks(parts: DataFrame, id: str) -> DataFrame:
    span = "struct<begin:bigint,end:bigint>"
    step = (
        "CASE WHEN size(acc) > 0 AND element_at(acc, -1).end >= s.begin THEN "
        "concat(slice(acc, 1, size(acc) - 1), array(named_struct('begin', element_at(acc, -1).begin, 'end', greatest(element_at(acc, -1).end, s.end)))) "
        "ELSE concat(acc, array(s)) END"
    )
    return (
        parts.groupBy("key")
        .agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
             F.array_sort(F.flatten(F.collect_list("items"))).alias("items"))
        .select(F.col("key.id").alias(id), "n_words",
                F.expr(f"aggregate(spans, CAST(array() AS array<{span}>), (acc, s) -> {step})").alias("spans"), "items")
    )


def judge(found: DataFrame, share: float = 0.05) -> DataFrame:
    """Add n_hit, n_items, items_sha256 and contaminated (a hit, and at least ``share`` of the words hit)."""
    hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.begin)")
    per = round(1 / share)
    return found.select(
        "*", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (per * F.col("n_hit") >= F.col("n_words")))


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
