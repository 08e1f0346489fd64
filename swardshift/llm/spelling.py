"""Spelling variants of the vocabulary by FM-index search schemes.

Two words are near if they are one inserted, deleted or replaced code point
apart. One half of a word then occurs unchanged in the other, at the same end:
the search matches either half exactly and extends across the other half,
allowing one error there. Matching runs over an index of the words of a block,
each closed by a delimiter: an interval of ranks holds the suffixes that begin
with what was matched, one character more narrows it. The index has two
directions, over the words and over the reversed words, so each half is reached
by narrowing from its own end. A delimiter before the word ends a match, and its
rank among the delimiters tells the word.

Blocks: a half has three code points at least, so only words with the same last
(first) three can match. Words meet in a block by these three; three that more
words share than fit into a block are dealt to a grid, where every slice of
index meets every slice of searches. No block grows with the vocabulary.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..stages import write_stage

#: Words of an index.
BLOCK_WORDS = 1 << 15
#: A task counts so many different words before it hands them on.
HELD_WORDS = 500_000
#: Code points that two near words have in common at one end, at least: half of the shortest word.
SHARED = 3
LEAST_CHARS = 6
#: Rows that are looked at together while intervals branch.
_ROWS = 1 << 21
#: Texts beyond this are walked match by match.
_LONG_TEXT = 1 << 23
#: Tasks that search; beyond that a task takes several blocks one after the other.
MOST_TASKS = 10_000
_INDEXED, _SEARCHED = 1, 2


def misspelt(run: str, prefix: int, every: int) -> str:
    """The run, without one code point if ``every`` divides its CRC-32, which also says which."""
    h = zlib.crc32(run.encode(), prefix)
    if h % every:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def vocabulary(docs: DataFrame, id: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_count: int = 5, every: int = 199) -> DataFrame:
    """(word, n): the lower-cased runs of letters of all texts, with the contract's deletions, that occur often enough.

    A missing text has no runs; a missing id reads ``null`` in the deletions' hash.
    Tasks count before the shuffle and hold a bounded number of words.
    """
    runs = re.compile(f"[a-zÀ-ÿ]{{{least_chars},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for own, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = body.as_py()
                if not raw:
                    continue
                low = raw.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # bytes lower A-Z only
                seen = Counter(runs.findall(low) if len(low) < _LONG_TEXT else (m.group() for m in runs.finditer(low)))
                prefix = zlib.crc32(f"{'null' if own is None else own}:".encode())
                for run, n in seen.items():
                    word = misspelt(run, prefix, every)
                    if len(word) >= least_chars:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield out()
        yield out()

    counted = docs.select(F.col(id).cast("string").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class SuffixRanks:
    """Ranks of all suffixes of delimited words, for matching from the words' ends to their fronts."""

    def __init__(self, words: list[str]) -> None:
        self.size = len(words)
        lengths = np.fromiter(map(len, words), np.int64, self.size)
        raw = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.alphabet = np.unique(raw)
        ends = np.cumsum(lengths + 1) - 1  # of the delimiters
        n = int(ends[-1]) + 1 if self.size else 0
        self.rows = n
        symbols = np.zeros(n, dtype=np.int64)
        inside = np.ones(n, dtype=bool)
        inside[ends] = False
        symbols[inside] = np.searchsorted(self.alphabet, raw) + 1
        left = np.repeat(ends, lengths + 1) - np.arange(n)  # code points before the delimiter
        rank, step = symbols.copy(), 1
        longest = int(lengths.max()) if self.size else 0
        while step <= longest:  # ranks by 1, 2, 4, ... code points
            further = np.zeros(n, dtype=np.int64)
            reach = left >= step
            further[reach] = rank[np.flatnonzero(reach) + step] + 1
            rank = np.unique(rank * (n + len(self.alphabet) + 2) + further, return_inverse=True)[1]
            step *= 2
        suffixes = np.argsort(rank, kind="stable")
        begins = ends - lengths
        first = np.zeros(n, dtype=bool)
        first[begins] = True
        #: Symbol before each suffix; the delimiter (0) before whole words.
        self.before = np.where(first[suffixes], 0, symbols[suffixes - 1])
        self._places = np.sort(self.before * (n + 1) + np.arange(n))
        self.in_order = (np.searchsorted(ends, suffixes[self.before == 0])).astype(np.int64)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words in a row, and where each word begins; unknown characters match nothing."""
        raw = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        at = np.minimum(np.searchsorted(self.alphabet, raw), max(len(self.alphabet) - 1, 0))
        known = self.alphabet[at] == raw if len(self.alphabet) else np.zeros(len(raw), dtype=bool)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        return np.where(known, at + 1, len(self.alphabet) + 1), np.r_[0, np.cumsum(lengths)]

    def narrow(self, symbol: np.ndarray | int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Interval of the suffixes that begin with ``symbol`` and go on as those of [low, high)."""
        key = symbol * (self.rows + 1)
        return np.searchsorted(self._places, key + low), np.searchsorted(self._places, key + high)

    def branches(self, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(interval's number, symbol, low, high) of every symbol that precedes an interval's suffixes."""
        letters = np.arange(1, len(self.alphabet) + 1)
        wide = high - low > 2 * len(letters)
        for own in np.array_split(np.flatnonzero(wide), max(1, int(wide.sum()) * len(letters) // _ROWS + 1)):
            which, symbol = np.repeat(own, len(letters)), np.tile(letters, len(own))
            a, b = self.narrow(symbol, low[which], high[which])
            yield which[a < b], symbol[a < b], a[a < b], b[a < b]
        for own in np.array_split(np.flatnonzero(~wide), max(1, int((high - low)[~wide].sum()) // _ROWS + 1)):
            sizes = (high - low)[own]
            at = np.repeat(low[own] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
            pairs = np.unique(np.repeat(own, sizes) * (len(letters) + 2) + self.before[at])
            which, symbol = np.divmod(pairs, len(letters) + 2)
            which, symbol = which[symbol > 0], symbol[symbol > 0]
            yield which, symbol, *self.narrow(symbol, low[which], high[which])

    def near(self, words: list[str], cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs (search, indexed word): equal from ``cuts`` on to the end, one error before it."""
        symbols, begin = self.encode(words)
        q = np.arange(len(words))
        at = np.diff(begin) - 1
        low, high = np.zeros(len(q), dtype=np.int64), np.full(len(q), self.size, dtype=np.int64)
        while (todo := (at >= cuts[q])).any():  # the half without an error
            a, b = self.narrow(symbols[begin[q[todo]] + at[todo]], low[todo], high[todo])
            low[todo], high[todo] = a, b
            at[todo] -= 1
            alive = low < high
            q, at, low, high = q[alive], at[alive], low[alive], high[alive]
        none = np.zeros(0, dtype=np.int64)
        wrong, found = [none] * 4, []
        while len(q) or len(wrong[0]):
            # Searches with their error behind them take one symbol, or end at the delimiter.
            over = wrong[1] < 0
            a, b = self.narrow(0, wrong[2][over], wrong[3][over])
            hit = a < b
            found.append((wrong[0][over][hit], self.in_order[a[hit]]))
            wq, wat, wlow, whigh = (x[~over] for x in wrong)
            a, b = self.narrow(symbols[begin[wq] + wat], wlow, whigh)
            parts = [[wq[a < b], wat[a < b] - 1, a[a < b], b[a < b]]]
            # The others take their error here, or the right symbol.
            inner = at >= 0
            parts.append([q[inner], at[inner] - 1, low[inner], high[inner]])  # a symbol left out
            onward = []
            right = np.where(inner, symbols[begin[q] + np.maximum(at, 0)], -1)
            for which, symbol, a, b in self.branches(low, high):
                parts.append([q[which], at[which], a, b])  # one put in
                same = symbol == right[which]
                swap = ~same & inner[which]
                parts.append([q[which][swap], at[which][swap] - 1, a[swap], b[swap]])
                onward.append([q[which][same], at[which][same] - 1, a[same], b[same]])
            wrong = [np.concatenate(x) for x in zip(*parts, strict=True)]
            q, at, low, high = (np.concatenate(x) for x in zip(*onward, strict=True)) if onward else [none] * 4
        pairs = np.unique(np.concatenate([a * max(self.size, 1) + b for a, b in found]))
        return np.divmod(pairs, max(self.size, 1))


def _found(word: list, n_near: list, top_n: list, top: list) -> pd.DataFrame:
    text = lambda x: pd.Series(x, dtype=object)
    return pd.DataFrame({"word": text(word), "n_near": pd.Series(n_near, dtype="int64"), "top_n": pd.Series(top_n, dtype="int64"), "top": text(top)})


def _search_block(block: pd.DataFrame) -> pd.DataFrame:
    """Near words of a block's searches: their number, and the most frequent of them."""
    reverse = bool(block["side"].iloc[0])
    own = block[block["flag"] & _INDEXED > 0]
    searched = block[block["flag"] & _SEARCHED > 0]
    words, counts, asked = own["s"].tolist(), own["n"].to_numpy(), searched["s"].tolist()
    halves = np.fromiter((len(w) // 2 for w in asked), np.int64, len(asked))
    cuts = np.fromiter(map(len, asked), np.int64, len(asked)) - halves if reverse else halves
    if not words or not asked:
        return _found([], [], [], [])
    a, b = SuffixRanks(words).near(asked, cuts)
    if not reverse:  # equal front halves are found by the other direction
        new = np.fromiter((not words[y].startswith(asked[x][: halves[x]]) for x, y in zip(a, b, strict=True)), bool, len(a))
        a, b = a[new], b[new]
    turn = (lambda w: w[::-1]) if reverse else (lambda w: w)
    top, number = {}, Counter(a.tolist())
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rank = (-int(counts[y]), turn(words[y]))  # strings compare by code points
        top[x] = min(top.get(x, rank), rank)
    return _found([turn(asked[x]) for x in top], [number[x] for x in top], [-r[0] for r in top.values()], [r[1] for r in top.values()])


def near_words(words: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, n_near, top, top_n) of the words that have near words; ``words`` is a written table (word, n) of distinct words.

    ``top`` is the near word of largest n, of equals the first in code-point order.
    """
    total = words.count()
    blocks = max(1, -(-2 * total // block_words))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("word").alias("s")), F.struct(F.lit(1).alias("side"), F.reverse("word").alias("s"))))
    rows = words.select("n", sides.alias("x")).select("n", "x.side", "x.s").withColumn("key", F.expr(f"right(s, {SHARED})"))
    hot = write_stage(
        rows.groupBy("side", "key").count().where(F.col("count") > block_words)
        .select(F.col("side").alias("hs"), F.col("key").alias("hk"), F.ceil(F.col("count") / block_words).cast("int").alias("slices")),
        "shared-ends",
    )
    met = rows.join(hot, (F.col("side") == F.col("hs")) & (F.col("key") == F.col("hk")), "left")
    alone = met.where("slices IS NULL").select(
        "side", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("string").alias("block"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), "s", "n", F.lit(_INDEXED | _SEARCHED).alias("flag")
    )
    crowd = met.where("slices IS NOT NULL").withColumn("own", F.pmod(F.xxhash64("s"), F.col("slices")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    grid = lambda i, j, flag: crowd.select("side", F.concat(F.lit("="), "key").alias("block"), F.col(i).alias("i"), F.col(j).alias("j"), "s", "n", F.lit(flag).alias("flag"))
    dealt = alone.unionByName(grid("own", "other", _INDEXED)).unionByName(grid("other", "own", _SEARCHED))
    # Asked for by number: a block is few bytes, but much work.
    cells = 2 * blocks + (hot.agg(F.sum(F.col("slices") * F.col("slices"))).first()[0] or 0)
    found = dealt.repartition(min(MOST_TASKS, cells), "side", "block", "i", "j").groupBy("side", "block", "i", "j").applyInPandas(_search_block, "word string, n_near long, top_n long, top string")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("top_n")).alias("m"), F.col("top").alias("w"))).alias("b"))
    return best.select("word", "n_near", F.col("b.w").alias("top"), (-F.col("b.m")).alias("top_n"))


def spelling_groups(words: DataFrame, ratio: int = 5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each distinct word of (word, n).

    A word's form is its most frequent near word if that is ``ratio`` times as
    frequent; the root is found by following forms. Counts grow by the ratio at
    each step, so a path has at most log(largest count) steps, and joins that
    double the reach end after the logarithm of that. A word without near words
    has n_near 0 and is its own root. No words give no rows.
    """
    words = write_stage(words.select("word", "n"), "vocabulary")
    near = near_words(words, block_words).withColumnRenamed("word", "nw")
    joined = words.join(near, F.col("word") == F.col("nw"), "left")
    is_form = F.col("top_n") >= ratio * F.col("n")
    formed = write_stage(
        joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("top")).alias("form"), F.when(is_form, F.col("top_n")).alias("form_n")),
        "forms",
    )
    hops = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        far = hops.select(F.col("word").alias("fw"), F.col("root").alias("far"))
        step = write_stage(hops.join(far, F.col("root") == F.col("fw"), "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        hops = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    roots = hops.select(F.col("word").alias("rw"), "root")
    return formed.join(roots, F.col("word") == F.col("rw"), "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
