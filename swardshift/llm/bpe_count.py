"""Token counts by heap-and-linked-list byte-pair merging.

A text becomes a linked list of symbols; the adjacent pair of the best rank is
popped from a heap and merged until none is left. The count is the number of
initial symbols less the merges, no identifiers are made. Symbols that the
vocabulary lacks count one for each of their bytes.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
#: A unit is a run of spaces and the run of other characters after it: no piece of the vocabulary reaches across.
_UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: So many units' counts are remembered by a task; then it forgets them and goes on.
REMEMBERED = 1_000_000
#: Longer units are counted afresh rather than remembered.
REMEMBERED_CHARS = 64


def load_ranks(path: str) -> dict[str, int]:
    """Rank of each piece of a byte-pair model (0 merges first), without control and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    usable = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    usable.sort(key=lambda i: (-sp.get_score(i), i))
    ranks, last, rank = {}, None, -1
    for i in usable:  # equal scores share a rank: then the leftmost pair goes first
        score = sp.get_score(i)
        rank += score != last
        last = score
        ranks[sp.id_to_piece(i)] = rank
    bad = [p for p in ranks if SPACE in p.lstrip(SPACE)]
    if bad:
        raise ValueError(f"pieces reach across spaces: {bad[:3]}")
    return ranks


def count_unit(unit: str, ranks: dict[str, int]) -> int:
    """Tokens of one unit: initial symbols less merges, unknown symbols by their bytes."""
    n = len(unit)
    symbols: list[str | None] = list(unit)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = []
    for k in range(n - 1):
        pair = unit[k : k + 2]
        if pair in ranks:
            heap.append((ranks[pair], k, pair))
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, left, pair = heapq.heappop(heap)
        right = after[left] if symbols[left] is not None else -1
        if right < 0 or symbols[left] + symbols[right] != pair:
            continue  # one of the two was merged meanwhile
        symbols[left], symbols[right] = pair, None
        after[left] = after[right]
        if after[right] >= 0:
            before[after[right]] = left
        merges += 1
        for a, b in ((before[left], left), (left, after[left])):
            if a >= 0 and b >= 0:
                joined = symbols[a] + symbols[b]
                if joined in ranks:
                    heapq.heappush(heap, (ranks[joined], a, joined))
    unknown = sum(len(s.encode()) - 1 for s in symbols if s is not None and len(s) == 1 and s not in ranks)
    return n - merges + unknown


class Counter(dict):
    """Counts of units, worked out on first sight; bounded."""

    def __init__(self, ranks: dict[str, int]) -> None:
        super().__init__()
        self.ranks = ranks

    def __missing__(self, unit: str) -> int:
        n = count_unit(unit, self.ranks)
        if len(unit) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[unit] = n
        return n

    def text(self, text: str | None) -> int:
        """Tokens of a whole text: a space is put before it, as the model does, and spaces become marks."""
        if not text:
            return 0
        return sum(map(self.__getitem__, _UNIT.findall(SPACE + text.replace(" ", SPACE))))


def count_tokens(docs: DataFrame, model_path: str, id: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """Each document's (id, n_bytes, n_tokens, over_limit); one row per input row.

    Null and empty texts have no bytes and no tokens; repeated rows repeat;
    a null id stays null; extra columns are ignored. ``model_path`` must name
    the model on every worker. Counted in the scan tasks, without a shuffle; a
    task holds a batch of texts, the vocabulary and a bounded memory of units.
    """
    schema = T.StructType([docs.schema[id], *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_tokens")], T.StructField("over_limit", T.BooleanType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(load_ranks(model_path))
        for batch in batches:
            n_bytes, n_tokens = [], []
            for body in batch.column(1):
                own = body.as_py()
                n_bytes.append(len(own.encode()) if own else 0)
                n_tokens.append(counter.text(own))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
                names=schema.names,
            )

    return docs.select(F.col(id), F.col(text).cast("string").alias("__text")).mapInArrow(count, schema)
