"""Packing of documents into sequences by a grouping genetic algorithm.

An individual is a set of sequences ("bins") that holds all pieces of a block.
Crossover takes over whole well-filled bins of another individual; bins of the
own one that hold any of the same pieces are opened, and what they held besides
goes by best fit into the gaps. Some incomplete bins are opened as well. The
fitness is the mean square of the bins' fill.

Blocks are dealt by hash and bounded in size. On every block several islands
evolve in tasks of their own; between epochs the elite of each also goes to the
next one. When the islands of a block have met, its complete bins are done. The
incomplete ones go on to a next round, where they are dealt to blocks anew as
whole bins: their packing is one of the individuals there, so no round gives up
what an earlier one had. A last block takes what fits into one.
"""

from __future__ import annotations

import json
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..stages import write_stage

#: Splitting of texts before merging: the public pattern of byte-level vocabularies. Fixed value.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

BLOCK_PIECES = 8192
ISLANDS, EPOCHS, ROUNDS = 2, 2, 4
#: Individuals of an island, and crossovers in an epoch.
POPULATION, CROSSOVERS = 6, 120
#: Tasks of an epoch; beyond that a task takes several islands one after the other.
MOST_TASKS = 10_000


def byte_level_encoder(path: str):
    """Encoder of a byte-level vocabulary file (.json); its ids are those of the ``tokenizers`` library.

    Special strings in a text are their special ids, as that library has it by default.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    # Bytes that print stand for themselves, the others for code points from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): rank for token, rank in model["model"]["vocab"].items() if token not in special}
    merges = (m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"])
    if any(model["model"]["vocab"]["".join(m)] != 256 + k for k, m in enumerate(merges)):
        raise ValueError(f"{path}: ids do not follow the order of the merges")
    return tiktoken.Encoding("pieces", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=special)


def cut_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32): each document's ids and ``end_id``, cut into pieces of ``capacity`` if longer.

    All pieces but the first are full. A missing text is empty: one piece of one
    id. Missing and repeated ids are documents like others.
    """
    fields = [T.StructField(c, T.IntegerType() if c == "piece" else T.LongType()) for c in ("piece", "start", "length", "ids_crc32")]
    schema = T.StructType([docs.schema[id], *fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_level_encoder(tokenizer_path)
        for batch in batches:
            row, out = [], []
            for k, body in enumerate(batch.column(1)):
                ids = np.append(encoder.encode_to_numpy(body.as_py() or "", allowed_special="all"), end_id).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                ends = range(first, len(ids) + 1, capacity)
                starts = [0, *ends[:-1]]
                row += [k] * len(ends)
                out += [(p, a, b - a, zlib.crc32(ids[a:b].tobytes())) for p, (a, b) in enumerate(zip(starts, ends, strict=True))]
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int32(), *[pa.int64()] * 3], strict=True)] if out else [pa.array([], t) for t in [pa.int32(), *[pa.int64()] * 3]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *columns], names=schema.names)

    return docs.select(F.col(id), F.col(text).cast("string").alias("__text")).mapInArrow(cut, schema)


class Packing:
    """An individual: bins of piece numbers."""

    __slots__ = ("bins", "fills", "fitness")

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int) -> None:
        self.bins = bins
        self.fills = [sum(lengths[i] for i in b) for b in bins]
        self.fitness = sum((f / capacity) ** 2 for f in self.fills) / max(1, len(bins))


def best_fit(bins: list[list[int]], fills: list[int], pieces: list[int], lengths: list[int], capacity: int) -> list[list[int]]:
    """Put the pieces, in their order, into the bin that they leave least room in; a new one if none has room."""
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r: a bin has r left
    for k, fill in enumerate(fills):
        if fill < capacity:
            by_room.setdefault(capacity - fill, []).append(k)
            rooms |= 1 << (capacity - fill)
    for i in pieces:
        length = lengths[i]
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[k].append(i)
        else:
            k, room = len(bins), capacity
            bins.append([i])
        if room > length:
            by_room.setdefault(room - length, []).append(k)
            rooms |= 1 << (room - length)
    return bins


def cross(own: Packing, other: Packing, lengths: list[int], capacity: int, rng: random.Random) -> Packing:
    """Bins of ``other`` are taken over whole; pieces that lose their bin go by best fit into the gaps."""
    well = sorted(range(len(other.bins)), key=lambda k: -other.fills[k] - rng.random() * capacity / 64)
    well = well[: max(1, len(well) // 2)]
    taken = [other.bins[k] for k in rng.sample(well, max(1, int(len(well) * rng.choice((0.05, 0.2, 0.5)))))]
    injected = {i for b in taken for i in b}
    opened = rng.choice((0.01, 0.05, 0.15))
    bins, fills, loose = [], [], []
    for b, fill in zip(own.bins, own.fills, strict=True):
        if not injected.isdisjoint(b):
            loose += [i for i in b if i not in injected]
        elif rng.random() < (0.5 if fill < capacity else opened):
            loose += b
        else:
            bins.append(list(b))
            fills.append(fill)
    bins += [list(b) for b in taken]
    fills += [sum(lengths[i] for i in b) for b in taken]
    stir = capacity * rng.choice((0, 0, 0.015, 0.07))
    loose.sort(key=lambda i: -lengths[i] - rng.random() * stir)
    return Packing(best_fit(bins, fills, loose, lengths, capacity), lengths, capacity)


def evolve(lengths: list[int], given: list[list[list[int]]], capacity: int, crossovers: int, seed: int) -> Packing:
    """The best individual after some crossovers; ``given`` packings are among the first ones."""
    rng = random.Random(seed)
    least = -(-sum(lengths) // capacity)
    people = [Packing(bins, lengths, capacity) for bins in given]
    best = lambda: min(people, key=lambda p: (len(p.bins), -p.fitness))
    for k in range(POPULATION):
        if people and (len(people) >= POPULATION or len(best().bins) <= least):
            break
        stir = 0 if k == 0 else capacity * k / 40
        order = sorted(range(len(lengths)), key=lambda i: -lengths[i] - rng.random() * stir)
        people.append(Packing(best_fit([], [], order, lengths, capacity), lengths, capacity))
    for _ in range(crossovers):
        if len(best().bins) <= least:
            break
        own, other = rng.sample(people, 2)
        child = cross(own, other, lengths, capacity, rng)
        worst = min(range(len(people)), key=lambda k: people[k].fitness)
        if child.fitness > people[worst].fitness:
            people[worst] = child
    return best()


_PACKED = "block long, island int, origin int, key long, length long, bin long"


def _islands(capacity: int, crossovers: int, epoch: int):
    """Evolves one island of one block from the packings that have arrived there; all of them hold the same pieces."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        block, island = int(rows["block"].iloc[0]), int(rows["island"].iloc[0])
        given = []
        for _, own in rows.sort_values(["origin", "key"]).groupby("origin"):
            keys, lengths = own["key"].to_numpy(), own["length"].tolist()
            bins = own["bin"].to_numpy()
            if (bins >= 0).all():
                number = np.unique(bins, return_inverse=True)[1]
                packed = [[] for _ in range(int(number.max()) + 1)]
                for i, b in enumerate(number.tolist()):
                    packed[b].append(i)
                given.append(packed)
        found = evolve(lengths, given, capacity, crossovers, zlib.crc32(f"{block}:{island}:{epoch}".encode()))
        bins = np.empty(len(keys), dtype=np.int64)
        for members in found.bins:
            bins[members] = keys[members].min()  # the smallest key in it names a bin
        return pd.DataFrame({"block": block, "island": np.int32(island), "origin": np.int32(island), "key": keys, "length": lengths, "bin": bins})

    return run


def _meet(rows: pd.DataFrame) -> pd.DataFrame:
    """The packing of the island with the fewest bins, of equals the one with the fullest."""
    scored = [(own["bin"].nunique(), -float((own.groupby("bin")["length"].sum() ** 2).sum()), k) for k, own in rows.groupby("origin")]
    return rows[rows["origin"] == min(scored)[2]]


def pack_pieces(pieces: DataFrame, capacity: int = 2048, block_pieces: int = BLOCK_PIECES, islands: int = ISLANDS, epochs: int = EPOCHS, rounds: int = ROUNDS, crossovers: int = CROSSOVERS) -> DataFrame:
    """(key, bin) for each row of (key, length): bins of at most ``capacity``, named by the smallest key in them.

    Keys are distinct numbers from 0 on, lengths lie between 1 and ``capacity``. No
    pieces give no rows. Blocks hold about ``block_pieces`` pieces, so a task's
    memory does not grow with the table.
    """
    todo = write_stage(pieces.select("key", "length", F.lit(-1).cast("long").alias("bin")), "loose")
    done = None
    for turn in range(rounds):
        left = todo.count()
        if turn and not left:
            break
        blocks = max(1, -(-left // block_pieces))
        dealt = F.pmod(F.xxhash64(F.lit(turn), F.col("bin" if turn else "key")), F.lit(blocks))
        state = todo.select(
            dealt.cast("long").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.lit(-1).alias("origin"), "key", "length", "bin"
        )
        tasks = min(MOST_TASKS, blocks * islands)  # asked for: the rows are few bytes, but much work
        for epoch in range(epochs):
            state = state.repartition(tasks, "block", "island").groupBy("block", "island").applyInPandas(_islands(capacity, crossovers, turn * epochs + epoch), _PACKED)
            if epoch < epochs - 1:  # the elite stays and goes to the next island
                there = F.array_distinct(F.array("island", ((F.col("island") + 1) % islands).cast("int")))
                state = state.withColumn("island", F.explode(there))
        met = state.groupBy("block").applyInPandas(_meet, _PACKED)
        packed = write_stage(met.select("block", "key", "length", "bin"), "packed")
        full = packed.withColumn("fill", F.sum("length").over(Window.partitionBy("bin")))  # a bin holds at most capacity pieces
        last = blocks == 1 or turn == rounds - 1
        ready = full.where(F.lit(last) | (F.col("fill") == capacity)).select("key", "bin")
        done = ready if done is None else done.unionByName(ready)
        if last:
            break
        todo = write_stage(full.where(F.col("fill") < capacity).select("key", "length", "bin"), "loose")
    return done


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id: str = "doc_id", text: str = "text", **search) -> DataFrame:
    """Each piece's (id, piece, start, length, ids_crc32, sequence_id, offset); see ``cut_documents`` and ``pack_pieces``.

    A full piece is a sequence of its own. Offsets are places in the sequence,
    without gaps from 0. An empty table gives no rows; extra columns are ignored.
    """
    cut = write_stage(cut_documents(docs, tokenizer_path, capacity, end_id, id, text).withColumn("__key", F.monotonically_increasing_id()), "pieces")
    loose = cut.where(F.col("length") < capacity)
    packed = pack_pieces(loose.select(F.col("__key").alias("key"), "length"), capacity, **search)
    placed = loose.join(packed, F.col("__key") == F.col("key")).withColumn("sequence_id", F.col("bin"))
    before = Window.partitionBy("sequence_id").orderBy("__key").rowsBetween(Window.unboundedPreceding, -1)  # at most capacity rows
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
    whole = cut.where(F.col("length") >= capacity).withColumns({"sequence_id": F.col("__key"), "offset": F.lit(0).cast("long")})
    columns = [id, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return whole.select(*columns).unionByName(placed.select(*columns))
