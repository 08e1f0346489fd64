"""Trie of conversation prefixes from composable fingerprints.

A sequence of turns has the fingerprint ``sum of mark * base ** (turns after it)``
modulo 2**64, twice with different bases. Such products form a monoid: the
fingerprint of "head of one conversation, then tail of another" follows from
three stored prefix fingerprints, so rebuilt conversations are never written
out. A prefix's fingerprint also gives that of the prefix one turn shorter.

Equal fingerprints only propose equal prefixes. Turns are stored once, under a
mark of their content; a mark must stand for one (role, text), and all members
of a node must end in the same stored turn. By induction over the depth their
whole prefixes are then equal. If either check fails, the fingerprints are drawn
anew with other bases.

Conversations of any length are scanned in pieces: rows are range-partitioned
by (conversation, turn), each task works out its piece, and the pieces of a
conversation that spans tasks are composed. Sums over subtrees need no descent:
a node counts for the smallest conversation through it, so its subtree's sum is
the sum over its members, less what that conversation has above the node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordering import running_total
from ..stages import write_stage

#: Ids of one node that end up in one row of its digest's input.
CHUNK_IDS = 4096
_MASK = (1 << 64) - 1
_KEY = ["d", "f1", "f2"]


def bases(attempt: int) -> tuple[int, int]:
    """The two odd bases of an attempt."""
    drawn = np.random.default_rng([77, attempt]).integers(1, 1 << 62, 2, dtype=np.uint64)
    return tuple(int(b) * 2 + 1 for b in drawn)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2**64."""
    steps = np.full(n + 1, base & _MASK, dtype=np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def power_of(base: int, exponents: np.ndarray) -> np.ndarray:
    """base ** each exponent modulo 2**64, by squaring."""
    left, out, square = exponents.astype(np.uint64), np.ones(len(exponents), dtype=np.uint64), base & _MASK
    while left.any():
        out = np.where(left & np.uint64(1), out * np.uint64(square), out)
        left = left >> np.uint64(1)
        square = square * square & _MASK
    return out


def prefix_fingerprints(starts: np.ndarray, marks: np.ndarray, base: int) -> np.ndarray:
    """Fingerprint of the marks from each row's ``starts`` up to the row."""
    n = len(marks)
    up, down = powers(base, n), powers(pow(base, -1, 1 << 64), n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(marks * down[:n], out=total[1:])
    return (total[1:] - total[starts]) * up[:n]


def _longs(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values, dtype=np.uint64).view(np.int64))


def _signed_int(value: int) -> int:
    value &= _MASK
    return value - (1 << 64) if value >> 63 else value


def _scan(sorted_turns: DataFrame, pair: tuple[int, int]) -> DataFrame:
    """(c, part, k, f1, f2, m1, m2, w): prefixes within the task's piece of each conversation."""
    fields = [(n, T.LongType()) for n in ("c", "part", "k", "f1", "f2", "m1", "m2", "w")]
    schema = T.StructType([T.StructField(*f) for f in fields])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None  # conversation, rows and fingerprints so far of the one that the last batch ended in
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            conv = batch.column(0).to_numpy(zero_copy_only=False)
            marks = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=">u8").astype(np.uint64).reshape(n, 2)
            new = np.r_[True, conv[1:] != conv[:-1]]
            starts = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            k = np.arange(n) - starts + 1
            prints = [prefix_fingerprints(starts, marks[:, lane], pair[lane]) for lane in (0, 1)]
            if at is not None and at[0] == conv[0]:
                run = starts == 0
                for lane in (0, 1):
                    prints[lane][run] += np.uint64(at[2 + lane]) * powers(pair[lane], n)[1:][run]
                k[run] += at[1]
            at = (conv[-1], int(k[-1]), int(prints[0][-1]), int(prints[1][-1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(conv), batch.column(1), pa.array(k), *map(_signed, prints), _signed(marks[:, 0]), _signed(marks[:, 1]), batch.column(3)],
                names=schema.names,
            )

    return sorted_turns.select("c", F.spark_partition_id().cast("long").alias("part"), "mark", "w").mapInArrow(scan, schema)


def _offsets(pieces: DataFrame, pair: tuple[int, int]) -> DataFrame:
    """(oc, opart, on, o1, o2) before each later piece of a conversation that spans tasks.

    A task ends in at most one conversation that goes on in the next, so the
    rows that come to the driver are fewer than twice the tasks.
    """
    ends = pieces.groupBy("c", "part").agg(F.max(F.struct("k", "f1", "f2")).alias("e"))
    spans = ends.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("a"), F.max("part").alias("b")).where("n > 1").select(F.col("c").alias("sc"))
    rows = ends.join(spans, F.col("c") == F.col("sc"), "left_semi").select("c", "part", "e.k", "e.f1", "e.f2").orderBy("c", "part").collect()
    out, conv, state = [], None, (0, 0, 0)
    for c, part, k, f1, f2 in rows:
        if c != conv:
            conv, state = c, (0, 0, 0)
        else:
            out.append((c, part, state[0], _signed_int(state[1]), _signed_int(state[2])))
        state = (state[0] + k, state[1] * pow(pair[0], k, 1 << 64) + f1 & _MASK, state[2] * pow(pair[1], k, 1 << 64) + f2 & _MASK)
    schema = ", ".join(f"{n} long" for n in ("oc", "opart", "on", "o1", "o2"))
    return pieces.sparkSession.createDataFrame(out, schema)


def _compose(rows: DataFrame, pair: tuple[int, int], keep: list[str]) -> DataFrame:
    """g * base ** e + f - o * base ** e of both lanes as f1, f2; and without the last mark as p1, p2."""
    names = [*keep, "f1", "f2", "p1", "p2"]
    schema = T.StructType([*[rows.schema[c] for c in keep], *[T.StructField(c, T.LongType()) for c in names[-4:]]])
    inverse = [pow(b, -1, 1 << 64) for b in pair]

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = lambda name, own=batch: _longs(own.column(own.schema.get_field_index(name)))
            grown = [power_of(pair[lane], col("e")) for lane in (0, 1)]
            whole = [(col(f"g{lane + 1}") - col(f"o{lane + 1}")) * grown[lane] + col(f"f{lane + 1}") for lane in (0, 1)]
            shorter = [(whole[lane] - col(f"m{lane + 1}")) * np.uint64(inverse[lane]) for lane in (0, 1)]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, *map(_signed, whole), *map(_signed, shorter)], names=names)

    wanted = list(dict.fromkeys([*keep, "e", "g1", "g2", "o1", "o2", "f1", "f2", "m1", "m2"]))
    return rows.select(*wanted).mapInArrow(compose, schema)


def _members(turns: DataFrame, plan: Callable[[Column], tuple[Column, Column]], most_head: int, pair: tuple[int, int]) -> DataFrame:
    """(c, d, f1, f2, p1, p2, m1, m2, w, last): every prefix of every rebuilt conversation."""
    pieces = write_stage(_scan(turns, pair), "pieces")
    before = F.broadcast(_offsets(pieces, pair))  # fewer rows than tasks
    met = pieces.join(before, (F.col("c") == F.col("oc")) & (F.col("part") == F.col("opart")), "left")
    zero = F.lit(0).cast("long")
    placed = _compose(
        met.select(
            "c", "w", "m1", "m2", "f1", "f2", (F.col("k") + F.coalesce("on", zero)).alias("pos"),
            F.when(F.col("on").isNull(), zero).otherwise(F.col("k")).alias("e"),
            F.coalesce("o1", zero).alias("g1"), F.coalesce("o2", zero).alias("g2"), zero.alias("o1"), zero.alias("o2"),
        ),
        pair, ["c", "w", "m1", "m2", "pos"],
    ).drop("p1", "p2")
    base, head = plan(F.col("c"))
    first = F.when(F.col("pos") <= most_head, F.struct("pos", "f1", "f2", "m1", "m2", "w"))
    convs = write_stage(
        placed.groupBy("c").agg(F.max("pos").alias("n"), F.sort_array(F.collect_list(first)).alias("first"))
        .select("c", "n", "first", base.alias("b"), F.least(head.cast("long"), F.lit(most_head)).alias("h")),
        "conversations",
    )
    heads = convs.select(F.col("c").alias("bc"), F.col("first").alias("head"))
    taken = F.least("h", F.coalesce(F.size("head"), zero))
    own = F.when((F.col("h") > 0) & (F.col("n") >= F.col("h")), F.element_at("first", F.greatest("h", F.lit(1)).cast("int")))
    joint = F.when(F.col("hb") > 0, F.element_at("head", F.greatest("hb", F.lit(1)).cast("int")))
    rebuilt = write_stage(
        convs.join(heads, F.col("b") == F.col("bc"), "left").withColumn("hb", taken.cast("long")).select(
            F.col("c").alias("rc"), "h", "hb", (F.col("hb") + F.greatest(F.col("n") - F.col("h"), zero)).alias("len"),
            F.when(F.col("hb") > 0, F.slice("head", 1, F.col("hb").cast("int"))).alias("head"),
            *[F.coalesce(joint[f"f{k}"], zero).alias(f"g{k}") for k in (1, 2)], *[F.coalesce(own[f"f{k}"], zero).alias(f"o{k}") for k in (1, 2)],
        ),
        "rebuilt",
    )
    nothing = [zero.alias(c) for c in ("e", "g1", "g2", "o1", "o2")]
    root = rebuilt.select(F.col("rc").alias("c"), zero.alias("d"), "len", zero.alias("w"), *[zero.alias(c) for c in ("m1", "m2", "f1", "f2")], *nothing)
    lead = rebuilt.select("rc", "len", F.explode("head").alias("t")).select(
        F.col("rc").alias("c"), F.col("t.pos").alias("d"), "len", "t.w", "t.m1", "t.m2", "t.f1", "t.f2", *nothing
    )
    rest = placed.join(rebuilt, F.col("c") == F.col("rc")).where("pos > h").select(
        "c", (F.col("hb") + F.col("pos") - F.col("h")).alias("d"), "len", "w", "m1", "m2", "f1", "f2",
        (F.col("pos") - F.col("h")).alias("e"), "g1", "g2", "o1", "o2",
    )
    every = _compose(root.unionByName(lead).unionByName(rest), pair, ["c", "d", "len", "w", "m1", "m2"])
    return every.withColumn("last", F.col("d") == F.col("len")).drop("len")


def _digests(ends: DataFrame) -> DataFrame:
    """(d, f1, f2, ends_sha256) of the ids ``c`` that end in a node, ascending.

    A digest reads its list from front to back, so the ids of one node pass
    through one task; they do so as a stream of chunks, never as a group in
    memory. The chunks are made by all tasks that hold the node's ids.
    """
    key = T.StructType([T.StructField(c, T.LongType(), False) for c in _KEY])
    chunked = T.StructType([*key, T.StructField("at", T.LongType()), T.StructField("body", T.StringType())])
    hashed = T.StructType([*key, T.StructField("ends_sha256", T.StringType())])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if not len(rows):
                continue
            change = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
            cuts = [c for a, b in zip(np.r_[0, change], np.r_[change, len(rows)], strict=True) for c in range(a, b, CHUNK_IDS)]
            parts = [rows[a:b] for a, b in zip(cuts, [*cuts[1:], len(rows)], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([int(p[0, i]) for p in parts], pa.int64()) for i in range(4)], pa.array([",".join(map(str, p[:, 3].tolist())) for p in parts])],
                names=chunked.names,
            )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for *own, _, body in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if own != node:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = own, hashlib.sha256(body.encode())
                else:
                    state.update(b"," + body.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(hashed.names, r, strict=True)) for r in done], schema=_arrow(hashed))
        if node is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(hashed.names, (*node, state.hexdigest()), strict=True))], schema=_arrow(hashed))

    parts = ends.select(*_KEY, "c").repartitionByRange(*_KEY, "c").sortWithinPartitions(*_KEY, "c").mapInArrow(chunks, chunked)
    return parts.repartition(*_KEY).sortWithinPartitions(*_KEY, "at").mapInArrow(digest, hashed)


def _arrow(schema: T.StructType) -> pa.Schema:
    return pa.schema([(f.name, pa.string() if isinstance(f.dataType, T.StringType) else pa.int64()) for f in schema])


def spliced(period: int = 20, heads: int = 4) -> Callable[[Column], tuple[Column, Column]]:
    """The rebuilding plan: conversation c opens with the first crc32(c) % heads turns of c - c % period.

    The remainder of a negative id is negative, as SQL has it.
    """

    def plan(c: Column) -> tuple[Column, Column]:
        return c - c % period, F.crc32(c.cast("string").cast("binary")) % heads

    return plan


def prefix_trie(
    conversations: DataFrame, plan: Callable[[Column], tuple[Column, Column]] | None = None, most_head: int = 3,
    conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", first_attempt: int = 0,
) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations.

    ``plan`` maps an id to (base conversation, turns taken from its front, at
    most ``most_head``); those turns replace as many of the conversation's own.
    Returns conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by ``turn``, missing ones first; turns that tie, copies of
    rows among them, all count, in the order of their contents' marks. A missing
    role or text is empty; rows without a conversation id belong to none and are
    left out. An absent base gives no turns. An empty table gives no rows, not
    even a root. Extra columns are ignored, also those with names used inside.
    """
    own = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("c"), F.col(turn).alias("at"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    for attempt in range(first_attempt, first_attempt + 8):
        pair = bases(attempt)
        body = F.concat(F.lit(f"{attempt}:"), F.length("role").cast("string"), F.lit(":"), "role", "text")
        marked = own.withColumn("mark", F.unhex(F.substring(F.sha2(body.cast("binary"), 256), 1, 32)))
        turns = marked.select("c", "at", "mark", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("w"))
        turns = turns.repartitionByRange("c", F.col("at").asc_nulls_first(), "mark").sortWithinPartitions("c", F.col("at").asc_nulls_first(), "mark")
        members = write_stage(_members(turns, plan or spliced(), most_head, pair), "members")
        nodes = write_stage(
            members.groupBy(*_KEY).agg(
                F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("w").alias("w"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
                ((F.min("m1") == F.max("m1")) & (F.min("m2") == F.max("m2"))).alias("alike"),
            ).withColumn("own", (F.col("n_convs") - 1) * F.col("w")),
            "nodes",
        )
        stored = marked.groupBy("mark").agg(F.min(F.struct("role", "text")).alias("a"), F.max(F.struct("role", "text")).alias("z"))
        if nodes.where("NOT alike").isEmpty() and stored.where("a <> z").isEmpty():
            return _report(members, nodes)
    raise RuntimeError("fingerprints of different prefixes met in eight attempts")


def _report(members: DataFrame, nodes: DataFrame) -> DataFrame:
    kids = nodes.where("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("p1").alias("f1"), F.col("p2").alias("f2")).agg(F.count(F.lit(1)).alias("n_children"))
    known = write_stage(nodes.join(kids, _KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")), "known")
    # What the smallest conversation of each node brings to all nodes above: its nodes' savings, and whether it ends in a leaf.
    brought = known.groupBy(F.col("conv_id").alias("bc")).agg(F.sum("own").alias("brings"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    sums = members.join(brought, F.col("c") == F.col("bc")).groupBy(*_KEY).agg(F.sum("brings").alias("below"), F.sum("leaf").alias("n_leaves"))
    above = running_total(known.select(*_KEY, "conv_id", "own"), ["conv_id"], ["d"], F.col("own"), "upto").select(*_KEY, (F.col("upto") - F.col("own")).alias("above"))
    parents = known.select((F.col("d") + 1).alias("d"), F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    full = known.join(sums, _KEY).join(above, _KEY).join(_digests(members.where("last")), _KEY, "left").join(parents, ["d", "p1", "p2"], "left")
    return full.select(
        "conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("below") - F.col("above")).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
