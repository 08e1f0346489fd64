"""MinHash near-duplicates by an LSH forest.

Every distinct set of shingles has a signature of ``trees * depth`` minima. A
tree orders the sets by its own ``depth`` minima; sets with a common prefix lie
together, and the prefix deepens per region until at most ``region`` sets share
it: these are each other's candidates. Regions too crowded even at full depth
(large groups of similar texts) are linked to a pivot, and what that leaves is
found exactly, by an index of each set's rarest shingles that only looks for
links between different components. All links are confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..stages import drop_stages, write_stage
from .components import connected_components
from .wordhash import NOT_SPACE, WordHasher, mix, shingle_set, text_pieces, windows

WIDTH = 5
TREES, DEPTH, LEAST_DEPTH = 16, 8, 4
#: Bits of the filter of ids whose sets are made, at most (32 MB).
MOST_BITS = 1 << 28
#: Shingles of a component that a task holds.
MERGED_TOKENS = 1 << 22
#: Shingles whose frequencies every task knows, at most (4 MB).
MOST_FREQUENT = 1 << 18
#: Sets that a region may hold before its prefix is deepened.
REGION = 32
_SALT = np.uint64(0x632BE59BD9B4E019)
_RNG = np.random.default_rng(5)
_A = _RNG.integers(0, 2**31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 2**32, TREES * DEPTH, dtype=np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """16 bits of the smallest value of each hash function over the set."""
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_A), 0xFFFFFFFF, dtype=np.uint32)
    for k in range(0, len(h), 1024):
        np.minimum(least, (h[k : k + 1024, None] * _A + _B).min(axis=0), out=least)
    return (mix(least.astype(np.uint64) + np.arange(1, len(_A) + 1, dtype=np.uint64) * _SALT) & np.uint64(0xFFFF)).astype(np.uint16)


def prefix_keys(sig: np.ndarray, least_depth: int = LEAST_DEPTH) -> np.ndarray:
    """Key of every tree's prefix at every depth from ``least_depth`` on: trees x depths."""
    own = sig.reshape(TREES, DEPTH).astype(np.uint64)
    key = np.arange(1, TREES + 1, dtype=np.uint64) * _SALT
    out = []
    for d in range(DEPTH):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + own[:, d] + np.uint64(1))
        if d + 1 >= least_depth:
            out.append(key)
    return np.stack(out, axis=1)


def _shingles_by_piece(batch_texts, width: int, hasher: WordHasher) -> Iterator[tuple[int, list[np.ndarray]]]:
    """First row and shingle sets of the texts of each bounded piece of a batch."""
    for first, end, data, offsets in text_pieces(batch_texts):
        h, _, _, before = hasher.words(data, offsets)
        wins = windows(h, width)
        yield first, [shingle_set(h, wins, int(before[k]), int(before[k + 1]), width) for k in range(end - first)]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _signatures(docs: DataFrame, width: int) -> DataFrame:
    """(id, n_shingles, d1, d2, sig, keys): set size, 128-bit digest of the set, signature, shallowest keys."""
    schema = T.StructType([
        docs.schema["id"], T.StructField("n_shingles", T.LongType()), T.StructField("d1", T.LongType()),
        T.StructField("d2", T.LongType()), T.StructField("sig", T.BinaryType()),
    ])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(NOT_SPACE)
        for batch in batches:
            for first, sets in _shingles_by_piece(batch.column(1), width, hasher):
                d1 = [int(_signed(mix(s).sum(dtype=np.uint64, keepdims=True))[0]) for s in sets]
                d2 = [int(_signed(mix(s ^ _SALT).sum(dtype=np.uint64, keepdims=True))[0]) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(d1, pa.int64()),
                     pa.array(d2, pa.int64()), pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())],
                    names=schema.names,
                )

    return docs.select("id", "t").mapInArrow(sign, schema)


def _filter_bits(wanted: DataFrame, value: Column) -> tuple[np.ndarray, int]:
    """Bits that the wanted rows' hashed values set, as bytes, and their number: 16 for each row, at most ``MOST_BITS``."""
    size = 1 << 15
    count = wanted.count()
    while size < min(16 * count, MOST_BITS):
        size *= 2
    place = F.pmod(value, F.lit(size))
    rows = wanted.select(F.bitmap_bucket_number(place + 1).alias("bucket"), F.bitmap_bit_position(place + 1).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(size // 8, dtype=np.uint8)
    for r in rows.collect():  # 4 KB for each 32,768 bits
        out[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out, size


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(rep, n, shingles): the full sets of the documents in ``wanted`` (rep), as sorted 64-bit values.

    Texts are not shuffled: the scan makes the sets of ids that a filter of
    bounded size lets through, and the few that it lets through in error are
    left out by an exact join of the sets.
    """
    schema = T.StructType([T.StructField("rep", docs.schema["id"].dataType), T.StructField("n", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])
    bits, size = _filter_bits(wanted, F.xxhash64("rep"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(NOT_SPACE)
        for batch in batches:
            place = batch.column(2).to_numpy(zero_copy_only=False)
            through = pa.array(np.flatnonzero(bits[place >> 3] >> (place & 7).astype(np.uint8) & 1))
            ids = batch.column(0).take(through)
            for first, sets in _shingles_by_piece(batch.column(1).take(through), width, hasher):
                n = [len(x) for x in sets]
                flat = _signed(np.concatenate(sets))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(sets)), pa.array(n, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(flat))],
                    names=schema.names,
                )

    made = docs.where("id is not null").select("id", "t", F.pmod(F.xxhash64("id"), F.lit(size)).alias("place")).mapInArrow(gather, schema)
    return made.where("n > 0").join(wanted, "rep", "left_semi").distinct()


def _tree_keys(reps: DataFrame, least_depth: int, most_depth: int) -> DataFrame:
    """(rep, tree, depth, key) for every tree and the asked depths."""
    schema = T.StructType([
        T.StructField("rep", reps.schema["rep"].dataType), T.StructField("tree", T.IntegerType()),
        T.StructField("depth", T.IntegerType()), T.StructField("key", T.LongType()),
    ])
    depths = list(range(least_depth, most_depth + 1))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 1000):
                ids = batch.column(0).slice(part, 1000)
                own = [prefix_keys(np.frombuffer(s.as_py(), dtype=np.uint16))[:, [d - LEAST_DEPTH for d in depths]] for s in batch.column(1).slice(part, 1000)]
                each = TREES * len(depths)
                take = pa.array(np.repeat(np.arange(len(ids)), each))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(take), pa.array(np.tile(np.repeat(np.arange(TREES, dtype=np.int32), len(depths)), len(ids))),
                     pa.array(np.tile(np.array(depths, dtype=np.int32), TREES * len(ids))), pa.array(_signed(np.concatenate(own).reshape(-1)))],
                    names=schema.names,
                )

    return reps.select("rep", "sig").mapInArrow(label, schema)


def _region_pairs(regions: DataFrame, least_same: int) -> DataFrame:
    """Candidates (a, b) within regions (key, members): prefix neighbours whose signatures agree often enough.

    Signatures of sets at the similarity sought agree at ``least_same`` places
    or more but for a chance of less than one in a million.
    """
    rep = regions.schema["members"].dataType.elementType["rep"].dataType
    schema = T.StructType([T.StructField("a", rep), T.StructField("b", rep)])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = set()
            for members in batch.column(0).to_pylist():
                ids = [m["rep"] for m in members]
                sigs = np.stack([np.frombuffer(m["sig"], dtype=np.uint16) for m in members])
                for i in range(len(ids) - 1):
                    same = (sigs[i + 1 :] == sigs[i]).sum(axis=1)
                    out.update((min(ids[i], ids[j]), max(ids[i], ids[j])) for j in (np.flatnonzero(same >= least_same) + i + 1).tolist() if ids[i] != ids[j])
            yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in out], schema=pa.schema([("a", arrow), ("b", arrow)]))

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(rep)
    return regions.select("members").mapInArrow(pair, schema)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets have the similarity: 100 * common >= percent * all."""
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    met = pairs.join(left, "a").join(right, "b").withColumn("both", F.size(F.array_intersect("sa", "sb")))
    return met.where(100 * F.col("both") >= percent * (F.size("sa") + F.size("sb") - F.col("both"))).select("a", "b")


def _component_tokens(own: DataFrame) -> DataFrame:
    """(component, token): the shingles of each component, merged by each task that holds some of its sets."""
    schema = T.StructType([own.schema["component"], T.StructField("token", T.LongType())])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        component, held, size = None, [], 0

        def out() -> pa.RecordBatch:
            tokens = np.unique(np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array([component] * len(tokens), arrow), pa.array(tokens)], names=schema.names)

        for batch in batches:
            shingles = batch.column(1)
            for k, name in enumerate(batch.column(0).to_pylist()):
                if name != component and held:
                    yield out()
                    held, size = [], 0
                component = name
                held.append(shingles[k].values.to_numpy(zero_copy_only=False))
                size += len(held[-1])
                if size > MERGED_TOKENS:  # what a task holds is bounded; more rows of a component do no harm
                    held = [np.unique(np.concatenate(held))]
                    size = len(held[0])
                    if size > MERGED_TOKENS // 2:
                        yield out()
                        held, size = [], 0
        if held:
            yield out()

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(own.schema["component"].dataType)
    return own.sortWithinPartitions("component").select("component", "shingles").mapInArrow(merge, schema)


def _frequent(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of (token, df), sorted, and their frequencies: all from that power of two on which leaves at most ``MOST_FREQUENT``."""
    power = F.floor(F.log2("df")).cast("int")
    left, least = MOST_FREQUENT, None
    for r in sorted(df.groupBy(power.alias("power")).count().collect(), reverse=True):  # a row for each power of two
        if r["count"] > left:
            break
        left, least = left - r["count"], r["power"]
    if least is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    found = df.where(power >= least).select("token", "df").toArrow()
    token, often = (found.column(c).to_numpy() for c in ("token", "df"))
    order = np.argsort(token)
    return token[order], often[order]


def _rarest_shared(own: DataFrame, df: DataFrame, percent: int) -> DataFrame:
    """(rep, n, component, c, pos, token): the rarest of each set's shingles that others may share, c in all, by place.

    Of the c shingles that a filter of bounded size takes for those in ``df``
    (it passes all that are), a partner at the similarity shares
    ``ceil(share * n)`` or more, so one of the first ``c - ceil(share * n) + 1``
    in an order that is the same for all sets: frequent ones last, by their
    frequency, then by value. Only these become rows.
    """
    bits, size = _filter_bits(df, F.col("token"))
    known, often = _frequent(df)
    schema = T.StructType([
        own.schema["rep"], own.schema["n"], own.schema["component"], T.StructField("c", T.LongType()), T.StructField("pos", T.IntegerType()), T.StructField("token", T.LongType()),
    ])

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in range(0, whole.num_rows, 256):
                batch = whole.slice(part, 256)
                lists = batch.column(3)
                token = lists.flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                place = token & (size - 1)
                through = bits[place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1
                token, row = token[through], row[through]
                df_of = np.zeros(len(token), dtype=np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, token), len(known) - 1)
                    df_of = np.where(known[at] == token, often[at], 0)
                order = np.lexsort((token, df_of, row))
                token, row = token[order], row[order]
                c = np.bincount(row, minlength=len(lists))
                pos = np.arange(len(row)) - (np.cumsum(c) - c)[row]
                least = -(-percent * batch.column(1).to_numpy() // 100)
                first = np.flatnonzero(pos < (c - least + 1)[row])
                take = pa.array(row[first])
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(k).take(take) for k in range(3)], pa.array(c[row[first]]), pa.array(pos[first].astype(np.int32)), pa.array(token[first])],
                    names=schema.names,
                )

    return own.select("rep", "n", "component", "shingles").mapInArrow(rarest, schema)


def _rare_pairs(sets: DataFrame, crowded: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """Pairs of crowded sets in different components that may reach the similarity. Exact: none is left out.

    Only shingles that two components hold can be shared between them. They are
    found from the shingles of whole components, of which copies have few. A pair
    at the similarity shares one of each set's ``c - ceil(share * n) + 1`` rarest
    ones, c being how many of its n shingles can be shared; a set with fewer than
    ``share * n`` has no partner. Tasks pick them from whole sets, so only the
    rarest become rows. The number of shareable shingles bounds the similarity of
    a set with any partner of a given size, so a set only looks into the size
    classes that it can reach; and the place of a shared shingle in both orders
    bounds what can still be shared.
    """
    named = comps.select(F.col("node").alias("rep"), "component")
    own = sets.join(crowded, "rep", "left_semi").join(named, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    own = write_stage(own.repartitionByRange("component", "rep"), "crowded-sets")
    df = (
        _component_tokens(own).distinct().groupBy("token")
        .agg(F.count(F.lit(1)).alias("df"), F.min("component").alias("lead"), F.max("component").alias("last"))
        .where("lead <> last").select("token", "df", "lead")
    )
    df = write_stage(df, "shared-shingles")
    per_set = _rarest_shared(own, df, percent).join(df.select("token", "lead"), "token")
    placed = write_stage(per_set.withColumn("bin", F.floor(F.log("n") / F.log(F.lit(1.03))).cast("int")), "rare")
    # Of two sets of different components at least one is not of a shingle's lead component.
    probes = placed.where("component <> lead").drop("lead")
    # With c shareable shingles a partner of size m gives at most c / (n + m - c), and at most m / n.
    low = F.expr(f"{percent} * n / 100.0D")
    high = F.least(F.expr(f"c * {100 + percent} / {percent}.0D - n + 1e-6D"), F.expr(f"100.0D * n / {percent} + 1e-6D"))
    first, last = (F.floor(F.log(x) / F.log(F.lit(1.03))).cast("int") for x in (low, high))
    probes = probes.withColumn("high", high).where("high >= 1").withColumn("last", last).withColumn("first", first).where("first <= last").select(
        F.col("rep").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), (F.col("c") - F.col("pos")).alias("ra"), "high", "token", F.explode(F.sequence("first", "last")).alias("bin"))
    found = probes.join(placed.select(F.col("rep").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("c").alias("c_b"), (F.col("c") - F.col("pos")).alias("rb"), "token", "bin"), ["token", "bin"])
    # At the rarest shingle that a pair shares, all it shares lies at or behind it in both orders.
    reach = (
        f"ca <> cb AND nb <= high AND na <= c_b * {100 + percent} / {percent}.0D - nb + 1e-6D "
        f"AND {100 + percent} * least(ra, rb) >= {percent} * (na + nb)"
    )
    return found.where(reach).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = 80, width: int = WIDTH, region: int = REGION
) -> DataFrame:
    """Each document's (id, n_shingles, component_id, kept), linked at ``percent`` hundredths of Jaccard similarity.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a set
    holds the distinct ``width``-word shingles, a shorter text is one shingle.
    Texts without words (null included) are linked with nothing. A component is
    named by its smallest id. One row per input row: rows that repeat an id
    share its component if their texts do; a row without an id is not linked,
    has no component and is kept. Extra columns are ignored.

    Equal sets are one set from the start, so copies cost no links. Region
    pairs are bounded by ``region``, pivots by one pair for each set, tree and
    depth, and the exact search by what the bounds on shareable shingles let
    through.
    """
    own = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("t"))
    signed = write_stage(_signatures(own, width), "signatures")
    usable = signed.where("id is not null and n_shingles > 0")
    groups = usable.groupBy("d1", "d2").agg(F.min(F.struct("id", "sig")).alias("x")).select("d1", "d2", "x.*")
    groups = write_stage(groups.withColumnRenamed("id", "rep"), "groups")
    reps = groups.groupBy("rep").agg(F.min("sig").alias("sig"))  # an id with several texts stands for all of them

    # A pair's minima agree as often as its similarity says; five standard deviations below are allowed.
    share = percent / 100
    least_same = int(TREES * DEPTH * share - 5 * (TREES * DEPTH * share * (1 - share)) ** 0.5)
    shallow = _tree_keys(reps, LEAST_DEPTH, LEAST_DEPTH)
    crowd = shallow.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("pivot")).where("size > 1")
    placed = write_stage(shallow.join(crowd, "key").select("rep", "tree", "key", "size", "pivot"), "placed")
    sig = reps.select("rep", "sig")

    dense = placed.where(F.col("size") > region)
    crowded = write_stage(dense.select("rep").distinct(), "crowded")
    deep = _tree_keys(sig.join(crowded, "rep", "left_semi"), LEAST_DEPTH + 1, DEPTH).join(dense.select("rep", "tree"), ["rep", "tree"], "left_semi")
    deep = write_stage(deep, "deep")
    sizes = deep.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("pivot")).where("size > 1")
    deeper = write_stage(deep.join(sizes, "key"), "deeper")
    # The region of a set in a tree is the shallowest prefix that few enough share.
    settled = deeper.where(F.col("size") <= region).groupBy("rep", "tree").agg(F.min(F.struct("depth", "key")).alias("x")).select("rep", "x.key")
    members = placed.where(F.col("size") <= region).select("rep", "key").union(settled)
    regions = members.join(sig, "rep").groupBy("key").agg(F.collect_list(F.struct("rep", "sig")).alias("members")).where("size(members) > 1")
    near = _region_pairs(regions, least_same)
    hubs = dense.select("rep", "pivot").union(deeper.where(F.col("size") > region).select("rep", "pivot")).where("rep <> pivot").distinct()
    hub_pairs = hubs.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b"))
    pairs = write_stage(near.union(hub_pairs).distinct(), "pairs")
    drop_stages(placed, deep, deeper)

    wanted = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).union(crowded).distinct()
    sets = write_stage(_sets(own, wanted, width), "sets")
    links = write_stage(_confirmed(pairs, sets, percent), "links")
    comps = connected_components(links)
    rest = _confirmed(_rare_pairs(sets, crowded, comps, percent), sets, percent)
    links = write_stage(links.union(rest), "links")
    drop_stages(pairs, sets, crowded)
    comps = connected_components(links)

    named = groups.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("component"))
    joined = signed.join(named, ["d1", "d2"], "left")
    own_component = F.when(F.col("id").isNull(), None).when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.coalesce("component", "id"))
    return joined.select(
        F.col("id").alias(id), "n_shingles", own_component.alias("component_id"),
        F.coalesce(F.col("id") == own_component, F.lit(True)).alias("kept"),
    )
