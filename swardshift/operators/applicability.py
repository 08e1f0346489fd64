"""Area of applicability of a model (Meyer and Pebesma 2021, doi:10.1111/2041-210X.13650).

Distances are taken tile against tile inside Arrow tasks; only one sum, count
and minimum per row and cell leave a task, never the pairs. A cell has a
bounded number of rows whatever the data look like.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .joins import with_group_count
from .profile import scale_parameters, scaled
from .quantiles import exact_quantiles

#: Rows of a tile of distances, and of a fragment that a cell of the grid holds.
TILE_ROWS, FRAGMENT_ROWS = 512, 16_384
#: Bytes of the rows in a block; two blocks meet in a task.
BLOCK_BYTES = 1 << 22
#: Rows below which a piece of a block is not cut further; most terms of the sum that stands for the distances of two pieces, and rows for each.
PIECE_ROWS, MOST_TERMS, ROWS_PER_TERM = 1024, 200, 64
#: The terms end at this share of the pieces' distance; rows of a piece that are checked against what the terms give, and what they may differ by.
TERM_SHARE, CHECKED_ROWS, CHECK_SHARE = 1e-10, 16, 1e-9
#: Rows lie on planes where all but at most so many variables have few values each: most values, and most planes. Most numbers that stand for all planes' rows, nodes of a plane, and nodes along a variable.
FREE_VARIABLES, LEVEL_VALUES, MOST_PLANES, MOST_MOMENTS, MOST_NODES, MOST_ALONG = 2, 64, 2048, 1 << 23, 1 << 13, 1 << 10
#: What a number interpolated between planes may be off, as a share of the largest distance; seconds of a pair of rows, and of a multiplication in a product of matrices.
NODE_SHARE, PAIR_S, PRODUCT_S = 1e-12, 1e-8, 2e-10
#: Training rows that a leaf of the tree aims at, leaves (larger tables have larger leaves), and rows sampled for each.
LEAF_ROWS, MOST_LEAVES, SAMPLE_PER_LEAF = 1024, 4096, 16
#: Tasks that look for nearest rows; beyond that a task takes several cells one after the other, as where they hold fewer pairs.
MOST_TASKS, TASK_PAIRS = 10_000, 1 << 27


def importance_weights(
    importance: Mapping[str, float], columns: Sequence[str], source_of: Mapping[str, str] | None = None
) -> dict[str, float]:
    """Weight per column: its own importance, or for a one-hot column that of its source.

    ``source_of`` comes from ``one_hot_columns``; nothing is guessed from names.
    """
    source_of = source_of or {}
    out, missing = {}, []
    for c in columns:
        base = source_of.get(c, c)
        if base in importance:
            out[c] = float(importance[base])
        else:
            missing.append(c)
    if missing:
        raise ValueError(f"no importance for {missing}")
    return out


def _matrix(table: pa.Table) -> np.ndarray:
    col = table.column("vec").combine_chunks()
    if len(col) == 0:
        return np.empty((0, 0))
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances; near-coincident pairs are recomputed without cancellation."""
    na, nb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    scale = na[:, None] + nb[None, :]
    sq = scale - 2.0 * (a @ b.T)
    i, j = np.nonzero(sq < 1e-4 * scale)
    for lo in range(0, len(i), 65536):
        ii, jj = i[lo:lo + 65536], j[lo:lo + 65536]
        d = a[ii] - b[jj]
        sq[ii, jj] = (d * d).sum(axis=1)
    return np.sqrt(np.maximum(sq, 0.0))


def _other_cluster(table: pa.Table) -> np.ndarray | None:
    return table.column("cluster").to_numpy() if "cluster" in table.column_names else None


def _pair_sums(a: np.ndarray, b: np.ndarray, same: bool, ca: np.ndarray | None, cb: np.ndarray | None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(sums, counts, least) of the distances of each row of a to those of b, and the other way round, tile by tile."""
    mine, theirs = ([np.zeros(len(x)), np.zeros(len(x), dtype="int64"), np.full(len(x), np.inf)] for x in (a, b))
    for i in range(0, len(a), TILE_ROWS):
        for j in range(i if same else 0, len(b), TILE_ROWS):
            x, y = slice(i, i + TILE_ROWS), slice(j, j + TILE_ROWS)
            d = _distances(a[x], b[y])
            valid = np.ones(d.shape, dtype=bool) if ca is None else ca[x][:, None] != cb[y][None, :]
            if same and i == j:
                np.fill_diagonal(valid, False)
            shown, least = np.where(valid, d, 0.0), np.where(valid, d, np.inf)
            for side, own, axis in ((mine, x, 1), (theirs, y, 0)):
                side[0][own] += shown.sum(axis=axis)
                side[1][own] += valid.sum(axis=axis)
                side[2][own] = np.minimum(side[2][own], least.min(axis=axis))
                if same and i == j:
                    break  # the tile holds each pair both ways
    if same:
        mine = [mine[0] + theirs[0], mine[1] + theirs[1], np.minimum(mine[2], theirs[2])]
    return mine, theirs


def _train_cell(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Sums of a cell of the grid: fragment against fragment, on the diagonal a fragment against itself."""
    same = key[0].as_py() == key[1].as_py()
    other = left if same else right
    shown = []
    if left.num_rows and other.num_rows:
        mine, theirs = _pair_sums(_matrix(left), _matrix(other), same, _other_cluster(left), _other_cluster(other))
        shown = [(left.column("id"), mine)] if same else [(left.column("id"), mine), (right.column("id"), theirs)]
    else:  # alone in its cell: no pairs, but rows of the result
        shown = [(t.column("id"), (np.zeros(t.num_rows), np.zeros(t.num_rows, dtype="int64"), np.full(t.num_rows, np.inf))) for t in (left, right) if t.num_rows]
    return pa.concat_tables([pa.table({"id": i, "total": pa.array(t), "n": pa.array(n), "least": pa.array(m)}) for i, (t, n, m) in shown])


def grid_side(n: int, tasks: int) -> int:
    """Fragments along a side of the grid: enough cells for the tasks, and no fragment over ``FRAGMENT_ROWS``."""
    wanted = math.ceil(math.sqrt(2 * tasks))
    return max(1, math.ceil(n / FRAGMENT_ROWS), min(wanted, math.ceil(n / TILE_ROWS)))


def train_distances(train: DataFrame, n: int, side: int | None = None) -> DataFrame:
    """``(id, mean_dist, min_dist)`` of each training row to all others (of other clusters, if there is a column ``cluster``).

    The mean needs every pair. Rows are dealt to ``side`` fragments by hash, and
    every unordered pair of fragments meets in one cell of a triangular grid; a
    row is copied ``side`` times, about the square root of twice the cells. A cell
    works through tiles of bounded size and hands on one sum per row.
    """
    side = side or grid_side(n, int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cells = side * (side + 1) // 2
    rows = train.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(side)).cast("int"))
    left = rows.select(F.col("b").alias("lo"), F.explode(F.sequence(F.col("b"), F.lit(side - 1))).alias("hi"), *train.columns)
    right = rows.where("b > 0").select(F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("lo"), F.col("b").alias("hi"), *train.columns)
    id_type = train.schema["id"].dataType.simpleString()
    # The cells are asked for by number: few bytes, but much work.
    dealt = [x.repartition(min(cells, MOST_TASKS), "lo", "hi").groupBy("lo", "hi") for x in (left, right)]
    sums = dealt[0].cogroup(dealt[1]).applyInArrow(_train_cell, f"id {id_type}, total double, n bigint, least double")
    least = F.min("least")
    return sums.groupBy("id").agg(
        F.try_divide(F.sum("total"), F.sum("n").cast("double")).alias("mean_dist"),
        F.when(least < F.lit(float("inf")), least).alias("min_dist"),
    )


def _halves(lo: int, hi: int) -> tuple[tuple[int, int], tuple[int, int]] | None:
    """The two pieces of a block's rows from ``lo`` to before ``hi``, or none if they are few."""
    middle = (lo + hi) // 2
    return None if hi - lo <= PIECE_ROWS else ((lo, middle), (middle, hi))


def _piece_order(rows: np.ndarray) -> np.ndarray:
    """An order of the rows in which both halves of every piece lie apart along its widest variable."""
    order, stack = np.arange(len(rows)), [(0, len(rows))]
    while stack:
        lo, hi = stack.pop()
        halves = _halves(lo, hi)
        if halves is None:
            continue
        own = rows[order[lo:hi]]
        axis = int((own.max(axis=0) - own.min(axis=0)).argmax())
        order[lo:hi] = order[lo:hi][np.argpartition(own[:, axis], halves[0][1] - lo)]
        stack += halves
    return order


def _packed_block(table: pa.Table) -> pa.Table:
    rows = _matrix(table)
    order = _piece_order(rows)
    shares, copies = (table.column(c).to_numpy().astype(float)[order].tobytes() for c in ("share", "copies"))
    flat = pa.array([rows[order].tobytes()], pa.large_binary()).cast(pa.binary())
    return pa.table({"block": table.column("block").slice(0, 1), "vecs": flat, "shares": [shares], "copies": [copies]})


def _block_sum(a: np.ndarray, b: np.ndarray, sa: np.ndarray, sb: np.ndarray, ca: np.ndarray, cb: np.ndarray) -> float:
    """Sum of all distances between the rows of a and b, times share of the one and copies of the other, both ways round."""
    # Squares are taken around the middle of b, so that little cancels.
    middle = b.mean(axis=0)
    a, b = a - middle, b - middle
    na, nb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    ones = np.ones
    # One product gives the squares: |x|^2 + |y|^2 - 2xy.
    left, right = np.column_stack([-2.0 * a, na, ones(len(a))]), np.column_stack([b, ones(len(b)), nb])
    total = 0.0
    for i in range(0, len(a), TILE_ROWS):
        x = slice(i, i + TILE_ROWS)
        for j in range(0, len(b), TILE_ROWS):
            y = slice(j, j + TILE_ROWS)
            sq = left[x] @ right[y].T
            # Near-coincident pairs are worked out again without cancellation.
            close = sq < (1e-4 * (na[x] + nb[y].max()))[:, None]
            many = np.count_nonzero(close)
            if many > close.size // 64:
                sq[:] = 0.0
                for p, q in zip(a[x].T, b[y].T, strict=True):
                    d = p[:, None] - q[None, :]
                    d *= d
                    sq += d
            elif many:
                k, m = np.nonzero(close)
                d = a[x][k] - b[y][m]
                sq[k, m] = (d * d).sum(axis=1)
            np.sqrt(sq, out=sq)
            total += sa[x] @ (sq @ cb[y]) + ca[x] @ (sq @ sb[y])
    return total


def _from_one(row: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Distances of a row to all rows of a table that is given by its columns."""
    sq = np.zeros(columns.shape[1])
    for value, column in zip(row, columns, strict=True):
        d = column - value
        d *= d
        sq += d
    return np.sqrt(sq, out=sq)


class _Block:
    """A block's rows in the order of its pieces, with the box of each piece."""

    def __init__(self, rows: np.ndarray, shares: np.ndarray, copies: np.ndarray) -> None:
        self.rows, self.shares, self.copies = rows, shares, copies
        self.columns = np.ascontiguousarray(rows.T)
        self.boxes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        self._box((0, len(rows)))

    def _box(self, piece: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        halves = _halves(*piece)
        if halves is None:
            own = self.rows[slice(*piece)]
            box = own.min(axis=0), own.max(axis=0)
        else:
            (low, high), (other_low, other_high) = (self._box(half) for half in halves)
            box = np.minimum(low, other_low), np.maximum(high, other_high)
        self.boxes[piece] = box
        return box

    def width(self, piece: tuple[int, int]) -> float:
        low, high = self.boxes[piece]
        return float(np.sqrt(((high - low) ** 2).sum()))


def _term_sum(a: _Block, x: tuple[int, int], b: _Block, y: tuple[int, int], far: float) -> float | None:
    """:func:`_block_sum` of two pieces that lie apart, or none if few terms do not give their distances.

    Distances between far pieces are smooth, so a few rows and columns of their
    table give all others (adaptive cross approximation, Bebendorf 2000): terms
    are added until the next one is below ``TERM_SHARE`` of the largest distance
    ``far``. Rows spread over the piece are then compared with their true distances.
    """
    own, other = slice(*x), slice(*y)
    left, right = a.columns[:, own], b.columns[:, other]
    rows, columns = a.rows[own], b.rows[other]
    sa, ca, sb, cb = a.shares[own], a.copies[own], b.shares[other], b.copies[other]
    most = min(MOST_TERMS, min(len(rows), len(columns)) // ROWS_PER_TERM)
    u, v = np.empty((most, len(rows))), np.empty((most, len(columns)))
    used, i, terms, small = np.zeros(len(rows), dtype=bool), len(rows) // 2, 0, 0
    while small < 2:
        used[i] = True
        rest = _from_one(rows[i], right) - u[:terms, i] @ v[:terms]
        j = int(np.abs(rest).argmax())
        if abs(rest[j]) <= TERM_SHARE * far * 1e-2:  # this row is given already
            small += 1
            i = int(np.where(used, -1.0, (np.arange(len(rows)) * 7919 + 13) % len(rows)).argmax())
            if used.all():
                break
            continue
        if terms == most:
            return None
        v[terms] = rest / rest[j]
        u[terms] = _from_one(columns[j], left) - v[:terms, j] @ u[:terms]
        left_over = np.abs(u[terms])
        terms += 1
        if terms == most // 2 and left_over.max() > TERM_SHARE**0.5 * far:  # not half way: it would not end in time
            return None
        small = small + 1 if left_over.max() <= TERM_SHARE * far else 0
        left_over[used] = -1.0
        i = int(left_over.argmax())
        if used[i]:
            break
    for k in np.linspace(0, len(rows) - 1, CHECKED_ROWS).astype(int):
        if np.abs(_from_one(rows[k], right) - u[:terms, k] @ v[:terms]).max() > CHECK_SHARE * far:
            return None
    u, v = u[:terms], v[:terms]
    return float((u @ sa) @ (v @ cb) + (u @ ca) @ (v @ sb))


def _pieces_sum(a: _Block, b: _Block, same: bool) -> float:
    """Sum of the distances of two blocks, or of a block to itself: far pieces by terms, near ones pair by pair."""
    total, stack = 0.0, [((0, len(a.rows)), (0, len(b.rows)))]
    while stack:
        x, y = stack.pop()
        halves, other_halves = _halves(*x), _halves(*y)
        if same and x == y:
            if halves is None:
                own = slice(*x)
                some = (a.rows[own], a.shares[own], a.copies[own])
                total += _block_sum(some[0], some[0], some[1], some[1], some[2], some[2]) / 2
            else:
                stack += [(halves[0], halves[0]), (halves[1], halves[1]), halves]
            continue
        (low, high), (other_low, other_high) = a.boxes[x], b.boxes[y]
        gap = np.sqrt((np.maximum(np.maximum(other_low - high, low - other_high), 0.0) ** 2).sum())
        widths = a.width(x), b.width(y)
        if gap > 0 and min(widths) <= gap and (x[1] - x[0]) * (y[1] - y[0]) > 4 * PIECE_ROWS**2:
            found = _term_sum(a, x, b, y, float(gap + sum(widths)))
            if found is not None:
                total += found
                continue
        if halves and (widths[0] >= widths[1] or not other_halves):
            stack += [(half, y) for half in halves]
        elif other_halves:
            stack += [(x, half) for half in other_halves]
        else:
            own, other = slice(*x), slice(*y)
            total += _block_sum(a.rows[own], b.rows[other], a.shares[own], b.shares[other], a.copies[own], b.copies[other])
    return total


def _in_blocks(own: DataFrame, n: int, width: int) -> tuple[DataFrame, int]:
    """Rows with a ``block`` of rows that lie together, of bounded size, and the number of blocks."""
    tasks = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = max(1, BLOCK_BYTES // (8 * max(1, width)))
    wanted = max(math.ceil(n / most), min(math.ceil(math.sqrt(2 * tasks)), math.ceil(n / TILE_ROWS)))
    placed = cut_lineage(_placed(own, box_tree(own, n, wanted)))
    # The tree comes from a sample: leaves that are larger than a block are dealt to several.
    parts = placed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / (2 * most)).cast("int").alias("parts")).collect()
    first, blocks = {}, 0
    for r in parts:
        first[r["leaf"]] = blocks
        blocks += r["parts"]
    spread = own.sparkSession.createDataFrame([(r["leaf"], r["parts"], first[r["leaf"]]) for r in parts], "leaf int, parts int, first int")
    block = F.col("first") + F.pmod(F.xxhash64("vec"), F.col("parts")).cast("int")
    return placed.join(spread, "leaf").select("vec", "copies", "share", block.alias("block")), blocks


def _sum_by_blocks(own: DataFrame, n: int, width: int) -> float:
    """Sum of the distances of all pairs: rows are packed into blocks, and every two blocks meet in a task."""
    dealt, blocks = _in_blocks(own, n, width)
    packed = cut_lineage(dealt.groupBy("block").applyInArrow(_packed_block, "block int, vecs binary, shares binary, copies binary"))
    left, right = (packed.repartitionByRange(blocks, "block").select(*[F.col(c).alias(f"{side}_{c}") for c in packed.columns]) for side in "ab")
    # Every pair of partitions is a task that reads both; nothing is copied to files for it, and no side is broadcast.
    met = left.hint("shuffle_replicate_nl").join(right.hint("shuffle_replicate_nl"), F.col("a_block") <= F.col("b_block"))
    return met.withColumn("apart", F.lit(0.0)).mapInArrow(_met_blocks, "total double").agg(F.sum("total")).first()[0]


def _met_blocks(batches):
    """The sum of each pair of blocks; ``apart`` is a distance that all their rows have besides, at right angles."""
    for batch in batches:
        for k in range(batch.num_rows):
            get = lambda c, k=k, batch=batch: np.frombuffer(batch.column(c)[k].as_buffer(), dtype=float)
            copies = [get(f"{s}_copies") for s in "ab"]
            rows = [get(f"{s}_vecs").reshape(len(c), -1) for s, c in zip("ab", copies, strict=True)]
            if apart := batch.column("apart")[k].as_py():
                rows = [np.column_stack([x, np.full(len(x), end)]) for x, end in zip(rows, (0.0, apart), strict=True)]
            a, b = (_Block(x, get(f"{s}_shares"), c) for s, x, c in zip("ab", rows, copies, strict=True))
            same = batch.column("a_block")[k].as_py() == batch.column("b_block")[k].as_py()
            yield pa.RecordBatch.from_arrays([pa.array([_pieces_sum(a, b, same)])], names=["total"])


def _bernstein(apart: float, half: float) -> int:
    """Chebyshev nodes on an interval of a half-width for a function whose nearest singularity lies ``apart`` beside it."""
    if half <= 0:
        return 1
    rho = apart / half + math.sqrt(1.0 + (apart / half) ** 2)
    return max(2, math.ceil((math.log(1.0 / NODE_SHARE) + math.log(4.0 / (rho - 1.0))) / math.log(rho)))


class _Nodes:
    """Chebyshev nodes of an interval, and the shares that a place between them takes of each."""

    def __init__(self, lo: float, hi: float, n: int) -> None:
        self.middle, self.half, self.n = (lo + hi) / 2, (hi - lo) / 2, n
        angle = (2 * np.arange(n) + 1) * math.pi / (2 * n)
        self.at = self.middle + self.half * np.cos(angle)
        # From Chebyshev sums to the nodes' shares.
        self.shares_of = 2.0 / n * np.cos(angle[:, None] * np.arange(n)[None, :])
        self.shares_of[:, 0] /= 2.0

    def polynomials(self, x: np.ndarray) -> np.ndarray:
        """T_k at each place, a row for each k."""
        t = np.clip((x - self.middle) / self.half if self.half else np.zeros(len(x)), -1.0, 1.0)
        out = np.ones((self.n, len(x)))
        if self.n > 1:
            out[1] = t
        for k in range(2, self.n):
            np.multiply(out[k - 1], 2.0 * t, out=out[k])
            out[k] -= out[k - 2]
        return out

    def shares(self, x: np.ndarray) -> np.ndarray:
        return self.shares_of @ self.polynomials(x)


class _Planes:
    """Which rows' distances are interpolated: those of rows on planes that lie ``apart`` or more, through ``free`` nodes on each plane and ``square`` ones between squared distances of planes."""

    def __init__(self, squares: np.ndarray, counts: np.ndarray, spans: list[tuple[float, float]]) -> None:
        self.squares, self.spans, self.seconds = squares, spans, math.inf
        planes = len(counts)
        upper = np.triu_indices(planes)
        apart, pairs = squares[upper], np.outer(counts, counts)[upper].astype(float)
        pairs[upper[0] == upper[1]] /= 2
        self.all_pairs_s = float(pairs.sum()) * PAIR_S
        order = np.argsort(apart, kind="stable")
        apart, before = apart[order], np.concatenate([[0.0], np.cumsum(pairs[order])[:-1]]) * PAIR_S
        starts = np.flatnonzero(np.concatenate([[False], np.diff(apart) > 1e-9 * apart[1:]]))
        if not len(starts):
            return
        tried = np.searchsorted(apart[starts], np.geomspace(apart[starts[0]], apart[-1], 256))
        for k in starts[np.unique(np.minimum(tried, len(starts) - 1))]:
            free, square = self._sizes(apart[k], apart[-1])
            nodes = math.prod(free)
            products = square * (planes * nodes * nodes + planes * planes * nodes) + counts.sum() * nodes
            seconds = before[k] + products * PRODUCT_S
            if planes * nodes <= MOST_MOMENTS and nodes <= MOST_NODES and max(free) <= MOST_ALONG and seconds < self.seconds:
                self.seconds, self.least, self.most = seconds, apart[k], apart[-1]

    def _sizes(self, least: float, most: float) -> tuple[list[int], int]:
        free = [_bernstein(math.sqrt(least), (hi - lo) / 2) for lo, hi in self.spans]
        return free, _bernstein(math.pi, math.log(most / least) / 2)

    def settle(self) -> bool:
        """Take the nodes, and more of them until distances at places drawn at random come out right."""
        self.least *= 1 - 1e-12  # a hair of slack, so that rounding splits no group of equal squares
        free, square = self._sizes(self.least, self.most)
        rng = np.random.default_rng(11)
        for _ in range(6):
            self.free = [_Nodes(lo, hi, n) for (lo, hi), n in zip(self.spans, free, strict=True)]
            self.square = _Nodes(math.log(self.least), math.log(self.most), square)
            worst, largest = 0.0, math.sqrt(self.most + sum((hi - lo) ** 2 for lo, hi in self.spans))
            places = [[rng.uniform(lo, hi, 48) for lo, hi in self.spans] for _ in range(2)]
            shares = [self._moments(p, np.eye(48)) for p in places]
            nodes = shares[0].shape[1]
            by_square = [
                sum(shares[0][:, lo:lo + 256] @ (self._kernel(k, slice(lo, lo + 256)) @ shares[1].T) for lo in range(0, nodes, 256)) for k in range(self.square.n)
            ]
            for u in (self.least, self.most, *np.exp(rng.uniform(math.log(self.least), math.log(self.most), 6))):
                true = np.sqrt(u + sum((a[:, None] - b[None, :]) ** 2 for a, b in zip(*places, strict=True)))
                got = sum(w * x for w, x in zip(self.square.shares(np.array([math.log(u)]))[:, 0], by_square, strict=True))
                worst = max(worst, float(np.abs(true - got).max()))
            if worst <= 10 * NODE_SHARE * largest:
                return True
            free, square = [math.ceil(1.1 * n) + 1 for n in free], square if self.most <= self.least else math.ceil(1.1 * square) + 1
        return False

    def _kernel(self, k: int, rows: slice) -> np.ndarray:
        """Distances between nodes of two planes at the k-th squared distance: some rows of the table."""
        grid = [g.ravel() for g in np.meshgrid(*[f.at for f in self.free], indexing="ij")]
        sq = np.full((len(grid[0][rows]), len(grid[0])), math.exp(self.square.at[k]))
        for g in grid:
            d = g[rows][:, None] - g[None, :]
            d *= d
            sq += d
        return np.sqrt(sq, out=sq)

    def _moments(self, places: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
        """What rows at some places, with weights (a row for each sum), give to the nodes of their plane."""
        out = []
        polynomials = [f.polynomials(x) for f, x in zip(self.free, places, strict=True)]
        for w in weights:
            if len(polynomials) == 1:
                out.append(self.free[0].shares_of @ (polynomials[0] @ w))
            else:
                sums = (polynomials[0] * w) @ polynomials[1].T
                out.append((self.free[0].shares_of @ sums @ self.free[1].shares_of.T).ravel())
        return np.array(out)

    def moments(self, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """:meth:`_moments` of any number of rows, a slice after the other."""
        total = 0.0
        step = max(64, (1 << 20) // max(f.n for f in self.free))
        for lo in range(0, len(rows), step):
            own = slice(lo, lo + step)
            total = total + self._moments(list(rows[own].T), weights[:, own])
        return total

    def far_sum(self, k: int, rows: slice, shares: np.ndarray, copies: np.ndarray) -> float:
        """The part of the sum over pairs on planes far apart that falls to a squared distance's node and some rows of its table."""
        far = self.squares >= self.least
        weight = np.zeros(self.squares.shape)
        squares = np.log(self.squares[far])
        for lo in range(0, len(squares), 65536):
            squares[lo:lo + 65536] = self.square.shares_of[k] @ self.square.polynomials(squares[lo:lo + 65536])
        weight[far] = squares
        return float(((self._kernel(k, rows) @ (weight @ copies).T) * shares[:, rows].T).sum())


def _on_planes(own: DataFrame, n: int, width: int) -> tuple[_Planes, list[int], dict[bytes, int], list[int]] | None:
    """The planes that rows lie on, their free variables, numbers by their fixed values, and rows; or none if that is not worth it."""
    if n * float(n) / 2 * PAIR_S < 1.0 or not width:
        return None
    at = [F.col("vec")[i] for i in range(width)]
    seen = own.agg(*[f(c).alias(f"{f.__name__}_{i}") for i, c in enumerate(at) for f in (F.approx_count_distinct, F.min, F.max)]).first()
    free = [i for i in range(width) if seen[f"approx_count_distinct_{i}"] > LEVEL_VALUES]
    fixed = [i for i in range(width) if i not in free]
    spans = [(seen[f"min_{i}"], seen[f"max_{i}"]) for i in free]
    if not 1 <= len(free) <= FREE_VARIABLES or not fixed or not np.isfinite(spans).all():
        return None
    found = own.groupBy(F.array(*[at[i] for i in fixed]).alias("fixed")).agg(F.count(F.lit(1)).alias("n")).limit(MOST_PLANES + 1).collect()
    if len(found) > MOST_PLANES:
        return None
    levels, counts = np.array([r["fixed"] for r in found]) + 0.0, np.array([r["n"] for r in found])
    squares = np.zeros((len(levels), len(levels)))
    for column in levels.T:
        squares += (column[:, None] - column[None, :]) ** 2
    planes = _Planes(squares, counts, spans)
    if planes.seconds > planes.all_pairs_s / 3 or not planes.settle():
        return None
    return planes, free, {row.tobytes(): g for g, row in enumerate(levels)}, [int(c) for c in counts]


def _sum_by_planes(own: DataFrame, n: int, width: int) -> float | None:
    """Sum of the distances of all pairs where rows lie on planes, or none where they do not, or few pairs make that needless.

    With all but two variables fixed to few values (0/1 columns of categories),
    rows of two planes are ``sqrt(u + dx^2 + dy^2)`` apart, ``u`` the planes'
    squared distance. Where it is not small, that is smooth in x, y and log(u), so
    the rows' distances follow from those of Chebyshev nodes, to ``NODE_SHARE`` of
    the largest: a row gives to its plane's nodes once, whatever the other rows.
    Planes close to each other, and each with itself, are worked out by blocks.
    """
    found = _on_planes(own, n, width)
    if found is None:
        return None
    planes, free, number, counts = found
    fixed = [i for i in range(width) if i not in free]
    first = np.concatenate([[0], np.cumsum([-(-c // FRAGMENT_ROWS) for c in counts])])

    def place(batches):
        for batch in batches:
            rows = _matrix(pa.Table.from_batches([batch]))
            if len(rows):
                plane = np.array([number[row.tobytes()] for row in rows[:, fixed] + 0.0], dtype="int32")
                parts = np.diff(first)[plane]
                block = first[plane] + batch.column("h").to_numpy() % parts
                at = [pa.array(np.ascontiguousarray(rows[:, i])) for i in free]
                yield pa.RecordBatch.from_arrays([pa.array(block.astype("int32")), pa.array(plane), *at, batch.column("share"), batch.column("copies")], names=names)

    names = ["block", "plane", *[f"x{i}" for i in range(len(free))], "share", "copies"]
    schema = "block int, plane int, " + ", ".join(f"x{i} double" for i in range(len(free))) + ", share double, copies bigint"

    def pack(table: pa.Table) -> pa.Table:
        rows = np.column_stack([table.column(f"x{i}").to_numpy() for i in range(len(free))])
        order = _piece_order(rows)
        rows = rows[order]
        weights = np.array([table.column(c).to_numpy().astype(float)[order] for c in ("share", "copies")])
        packed = [rows.tobytes(), weights[0].tobytes(), weights[1].tobytes(), planes.moments(rows, weights).tobytes()]
        return pa.table({"block": table.column("block").slice(0, 1), "plane": table.column("plane").slice(0, 1)} | dict(zip(("vecs", "shares", "copies", "moments"), ([x] for x in packed), strict=True)))

    placed = own.withColumn("h", F.pmod(F.xxhash64("vec"), F.lit(1 << 30))).mapInArrow(place, schema)
    packed = cut_lineage(placed.groupBy("block").applyInArrow(pack, "block int, plane int, vecs binary, shares binary, copies binary, moments binary"))
    spark = own.sparkSession

    # Planes far apart: the nodes of all planes are bounded in number.
    def added(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), dtype=float) for x in table.column("moments"))
        return pa.table({"plane": table.column("plane").slice(0, 1), "moments": [total.tobytes()]})

    nodes = math.prod(f.n for f in planes.free)
    shares, copies = (np.zeros((len(counts), nodes)) for _ in range(2))
    for r in packed.select("plane", "moments").groupBy("plane").applyInArrow(added, "plane int, moments binary").toLocalIterator():
        shares[r["plane"]], copies[r["plane"]] = np.frombuffer(r["moments"]).reshape(2, -1)
    slices = max(1, math.ceil(nodes / max(512, len(counts))))
    height = -(-nodes // slices)
    sent = spark.sparkContext.broadcast((shares, copies))

    def far(batches):
        for batch in batches:
            for k in batch.column("id").to_pylist():
                lo = k % slices * height
                yield pa.RecordBatch.from_arrays([pa.array([planes.far_sum(k // slices, slice(lo, lo + height), *sent.value)])], names=["total"])

    parts = slices * planes.square.n
    total = spark.range(0, parts, 1, min(parts, MOST_TASKS)).mapInArrow(far, "total double").agg(F.sum("total")).first()[0]
    sent.unpersist()
    # Each plane with itself and with those near it, block by block.
    near = [
        (a, b, math.sqrt(planes.squares[g, h]))
        for g, h in zip(*(x.tolist() for x in np.nonzero(np.triu(planes.squares < planes.least))), strict=True)
        for a in range(first[g], first[g + 1]) for b in range(first[h], first[h + 1]) if a <= b
    ]
    pairs = spark.createDataFrame([(int(a), int(b), float(d)) for a, b, d in near], "a_block int, b_block int, apart double")
    for side in "ab":
        rows = packed.select(*[F.col(c).alias(f"{side}_{c}") for c in ("block", "vecs", "shares", "copies")])
        pairs = pairs.join(rows.hint("merge"), f"{side}_block")
    worked = sum(counts[g] * counts[h] for g, h in zip(*np.nonzero(np.triu(planes.squares < planes.least)), strict=True))
    tasks = min(len(near), MOST_TASKS, max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(len(near) / 64), math.ceil(worked / TASK_PAIRS)))
    pairs = pairs.repartition(tasks, "a_block", "b_block")
    return total + pairs.mapInArrow(_met_blocks, "total double").agg(F.sum("total")).first()[0]


def mean_train_distance(train: DataFrame) -> float | None:
    """Mean over the ids of ``(id, vec)`` of an id's mean distance to all other rows.

    The mean takes in every pair of different rows; equal rows are one, with their
    number. Where all but two variables have few values, rows on planes far apart
    meet through nodes of their planes. Else, and for planes close together, rows
    are packed into blocks of bounded size that lie together, written once, and
    two blocks meet in a task that hands on one number. Within it, near pieces of
    blocks are worked out pair by pair; the distances of far ones follow from few
    rows and columns of their table, to ten digits and more.
    """
    own = with_group_count(train.select("id", "vec"), ["id"], "of_id").groupBy("vec").agg(
        F.count(F.lit(1)).alias("copies"), F.sum(1.0 / F.col("of_id")).alias("share")
    )
    own = cut_lineage(own)
    size = own.agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("rows"), F.sum("share").alias("ids"), F.max(F.size("vec")).alias("width")).first()
    if not size["rows"] or size["rows"] < 2:
        return None
    summed = _sum_by_planes(own, size["n"], size["width"])
    if summed is None:
        summed = _sum_by_blocks(own, size["n"], size["width"])
    return summed / ((size["rows"] - 1) * size["ids"])


class BoxTree:
    """A binary tree of boxes over training rows. The cuts come from a sample, the boxes from all rows of a leaf."""

    def __init__(self, sample: np.ndarray, leaves: int, apart: float = math.inf) -> None:
        """Variables of two values more than ``apart`` from each other are cut first."""
        self.axis, self.cut, self.kids, self.leaf_of = [], [], [], []
        self.leaves = 0
        low, high = (sample.min(axis=0), sample.max(axis=0)) if len(sample) else (np.zeros(0), np.zeros(0))
        self.two = np.flatnonzero((high - low > apart) & ((sample == low) | (sample == high)).all(axis=0))
        self.halfway = (low + high)[self.two] / 2
        self._grow(sample, leaves)
        self.axis, self.cut, self.kids, self.leaf_of = np.array(self.axis), np.array(self.cut), np.array(self.kids).reshape(-1, 2), np.array(self.leaf_of)

    def _grow(self, rows: np.ndarray, leaves: int) -> int:
        node = len(self.axis)
        for part in (self.axis, self.cut, self.kids, self.leaf_of):
            part.append(-1)
        self.kids[node] = (-1, -1)
        spread = rows.var(axis=0) if leaves > 1 and len(rows) > 1 else np.zeros(1)
        if spread.max() <= 0:
            self.leaf_of[node] = self.leaves
            self.leaves += 1
            return node
        share = (rows[:, self.two] > self.halfway).mean(axis=0)
        share = np.minimum(share, 1 - share)
        if len(share) and share.max() * leaves >= 0.5:
            pick = int(share.argmax())
            axis, cut = int(self.two[pick]), float(self.halfway[pick])
            values = rows[:, axis]
        else:
            # The widest variable is cut at its median, or, where that holds the largest value, at its mean (0/1 columns).
            axis = int(spread.argmax())
            values = rows[:, axis]
            cut = float(np.median(values))
            if not (values > cut).any():
                cut = float(values.mean())
        below = values <= cut
        share = max(1, min(leaves - 1, round(leaves * below.mean())))
        self.axis[node], self.cut[node] = axis, cut
        self.kids[node] = (self._grow(rows[below], share), self._grow(rows[~below], leaves - share))
        return node

    def place(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        node = np.zeros(len(rows), dtype=int)
        while (inner := self.leaf_of[node] < 0).any():
            at = node[inner]
            node[inner] = self.kids[at, (rows[inner, self.axis[at]] > self.cut[at]).astype(int)]
        return self.leaf_of[node]

    def set_boxes(self, lows: dict[int, np.ndarray], highs: dict[int, np.ndarray], width: int) -> None:
        """Boxes of the leaves, and of each node around those of its kids; a leaf without rows is out of reach."""
        self.low, self.high = np.full((len(self.axis), width), np.inf), np.full((len(self.axis), width), -np.inf)
        for node in range(len(self.axis) - 1, -1, -1):  # kids come after their parent
            leaf = int(self.leaf_of[node])
            if leaf in lows:
                self.low[node], self.high[node] = lows[leaf], highs[leaf]
            elif leaf < 0:
                pair = self.kids[node]
                self.low[node], self.high[node] = self.low[pair].min(axis=0), self.high[pair].max(axis=0)

    def gap(self, rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Distance of each row to its node's box: no training row in it is nearer."""
        out = np.empty(len(nodes))
        for k in range(0, len(nodes), 8192):
            own, at = rows[k:k + 8192], nodes[k:k + 8192]
            short = np.maximum(np.maximum(self.low[at] - own, own - self.high[at]), 0.0)
            out[k:k + 8192] = np.sqrt((short * short).sum(axis=1))
        return out

    def within(self, rows: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row number, leaf, gap) of all leaves no farther than ``reach``, in the order of (row, gap, leaf)."""
        row, node = np.arange(len(rows)), np.zeros(len(rows), dtype=int)
        found = []
        while len(row):
            gap = self.gap(rows[row], node)
            near = gap <= reach[row]
            row, node, gap = row[near], node[near], gap[near]
            end = self.leaf_of[node] >= 0
            found.append((row[end], self.leaf_of[node[end]], gap[end]))
            row, node = np.repeat(row[~end], 2), self.kids[node[~end]].reshape(-1)
        row, leaf, gap = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((leaf, gap, row))
        return row[order], leaf[order], gap[order]


def _usual_gap(sample: np.ndarray) -> float:
    """Distance within which most rows have their nearest other one: that of rows of a sample, which lie farther apart."""
    some = sample[np.unique(np.linspace(0, len(sample) - 1, 256).astype(int))] if len(sample) else sample
    least = np.full(len(some), np.inf)
    for j in range(0, len(sample), 4096):
        d = _distances(some, sample[j:j + 4096])
        d[d == 0] = np.inf
        least = np.minimum(least, d.min(axis=1))
    least = least[np.isfinite(least)]
    return float(np.median(least)) if len(least) else math.inf


def box_tree(train: DataFrame, n: int, leaves: int | None = None, gaps_first: bool = False) -> BoxTree:
    """Tree over the rows' ``vec``; a bounded sample of rows and the leaves' boxes come to the driver.

    With ``gaps_first`` it is cut where no row's nearest lies across: between the
    two values of a variable that are farther apart than near rows are.
    """
    leaves = min(MOST_LEAVES, leaves or max(1, math.ceil(n / LEAF_ROWS)))
    wanted = SAMPLE_PER_LEAF * leaves
    # A draw by hash, so that a lost executor draws the same rows again.
    drawn = train.where(F.pmod(F.xxhash64(F.lit(3), "vec"), F.lit(1 << 30)) < F.lit(min(1 << 30, int(2.0 * wanted / max(n, 1) * (1 << 30)) + 1)))
    sample = _matrix(drawn.select("vec").limit(wanted).toArrow())
    if not len(sample):
        sample = _matrix(train.select("vec").limit(wanted).toArrow())
    return BoxTree(sample, leaves, _usual_gap(sample) if gaps_first else math.inf)


def _placed(rows: DataFrame, tree: BoxTree) -> DataFrame:
    """Rows (vec, ...) with their leaf."""

    def place(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            leaf = tree.place(_matrix(table)) if batch.num_rows else np.zeros(0, dtype=int)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], names=[*batch.schema.names, "leaf"])

    return rows.mapInArrow(place, T.StructType([*rows.schema, T.StructField("leaf", T.IntegerType())]))


def _next_visits(state: DataFrame, tree: BoxTree, first: int, last: int) -> DataFrame:
    """(id, vec, leaf): of the leaves that may hold a nearer row than ``best``, nearest box first, those from ``first`` to before ``last``."""
    schema = T.StructType([state.schema["id"], state.schema["vec"], T.StructField("leaf", T.IntegerType())])

    def visits(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _matrix(pa.Table.from_batches([batch]).select(["vec"]))
            best = batch.column("best").to_numpy(zero_copy_only=False).astype(float)
            best = np.where(np.isnan(best), np.inf, best)
            home = tree.place(rows)
            row, leaf, _ = tree.within(rows, _reach(best))
            other = leaf != home[row]
            row, leaf = row[other], leaf[other]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            due = (rank >= first) & (rank < last)
            taken = pa.array(row[due])
            yield pa.RecordBatch.from_arrays([batch.column("id").take(taken), batch.column("vec").take(taken), pa.array(leaf[due], pa.int32())], names=schema.names)

    return state.select("id", "vec", "best").mapInArrow(visits, schema)


def _nearest_cell(key: tuple, left: pa.Table, right: pa.Table, others: bool, tree: BoxTree | None) -> pa.Table:
    """Least distances of the left rows to the right ones; with a tree, of rows at home, also ``vec`` of those that other leaves may hold a nearer row for."""
    if left.num_rows == 0:
        return pa.table({"id": left.column("id"), "d": pa.array([], pa.float64())} | ({"vec": left.column("vec")} if tree else {}))
    a, b = _matrix(left), _matrix(right)
    least = np.full(len(a), np.inf)
    for i in range(0, len(a), TILE_ROWS):
        for j in range(0, len(b), TILE_ROWS):
            own = slice(i, i + TILE_ROWS)
            d = _distances(a[own], b[j:j + TILE_ROWS])
            if others:
                d[d == 0] = np.inf
            least[own] = np.minimum(least[own], d.min(axis=1))
    found = pa.table({"id": left.column("id"), "d": pa.array(least)})
    if tree is None:
        return found
    more = np.isinf(least)
    known = np.flatnonzero(~more)
    if tree.leaves > 1 and len(known):
        row, leaf, _ = tree.within(a[known], _reach(least[known]))
        more[known[row[leaf != key[0].as_py()]]] = True
    at = np.where(more, np.arange(len(a)), -1)
    return found.append_column("vec", left.column("vec").take(pa.array(at, mask=at < 0)))


def _reach(best: np.ndarray) -> np.ndarray:
    """A hair of slack keeps rounding from leaving out a box that ties."""
    return best * (1 + 1e-9) + 1e-12


def _visit(asked: DataFrame, rows: DataFrame, others: bool = False, tree: BoxTree | None = None) -> DataFrame:
    """``(id, d)``: each visit's least distance to the rows of its leaf, with ``others`` to those at another place.

    Leaves with many rows are cut into pieces and many visits into slices, so a
    cell holds a bounded number of either; every slice meets every piece. With a
    ``tree`` rows are at home: they come back even from leaves without rows, and
    with their ``vec`` where other leaves are to be visited too.
    """
    both = asked.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).join(
        rows.groupBy(F.col("leaf").alias("l2")).agg(F.count(F.lit(1)).alias("n2")), F.col("leaf") == F.col("l2"), "left" if tree else "inner"
    )
    fragments = lambda n: F.greatest(F.lit(1), F.ceil(F.coalesce(F.col(n), F.lit(0)) / FRAGMENT_ROWS).cast("int"))
    sizes = cut_lineage(both.select(F.col("leaf").alias("sl"), fragments("n").alias("slices"), fragments("n2").alias("pieces"), (F.col("n") * F.col("n2")).alias("pairs")))
    total = sizes.agg(F.sum(F.col("slices") * F.col("pieces")).alias("cells"), F.sum(F.col("pairs").cast("double")).alias("pairs")).first()
    cells = total["cells"]
    id_type = asked.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, d double" + (", vec array<double>" if tree else "")
    if not cells:
        return asked.sparkSession.createDataFrame([], schema)
    # The cells are asked for by number: few bytes, but much work. Small ones share a task.
    partitions = 2 * int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = min(cells, MOST_TASKS, max(partitions, math.ceil((total["pairs"] or 0) / TASK_PAIRS)))

    def dealt(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        cut = df.join(sizes.drop("pairs"), F.col("leaf") == F.col("sl")).withColumn(own, F.pmod(F.xxhash64(key), F.col(f"{own}s")).cast("int"))
        spread = cut.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)))
        names = [c for c in ("id", "vec") if c in df.columns]
        keys = ["leaf", "slice", "piece"]
        return spread.select(*keys, *names).repartition(tasks, *keys).groupBy(*keys)

    return dealt(asked, "id", "slice", "piece").cogroup(dealt(rows, "vec", "piece", "slice")).applyInArrow(lambda key, left, right: _nearest_cell(key, left, right, others, tree), schema)


def nearest_train_distance(new: DataFrame, train: DataFrame, n_train: int, visits: list[int] | None = None, others: bool = False, unique: bool = False) -> DataFrame:
    """``(id, min_dist)``: exact distance of each new row to its nearest training row.

    Training rows lie in the leaves of a tree of boxes. A new row first visits
    the leaf it falls into; then, nearest box first, the leaves whose box is no
    farther than the best distance so far: 4 of them, then 16 more, 64 more and so
    on while any is left, so the rounds grow with the logarithm of the leaves.
    Rows that no other leaf may hold a nearer one for take part in the first visit
    only. Equal training rows are one, and are so already if they are ``unique``.
    The copies of new rows in each round are appended to ``visits``. With
    ``others`` training rows at a row's own place do not count.
    """
    rows = train.select("vec") if unique else cut_lineage(train.select("vec").distinct())
    tree = box_tree(rows, n_train, gaps_first=True)
    placed = cut_lineage(_placed(rows, tree))
    width = len(train.select("vec").first()["vec"]) if n_train else 0
    ends = lambda pick: F.array(*[pick(F.col("vec")[i]) for i in range(width)])
    boxes = placed.groupBy("leaf").agg(ends(F.min).alias("lo"), ends(F.max).alias("hi")).collect()
    tree.set_boxes({r["leaf"]: np.array(r["lo"]) for r in boxes}, {r["leaf"]: np.array(r["hi"]) for r in boxes}, width)
    asked = cut_lineage(_placed(new.select("id", "vec"), tree))
    if visits is not None and (count := asked.count()):
        visits.append(count)
    home = cut_lineage(_visit(asked, placed, others, tree))
    found = home.select("id", "d")
    # Left are the rows that other leaves are to be visited for.
    state = cut_lineage(home.where("vec is not null").groupBy("id").agg(F.first("vec").alias("vec"), F.min("d").alias("best")).select("id", "vec", "best"))
    first, step = 0, 4
    while tree.leaves > 1:
        asked = cut_lineage(_next_visits(state, tree, first, first + step))
        count = asked.count()
        if not count:
            break
        if visits is not None:
            visits.append(count)
        seen = cut_lineage(_visit(asked, placed, others).groupBy("id").agg(F.min("d").alias("d")))
        found = found.unionByName(seen)
        nearer = seen.select(F.col("id").alias("fid"), "d")
        state = cut_lineage(
            state.join(nearer, F.col("id") == F.col("fid"), "left").select("id", "vec", F.least("best", F.coalesce("d", F.lit(math.inf))).alias("best"))
        )
        first, step = first + step, step * 4
    return found.groupBy("id").agg(F.min("d").alias("d")).select("id", F.when(F.col("d") < F.lit(math.inf), F.col("d")).alias("min_dist"))


def _at_places(rows: DataFrame, train: DataFrame, n_train: int) -> DataFrame:
    """Rows (id, vec) with ``min_dist``, their distance to the nearest training row; equal rows are looked up once."""
    places = cut_lineage(rows.select("vec").distinct().withColumn("id", F.monotonically_increasing_id()))
    found = nearest_train_distance(places, train, n_train)
    known = cut_lineage(places.join(found, "id").drop("id"))
    return rows.join(known.hint("merge"), "vec").select("id", "vec", "min_dist")


def _own_distances(train: DataFrame, n_train: int) -> DataFrame:
    """``(id, min_dist)`` of each training row to its nearest other one: 0 if another row is equal."""
    counted = train.groupBy("vec").agg((F.count(F.lit(1)) > 1).alias("twin"))
    places = cut_lineage(counted.withColumn("id", F.monotonically_increasing_id()))
    found = nearest_train_distance(places, places, n_train, others=True, unique=True)
    least = F.when(F.col("twin"), F.lit(0.0)).otherwise(F.col("min_dist"))
    known = cut_lineage(places.join(found, "id").select("vec", least.alias("min_dist")))
    return train.join(known.hint("merge"), "vec").groupBy("id").agg(F.min("min_dist").alias("min_dist"))


def area_of_applicability(
    new: DataFrame,
    train: DataFrame,
    weights: Mapping[str, float],
    id: str = "point_id",
    threshold: float = 0.95,
    cluster: str | None = None,
) -> DataFrame:
    """``(id, di, aoa)``: dissimilarity to the training rows, and 1 inside the area of applicability.

    Variables are scaled by the training rows' mean and standard deviation and
    multiplied by their weight; missing and undefined values count as average.
    ``di`` is the distance to the nearest training row over the mean distance
    between training rows. The area ends at the ``threshold`` quantile of the
    training rows' own dissimilarity, taken outside their ``cluster`` if given.
    Ids must be unique.
    """
    if not weights:
        raise ValueError("no variables to compare")
    absent = [c for c in weights if c not in new.columns or c not in train.columns]
    if absent:
        raise ValueError(f"variables missing from the data: {absent}")
    variables = list(weights)
    params = scale_parameters(train, variables)
    vec = F.array(*[scaled(c, *params[c], weight=weights[c]) for c in variables])
    extra = [F.xxhash64(F.col(cluster)).alias("cluster")] if cluster else []
    train_v = cut_lineage(train.select(F.col(id).alias("id"), vec.alias("vec"), *extra))
    new_v = cut_lineage(new.select(F.col(id).alias("id"), vec.alias("vec")))
    n_train = train_v.count()
    if cluster:
        own = cut_lineage(train_distances(train_v, n_train))
        mean_dist = own.agg(F.avg("mean_dist")).first()[0]
    else:
        own = cut_lineage(_own_distances(train_v, n_train))
        mean_dist = mean_train_distance(train_v)
    limit = exact_quantiles(own, [], "min_dist", [threshold], ["q"]).first()
    limit = None if limit is None or limit["q"] is None or not mean_dist else limit["q"] / mean_dist
    if limit is None:
        raise ValueError("training rows are too few or all alike: no distance scale")
    nearest = _at_places(new_v, train_v, n_train)
    di = F.col("min_dist") / F.lit(mean_dist)
    return nearest.select(
        F.col("id").alias(id), di.alias("di"), F.when(di > F.lit(limit), 0).otherwise(1).alias("aoa")
    )
