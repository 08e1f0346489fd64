"""Exact k nearest neighbours of the other classes on the sphere.

Points are put on the unit sphere and their locations in a tree of cubes that
is refined only where points are dense. Both sides descend together: a leaf of
query locations keeps the partner cubes that could still hold one of its k
nearest, judged by the boxes' least and greatest distance. Each step is an
equi-join on the cube and a window over the few cubes one leaf keeps, so no
join ever pairs all points, and dense places only make the tree deeper there.

Points at the same place are one location. All of them have the same
neighbours, and as partners only the k with the smallest ids can come first,
since every one of them ties at every distance.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import EARTH_RADIUS_M, unit_sphere
from ..functions.measures import difference
from ..functions.strict import strict_median
from ..session import cut_lineage
from .joins import beside_each
from .ordering import top_k

DEPTH = 24
STEP = 1
LEAF_LOCATIONS = 64
CUBE = ["lev", "cx", "cy", "cz"]
BOX = ["x0", "x1", "y0", "y1", "z0", "z1"]
# Neighbours are ordered by distance in whole millimetres, then by id; boxes
# are kept with more slack than that (chord of the unit sphere).
DISTANCE_DIGITS = 3
SLACK = 4e-3 / EARTH_RADIUS_M
# Slack of a cosine that covers two millimetres at any distance.
COSINE_SLACK = 2e-9


def _locations(points: DataFrame, k: int, id: str, lon: str, lat: str, cls: str) -> DataFrame:
    rows = points.select(
        F.col(cls).alias("cls"), F.col(lon).alias("lon"), F.col(lat).alias("lat"), F.col(id).alias("id")
    ).dropna()
    first = top_k(rows, ["cls", "lon", "lat"], ["id"], k)
    locs = first.groupBy("cls", "lon", "lat").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    x, y, z = unit_sphere("lon", "lat")

    def index(c: Column) -> Column:
        return F.greatest(
            F.lit(0), F.least(F.lit(2**DEPTH - 1), F.floor((c + 1) / 2 * 2**DEPTH).cast("int"))
        )

    return (
        locs.withColumns({"x": x, "y": y, "z": z})
        .withColumns({"ix": index(F.col("x")), "iy": index(F.col("y")), "iz": index(F.col("z"))})
    )


def _at_levels(locs: DataFrame) -> DataFrame:
    levelled = locs.withColumn("lev", F.explode(F.sequence(F.lit(0), F.lit(DEPTH), F.lit(STEP))))
    return levelled.withColumns(
        {c: F.expr(f"shiftright({i}, {DEPTH} - lev)") for c, i in (("cx", "ix"), ("cy", "iy"), ("cz", "iz"))}
    )


def _tree(levelled: DataFrame, leaf_locations: int) -> DataFrame:
    """Cubes of the refined tree with their location count, id count and tight box."""
    cubes = levelled.groupBy("cls", *CUBE).agg(
        F.count(F.lit(1)).alias("n_loc"),
        F.sum(F.size("ids")).alias("n_ids"),
        F.min("x").alias("x0"), F.max("x").alias("x1"),
        F.min("y").alias("y0"), F.max("y").alias("y1"),
        F.min("z").alias("z0"), F.max("z").alias("z1"),
    )
    up = {p: F.shiftright(c, STEP) for p, c in (("px", "cx"), ("py", "cy"), ("pz", "cz"))}
    cubes = cubes.withColumns(up)
    refined = cubes.where(F.col("n_loc") > leaf_locations).select(
        "cls", (F.col("lev") + STEP).alias("lev"),
        F.col("cx").alias("px"), F.col("cy").alias("py"), F.col("cz").alias("pz"),
    )
    below = cubes.where("lev > 0").join(refined, ["cls", "lev", "px", "py", "pz"], "left_semi")
    kept = cubes.where("lev = 0").unionByName(below)
    return kept.withColumn("leaf", (F.col("n_loc") <= leaf_locations) | (F.col("lev") == DEPTH))


def _prefixed(df: DataFrame, p: str, cols: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(p + c) for c in cols])


def _box_distances() -> tuple[Column, Column]:
    near = far = F.lit(0.0)
    for a in "xyz":
        q0, q1, r0, r1 = (F.col(f"{s}{a}{e}") for s in "qr" for e in "01")
        gap = F.greatest(F.lit(0.0), q0 - r1, r0 - q1)
        reach = F.greatest(q1 - r0, r1 - q0)
        near, far = near + gap * gap, far + reach * reach
    return F.sqrt(near), F.sqrt(far)


def _prune(pairs: DataFrame, k: int) -> DataFrame:
    """Drop partner cubes farther than a distance within which k partners are certain."""
    near, far = _box_distances()
    of_leaf = Window.partitionBy("qcls", *["q" + c for c in CUBE], "rcls")
    by_reach = of_leaf.orderBy("far").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Few bytes per leaf but much work: a stated number of partitions is not merged for its size.
    partitions = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        pairs.repartition(partitions, "qcls", *["q" + c for c in CUBE])
        .withColumns({"near": near, "far": far})
        .withColumn("sure", F.sum("rn_ids").over(by_reach))
        .withColumn("bound", F.min(F.when(F.col("sure") >= k, F.col("far"))).over(of_leaf))
        .where(F.col("bound").isNull() | (F.col("near") <= F.col("bound") + SLACK))
        .select(*pairs.columns)
    )


def nearest_other_class(
    points: DataFrame,
    k: int,
    id: str = "point_id",
    lon: str = "lon",
    lat: str = "lat",
    cls: str = "LC0_Desc",
    leaf_locations: int = LEAF_LOCATIONS,
) -> DataFrame:
    """The k nearest partners of every location in each other class.

    Returns ``(cls, lon, lat, partner_cls, partner_id, dist_m, rank)``; one
    location stands for all points of its class there.
    """
    locs = cut_lineage(_locations(points, k, id, lon, lat, cls))
    levelled = _at_levels(locs)
    tree = cut_lineage(_tree(levelled, leaf_locations))
    leaves = tree.where("leaf")
    placed = cut_lineage(
        levelled.join(leaves.select("cls", *CUBE), ["cls", *CUBE], "left_semi").select(
            "cls", *CUBE, "lon", "lat", "ids"
        )
    )

    deepest = tree.agg(F.max(F.when(~F.col("leaf"), F.col("lev")))).first()[0]
    node_cols = ["cls", *CUBE, *BOX, "n_ids", "leaf"]
    queries = _prefixed(leaves, "q", ["cls", *CUBE, *BOX])
    # The roots are a table of one row per class (and top cube); every leaf starts at those of the other classes.
    roots = _prefixed(tree.where("lev = 0"), "r", node_cols)
    pairs = beside_each(queries, roots, ["rcls", *["r" + c for c in CUBE]]).where("rcls <> qcls")
    children = tree.select(
        F.col("cls").alias("rcls"),
        *[F.col(p).alias("r" + c) for p, c in (("px", "cx"), ("py", "cy"), ("pz", "cz"))],
        (F.col("lev") - STEP).alias("rlev"),
        F.struct(*CUBE, *BOX, "n_ids", "leaf").alias("child"),
    ).where("rlev >= 0")
    keep = ["qcls", *["q" + c for c in CUBE + BOX], "rcls"]
    at = ["rcls", "rlev", "rcx", "rcy", "rcz"]
    for step, level in enumerate(range(0, -1 if deepest is None else deepest + 1, STEP)):
        # Cubes with children give way to them, leaves stay as they are.
        opened = pairs.join(children.where(F.col("rlev") == level), at, "left").select(
            *keep, *[F.coalesce(F.col(f"child.{c}"), F.col("r" + c)).alias("r" + c) for c in node_cols[1:]]
        )
        pairs = _prune(opened, k)
        if step % 4 == 3:
            pairs = cut_lineage(pairs)

    leaf = ["cls", *CUBE]
    queries_at = placed.select(*[F.col(c).alias("q" + c) for c in leaf], "lon", "lat")
    # A leaf's partners are one list, so what is shuffled and sorted is a row for each pair of leaves.
    refs_at = (
        placed.select(*[F.col(c).alias("r" + c) for c in leaf], "lon", "lat", F.explode("ids").alias("id"))
        .groupBy(*["r" + c for c in leaf]).agg(F.collect_list(F.struct("lon", "lat", "id")).alias("held"))
    )
    # One copy of the partners per query leaf, not per query point.
    partners = pairs.select(*["q" + c for c in leaf], *["r" + c for c in leaf]).join(
        refs_at, ["r" + c for c in leaf]
    ).select(*[F.col("q" + c).alias("p" + c) for c in leaf], "rcls", "held")
    types = {f: points.schema[c].dataType.simpleString() for f, c in (("cls", cls), ("id", id))}
    return (
        queries_at.groupBy(*["q" + c for c in leaf])
        .cogroup(partners.groupBy(*["p" + c for c in leaf]))
        .applyInArrow(
            _nearest_in_leaf(k),
            f"cls {types['cls']}, lon double, lat double, partner_cls {types['cls']}, "
            f"partner_id {types['id']}, dist_m double, rank int",
        )
    )


def _nearest_in_leaf(k: int):
    """The k nearest per class among the partners that came with one leaf's locations.

    A product of unit vectors finds all partners up to the k-th nearest plus
    more than a millimetre; only those get the great-circle formula.
    """

    def vectors(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
        return np.column_stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        lon, lat = (np.radians(left.column(c).to_numpy()) for c in ("lon", "lat"))
        lists = right.column("held").combine_chunks()
        held = lists.flatten()
        ids = held.field("id")
        # Position of each partner in id order: the tie-break, whatever type ids have.
        place = np.empty(len(ids), dtype=np.int64)
        place[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        rlon, rlat = (np.radians(held.field(c).to_numpy()) for c in ("lon", "lat"))
        rcls = right.column("rcls").combine_chunks().take(pc.list_parent_indices(lists))
        codes = pc.dictionary_encode(rcls)
        of_class = codes.indices.to_numpy(zero_copy_only=False)
        own, other = vectors(lon, lat), vectors(rlon, rlat)
        found = []
        for c in range(len(codes.dictionary)):
            members = np.flatnonzero(of_class == c)
            cosine = own @ other[members].T
            if len(members) > k:
                reach = np.partition(cosine, len(members) - k, axis=1)[:, len(members) - k]
                q, m = np.nonzero(cosine >= reach[:, None] - COSINE_SLACK)
            else:
                q, m = np.nonzero(np.ones_like(cosine, dtype=bool))
            p = members[m]
            a = (
                np.sin((rlat[p] - lat[q]) / 2) ** 2
                + np.cos(lat[q]) * np.cos(rlat[p]) * np.sin((rlon[p] - lon[q]) / 2) ** 2
            )
            d = np.round(2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(np.minimum(1.0, a))), DISTANCE_DIGITS)
            order = np.lexsort((place[p], d, q))
            q, p, d = q[order], p[order], d[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q) + 1
            kept = rank <= k
            found.append((q[kept], p[kept], d[kept], rank[kept].astype(np.int32)))
        if not found:
            found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int32))]
        q, p, d, rank = (pa.array(np.concatenate(column)) for column in zip(*found))
        return pa.table(
            {
                "cls": left.column("qcls").take(q),
                "lon": left.column("lon").take(q),
                "lat": left.column("lat").take(q),
                "partner_cls": rcls.take(p),
                "partner_id": ids.take(p),
                "dist_m": d,
                "rank": rank,
            }
        )

    return run


def neighbour_pairs(
    points: DataFrame, k: int, id: str = "point_id", lon: str = "lon", lat: str = "lat", cls: str = "LC0_Desc"
) -> DataFrame:
    """``(id, cls, partner_id, partner_cls, dist_m, rank)`` per point."""
    found = nearest_other_class(points, k, id, lon, lat, cls)
    own = points.select(id, F.col(cls).alias("cls"), F.col(lon).alias("lon"), F.col(lat).alias("lat"))
    return own.join(found, ["cls", "lon", "lat"]).select(
        id, F.col("cls").alias(cls), "partner_id", F.col("partner_cls"), "dist_m", "rank"
    )


def neighbour_features(
    points: DataFrame,
    attributes: Sequence[str],
    k: int = 5,
    id: str = "point_id",
    lon: str = "lon",
    lat: str = "lat",
    cls: str = "LC0_Desc",
) -> DataFrame:
    """Median attribute of a point's nearest other-class partners, and own minus partner.

    Adds ``partner_<a>``, ``partner_<a>diff`` and ``median_dist`` to the points.
    A median is missing when any partner misses the attribute. Medians are
    taken once per location and handed to all points there.
    """
    found = nearest_other_class(points, k, id, lon, lat, cls)
    theirs = points.select(
        F.col(id).alias("partner_id"), *[F.col(a).alias(f"partner_{a}") for a in attributes]
    )
    medians = (
        found.join(theirs, "partner_id")
        .groupBy("cls", "lon", "lat")
        .agg(
            *[strict_median(f"partner_{a}").alias(f"partner_{a}") for a in attributes],
            strict_median("dist_m").alias("median_dist"),
        )
        .withColumnsRenamed({"cls": cls, "lon": lon, "lat": lat})
    )
    out = points.join(medians, [cls, lon, lat], "left")
    return out.withColumns({f"partner_{a}diff": difference(a, f"partner_{a}") for a in attributes})
