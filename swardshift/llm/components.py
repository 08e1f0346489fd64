"""Connected components of a link table, by alternating stars.

Each round hangs every neighbour on the smallest one around it, first the
larger neighbours (large star), then the smaller ones (small star). The number
of rounds grows with the logarithm of the links' longest path, not with the
size of a component. A node's neighbours are only aggregated and joined, never
gathered, so a hub with any number of links is split like any other key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..stages import drop_stages, write_stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Edges (hi, lo): each node's larger neighbours are linked to its smallest neighbour or itself."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges (hi, lo): each node and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.union(least.select("hi", F.col("m").alias("lo"))).distinct()


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with a link to another; the component is its smallest node.

    Links may repeat, in either direction; links with a null end or from a node
    to itself say nothing. No links give no rows.
    """
    edges = write_stage(
        links.where(f"{a} is not null and {b} is not null and {a} <> {b}")
        .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(),
        "edges",
    )
    state = _state(edges)
    while state[0]:
        before, edges = edges, write_stage(_small_star(_large_star(edges)), "edges")
        drop_stages(before)
        new = _state(edges)
        if new == state:
            break
        state = new
    roots = edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)
