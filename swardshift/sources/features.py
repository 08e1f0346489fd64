"""GeoJSON points and polygons -> plain columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import beside_each


def _features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features of GeoJSON files: one per line, or one collection per file, on one line or many.

    One feature per line is read in splits; a collection is one JSON value, so a
    file of it is one task, and its features are spread out afterwards. Text
    that is not JSON raises. Coordinates stay JSON text, as their depth depends
    on the geometry's type.
    """
    geometry = "struct<type:string,coordinates:string>"
    feature = f"struct<properties:struct<{properties}>,geometry:{geometry}>"
    schema = f"features array<{feature}>, properties struct<{properties}>, geometry {geometry}"
    # A first line that is a whole JSON value on its own tells lines of features from a spread-out collection.
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    whole = lines.limit(1).select(F.get_json_object("value", "$.type").isNotNull()).collect()
    by_line = bool(whole) and whole[0][0]
    raw = spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", not by_line).json(path)
    in_collection = raw.where("features is not null").select(F.explode("features").alias("f")).hint("rebalance")
    single = raw.where("features is null and geometry is not null").select(F.struct("properties", "geometry").alias("f"))
    return in_collection.unionByName(single)


def read_points(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Point features: the named properties plus ``lon`` and ``lat``.

    ``properties`` is a field list such as ``"point_id:bigint,LC:string"``.
    """
    f = _features(spark, path, properties).select("f.*", _coordinates("array<double>").alias("c"))
    return f.select("properties.*", F.col("c")[0].alias("lon"), F.col("c")[1].alias("lat"))


def _coordinates(kind: str):
    """The coordinates as arrays of the given depth; text of another depth raises."""
    return F.from_json("f.geometry.coordinates", kind, {"mode": "FAILFAST"})


def read_polygon_rings(spark: SparkSession, path: str, id_field: str = "region_id") -> DataFrame:
    """Polygon and multipolygon features -> vertices ``(id, ring, seq, x, y)``."""
    schema = f"{id_field}:string"
    features = _features(spark, path, schema)
    multi = F.flatten(_coordinates("array<array<array<array<double>>>>"))
    simple = _coordinates("array<array<array<double>>>")
    kind = F.col("f.geometry.type")
    rings = features.where(kind.isin("Polygon", "MultiPolygon")).select(
        F.col(f"f.properties.{id_field}").alias(id_field),
        F.posexplode(F.when(kind == "MultiPolygon", multi).otherwise(simple)).alias("ring", "pts"),
    )
    return rings.select(id_field, "ring", F.posexplode("pts").alias("seq", "p")).select(
        id_field, "ring", "seq", F.col("p")[0].alias("x"), F.col("p")[1].alias("y")
    )


def read_yearly_polygons(
    spark: SparkSession, paths: Mapping[int, str], id_field: str = "region_id", year: str = "year"
) -> DataFrame:
    """Ring vertices of several vintages in one table, each marked with its year."""
    parts = [
        read_polygon_rings(spark, p, id_field).withColumn(year, F.lit(y)) for y, p in sorted(paths.items())
    ]
    return reduce(DataFrame.unionByName, parts)


def layer_catalogue(
    layers: DataFrame, name: str, keyword: str, prefix: str, keep: Sequence[str] = ()
) -> DataFrame:
    """Keep raster layers whose name holds ``keyword`` and turn the name into a location.

    Only the first ';' becomes a '/'.
    """
    located = F.concat(F.lit(prefix), F.regexp_replace(F.col(name), "^([^;]*);", "$1/"))
    return layers.where(F.col(name).contains(keyword)).select(*keep, located.alias("location"))


def raster_sample(
    pixels: DataFrame,
    layers: DataFrame,
    points: DataFrame,
    ids: Sequence[str],
    x: str = "x",
    y: str = "y",
) -> DataFrame:
    """Value of the pixel each point falls in, per layer, NULL outside or without data.

    ``layers`` holds each layer's geotransform ``(layer, x0, y0, dx, dy)`` with
    the upper-left corner and positive pixel sizes. It stays a table: points
    meet each distinct grid once, where pixel indices are computed, and points
    that fall in one pixel look it up once; points fan out to the layers of a
    grid only in the last join.
    """
    grid = ["x0", "y0", "dx", "dy"]
    listed = layers.select("layer", *[F.col(c).cast("double").alias(c) for c in grid]).distinct()
    grids = listed.groupBy(*grid).agg(F.sort_array(F.collect_set("layer")).alias("layers"))
    placed = (
        beside_each(points.select(*ids, x, y), grids, grid)
        .withColumn("col", F.floor((F.col(x) - F.col("x0")) / F.col("dx")).cast("int"))
        .withColumn("row", F.floor((F.col("y0") - F.col(y)) / F.col("dy")).cast("int"))
    )
    cells = placed.select("row", "col", F.explode("layers").alias("layer")).distinct()
    hits = pixels.select("layer", "row", "col", "value").join(cells, ["layer", "row", "col"], "left_semi")
    wanted = placed.select(*ids, "row", "col", F.explode("layers").alias("layer"))
    return wanted.join(hits, ["layer", "row", "col"], "left").select(*ids, "layer", "value")
