"""Running totals, row numbers, top-k and paging without a single-task sort."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage


def _differs(column: pa.Array) -> np.ndarray:
    """For each row but the first: is its value another one than the row's before? Missing values are alike, and so are NaNs."""
    here, before = column.slice(1), column.slice(0, len(column) - 1)
    unlike = np.asarray(pc.fill_null(pc.not_equal(here, before), False).to_numpy(zero_copy_only=False), dtype=bool)
    if pa.types.is_floating(column.type):
        unlike &= ~np.asarray(pc.fill_null(pc.and_(pc.is_nan(here), pc.is_nan(before)), False).to_numpy(zero_copy_only=False), dtype=bool)
    missing = pc.is_null(column).to_numpy(zero_copy_only=False)
    return unlike | (missing[1:] != missing[:-1])


def _within_parts(groups: Sequence[str], schema: T.StructType):
    """Running sums of ``__rt_value`` within a task's rows, which come sorted by group; rows of its first group are marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, upto, opening, row = None, 0, True, 0
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            at = {c: batch.schema.get_field_index(c) for c in (*groups, "__rt_value")}
            values = batch.column(at["__rt_value"]).to_numpy(zero_copy_only=False)
            new = np.zeros(n, dtype=bool)
            for c in groups:
                new[1:] |= _differs(batch.column(at[c]))
            ends = [repr(tuple(batch.column(at[c])[k].as_py() for c in groups)) for k in (0, n - 1)]
            new[0] = ends[0] != group
            total = np.cumsum(values)
            first = np.flatnonzero(new)
            before = np.zeros(n, dtype=total.dtype)
            # What was summed before a row's group began; rows that go on with the last batch's group add its sum.
            begin = np.where(new, np.arange(n), 0)
            np.maximum.accumulate(begin, out=begin)
            old = np.arange(n) < (first[0] if len(first) else n)
            before[~old] = (total - values)[begin[~old]]
            sums = total - before
            if old.any():
                sums[old] += upto
            # The task's first group ends where another begins.
            new[0] &= row > 0
            marked = opening & (np.cumsum(new) == 0)
            opening = bool(marked[-1])
            group, upto = ends[1], sums[-1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sums), pa.array(marked), pa.array(np.arange(row, row + n))], names=schema.names
            )
            row += n

    return run


def running_total(
    df: DataFrame, groups: Sequence[str], order: Sequence[Column | str], value: Column, out: str
) -> DataFrame:
    """Cumulative sum of ``value`` (whole numbers or doubles) within each group, for groups of any size.

    One shuffle: rows are range-partitioned on (groups, order), so one group may
    span many partitions, and each task sums its own piece. Only a partition's
    first group can have begun before it: what it had by then follows from the
    ends of the partitions before, which alone come to the driver, and is added
    to the written rows. ``order`` must be total. Missing keys are a group of
    their own; missing values count as 0.
    """
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    keys = [*[F.col(g) for g in groups], *order_cols]
    whole = isinstance(df.select(value.alias("v")).schema["v"].dataType, T.IntegralType)
    number = T.LongType() if whole else T.DoubleType()
    valued = df.withColumn("__rt_value", F.coalesce(value.cast(number), F.lit(0).cast(number)))
    ranged = valued.repartitionByRange(*keys) if keys else valued.repartition(1)
    sorted_rows = ranged.sortWithinPartitions(*keys).withColumn("__rt_part", F.spark_partition_id())
    schema = T.StructType([
        *sorted_rows.schema, T.StructField("__rt_upto", number), T.StructField("__rt_first", T.BooleanType()), T.StructField("__rt_row", T.LongType()),
    ])
    summed = cut_lineage(sorted_rows.mapInArrow(_within_parts(groups, schema), schema))
    end = F.struct("__rt_row", *[F.col(g).alias(f"g{i}") for i, g in enumerate(groups)], F.col("__rt_upto").alias("upto"))
    ends = summed.groupBy("__rt_part").agg(F.max_by(end, "__rt_row").alias("last"), F.max_by(F.when(F.col("__rt_first"), end), F.when(F.col("__rt_first"), F.col("__rt_row"))).alias("first"))
    zero = 0 if whole else 0.0
    offsets, group, upto = [], None, zero
    for part in sorted(ends.collect(), key=lambda r: r["__rt_part"]):  # a row for each partition
        own = [repr(tuple(part[e][f"g{i}"] for i in range(len(groups)))) for e in ("first", "last")]
        carried = upto if own[0] == group else zero
        if carried:
            offsets.append((part["__rt_part"], carried))
        alone = part["first"]["__rt_row"] == part["last"]["__rt_row"]
        group, upto = own[1], part["last"]["upto"] + (carried if alone else zero)
    helpers = ["__rt_value", "__rt_part", "__rt_upto", "__rt_first", "__rt_row"]
    if not offsets:
        return summed.withColumn(out, F.col("__rt_upto")).drop(*[h for h in helpers if h != out])
    given = df.sparkSession.createDataFrame(offsets, T.StructType([T.StructField("__rt_p", T.IntegerType()), T.StructField("__rt_offset", number)]))
    # One row for each partition at most, so it is small whatever the table's size.
    met = summed.join(F.broadcast(given), F.col("__rt_first") & (F.col("__rt_part") == F.col("__rt_p")), "left")
    return met.withColumn(out, F.col("__rt_upto") + F.coalesce("__rt_offset", F.lit(zero).cast(number))).drop(*[h for h in [*helpers, "__rt_p", "__rt_offset"] if h != out])


def number_rows(df: DataFrame, order: Sequence[Column | str], out: str = "row") -> DataFrame:
    """1-based row number over the whole table in a total order."""
    return running_total(df, [], order, F.lit(1).cast("long"), out)


def paginate(df: DataFrame, order: Sequence[Column | str], size: int) -> DataFrame:
    """Row number, page, and position within the page."""
    return (
        number_rows(df, order)
        .withColumn("page", F.ceil(F.col("row") / size).cast("long"))
        .withColumn("pos", F.col("row") - (F.col("page") - 1) * size)
    )


def grid_cells(numbered: DataFrame, pos: str, columns: int, out: str = "cell") -> DataFrame:
    """Panel label (row letter, column number) of a position in a page, filled row by row."""
    zero = F.col(pos) - 1
    letter = F.char(F.lit(65) + F.floor(zero / columns))
    return numbered.withColumn(out, F.concat(letter, (zero % columns + 1).cast("string")))


def top_k(
    df: DataFrame, groups: Sequence[str], order: Sequence[Column | str], k: int, rank: str | None = None
) -> DataFrame:
    """First k rows per group in a total order; Spark trims to k per task before shuffling."""
    w = Window.partitionBy(*groups).orderBy(*order)
    name = rank or "__rank"
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def top_n_with_ties(df: DataFrame, value: str, n: int) -> DataFrame:
    """Rows whose value is at least the n-th largest; rows tied with it are all kept."""
    largest = df.where(F.col(value).isNotNull()).select(value).orderBy(F.desc(value)).limit(n)
    # The n-th largest value alone comes to the driver, as a filter the scan can use.
    floor = largest.agg(F.min(value)).first()[0]
    return df.where(F.lit(False)) if floor is None else df.where(F.col(value) >= F.lit(floor))


def sort_missing_last(df: DataFrame, *order: str) -> DataFrame:
    """Sort with missing values last in either direction; '-name' sorts descending."""
    return df.orderBy(
        *[F.desc_nulls_last(o[1:]) if o.startswith("-") else F.asc_nulls_last(o) for o in order]
    )
