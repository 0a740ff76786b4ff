"""Places, running sums and neighbours in long ordered groups, without one task per group.

A group that holds a third of all rows is cut into ranges of its order; ranges are numbered apart and
moved by what stands before them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.session import cut

#: Rows of a group that one window holds, and rows shown beside them.
SLICE, MARGIN = 8192, 3


def places(df: DataFrame, key: str, order: list[str | Column], place: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """Adds `place` (INT, from 0 in each group, by `order`, rising) and for each of `sums` the total of the rows before (LONG).

    The order has to be total; ties are numbered in any way. Rows without key form a group too.
    """
    sums = sums or {}
    keys = {f"_o{i}": (F.col(o) if isinstance(o, str) else o) for i, o in enumerate(order)}
    base = df.withColumns({**keys, **{f"_s{i}": c for i, c in enumerate(sums.values())}})
    ranged = cut(base.repartitionByRange(key, *keys).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy(key, "_range").orderBy(*keys)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    own = {"_n": F.row_number().over(inside) - 1} | {f"_b{i}": F.coalesce(F.sum(f"_s{i}").over(before), F.lit(0)) for i in range(len(sums))}
    totals = ranged.groupBy(key, "_range").agg(F.count("*").alias("_n"), *[F.coalesce(F.sum(f"_s{i}"), F.lit(0)).alias(f"_b{i}") for i in range(len(sums))])
    ahead = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    moved = totals.select(F.col(key).alias("_k"), F.col("_range").alias("_r"), *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_0") for c in own])
    joined = ranged.withColumns(own).join(moved, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_range") == F.col("_r")))
    out = {place: (F.col("_n") + F.col("_n_0")).cast("int")} | {name: (F.col(f"_b{i}") + F.col(f"_b{i}_0")).cast("long") for i, name in enumerate(sums)}
    return joined.withColumns(out).select(*df.columns, *out)


def sliced(df: DataFrame, key: str, place: str) -> DataFrame:
    """Rows in slices of their group (`_slice`), each with the rows beside it (`_aside`), so that windows over (key, _slice) see neighbours."""
    own, at = F.floor(F.col(place) / SLICE), F.col(place) % SLICE
    near = F.array_compact(F.array(own, F.when(at < MARGIN, own - 1), F.when(at >= SLICE - MARGIN, own + 1)))
    return df.withColumn("_slice", F.explode(near)).withColumn("_aside", F.col("_slice") != own)


def last_before(df: DataFrame, key: str, place: str, mark: Column, name: str) -> DataFrame:
    """Adds `name`: the place of the last row up to this one where `mark` is true (null without one). Rows come from `sliced`, without those aside."""
    here = Window.partitionBy(key, "_slice").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    marked = df.withColumn("_mark", F.when(mark, F.col(place)))
    ends = marked.groupBy(key, "_slice").agg(F.max("_mark").alias("_end"))
    ahead = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col(key).alias("_k"), F.col("_slice").alias("_r"), F.max("_end").over(ahead).alias("_carried"))
    joined = marked.withColumn("_own", F.max("_mark").over(here)).join(carried, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_slice") == F.col("_r")))
    return joined.withColumn(name, F.coalesce("_own", "_carried")).drop("_mark", "_own", "_k", "_r", "_carried")
