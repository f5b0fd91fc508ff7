"""Running totals along one global order, without a single-task sort.

Rows are range-partitioned by the order, each partition sums on its own, and the partitions'
totals (one row each, so bounded by the number of partitions) become offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stash


def gathered(df: DataFrame, keys: list[str], order: list[str], tasks: int | None = None) -> DataFrame:
    """The rows of each key in one task, in order, for a stream over them.

    They are dealt by a hash of the keys: an exchange by columns that the rows lie by already, as after a
    join, is left out by Spark, which may then turn that join and read its rows in other splits.
    """
    dealt = df.withColumn("_g", F.xxhash64(*keys))
    placed = dealt.repartition("_g") if tasks is None else dealt.repartition(tasks, "_g")
    return placed.sortWithinPartitions(*keys, *order).drop("_g")


def running_totals(df: DataFrame, order: list[str], totals: dict[str, Column]) -> DataFrame:
    """``df`` with one bigint column per entry of ``totals``: its sum over all rows before this one.

    ``order`` names columns that order the rows totally. ``F.lit(1)`` as a total gives 0-based
    positions. An empty frame stays empty.
    """
    summed = {name: f"_v{i}" for i, name in enumerate(totals)}
    marked = df.withColumns({summed[name]: value.cast("bigint") for name, value in totals.items()})
    # The partition number depends on sampled bounds, so it is written down once.
    ranged = stash(marked.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    whole = ranged.groupBy("_p").agg(*[F.sum(v).alias(f"{v}_all") for v in summed.values()])
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = whole.select("_p", *[
        F.coalesce(F.sum(f"{v}_all").over(before), F.lit(0)).alias(f"{v}_off") for v in summed.values()])
    so_far = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranged.join(F.broadcast(offsets), "_p").select(*df.columns, *[
        (F.col(f"{v}_off") + F.sum(v).over(so_far) - F.col(v)).alias(name) for name, v in summed.items()])


def totals_within(df: DataFrame, keys: list[str], order: list[str], totals: dict[str, Column],
                  before: dict[str, str] | None = None) -> DataFrame:
    """Like :func:`running_totals`, starting anew for every value of ``keys``.

    Ranges are cut inside a key too, so a key of any size spreads. Only keys that reach over a
    border need offsets: at most two of them per partition, which bounds the broadcast.
    ``before`` names new columns after columns whose value in the row before is wanted (null for the first).
    The result reads a table of its own, which ``session.drop_stash`` frees.
    """
    before = before or {}
    summed = {name: f"_v{i}" for i, name in enumerate(totals)}
    marked = df.withColumns({summed[name]: value.cast("bigint") for name, value in totals.items()})
    ranged = stash(marked.repartitionByRange(*keys, *order).withColumn("_p", F.spark_partition_id()))
    whole = ranged.groupBy("_p", *keys).agg(*[F.sum(v).alias(f"{v}_all") for v in summed.values()], *[
        F.max_by(c, F.struct(*order)).alias(f"_l_{name}") for name, c in before.items()])
    same = Window.partitionBy(*keys)
    earlier = same.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = whole.withColumn("_parts", F.count(F.lit(1)).over(same)).withColumns(
        {f"{v}_off": F.sum(f"{v}_all").over(earlier) for v in summed.values()}
        | {f"_l_{name}": F.lag(f"_l_{name}").over(same.orderBy("_p")) for name in before}).filter("_parts > 1").select(
        F.col("_p").alias("_met"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[f"{v}_off" for v in summed.values()],
        *[f"_l_{name}" for name in before])
    met = F.col("_p") == F.col("_met")
    for i, k in enumerate(keys):
        met &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    own = Window.partitionBy("_p", *keys).orderBy(*order)
    so_far = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.join(F.broadcast(offsets), met, "left").select(*df.columns, *[
        (F.coalesce(F.col(f"{v}_off"), F.lit(0)) + F.sum(v).over(so_far) - F.col(v)).alias(name) for name, v in summed.items()], *[
        F.when(F.row_number().over(own) > 1, F.lag(c).over(own)).otherwise(F.col(f"_l_{name}")).alias(name) for name, c in before.items()])
    out._stash_path = ranged._stash_path
    return out
