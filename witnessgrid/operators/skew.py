"""Joins and rankings that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ordered import totals_within

# A key with more rows than this is "hot". At most total_rows / HOT_ROWS keys can be hot,
# which is what bounds every broadcast of hot keys below.
HOT_ROWS = 1_000_000


def lookup(big: DataFrame, table: DataFrame, keys: list[str], size: str,
           hot_rows: int = HOT_ROWS, how: str = "left",
           spread_by: list[str] | None = None) -> DataFrame:
    """Join ``big`` to ``table`` (unique on ``keys``), whose ``size`` says how many rows a key has.

    Rows of hot keys take their answer from a broadcast of the hot part of ``table``
    (at most total/hot_rows rows) and are then spread over the shuffle by a salt; all other
    rows take the ordinary equi-join. One pass over ``big`` either way. ``spread_by`` names
    the columns that tell rows of one key apart.
    """
    payload = [c for c in table.columns if c not in keys]
    packed = table.select(*keys, F.col(size).alias("_n"), F.struct(*payload).alias("_p"))
    hot = packed.filter(F.col("_n") > hot_rows).select(*keys, F.col("_p").alias("_hot"))
    # The salt depends on a column on purpose: a literal would be folded out of the join keys.
    cold = packed.filter(F.col("_n") <= hot_rows).select(
        *keys, F.when(F.col("_n") < 0, 1).otherwise(0).cast("bigint").alias("_salt"),
        F.col("_p").alias("_cold"),
    )
    spread = F.pmod(F.xxhash64(*(spread_by or big.columns)), F.lit(1_000_003)) + 1
    marked = big.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(spread).cast("bigint")
    )
    joined = marked.join(cold, [*keys, "_salt"], "left")
    answer = F.coalesce("_hot", "_cold")
    if how == "inner":
        joined = joined.filter(answer.isNotNull())
    return joined.select(*big.columns, *[answer[c].alias(c) for c in payload])


def has_hot_group(sizes: DataFrame, keys: list[str], hot_rows: int) -> bool:
    """Cheap size check: does any key of ``sizes`` (rows, not counts) exceed ``hot_rows``?"""
    present = [k for k in keys if k in sizes.columns]
    return not sizes.groupBy(*present).count().filter(F.col("count") > hot_rows).isEmpty()


def rank_within(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank",
                sizes: DataFrame | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Exact 1-based position of every row inside its ``keys`` group.

    ``order`` must be a total order of ascending expressions (negate numbers for descending).
    ``sizes`` is any frame with some of the key columns whose groups are at least as large as
    those of ``df``; it is only counted. When no group is hot a plain window does the work;
    otherwise rows are range-partitioned by (keys, order), so a group is cut where it is large, and
    the counts of the parts before become offsets (:func:`ordered.totals_within`).
    """
    if not has_hot_group(df if sizes is None else sizes, keys, hot_rows):
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    placed = df.withColumns({f"_o{i}": o for i, o in enumerate(order)})
    ranked = totals_within(placed, keys, [f"_o{i}" for i in range(len(order))], {name: F.lit(1)})
    return ranked.withColumn(name, F.col(name) + 1).drop(*[f"_o{i}" for i in range(len(order))])


def dense_index(df: DataFrame, order: list[Column], name: str = "row_index",
                hot_rows: int = HOT_ROWS) -> DataFrame:
    """0-based position in one global total order."""
    keyed = df.withColumn("_all", F.lit(0))
    ranked = rank_within(keyed, ["_all"], order, name, hot_rows=hot_rows)
    return ranked.drop("_all").withColumn(name, F.col(name) - 1)
