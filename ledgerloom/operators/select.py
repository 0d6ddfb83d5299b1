"""Pick-one-row and ranking primitives.

``pick_first`` filters ``row_number() = 1``. Spark plans a partial WindowGroupLimit below the
exchange, so every map task sends at most one row per key: a key holding a third of the table
costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import cut_lineage

_RN = "_pick_rn"


def pick_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(_RN, F.row_number().over(window)).filter(F.col(_RN) == 1).drop(_RN)


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add an expensive column that is computed exactly once per row.

    A filter on an ordinary column is pushed below the projection and computes the column again. The
    outer generator keeps its rows and its value where they are.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def scan_order() -> list[Column]:
    """Order in which stored statement rows are read; the last word in every tie."""
    return [
        F.col("bsns_year").desc(),
        F.col("rcept_no").desc(),
        F.col("fs_div").asc(),
        F.col("sj_div").asc(),
        F.col("ord").asc_nulls_first(),
        F.col("id").asc(),
    ]


def reverse_scan_order() -> list[Column]:
    return [
        F.col("bsns_year").asc(),
        F.col("rcept_no").asc(),
        F.col("fs_div").desc(),
        F.col("sj_div").desc(),
        F.col("ord").desc_nulls_last(),
        F.col("id").desc(),
    ]


def rank_within(
    df: DataFrame, groups: Sequence[str], order: Sequence[Column], out: str = "rank", total: str | None = None
) -> DataFrame:
    """Exact ``row_number`` inside groups of any size.

    Rows are range-partitioned by (group, order), so a group spreads over as many partitions as it
    needs. Each slice is numbered on its own and shifted by the row counts of the slices before it;
    only one count per (group, slice) is combined. ``order`` has to end with a unique key, or rows that
    are equal in it cannot be split. ``total`` names a column for the size of the group.
    """
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(slices, *[F.col(g).asc() for g in groups], *order)
    staged = cut_lineage(ranged.withColumn("_slice", F.spark_partition_id()))
    by_slice = Window.partitionBy(*groups).orderBy("_slice")
    counts = staged.groupBy(*groups, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn(
        "_before",
        F.coalesce(F.sum("_n").over(by_slice.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    )
    if total:
        offsets = offsets.withColumn(total, F.sum("_n").over(Window.partitionBy(*groups)))
    offsets = offsets.drop("_n")
    local = Window.partitionBy(*groups, "_slice").orderBy(*order)
    return (
        staged.withColumn("_local", F.row_number().over(local))
        .join(offsets, [*groups, "_slice"])
        .withColumn(out, F.col("_before") + F.col("_local"))
        .drop("_slice", "_local", "_before")
    )
