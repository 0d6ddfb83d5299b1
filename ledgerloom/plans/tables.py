"""Reading and writing the stored tables on Parquet.

Large tables are partitioned by ``bsns_year, reprt_code``: a merge rewrites the partitions it touches and
nothing else. Small tables are kept as numbered snapshots, so a reader never sees a half-written one.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.operators import merge
from ledgerloom.schemas import COMMITS
from ledgerloom.session import cut_lineage

PARTITIONS = ["bsns_year", "reprt_code"]


def read_table(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Stored rows, or an empty frame of ``schema`` before the first write. A row without id only marks an emptied partition."""
    empty = spark.createDataFrame([], schema)
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return empty
    rows = stored.select(*[F.col(f.name).cast(f.dataType) for f in empty.schema.fields])
    return rows.filter(F.col("id").isNotNull()) if "id" in empty.columns else rows


def last_commit(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One row: number of the last commit to table ``name`` and the last id that it gave, 0 before the first.

    Read from a table of one row per commit, not from the table itself.
    """
    commits = read_table(spark, path, COMMITS).filter(F.col("name") == name)
    return commits.agg(F.coalesce(F.max("commit"), F.lit(0)).alias("commit"), F.coalesce(F.max("last_id"), F.lit(0)).alias("last_id"))


def add_commit(last: DataFrame, path: str, name: str, last_id: DataFrame) -> None:
    """Reserve what follows ``last``, before rows are written: a write that fails leaves a gap, never an id twice."""
    row = last_id.toDF("given").select(
        F.lit(name).alias("name"), (last.select("commit").scalar() + 1).alias("commit"),
        F.coalesce("given", last.select("last_id").scalar()).cast("bigint").alias("last_id"),
    )
    row.coalesce(1).write.mode("append").parquet(path)


def _balanced(df: DataFrame) -> DataFrame:
    """Rows of a partition together, in as many tasks as their size asks for: a hot year is split, small ones share."""
    return df.hint("rebalance", *PARTITIONS)


def append(df: DataFrame, path: str) -> None:
    _balanced(df).write.mode("append").partitionBy(*PARTITIONS).parquet(path)


def overwrite_partitions(df: DataFrame, path: str) -> None:
    """Replace the partitions that occur in ``df``."""
    _balanced(df).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(path)


def touched(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored rows in the partitions of ``incoming``; the semi-join on partition columns prunes the scan.

    Partitions are folders, so there are few and they are sent to the stored rows, which are not exchanged for this.
    """
    return stored.join(F.broadcast(incoming.select(*PARTITIONS).distinct()), PARTITIONS, "left_semi")


def upsert_table(
    spark: SparkSession, path: str, incoming: DataFrame, keys: Sequence[str], updated: Sequence[str], order: Sequence[Column]
) -> None:
    stored = read_table(spark, path, incoming.schema)
    overwrite_partitions(merge.upsert(touched(stored, incoming), incoming, keys, updated, order), path)


def delete_from_table(spark: SparkSession, path: str, schema: StructType | str, condition: Column) -> DataFrame:
    """Delete matching rows; returns how many there were.

    One pass counts by partition what is deleted and what stays; one write replaces the partitions that are hit. A
    partition that loses all its rows keeps one row without id, which ``read_table`` leaves out.
    """
    stored = read_table(spark, path, schema)
    hit = F.coalesce(condition, F.lit(False))
    sizes = stored.groupBy(*PARTITIONS).agg(F.count_if(hit).alias("deleted"), F.count_if(~hit).alias("left")).filter("deleted > 0")
    sizes = cut_lineage(sizes)
    marks = sizes.filter("left = 0").select(
        *[F.col(f.name) if f.name in PARTITIONS else F.lit(None).cast(f.dataType).alias(f.name) for f in stored.schema.fields]
    )
    overwrite_partitions(merge.delete_rows(touched(stored, sizes), condition).unionByName(marks), path)
    return sizes.agg(F.coalesce(F.sum("deleted"), F.lit(0)).alias("deleted_count"))


def read_snapshot(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, int]:
    """(rows of the newest snapshot, its number); number 0 before the first write. Folder names tell which is newest."""
    empty = spark.createDataFrame([], schema)
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return empty, 0
    newest = max(int(number) for file in stored.inputFiles() for number in re.findall(r"/snapshot=(\d+)/", file))
    rows = stored.filter(F.col("snapshot") == newest)
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in empty.schema.fields]), newest


def write_snapshot(df: DataFrame, path: str, number: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/snapshot={number}")
