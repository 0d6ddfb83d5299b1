"""Landed filing lists: every page of every request at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fields of a listed filing, answer codes.
FIELDS = ("corp_code", "corp_name", "report_nm", "rcept_no", "rcept_dt", "flr_nm")
PAGE = "status string, message string, page_no int, total_page int, list array<struct<" + ", ".join(
    f"{name}: string" for name in FIELDS
) + ">>"
STATUS_OK, STATUS_NO_DATA = "000", "013"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGE).option("multiLine", True).json(path).withColumn("file", F.input_file_name())


def listed_filings(pages: DataFrame, source: str = "file") -> DataFrame:
    """One row per listed filing; ``ordinal`` keeps the order inside a page."""
    good = pages.filter(F.col("status") == STATUS_OK)
    return good.select(source, F.coalesce("page_no", F.lit(1)).alias("page_no"), F.posexplode("list").alias("place", "l")).select(
        "l.*", F.struct("page_no", "place", source).alias("ordinal")
    )


def failed_pages(pages: DataFrame) -> DataFrame:
    """Answers that are neither usable nor simply empty."""
    return pages.filter(~F.coalesce("status", F.lit("")).isin(STATUS_OK, STATUS_NO_DATA)).drop("list")
