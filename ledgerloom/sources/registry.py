"""Company registry as landed: XML rows, plain or inside a ZIP."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import clean_text
from ledgerloom.sources.archives import member_elements

FIELDS = ("corp_code", "corp_name", "stock_code", "modify_date")
ROW = ", ".join(f"{name} string" for name in FIELDS)


def clean_registry(rows: DataFrame) -> DataFrame:
    """Trimmed fields, empty text as null, rows without code or name dropped."""
    cleaned = rows.select(*[clean_text(name).alias(name) for name in FIELDS])
    return cleaned.filter(F.col("corp_code").isNotNull() & F.col("corp_name").isNotNull())


def read_registry_xml(spark: SparkSession, path: str) -> DataFrame:
    """One row per ``<list>`` element; a large file is split by the reader."""
    return clean_registry(spark.read.format("xml").option("rowTag", "list").schema(ROW).load(path))


def registry_from_zip(archives: DataFrame, key: str = "path") -> DataFrame:
    """Rows of the first XML member of each archive, which is streamed: a row per ``<list>`` range, not per archive."""
    entries = member_elements(archives, key, ".xml", "list").hint("rebalance")
    return clean_registry(entries.select(F.from_xml("entry", ROW).alias("r")).select("r.*"))
