"""Preparing filings for many companies at once: outcomes are rows, so one failure stops nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import corp_key
from ledgerloom.operators.select import pick_first
from ledgerloom.sources.statements import Ingest


def unique_requests(requests: DataFrame) -> DataFrame:
    """Requested companies by padded code, first mention wins; ``position`` restores the order of the request."""
    keyed = requests.withColumn("corp_code", corp_key("corp_code")).filter(F.col("corp_code") != "")
    return pick_first(keyed, ["corp_code"], [F.col("position").asc()])


def outcomes(requests: DataFrame, delivered: Ingest, ratios: DataFrame, changes: DataFrame) -> DataFrame:
    """One row per requested company with its counts per stage and the stage that failed, if any.

    ``ratios`` and ``changes`` are what was calculated of the rows after the save. Each stage is aggregated to companies first, so the
    joins are between tables of one row per company.
    """
    good = F.size("reasons") == 0
    received = delivered.checked_rows.groupBy("corp_code").agg(
        F.count_if(good).alias("received_count"), F.count_if(~good).alias("rejected_count")
    )
    refused = delivered.rejected_answers.groupBy("corp_code").agg(F.min("reason").alias("answer_reason"))
    ratio_counts = ratios.groupBy("corp_code").agg(F.count("ratio_value").alias("ratio_count"))
    change_counts = changes.groupBy("corp_code").agg(F.count(F.lit(1)).alias("change_count"))
    joined = unique_requests(requests)
    for part in (received, refused, ratio_counts, change_counts):
        joined = joined.join(part, "corp_code", "left")
    counts = ("received_count", "rejected_count", "ratio_count", "change_count")
    joined = joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    stage = (
        F.when(F.col("received_count") == 0, "fetch")
        .when(F.col("ratio_count") == 0, "ratios")
        .when(F.col("change_count") == 0, "changes")
    )
    return joined.select(
        "position",
        "corp_code",
        *counts,
        stage.alias("failed_stage"),
        F.when(stage == "fetch", F.coalesce("answer_reason", F.lit("no_answer"))).alias("message"),
        stage.isNull().alias("is_success"),
    )


def outcome_summary(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Requested, unique, succeeded and failed companies."""
    asked = requests.agg(F.count(F.lit(1)).alias("requested_count"))
    return results.agg(
        asked.scalar().alias("requested_count"),
        F.count(F.lit(1)).alias("unique_count"),
        F.count_if("is_success").alias("success_count"),
        F.count_if(~F.col("is_success")).alias("failure_count"),
    )
