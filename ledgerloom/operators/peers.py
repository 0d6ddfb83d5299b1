"""Peer tables, summary statistics, rankings and industry peer sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import dims
from ledgerloom.functions.text import account_label, corp_key, has_text, scope_rank, strip
from ledgerloom.operators.ratios import FILING
from ledgerloom.operators.select import pick_first, rank_within

CONDITION = ["bsns_year", "reprt_code", "fs_div"]


def latest_ratios(ratios: DataFrame) -> DataFrame:
    """Newest result per (filing, ratio), whatever its version."""
    return pick_first(ratios, [*FILING, "ratio_code"], [F.col("calculated_at").desc(), F.col("id").desc()])


def latest_changes(changes: DataFrame) -> DataFrame:
    """Newest result per (filing, statement, account), whatever its version."""
    return pick_first(
        changes,
        [*FILING, "sj_div", "account_id", "account_nm", "account_detail"],
        [F.col("calculated_at").desc(), F.col("id").desc()],
    )


def unique_peers(peers: DataFrame, ordinal: str) -> DataFrame:
    """Padded company code, first mention wins, blank codes dropped, name falls back to the code."""
    keyed = peers.withColumn("corp_code", corp_key("corp_code")).filter(F.col("corp_code") != "")
    name = F.coalesce(F.nullif(strip("corp_name"), F.lit("")), F.col("corp_code"))
    return pick_first(keyed, ["corp_code"], [F.col(ordinal).asc()]).withColumn("corp_name", name)


def change_columns(changes: DataFrame) -> DataFrame:
    """One chosen row per (filing, change column).

    Rows of an unexpected statement rank last but may still win. Ties follow the order of the stored
    result: statement, account name, detail.
    """
    alias = dims.rows_frame(
        changes.sparkSession, dims.ranked_labels(dims.CHANGE_ALIASES), "column_key string, alias_label string, alias_rank int"
    )
    statement = F.lit(99)
    for key, divisions in dims.CHANGE_STATEMENTS.items():
        for rank, division in enumerate(divisions):
            statement = F.when(
                (F.col("column_key") == key) & (F.col("sj_div") == division), rank
            ).otherwise(statement)
    matched = changes.withColumn("alias_label", account_label("account_nm")).join(alias, "alias_label")
    scope = F.when(
        F.col("column_key").isin(*dims.CHANGE_SCOPED), scope_rank("account_id", "account_nm", "account_detail")
    ).otherwise(0)
    order = [
        statement.asc(),
        scope.asc(),
        F.col("alias_rank").asc(),
        has_text("account_detail").asc(),
        F.col("sj_div").asc(),
        F.col("account_nm").asc(),
        F.col("account_detail").asc(),
        F.col("account_id").asc(),
    ]
    return pick_first(matched, [*FILING, "column_key"], order)


def peer_table(peers: DataFrame, ratios: DataFrame, changes: DataFrame, with_missing: bool = False) -> DataFrame:
    """Thirteen ratios and seven change rates per company and reporting condition.

    ``peers`` has unique ``corp_code`` and ``corp_name``; ``ratios`` and ``changes`` are the latest
    results. With ``with_missing`` companies without any data follow as rows with a null condition.
    """
    chosen = peers.select("corp_code")
    wide_ratios = (
        ratios.filter(F.col("ratio_code").isin(*dims.GENERAL_RATIO_NAMES))
        .join(chosen, "corp_code", "left_semi")
        .groupBy(*FILING)
        .agg(
            *[F.max(F.when(F.col("ratio_code") == code, F.col("ratio_value"))).alias(code) for code in dims.GENERAL_RATIO_NAMES]
        )
    )
    wide_changes = (
        change_columns(changes.join(chosen, "corp_code", "left_semi"))
        .groupBy(*FILING)
        .agg(*[F.max(F.when(F.col("column_key") == key, F.col("change_rate"))).alias(key) for key in dims.CHANGE_ALIASES])
    )
    metrics = wide_ratios.join(wide_changes, FILING, "full_outer")
    joined = peers.select("corp_code", "corp_name").join(metrics, "corp_code", "left" if with_missing else "inner")
    return joined.select("corp_code", "corp_name", *CONDITION, *dims.PEER_METRICS)


def missing_peers(table: DataFrame) -> DataFrame:
    """Companies of a condition for which every metric is null."""
    return table.filter(F.coalesce(*[F.col(m).cast("double") for m in dims.PEER_METRICS]).isNull()).select(
        "corp_code", "corp_name", *CONDITION
    )


def sort_peers(table: DataFrame, sort_key: str = "corp_name", descending: bool = False) -> DataFrame:
    """By name (always ascending) or by a metric with nulls last in both directions."""
    if sort_key == "corp_name":
        order = [F.col("corp_name").asc()]
    elif sort_key in dims.PEER_METRICS:
        order = [F.col(sort_key).desc_nulls_last() if descending else F.col(sort_key).asc_nulls_last()]
    else:
        raise ValueError(f"unknown sort key: {sort_key}")
    return table.orderBy(*CONDITION, *order, "corp_code")


def metrics_long(table: DataFrame, metrics: Sequence[str] = dims.PEER_METRICS) -> DataFrame:
    keys = [c for c in table.columns if c not in dims.PEER_METRICS]
    return table.unpivot(keys, list(metrics), "metric", "value").filter(F.col("value").isNotNull())


def metric_summary(values: DataFrame, groups: Sequence[str], unique_key: str = "corp_code") -> DataFrame:
    """Count, mean, exact median, sample deviation, minimum and maximum of ``value`` per group.

    The median comes from exact ranks over range partitions, so no group has to fit into one task.
    """
    ranked = rank_within(
        values.select(*groups, unique_key, "value"), groups, [F.col("value").asc(), F.col(unique_key).asc()],
        out="_rank", total="_size",
    )
    middle = (F.col("_rank") == F.expr("(_size + 1) div 2")) | (F.col("_rank") == F.expr("(_size + 2) div 2"))
    return ranked.groupBy(*groups).agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.avg(F.when(middle, F.col("value"))).alias("median"),
        F.stddev_samp("value").alias("stdev"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )


def rank_ratios(ratios: DataFrame, groups: Sequence[str] = (*CONDITION, "ratio_code")) -> DataFrame:
    """Position of each company by value, highest first; equal values keep the order of company codes."""
    present = ratios.filter(F.col("ratio_value").isNotNull())
    return rank_within(present, list(groups), [F.col("ratio_value").desc(), F.col("corp_code").asc()])


def unavailable_companies(peers: DataFrame, statements: DataFrame) -> DataFrame:
    """Requested companies that cannot be compared, with the reason."""
    code = F.coalesce(strip("corp_code"), F.lit(""))
    named = peers.select(code.alias("corp_code"), "corp_name")
    blank = named.filter(F.col("corp_code") == "").withColumn("reason", F.lit("no_corp_code"))
    absent = (
        named.filter(F.col("corp_code") != "")
        .join(statements.select("corp_code").distinct(), "corp_code", "left_anti")
        .withColumn("reason", F.lit("no_statements"))
    )
    return blank.unionByName(absent)


def industry_peers(members: DataFrame, table: DataFrame) -> DataFrame:
    """Peer table of every industry at once; a company appears in each industry it belongs to."""
    return members.select("industry_id", "corp_code").join(table, "corp_code")


def industry_counts(groups: DataFrame, members: DataFrame) -> DataFrame:
    """Members per group, zero for an empty one. Members are counted before the join."""
    counts = members.groupBy("industry_id").agg(F.count("corp_code").alias("member_count"))
    return groups.join(counts, "industry_id", "left").withColumn(
        "member_count", F.coalesce("member_count", F.lit(0))
    )
