"""Merges on Parquet tables: insert-if-absent, upsert, snapshot sync, delete, memberships.

Each function returns the rows of the merged table (or the new rows); ``plans.tables`` writes them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import corp_key, has_text, strip
from ledgerloom.operators.quality import required, split_rejects
from ledgerloom.operators.select import pick_first, rank_within
from ledgerloom.session import cut_lineage

STATEMENT_KEY = ["rcept_no", "fs_div", "sj_div", "account_id", "account_nm", "account_detail", "ord"]
RATIO_KEY = ["corp_code", "bsns_year", "reprt_code", "fs_div", "ratio_code", "calculation_version"]
CHANGE_KEY = ["financial_statement_id", "calculation_version"]


def insert_if_absent(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], nullable: str, order: Sequence[Column]
) -> DataFrame:
    """Incoming rows to append: the first of each key that the table does not have yet.

    A null in ``nullable`` never equals another null, so such rows are always new.
    """
    keyed = pick_first(incoming.filter(F.col(nullable).isNotNull()), keys, order)
    current = existing.filter(F.col(nullable).isNotNull()).select(*keys)
    fresh = keyed.join(current, list(keys), "left_anti")
    return fresh.unionByName(incoming.filter(F.col(nullable).isNull()))


def upsert(
    existing: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    updated: Sequence[str],
    order: Sequence[Column],
) -> DataFrame:
    """Merged table. Incoming rows replace ``updated``; other columns keep their stored values.

    ``order`` says which of several incoming rows with one key counts (the first).
    """
    new = pick_first(incoming, keys, order).withColumn("_new", F.lit(True)).alias("n")
    old = existing.withColumn("_old", F.lit(True)).alias("o")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    joined = old.join(new, on, "full_outer")
    columns = []
    for name in existing.columns:
        if name in keys:
            columns.append(F.coalesce(f"o.{name}", f"n.{name}").alias(name))
        elif name in updated:
            columns.append(F.when(F.col("_new"), F.col(f"n.{name}")).otherwise(F.col(f"o.{name}")).alias(name))
        else:
            columns.append(F.when(F.col("_old"), F.col(f"o.{name}")).otherwise(F.col(f"n.{name}")).alias(name))
    return joined.select(*columns)


def upsert_ratios(existing: DataFrame, incoming: DataFrame, order: Sequence[Column]) -> DataFrame:
    updated = ["ratio_name", "ratio_value", "numerator_value", "denominator_value", "calculated_at"]
    return upsert(existing, incoming, RATIO_KEY, updated, order)


def upsert_changes(existing: DataFrame, incoming: DataFrame, order: Sequence[Column]) -> DataFrame:
    return upsert(existing, incoming, CHANGE_KEY, ["change_amount", "change_rate", "calculated_at"], order)


# What a stored change must have.
CHANGE_REQUIRED = ("financial_statement_id", "corp_code", "bsns_year", "reprt_code", "fs_div", "sj_div", "account_nm")


def storable_changes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reasons) of calculated changes before they are stored.

    Account id and detail become empty text instead of null, and a change amount loses what is after the point.
    """
    accepted, rejected = split_rejects(rows, required(CHANGE_REQUIRED))
    filled = accepted.withColumns({c: F.coalesce(c, F.lit("")) for c in ("account_id", "account_detail")})
    return filled.withColumn("change_amount", F.col("change_amount").try_cast("bigint")), rejected


def sync_registry(current: DataFrame, snapshot: DataFrame, seen_at: Column) -> DataFrame:
    """Registry after a snapshot, with ``sync_action`` per row.

    New companies are added, known ones updated and reactivated, active ones that are missing from the
    snapshot become inactive; nothing is removed. One full outer join.
    """
    new = snapshot.withColumn("_new", F.lit(True)).alias("n")
    old = current.withColumn("_old", F.lit(True)).alias("o")
    joined = old.join(new, F.col("o.corp_code") == F.col("n.corp_code"), "full_outer")
    seen = F.coalesce("_new", F.lit(False))
    dropped = ~seen & F.col("o.is_active")

    def fresh(name):
        return F.when(seen, F.nullif(F.col(f"n.{name}"), F.lit(""))).otherwise(F.col(f"o.{name}")).alias(name)

    return joined.select(
        F.coalesce("o.corp_code", "n.corp_code").alias("corp_code"),
        fresh("corp_name"),
        fresh("stock_code"),
        fresh("modify_date"),
        F.when(seen, True).when(dropped, False).otherwise(F.col("o.is_active")).alias("is_active"),
        F.coalesce("o.first_seen_at", seen_at).alias("first_seen_at"),
        F.when(seen, seen_at).otherwise(F.col("o.last_seen_at")).alias("last_seen_at"),
        F.when(seen, F.lit(None)).when(dropped, seen_at).otherwise(F.col("o.deactivated_at")).alias("deactivated_at"),
        F.when(F.col("_old").isNull(), "inserted")
        .when(seen, "updated")
        .when(dropped, "deactivated")
        .otherwise("unchanged")
        .alias("sync_action"),
    )


def sync_counts(synced: DataFrame) -> DataFrame:
    """Counters of one snapshot sync from its merged rows."""
    received = F.col("sync_action").isin("inserted", "updated")
    return synced.agg(
        F.count_if(received).alias("received_count"),
        F.count_if(received & F.col("stock_code").isNotNull()).alias("listed_count"),
        F.count_if(received & F.col("stock_code").isNull()).alias("unlisted_count"),
        F.count_if(F.col("sync_action") == "deactivated").alias("deactivated_count"),
    )


def delete_rows(table: DataFrame, condition: Column) -> DataFrame:
    """Rows that stay; a null condition does not delete."""
    return table.filter(~F.coalesce(condition, F.lit(False)))


def create_groups(existing: DataFrame, incoming: DataFrame, ordinal: str) -> DataFrame:
    """New industry groups: code trimmed and upper-cased, name trimmed, both unique; ids continue upwards.

    Rows count in the order of ``ordinal``: one is refused when it is blank or its code or name is taken by
    a stored group or an accepted earlier row. Each round accepts the rows that nothing before them can
    refuse and drops what they refuse; batches need few rounds.
    """
    cleaned = (
        incoming.withColumn("industry_code", F.upper(strip("industry_code")))
        .withColumn("industry_name", strip("industry_name"))
        .filter((F.col("industry_code") != "") & (F.col("industry_name") != ""))
    )
    fresh = cleaned.join(existing.select("industry_code"), "industry_code", "left_anti").join(
        existing.select("industry_name"), "industry_name", "left_anti"
    )
    waiting, unique = cut_lineage(fresh), None
    while not waiting.isEmpty():
        by_code = waiting.groupBy("industry_code").agg(F.min(ordinal).alias("_code_first"))
        by_name = waiting.groupBy("industry_name").agg(F.min(ordinal).alias("_name_first"))
        marked = waiting.join(by_code, "industry_code").join(by_name, "industry_name")
        first = (F.col(ordinal) == F.col("_code_first")) & (F.col(ordinal) == F.col("_name_first"))
        accepted = cut_lineage(marked.filter(first).select(*waiting.columns))
        unique = accepted if unique is None else unique.unionByName(accepted)
        waiting = cut_lineage(
            waiting.join(accepted.select("industry_code"), "industry_code", "left_anti").join(
                accepted.select("industry_name"), "industry_name", "left_anti"
            )
        )
    unique = fresh.limit(0) if unique is None else unique
    numbered = rank_within(unique.withColumn("_all", F.lit(1)), ["_all"], [F.col(ordinal).asc()], out="_step").drop("_all")
    last = existing.agg(F.coalesce(F.max("industry_id"), F.lit(0)).cast("bigint").alias("last"))
    return numbered.withColumn("industry_id", last.scalar() + F.col("_step")).drop("_step")


def add_members(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Memberships to append: padded codes, blanks dropped, each pair once and only if new."""
    pairs = (
        incoming.filter(has_text("corp_code"))
        .select("industry_id", corp_key("corp_code").alias("corp_code"))
        .dropDuplicates(["industry_id", "corp_code"])
    )
    return pairs.join(existing.select("industry_id", "corp_code"), ["industry_id", "corp_code"], "left_anti")


def remove_members(existing: DataFrame, removals: DataFrame) -> DataFrame:
    gone = removals.select("industry_id", corp_key("corp_code").alias("corp_code"))
    return existing.join(gone, ["industry_id", "corp_code"], "left_anti")


def delete_groups(groups: DataFrame, members: DataFrame, removals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups and memberships that remain; memberships of a deleted group go with it."""
    gone = removals.select("industry_id")
    return groups.join(gone, "industry_id", "left_anti"), members.join(gone, "industry_id", "left_anti")
