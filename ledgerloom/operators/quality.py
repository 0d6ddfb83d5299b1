"""Constraints as operators: each returns the rows that break a rule, or splits good rows from bad."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import as_column, has_text


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).filter(F.col("row_count") > 1)


def orphans(df: DataFrame, column: str, parents: DataFrame, parent_column: str) -> DataFrame:
    """Rows whose reference is set but unknown."""
    known = parents.select(F.col(parent_column).alias(column)).distinct()
    return df.filter(F.col(column).isNotNull()).join(known, column, "left_anti")


def integrity(
    tables: Mapping[str, DataFrame],
    unique: Mapping[str, tuple[str, Sequence[str]]] = {},
    references: Mapping[str, tuple[str, str, str, str]] = {},
    rules: Mapping[str, Mapping[str, Column]] = {},
) -> DataFrame:
    """``(rule, violations)`` of all constraints, with one scan of each table and one grouping.

    ``unique``: table and key columns, violated by each key that stands more than once. ``references``: table, column,
    parent table and column, violated by each row whose value is set but unknown there. ``rules``: by table, conditions on
    a row; a null condition counts as broken. A row gives a key for each rule that it takes part in; keys are added up
    before they are exchanged, so a frequent key is harmless. A rule over empty tables is not listed.
    """
    parts = []
    for name, frame in tables.items():

        def entry(rule: str, key: Sequence[str] | None, own: Column | int, parent: int) -> Column:
            keys = F.array(*[F.col(c).cast("string") for c in key]) if key else F.array().cast("array<string>")
            return F.struct(F.lit(rule).alias("rule"), keys.alias("key"), F.lit(own).cast("long").alias("own"), F.lit(parent).alias("parent"))

        entries = [entry(rule, keys, 1, 0) for rule, (table, keys) in unique.items() if table == name]
        for rule, (table, column, parent, parent_column) in references.items():
            entries += [entry(rule, [column], F.col(column).isNotNull().cast("int"), 0)] if table == name else []
            entries += [entry(rule, [parent_column], 0, 1)] if parent == name else []
        entries += [entry(rule, None, (~F.coalesce(test, F.lit(False))).cast("int"), 0) for rule, test in rules.get(name, {}).items()]
        if entries:
            parts.append(frame.select(F.inline(F.array(*entries))))
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.union(part)
    keyed = stacked.groupBy("rule", "key").agg(F.sum("own").alias("own"), F.max("parent").alias("parent"))
    broken = (
        F.when(F.col("rule").isin(*unique), (F.col("own") > 1).cast("long"))
        .when(F.col("parent") == 0, F.col("own")).otherwise(0)
    )
    return keyed.groupBy("rule").agg(F.sum(broken).alias("violations"))


def is_year(value: Column | str) -> Column:
    return as_column(value).rlike(r"^[0-9]{4}$")


def is_console_year(value: Column | str) -> Column:
    return is_year(value) & as_column(value).try_cast("int").between(2000, 2100)


def is_scope(value: Column | str) -> Column:
    return as_column(value).isin("CFS", "OFS")


def is_corp_code(value: Column | str) -> Column:
    return as_column(value).rlike(r"^[0-9]{8}$")


def is_receipt_number(value: Column | str) -> Column:
    return as_column(value).rlike(r"^[0-9]{14}$")


def is_date(value: Column | str) -> Column:
    return as_column(value).rlike(r"^[0-9]{8}$")


def is_date_range(start: Column | str, end: Column | str) -> Column:
    return is_date(start) & is_date(end) & (as_column(start) <= as_column(end))


def required(columns: Sequence[str]) -> dict[str, Column]:
    return {f"missing:{name}": has_text(F.col(name).cast("string")) for name in columns}


def with_reasons(df: DataFrame, rules: Mapping[str, Column], out: str = "reasons") -> DataFrame:
    """Names of the rules a row breaks; a rule that is null counts as broken."""
    broken = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    return df.withColumn(out, F.array_compact(F.array(*broken)))


def split_rejects(
    df: DataFrame, rules: Mapping[str, Column], strict: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected). ``strict`` makes the first bad row fail the job instead."""
    checked = with_reasons(df, rules)
    bad = F.size("reasons") > 0
    if strict:
        message = F.concat(F.lit("invalid row: "), F.array_join("reasons", ", "))
        # the error is part of the kept filter, so it cannot be pruned away with an unused column
        accepted = checked.filter(F.when(bad, F.raise_error(message).cast("boolean")).otherwise(True))
        return accepted.drop("reasons"), checked.filter(F.lit(False))
    return checked.filter(~bad).drop("reasons"), checked.filter(bad)
