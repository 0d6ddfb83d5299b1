"""Period-over-period changes and the screens built on them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import dims
from ledgerloom.functions.amounts import change_amount, change_rate
from ledgerloom.functions.text import label_without_blanks, label_without_loss_mark, squeeze
from ledgerloom.operators.ratios import FILING
from ledgerloom.operators.select import pick_first


def account_changes(statements: DataFrame, sj_divs: Sequence[str] | None = None) -> DataFrame:
    """Amount and rate of change per statement row; no shuffle. ``sj_divs`` keeps some statements only."""
    if sj_divs:
        statements = statements.filter(F.col("sj_div").isin(*sj_divs))
    current, previous = F.col("thstrm_amount"), F.col("frmtrm_amount")
    return statements.select(
        F.col("id").alias("financial_statement_id"),
        *FILING, "rcept_no", "fs_nm", "sj_div", "account_id", "account_nm", "account_detail", "ord",
        F.col("thstrm_nm").alias("current_term_name"),
        F.col("frmtrm_nm").alias("previous_term_name"),
        current.alias("current_amount"),
        previous.alias("previous_amount"),
        change_amount(current, previous).alias("change_amount"),
        change_rate(current, previous).alias("change_rate"),
    )


def change_scan_order() -> list[Column]:
    """Scan order of the statement rows behind the changes."""
    return [
        F.col("bsns_year").desc(),
        F.col("rcept_no").desc(),
        F.col("fs_div").asc(),
        F.col("sj_div").asc(),
        F.col("ord").asc_nulls_first(),
        F.col("financial_statement_id").asc(),
    ]


def statement_position(sj_divs: Sequence[str]) -> Column:
    return F.array_position(F.array(*[F.lit(d) for d in sj_divs]), F.col("sj_div"))


def combined_changes(changes: DataFrame, sj_divs: Sequence[str] = dims.COMBINED_STATEMENTS) -> DataFrame:
    """First row per (filing, statement, account id, name) over the given statements.

    ``account_detail`` is not part of the key. ``statement_position`` keeps the order of the statements.
    """
    chosen = changes.filter(F.col("sj_div").isin(*sj_divs))
    keys = [*FILING, "sj_div", "account_id", "account_nm"]
    return pick_first(chosen, keys, change_scan_order()).withColumn("statement_position", statement_position(sj_divs))


def major_changes(
    changes: DataFrame, accounts: Mapping[str, Sequence[str]] = dims.MAJOR_ACCOUNTS
) -> DataFrame:
    """Rows of the listed accounts with their place in the list; names compare without white space."""
    rows = [
        (division, name, statement, position)
        for statement, (division, names) in enumerate(accounts.items(), start=1)
        for position, name in enumerate(names, start=1)
    ]
    if not rows:
        return changes.limit(0)
    wanted = dims.rows_frame(
        changes.sparkSession, rows, "sj_div string, name string, statement_position int, account_position int"
    ).select("sj_div", squeeze("name").alias("major_label"), "statement_position", "account_position")
    return changes.withColumn("major_label", squeeze("account_nm")).join(wanted, ["sj_div", "major_label"])


def significant_moves(changes: DataFrame, threshold: float = dims.SIGNIFICANT_CHANGE) -> DataFrame:
    """Major accounts whose rate of change reaches the threshold, with direction and message."""
    rules: dict[str, tuple[str, str]] = {}
    for major, (aliases, message) in dims.SCREENING_RULES.items():
        for alias in aliases:
            rules.setdefault(alias.replace(" ", ""), (major, message))
    rule_frame = dims.rows_frame(
        changes.sparkSession,
        [(label, *rule) for label, rule in rules.items()],
        "rule_label string, major_account_nm string, message string",
    )
    rate = F.col("change_rate")
    return (
        changes.filter(F.abs(rate) >= threshold)
        .withColumn("rule_label", label_without_blanks("account_nm"))
        .join(rule_frame, "rule_label")
        .withColumn("direction", F.when(rate > 0, "증가").otherwise("감소"))
        .drop("rule_label")
    )


def divergence(
    changes: DataFrame,
    base: Sequence[str] = dims.DIVERGENCE_BASE,
    target: Sequence[str] = dims.DIVERGENCE_TARGET,
    points: float = dims.DIVERGENCE_POINTS,
    sj_divs: Sequence[str] = dims.COMBINED_STATEMENTS,
) -> DataFrame:
    """Filings where the target account grew at least ``points`` faster than the base account.

    Each side is the first row with a listed name, in statement order and then scan order. Defaults:
    inventory against revenue.
    """

    def plain(names):
        return [name.replace(" ", "").replace("(손실)", "") for name in names]

    label = label_without_loss_mark("account_nm")
    side = F.when(label.isin(*plain(base)), "base").when(label.isin(*plain(target)), "target")
    sided = (
        changes.filter(F.col("sj_div").isin(*sj_divs)).withColumn("side", side).filter(F.col("side").isNotNull())
    )
    picked = pick_first(sided, [*FILING, "side"], [statement_position(sj_divs).asc(), *change_scan_order()])
    rates = picked.groupBy(*FILING).agg(
        F.max(F.when(F.col("side") == "base", F.col("change_rate"))).alias("base_rate"),
        F.max(F.when(F.col("side") == "target", F.col("change_rate"))).alias("target_rate"),
    )
    return rates.withColumn("difference", F.col("target_rate") - F.col("base_rate")).filter(
        F.col("difference") >= points
    )
