"""Earnings per share, effective tax rate and tax-account movements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import dims
from ledgerloom.functions.amounts import change_rate, effective_rate
from ledgerloom.functions.text import label_without_currency_mark, strip
from ledgerloom.operators.changes import account_changes, change_scan_order
from ledgerloom.operators.ratios import FILING
from ledgerloom.operators.select import pick_first, reverse_scan_order, scan_order


def _eps_score(kind: str):
    """Score of a row as basic or diluted earnings per share, and the part that comes from its id or name."""
    label = F.col("eps_label")
    ids, names = dims.EPS_IDS[kind], dims.EPS_NAMES[kind]
    suffixes = {i.split("_", 1)[-1] for i in ids}
    account_id = F.coalesce("account_id", F.lit(""))
    by_id = F.when(account_id.isin(*ids), 100)
    for suffix in sorted(suffixes):
        by_id = by_id.when(account_id.endswith(suffix), 80)
    by_id = by_id.otherwise(0)
    by_name = F.when(label.isin(*names), 60)
    for name in names:
        by_name = by_name.when(label.contains(name), 40)
    by_name = by_name.otherwise(0)
    matched = by_id + by_name
    diluted_name = label.contains(dims.DILUTED_WORD)
    allowed = (diluted_name | (matched >= 80)) if kind == "diluted" else ~diluted_name
    bonus = F.when(F.col("sj_div").isin("IS", "CIS"), 10).otherwise(0) + F.when(
        F.col("thstrm_amount").isNotNull(), 5
    ).otherwise(0)
    return allowed, matched, matched + bonus


def eps(statements: DataFrame, min_match: int = 40) -> DataFrame:
    """Basic and diluted earnings per share of every filing.

    A row has to match by id or name (``min_match``). ``min_match=0`` also accepts rows that only score
    for their statement and amount, as a plain highest-score rule would.
    """
    kinds = []
    for kind in ("basic", "diluted"):
        allowed, matched, score = _eps_score(kind)
        kinds.append(
            F.when(allowed & (matched >= min_match) & (score > 0), F.struct(F.lit(kind).alias("kind"), score.alias("score")))
        )
    rows = statements.withColumn("eps_label", label_without_currency_mark("account_nm")).select(
        "*", F.inline_outer(F.array_compact(F.array(*kinds)))
    )
    picked = pick_first(
        rows, [*FILING, "kind"], [F.col("score").desc(), F.col("rcept_no").desc(), *scan_order()]
    )

    def of(kind, column):
        return F.max(F.when(F.col("kind") == kind, F.col(column)))

    wide = picked.groupBy(*FILING).agg(
        of("basic", "thstrm_amount").alias("basic_eps"),
        of("basic", "frmtrm_amount").alias("previous_basic_eps"),
        of("diluted", "thstrm_amount").alias("diluted_eps"),
        of("diluted", "frmtrm_amount").alias("previous_diluted_eps"),
        F.max(F.when(F.col("kind") == "basic", F.struct("currency"))).alias("basic_row"),
        F.max(F.when(F.col("kind") == "diluted", F.struct("currency"))).alias("diluted_row"),
    )
    first_row = F.coalesce("basic_row", "diluted_row")
    return wide.select(
        *FILING,
        "basic_eps",
        "previous_basic_eps",
        change_rate(F.col("basic_eps"), F.col("previous_basic_eps")).alias("basic_eps_change_rate"),
        "diluted_eps",
        "previous_diluted_eps",
        change_rate(F.col("diluted_eps"), F.col("previous_diluted_eps")).alias("diluted_eps_change_rate"),
        F.when(
            first_row.isNotNull(),
            F.coalesce(F.nullif(first_row["currency"], F.lit("")), F.lit(dims.DEFAULT_CURRENCY)),
        ).alias("currency"),
    )


def effective_tax_rate(statements: DataFrame, prefer: str = "last") -> DataFrame:
    """Tax expense over pre-tax profit per filing, with a status instead of an error.

    Names are compared as written. ``prefer='last'`` takes the last matching row of the scan, which is
    the oldest receipt; ``'latest'`` takes the first one.
    """
    name = F.col("account_nm")
    role = F.when(name.isin(*dims.TAX_EXPENSE_NAMES), "tax").when(name.isin(*dims.PRETAX_PROFIT_NAMES), "profit")
    order = reverse_scan_order() if prefer == "last" else scan_order()
    picked = pick_first(statements.withColumn("role", role), [*FILING, "role"], order)
    wide = picked.groupBy(*FILING).agg(
        F.max(F.when(F.col("role") == "tax", F.col("thstrm_amount"))).alias("tax_expense"),
        F.max(F.when(F.col("role") == "profit", F.col("thstrm_amount"))).alias("profit_before_tax"),
    )
    tax, profit = F.col("tax_expense"), F.col("profit_before_tax")
    return wide.withColumn(
        "effective_tax_rate", F.when(tax.isNotNull(), effective_rate(tax, profit))
    ).withColumn(
        "status",
        F.when(tax.isNull(), "no_tax_expense")
        .when(profit.isNull(), "no_pretax_profit")
        .when(profit <= 0, "no_profit")
        .otherwise("ok"),
    )


def tax_movements(statements: DataFrame) -> DataFrame:
    """Tax accounts of the balance sheet, largest absolute movement first within each filing."""
    rows = [
        (name, code, label)
        for code, (label, names) in dims.TAX_ACCOUNT_GROUPS.items()
        for name in names
    ]
    groups = dims.rows_frame(
        statements.sparkSession, rows, "tax_label string, tax_account_code string, tax_account_name string"
    )
    current, previous = F.coalesce("current_amount", F.lit(0)), F.coalesce("previous_amount", F.lit(0))
    return (
        account_changes(statements, ["BS"])
        .withColumn("tax_label", strip("account_nm"))
        .join(groups, "tax_label")
        .withColumn("sort_amount", F.abs(current - previous))
        .orderBy(*FILING, F.col("sort_amount").desc(), *change_scan_order())
    )
