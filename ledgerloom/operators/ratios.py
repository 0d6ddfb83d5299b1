"""General and bank ratios for every filing in one plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import dims
from ledgerloom.functions.amounts import average, days, percentage, turnover
from ledgerloom.functions.text import account_label, has_text, scope_rank
from ledgerloom.operators.select import pick_first, scan_order

FILING = ["corp_code", "bsns_year", "reprt_code", "fs_div"]


def match_accounts(
    statements: DataFrame,
    aliases: Mapping[str, Sequence[str]],
    divisions: Mapping[str, Sequence[str]],
    repeat_wins: str = "last",
) -> DataFrame:
    """Add ``account_key``, ``alias_rank``, ``division_rank``; rows without a match keep nulls."""
    alias = dims.alias_frame(statements.sparkSession, aliases, divisions, repeat_wins)
    return statements.withColumn("alias_label", account_label("account_nm")).join(
        alias, ["alias_label", "sj_div"], "left"
    )


def select_general_accounts(statements: DataFrame) -> DataFrame:
    """One row per (filing, account key). A filing without any known account keeps one null-key row."""
    matched = match_accounts(statements, dims.GENERAL_ALIASES, dims.GENERAL_STATEMENTS)
    order = [
        F.col("division_rank").asc(),
        F.when(F.col("account_key").isNotNull(), scope_rank("account_id", "account_nm", "account_detail")).asc(),
        F.col("alias_rank").asc(),
        has_text("account_detail").asc(),
        F.coalesce("account_id", F.lit("")).asc(),
        *scan_order(),
    ]
    return pick_first(matched, [*FILING, "account_key"], order)


def select_bank_accounts(statements: DataFrame) -> DataFrame:
    """As above with the bank names: exact names before prefixes, then the printed order of rows."""
    aliases = {key: dims.BANK_ALIASES[key] for key in dims.BANK_KEYS_USED}
    exact = match_accounts(statements, aliases, dims.BANK_STATEMENTS, repeat_wins="first")
    prefix_key, prefix_rank, prefix_division = F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("int")
    for key, prefixes in dims.BANK_PREFIXES.items():
        for division_rank, division in enumerate(dims.BANK_STATEMENTS[key]):
            for rank, prefix in reversed(list(enumerate(prefixes))):
                hit = (F.col("sj_div") == division) & F.col("alias_label").startswith(prefix)
                prefix_key = F.when(hit, key).otherwise(prefix_key)
                prefix_rank = F.when(hit, rank).otherwise(prefix_rank)
                prefix_division = F.when(hit, division_rank).otherwise(prefix_division)
    by_name = F.col("account_key").isNotNull()
    matched = exact.select(
        *[c for c in exact.columns if c not in ("account_key", "alias_rank", "division_rank")],
        F.when(by_name, 0).otherwise(1).alias("match_kind"),
        F.coalesce("account_key", prefix_key).alias("account_key"),
        F.coalesce("alias_rank", prefix_rank).alias("alias_rank"),
        F.coalesce("division_rank", prefix_division).alias("division_rank"),
    )
    order = [
        F.col("division_rank").asc(),
        F.col("match_kind").asc(),
        F.col("alias_rank").asc(),
        has_text("account_detail").asc(),
        F.coalesce("ord", F.lit(0)).asc(),
        F.coalesce("account_id", F.lit("")).asc(),
        *scan_order(),
    ]
    return pick_first(matched, [*FILING, "account_key"], order)


def account_columns(picked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Wide form: ``<key>`` and ``<key>_prev`` per filing."""
    sums = []
    for key in keys:
        mine = F.col("account_key") == key
        sums.append(F.max(F.when(mine, F.col("thstrm_amount"))).alias(key))
        sums.append(F.max(F.when(mine, F.col("frmtrm_amount"))).alias(f"{key}_prev"))
    return picked.groupBy(*FILING).agg(*sums)


def _balance(key: str) -> Column:
    return average(F.col(key), F.col(f"{key}_prev"))


def _ratio(code: str, names: Mapping[str, str], value: Column, numerator: Column, denominator: Column) -> Column:
    return F.struct(
        F.lit(code).alias("ratio_code"),
        F.lit(names[code]).alias("ratio_name"),
        value.alias("ratio_value"),
        numerator.cast("double").alias("numerator_value"),
        denominator.cast("double").alias("denominator_value"),
    )


def general_ratios(statements: DataFrame, version: str = dims.GENERAL_VERSION) -> DataFrame:
    """Thirteen ratios per filing in long form; a ratio that cannot be computed is null, not missing."""
    wide = account_columns(select_general_accounts(statements), list(dims.GENERAL_ALIASES))
    c = F.col

    def percent(code, numerator, denominator):
        return _ratio(code, dims.GENERAL_RATIO_NAMES, percentage(numerator, denominator), numerator, denominator)

    rows = [
        percent("OPERATING_MARGIN", c("operating_profit"), c("revenue")),
        percent("NET_PROFIT_MARGIN", c("net_income"), c("revenue")),
        percent("ROA", c("net_income"), _balance("total_assets")),
        percent("ROE", c("net_income"), _balance("total_equity")),
        percent("DEBT_RATIO", c("total_liabilities"), c("total_equity")),
        percent("CURRENT_RATIO", c("current_assets"), c("current_liabilities")),
    ]
    spans = {}
    for turnover_code, days_code, flow, stock in (
        ("INVENTORY_TURNOVER", "DIO", "cost_of_sales", "inventory"),
        ("RECEIVABLE_TURNOVER", "DSO", "revenue", "receivables"),
        ("PAYABLE_TURNOVER", "DPO", "cost_of_sales", "payables"),
    ):
        turned = turnover(c(flow), _balance(stock))
        spans[days_code] = days(turned)
        rows.append(_ratio(turnover_code, dims.GENERAL_RATIO_NAMES, turned, c(flow), _balance(stock)))
        rows.append(_ratio(days_code, dims.GENERAL_RATIO_NAMES, spans[days_code], _balance(stock), c(flow)))
    nothing = F.lit(None)
    cycle = spans["DIO"] + spans["DSO"] - spans["DPO"]
    rows.append(_ratio("CCC", dims.GENERAL_RATIO_NAMES, cycle, nothing, nothing))
    return wide.select(*FILING, F.inline(F.array(*rows))).withColumn("calculation_version", F.lit(version))


def bank_ratios(statements: DataFrame, version: str = dims.BANK_VERSION) -> DataFrame:
    """Eight ratios per filing for banks and financial groups."""
    wide = account_columns(select_bank_accounts(statements), list(dims.BANK_KEYS_USED))
    c = F.col
    specs = {
        "BANK_ROA": (c("net_income"), _balance("total_assets")),
        "BANK_ROE": (c("net_income"), _balance("total_equity")),
        "BANK_NET_INTEREST_ASSET_RATIO": (c("net_interest_income"), _balance("total_assets")),
        "BANK_NET_FEE_ASSET_RATIO": (c("net_fee_income"), _balance("total_assets")),
        "BANK_LOAN_ASSET_RATIO": (c("loans"), c("total_assets")),
        "BANK_DEPOSIT_LIABILITY_RATIO": (c("deposits"), c("total_liabilities")),
        "BANK_BORROWING_LIABILITY_RATIO": (c("borrowings"), c("total_liabilities")),
        "BANK_CREDIT_COST_RATIO": (c("credit_loss"), _balance("loans")),
    }
    rows = [_ratio(code, dims.BANK_RATIO_NAMES, percentage(n, d), n, d) for code, (n, d) in specs.items()]
    return wide.select(*FILING, F.inline(F.array(*rows))).withColumn("calculation_version", F.lit(version))


def completeness(ratios: DataFrame, keys: Sequence[str] = FILING) -> DataFrame:
    """How many ratios of a filing have a value, and which ones have not."""
    missing = F.array_sort(F.collect_set(F.when(F.col("ratio_value").isNull(), F.col("ratio_code"))))
    return ratios.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("ratio_count"),
        F.count("ratio_value").alias("available_count"),
        F.array_join(missing, ",").alias("missing_codes"),
    )
