"""Shared pieces of the query catalogue: table CTEs and constant tables for the SQL oracles."""

from __future__ import annotations

from collections.abc import Sequence

from ledgerloom import dims, star

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

STATEMENTS = star.statements_sql()


def values(rows: Sequence[tuple], columns: str) -> str:
    def literal(v):
        if v is None or isinstance(v, bool):
            return {None: "null", True: "true", False: "false"}[v]
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return f"(select * from (values {body}) as t({columns}))"


def label_sql(column: str) -> str:
    """Account label: one leading outline mark and all white space removed."""
    marks = (
        r"[IVXLCDM]+[.)]|[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩⅪⅫ]+[.)]|\d+[.)]|\(\d+\)|[①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳]|[가-하][.)]"
    )
    return rf"regexp_replace(regexp_replace(trim({column}), '^\s*(?:{marks})\s*', ''), '\s+', '', 'g')"


def scope_sql(prefix: str = "") -> str:
    text = f"replace(lower(concat_ws(' ', {prefix}account_id, {prefix}account_nm, {prefix}account_detail)), '_', ' ')"
    return (
        f"case when {text} like '%noncurrent%' or {text} like '%non-current%' or {text} like '%비유동%'"
        f" or {text} like '%장기%' then 2 when {text} like '%current%' or {text} like '%유동%' or {text} like '%단기%'"
        " then 0 else 1 end"
    )


SCAN = "bsns_year desc, rcept_no desc, fs_div, sj_div, ord nulls first, id"
FILING = "corp_code, bsns_year, reprt_code, fs_div"


def alias_values(aliases: dict, divisions: dict, repeat_wins: str = "last") -> str:
    rows = []
    for key, names in aliases.items():
        seen = {}
        for i, name in enumerate(names):
            label = "".join(name.split())
            if repeat_wins == "last" or label not in seen:
                seen[label] = i
        rows += [(key, label, i, d, di) for label, i in seen.items() for di, d in enumerate(divisions[key])]
    return values(rows, "account_key, alias_label, alias_rank, sj_div, division_rank")


def pct(n: str, d: str) -> str:
    return f"(({n})::double / nullif(({d})::double, 0)) * 100.0"


def avg(key: str) -> str:
    return f"(({key}::double + {key}_prev::double) / 2.0)"


def wide_sql(source: str, keys: Sequence[str]) -> str:
    columns = ", ".join(
        f"max(case when account_key = '{k}' then thstrm_amount end) as {k}, "
        f"max(case when account_key = '{k}' then frmtrm_amount end) as {k}_prev"
        for k in keys
    )
    return f"select {FILING}, {columns} from {source} group by {FILING}"


def general_ratio_ctes() -> str:
    """``ratio``: the thirteen ratios, from the ``stmt`` CTE."""
    turn = {
        "INVENTORY_TURNOVER": ("cost_of_sales", "inventory", "DIO"),
        "RECEIVABLE_TURNOVER": ("revenue", "receivables", "DSO"),
        "PAYABLE_TURNOVER": ("cost_of_sales", "payables", "DPO"),
    }
    percents = {
        "OPERATING_MARGIN": ("operating_profit", "revenue"),
        "NET_PROFIT_MARGIN": ("net_income", "revenue"),
        "ROA": ("net_income", avg("total_assets")),
        "ROE": ("net_income", avg("total_equity")),
        "DEBT_RATIO": ("total_liabilities", "total_equity"),
        "CURRENT_RATIO": ("current_assets", "current_liabilities"),
    }
    parts, day = [], {}
    for code, (n, d) in percents.items():
        parts.append((code, pct(n, d), n, d))
    for code, (flow, stock, span) in turn.items():
        value = f"({flow}::double / nullif({avg(stock)}, 0))"
        day[span] = f"(365.0::double / nullif({value}, 0))"
        parts += [(code, value, flow, avg(stock)), (span, day[span], avg(stock), flow)]
    parts.append(("CCC", f"{day['DIO']} + {day['DSO']} - {day['DPO']}", "null", "null"))
    selects = " union all ".join(
        f"select {FILING}, '{code}' as ratio_code, '{dims.GENERAL_RATIO_NAMES[code]}' as ratio_name, "
        f"({value})::double as ratio_value, ({n})::double as numerator_value, ({d})::double as denominator_value from gwide"
        for code, value, n, d in parts
    )
    return f""",
galias as {alias_values(dims.GENERAL_ALIASES, dims.GENERAL_STATEMENTS)},
gpick as (
  select s.*, a.account_key from stmt s left join galias a on a.alias_label = {label_sql("s.account_nm")} and a.sj_div = s.sj_div
  qualify row_number() over (partition by {FILING}, a.account_key order by a.division_rank, {scope_sql("s.")}, a.alias_rank,
    trim(s.account_detail) <> '', s.account_id, {SCAN.replace("sj_div", "s.sj_div")}) = 1),
gwide as materialized ({wide_sql("gpick", list(dims.GENERAL_ALIASES))}),
ratio as ({selects})"""


def bank_ratio_ctes() -> str:
    """``bratio``: the eight bank ratios."""
    aliases = {k: dims.BANK_ALIASES[k] for k in dims.BANK_KEYS_USED}
    specs = {
        "BANK_ROA": ("net_income", avg("total_assets")),
        "BANK_ROE": ("net_income", avg("total_equity")),
        "BANK_NET_INTEREST_ASSET_RATIO": ("net_interest_income", avg("total_assets")),
        "BANK_NET_FEE_ASSET_RATIO": ("net_fee_income", avg("total_assets")),
        "BANK_LOAN_ASSET_RATIO": ("loans", "total_assets"),
        "BANK_DEPOSIT_LIABILITY_RATIO": ("deposits", "total_liabilities"),
        "BANK_BORROWING_LIABILITY_RATIO": ("borrowings", "total_liabilities"),
        "BANK_CREDIT_COST_RATIO": ("credit_loss", avg("loans")),
    }
    selects = " union all ".join(
        f"select {FILING}, '{code}' as ratio_code, '{dims.BANK_RATIO_NAMES[code]}' as ratio_name, "
        f"({pct(n, d)})::double as ratio_value, ({n})::double as numerator_value, ({d})::double as denominator_value from bwide"
        for code, (n, d) in specs.items()
    )
    return f""",
balias as {alias_values(aliases, dims.BANK_STATEMENTS, "first")},
bcand as (
  select s.*, a.account_key, 0 as match_kind, a.alias_rank, a.division_rank
  from stmt s join balias a on a.alias_label = {label_sql("s.account_nm")} and a.sj_div = s.sj_div
  union all
  select s.*, 'loans', 1, 0, 0 from stmt s
  where s.sj_div = 'BS' and starts_with({label_sql("s.account_nm")}, '상각후원가측정대출채권및기타')
    and not exists (select 1 from balias a where a.alias_label = {label_sql("s.account_nm")} and a.account_key = 'loans')
  union all
  select s.*, null, 1, null, null from stmt s),
bpick as (
  select * from bcand
  qualify row_number() over (partition by {FILING}, account_key order by division_rank, match_kind, alias_rank,
    trim(account_detail) <> '', coalesce(ord, 0), account_id, {SCAN}) = 1),
bwide as materialized ({wide_sql("bpick", dims.BANK_KEYS_USED)}),
bratio as ({selects})"""


CHANGES = """,
chg as materialized (
  select id as financial_statement_id, corp_code, bsns_year, reprt_code, fs_div, rcept_no, fs_nm, sj_div, account_id, account_nm,
    account_detail, ord, thstrm_nm as current_term_name, frmtrm_nm as previous_term_name, thstrm_amount as current_amount,
    frmtrm_amount as previous_amount, thstrm_amount - frmtrm_amount as change_amount,
    ((thstrm_amount - frmtrm_amount)::double / nullif(abs(frmtrm_amount)::double, 0)) * 100.0 as change_rate
  from stmt)"""
CHANGE_SCAN = "bsns_year desc, rcept_no desc, fs_div, sj_div, ord nulls first, financial_statement_id"
