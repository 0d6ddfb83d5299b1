"""Queries over statements: scans, ratios, changes, screens, earnings per share, tax."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import dims, star
from ledgerloom.catalog import support as q
from ledgerloom.functions import amounts, formats, text
from ledgerloom.operators import changes, earnings, ratios, search
from ledgerloom.operators.select import pick_first, with_once


def statements_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search.statement_view(star.statements(spark, sf_dir), fs_div="CFS", reprt_code="11011")
    rows = rows.filter(F.col("sj_div").isin(*dims.DEFAULT_CHANGE_STATEMENTS))
    return search.with_statement_name(rows).select(
        "id", "rcept_no", "bsns_year", "corp_code", "sj_div", "statement_name", "account_id", "account_nm",
        "account_detail", "thstrm_amount", "frmtrm_amount", "ord",
    )


STATEMENTS_SCAN = q.STATEMENTS + f"""
select id, rcept_no, bsns_year, corp_code, sj_div, n.statement_name, account_id, account_nm, account_detail,
  thstrm_amount, frmtrm_amount, ord
from stmt left join {q.values(list(dims.STATEMENT_NAMES.items()), "sj_div, statement_name")} n using (sj_div)
where fs_div = 'CFS' and reprt_code = '11011' and sj_div in ('BS', 'IS', 'CIS', 'CF')"""


def amount_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals written the way filings write amounts, then read back."""
    key, whole = F.col("o_orderkey"), F.floor("o_totalprice").cast("bigint")
    grouped = F.format_number(whole, 0)
    raw = (
        F.when(key % 8 == 0, F.concat(F.lit("("), grouped, F.lit(")")))
        .when(key % 8 == 1, F.concat(F.lit(" -"), grouped))
        .when(key % 8 == 2, F.lit("－"))
        .when(key % 8 == 3, F.lit(" - "))
        .when(key % 8 == 4, F.lit("금액없음"))
        .when(key % 8 == 5, F.concat(whole.cast("string"), F.lit(".5")))
        .when(key % 8 == 6, F.lit("  "))
        .otherwise(F.concat(F.lit("　"), grouped))
    )
    rows = star.table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"))
    return rows.select(
        "o_orderkey",
        amounts.parse_amount("raw").alias("amount"),
        amounts.amount_is_bad("raw").alias("is_bad"),
        amounts.parse_decimal("raw").cast("double").alias("decimal_amount"),
        amounts.parse_decimal("raw", parentheses=False).cast("double").alias("tolerant_amount"),
    )


AMOUNT_PARSE = r"""
with raw as (
  select o_orderkey, o_orderkey % 8 as k, floor(o_totalprice)::bigint as v from orders)
select o_orderkey,
  case when k in (0, 1) then -v when k = 7 then v end as amount,
  k in (4, 5) as is_bad,
  (case when k in (0, 1) then -v when k = 7 then v when k = 5 then v + 0.5 end)::double as decimal_amount,
  (case when k = 1 then -v when k = 7 then v when k = 5 then v + 0.5 end)::double as tolerant_amount
from raw"""


def label_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with outline marks in front, through all name rules."""
    key = F.col("p_partkey")
    marks = ["IV. ", "Ⅱ) ", "12. ", "(3) ", "④ ", "나. ", "", "(가) "]
    mark = F.element_at(F.array(*[F.lit(m) for m in marks]), (key % len(marks) + 1).cast("int"))
    name = F.concat(mark, F.col("p_name"), F.when(key % 3 == 0, " (손실)").when(key % 3 == 1, " (원)").otherwise(""))
    rows = star.table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))
    return rows.select(
        "p_partkey",
        text.account_label("name").alias("label"),
        text.squeeze("name").alias("squeezed"),
        text.label_without_loss_mark("name").alias("no_loss_mark"),
        text.label_without_currency_mark("name").alias("no_currency_mark"),
        text.clean_text(F.when(key % 7 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("name")))).alias("cleaned"),
        text.corp_key("p_partkey").alias("padded"),
        text.safe_file_name(F.concat(F.col("name"), F.lit("?/*"))).alias("file_name"),
    )


LABEL_NORMALISE = rf"""
with n as (
  select p_partkey, ['IV. ', 'Ⅱ) ', '12. ', '(3) ', '④ ', '나. ', '', '(가) '][(p_partkey % 8 + 1)::int] || p_name ||
    case p_partkey % 3 when 0 then ' (손실)' when 1 then ' (원)' else '' end as name
  from part)
select p_partkey, {q.label_sql("name")} as label, replace(name, ' ', '') as squeezed,
  replace(replace(name, ' ', ''), '(손실)', '') as no_loss_mark, replace(replace(name, ' ', ''), '(원)', '') as no_currency_mark,
  case when p_partkey % 7 = 0 then null else trim(name) end as cleaned,
  lpad(p_partkey::varchar, greatest(8, length(p_partkey::varchar))::int, '0') as padded,
  name || '___' as file_name
from n"""


def scope_priority_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receivable rows of each filing: the current one, and the non-current one."""
    rows = star.statements(spark, sf_dir).filter(text.account_label("account_nm").contains("매출채권"))
    parts = []
    for prefer in (True, False):
        order = [
            text.scope_rank("account_id", "account_nm", "account_detail", prefer).asc(),
            text.has_text("account_detail").asc(),
            F.col("id").asc(),
        ]
        parts.append(pick_first(rows, ratios.FILING, order).withColumn("prefer_current", F.lit(prefer)))
    return parts[0].unionByName(parts[1]).select(
        *ratios.FILING, "prefer_current", "account_id", "account_nm", "thstrm_amount"
    )


SCOPE_PRIORITY_PICK = q.STATEMENTS + f""",
r as (select *, {q.scope_sql()} as sc from stmt where account_nm in ('매출채권', '단기매출채권')),
picked as (
  select *, true as prefer_current from r qualify row_number() over (partition by {q.FILING} order by sc, id) = 1
  union all
  select *, false from r qualify row_number() over (partition by {q.FILING} order by 2 - sc, id) = 1)
select {q.FILING}, prefer_current, account_id, account_nm, thstrm_amount from picked"""


def general_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratios.general_ratios(star.statements(spark, sf_dir))


GENERAL_RATIOS = (
    q.STATEMENTS + q.general_ratio_ctes() + f" select *, '{dims.GENERAL_VERSION}' as calculation_version from ratio"
)


def bank_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratios.bank_ratios(star.statements(spark, sf_dir))


BANK_RATIOS = q.STATEMENTS + q.bank_ratio_ctes() + f" select *, '{dims.BANK_VERSION}' as calculation_version from bratio"


def completeness_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratios.completeness(ratios.general_ratios(star.statements(spark, sf_dir)))


COMPLETENESS_REPORT = q.STATEMENTS + q.general_ratio_ctes() + f"""
select {q.FILING}, count(*) as ratio_count, count(ratio_value) as available_count,
  coalesce(string_agg(case when ratio_value is null then ratio_code end, ',' order by ratio_code), '') as missing_codes
from ratio group by {q.FILING}"""


def exact_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of 35 digits before and 25 after the point, with outer zeros and exponents, read exactly and written again."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    whole = F.concat(F.lpad(key.cast("string"), 15, "7"), F.lpad(cust.cast("string"), 20, "3"))
    places = F.concat(F.lpad(key.cast("string"), 20, "0"), F.lpad((cust % 100 * 100).cast("string"), 5, "0"))
    raw = (
        F.when(key % 4 == 0, F.concat(F.lit("-"), whole, F.lit("."), places)).when(key % 4 == 1, F.concat(F.lit(" +000"), whole, F.lit(".")))
        .when(key % 4 == 2, F.concat(F.lit("."), places, F.lit("e+3"))).otherwise(F.concat(key.cast("string"), F.lit("x")))
    )
    number = with_once(star.table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw")), "n", amounts.exact_number("raw"))
    return number.select(
        "o_orderkey", "n.digits", "n.scale", amounts.plain_number(F.col("n")).alias("plain"),
        (F.col("n.sort_key") < amounts.exact_number(F.lit("0.5"))["sort_key"]).alias("below_half"),
    )


EXACT_AMOUNTS = """
with w as (
  select o_orderkey, o_orderkey % 4 as k, lpad(o_orderkey::varchar, 15, '7') || lpad(o_custkey::varchar, 20, '3') as whole,
    lpad(o_orderkey::varchar, 20, '0') || lpad((o_custkey % 100 * 100)::varchar, 5, '0') as places from orders),
d as (
  select *, rtrim(places, '0') as p, rtrim(whole, '0') as wz, substr(places, 1, 3) as front, rtrim(substr(places, 4), '0') as back from w)
select o_orderkey, case k when 0 then ltrim(rtrim(whole || p, '0'), '0') when 1 then wz when 2 then ltrim(rtrim(places, '0'), '0') end as digits,
  (case k when 0 then length(p) when 1 then length(wz) - 35 when 2 then length(p) - 3 end)::int as scale,
  case k when 0 then '-' || whole || '.' || p when 1 then whole when 2 then '0.' || back end as plain,
  case k when 0 then true when 1 then false when 2 then true end as below_half
from d"""


def account_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.account_changes(star.statements(spark, sf_dir))


ACCOUNT_CHANGES = q.STATEMENTS + q.CHANGES + " select * from chg"


def combined_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changes.combined_changes(changes.account_changes(star.statements(spark, sf_dir)))
    return rows.withColumn("statement_position", F.col("statement_position").cast("bigint"))


COMBINED_CHANGES = q.STATEMENTS + q.CHANGES + f"""
select *, case sj_div when 'BS' then 1 when 'IS' then 2 else 3 end::bigint as statement_position
from chg where sj_div in ('BS', 'IS', 'CIS')
qualify row_number() over (partition by {q.FILING}, sj_div, account_id, account_nm order by {q.CHANGE_SCAN}) = 1"""


def major_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changes.major_changes(changes.account_changes(star.statements(spark, sf_dir)))
    return rows.select(
        *ratios.FILING, "sj_div", "account_nm", "financial_statement_id", "change_amount", "change_rate",
        "statement_position", "account_position",
    )


_MAJOR = [
    (division, "".join(name.split()), s, a)
    for s, (division, names) in enumerate(dims.MAJOR_ACCOUNTS.items(), 1)
    for a, name in enumerate(names, 1)
]
MAJOR_CHANGES = q.STATEMENTS + q.CHANGES + f"""
select {q.FILING}, sj_div, account_nm, financial_statement_id, change_amount, change_rate,
  m.statement_position::int as statement_position, m.account_position::int as account_position
from chg join {q.values(_MAJOR, "sj_div, name, statement_position, account_position")} m using (sj_div)
where regexp_replace(account_nm, '\\s+', '', 'g') = m.name"""


def significant_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changes.significant_moves(changes.account_changes(star.statements(spark, sf_dir)))
    return rows.select(
        *ratios.FILING, "sj_div", "account_nm", "financial_statement_id", "major_account_nm", "change_rate", "direction",
        "message",
    )


_RULES = [
    (alias.replace(" ", ""), major, message)
    for major, (aliases, message) in dims.SCREENING_RULES.items()
    for alias in dict.fromkeys(a.replace(" ", "") for a in aliases)
]
SIGNIFICANT_MOVES = q.STATEMENTS + q.CHANGES + f"""
select {q.FILING}, sj_div, account_nm, financial_statement_id, r.major_account_nm, change_rate,
  case when change_rate > 0 then '증가' else '감소' end as direction, r.message
from chg join {q.values(_RULES, "label, major_account_nm, message")} r on replace(account_nm, ' ', '') = r.label
where abs(change_rate) >= 20.0"""


def divergence_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.divergence(changes.account_changes(star.statements(spark, sf_dir)))


DIVERGENCE_SCREEN = q.STATEMENTS + q.CHANGES + f""",
sided as (
  select *, case when replace(replace(account_nm, ' ', ''), '(손실)', '') in ('매출액', '수익(매출액)', '영업수익') then 'b'
    when replace(replace(account_nm, ' ', ''), '(손실)', '') = '재고자산' then 't' end as side
  from chg where sj_div in ('BS', 'IS', 'CIS')),
first as (
  select * from sided where side is not null
  qualify row_number() over (partition by {q.FILING}, side
    order by case sj_div when 'BS' then 1 when 'IS' then 2 else 3 end, {q.CHANGE_SCAN}) = 1),
rates as (
  select {q.FILING}, max(case when side = 'b' then change_rate end) as base_rate,
    max(case when side = 't' then change_rate end) as target_rate from first group by {q.FILING})
select *, target_rate - base_rate as difference from rates where target_rate - base_rate >= 10.0"""


def eps_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return earnings.eps(star.statements(spark, sf_dir))


EPS_PICK = q.STATEMENTS + f""",
named as (
  select *, replace(replace(account_nm, ' ', ''), '(원)', '') as label from stmt),
scored as (
  select *, 'basic' as kind,
    case when account_id in ('ifrs-full_BasicEarningsLossPerShare', 'dart_BasicEarningsLossPerShare') then 100
      when account_id like '%BasicEarningsLossPerShare' then 80 else 0 end +
    case when label in ('기본주당이익', '기본주당순이익', '기본주당손익', '주당이익', '주당순이익') then 60
      when label like '%주당이익%' or label like '%주당순이익%' or label like '%기본주당손익%' then 40 else 0 end as hit,
    label not like '%희석%' as allowed
  from named
  union all
  select *, 'diluted',
    case when account_id in ('ifrs-full_DilutedEarningsLossPerShare', 'dart_DilutedEarningsLossPerShare') then 100
      when account_id like '%DilutedEarningsLossPerShare' then 80 else 0 end +
    case when label in ('희석주당이익', '희석주당순이익', '희석주당손익') then 60
      when label like '%희석주당이익%' or label like '%희석주당순이익%' or label like '%희석주당손익%' then 40 else 0 end,
    null
  from named),
ranked as (
  select *, hit + case when sj_div in ('IS', 'CIS') then 10 else 0 end + case when thstrm_amount is not null then 5 else 0 end as score
  from scored where hit >= 40 and coalesce(allowed, label like '%희석%' or hit >= 80)
  qualify row_number() over (partition by {q.FILING}, kind order by score desc, rcept_no desc, {q.SCAN}) = 1),
w as (
  select f.*, b.thstrm_amount as basic_eps, b.frmtrm_amount as previous_basic_eps, d.thstrm_amount as diluted_eps,
    d.frmtrm_amount as previous_diluted_eps, case when b.id is not null or d.id is not null then 'KRW' end as currency
  from (select distinct {q.FILING} from stmt) f
  left join (from ranked where kind = 'basic') b using ({q.FILING})
  left join (from ranked where kind = 'diluted') d using ({q.FILING}))
select {q.FILING}, basic_eps, previous_basic_eps,
  ((basic_eps - previous_basic_eps)::double / nullif(abs(previous_basic_eps), 0)::double) * 100.0 as basic_eps_change_rate,
  diluted_eps, previous_diluted_eps,
  ((diluted_eps - previous_diluted_eps)::double / nullif(abs(previous_diluted_eps), 0)::double) * 100.0 as diluted_eps_change_rate,
  currency from w"""


def effective_tax_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return earnings.effective_tax_rate(star.statements(spark, sf_dir))


_TAX = ", ".join(f"'{n}'" for n in dims.TAX_EXPENSE_NAMES)
_PRETAX = ", ".join(f"'{n}'" for n in dims.PRETAX_PROFIT_NAMES)
_REVERSED = "bsns_year, rcept_no, fs_div desc, sj_div desc, ord desc nulls last, id desc"
EFFECTIVE_TAX_RATE = q.STATEMENTS + f""",
t as (select * from stmt where account_nm in ({_TAX}) qualify row_number() over (partition by {q.FILING} order by {_REVERSED}) = 1),
p as (select * from stmt where account_nm in ({_PRETAX}) qualify row_number() over (partition by {q.FILING} order by {_REVERSED}) = 1),
w as (
  select f.*, t.thstrm_amount as tax_expense, p.thstrm_amount as profit_before_tax
  from (select distinct {q.FILING} from stmt) f left join t using ({q.FILING}) left join p using ({q.FILING}))
select *, case when tax_expense is not null and profit_before_tax > 0
    then tax_expense::double / profit_before_tax::double * 100.0 end as effective_tax_rate,
  case when tax_expense is null then 'no_tax_expense' when profit_before_tax is null then 'no_pretax_profit'
    when profit_before_tax <= 0 then 'no_profit' else 'ok' end as status
from w"""


def tax_movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return earnings.tax_movements(star.statements(spark, sf_dir)).select(
        *ratios.FILING, "financial_statement_id", "account_nm", "tax_account_code", "tax_account_name", "current_amount",
        "previous_amount", "change_amount", "change_rate", "sort_amount",
    )


_TAX_GROUPS = [(n, code, label) for code, (label, names) in dims.TAX_ACCOUNT_GROUPS.items() for n in names]
TAX_MOVEMENTS = q.STATEMENTS + q.CHANGES + f"""
select {q.FILING}, financial_statement_id, account_nm, tax_account_code, tax_account_name, current_amount,
  previous_amount, change_amount, change_rate, abs(coalesce(current_amount, 0) - coalesce(previous_amount, 0)) as sort_amount
from chg join {q.values(_TAX_GROUPS, "n, tax_account_code, tax_account_name")} g on trim(account_nm) = g.n
where sj_div = 'BS'"""


def report_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios and changes as report text."""
    rows = changes.account_changes(star.statements(spark, sf_dir))
    return rows.select(
        "financial_statement_id",
        formats.amount_text("current_amount").alias("amount_text"),
        formats.signed_amount_text("change_amount").alias("change_text"),
        formats.dashed_date(F.substring("rcept_no", 1, 8)).alias("date_text"),
        formats.resolve_alias(F.when(F.col("fs_div") == "CFS", " 연결 ").otherwise("OFS"), formats.SCOPE_ALIASES).alias("scope"),
        formats.resolve_alias(F.lit("Annual"), formats.REPORT_ALIASES).alias("report"),
        F.when(F.col("change_rate").isNull(), formats.signed_rate_text("change_rate"))
        .otherwise(formats.signed_rate_text(F.floor(F.col("change_rate")).cast("double"))).alias("rate_text"),
        formats.ratio_text(F.floor("change_rate").cast("double"), F.element_at(
            F.array(F.lit("percentage"), F.lit("turnover"), F.lit("days")), (F.col("financial_statement_id") % 3 + 1).cast("int")
        )).alias("ratio_text"),
    )


REPORT_FORMAT = q.STATEMENTS + q.CHANGES + """
select financial_statement_id, coalesce(format('{:,}', current_amount), '-') as amount_text,
  case when change_amount is null then '-' when change_amount < 0 then format('{:,}', change_amount)
    else '+' || format('{:,}', change_amount) end as change_text,
  rcept_no[1:4] || '-' || rcept_no[5:6] || '-' || rcept_no[7:8] as date_text, fs_div as scope, '11011' as report,
  case when change_rate is null then '-' else printf('%+.2f%%', floor(change_rate)) end as rate_text,
  case when change_rate is null then '-' when financial_statement_id % 3 = 0 then format('{:,}', floor(change_rate)::bigint) || '.00%'
    when financial_statement_id % 3 = 1 then printf('%.2f회', floor(change_rate)) else printf('%.2f일', floor(change_rate)) end as ratio_text
from chg"""

QUERIES = {
    "statements_scan": (statements_scan, STATEMENTS_SCAN),
    "amount_parse": (amount_parse, AMOUNT_PARSE),
    "label_normalise": (label_normalise, LABEL_NORMALISE),
    "scope_priority_pick": (scope_priority_pick, SCOPE_PRIORITY_PICK),
    "general_ratios": (general_ratios, GENERAL_RATIOS),
    "bank_ratios": (bank_ratios, BANK_RATIOS),
    "completeness_report": (completeness_report, COMPLETENESS_REPORT),
    "exact_amounts": (exact_amounts, EXACT_AMOUNTS),
    "account_changes": (account_changes, ACCOUNT_CHANGES),
    "combined_changes": (combined_changes, COMBINED_CHANGES),
    "major_changes": (major_changes, MAJOR_CHANGES),
    "significant_moves": (significant_moves, SIGNIFICANT_MOVES),
    "divergence_screen": (divergence_screen, DIVERGENCE_SCREEN),
    "eps_pick": (eps_pick, EPS_PICK),
    "effective_tax_rate": (effective_tax_rate, EFFECTIVE_TAX_RATE),
    "tax_movements": (tax_movements, TAX_MOVEMENTS),
    "report_format": (report_format, REPORT_FORMAT),
}
