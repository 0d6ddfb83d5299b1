"""Filings derived from the star-schema tables, so that every operator runs on the given data.

A supplier is a corporation and a ship year a business year. Amounts are whole numbers computed per
line item, so sums do not depend on the order of rows. ``ACCOUNTS`` lists the statement lines; names,
duplicates and gaps vary with the supplier key to exercise account selection.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import padded_number

MEASURES = ("rev", "cost", "tax", "inv", "recv", "pay")
FILING = ["corp_code", "bsns_year", "reprt_code", "fs_div"]
REPORT_CODE = "11011"


@dataclass(frozen=True)
class Account:
    """One statement line. Text fields are SQL; ``{m}`` is the period prefix, ``s`` the supplier key."""

    sj_div: str
    account_id: str
    name: str
    amount: str
    when: str = "true"
    detail: str = ""
    late: bool = False


_ASSETS = "({m}recv + {m}inv + {m}rev DIV 4 + {m}cost + {m}tax DIV 3 + {m}tax DIV 5)"
_DEBTS = "({m}pay + {m}tax DIV 2 + {m}tax DIV 6 + {m}rev DIV 5)"

ACCOUNTS = (
    Account("IS", "ifrs-full_Revenue",
            "case when s % 5 = 0 then 'I. 매출액' when s % 5 = 1 then '영업수익' when s % 5 = 2 then '매 출 액' else '매출액' end",
            "{m}rev"),
    Account("IS", "ifrs-full_Revenue", "'매출액'", "{m}rev DIV 2", "s % 4 = 0", "부문 A"),
    Account("IS", "ifrs-full_CostOfSales", "'매출원가'", "{m}cost"),
    Account("IS", "dart_OperatingIncomeLoss",
            "case when s % 3 = 0 then '영업이익(손실)' when s % 3 = 1 then '영업 이익' else 'Ⅲ. 영업이익' end",
            "{m}rev - {m}cost"),
    Account("IS", "ifrs-full_ProfitLossBeforeTax", "'법인세비용차감전순이익'",
            "case when s % 13 = 5 then {m}tax - {m}rev else {m}rev - {m}cost end"),
    Account("IS", "ifrs-full_IncomeTaxExpense", "case when s % 2 = 0 then '법인세비용' else '법인세비용(수익)' end", "{m}tax",
            "s % 17 <> 3"),
    Account("IS", "ifrs-full_ProfitLoss", "'당기순이익'", "{m}rev - {m}cost - {m}tax", "s % 6 <> 5"),
    Account("CIS", "ifrs-full_ProfitLoss", "'당기순이익(손실)'", "{m}rev - {m}cost - {m}tax - {m}rev DIV 50"),
    Account("IS", "ifrs-full_BasicEarningsLossPerShare", "'기본주당순이익(원)'", "{m}rev DIV 1000", "s % 5 <> 2"),
    Account("IS", "custom_DilutedPerShare", "'희석주당순이익'", "{m}rev DIV 1100", "s % 3 <> 1"),
    Account("BS", "ifrs-full_CashAndCashEquivalents", "'현금및현금성자산'", "{m}rev DIV 4"),
    Account("BS", "ifrs-full_CurrentTradeReceivables", "'매출채권'", "{m}recv"),
    Account("BS", "ifrs-full_NoncurrentTradeReceivables", "'매출채권'", "{m}recv DIV 7", "s % 3 = 0"),
    Account("BS", "dart_ShortTermTradeReceivable", "'단기매출채권'", "{m}recv DIV 3", "s % 4 = 1"),
    Account("BS", "ifrs-full_Inventories", "case when s % 3 = 0 then '재고자산' else '(1) 재고자산' end", "{m}inv", "s % 7 <> 6"),
    Account("BS", "ifrs-full_PropertyPlantAndEquipment", "'유형자산'", "{m}cost"),
    Account("BS", "-표준계정코드 미사용-", "'이연법인세자산'", "{m}tax DIV 3", detail="-"),
    Account("BS", "ifrs-full_CurrentTaxAssets", "case when s % 2 = 0 then '당기법인세자산' else ' 미수법인세 ' end", "{m}tax DIV 5"),
    Account("BS", "ifrs-full_CurrentAssets", "'유동자산'", "{m}recv + {m}inv + {m}rev DIV 4"),
    Account("BS", "ifrs-full_Assets", "'자산총계'", _ASSETS),
    Account("BS", "ifrs-full_TradeAndOtherCurrentPayables",
            "case when s % 4 = 3 then '매입채무 및 기타채무' else '매입채무' end", "{m}pay"),
    Account("BS", "ifrs-full_CurrentTaxLiabilities", "'당기법인세부채'", "{m}tax DIV 2"),
    Account("BS", "ifrs-full_DeferredTaxLiabilities", "'비유동이연법인세부채'", "{m}tax DIV 6"),
    Account("BS", "ifrs-full_CurrentLiabilities", "'유동부채'", "case when s % 19 = 7 then 0 else {m}pay + {m}tax DIV 2 end"),
    Account("BS", "ifrs-full_Liabilities", "'부채총계'", _DEBTS),
    Account("BS", "ifrs-full_Equity", "'자본총계'", f"{_ASSETS} - {_DEBTS}"),
    Account("BS", "dart_LoansAtAmortisedCost",
            "case when s % 4 = 0 then '상각후원가측정대출채권' when s % 4 = 1 then '상각후원가측정대출채권및기타금융자산'"
            " when s % 4 = 2 then '상각후원가측정대출채권및기타수취채권' else '상각후원가 측정 대출채권' end",
            "{m}cost DIV 2"),
    Account("BS", "dart_OtherLoans", "'상각후원가측정대출채권및기타자산'", "{m}cost DIV 3", "s % 3 = 2"),
    Account("BS", "dart_DepositLiabilities", "case when s % 2 = 0 then '예수부채' else '예수금' end", "{m}rev DIV 6"),
    Account("BS", "dart_Borrowings", "'차입부채'", "{m}rev DIV 9", "s % 5 <> 4"),
    Account("IS", "dart_NetInterest", "case when s % 3 = 0 then '순이자손익' else '순이자이익' end", "{m}rev DIV 8"),
    Account("IS", "dart_NetFees", "'순수수료이익'", "{m}rev DIV 20"),
    Account("CIS", "dart_CreditLoss", "'신용손실에 대한 손상차손'", "{m}tax DIV 4"),
    Account("CF", "ifrs-full_CashFlowsFromOperating", "'영업활동현금흐름'", "{m}rev - {m}cost"),
    Account("SCE", "ifrs-full_Equity", "'자본총계'", "{m}rev DIV 5", detail="자본금"),
    Account("BS", "ifrs-full_Inventories", "'유동재고자산'", "{m}inv DIV 2", "s % 14 = 6"),
    Account("IS", "ifrs-full_IncomeTaxExpense", "'법인세비용'", "{m}tax + 7", "s % 9 = 0", late=True),
    Account("IS", "ifrs-full_BasicEarningsLossPerShare", "'기본주당이익'", "{m}rev DIV 900", "s % 8 = 0", late=True),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corporations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry: every third supplier is unlisted."""
    key = F.col("s_suppkey").cast("string")
    return table(spark, sf_dir, "supplier").select(
        padded_key(F.col("s_suppkey")).alias("corp_code"),
        F.col("s_name").alias("corp_name"),
        F.when(F.col("s_suppkey") % 3 != 0, F.when(F.length(key) < 6, F.lpad(key, 6, "0")).otherwise(key)).alias(
            "stock_code"
        ),
        (F.col("s_suppkey") % 10 != 9).alias("is_active"),
        F.col("s_nationkey"),
        F.col("s_suppkey"),
    )


def padded_key(key: Column) -> Column:
    return padded_number(key, 8)


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (supplier, year, scope) with current (c_) and previous-year (p_) measures.

    A single partially aggregated shuffle of the line items; everything after it works on
    supplier-years.
    """
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    discount = F.round(F.col("l_discount") * 100).cast("bigint")
    tax = F.round(F.col("l_tax") * 100).cast("bigint")
    lines = (
        table(spark, sf_dir, "lineitem")
        .select(
            F.col("l_suppkey").alias("s"),
            F.year("l_shipdate").alias("y"),
            "l_returnflag",
            "l_linestatus",
            F.round("l_quantity").cast("bigint").alias("q"),
            cents.alias("cents"),
            discount.alias("disc"),
            tax.alias("taxpct"),
        )
        .withColumn("rev", F.expr("(cents * (100 - disc)) div 10000"))
        .withColumn("tax", F.expr("(cents * taxpct) div 10000"))
        .withColumn("cost", F.expr("(rev * (40 + q)) div 100"))
        .withColumn("inv", F.when(F.col("l_returnflag") == "A", F.col("cost")))
        .withColumn("recv", F.when(F.col("l_returnflag") == "N", F.col("rev")))
        .withColumn("pay", F.when(F.col("l_returnflag") == "R", F.col("cost")))
    )
    sums = [F.coalesce(F.sum(m), F.lit(0)).alias(f"all_{m}") for m in MEASURES]
    finals = [
        F.coalesce(F.sum(F.when(F.col("l_linestatus") == "F", F.col(m))), F.lit(0)).alias(f"f_{m}") for m in MEASURES
    ]
    yearly = lines.groupBy("s", "y").agg(*sums, *finals)
    scopes = yearly.select(
        "s",
        "y",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(scope).alias("fs_div"), *[F.col(f"{prefix}_{m}").alias(f"c_{m}") for m in MEASURES])
                    for scope, prefix in (("CFS", "all"), ("OFS", "f"))
                ]
            )
        ),
    )
    history = Window.partitionBy("s", "fs_div").orderBy("y")
    follows = F.lag("y").over(history) == F.col("y") - 1
    return scopes.select(
        "*", *[F.when(follows, F.lag(f"c_{m}").over(history)).alias(f"p_{m}") for m in MEASURES]
    )


def _spark_sql(text: str, prefix: str) -> str:
    return text.replace("{m}", prefix).replace("DIV", "div")


def _lines() -> str:
    """SQL for the array of statement lines of one filing."""
    structs = ", ".join(
        "named_struct("
        f"'keep', {a.when}, 'line', {number}, 'late', {str(a.late).lower()}, 'sj_div', '{a.sj_div}', "
        f"'account_id', '{a.account_id}', 'account_nm', {a.name}, 'account_detail', '{a.detail}', "
        f"'thstrm_amount', cast({_spark_sql(a.amount, 'c_')} as bigint), "
        f"'frmtrm_amount', cast({_spark_sql(a.amount, 'p_')} as bigint))"
        for number, a in enumerate(ACCOUNTS, start=1)
    )
    return f"filter(array({structs}), line -> line.keep)"


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored statement rows (long form) for all companies, years and scopes."""
    rows = measures(spark, sf_dir).select("s", "y", "fs_div", F.expr(f"inline({_lines()})"))
    corp = padded_key(F.col("s"))
    return rows.select(
        (
            F.col("s") * 100000
            + (F.col("y") - 1990) * 1000
            + F.when(F.col("fs_div") == "OFS", 500).otherwise(0)
            + F.col("line")
        ).alias("id"),
        F.concat((F.col("y") + 1).cast("string"), F.when(F.col("late"), "04").otherwise("03"), corp).alias("rcept_no"),
        F.lit(REPORT_CODE).alias("reprt_code"),
        F.col("y").cast("string").alias("bsns_year"),
        corp.alias("corp_code"),
        "fs_div",
        F.when(F.col("fs_div") == "CFS", "연결재무제표").otherwise("재무제표").alias("fs_nm"),
        "sj_div",
        "account_id",
        "account_nm",
        "account_detail",
        F.concat(F.lit("제"), (F.col("y") - 1990).cast("string"), F.lit("기")).alias("thstrm_nm"),
        F.concat(F.lit("제"), (F.col("y") - 1991).cast("string"), F.lit("기")).alias("frmtrm_nm"),
        "thstrm_amount",
        "frmtrm_amount",
        F.col("line").alias("ord"),
        F.lit("KRW").alias("currency"),
    )


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One delivered JSON answer per filing, with faults: no data, unreadable amounts, blank names."""
    s = F.col("s")

    def amount(value):
        grouped = F.format_number(F.abs(value), 0)
        negative = F.when(s % 2 == 0, F.concat(F.lit("("), grouped, F.lit(")"))).otherwise(F.concat(F.lit("-"), grouped))
        return F.when(value.isNull(), "").when(value < 0, negative).otherwise(grouped)

    def raw(line):
        month = F.when(line["late"], "04").otherwise("03")
        current = F.when((s % 11 == 3) & (line["line"] == 16), "금액없음").otherwise(amount(line["thstrm_amount"]))
        name = F.when((s % 12 == 5) & (line["line"] == 11), "  ").otherwise(line["account_nm"])
        return F.struct(
            F.concat((F.col("y") + 1).cast("string"), month, padded_key(s)).alias("rcept_no"),
            F.lit(REPORT_CODE).alias("reprt_code"),
            F.col("y").cast("string").alias("bsns_year"),
            padded_key(s).alias("corp_code"),
            line["sj_div"].alias("sj_div"),
            line["account_id"].alias("account_id"),
            name.alias("account_nm"),
            line["account_detail"].alias("account_detail"),
            current.alias("thstrm_amount"),
            amount(line["frmtrm_amount"]).alias("frmtrm_amount"),
            line["line"].cast("string").alias("ord"),
            F.lit("KRW").alias("currency"),
        )

    absent = s % 10 == 9
    answer = F.struct(
        F.when(absent, "013").otherwise("000").alias("status"),
        F.when(absent, "no data").otherwise("ok").alias("message"),
        F.when(~absent, F.transform(F.expr(_lines()), raw)).alias("list"),
    )
    return measures(spark, sf_dir).select(padded_key(s).alias("corp_code"), "fs_div", F.to_json(answer).alias("payload"))


def industries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Industry groups (regions) and memberships (suppliers by nation)."""
    groups = table(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("industry_id"),
        F.upper("r_name").alias("industry_code"),
        F.col("r_name").alias("industry_name"),
    )
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("industry_id"))
    members = (
        corporations(spark, sf_dir)
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select("industry_id", "corp_code")
    )
    return groups, members


def _duck(text: str, prefix: str) -> str:
    return text.replace("{m}", prefix).replace("DIV", "//")


def statements_sql() -> str:
    """The same derivation as CTEs for the SQL oracle: ``stmt``, ``corp``, ``grp``, ``member``."""
    sums = ", ".join(f"coalesce(sum({m}), 0)::bigint as c_{m}" for m in MEASURES)
    previous = ", ".join(f"p.c_{m} as p_{m}" for m in MEASURES)
    lines = " union all ".join(
        f"select id_base + {number} as id, rc || '{'04' if a.late else '03'}' || code as rcept_no, y, code, fs_div, "
        f"'{a.sj_div}' as sj_div, '{a.account_id}' as account_id, {a.name} as account_nm, '{a.detail}' as account_detail, "
        f"({_duck(a.amount, 'c_')})::bigint as thstrm_amount, ({_duck(a.amount, 'p_')})::bigint as frmtrm_amount, "
        f"{number} as ord from wide where {a.when}"
        for number, a in enumerate(ACCOUNTS, start=1)
    )
    return f"""
with line0 as (
  select l_suppkey as s, year(l_shipdate)::int as y, l_returnflag as rf, l_linestatus as ls,
    round(l_quantity)::bigint as q, round(l_extendedprice * 100)::bigint as cents,
    round(l_discount * 100)::bigint as disc, round(l_tax * 100)::bigint as taxpct
  from lineitem),
line1 as (select *, (cents * (100 - disc)) // 10000 as rev, (cents * taxpct) // 10000 as tax from line0),
line2 as (select *, (rev * (40 + q)) // 100 as cost from line1),
line3 as (select *, case when rf = 'A' then cost end as inv, case when rf = 'N' then rev end as recv,
    case when rf = 'R' then cost end as pay from line2),
scoped as (
  select s, y, 'CFS' as fs_div, {sums} from line3 group by s, y
  union all
  select s, y, 'OFS' as fs_div, {sums} from (
    select s, y, {", ".join(f"case when ls = 'F' then {m} end as {m}" for m in MEASURES)} from line3) group by s, y),
wide as materialized (
  select c.*, {previous}, lpad(c.s::varchar, greatest(8, length(c.s::varchar))::int, '0') as code,
    (c.y + 1)::varchar as rc, c.s * 100000 + (c.y - 1990) * 1000 + case when c.fs_div = 'OFS' then 500 else 0 end as id_base
  from scoped c left join scoped p on p.s = c.s and p.fs_div = c.fs_div and p.y = c.y - 1),
stmt as materialized (
  select id::bigint as id, rcept_no, '{REPORT_CODE}' as reprt_code, y::varchar as bsns_year, code as corp_code, fs_div,
    case when fs_div = 'CFS' then '연결재무제표' else '재무제표' end as fs_nm,
    sj_div, account_id, account_nm, account_detail, '제' || (y - 1990)::varchar || '기' as thstrm_nm,
    '제' || (y - 1991)::varchar || '기' as frmtrm_nm, thstrm_amount, frmtrm_amount, ord::int as ord, 'KRW' as currency
  from ({lines})),
corp as (
  select lpad(s_suppkey::varchar, greatest(8, length(s_suppkey::varchar))::int, '0') as corp_code, s_name as corp_name,
    case when s_suppkey % 3 <> 0 then lpad(s_suppkey::varchar, greatest(6, length(s_suppkey::varchar))::int, '0') end as stock_code,
    s_suppkey % 10 <> 9 as is_active, s_nationkey, s_suppkey
  from supplier),
grp as (select r_regionkey as industry_id, upper(r_name) as industry_code, r_name as industry_name from region),
member as (select n_regionkey as industry_id, corp_code from corp join nation on s_nationkey = n_nationkey)
"""
