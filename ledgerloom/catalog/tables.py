"""Queries over stored tables: merges, constraints, search, filing selection, peers, ingest."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import dims, star
from ledgerloom.catalog import support as q
from ledgerloom.functions.text import padded_number
from ledgerloom.operators import changes, merge, peers, quality, ratios, search
from ledgerloom.operators.select import rank_within
from ledgerloom.plans import prepare
from ledgerloom.sources import disclosures as disclosure_answers
from ledgerloom.sources import registry
from ledgerloom.sources import statements as delivered

T1, T2, T3 = "2025-01-01 00:00:00", "2025-01-02 00:00:00", "2025-01-03 00:00:00"


def _at(text: str):
    return F.lit(text).cast("timestamp")


def _supplier():
    return F.col("corp_code").cast("bigint")


# ---- versions ------------------------------------------------------------------------------------
def _two_versions(results: DataFrame, value: str, first: str, second: str) -> DataFrame:
    """Results in a newer and an older version; some older ones were calculated later or at the same time."""
    newer = results.withColumns(
        {"calculation_version": F.lit(second), "calculated_at": _at(T2), "id": F.lit(1).cast("bigint")}
    )
    late = F.when(_supplier() % 4 == 0, _at(T3)).when(_supplier() % 4 == 1, _at(T2)).otherwise(_at(T1))
    older = results.withColumns(
        {
            value: F.col(value) / 2,
            "calculation_version": F.lit(first),
            "calculated_at": late,
            "id": F.lit(2).cast("bigint"),
        }
    )
    return newer.unionByName(older)


def _with_names(spark: SparkSession, sf_dir: str, results: DataFrame) -> DataFrame:
    listed = star.corporations(spark, sf_dir).filter(F.col("stock_code").isNotNull())
    return results.join(listed.select("corp_code"), "corp_code", "left_semi").join(
        star.corporations(spark, sf_dir).select("corp_code", "corp_name"), "corp_code"
    )


def latest_version_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = ratios.general_ratios(star.statements(spark, sf_dir))
    latest = peers.latest_ratios(_two_versions(results, "ratio_value", "v1", "v2"))
    return _with_names(spark, sf_dir, latest).select(
        *ratios.FILING, "corp_name", "ratio_code", "ratio_value", "calculation_version"
    )


_PICK_OLD = "c.s % 4 in (0, 1)"
LATEST_VERSION_RATIOS = q.STATEMENTS + q.general_ratio_ctes() + f""",
c as (select *, s_suppkey as s from corp where stock_code is not null)
select {q.FILING}, corp_name, ratio_code, case when {_PICK_OLD} then ratio_value / 2 else ratio_value end as ratio_value,
  case when {_PICK_OLD} then 'v1' else 'v2' end as calculation_version
from ratio join c using (corp_code)"""


def latest_version_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = changes.account_changes(star.statements(spark, sf_dir))
    latest = peers.latest_changes(_two_versions(results.drop("id"), "change_rate", "v1", "v2"))
    return _with_names(spark, sf_dir, latest).groupBy(*ratios.FILING, "corp_name").agg(
        F.count(F.lit(1)).alias("account_count"),
        F.count("change_rate").alias("rate_count"),
        F.min("calculation_version").alias("calculation_version"),
        F.max("change_rate").alias("max_rate"),
    )


LATEST_VERSION_CHANGES = q.STATEMENTS + q.CHANGES + f""",
c as (select *, s_suppkey as s from corp where stock_code is not null),
two as (
  select chg.*, 'v2' as v, timestamp '{T2}' as calc, 1 as id, change_rate as r from chg
  union all
  select chg.*, 'v1', case corp_code::bigint % 4 when 0 then timestamp '{T3}' when 1 then timestamp '{T2}' else timestamp '{T1}' end,
    2, change_rate / 2 from chg),
latest as (
  select * from two qualify row_number() over (
    partition by {q.FILING}, sj_div, account_id, account_nm, account_detail order by calc desc, id desc) = 1)
select {q.FILING}, corp_name, count(*) as account_count, count(r) as rate_count, min(v) as calculation_version, max(r) as max_rate
from latest join c using (corp_code) group by {q.FILING}, corp_name"""


# ---- merges --------------------------------------------------------------------------------------
def _line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.when(F.col("l_linenumber") != 7, F.col("l_linenumber")).alias("ord"),
        "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    )


def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with odd parts arrive in a table that holds those with even parts."""
    rows = _line_rows(spark, sf_dir)
    order = [F.col(c).asc() for c in ("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")]
    return merge.insert_if_absent(
        rows.filter(F.col("l_partkey") % 2 == 0), rows.filter(F.col("l_partkey") % 2 == 1), ["l_orderkey", "ord"], "ord", order
    )


_LINES = """
with r as (
  select l_orderkey, case when l_linenumber <> 7 then l_linenumber end as ord, l_partkey, l_suppkey, l_quantity, l_extendedprice
  from lineitem),
first as (
  select * from r where l_partkey % 2 = 1 and ord is not null
  qualify row_number() over (partition by l_orderkey, ord order by l_partkey, l_suppkey, l_extendedprice, l_quantity) = 1),
fresh as (
  select * from first f where not exists (
    select 1 from r e where e.l_partkey % 2 = 0 and e.l_orderkey = f.l_orderkey and e.ord = f.ord)
  union all
  select * from r where l_partkey % 2 = 1 and ord is null)"""
INSERT_IF_ABSENT = _LINES + " select * from fresh"


def insert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Received, saved and ignored rows of that insert."""
    received = _line_rows(spark, sf_dir).filter(F.col("l_partkey") % 2 == 1)
    saved = insert_if_absent(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))
    counts = received.agg(F.count(F.lit(1)).alias("received_count"), saved.scalar().alias("saved_count"))
    return counts.withColumn("ignored_count", F.col("received_count") - F.col("saved_count"))


INSERT_COUNTS = _LINES + """
select a.n as received_count, b.n as saved_count, a.n - b.n as ignored_count
from (select count(*) as n from r where l_partkey % 2 = 1) a, (select count(*) as n from fresh) b"""


def upsert_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years up to 1998 are stored, years from 1998 arrive recalculated."""
    results = ratios.general_ratios(star.statements(spark, sf_dir))
    stored = results.filter(F.col("bsns_year") <= "1998").withColumn("calculated_at", F.lit(T1))
    arriving = results.filter(F.col("bsns_year") >= "1998").withColumns(
        {"ratio_value": F.col("ratio_value") + 1, "ratio_name": F.concat(F.col("ratio_name"), F.lit("*")), "calculated_at": F.lit(T2)}
    )
    return merge.upsert_ratios(stored, arriving, [F.col("calculated_at").desc()])


UPSERT_RATIOS = q.STATEMENTS + q.general_ratio_ctes() + f"""
select {q.FILING}, ratio_code, case when bsns_year >= '1998' then ratio_name || '*' else ratio_name end as ratio_name,
  case when bsns_year >= '1998' then ratio_value + 1 else ratio_value end as ratio_value, numerator_value, denominator_value,
  '{dims.GENERAL_VERSION}' as calculation_version, case when bsns_year >= '1998' then '{T2}' else '{T1}' end as calculated_at
from ratio"""


def upsert_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored changes of the default statements; recalculated balance sheets and equity statements arrive."""
    rows = changes.account_changes(star.statements(spark, sf_dir)).select(
        "financial_statement_id", *ratios.FILING, "sj_div", "account_nm", "change_amount", "change_rate"
    )
    rows = rows.withColumn("calculation_version", F.lit("v1"))
    stored = rows.filter(F.col("sj_div").isin(*dims.DEFAULT_CHANGE_STATEMENTS)).withColumn("calculated_at", F.lit(T1))
    arriving = rows.filter(F.col("sj_div").isin("BS", "SCE")).withColumns(
        {"change_amount": F.col("change_amount") + 1, "account_nm": F.lit("renamed"), "calculated_at": F.lit(T2)}
    )
    return merge.upsert_changes(stored, arriving, [F.col("calculated_at").desc()])


UPSERT_CHANGES = q.STATEMENTS + q.CHANGES + f"""
select financial_statement_id, {q.FILING}, sj_div, case when sj_div = 'SCE' then 'renamed' else account_nm end as account_nm,
  case when sj_div in ('BS', 'SCE') then change_amount + 1 else change_amount end as change_amount, change_rate,
  'v1' as calculation_version, case when sj_div in ('BS', 'SCE') then '{T2}' else '{T1}' end as calculated_at
from chg"""


def _registries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as a stored registry and as a newer snapshot, each with gaps."""
    key = F.col("c_custkey")
    rows = star.table(spark, sf_dir, "customer").select(
        "c_custkey",
        padded_number(key, 8).alias("corp_code"),
        F.col("c_name").alias("corp_name"),
        F.when(key % 3 == 0, padded_number(key, 6)).alias("stock_code"),
        F.lit("20240101").alias("modify_date"),
    )
    stored = rows.filter(key % 7 != 3).withColumns(
        {
            "is_active": key % 6 != 5,
            "first_seen_at": F.lit(T1),
            "last_seen_at": F.lit(T1),
            "deactivated_at": F.when(key % 6 == 5, F.lit(T1)),
        }
    )
    snapshot = rows.filter(key % 5 != 4).withColumns(
        {
            "corp_name": F.when(key % 4 == 0, F.concat(F.col("corp_name"), F.lit(" Ltd"))).otherwise(F.col("corp_name")),
            "stock_code": F.when(key % 9 == 0, F.lit("")).otherwise(F.col("stock_code")),
        }
    )
    return stored.drop("c_custkey"), snapshot.drop("c_custkey")


def registry_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, snapshot = _registries(spark, sf_dir)
    return merge.sync_registry(stored, snapshot, F.lit(T2))


_SYNC = f"""
with c as (
  select c_custkey as k, lpad(c_custkey::varchar, greatest(8, length(c_custkey::varchar))::int, '0') as corp_code, c_name as corp_name,
    case when c_custkey % 3 = 0 then lpad(c_custkey::varchar, greatest(6, length(c_custkey::varchar))::int, '0') end as stock_code
  from customer where c_custkey % 7 <> 3 or c_custkey % 5 <> 4),
f as (select *, k % 7 <> 3 as old, k % 5 <> 4 as new, k % 6 <> 5 as was_active from c),
synced as (
  select corp_code, case when new and k % 4 = 0 then corp_name || ' Ltd' else corp_name end as corp_name,
    case when new and k % 9 = 0 then null else stock_code end as stock_code, '20240101' as modify_date, new as is_active,
    case when old then '{T1}' else '{T2}' end as first_seen_at, case when new then '{T2}' else '{T1}' end as last_seen_at,
    case when new then null when was_active then '{T2}' else '{T1}' end as deactivated_at,
    case when not old then 'inserted' when new then 'updated' when was_active then 'deactivated' else 'unchanged' end as sync_action
  from f)"""
REGISTRY_SYNC = _SYNC + " select * from synced"


def registry_sync_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.sync_counts(registry_sync(spark, sf_dir))


REGISTRY_SYNC_COUNTS = _SYNC + """
select count_if(is_active) as received_count, count_if(is_active and stock_code is not null) as listed_count,
  count_if(is_active and stock_code is null) as unlisted_count, count_if(sync_action = 'deactivated') as deactivated_count
from synced""".replace("count_if(", "count(*) filter (where ")


def delete_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Separate-statement ratios of one version of every third company are deleted."""
    results = ratios.general_ratios(star.statements(spark, sf_dir)).withColumn(
        "calculation_version", F.when(F.col("bsns_year") < "1998", "v1").otherwise("v2")
    )
    gone = (_supplier() % 3 == 0) & (F.col("fs_div") == "OFS") & (F.col("calculation_version") == "v1")
    return merge.delete_rows(results, gone).groupBy("corp_code", "fs_div", "calculation_version").agg(
        F.count(F.lit(1)).alias("row_count")
    )


DELETE_BY_KEY = q.STATEMENTS + q.general_ratio_ctes() + """,
v as (select corp_code, fs_div, case when bsns_year < '1998' then 'v1' else 'v2' end as calculation_version from ratio)
select corp_code, fs_div, calculation_version, count(*) as row_count from v
where not (corp_code::bigint % 3 = 0 and fs_div = 'OFS' and calculation_version = 'v1') group by all"""


def industry_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memberships after adding unpadded and repeated codes, removing some and deleting one group."""
    groups, members = star.industries(spark, sf_dir)
    supplier = star.corporations(spark, sf_dir)
    added = supplier.select(
        ((F.col("s_suppkey") + 1) % 5).cast("int").alias("industry_id"), F.concat(F.lit(" "), F.col("s_suppkey").cast("string")).alias("corp_code")
    )
    blank = supplier.select(F.lit(0).alias("industry_id"), F.lit("  ").alias("corp_code"))
    grown = members.unionByName(merge.add_members(members, added.unionByName(added).unionByName(blank)))
    removed = supplier.filter(F.col("s_suppkey") % 10 == 0).select(
        F.lit(1).alias("industry_id"), F.col("s_suppkey").cast("string").alias("corp_code")
    )
    kept_groups, kept = merge.delete_groups(
        groups, merge.remove_members(grown, removed), groups.filter(F.col("industry_code") == "EUROPE").select("industry_id")
    )
    return (
        kept.join(kept_groups, "industry_id")
        .join(supplier.select("corp_code", "corp_name", "stock_code", "is_active"), "corp_code")
        .select("industry_id", "industry_code", "corp_code", "corp_name", "stock_code", "is_active")
    )


INDUSTRY_MEMBERS = q.STATEMENTS + """,
m as (
  select industry_id, corp_code from member
  union
  select ((s_suppkey + 1) % 5)::int, corp_code from corp)
select industry_id, industry_code, corp_code, corp_name, stock_code, is_active
from m join corp using (corp_code) join grp using (industry_id)
where not (industry_id = 1 and s_suppkey % 10 = 0) and industry_code <> 'EUROPE'"""


def industry_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts offered as industry groups: codes repeat in pairs, names in triples, some codes are taken or blank."""
    groups, _ = star.industries(spark, sf_dir)
    key = F.col("p_partkey")
    code = F.when(key % 50 == 1, "africa").otherwise(F.concat(F.lit(" part-"), F.expr("p_partkey div 2").cast("string")))
    offered = star.table(spark, sf_dir, "part").select(
        code.alias("industry_code"),
        F.concat(F.lit("name "), F.expr("p_partkey div 3").cast("string"), F.lit(" ")).alias("industry_name"),
        key.alias("ordinal"),
    )
    blank = offered.withColumns({"industry_code": F.lit("  "), "ordinal": F.col("ordinal") - 1000000000})
    return merge.create_groups(groups, offered.unionByName(blank), "ordinal").select(
        "industry_id", "industry_code", "industry_name"
    )


# a refused first row of a triple leaves the name to the next one
INDUSTRY_CREATE = q.STATEMENTS + """
select (select max(industry_id) from grp) + row_number() over (order by p_partkey) as industry_id,
  'PART-' || p_partkey // 2 as industry_code, 'name ' || p_partkey // 3 as industry_name
from part where (p_partkey % 3 = 0 and p_partkey % 50 <> 1) or (p_partkey % 3 = 1 and p_partkey % 50 = 2)"""


# ---- constraints ---------------------------------------------------------------------------------
def integrity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations per rule on the given tables."""
    dates = F.date_format("o_orderdate", "yyyyMMdd")
    given = {name: star.table(spark, sf_dir, name) for name in ("lineitem", "orders", "customer")}
    return quality.integrity(
        {**given, "supplier": star.corporations(spark, sf_dir)},
        unique={"unique_line": ("lineitem", ["l_orderkey", "l_linenumber"])},
        references={
            "line_order": ("lineitem", "l_orderkey", "orders", "o_orderkey"),
            "order_customer": ("orders", "o_custkey", "customer", "c_custkey"),
            "customer_supplier_nation": ("customer", "c_nationkey", "supplier", "s_nationkey"),
        },
        rules={
            "orders": {"date_range": quality.is_date_range(dates, F.lit("19980101"))},
            "supplier": {
                "corp_code": quality.is_corp_code("corp_code"),
                "stock_code": quality.required(["stock_code"])["missing:stock_code"],
                "year": quality.is_console_year(F.col("s_suppkey").cast("string")),
            },
        },
    )


INTEGRITY_REPORT = """
select 'unique_line' as rule, count(*) as violations from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1)
union all select 'line_order', count(*) from lineitem where l_orderkey not in (select o_orderkey from orders)
union all select 'order_customer', count(*) from orders where o_custkey not in (select c_custkey from customer)
union all select 'customer_supplier_nation', count(*) from customer where c_nationkey not in (select s_nationkey from supplier)
union all select 'date_range', count(*) from orders where strftime(o_orderdate, '%Y%m%d') > '19980101'
union all select 'stock_code', count(*) from supplier where s_suppkey % 3 = 0
union all select 'corp_code', count(*) from supplier where s_suppkey > 99999999
union all select 'year', count(*) from supplier where s_suppkey not between 2000 and 2100"""


# ---- search --------------------------------------------------------------------------------------
NAME_QUERIES = ["supplier#00000000", "Supplier#000000007", "99"]
ROUTED_QUERIES = ["000007", "00000012", "00000019", "Supplier#0000000", " 000003 "]


def _with_query(frame: DataFrame) -> DataFrame:
    return frame.select("query", F.col("position").cast("bigint").alias("position"), "corp_code", "corp_name", "stock_code")


def entity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_query(search.search_by_name(star.corporations(spark, sf_dir), NAME_QUERIES, limit=5))


def _name_search(words: list[str], limit: int) -> str:
    listed = q.values([(w,) for w in words], "query")
    return f"""
select query, row_number() over (partition by query order by case when corp_name = query then 0 else 1 end, corp_name, corp_code) as position,
  corp_code, corp_name, stock_code
from corp join {listed} on contains(lower(corp_name), lower(query)) where is_active qualify position <= {limit}"""


ENTITY_SEARCH = q.STATEMENTS + _name_search(NAME_QUERIES, 5)


def entity_search_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_query(search.find_corporations(star.corporations(spark, sf_dir), ROUTED_QUERIES, limit=7))


ENTITY_SEARCH_ROUTER = q.STATEMENTS + f"""
select stock_code as query, 1::bigint as position, corp_code, corp_name, stock_code from corp where is_active and stock_code in ('000007', '000003')
union all
select corp_code, 1, corp_code, corp_name, stock_code from corp where is_active and corp_code in ('00000012', '00000019')
union all
select * from ({_name_search(["Supplier#0000000"], 7)})"""


def entity_search_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.count_by_keyword(star.corporations(spark, sf_dir), NAME_QUERIES)


ENTITY_SEARCH_COUNT = q.STATEMENTS + f"""
select query, count(*) filter (where is_active and (contains(lower(corp_name), lower(query)) or contains(stock_code, query)
  or contains(corp_code, query))) as total_count
from {q.values([(w,) for w in NAME_QUERIES], "query")} left join corp on true group by query"""


def _customers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as a registry, and queries that grow with it: segments, ends of numbers, codes, names, and what none has."""
    key, code = F.col("c_custkey"), padded_number("c_custkey", 8)
    registry_rows = star.table(spark, sf_dir, "customer").select(
        code.alias("corp_code"), F.concat("c_name", F.lit(" "), "c_mktsegment").alias("corp_name"),
        F.when(key % 3 != 0, padded_number("c_custkey", 6)).alias("stock_code"), (key % 10 != 9).alias("is_active"),
    )
    texts = F.array(
        F.lower(F.substring("c_mktsegment", 1, 4)), F.concat((key % 100).cast("string"), F.lit(" B")), F.substring("c_mktsegment", 1, 1),
        F.when(key % 7 == 0, code), F.when(key % 7 == 1, padded_number("c_custkey", 6)), F.when(key % 7 == 2, F.concat(F.lit(" "), F.lower("c_name"))),
        F.when(key % 7 == 3, F.concat("c_name", F.lit(" "), "c_mktsegment")), F.when(key % 7 == 4, F.concat(F.lit("no "), code)), F.lit(" "), F.lit("0"),
    )
    queries = star.table(spark, sf_dir, "customer").select(F.explode(F.array_compact(texts)).alias("query"))
    return registry_rows, queries


_CUSTOMERS = """
with corp as (
  select lpad(c_custkey::varchar, greatest(8, length(c_custkey::varchar))::int, '0') as corp_code, c_name || ' ' || c_mktsegment as corp_name,
    case when c_custkey % 3 <> 0 then lpad(c_custkey::varchar, greatest(6, length(c_custkey::varchar))::int, '0') end as stock_code, c_custkey % 10 <> 9 as is_active
  from customer),
asked as (
  select distinct unnest([lower(substr(c_mktsegment, 1, 4)), (c_custkey % 100) || ' B', substr(c_mktsegment, 1, 1),
    case when c_custkey % 7 = 0 then lpad(c_custkey::varchar, greatest(8, length(c_custkey::varchar))::int, '0') end,
    case when c_custkey % 7 = 1 then lpad(c_custkey::varchar, greatest(6, length(c_custkey::varchar))::int, '0') end,
    case when c_custkey % 7 = 2 then ' ' || lower(c_name) end, case when c_custkey % 7 = 3 then c_name || ' ' || c_mktsegment end,
    case when c_custkey % 7 = 4 then 'no ' || lpad(c_custkey::varchar, greatest(8, length(c_custkey::varchar))::int, '0') end, ' ', '0']) as query
  from customer),
word as (select query, trim(query) as w from asked where query is not null)"""


def entity_search_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of queries, routed to codes and names, in one pass over the registry."""
    return _with_query(search.route_queries(*_customers(spark, sf_dir), limit=6))


ENTITY_SEARCH_MANY = _CUSTOMERS + """
select query, row_number() over (partition by query order by case when corp_name = w then 0 else 1 end, corp_name, corp_code) as position,
  corp_code, corp_name, stock_code
from word join corp on is_active and w <> '' and case when regexp_full_match(w, '[0-9]{6}') then stock_code = w
  when regexp_full_match(w, '[0-9]{8}') then corp_code = w else contains(lower(corp_name), lower(w)) end
qualify position <= 6"""


def entity_count_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.count_matches(*_customers(spark, sf_dir))


ENTITY_COUNT_MANY = _CUSTOMERS + """
select query, count(*) filter (where w <> '' and is_active and (contains(lower(corp_name), lower(w)) or contains(stock_code, w) or contains(corp_code, w)))
  as total_count
from word left join corp on true group by query"""


def ratio_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consolidated annual ratios of the current version, in report order."""
    results = ratios.general_ratios(star.statements(spark, sf_dir))
    return search.ratio_view(
        results, reprt_code=star.REPORT_CODE, fs_div="CFS", calculation_version=dims.GENERAL_VERSION, bsns_year=None
    ).select(*ratios.FILING, "ratio_code", "ratio_value")


RATIO_SCAN = q.STATEMENTS + q.general_ratio_ctes() + f"""
select {q.FILING}, ratio_code, ratio_value from ratio where fs_div = 'CFS' order by reprt_code, fs_div, ratio_code"""


ACCOUNT_KEYS = [*ratios.FILING, "account_nm"]


def account_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one account name per filing, asked with all five keys; a twelfth of the requests leave one blank."""
    rows = star.statements(spark, sf_dir)
    asked = rows.filter(F.col("ord") % 5 == F.col("corp_code").cast("bigint") % 5).select(
        *ratios.FILING, F.when(F.col("corp_code").cast("bigint") % 12 == 0, "").otherwise(F.col("account_nm")).alias("account_nm")
    )
    return search.lookup(rows, asked.distinct(), ACCOUNT_KEYS).select(*ACCOUNT_KEYS, "sj_div", "ord", "thstrm_amount", "frmtrm_amount")


ACCOUNT_LOOKUP = q.STATEMENTS + f""",
asked as (
  select distinct {q.FILING}, case when corp_code::bigint % 12 = 0 then '' else account_nm end as account_nm
  from stmt where ord % 5 = corp_code::bigint % 5)
select {q.FILING}, account_nm, sj_div, ord, thstrm_amount, frmtrm_amount from stmt
semi join asked using ({q.FILING}, account_nm) where account_nm <> ''"""


def ratio_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ratio per filing of the separate statements, asked with all its keys."""
    results = ratios.general_ratios(star.statements(spark, sf_dir))
    codes = F.array(*[F.lit(code) for code in sorted(dims.GENERAL_RATIO_NAMES)])
    asked = results.filter("fs_div = 'OFS'").select(
        *ratios.FILING, F.element_at(codes, (F.col("corp_code").cast("bigint") % F.size(codes) + 1).cast("int")).alias("ratio_code")
    )
    return search.lookup(results, asked.distinct(), [*ratios.FILING, "ratio_code"]).select(*ratios.FILING, "ratio_code", "ratio_value")


RATIO_LOOKUP = q.STATEMENTS + q.general_ratio_ctes() + f"""
select {q.FILING}, ratio_code, ratio_value from ratio where fs_div = 'OFS'
  and ratio_code = {sorted(dims.GENERAL_RATIO_NAMES)}[(corp_code::bigint % {len(dims.GENERAL_RATIO_NAMES)} + 1)::int]"""


def format_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every format rule on dates, receipts, keys and words of the orders."""
    date = F.date_format("o_orderdate", "yyyyMMdd")
    value = F.element_at(
        F.array(
            date, F.substring(date, 1, 4), F.concat(date, padded_number("o_orderkey", 6)), star.padded_key(F.col("o_custkey")),
            F.col("o_orderkey").cast("string"), F.when(F.col("o_custkey") % 2 == 0, "CFS").otherwise("cfs"), F.lit(""), F.lit(None),
        ), (F.col("o_orderkey") % 8 + 1).cast("int"),
    )
    rules = {
        "is_year": quality.is_year, "is_console_year": quality.is_console_year, "is_scope": quality.is_scope,
        "is_corp_code": quality.is_corp_code, "is_receipt_number": quality.is_receipt_number, "is_date": quality.is_date,
    }
    rows = star.table(spark, sf_dir, "orders").select("o_orderkey", value.alias("value"))
    return rows.select("o_orderkey", "value", *[F.coalesce(rule("value"), F.lit(False)).alias(name) for name, rule in rules.items()])


FORMAT_RULES = """
with v as (
  select o_orderkey, case o_orderkey % 8 when 0 then strftime(o_orderdate, '%Y%m%d') when 1 then year(o_orderdate)::varchar
    when 2 then strftime(o_orderdate, '%Y%m%d') || lpad(o_orderkey::varchar, greatest(6, length(o_orderkey::varchar))::int, '0')
    when 3 then lpad(o_custkey::varchar, greatest(8, length(o_custkey::varchar))::int, '0') when 4 then o_orderkey::varchar
    when 5 then case when o_custkey % 2 = 0 then 'CFS' else 'cfs' end when 6 then '' end as value
  from orders)
select o_orderkey, value, coalesce(regexp_full_match(value, '[0-9]{4}'), false) as is_year,
  coalesce(regexp_full_match(value, '[0-9]{4}') and try_cast(value as int) between 2000 and 2100, false) as is_console_year,
  coalesce(value in ('CFS', 'OFS'), false) as is_scope, coalesce(regexp_full_match(value, '[0-9]{8}'), false) as is_corp_code,
  coalesce(regexp_full_match(value, '[0-9]{14}'), false) as is_receipt_number, coalesce(regexp_full_match(value, '[0-9]{8}'), false) as is_date
from v"""


#: Filings of a delivered answer at most.
PAGE_ROWS = 100


def disclosure_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as one page of filings, delivered in parts of ``PAGE_ROWS``; some pages are errors or empty.

    A part is named by its file and the place of its first filing.
    """
    key = F.col("o_custkey")
    filing = F.struct(
        star.padded_key(key).alias("corp_code"), F.lit("n").alias("corp_name"), F.concat(F.lit("R "), F.col("o_orderpriority")).alias("report_nm"),
        F.col("o_orderkey").cast("string").alias("rcept_no"), F.date_format("o_orderdate", "yyyyMMdd").alias("rcept_dt"), F.lit("f").alias("flr_nm"),
    )
    orders = star.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", filing.alias("f"))
    ranked = rank_within(orders, ["o_custkey"], [F.col("o_orderkey")]).withColumn("place", (F.col("rank") - 1).cast("int"))
    parts = ranked.groupBy("o_custkey", (F.col("place") - F.col("place") % PAGE_ROWS).alias("begin")).agg(
        F.array_sort(F.collect_list(F.struct("place", "f"))).alias("fs")  # PAGE_ROWS orders at most
    )
    pages = parts.filter((key % 10 != 7) | (F.col("begin") == 0))  # an error is one answer
    status = F.when(key % 10 == 3, "013").when(key % 10 == 7, "020").otherwise("000")
    text = F.to_json(F.struct(
        status.alias("status"), F.lit("m").alias("message"), F.when(key % 2 == 0, (key % 5).cast("int")).alias("page_no"),
        F.lit(1).alias("total_page"), F.when(status == "000", F.transform("fs", lambda e: e["f"])).alias("list"),
    ))
    source = F.struct(key.cast("string").alias("name"), "begin")
    delivered_pages = pages.select(source.alias("file"), F.from_json(text, disclosure_answers.PAGE).alias("p")).select("file", "p.*")
    listed = disclosure_answers.listed_filings(delivered_pages).select(
        F.col("ordinal.file.name").alias("file"), "ordinal.page_no", (F.col("ordinal.file.begin") + F.col("ordinal.place")).alias("place"),
        "corp_code", "report_nm", "rcept_no", "rcept_dt",
    )
    failed = disclosure_answers.failed_pages(delivered_pages).select(F.col("file.name").alias("file"), F.coalesce("page_no", F.lit(1)).alias("page_no"))
    return listed.withColumn("failed", F.lit(False)).unionByName(failed.withColumn("failed", F.lit(True)), allowMissingColumns=True)


DISCLOSURE_PAGES = """
select o_custkey::varchar as file, case when o_custkey % 2 = 0 then (o_custkey % 5)::int else 1 end as page_no,
  (row_number() over (partition by o_custkey order by o_orderkey) - 1)::int as place,
  lpad(o_custkey::varchar, greatest(8, length(o_custkey::varchar))::int, '0') as corp_code, 'R ' || o_orderpriority as report_nm,
  o_orderkey::varchar as rcept_no, strftime(o_orderdate, '%Y%m%d') as rcept_dt, false as failed
from orders where o_custkey % 10 not in (3, 7)
union all
select distinct o_custkey::varchar, case when o_custkey % 2 = 0 then (o_custkey % 5)::int else 1 end, null, null, null, null, null, true
from orders where o_custkey % 10 = 7"""


def registry_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active companies by name with the number of their stored statement rows."""
    listed = search.all_corporations(star.corporations(spark, sf_dir)).select("corp_code", "corp_name", "stock_code")
    counted = listed.join(search.row_counts(listed, star.statements(spark, sf_dir)), "corp_code")
    return counted.orderBy("corp_name", "corp_code")


REGISTRY_LIST = q.STATEMENTS + """
select c.corp_code, c.corp_name, c.stock_code, count(s.id) as statement_rows
from corp c left join stmt s using (corp_code) where c.is_active group by all"""


def _zip_registry(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        out = []
        for text in batch:
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr("readme.txt", "<list>not this</list>")
                archive.writestr("CORPCODE.xml", text)
                archive.writestr("other.xml", "<list><corp_code>0</corp_code><corp_name>0</corp_name></list>")
            out.append(buffer.getvalue())
        yield pd.Series(out, dtype=object)


def registry_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as registry archives of some hundred companies each, read back as streamed ranges."""
    key, number = F.col("c_custkey"), padded_number("c_custkey", 8)
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>\n"))
    entry = F.concat(
        F.lit("<list>"), tag("corp_code", F.concat(F.lit(" "), number)),
        tag("corp_name", F.when(key % 11 == 0, " ").otherwise(F.concat(F.lit("가 &lt;A&amp;B&gt; "), "c_name"))),
        tag("stock_code", F.when(key % 3 == 0, F.substring(number, 3, 6)).otherwise(" ")),
        tag("modify_date", F.lit("20240101")), F.lit("</list>"),
    )
    packed = star.table(spark, sf_dir, "customer").groupBy(F.expr("c_custkey div 400").alias("part")).agg(
        F.concat(F.lit("<result>"), F.array_join(F.collect_list(entry), ""), F.lit("</result>")).alias("xml")  # at most 400 each
    )
    landed = packed.select(F.col("part").cast("string").alias("path"), F.pandas_udf(_zip_registry, "binary")("xml").alias("content"))
    return registry.registry_from_zip(landed)


REGISTRY_SCAN = """
select lpad(c_custkey::varchar, greatest(8, length(c_custkey::varchar))::int, '0') as corp_code, '가 <A&B> ' || c_name as corp_name,
  case when c_custkey % 3 = 0 then substr(lpad(c_custkey::varchar, greatest(8, length(c_custkey::varchar))::int, '0'), 3, 6) end as stock_code,
  '20240101' as modify_date
from customer where c_custkey % 11 <> 0"""


def industry_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies of every industry by name."""
    _, members = star.industries(spark, sf_dir)
    listed = star.corporations(spark, sf_dir).select("corp_code", "corp_name", "stock_code", "is_active")
    return search.industry_corporations(members, listed)


INDUSTRY_LIST = q.STATEMENTS + """
select industry_id, corp_code, corp_name, stock_code, is_active from member join corp using (corp_code)"""


# ---- filings -------------------------------------------------------------------------------------
def disclosures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a filing list: company, filing name, receipt date and number."""
    key = F.col("o_orderkey")
    year = F.year("o_orderdate")
    name = F.element_at(
        F.array(
            *[
                F.concat(F.lit(prefix), (year - shift).cast("string"), F.lit(suffix))
                for prefix, shift, suffix in (
                    ("사업보고서 (", 1, ".12)"),
                    ("[기재정정] 사업 보고서 (", 1, ".12)"),
                    ("반기보고서 (", 0, ".06)"),
                    ("분기보고서 (", 0, ".03)"),
                    ("분기보고서 (", 2, ".09)"),
                    ("감사 보고서제출 ", 1, ""),
                    ("주요사항보고서 ", 0, ""),
                )
            ]
        ),
        (key % 7 + 1).cast("int"),
    )
    date = F.date_format("o_orderdate", "yyyyMMdd")
    return star.table(spark, sf_dir, "orders").select(
        key.alias("ordinal"),
        star.padded_key(F.col("o_custkey")).alias("corp_code"),
        name.alias("report_nm"),
        date.alias("rcept_dt"),
        F.concat(date, padded_number(key, 6)).alias("rcept_no"),
    )


_DISCLOSURES = """
with d as (
  select o_orderkey as ordinal, lpad(o_custkey::varchar, greatest(8, length(o_custkey::varchar))::int, '0') as corp_code,
    o_orderkey % 7 as kind, year(o_orderdate) as y, strftime(o_orderdate, '%Y%m%d') as rcept_dt,
    strftime(o_orderdate, '%Y%m%d') || lpad(o_orderkey::varchar, greatest(6, length(o_orderkey::varchar))::int, '0') as rcept_no
  from orders)"""


def report_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.periodic_reports(disclosures(spark, sf_dir), "ordinal").select(
        "corp_code", "bsns_year", "reprt_code", "rcept_no", "rcept_dt"
    )


REPORT_MATCH = _DISCLOSURES + """
select corp_code, (case when kind in (0, 1) then y - 1 else y end)::varchar as bsns_year,
  case when kind in (0, 1) then '11011' when kind = 2 then '11012' else '11013' end as reprt_code, rcept_no, rcept_dt
from d where kind in (0, 1, 2, 3)
qualify row_number() over (partition by corp_code, 2, 3 order by rcept_dt desc, ordinal) = 1""".replace(
    "partition by corp_code, 2, 3", "partition by corp_code, bsns_year, reprt_code"
)


def audit_filing_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.latest_audit_filings(disclosures(spark, sf_dir), "ordinal").select(
        "corp_code", "bsns_year", "rcept_no", "rcept_dt"
    )


AUDIT_FILING_LATEST = _DISCLOSURES + """,
once as (select * from d where kind in (0, 1, 5) qualify row_number() over (partition by rcept_no order by ordinal desc) = 1)
select corp_code, (y - 1)::varchar as bsns_year, rcept_no, rcept_dt from once
qualify row_number() over (partition by corp_code, y order by rcept_dt desc, rcept_no desc) = 1"""


_TITLES = [
    " 감사 보고서 ", "연결 감사보고서", "영문감사보고서", "내부회계관리제도 감사보고서", "[첨부] 감사보고서", "감사의 감사보고서", "사업보고서", "[정정]연결감사보고서",
]


def attachment_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as attachments of one filing."""
    titles = F.array(*[F.lit(t) for t in _TITLES])
    rows = star.table(spark, sf_dir, "orders").select(
        star.padded_key(F.col("o_custkey")).alias("rcept_no"),
        F.col("o_orderkey").cast("string").alias("dcm_no"),
        F.element_at(titles, (F.col("o_orderkey") % len(_TITLES) + 1).cast("int")).alias("title"),
        F.col("o_orderkey").alias("ordinal"),
    )
    return search.pick_attachments(rows, "ordinal")


ATTACHMENT_PICK = """
with a as (
  select lpad(o_custkey::varchar, greatest(8, length(o_custkey::varchar))::int, '0') as rcept_no, o_orderkey::varchar as dcm_no,
    case o_orderkey % 8 when 0 then '감사 보고서' when 7 then '연결감사보고서' else '감사보고서' end as title, o_orderkey % 8 = 7 as is_consolidated,
    o_orderkey as ordinal
  from orders where o_orderkey % 8 in (0, 1, 4, 7)),
u as (select * from a qualify row_number() over (partition by rcept_no, dcm_no, is_consolidated order by ordinal desc) = 1)
select *, 'any' as asked from u qualify row_number() over (partition by rcept_no order by is_consolidated desc, title, ordinal) = 1
union all
select *, 'separate' from u where not is_consolidated qualify row_number() over (partition by rcept_no order by title, ordinal) = 1"""


# ---- peers ---------------------------------------------------------------------------------------
def _peer_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    statements = star.statements(spark, sf_dir)
    return peers.peer_table(
        star.corporations(spark, sf_dir), ratios.general_ratios(statements), changes.account_changes(statements)
    )


def _peer_ctes() -> str:
    keys = [(key, "".join(n.split()), i) for key, names in dims.CHANGE_ALIASES.items() for i, n in enumerate(names)]
    last = {(k, n): i for k, n, i in keys}
    alias = q.values([(k, n, i) for (k, n), i in last.items()], "column_key, alias_label, alias_rank")
    ratio_columns = ", ".join(f"max(case when ratio_code = '{c}' then ratio_value end) as {c}" for c in dims.GENERAL_RATIO_NAMES)
    change_columns = ", ".join(f"max(case when column_key = '{k}' then change_rate end) as {k}" for k in dims.CHANGE_ALIASES)
    return q.general_ratio_ctes() + q.CHANGES + f""",
cand as (
  select g.*, c.corp_name, a.column_key, a.alias_rank,
    case when column_key in ('REVENUE_CHANGE', 'COST_OF_SALES_CHANGE', 'OPERATING_PROFIT_CHANGE')
      then case sj_div when 'IS' then 0 when 'CIS' then 1 else 99 end else case sj_div when 'BS' then 0 else 99 end end as p1,
    case when column_key in ('RECEIVABLE_CHANGE', 'INVENTORY_CHANGE', 'PAYABLE_CHANGE') then {q.scope_sql("g.")} else 0 end as p2
  from chg g join {alias} a on a.alias_label = {q.label_sql("g.account_nm")} join corp c using (corp_code)),
cpick as (
  select * from cand qualify row_number() over (partition by {q.FILING}, column_key
    order by p1, p2, alias_rank, trim(account_detail) <> '', corp_name, sj_div, account_nm, account_detail, account_id) = 1),
peer as materialized (
  select corp_code, corp_name, bsns_year, reprt_code, fs_div, {", ".join(dims.PEER_METRICS)}
  from (select {q.FILING}, {ratio_columns} from ratio group by {q.FILING})
  full join (select {q.FILING}, {change_columns} from cpick group by {q.FILING}) using ({q.FILING})
  join corp using (corp_code))"""


def peer_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peers.sort_peers(_peer_table(spark, sf_dir), "ROA", descending=True)


PEER_TABLE = q.STATEMENTS + _peer_ctes() + " select * from peer"


def _rounded(frame: DataFrame) -> DataFrame:
    return frame.withColumns({c: F.round(c, 6) for c in ("mean", "median", "stdev", "min", "max")})


def peer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = peers.metrics_long(_peer_table(spark, sf_dir))
    return _rounded(peers.metric_summary(values, [*peers.CONDITION, "metric"]))


_LONG = "unpivot (select * exclude (corp_name) from peer) on " + ", ".join(dims.PEER_METRICS) + " into name metric value value"
_STATS = """count(value) as count, round(avg(value), 6) as mean, round(median(value), 6) as median,
  round(stddev_samp(value), 6) as stdev, round(min(value), 6) as min, round(max(value), 6) as max"""
PEER_SUMMARY = q.STATEMENTS + _peer_ctes() + f"""
select bsns_year, reprt_code, fs_div, metric, {_STATS} from ({_LONG}) group by bsns_year, reprt_code, fs_div, metric"""


def peer_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peers.rank_ratios(ratios.bank_ratios(star.statements(spark, sf_dir))).select(
        *ratios.FILING, "ratio_code", "ratio_name", "ratio_value", "rank"
    )


PEER_RANKING = q.STATEMENTS + q.bank_ratio_ctes() + f"""
select {q.FILING}, ratio_code, ratio_name, ratio_value,
  row_number() over (partition by bsns_year, reprt_code, fs_div, ratio_code order by ratio_value desc, corp_code) as rank
from bratio where ratio_value is not null"""


def unavailable_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers requested for a comparison of suppliers, some without a code."""
    asked = star.table(spark, sf_dir, "customer").select(
        F.when(F.col("c_custkey") % 50 == 0, "  ").otherwise(star.padded_key(F.col("c_custkey"))).alias("corp_code"),
        F.col("c_name").alias("corp_name"),
    )
    return peers.unavailable_companies(asked, star.statements(spark, sf_dir))


UNAVAILABLE_COMPANIES = q.STATEMENTS + """,
asked as (
  select case when c_custkey % 50 = 0 then '' else lpad(c_custkey::varchar, greatest(8, length(c_custkey::varchar))::int, '0') end as corp_code,
    c_name as corp_name from customer)
select *, case when corp_code = '' then 'no_corp_code' else 'no_statements' end as reason
from asked where corp_code = '' or corp_code not in (select corp_code from stmt)"""


def industry_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of every metric per industry and condition."""
    _, members = star.industries(spark, sf_dir)
    values = peers.metrics_long(peers.industry_peers(members, _peer_table(spark, sf_dir)).drop("corp_name"))
    return _rounded(peers.metric_summary(values, ["industry_id", *peers.CONDITION, "metric"]))


INDUSTRY_PEERS = q.STATEMENTS + _peer_ctes() + f"""
select industry_id, bsns_year, reprt_code, fs_div, metric, {_STATS}
from ({_LONG}) join member using (corp_code) group by industry_id, bsns_year, reprt_code, fs_div, metric"""


def industry_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members per group, with one group that nobody belongs to."""
    groups, members = star.industries(spark, sf_dir)
    # an id that no region has: one group is added per table, whatever its size
    empty = groups.groupBy().agg((F.max("industry_id") + 1).alias("industry_id")).select(
        "industry_id", F.lit("NONE").alias("industry_code"), F.lit("none").alias("industry_name")
    )
    return peers.industry_counts(groups.unionByName(empty), members)


INDUSTRY_COUNTS = q.STATEMENTS + """
select g.*, count(m.corp_code) as member_count
from (select * from grp union all select max(industry_id) + 1, 'NONE', 'none' from grp) g left join member m using (industry_id) group by all"""


# ---- ingest --------------------------------------------------------------------------------------
def _delivered(spark: SparkSession, sf_dir: str) -> delivered.Ingest:
    answers = delivered.answers_from_text(
        star.payloads(spark, sf_dir), corp_code=F.col("corp_code"), fs_div=F.col("fs_div")
    )
    # parsed once and written, since the rows are used several times below
    return delivered.settle(delivered.ingest(answers))


def statement_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows of delivered answers for a table that already holds the separate statements."""
    stored = star.statements(spark, sf_dir).filter(F.col("fs_div") == "OFS")
    rows = delivered.for_storage(_delivered(spark, sf_dir).rows)
    fresh = merge.insert_if_absent(stored, rows, merge.STATEMENT_KEY, "ord", [F.col(delivered.PLACE).asc()])
    return fresh.select(
        *merge.STATEMENT_KEY, "corp_code", "bsns_year", "reprt_code", "thstrm_amount", "frmtrm_amount", "currency"
    )


_GOOD = """corp_code::bigint % 10 <> 9 and not (corp_code::bigint % 11 = 3 and ord = 16)
  and not (corp_code::bigint % 12 = 5 and ord = 11)"""
STATEMENT_INGEST = q.STATEMENTS + f"""
select rcept_no, fs_div, sj_div, account_id, trim(account_nm) as account_nm, account_detail, ord, corp_code, bsns_year, reprt_code,
  thstrm_amount, frmtrm_amount, currency from stmt where {_GOOD} and (fs_div = 'CFS' or account_nm <> trim(account_nm))"""


def ingest_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected rows and answers with their reasons."""
    result = _delivered(spark, sf_dir)
    rows = result.rejected_rows.select("corp_code", "fs_div", "bsns_year", F.array_join("reasons", ",").alias("reason"))
    answers = result.rejected_answers.select("corp_code", "fs_div", F.lit(None).cast("string").alias("bsns_year"), "reason")
    return rows.unionByName(answers)


INGEST_REJECTS = q.STATEMENTS + """
select corp_code, fs_div, bsns_year, case when ord = 16 then 'amount:thstrm_amount' else 'missing:account_nm' end as reason
from stmt where corp_code::bigint % 10 <> 9 and ((corp_code::bigint % 11 = 3 and ord = 16) or (corp_code::bigint % 12 = 5 and ord = 11))
union all
select corp_code, fs_div, null, 'no_data' from (select distinct corp_code, fs_div, bsns_year from stmt where corp_code::bigint % 10 = 9)"""


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer key as a requested company, unpadded, in two overlapping lists."""
    asked = star.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("corp_code"), F.col("c_custkey").alias("position")
    )
    return asked.unionByName(asked.withColumn("position", F.col("position") + 1000000000))


def batch_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = _delivered(spark, sf_dir)
    stored = delivered.for_storage(result.rows).withColumn("id", F.monotonically_increasing_id())
    return prepare.outcomes(_requests(spark, sf_dir), result, ratios.general_ratios(stored), changes.account_changes(stored))


BATCH_OUTCOME = q.STATEMENTS.replace("stmt as materialized (", "stmt0 as materialized (") + f""",
stmt as materialized (select * replace (trim(account_nm) as account_nm) from stmt0 where {_GOOD})""" + q.general_ratio_ctes() + """,
a as (select lpad(c_custkey::varchar, greatest(8, length(c_custkey::varchar))::int, '0') as corp_code, c_custkey as position from customer),
r as (select corp_code, count(*) as n from stmt group by corp_code),
b as (select corp_code, count(*) as n from stmt0 where corp_code::bigint % 10 <> 9 group by corp_code),
x as (select corp_code, count(ratio_value) as n from ratio group by corp_code)
select position, corp_code, coalesce(r.n, 0) as received_count, coalesce(b.n, 0) - coalesce(r.n, 0) as rejected_count,
  coalesce(x.n, 0) as ratio_count, coalesce(r.n, 0) as change_count, case when r.n is null then 'fetch' when coalesce(x.n, 0) = 0 then 'ratios' end as failed_stage,
  case when r.n is null then case when corp_code in (select corp_code from stmt0) then 'no_data' else 'no_answer' end end as message,
  r.n is not null and coalesce(x.n, 0) > 0 as is_success
from a left join r using (corp_code) left join b using (corp_code) left join x using (corp_code)"""


def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.outcome_summary(_requests(spark, sf_dir), batch_outcome(spark, sf_dir))


BATCH_SUMMARY = f"""
with o as ({BATCH_OUTCOME})
select 2 * count(*) as requested_count, count(*) as unique_count, count(*) filter (where is_success) as success_count,
  count(*) filter (where not is_success) as failure_count from o"""

QUERIES = {
    "latest_version_ratios": (latest_version_ratios, LATEST_VERSION_RATIOS),
    "latest_version_changes": (latest_version_changes, LATEST_VERSION_CHANGES),
    "insert_if_absent": (insert_if_absent, INSERT_IF_ABSENT),
    "insert_counts": (insert_counts, INSERT_COUNTS),
    "upsert_ratios": (upsert_ratios, UPSERT_RATIOS),
    "upsert_changes": (upsert_changes, UPSERT_CHANGES),
    "registry_sync": (registry_sync, REGISTRY_SYNC),
    "registry_sync_counts": (registry_sync_counts, REGISTRY_SYNC_COUNTS),
    "delete_by_key": (delete_by_key, DELETE_BY_KEY),
    "industry_members": (industry_members, INDUSTRY_MEMBERS),
    "industry_create": (industry_create, INDUSTRY_CREATE),
    "integrity_report": (integrity_report, INTEGRITY_REPORT),
    "entity_search": (entity_search, ENTITY_SEARCH),
    "entity_search_router": (entity_search_router, ENTITY_SEARCH_ROUTER),
    "entity_search_count": (entity_search_count, ENTITY_SEARCH_COUNT),
    "ratio_scan": (ratio_scan, RATIO_SCAN),
    "account_lookup": (account_lookup, ACCOUNT_LOOKUP),
    "ratio_lookup": (ratio_lookup, RATIO_LOOKUP),
    "format_rules": (format_rules, FORMAT_RULES),
    "disclosure_pages": (disclosure_pages, DISCLOSURE_PAGES),
    "registry_list": (registry_list, REGISTRY_LIST),
    "registry_scan": (registry_scan, REGISTRY_SCAN),
    "entity_search_many": (entity_search_many, ENTITY_SEARCH_MANY),
    "entity_count_many": (entity_count_many, ENTITY_COUNT_MANY),
    "industry_list": (industry_list, INDUSTRY_LIST),
    "report_match": (report_match, REPORT_MATCH),
    "audit_filing_latest": (audit_filing_latest, AUDIT_FILING_LATEST),
    "attachment_pick": (attachment_pick, ATTACHMENT_PICK),
    "peer_table": (peer_table, PEER_TABLE),
    "peer_summary": (peer_summary, PEER_SUMMARY),
    "peer_ranking": (peer_ranking, PEER_RANKING),
    "unavailable_companies": (unavailable_companies, UNAVAILABLE_COMPANIES),
    "industry_peers": (industry_peers, INDUSTRY_PEERS),
    "industry_counts": (industry_counts, INDUSTRY_COUNTS),
    "statement_ingest": (statement_ingest, STATEMENT_INGEST),
    "ingest_rejects": (ingest_rejects, INGEST_REJECTS),
    "batch_outcome": (batch_outcome, BATCH_OUTCOME),
    "batch_summary": (batch_summary, BATCH_SUMMARY),
}
