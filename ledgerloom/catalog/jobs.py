"""Queries that run whole jobs over a store of their own in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import schemas, star
from ledgerloom.catalog import support as q
from ledgerloom.catalog.tables import BATCH_OUTCOME
from ledgerloom.operators import merge, peers, ratios
from ledgerloom.operators.changes import account_changes
from ledgerloom.plans import jobs, tables
from ledgerloom.session import scratch_folder
from ledgerloom.sources import statements as delivered

AT, LATER = "2025-01-01 00:00:00", "2025-02-01 00:00:00"


def _store(spark: SparkSession, sf_dir: str) -> jobs.Store:
    store = jobs.Store(scratch_folder(spark, "store"))
    snapshot = star.corporations(spark, sf_dir).select("corp_code", "corp_name", "stock_code", F.lit("20240101").alias("modify_date"))
    jobs.sync_registry(spark, store, snapshot, AT)
    return store


def ratio_save(spark: SparkSession, sf_dir: str) -> DataFrame:
    """General and bank ratios of every filing saved, saved again, and read back: what is available and what is not."""
    store, rows = _store(spark, sf_dir), star.statements(spark, sf_dir)
    saved = [jobs.save_ratios(spark, store, rows, AT, bank=bank).withColumn("kind", F.lit("bank" if bank else "general")) for bank in (False, True)]
    jobs.save_ratios(spark, store, rows, LATER)
    stored = jobs.ratios(spark, store)
    kind = F.when(F.col("ratio_code").startswith("BANK_"), "bank").otherwise("general")
    counts = stored.groupBy(*ratios.FILING, kind.alias("kind")).agg(
        F.count(F.lit(1)).alias("stored_count"), F.count_if(F.col("calculated_at") == F.lit(LATER).cast("timestamp")).alias("updated_count"),
        F.min("id").alias("commit"),
    )
    return saved[0].unionByName(saved[1]).join(counts, [*ratios.FILING, "kind"])


def _completeness(source: str, kind: str, updated: str, commit: int) -> str:
    return f"""
select {q.FILING}, '{kind}' as kind, count(*) as ratio_count, count(ratio_value) as available_count,
  coalesce(string_agg(case when ratio_value is null then ratio_code end, ',' order by ratio_code), '') as missing_codes,
  count(*) as stored_count, {updated} as updated_count, {commit}::bigint as commit
from {source} group by {q.FILING}"""


RATIO_SAVE = q.STATEMENTS + q.general_ratio_ctes() + q.bank_ratio_ctes() + _completeness("ratio", "general", "count(*)", 1) + (
    " union all " + _completeness("bratio", "bank", "0::bigint", 2))


def prepare_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One company, the first, out of the answers of all: fetched, stored, calculated."""
    answers = delivered.answers_from_text(star.payloads(spark, sf_dir), corp_code=F.col("corp_code"), fs_div=F.col("fs_div"))
    return jobs.prepare_company(spark, _store(spark, sf_dir), "00000001", answers, AT)


# stored are the changes of the default statements, the batch query counts those of all
PREPARE_COMPANY = BATCH_OUTCOME.replace(
    "coalesce(r.n, 0) as change_count", "(select count(*) from stmt where sj_div in ('BS', 'IS', 'CIS', 'CF') and corp_code = '00000001') as change_count"
) + " where a.corp_code = '00000001'"


def same_time_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of the changes saved at one time: the one that was saved later is the latest."""
    store, rows = _store(spark, sf_dir), star.statements(spark, sf_dir)
    jobs.save_changes(spark, store, rows, AT, "v2")
    jobs.save_changes(spark, store, rows, AT, "v1")
    latest = peers.latest_changes(jobs.changes(spark, store))
    return latest.groupBy(*ratios.FILING).agg(
        F.min("calculation_version").alias("first_version"), F.max("calculation_version").alias("last_version"),
        F.count(F.lit(1)).alias("change_count"),
    )


SAME_TIME_VERSIONS = q.STATEMENTS + q.CHANGES + f"""
select {q.FILING}, 'v1' as first_version, 'v1' as last_version, count(*) as change_count
from (select distinct {q.FILING}, sj_div, account_id, account_nm, account_detail from chg where sj_div in ('BS', 'IS', 'CIS', 'CF')) group by {q.FILING}"""


def delete_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios of a whole year and of some companies deleted; what was deleted and what is left, by year."""
    store, rows = _store(spark, sf_dir), star.statements(spark, sf_dir)
    jobs.save_ratios(spark, store, rows, AT)
    condition = (F.col("bsns_year") == "1995") | (F.col("corp_code").cast("bigint") % 4 == 1)
    deleted = tables.delete_from_table(spark, store.path("ratios"), schemas.RATIOS, condition)
    left = jobs.ratios(spark, store).groupBy("bsns_year").agg(F.count(F.lit(1)).alias("n"))
    return left.unionByName(deleted.select(F.lit("deleted").alias("bsns_year"), F.col("deleted_count").alias("n")))


DELETE_PARTITIONS = q.STATEMENTS + q.general_ratio_ctes() + """,
marked as (select bsns_year, bsns_year = '1995' or corp_code::bigint % 4 = 1 as gone from ratio)
select bsns_year, count(*) as n from marked where not gone group by 1
union all select 'deleted', count(*) from marked where gone"""


def change_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calculated changes with blank and missing fields and with fractions, split before they are stored."""
    k = F.col("financial_statement_id") % 10
    rows = account_changes(star.statements(spark, sf_dir)).withColumns({
        "corp_code": F.when(k == 1, " ").otherwise(F.col("corp_code")), "account_nm": F.when(k.isin(2, 3), None).otherwise(F.col("account_nm")),
        "sj_div": F.when(k == 3, "").otherwise(F.col("sj_div")), "account_id": F.when(k == 4, None).otherwise(F.col("account_id")),
        "change_amount": F.col("change_amount").cast("decimal(30,2)") + F.when(k == 5, F.lit(0.75)).when(k == 6, F.lit(-0.75)).otherwise(0).cast("decimal(3,2)"),
    })
    accepted, rejected = merge.storable_changes(rows)
    columns = ["financial_statement_id", "account_id", "change_amount"]
    return accepted.select(*columns, F.lit("").alias("reasons")).unionByName(
        rejected.select("financial_statement_id", "account_id", F.lit(None).cast("bigint").alias("change_amount"), F.array_join("reasons", ",").alias("reasons"))
    )


CHANGE_REJECTS = q.STATEMENTS + q.CHANGES + """,
k as (select *, financial_statement_id % 10 as k from chg)
select financial_statement_id, account_id, null::bigint as change_amount,
  case k when 1 then 'missing:corp_code' when 2 then 'missing:account_nm' else 'missing:sj_div,missing:account_nm' end as reasons from k where k in (1, 2, 3)
union all
select financial_statement_id, case when k = 4 then '' else coalesce(account_id, '') end,
  (case when k = 5 and change_amount < 0 then change_amount + 1 when k = 6 and change_amount > 0 then change_amount - 1 else change_amount end)::bigint, ''
from k where k not in (1, 2, 3)"""

QUERIES = {
    "ratio_save": (ratio_save, RATIO_SAVE),
    "prepare_company": (prepare_company, PREPARE_COMPANY),
    "same_time_versions": (same_time_versions, SAME_TIME_VERSIONS),
    "delete_partitions": (delete_partitions, DELETE_PARTITIONS),
    "change_rejects": (change_rejects, CHANGE_REJECTS),
}
