"""Every registered query with an oracle equals its SQL on the smallest tables."""

import pytest
from oracle_support import compare, connect
from pyspark.sql import functions as F

from ledgerloom.catalog import all_queries
from ledgerloom.sources import disclosures

SF_DIR = "/root/testdata/sf0.001"
QUERIES = all_queries()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_query_equals_oracle(spark, con, name):
    run, sql = QUERIES[name]
    _, problem = compare(spark, con, run, sql, SF_DIR)
    assert problem is None, problem


def test_blocks_of_pages_follow_the_document(spark):
    rows = QUERIES["html_blocks"][0](spark, SF_DIR).collect()
    assert rows
    by_page = {}
    for row in rows:
        by_page.setdefault(row.page_id, []).append(row.position)
        assert row.text == row.text.strip() != ""
        assert row.tag in "p div td th li h1 h2 h3 h4 h5 h6 title tu te".split()
    assert all(sorted(p) == list(range(len(p))) for p in by_page.values())


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    frame = entry.entry(spark)
    assert frame.columns[:4] == ["corp_code", "bsns_year", "reprt_code", "fs_div"]
    assert frame.limit(1).count() == 1


@pytest.mark.parametrize("customer", [4, 7])  # listed, and failed
def test_orders_of_one_large_customer_are_delivered_in_bounded_pages(spark, tmp_path, monkeypatch, customer):
    orders = spark.read.parquet(f"{SF_DIR}/orders.parquet")
    orders.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, customer).otherwise(F.col("o_custkey"))).coalesce(1).write.parquet(
        f"{tmp_path}/orders.parquet")
    con = connect(SF_DIR)
    con.execute(f"create or replace view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    delivered = []
    listed = disclosures.listed_filings
    monkeypatch.setattr(disclosures, "listed_filings", lambda pages, *more: delivered.append(pages) or listed(pages, *more))
    _, problem = compare(spark, con, *QUERIES["disclosure_pages"], str(tmp_path))
    assert problem is None, problem
    assert max(r.n for r in delivered[0].where("list is not null").select(F.size("list").alias("n")).collect()) <= 100
