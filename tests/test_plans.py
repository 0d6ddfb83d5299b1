"""The plans that matter at size: where rows are reduced, what is read, what is broadcast."""

import re

import pytest
from pyspark.sql import functions as F

from ledgerloom import star
from ledgerloom.catalog import all_queries
from ledgerloom.operators import ratios, search
from ledgerloom.operators.select import pick_first, with_once

SF_DIR = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_pick_first_limits_groups_before_the_exchange(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    lines = [line.strip(" :+-") for line in plan(pick_first(rows, ["k"], [F.col("v").desc()])).splitlines()]
    exchange = next(i for i, line in enumerate(lines) if line.startswith("Exchange"))
    assert any(line.startswith("WindowGroupLimit") for line in lines[exchange + 1 :])


def test_account_selection_is_skew_safe_and_broadcasts_only_constants(spark):
    text = plan(ratios.general_ratios(star.statements(spark, SF_DIR)))
    assert text.count("WindowGroupLimit") == 2
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    broadcast = text.split("BroadcastExchange")[1]
    assert "LocalTableScan" in broadcast and "FileScan" not in broadcast


def test_line_items_are_read_once_and_pruned(spark):
    text = plan(star.statements(spark, SF_DIR))
    assert len(re.findall("FileScan parquet", text)) == 1
    columns = re.search(r"FileScan parquet \[([^\]]*)\]", text).group(1)
    assert "l_suppkey" in columns and "l_orderkey" not in columns and "l_partkey" not in columns
    assert "partial_sum" in text


def test_equality_filters_reach_the_scan(spark, tmp_path):
    stored = star.statements(spark, SF_DIR)
    stored.write.partitionBy("bsns_year", "reprt_code").parquet(str(tmp_path / "s"))
    view = search.statement_view(spark.read.parquet(str(tmp_path / "s")), bsns_year="1998", fs_div="CFS").select("corp_code")
    text = plan(view)
    assert "PartitionFilters: [isnotnull(bsns_year" in text and "EqualTo(fs_div,CFS)" in text


@pytest.mark.parametrize("name", ["opinion_classify", "section_extract", "going_concern", "audit_summary", "html_blocks"])
def test_documents_are_parsed_without_a_shuffle(spark, name):
    text = plan(all_queries()[name][0](spark, SF_DIR))
    assert text.count("ArrowEvalPython") == 1
    # the only exchange spreads the few splits of the small test files
    assert text.count("Exchange") == text.count("REPARTITION_BY_NUM") <= 1


def test_with_once_stops_filters(spark):
    frame = with_once(spark.range(5), "x", F.sqrt(F.col("id")))
    text = plan(frame.filter(F.col("x") > 1))
    assert text.count("SQRT") == 1
    assert sorted(r.id for r in frame.filter(F.col("x") > 1).collect()) == [2, 3, 4]


# these rank over a checkpoint, so building them already runs jobs
RANKED = ("industry_create", "industry_peers", "peer_summary", "peer_ranking")


@pytest.mark.parametrize("name", [n for n in all_queries() if n not in RANKED])
def test_no_query_multiplies_rows(spark, name):
    text = plan(all_queries()[name][0](spark, SF_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
