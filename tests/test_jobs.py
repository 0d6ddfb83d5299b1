import json
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import merge, quality, search
from ledgerloom.plans import jobs, tables
from ledgerloom.plans.jobs import Store
from ledgerloom.sources import archives, disclosures, registry
from ledgerloom.sources import statements as delivered
from ledgerloom.streaming.ingest import ingest_keyed_stream, ingest_stream

AT, LATER = "2025-01-01 00:00:00", "2025-02-01 00:00:00"


def raw(corp="00000001", year="2025", name="자산총계", amount="1,200", previous="1,000", order="1", **more):
    return {
        "rcept_no": f"{year}0311000514", "reprt_code": "11011", "bsns_year": year, "corp_code": corp, "sj_div": "BS",
        "account_id": "ifrs-full_Assets", "account_nm": name, "account_detail": "-", "thstrm_amount": amount,
        "frmtrm_amount": previous, "ord": order, "currency": "KRW", **more,
    }


def answers(spark, *items):
    rows = [(item[0], json.dumps(item[1], ensure_ascii=False), item[2] if len(item) > 2 else "00000001") for item in items]
    frame = spark.createDataFrame(rows, "fs_div string, payload string, corp_code string")
    return delivered.answers_from_text(frame, fs_div=F.col("fs_div"), corp_code=F.col("corp_code"))


def ok(*rows):
    return {"status": "000", "message": "정상", "list": list(rows)}


@pytest.fixture
def store(spark, tmp_path):
    target = Store(str(tmp_path / "store"))
    snapshot = spark.createDataFrame(
        [("00000001", "가", "000001", "20240101"), ("00000002", "나", None, None)], "corp_code string, corp_name string, stock_code string, modify_date string"
    )
    jobs.sync_registry(spark, target, snapshot, AT).collect()
    return target


def test_registry_sync_over_three_snapshots(spark, store):
    second = spark.createDataFrame([("00000001", "가나", "", None), ("00000003", "다", "000003", None)],
                                   "corp_code string, corp_name string, stock_code string, modify_date string")
    counts = jobs.sync_registry(spark, store, second, LATER).first()
    assert tuple(counts) == (2, 1, 1, 1)
    rows = {r.corp_code: r for r in jobs.corporations(spark, store).collect()}
    assert rows["00000001"].corp_name == "가나" and rows["00000001"].stock_code is None
    assert str(rows["00000001"].first_seen_at) == AT and str(rows["00000001"].last_seen_at) == LATER
    assert not rows["00000002"].is_active and str(rows["00000002"].deactivated_at) == LATER
    third = second.limit(0).unionByName(spark.createDataFrame([("00000002", "나", None, None)], second.schema))
    jobs.sync_registry(spark, store, third, "2025-03-01 00:00:00")
    again = {r.corp_code: r for r in jobs.corporations(spark, store).collect()}["00000002"]
    assert again.is_active and again.deactivated_at is None and str(again.first_seen_at) == AT
    with pytest.raises(ValueError):
        jobs.sync_registry(spark, store, second.limit(0), LATER)


def test_statement_sync_is_idempotent(spark, store):
    batch = answers(spark, ("CFS", ok(raw(), raw(), raw(name="부채총계", order=""), raw(name="부채총계", order=""))),
                    ("CFS", ok(raw(corp="00000009"))), ("OFS", {"status": "013", "message": "none"}), ("OFS", {"status": "000"}))
    result, counts = jobs.sync_statements(spark, store, batch, AT)
    got = counts.first()
    # rows without order number are never duplicates
    assert (got.received_count, got.saved_count, got.ignored_count, got.unknown_count) == (5, 3, 1, 1)
    assert sorted(r.reason for r in result.rejected_answers.collect()) == ["missing_list", "no_data"]
    _, counts = jobs.sync_statements(spark, store, answers(spark, ("CFS", ok(raw(), raw(year="2024")))), AT)
    assert counts.first().saved_count == 1
    rows = jobs.statements(spark, store).collect()
    assert sorted(r.id for r in rows) == [1, 2, 3, 4]
    assert {r.bsns_year for r in rows} == {"2024", "2025"} and rows[0].thstrm_amount == 1200


def test_rejected_rows_and_strict_mode(spark, store):
    bad = answers(spark, ("CFS", ok(raw(), raw(amount="금액없음", order="2"), raw(name=" ", order="x"))))
    result = delivered.ingest(bad)
    assert result.rows.count() == 1
    assert sorted(tuple(r.reasons) for r in result.rejected_rows.collect()) == [
        ("amount:thstrm_amount",), ("missing:account_nm", "order"),
    ]
    with pytest.raises(Exception, match="invalid statement row"):
        delivered.ingest(bad, strict=True).rows.collect()


def test_prepare_filings(spark, store):
    batch = answers(
        spark,
        ("CFS", ok(raw(), raw(name="자본총계", amount="800", previous="700", order="2"), raw(name="부채총계", amount="400", order="3"))),
        ("CFS", {"status": "800", "message": "limit"}, "00000002"),
    )
    requests = spark.createDataFrame([("1", 1), ("00000001", 2), ("2", 3)], "corp_code string, position bigint")
    outcome = {r.corp_code: r for r in jobs.prepare_filings(spark, store, requests, batch, AT).collect()}
    assert outcome["00000001"].is_success and outcome["00000001"].received_count == 3 and outcome["00000001"].change_count == 3
    assert (outcome["00000002"].failed_stage, outcome["00000002"].message) == ("fetch", "status_error")
    first = {r.ratio_code: r for r in jobs.ratios(spark, store).collect()}
    assert len(first) == 13 and first["DEBT_RATIO"].ratio_value == 50
    # a second run updates in place and keeps the id of the first calculation
    jobs.save_ratios(spark, store, jobs.statements(spark, store), LATER)
    second = {r.ratio_code: r for r in jobs.ratios(spark, store).collect()}
    assert len(second) == 13 and str(second["ROA"].calculated_at) == LATER and second["ROA"].id == first["ROA"].id
    jobs.save_changes(spark, store, jobs.statements(spark, store), LATER)
    assert jobs.changes(spark, store).count() == 3
    from ledgerloom import schemas

    gone = tables.delete_from_table(spark, store.path("ratios"), schemas.RATIOS, F.col("corp_code") == "00000001")
    assert gone.first().deleted_count == 13 and jobs.ratios(spark, store).count() == 0


def test_partition_overwrite_leaves_other_years_alone(spark, store):
    years = answers(spark, ("CFS", ok(raw(), raw(year="2024", amount="5"))))
    jobs.sync_statements(spark, store, years, AT)
    jobs.save_ratios(spark, store, jobs.statements(spark, store), AT)
    only = jobs.statements(spark, store).filter("bsns_year = '2025'")
    jobs.save_ratios(spark, store, only, LATER)
    stamps = {r.bsns_year: str(r.calculated_at) for r in jobs.ratios(spark, store).collect()}
    assert stamps == {"2024": AT, "2025": LATER}


def test_stream_equals_batch(spark, store, tmp_path):
    landing = tmp_path / "landing"
    for scope, year in (("CFS", "2025"), ("OFS", "2024"), ("CFS", "2023")):
        folder = landing / f"fs_div={scope}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{year}.json").write_text(json.dumps(ok(raw(year=year), raw(year=year))), encoding="utf-8")
    for _ in range(2):
        query = ingest_stream(spark, store, str(landing), str(tmp_path / "progress"), AT, files_per_batch=1)
        query.awaitTermination()
    streamed = sorted((r.bsns_year, r.fs_div, r.ord) for r in jobs.statements(spark, store).collect())
    other = Store(str(tmp_path / "batch"))
    tables.write_snapshot(jobs.corporations(spark, store), other.path("corporations"), 1)
    jobs.sync_statements(spark, other, delivered.read_answers(spark, str(landing)), AT)
    assert streamed == sorted((r.bsns_year, r.fs_div, r.ord) for r in jobs.statements(spark, other).collect())
    assert len(streamed) == 3


def test_keyed_stream_stores_each_key_once_over_batches_and_restarts(spark, store, tmp_path):
    landing = tmp_path / "landing" / "fs_div=CFS"
    landing.mkdir(parents=True)

    def land(name, *rows):
        (landing / f"{name}.json").write_text(json.dumps(ok(*rows)), encoding="utf-8")

    def run():
        ingest_keyed_stream(spark, store, str(tmp_path / "landing"), str(tmp_path / "progress"), files_per_batch=1).awaitTermination()

    land("a", raw(order="2", amount="7"), raw(order="2", amount="5"), raw(order=""))
    land("b", raw(year="2024"), raw(corp="00000009"))
    land("c", raw(order="2", amount="9"), raw(order=""), raw(year="2023"))
    run()
    first = jobs.statements(spark, store).collect()
    assert sorted((r.bsns_year, r.ord, r.thstrm_amount) for r in first if r.ord == 2) == [("2025", 2, 7)]
    assert sorted(r.id for r in first) == [1, 2, 3, 4, 5] and sum(r.ord is None for r in first) == 2
    assert all(r.created_at is not None for r in first)
    land("d", raw(order="2", amount="7"), raw(year="2022"))  # the first again, after a restart
    run()
    assert sorted((r.bsns_year, r.id) for r in jobs.statements(spark, store).collect() if r.id > 5) == [("2022", 6)]


def test_emptied_partitions_can_be_filled_again(spark, store):
    years = answers(spark, ("CFS", ok(raw(), raw(year="2024", amount="5"))))
    jobs.sync_statements(spark, store, years, AT)
    rows = jobs.statements(spark, store)
    jobs.save_ratios(spark, store, rows, AT)
    from ledgerloom import schemas

    gone = tables.delete_from_table(spark, store.path("ratios"), schemas.RATIOS, F.col("bsns_year") == "2024")
    assert gone.first().deleted_count == 13
    assert {r.bsns_year for r in jobs.ratios(spark, store).collect()} == {"2025"}
    nothing = tables.delete_from_table(spark, store.path("ratios"), schemas.RATIOS, F.col("bsns_year") == "1900")
    assert nothing.first().deleted_count == 0 and jobs.ratios(spark, store).count() == 13
    jobs.save_ratios(spark, store, rows, LATER)
    assert {(r.bsns_year, r.id) for r in jobs.ratios(spark, store).collect()} == {("2024", 2), ("2025", 1)}


def test_no_driver_work_in_plans_operators_sources_and_streams():
    import pathlib

    root = pathlib.Path(jobs.__file__).parents[1]
    found = [
        (path.name, word) for part in ("plans", "sources", "streaming") for path in (root / part).glob("*.py")
        for word in (".collect()", ".count()", "isEmpty", "_jvm", "toPandas", "toLocalIterator") if word in path.read_text()
    ]
    assert found == []


def test_registry_sources(spark, tmp_path):
    xml = (
        '<?xml version="1.0" encoding="UTF-8"?><result><list><corp_code> 1 </corp_code><corp_name>가&amp;나</corp_name><stock_code> </stock_code>'
        "<modify_date>20240101</modify_date></list><list><corp_code>2</corp_code><corp_name> </corp_name></list></result>"
    )
    (tmp_path / "r.xml").write_text(xml, encoding="utf-8")
    rows = registry.read_registry_xml(spark, str(tmp_path / "r.xml")).collect()
    assert [tuple(r) for r in rows] == [("1", "가&나", None, "20240101")]
    with zipfile.ZipFile(tmp_path / "r.zip", "w") as archive:
        archive.writestr("readme.txt", "x")
        archive.writestr("CORP.XML", xml)
    (tmp_path / "bad.zip").write_bytes(b"no zip")
    landed = archives.read_archives(spark, str(tmp_path / "*.zip"))
    assert [tuple(r) for r in registry.registry_from_zip(landed).collect()] == [tuple(r) for r in rows]
    assert sorted(r.status for r in archives.archive_status(landed, "path").collect()) == ["not_a_zip", "ok"]


def test_disclosure_pages(spark, tmp_path):
    def page(number, *names):
        listed = [{"corp_code": "00000001", "report_nm": n, "rcept_no": f"2026031100000{number}", "rcept_dt": "20260311"} for n in names]
        return {"status": "000", "page_no": number, "total_page": 2, "list": listed}

    (tmp_path / "1.json").write_text(json.dumps(page(1, "사업보고서 (2025.12)")), encoding="utf-8")
    (tmp_path / "2.json").write_text(json.dumps(page(2, "[기재정정]사업보고서 (2025.12)", "감사보고서제출")), encoding="utf-8")
    (tmp_path / "3.json").write_text(json.dumps({"status": "013", "message": "none"}), encoding="utf-8")
    (tmp_path / "4.json").write_text(json.dumps({"status": "020", "message": "limit"}), encoding="utf-8")
    pages = disclosures.read_pages(spark, str(tmp_path))
    listed = disclosures.listed_filings(pages)
    assert listed.count() == 3 and disclosures.failed_pages(pages).count() == 1
    found = search.periodic_reports(listed, "ordinal").first()
    # equal dates: the filing listed first
    assert (found.bsns_year, found.reprt_code, found.rcept_no) == ("2025", "11011", "20260311000001")
    assert search.latest_audit_filings(listed, "ordinal").first().rcept_no == "20260311000002"


def test_industry_groups(spark):
    groups = spark.createDataFrame([(1, "BANK", "은행")], "industry_id bigint, industry_code string, industry_name string")
    offered = spark.createDataFrame([(" bank ", "다른", 1), ("it", " 소프트 ", 2), ("IT", "중복", 3), (" ", "빈", 4), ("car", "소프트", 5), ("car", "자동차", 6)],
                                    "industry_code string, industry_name string, o bigint")
    made = [tuple(r) for r in merge.create_groups(groups, offered, "o").select("industry_id", "industry_code", "industry_name").orderBy("industry_id").collect()]
    assert made == [(2, "IT", "소프트"), (3, "CAR", "자동차")]
    members = spark.createDataFrame([(1, "00000001")], "industry_id bigint, corp_code string")
    incoming = spark.createDataFrame([(1, "1"), (1, " 2"), (1, "2"), (1, " ")], members.schema)
    assert [tuple(r) for r in merge.add_members(members, incoming).collect()] == [(1, "00000002")]
    assert merge.remove_members(members, spark.createDataFrame([(1, "1")], members.schema)).count() == 0


def test_search(spark):
    rows = [("00126380", "삼성전자", "005930", True), ("00000002", "삼성", "000002", True), ("00000003", "삼성물산", None, False), ("00000004", "ABC 50%", None, True)]
    corp = spark.createDataFrame(rows, "corp_code string, corp_name string, stock_code string, is_active boolean")

    def codes(frame):
        return [r.corp_code for r in frame.orderBy("query", "position").collect()]

    assert codes(search.find_corporations(corp, ["005930"])) == ["00126380"]
    assert codes(search.find_corporations(corp, ["00126380"])) == ["00126380"]
    assert codes(search.find_corporations(corp, [" 삼성 "])) == ["00000002", "00126380"]
    assert codes(search.find_corporations(corp, ["삼성"], active_only=False, limit=2)) == ["00000002", "00000003"]
    assert codes(search.find_corporations(corp, ["abc 50%"])) == ["00000004"]
    assert codes(search.find_corporations(corp, ["00000003", "없음"])) == []
    with pytest.raises(ValueError):
        search.find_corporations(corp, [" "])
    counts = {r["query"]: r.total_count for r in search.count_by_keyword(corp, ["0000", "삼성"]).collect()}
    assert counts == {"0000": 2, "삼성": 2}


def test_split_rejects(spark):
    frame = spark.createDataFrame([("2025", "CFS"), ("25", None)], "y string, f string")
    rules = {"year": quality.is_year("y"), "scope": quality.is_scope("f")}
    good, bad = quality.split_rejects(frame, rules)
    assert good.count() == 1 and bad.first().reasons == ["year", "scope"]
    with pytest.raises(Exception, match="invalid row: year, scope"):
        quality.split_rejects(frame, rules, strict=True)[0].count()


def test_a_merge_exchanges_stored_rows_once_and_leaves_no_checkpoint(spark, tmp_path, statement_rows, monkeypatch):
    rows = statement_rows(("BS", "ifrs-full_Assets", "자산총계", 100, 80), ("IS", "ifrs-full_Revenue", "매출액", 10, 5, {"year": "2024"}))
    store = jobs.Store(str(tmp_path / "s"))
    kept = []
    monkeypatch.setattr(jobs, "cut_lineage", lambda df: kept.append(df) or df)
    jobs.save_changes(spark, store, rows, "2025-01-01 00:00:00", "v2")
    jobs.save_changes(spark, store, rows, "2025-01-01 00:00:00", "v1")
    assert kept == []  # wide rows are written compressed instead
    stored = jobs.changes(spark, store)
    assert sorted((r.calculation_version, r.bsns_year, r.id) for r in stored.collect()) == [
        ("v1", "2024", 2), ("v1", "2025", 2), ("v2", "2024", 1), ("v2", "2025", 1)]
    near = tables.touched(stored, stored.filter("bsns_year = '2024'"))
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert [r.bsns_year for r in near.collect()] == ["2024", "2024"]
