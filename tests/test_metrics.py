import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import changes, earnings, peers, ratios
from ledgerloom.operators.select import rank_within

BASE = [
    ("BS", "ifrs-full_Assets", "자산총계", 1200, 1000), ("BS", "ifrs-full_Equity", "자본총계", 800, 700),
    ("BS", "ifrs-full_Liabilities", "부채총계", 400, 300), ("BS", "ifrs-full_CurrentAssets", "유동자산", 500, 450),
    ("BS", "ifrs-full_CurrentLiabilities", "유동부채", 200, 180), ("IS", "ifrs-full_Revenue", "매출액", 1000, 900),
    ("IS", "dart_OperatingIncomeLoss", "영업이익", 100, 90), ("IS", "ifrs-full_ProfitLoss", "당기순이익", 80, 70),
]


def ratio_map(frame):
    return {r.ratio_code: r for r in frame.collect()}


def replaced(name, *row):
    return [row if r[2] == name else r for r in BASE]


def test_general_ratios(statement_rows):
    got = ratio_map(ratios.general_ratios(statement_rows(*BASE)))
    assert len(got) == 13
    values = {k: r.ratio_value for k, r in got.items() if r.ratio_value is not None}
    assert values == pytest.approx({
        "OPERATING_MARGIN": 10, "NET_PROFIT_MARGIN": 8, "ROA": 80 / 1100 * 100, "ROE": 80 / 750 * 100, "DEBT_RATIO": 50,
        "CURRENT_RATIO": 250,
    })
    assert got["ROA"].denominator_value == 1100
    assert {r.calculation_version for r in got.values()} == {"v2_average_balance"}


def test_missing_previous_amount_gives_no_average(statement_rows):
    got = ratio_map(ratios.general_ratios(statement_rows(*replaced("자산총계", "BS", "x", "자산총계", 1200, None))))
    assert got["ROA"].ratio_value is None and got["ROE"].ratio_value is not None


def test_zero_denominator(statement_rows):
    got = ratio_map(ratios.general_ratios(statement_rows(*replaced("유동부채", "BS", "x", "유동부채", 0, 180))))
    assert got["CURRENT_RATIO"].ratio_value is None and got["CURRENT_RATIO"].denominator_value == 0


def test_filing_without_known_accounts_keeps_all_ratios(statement_rows):
    got = ratio_map(ratios.general_ratios(statement_rows(("CF", "x", "아무것도", 1, 1))))
    assert len(got) == 13 and all(r.ratio_value is None for r in got.values())


@pytest.mark.parametrize("name, row, value", [
    ("매출액", ("IS", "x", "영업수익", 1000, 900), 10), ("영업이익", ("IS", "x", "Ⅲ. 영업 이익", 100, 90), 10),
    ("영업이익", ("IS", "x", "영업이익(손실)", -100, 90), -10),
])
def test_aliases(statement_rows, name, row, value):
    assert ratio_map(ratios.general_ratios(statement_rows(*replaced(name, *row))))["OPERATING_MARGIN"].ratio_value == value


def test_selection_order(statement_rows):
    rows = BASE + [
        ("IS", "ifrs-full_Revenue", "매출액", 300, 1, {"detail": "부문"}),
        ("CIS", "a", "매출액", 7, 1),
        ("BS", "ifrs-full_NoncurrentInventories", "재고자산", 5, 5),
        ("BS", "z_Current", "유동재고자산", 60, 40),
        ("IS", "x", "매출원가", 500, 400),
    ]
    got = ratio_map(ratios.general_ratios(statement_rows(*rows)))
    assert got["OPERATING_MARGIN"].denominator_value == 1000
    # the current one wins over the better name
    assert got["INVENTORY_TURNOVER"].ratio_value == 500 / 50
    assert got["DIO"].ratio_value == 365 / 10
    dash = BASE + [("IS", "a", "매출액", 300, 1, {"detail": "-"})]
    assert ratio_map(ratios.general_ratios(statement_rows(*dash)))["OPERATING_MARGIN"].denominator_value == 1000


def test_bank_selection(statement_rows):
    rows = [
        ("BS", "a", "자산총계", 1000, 800), ("BS", "b", "상각후원가측정대출채권및기타자산", 1, 1, {"ord": 1}),
        ("BS", "c", "상각후원가 측정 대출채권", 600, 400, {"ord": 9}), ("IS", "d", "당기순이익", 9, 8),
        ("CIS", "e", "신용손실충당금전입액", 5, 4),
    ]
    got = ratio_map(ratios.bank_ratios(statement_rows(*rows)))
    assert len(got) == 8
    assert got["BANK_LOAN_ASSET_RATIO"].ratio_value == 60
    assert got["BANK_CREDIT_COST_RATIO"].ratio_value == 1.0
    assert got["BANK_ROA"].ratio_value == 1.0
    prefix_only = ratio_map(ratios.bank_ratios(statement_rows(rows[0], rows[1])))
    assert prefix_only["BANK_LOAN_ASSET_RATIO"].numerator_value == 1


def test_major_changes_keep_the_requested_order(statement_rows):
    rows = statement_rows(("BS", "a", "자산 총계", 10, 8), ("BS", "b", "재고자산", 5, 4), ("IS", "c", "자산총계", 1, 1), ("BS", "d", "무관", 1, 1))
    found = changes.major_changes(changes.account_changes(rows), {"BS": ["재고자산", "자산총계"]})
    got = [r.account_nm for r in found.orderBy("statement_position", "account_position").collect()]
    assert got == ["재고자산", "자산 총계"]
    assert changes.major_changes(changes.account_changes(rows), {}).count() == 0


def test_screens(statement_rows):
    rows = statement_rows(
        ("BS", "a", "재고자산", 150, 100), ("IS", "b", "매출액", 110, 100), ("IS", "c", "영업이익 (손실)", -30, 20),
        ("BS", "d", "자본총계", 101, 100),
    )
    all_changes = changes.account_changes(rows)
    got = {r.major_account_nm: (r.direction, r.change_rate) for r in changes.significant_moves(all_changes).collect()}
    assert got == {"재고자산": ("증가", 50.0), "영업이익": ("감소", -250.0)}
    one = changes.divergence(all_changes).first()
    assert (one.target_rate, one.base_rate, one.difference) == pytest.approx((50, 10, 40))
    assert changes.divergence(all_changes, points=40.1).count() == 0


def test_eps(statement_rows):
    rows = statement_rows(
        ("IS", "ifrs-full_BasicEarningsLossPerShare", "기본주당이익", 6338, 4950),
        ("IS", "ifrs-full_DilutedEarningsLossPerShare", "희석주당이익", 6305, 4920), ("IS", "x", "매출액", 1, 1),
    )
    got = earnings.eps(rows).first()
    assert (got.basic_eps, got.diluted_eps, round(got.basic_eps_change_rate, 2), got.currency) == (6338, 6305, 28.04, "KRW")
    named = earnings.eps(statement_rows(("IS", "custom_EarningsPerShare", "기본주당순이익(원)", 1200, 1000, {"currency": None}))).first()
    assert (named.basic_eps, named.basic_eps_change_rate, named.diluted_eps, named.currency) == (1200, 20.0, None, "KRW")
    nothing = earnings.eps(statement_rows(("IS", "x", "매출액", 1, 1))).first()
    assert nothing.basic_eps is None and nothing.currency is None
    assert earnings.eps(statement_rows(("IS", "x", "매출액", 1, 1)), min_match=0).first().basic_eps == 1


def test_effective_tax_rate(statement_rows):
    rows = statement_rows(("IS", "a", "법인세비용", 4274666000000, 1), ("IS", "b", "법인세비용차감전순이익", 49481471000000, 1))
    got = earnings.effective_tax_rate(rows).first()
    assert (round(got.effective_tax_rate, 2), got.status) == (8.64, "ok")
    loss = statement_rows(("IS", "a", "법인세비용", 428441584, 1), ("IS", "b", "법인세비용차감전순이익", -37023819, 1))
    assert earnings.effective_tax_rate(loss).first().status == "no_profit"
    spaced = statement_rows(("IS", "a", " 법인세비용", 1, 1), ("IS", "b", "법인세비용차감전순이익", 10, 1))
    assert earnings.effective_tax_rate(spaced).first().status == "no_tax_expense"
    two = statement_rows(
        ("IS", "a", "법인세비용", 1, 1, {"rcept_no": "1"}), ("IS", "a", "법인세비용", 2, 1, {"rcept_no": "2"}),
        ("IS", "b", "법인세비용차감전순이익", 10, 1),
    )
    assert earnings.effective_tax_rate(two).first().tax_expense == 1
    assert earnings.effective_tax_rate(two, prefer="latest").first().tax_expense == 2


def test_tax_movements(statement_rows):
    rows = statement_rows(
        ("BS", "a", "이연법인세자산", 18840559000000, 14236468000000), ("BS", "b", "미지급법인세", 1, None), ("IS", "c", "이연법인세부채", 1, 9),
    )
    got = earnings.tax_movements(rows).collect()
    assert [(r.tax_account_code, r.change_amount, r.sort_amount) for r in got] == [
        ("deferred_tax_asset", 4604091000000, 4604091000000), ("current_tax_liability", None, 1),
    ]


def test_rank_within_is_exact_for_a_dominant_group(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 10 < 8, "big").otherwise("small").alias("g"), (F.col("id") * 7 % 40).alias("v"), "id"
    )
    got = rank_within(rows, ["g"], [F.col("v").desc(), F.col("id").asc()], total="n").collect()
    for group in ("big", "small"):
        mine = sorted((r for r in got if r.g == group), key=lambda r: (-r.v, r.id))
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
        assert {r.n for r in mine} == {len(mine)}


def test_metric_summary_equals_statistics(spark):
    import statistics

    values = [(("g" if i % 3 else "h"), str(i), float((i * 37) % 11)) for i in range(200)] + [("one", "x", 4.0)]
    frame = spark.createDataFrame(values, "metric string, corp_code string, value double")
    for row in peers.metric_summary(frame, ["metric"]).collect():
        mine = [v for m, _, v in values if m == row.metric]
        assert (row["count"], row.min, row.max) == (len(mine), min(mine), max(mine))
        assert row["mean"] == pytest.approx(statistics.mean(mine)) and row["median"] == statistics.median(mine)
        assert row["stdev"] == (pytest.approx(statistics.stdev(mine)) if len(mine) > 1 else None)


def test_peer_table_missing_and_order(spark, statement_rows):
    rows = statement_rows(*BASE, ("BS", "r", "매출채권", 20, 10), ("CF", "r", "유형자산", 30, 10))
    listed = spark.createDataFrame([("126380", "나", 1), ("00126380", "중복", 2), ("1", "가", 3), (" ", "빈", 4)], "corp_code string, corp_name string, o int")
    unique = peers.unique_peers(listed, "o")
    assert sorted(r.corp_code for r in unique.collect()) == ["00000001", "00126380"]
    table = peers.peer_table(unique, ratios.general_ratios(rows), changes.account_changes(rows), with_missing=True)
    got = {r.corp_code: r for r in table.collect()}
    assert got["00126380"].RECEIVABLE_CHANGE == 100.0
    # a row of another statement still counts, with the lowest priority
    assert got["00126380"].PPE_CHANGE == 200.0
    assert [r.corp_code for r in peers.missing_peers(table).collect()] == ["00000001"]
    ordered = peers.sort_peers(table.withColumn("bsns_year", F.lit("2025")).withColumn("reprt_code", F.lit("1")).withColumn("fs_div", F.lit("CFS")), "ROA", True)
    assert [r.corp_code for r in ordered.collect()] == ["00126380", "00000001"]
    with pytest.raises(ValueError):
        peers.sort_peers(table, "nothing")
