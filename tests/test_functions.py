import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import amounts, formats, text


def evaluate(spark, value, function, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(function("v").alias("r")).first().r


@pytest.mark.parametrize("raw, expected", [
    ("1,234,567", 1234567), ("-1,234", -1234), ("(1,234)", -1234), (None, None), ("", None), (" ", None), ("-", None),
    ("－", None), ("　7 ", 7),
])
def test_parse_amount(spark, raw, expected):
    assert evaluate(spark, raw, amounts.parse_amount) == expected
    assert evaluate(spark, raw, lambda c: F.coalesce(amounts.amount_is_bad(c), F.lit(False))) is False


@pytest.mark.parametrize("raw", ["금액없음", "1.5", "((3))", "99999999999999999999"])
def test_bad_amounts_are_flagged(spark, raw):
    assert evaluate(spark, raw, amounts.parse_amount) is None
    assert evaluate(spark, raw, amounts.amount_is_bad) is True


@pytest.mark.parametrize("raw, expected", [
    ("I. 유형자산", "유형자산"), ("Ⅱ. 매출채권", "매출채권"), ("(1) 재고 자산", "재고자산"), ("①현금", "현금"), ("가. 예금", "예금"),
    ("매출액(A)", "매출액(A)"), ("1. 2. x", "2.x"), (None, ""), ("매출　액 ", "매출액"), ("영업이익(손실)", "영업이익(손실)"),
])
def test_account_label(spark, raw, expected):
    assert evaluate(spark, raw, text.account_label) == expected
    if raw is not None:
        assert text.plain_label(raw) == expected


@pytest.mark.parametrize("row, current, other", [
    (("ifrs-full_NoncurrentReceivables", "매출채권", ""), 2, 0),
    (("ifrs-full_CurrentReceivables", "매출채권", ""), 0, 2),
    (("x", "비유동자산", ""), 2, 0), (("x", "단기매출채권", None), 0, 2), (("x_non-current", "자산", ""), 2, 0), ((None, "자산", None), 1, 1),
])
def test_scope_rank(spark, row, current, other):
    frame = spark.createDataFrame([row], "a string, b string, c string")
    got = frame.select(text.scope_rank("a", "b", "c").alias("x"), text.scope_rank("a", "b", "c", False).alias("y")).first()
    assert (got.x, got.y) == (current, other)


@pytest.mark.parametrize("raw, expected", [("126380", "00126380"), (" 1 ", "00000001"), ("123456789", "123456789"), ("", "")])
def test_corp_key_pads_but_never_cuts(spark, raw, expected):
    assert evaluate(spark, raw, text.corp_key) == expected


@pytest.mark.parametrize("current, previous, amount, rate", [
    (1200, 1000, 200, 20.0), (800, 1000, -200, -20.0), (1000, 0, 1000, None), (None, 1000, None, None), (50, -100, 150, 150.0),
    (566942110000000, 514531948000000, 52410162000000, 10.19), (0, 608281000000, -608281000000, -100.0), (0, 0, 0, None),
])
def test_change(spark, current, previous, amount, rate):
    frame = spark.createDataFrame([(current, previous)], "c bigint, p bigint")
    got = frame.select(
        amounts.change_amount(F.col("c"), F.col("p")).alias("a"), F.round(amounts.change_rate(F.col("c"), F.col("p")), 2).alias("r")
    ).first()
    assert (got.a, got.r) == (amount, rate)


def test_formats(spark):
    frame = spark.createDataFrame([(-1234567, 1234.5, "20250131", " 연결재무제표", "Q1")], "a bigint, r double, d string, s string, p string")
    got = frame.select(
        formats.amount_text("a"), formats.signed_amount_text("a"), formats.signed_rate_text("r"), formats.dashed_date("d"),
        formats.resolve_alias("s", formats.SCOPE_ALIASES), formats.resolve_alias("p", formats.REPORT_ALIASES),
        formats.ratio_text("r", F.lit("percentage")), formats.ratio_text("r", F.lit("turnover")), formats.ratio_text("r", F.lit("days")),
        formats.ratio_text(F.lit(None).cast("double"), F.lit("days")),
    ).first()
    assert tuple(got) == (
        "-1,234,567", "-1,234,567", "+1234.50%", "2025-01-31", "CFS", "11013", "1,234.50%", "1234.50회", "1234.50일", "-",
    )


def test_xbrl_names(spark):
    frame = spark.createDataFrame([("x.xsd#entity00126380_Custom_Tax", "ifrs-full:A:B", "{http://n}Name")], "h string, q string, c string")
    got = frame.select(
        text.after_hash("h"), text.local_name_of_concept(text.after_hash("h")), text.local_name_of_qname("q"),
        text.local_name_of_clark("c"), text.after_hash(F.lit("none")), text.after_hash(F.lit("none"), keep_whole=True),
    ).first()
    assert tuple(got) == ("entity00126380_Custom_Tax", "Custom_Tax", "A:B", "Name", "", "none")


def test_exact_numbers_equal_decimals_of_any_length(spark):
    from decimal import Decimal, localcontext

    texts = [
        "0", "-0", "0.000", "1", "-1", "10", "100.00", "-12.340", "1e5", "-2.5E-7", "+00012", ".5", "5.", "9" * 35 + "." + "1" * 25,
        "-" + "9" * 35 + "." + "1" * 25, "123456789012345678901234567890123456789", "1e-30", "-1e-30", "99.9", "-99.9", "-100", "1E+40",
    ]
    rows = [(t,) for t in texts] + [(t,) for t in ("", "-", ".", "x", "1x", "1e", "1,000", None, "--1", "e5", "nan")]
    n = amounts.exact_number("t")
    got = spark.createDataFrame(rows, "t string").select("t", n.alias("n"), amounts.plain_number(n).alias("plain")).collect()
    found = {r.t: r for r in got}
    assert all(found[t].n is None and found[t].plain is None for (t,) in rows[len(texts):])
    with localcontext() as context:
        context.prec = 200
        for t in texts:
            value, r = Decimal(t), found[t]
            assert Decimal(r.plain) == value and Decimal(("-" if r.n.negative else "") + r.n.digits).scaleb(-r.n.scale) == value, t
            assert r.n.digits == "0" or r.n.digits.strip("0") == r.n.digits, t
        ordered = sorted(texts, key=lambda t: found[t].n.sort_key)
        assert [Decimal(t) for t in ordered] == sorted(map(Decimal, texts))
