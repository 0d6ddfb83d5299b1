from pyspark.sql import functions as F

from ledgerloom.documents import markup, opinion, reports
from ledgerloom.plans import jobs


def sections(spark, html):
    frame = spark.createDataFrame([("d", f"<html><body>{html}</body></html>")], "doc_id string, html string")
    return reports.sections_of(reports.parse(frame)).first()


END = "<p>재무제표감사에 대한 감사인의 책임</p><p>끝</p>"


def test_opinion_kinds(spark):
    cases = {
        "<p>감사의견</p><p>우리의 의견으로는 공정하게 표시하고 있습니다</p><p>감사의견근거</p><p>근거</p>": "적정의견",
        "<p>한정의견</p><p>본문</p>": "한정의견",
        "<p>감사의견</p><p>공정하게 표시하고 있지 않습니다 영향을 제외하고는</p>": "부적정의견",
        "<p>감사의견</p><p>본문</p><p>의견 거절 근거</p><p>x</p>": "의견거절",
        "<p>감사의견</p><p>영향을 제외하고는</p>": "한정의견",
    }
    for html, kind in cases.items():
        got = sections(spark, html + END).opinion
        assert (got.status, got.opinion_type) == ("ok", kind)
    assert sections(spark, "<p>감사의견</p><p>본문</p>").opinion.status == "not_full_report"
    assert sections(spark, END).opinion.status == "no_opinion_heading"
    assert sections(spark, "<p>감사의견</p>" + END).opinion.status == "no_opinion_text"


def test_split_heading_nested_blocks_and_reasons(spark):
    html = (
        "<div><p>의견거절</p><p>의견을 <b>표명하지</b> 않습니다</p></div><p><span>의견거절의</span> <span>근거</span></p>"
        "<p>서문 (1) 계속기업 회사는 손실 2) 자료 당사의 한계</p>"
    )
    got = sections(spark, html + END).opinion
    assert got.opinion_text == "의견을 표명하지 않습니다"
    assert got.basis_heading == "의견거절근거"
    assert got.reasons == ["근거\n\n서문", "계속기업 회사는 손실", "자료 당사의 한계"]
    parts = spark.createDataFrame([("계속기업 회사는 손실",), ("회사는 손실",), ("제목뿐",), ("😀 제목 2024년 본문",)], "r string")
    split = [tuple(r.x) for r in parts.select(opinion.split_reason_title(F.col("r")).alias("x")).collect()]
    assert split == [("계속기업", "회사는 손실"), ("회사는 손실", ""), ("제목뿐", ""), ("😀 제목", "2024년 본문")]


def test_key_audit_matters(spark):
    html = (
        "<p>핵심감사사항</p><p>서론</p><p><b>수익 인식</b></p><p>내용</p><p><b>감사인의 대응</b></p><p>절차</p>"
        "<p>2) 둘째</p><p>다른</p><p><b>빈 항목</b></p>"
    )
    got = sections(spark, html + END).key_audit_matters
    assert got.introduction == "서론"
    assert [(m.title, m.text) for m in got.matters] == [("수익 인식", "내용\n\n감사인의 대응\n\n절차"), ("2) 둘째", "다른")]
    plain = sections(spark, "<p>핵심 감사사항</p><p>한 문단</p>" + END).key_audit_matters
    assert [(m.title, m.text) for m in plain.matters] == [(None, "한 문단")] and plain.introduction is None
    assert sections(spark, END).key_audit_matters is None


def test_emphasis_and_other_matter(spark):
    contents = "<p>강조사항</p><p>기타사항</p><p>감사의견</p>"
    got = sections(spark, contents + "<p>강조사항: 주석 1 참조. 기타사항 다음</p><p>(1) 기타 사항</p><p>전기 감사</p>" + END)
    assert (got.emphasis.heading, got.emphasis.text) == ("강조사항", "주석 1 참조.")
    assert (got.other_matter.heading, got.other_matter.text) == ("(1) 기타 사항", "전기 감사")
    mention = sections(spark, "<p>강조사항</p><p>본문은 기타사항 과 무관</p>" + END)
    assert mention.emphasis.text == "본문은 기타사항 과 무관" and mention.other_matter is None
    assert sections(spark, "<p>기타사항 본문</p>" + END).other_matter is None


def test_going_concern(spark):
    heading = "계속기업 관련 중요한 불확실성"
    plain = sections(spark, f"<p>감사의견</p><p>x</p><p>강조사항</p><p>{heading}</p><p>본문 감사인의 책임 뒤</p>").going_concern
    assert (plain.heading, plain.text) == (heading, "본문")
    assert sections(spark, f"<p>감사의견</p><p>{heading}</p><p>본문</p>").going_concern is None
    excluded = f"<p>의견거절근거</p><p>(1) {heading}</p><p>강조사항</p><p>{heading}</p><p>본문</p>"
    assert sections(spark, excluded).going_concern is None
    bold = f'<p>감사의견 x <span style="font-weight: 700">{heading}</span> 본문 <i>계속</i> <b>강조사항</b> 뒤</p>'
    assert sections(spark, bold).going_concern.text == "본문\n\n계속"


def test_markup_helpers(spark):
    frame = spark.createDataFrame(
        [(bytearray("한글".encode("cp949")), "text/html"), (bytearray("한글".encode()), "text/html; charset=nope"), (bytearray(b"\xff\x80\xff"), None)],
        "content binary, type string",
    )
    assert [r[0] for r in frame.select(markup.decode_bytes("content", "type")).collect()] == ["한글", "한글", "���"]
    page = spark.createDataFrame([("<p>a&nbsp;&lt;b&#44;</p><script>x<y</script> c",)], "h string")
    assert page.select(markup.html_text("h")).first()[0] == "a <b, c"


def test_document_kind(spark):
    full = "감사의견 감사인의 책임"
    frame = spark.createDataFrame([("연결 감사보고서", full), ("분기보고서", full), ("기타", full), ("감사보고서", "요약")], "n string, t string")
    assert [r[0] for r in frame.select(reports.document_kind("n", "t")).collect()] == ["audit_report", "business_report", "unknown", "unknown"]


def test_a_document_is_one_row(spark):
    rows = spark.range(25).select(F.lit("r").alias("rcept_no"), (F.col("id") * 1000).alias("ele_id"), F.lit("u").alias("url"),
                                  F.concat(F.lit("<body>"), F.col("id").cast("string"), F.lit("</body>")).alias("html"), F.lit("t").alias("title"))
    documents = reports.with_file_name(reports.assemble(rows, ["rcept_no"])).collect()
    assert [(d.file_name, d.html.count("<section")) for d in documents] == [("r_t.html", 25)]
    assert documents[0].html.index(">\n9\n<") < documents[0].html.index(">\n10\n<")


def test_a_heading_may_hold_any_number_of_blanks(spark):
    heading = "<b>계속기업 가정에 대한" + " " * 210 + "중요한 불확실성</b>"
    frame = spark.createDataFrame([("d", f"<p>{heading} 본문</p>" + END)], "doc_id string, html string")
    assert reports.sections_of(reports.parse(frame)).first().going_concern.text == "본문"


def test_audit_report_job(spark):
    filings = spark.createDataFrame(
        [("c1", "감사보고서제출", "20260101000001", "20260101", 1), ("c1", "감사보고서제출", "20260201000001", "20260201", 2), ("c2", "사업보고서", "20260301000001", "20260301", 3)],
        "corp_code string, report_nm string, rcept_no string, rcept_dt string, ordinal int",
    )
    attachments = spark.createDataFrame(
        [("20260201000001", "7", "감사보고서", 1), ("20260201000001", "8", "연결감사보고서", 2)], "rcept_no string, dcm_no string, title string, ordinal int"
    )
    pieces = [("20260201000001", "8", 2, "u", END), ("20260201000001", "8", 1, "u", "<p>감사의견</p><p>본문</p>"), ("20260201000001", "7", 1, "u", "<p>x</p>")]
    fragments = spark.createDataFrame(pieces, "rcept_no string, dcm_no string, ele_id int, url string, html string")
    got = {r.corp_code: r for r in jobs.audit_reports(filings, attachments, fragments, "ordinal").collect()}
    assert got["c1"].status == "ok" and got["c1"].opinion.opinion_text == "본문" and got["c1"].dcm_no == "8"
    assert got["c2"].status == "no_attachment"


def test_nested_blocks_count_twice_unless_leaf_only(spark):
    html = "<div>강조사항</div><div><p>하나</p><p>둘</p></div>" + END
    frame = spark.createDataFrame([("d", html)], "doc_id string, html string")
    assert reports.sections_of(reports.parse(frame)).first().emphasis.text == "하나 둘\n\n하나\n\n둘"
    assert reports.sections_of(reports.parse(frame), leaf_only=True).first().emphasis.text == "하나\n\n둘"


def test_sections_of_the_latest_report_stay_in_its_row(spark):
    filed = [("c1", "감사보고서", "20260311", "r1", 1), ("c1", "감사보고서", "20260401", "r2", 2), ("c2", "감사보고서", "20260311", "r3", 3),
             ("c3", "감사보고서", "20260311", "r4", 4), ("c4", "감사보고서", "20260311", "r5", 5)]
    disclosures = spark.createDataFrame(filed, "corp_code string, report_nm string, rcept_dt string, rcept_no string, ordinal bigint")
    attached = [(r, "9", "감사보고서", 1) for r in ("r1", "r2", "r3", "r5")]
    attachments = spark.createDataFrame(attached, "rcept_no string, dcm_no string, title string, ordinal bigint")
    body = "<p>감사의견</p><p>본문</p>"
    landed = [("r1", "9", 1, "/u", body + END), ("r2", "9", 2, "/u", END), ("r2", "9", 1, "/u", body), ("r5", "9", 1, "/u", None), ("r4", "9", 1, "/u", body)]
    fragments = spark.createDataFrame(landed, "rcept_no string, dcm_no string, ele_id int, url string, html string")
    found = jobs.audit_reports(disclosures, attachments, fragments, "ordinal")
    rows = {r.corp_code: (r.rcept_no, r.dcm_no, r.title, r.status, r.is_full_report, r.opinion and r.opinion.opinion_type) for r in found.collect()}
    assert rows == {
        "c1": ("r2", "9", "감사보고서", "ok", True, "적정의견"), "c2": ("r3", None, None, "no_fragments", None, None),
        "c3": ("r4", None, None, "no_attachment", None, None), "c4": ("r5", "9", "감사보고서", "not_full_report", False, None),
    }
    # nothing is exchanged after the parse
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString().split("ArrowEvalPython")[0]
