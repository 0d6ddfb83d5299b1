"""Queries over documents: a report corpus built from ``documents`` with known answers, and the given pages.

Each document's whole text, escaped line by line, becomes the paragraphs of an audit report whose sections
vary with the document number. The oracles compute the expected sections from number and text alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import star
from ledgerloom.documents import files, markup, opinion, reports
from ledgerloom.documents.going_concern import going_concern
from ledgerloom.documents.kam import key_audit_matters
from ledgerloom.documents.sections import EMPHASIS, OTHER_MATTER, extract_section
from ledgerloom.functions.nested import let
from ledgerloom.functions.text import collapse, normalise_charset_tag, padded_number
from ledgerloom.operators.select import with_once
from ledgerloom.plans import jobs
from ledgerloom.session import scratch_folder, spread
from ledgerloom.sources import viewer

_KIND_HEADINGS = ("감사의견", "한정의견", "부적정의견", "의견거절")
_BASIS_HEADINGS = ("감사의견근거", "한정의견 근거", "부적정의견근거", "의견거절 근거")
_SENTENCES = (
    "우리의 의견으로는 재무제표는 공정하게 표시하고 있습니다",
    "영향을 제외하고는 공정하게 표시하고 있습니다",
    "공정하게 표시하고 있지 않습니다",
    "의견을 표명하지 않습니다",
)


def _p(*parts) -> Column:
    return F.concat(F.lit("<p>"), *[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("</p>"))


def _pick(index: Column, choices) -> Column:
    """Only the choice taken is computed; the elements of an array would be computed all."""
    first, *others = choices
    picked = F.when(index == 0, first)
    for number, choice in enumerate(others, start=1):
        picked = picked.when(index == number, choice)
    return picked


def report_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, title, html)``: one audit report per document."""
    doc = F.col("doc_id")
    lines = F.filter(F.transform(F.split("text", "\n"), lambda t: reports.escape_html(collapse(t))), lambda t: t != "")
    rows = spread(star.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select(
        "doc_id", let(lines, lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("body")))).alias("lines")
    )
    flat = F.array_join("lines", " ")
    paragraphs = F.concat(F.lit("<p>"), F.array_join("lines", "</p><p>"), F.lit("</p>"))
    full = doc % 11 != 10
    concern = F.when(full, doc % 7).otherwise(0)
    kind = (doc % 4).cast("int")
    sentence = F.when(doc % 16 == 8, _SENTENCES[3]).otherwise(_pick(kind, _SENTENCES))
    basis_kind = F.when(doc % 8 == 4, 1).otherwise(kind)
    split = (doc % 5 == 2) & (concern != 4)
    basis_heading = F.when(
        split, _p("<span>", _pick(basis_kind, _KIND_HEADINGS), "의</span> <span>근거</span>")
    ).otherwise(_p(_pick(basis_kind, _BASIS_HEADINGS)))
    kam = _pick(
        doc % 6,
        [
            "",
            F.concat(_p("핵심감사사항"), _p("서론"), _p("<b>Matter one</b>"), paragraphs),
            F.concat(
                _p("핵심감사사항"), _p("<b>Matter A</b>"), paragraphs, _p("<b>감사인의 대응</b>"), _p("response"),
                _p('<span style="font-weight: bold">Matter B</span>'), _p("2) Matter C"), paragraphs,
            ),
            F.concat(_p("핵심 감사사항(Key Audit Matters)"), paragraphs),
            "<div><p>핵심감사사항</p></div><div><p>one</p><p>two</p></div>",
            "<p>핵심감사사항</p>",
        ],
    )
    emphasis = _pick(
        doc % 5,
        [
            "",
            _p("강조사항: ", flat),
            F.concat(_p("강조사항"), paragraphs, _p("마지막 문장입니다. 기타사항")),
            F.concat(_p("강조 사항(주석 참조)"), paragraphs),
            _p("강조사항 ", flat),
        ],
    )
    other = _pick(doc % 4, ["", F.concat(_p("기타사항"), paragraphs), _p("기타사항 - ", flat), _p("기타사항 ", flat)])
    standalone = F.concat(_p("계속기업 관련 중요한 불확실성"), paragraphs)
    concern_section = _pick(
        concern,
        [
            "",
            standalone,
            _p("계속기업과 관련된 중요한 불확실성: ", flat),
            _p(
                '<span style="font-weight:bold">계속기업 가정에 대한 중요한 불확실성</span>', flat,
                " <b>강조사항</b> tail",
            ),
            standalone,
            "<p>계속기업 관련 중요한 불확실성</p>",
            "",
        ],
    )
    html = F.concat(
        F.lit("<html><head><script>var p = '<p>감사의견</p>';</script></head><body>"),
        F.when(doc % 3 == 0, "<p>강조사항</p><p>기타사항</p><p>감사의견</p>").otherwise(""),
        F.lit("<p>독립된 감사인의 감사보고서</p>"),
        _p(_pick(kind, _KIND_HEADINGS)),
        _p(sentence),
        paragraphs,
        basis_heading,
        _p("근거 서문 (1) 첫째 ", flat, " (2) 둘째 사유 회사는 ", flat),
        F.when(concern == 4, "<p>계속기업 관련 중요한 불확실성 참조</p>").otherwise(""),
        F.when(full, "<p>경영진의 책임</p><p>책임 본문</p>").otherwise(""),
        kam,
        emphasis,
        other,
        F.when(full, "<p>재무제표에 대한 경영진과 지배기구의 책임</p><p>지배 본문</p>").otherwise(""),
        concern_section,
        F.when(full, "<p>재무제표감사에 대한 감사인의 책임</p><p>끝 본문</p>").otherwise(""),
        F.lit("</body></html>"),
    )
    title = F.when(doc % 9 == 0, "사업보고서").when(doc % 9 == 1, "기타 문서").otherwise("감사 보고서")
    return rows.select("doc_id", title.alias("title"), html.alias("html"))


_CASES = " ".join(f"when {i} then '{s}'" for i, s in enumerate(_SENTENCES))
_HEADS = " ".join(f"when {i} then '{s}'" for i, s in enumerate(_KIND_HEADINGS))
CORPUS = rf"""
with l as (
  select doc_id, list_filter(list_transform(string_split(text, chr(10)),
    lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') as ls
  from documents),
d as (
  select doc_id, case when len(ls) = 0 then 'body' else array_to_string(ls, chr(10) || chr(10)) end as j,
    case when len(ls) = 0 then 'body' else array_to_string(ls, ' ') end as f,
    doc_id % 11 <> 10 as full_report, case when doc_id % 11 <> 10 then doc_id % 7 else 0 end as g,
    case when doc_id % 8 = 4 then 1 else doc_id % 4 end as bk, chr(10) || chr(10) as nn
  from l),
o as (
  select *, case doc_id % 4 {_HEADS} end as heading, case bk {_HEADS} end || '근거' as basis_heading,
    case when doc_id % 16 = 8 then '{_SENTENCES[3]}' else case doc_id % 4 {_CASES} end end || nn || j as opinion_text,
    case when doc_id % 4 > 0 then case doc_id % 4 {_HEADS} end when doc_id % 8 = 4 then '한정의견'
      when doc_id % 16 = 8 then '의견거절' else '적정의견' end as opinion_type,
    case when doc_id % 5 = 2 and g <> 4 then '근거' || nn else '' end || '근거 서문' as preface,
    '첫째 ' || f as reason_1, '둘째 사유 회사는 ' || f || case when g = 4 then nn || '계속기업 관련 중요한 불확실성 참조' else '' end as reason_2
  from d),
m as (
  select doc_id, list_filter(list_transform(string_split(
    regexp_replace(preface || ' (1) ' || reason_1 || ' (2) ' || reason_2, '(^|\s)({opinion.REASON_NUMBER})', '\1' || chr(1) || '\2', 'g'), chr(1)),
    lambda x: trim(regexp_replace(trim(x, ' ' || chr(10)), '^(?:{opinion.REASON_NUMBER})\s*', ''), ' ' || chr(10))), lambda x: x <> '') as reasons
  from o where full_report and opinion_type <> '적정의견')"""


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.parse(report_corpus(spark, sf_dir), keep=("doc_id", "title"))


def opinion_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = _parsed(spark, sf_dir)
    return parsed.select(
        "doc_id",
        reports.document_kind("title", "doc.text").alias("document_kind"),
        reports.is_report_body("doc.text").alias("is_report_body"),
        opinion.opinion(F.col("doc.text"), F.col("doc.units")).alias("o"),
    ).select(
        "doc_id", "document_kind", "is_report_body", "o.status", "o.opinion_type", "o.heading", "o.opinion_text",
        "o.basis_heading", "o.basis_text",
    )


OPINION_CLASSIFY = CORPUS + """
select doc_id, case when not full_report or doc_id % 9 = 1 then 'unknown' when doc_id % 9 = 0 then 'business_report' else 'audit_report' end as document_kind,
  full_report or doc_id % 4 = 0 or doc_id % 3 = 0 as is_report_body, case when full_report then 'ok' else 'not_full_report' end as status,
  case when full_report then opinion_type end as opinion_type, case when full_report then heading end as heading,
  case when full_report then opinion_text end as opinion_text, case when full_report then basis_heading end as basis_heading,
  case when full_report then preface || ' (1) ' || reason_1 || ' (2) ' || reason_2 end as basis_text
from o"""


def reason_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per reason of a modified opinion, split into title and body."""
    found = _parsed(spark, sf_dir).select("doc_id", opinion.opinion(F.col("doc.text"), F.col("doc.units")).alias("o"))
    reasons = found.select("doc_id", F.posexplode_outer("o.reasons").alias("position", "reason"))
    reasons = reasons.filter(F.col("position").isNotNull())
    return reasons.select("doc_id", "position", "reason", opinion.split_reason_title(F.col("reason")).alias("r")).select(
        "doc_id", "position", "reason", "r.title", "r.body"
    )


REASON_SPLIT = CORPUS + """,
r as (select doc_id, unnest(reasons) as reason, generate_subscripts(reasons, 1) as i from m),
t as (select *, replace(reason, chr(10) || chr(10), ' ') as line, strpos(replace(reason, chr(10) || chr(10), ' '), '회사는') as place from r)
select doc_id, (i - 1)::int as position, reason, case when place > 1 then trim(line[:place - 1]) else line end as title,
  case when place > 1 then trim(line[place:]) else '' end as body
from t"""


def kam_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_once(_parsed(spark, sf_dir), "k", key_audit_matters(F.col("doc.blocks")))
    present = found.filter(F.col("k").isNotNull())
    return present.select(
        "doc_id", "k.heading", "k.introduction", F.posexplode_outer("k.matters").alias("position", "matter")
    ).select("doc_id", "heading", "introduction", "position", "matter.title", "matter.text")


KAM_ITEMS = CORPUS + """
select doc_id, '핵심감사사항' as heading, '서론' as introduction, 0::int as position, 'Matter one' as title, j as text from d where doc_id % 6 = 1
union all
select doc_id, '핵심감사사항', null, 0, 'Matter A', j || nn || '감사인의 대응' || nn || 'response' from d where doc_id % 6 = 2
union all
select doc_id, '핵심감사사항', null, 1, '2) Matter C', j from d where doc_id % 6 = 2
union all
select doc_id, '핵심 감사사항(Key Audit Matters)', null, 0, null, j from d where doc_id % 6 = 3
union all
select doc_id, '핵심감사사항', null, 0, null, 'one two' || nn || 'one' || nn || 'two' from d where doc_id % 6 = 4
union all
select doc_id, '핵심감사사항', null, null, null, null from d where doc_id % 6 = 5"""


def section_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _parsed(spark, sf_dir).select(
        "doc_id",
        F.array(
            F.struct(F.lit("emphasis").alias("section"), extract_section(F.col("doc.blocks"), EMPHASIS).alias("found")),
            F.struct(F.lit("other_matter").alias("section"), extract_section(F.col("doc.blocks"), OTHER_MATTER).alias("found")),
        ).alias("sections"),
    )
    return found.select("doc_id", F.inline_outer("sections")).filter(F.col("found").isNotNull()).select(
        "doc_id", "section", "found.heading", "found.text"
    )


SECTION_EXTRACT = CORPUS + """
select doc_id, 'emphasis' as section, case doc_id % 5 when 3 then '강조 사항(주석 참조)' else '강조사항' end as heading,
  case doc_id % 5 when 1 then f when 4 then f when 2 then j || nn || '마지막 문장입니다.' else j end as text
from d where doc_id % 5 > 0
union all
select doc_id, 'other_matter', '기타사항', case doc_id % 4 when 1 then j else f end from d where doc_id % 4 in (1, 2)"""


def going_concern_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_once(
        _parsed(spark, sf_dir), "found", going_concern(F.col("doc.blocks"), F.col("doc.inline"))
    )
    return found.filter(F.col("found").isNotNull()).select("doc_id", "found.heading", "found.text")


GOING_CONCERN = CORPUS + """
select doc_id, case g when 2 then '계속기업과 관련된 중요한 불확실성' when 3 then '계속기업 가정에 대한 중요한 불확실성'
  else '계속기업 관련 중요한 불확실성' end as heading, case when g in (2, 3) then f else j end as text
from d where g in (1, 2, 3) or (g = 4 and bk = 0)"""


def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sections of every report, parsed once."""
    s = reports.sections_of(_parsed(spark, sf_dir))
    return s.select(
        "doc_id",
        "is_full_report",
        F.col("opinion.status").alias("status"),
        F.col("opinion.opinion_type").alias("opinion_type"),
        F.size("opinion.reasons").alias("reason_count"),
        F.coalesce(F.size("key_audit_matters.matters"), F.lit(-1)).alias("matter_count"),
        F.length("emphasis.text").alias("emphasis_chars"),
        F.length("other_matter.text").alias("other_matter_chars"),
        F.length("going_concern.text").alias("going_concern_chars"),
    )


AUDIT_SUMMARY = CORPUS + """
select doc_id, full_report as is_full_report, case when full_report then 'ok' else 'not_full_report' end as status,
  case when full_report then opinion_type end as opinion_type,
  coalesce((select len(reasons) from m where m.doc_id = o.doc_id), 0)::int as reason_count,
  (case doc_id % 6 when 0 then -1 when 2 then 2 when 5 then 0 else 1 end)::int as matter_count,
  (case doc_id % 5 when 0 then null when 2 then length(j) + 12 when 3 then length(j) else length(f) end)::int as emphasis_chars,
  (case doc_id % 4 when 1 then length(j) when 2 then length(f) end)::int as other_matter_chars,
  (case when g in (2, 3) then length(f) when g = 1 or (g = 4 and bk = 0) then length(j) end)::int as going_concern_chars
from o"""


# ---- given pages and conversations ---------------------------------------------------------------
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = reports.parse(spread(star.table(spark, sf_dir, "pages").select("page_id", "html"), "page_id"), keep=("page_id",))
    return pages.select("page_id", F.posexplode("doc.blocks").alias("position", "block")).select(
        "page_id", "position", "block.tag", "block.text", "block.bold", "block.leaf"
    )


_BLOCK_TAGS = ("p", "li", "td", "h3")


def shared_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as blocks of pages; each block with the number of documents that show its text and the first."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda t: reports.escape_html(collapse(t))), lambda t: t != "")
    opened = lambda i: F.element_at(F.array(*[F.lit(t) for t in _BLOCK_TAGS]), (i % len(_BLOCK_TAGS) + 1).cast("int"))
    body = F.array_join(F.transform(lines, lambda t, i: F.concat(F.lit("<"), opened(i), F.lit("> "), t, F.lit(" </"), opened(i), F.lit(">\n"))), "")
    pages = spread(star.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select(
        "doc_id", F.concat(F.lit("<html><body><script>var x = '<p>no</p>';</script>"), body, F.lit("</body></html>")).alias("html"))
    blocks = reports.parse(pages, keep=("doc_id",)).select("doc_id", F.posexplode("doc.blocks").alias("position", "b")).select(
        "doc_id", "position", "b.tag", "b.text")
    shown = blocks.select("doc_id", F.col("text").alias("shown")).distinct().groupBy("shown").agg(
        F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first_doc"))
    return blocks.join(shown, F.col("text") == F.col("shown")).groupBy("doc_id", "tag").agg(
        F.count(F.lit(1)).alias("blocks"), F.count_if(F.col("documents") > 1).alias("shared_blocks"),
        F.count_if(F.col("first_doc") < F.col("doc_id")).alias("seen_before"), F.sum(F.length("text")).alias("chars"),
        F.max("position").alias("last_position"),
    )


SHARED_BLOCKS = rf"""
with l as (
  select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') as ls
  from documents),
b as (select doc_id, unnest(ls) as text, generate_subscripts(ls, 1) - 1 as position from l),
t as (select *, ['p', 'li', 'td', 'h3'][position % 4 + 1] as tag from b),
s as (select text, count(distinct doc_id) as documents, min(doc_id) as first_doc from t group by text)
select doc_id, tag, count(*) as blocks, count(*) filter (where documents > 1) as shared_blocks, count(*) filter (where first_doc < doc_id) as seen_before,
  sum(length(t.text))::bigint as chars, max(position)::int as last_position
from t join s using (text) group by doc_id, tag"""


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.table(spark, sf_dir, "pages").select("page_id", markup.html_text("html").alias("text"))


HTML_TEXT = r"""
with t as (
  select page_id, regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g') as text
  from pages)
select page_id, trim(regexp_replace(
  replace(replace(replace(replace(replace(replace(text, '&copy;', '©'), '&quot;', '"'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'),
  '\s+', ' ', 'g')) as text
from t"""


def charset_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the declaration changed, kept or removed, then normalised."""
    key = F.col("page_id")
    declared = F.replace("html", F.lit('<meta charset="utf-8">'), F.element_at(
        F.array(
            F.lit('<META charset=euc-kr>'),
            F.lit(""),
            F.lit('<meta http-equiv="Content-Type" content="text/html">'),
            F.lit("<meta content='text/html; charset=cp949'><meta charset='x'>"),
        ), (key % 4 + 1).cast("int")))
    return star.table(spark, sf_dir, "pages").select("page_id", normalise_charset_tag(declared).alias("html"))


CHARSET_TAG = """
select page_id, case when not contains(html, '<meta charset="utf-8">') then html
  when page_id % 4 = 1 then replace(replace(html, '<meta charset="utf-8">', ''), '<head>', '<head>' || chr(10) || '<meta charset="utf-8">')
  when page_id % 4 = 3 then replace(html, '<meta charset="utf-8">', '<meta charset="utf-8"><meta charset=''x''>') else html end as html
from pages"""


def _cp949(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(lambda text: text.encode("cp949"), na_action="ignore")


def charset_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written in a declared charset, or in an undeclared Korean one, read back from bytes."""
    key = F.col("doc_id")
    # the third of the texts that Latin-1 can hold is written in it; without a declaration the bytes are UTF-8
    latin = (key % 3 == 2) & F.col("text").rlike(r"^[\x00-\xff]*$")
    # of the texts that are ASCII alone, a third gets a Korean beginning
    korean = F.when((key % 3 == 0) & F.col("text").rlike(r"^[\x00-\x7f]*$"), F.concat(F.lit("감사 보고서 "), "text"))
    content = (
        F.when(key % 3 == 1, F.encode("text", "UTF-16BE")).when(latin, F.encode("text", "ISO-8859-1"))
        .when(korean.isNotNull(), F.pandas_udf(_cp949, "binary")(korean)).otherwise(F.encode("text", "UTF-8"))
    )
    declared = (
        F.when(key % 3 == 1, 'text/html; charset="utf-16-be"').when(latin, "text/html;charset=iso-8859-1 ").otherwise("text/html")
    )
    return star.table(spark, sf_dir, "documents").select("doc_id", markup.decode_bytes(content, declared).alias("text"))


CHARSET_DECODE = r"""
select doc_id, case when doc_id % 3 = 0 and regexp_full_match(text, '[\x00-\x7f]*') then '감사 보고서 ' || text else text end as text from documents"""


def assemble_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as fragments of one document each."""
    turn = F.col("turn")
    fragments = star.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("rcept_no"),
        turn.alias("ele_id"),
        F.concat(F.lit("/v?a=1&e="), turn.cast("string")).alias("url"),
        F.when(turn % 2 == 0, F.concat(F.lit("<html><BODY class='x'>"), F.col("text"), F.lit("</body></html>")))
        .otherwise(F.col("text")).alias("html"),
        F.lit("감사보고서 <A/B>").alias("title"),
    )
    return reports.with_file_name(reports.assemble(fragments, ["rcept_no"])).select("rcept_no", "file_name", "html")


ASSEMBLE_FRAGMENTS = """
select conv_id::varchar as rcept_no, conv_id::varchar || '_감사보고서 _A_B_.html' as file_name,
  '<!DOCTYPE html>' || chr(10) || '<html lang="ko">' || chr(10) || '<head>' || chr(10) || '<meta charset="utf-8">' || chr(10) ||
  '<title>감사보고서 &lt;A/B&gt;</title>' || chr(10) || '</head>' || chr(10) || '<body>' || chr(10) ||
  string_agg('<section data-ele-id="' || turn || '" data-source-url="/v?a=1&amp;e=' || turn || '">' || chr(10) || text || chr(10) || '</section>', chr(10) order by turn)
  || chr(10) || '</body>' || chr(10) || '</html>' as html
from conversations group by conv_id"""


def _filed_reports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(disclosures, attachments, fragments): two documents are filings of one company, the later one counts.

    Some have no attachment that is a report or no fragments; a long report comes in two, the later one first.
    """
    doc = F.col("doc_id")
    date = F.when(doc % 2 == 0, "20260311").otherwise("20260401")
    receipt = F.concat(date, padded_number(doc, 6))
    corpus = report_corpus(spark, sf_dir).withColumns({"rcept_no": receipt, "dcm_no": F.concat(F.lit("9"), doc.cast("string"))})
    ids = star.table(spark, sf_dir, "documents").select("doc_id").withColumns({"rcept_no": receipt, "dcm_no": F.concat(F.lit("9"), doc.cast("string"))})
    listed = ids.select(
        padded_number(F.floor(doc / 2), 8).alias("corp_code"), F.lit("감사 보고서 제출").alias("report_nm"), date.alias("rcept_dt"),
        "rcept_no", F.col("doc_id").alias("ordinal"),
    )
    titles = F.filter(F.array(
        F.struct(F.lit("1").alias("dcm_no"), F.lit("영문감사보고서").alias("title")),
        F.struct(F.col("dcm_no").alias("dcm_no"), F.when(doc % 3 == 0, "(정정)  연결감사보고서").otherwise("감사보고서").alias("title")),
        F.struct(F.lit("3").alias("dcm_no"), F.lit("정관").alias("title")),
    ), lambda t: (doc % 13 != 5) | (t["dcm_no"] != F.col("dcm_no")))
    attached = ids.select("rcept_no", F.posexplode(titles).alias("ordinal", "t")).select("rcept_no", "t.*", "ordinal")
    cut = F.instr("html", "<p>경영진의 책임</p>")
    two = F.array(
        F.struct(F.lit(7).alias("ele_id"), F.expr("substr(html, cut)").alias("html")),
        F.struct(F.lit(3).alias("ele_id"), F.concat(F.expr("substr(html, 1, cut - 1)"), F.lit("</body></html>")).alias("html")),
    )
    one = F.array(F.struct(F.lit(3).alias("ele_id"), F.col("html").alias("html")))
    fragments = corpus.where("doc_id % 17 <> 3").withColumn("cut", cut).select(
        "rcept_no", "dcm_no", F.inline(F.when(F.col("cut") > 0, two).otherwise(one)), F.lit("/report/viewer.do").alias("url"))
    return listed, attached, fragments


def audit_report_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the filing list to the sections of the latest audit report of every company."""
    found = jobs.audit_reports(*_filed_reports(spark, sf_dir), "ordinal")
    return found.select(
        "corp_code", "bsns_year", "rcept_no", "dcm_no", "title", "status", F.col("opinion.opinion_type").alias("opinion_type"),
        F.size("opinion.reasons").alias("reason_count"), F.size("key_audit_matters.matters").alias("matter_count"),
        F.length("emphasis.text").alias("emphasis_chars"), F.length("other_matter.text").alias("other_matter_chars"),
        F.length("going_concern.text").alias("going_concern_chars"),
    )


AUDIT_REPORT_LATEST = CORPUS + """,
latest as (select *, doc_id // 2 as corp from o qualify row_number() over (partition by doc_id // 2 order by doc_id desc) = 1),
s as (select *, case when doc_id % 13 = 5 then 'no_attachment' when doc_id % 17 = 3 then 'no_fragments' when full_report then 'ok' else 'not_full_report' end as st from latest)
select lpad(corp::varchar, greatest(8, length(corp::varchar))::int, '0') as corp_code, '2025' as bsns_year,
  case when doc_id % 2 = 0 then '20260311' else '20260401' end || lpad(doc_id::varchar, greatest(6, length(doc_id::varchar))::int, '0') as rcept_no,
  case when st in ('ok', 'not_full_report') then '9' || doc_id end as dcm_no,
  case when st in ('ok', 'not_full_report') then case when doc_id % 3 = 0 then '연결감사보고서' else '감사보고서' end end as title,
  st as status, case when st = 'ok' then opinion_type end as opinion_type,
  case when st in ('ok', 'not_full_report') then coalesce((select len(reasons) from m where m.doc_id = s.doc_id), 0) end::int as reason_count,
  case when st in ('ok', 'not_full_report') then case doc_id % 6 when 0 then null when 2 then 2 when 5 then 0 else 1 end end::int as matter_count,
  case when st in ('ok', 'not_full_report') then case doc_id % 5 when 0 then null when 2 then length(j) + 12 when 3 then length(j) else length(f) end end::int as emphasis_chars,
  case when st in ('ok', 'not_full_report') then case doc_id % 4 when 1 then length(j) when 2 then length(f) end end::int as other_matter_chars,
  case when st in ('ok', 'not_full_report') then case when g in (2, 3) then length(f) when g = 1 or (g = 4 and bk = 0) then length(j) end end::int as going_concern_chars
from s"""


def assembled_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assembled documents written as files and read back by their manifest."""
    manifest = files.write_documents(assemble_fragments(spark, sf_dir), scratch_folder(spark, "documents"))
    read = files.read_documents(manifest)
    return read.join(manifest.select("rcept_no", "n_bytes"), "rcept_no").select("rcept_no", "file_name", "n_bytes", F.sha2("html", 256).alias("sha256"))


ASSEMBLED_FILES = f"""
with a as ({ASSEMBLE_FRAGMENTS})
select rcept_no, file_name, octet_length(encode(html)) as n_bytes, sha256(html) as sha256 from a"""


SHORT_LINE = 40


def section_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document grouped under the last short line before them, inside the row."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda t: F.trim(t)), lambda t: t != "")
    units = F.transform(
        lines,
        lambda t, i: F.struct(
            t.alias("text"), i.alias("block"), F.when(F.length(t) <= SHORT_LINE, t).alias("heading")
        ),
    )
    rows = star.table(spark, sf_dir, "documents").select("doc_id", units.alias("units"))
    positions = opinion.heading_positions(F.col("units"))
    found = rows.withColumn("positions", positions).select(
        "doc_id",
        F.posexplode_outer(
            F.transform(
                "positions",
                lambda h: F.struct(
                    h["heading"].alias("heading"), opinion.section_after(F.col("units"), F.col("positions"), h["ix"]).alias("text")
                ),
            )
        ).alias("position", "s"),
    )
    return found.filter(F.col("position").isNotNull()).select("doc_id", "position", "s.heading", "s.text")


SECTION_ASSIGN = f"""
with raw as (
  select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as i from documents),
l as (select doc_id, i, trim(t, ' ') as t, length(trim(t, ' ')) <= {SHORT_LINE} as h from raw where trim(t, ' ') <> ''),
s as (select *, sum(h::int) over (partition by doc_id order by i) as section from l)
select doc_id, (section - 1)::int as position, max(case when h then t end) as heading,
  coalesce(string_agg(t, chr(10) || chr(10) order by i) filter (where not h), '') as text
from s where section > 0 group by doc_id, section"""

def _page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return star.table(spark, sf_dir, "pages").select("page_id", "html", links.alias("links"))


def viewer_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each page written as viewer addresses, script properties and viewer calls, then found again."""
    receipt = F.lpad(F.col("page_id").cast("string"), 14, "2")
    number = F.col("page_id").cast("string")

    def written(link: Column, index: Column) -> Column:
        ele, offset, length = index.cast("string"), (index * 10).cast("string"), F.length(link).cast("string")
        foreign = F.when(index % 7 == 6, F.lit("9")).otherwise(number)
        address = F.concat(
            F.lit('<a href="/report/viewer.do?rcpNo='), receipt, F.lit("&amp;dcmNo="), foreign, F.lit("&amp;eleId="), ele,
            F.lit("\\u0026offset="), offset, F.lit("&length="), length, F.lit('&dtd=dart3.xsd">x</a>'),
        )
        script = F.concat(
            F.lit("node1['rcpNo'] = '"), receipt, F.lit("'; node1['dcmNo'] = \""), foreign, F.lit("\"; node1.eleId = '"), ele,
            F.lit("'; node1.offset = "), offset, F.lit("; node1['length'] = '"), length, F.lit("'; node1.dtd = 'dart3.xsd';\n"),
        )
        call = F.concat(
            F.lit("viewDoc('"), receipt, F.lit("', '"), foreign, F.lit("', '"), ele, F.lit("', '"), offset, F.lit("', '"),
            length, F.lit("', 'dart3.xsd', '')\n"),
        )
        return F.when(index % 3 == 0, address).when(index % 3 == 1, script).otherwise(call)

    pages = _page_links(spark, sf_dir).select(
        receipt.alias("rcept_no"), number.alias("dcm_no"),
        F.concat(F.col("html"), F.lit("<script>"), F.array_join(F.transform("links", written), ""), F.lit("</script>")).alias("html"),
    )
    return viewer.in_viewer_order(viewer.viewer_references(pages)).select(
        "rcept_no", "dcm_no", "ele_id", "offset", "length", "dtd", "url"
    )


VIEWER_REFS = f"""
with l as (select page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) as ls from pages),
e as (select page_id, unnest(ls) as link, generate_subscripts(ls, 1) - 1 as i from l),
r as (
  select lpad(page_id::varchar, 14, '2') as rcept_no, page_id::varchar as dcm_no, i::varchar as ele_id, (i * 10)::varchar as "offset",
    length(link)::varchar as length, 'dart3.xsd' as dtd, i, page_id from e)
select rcept_no, dcm_no, ele_id, "offset", length, dtd,
  '{viewer.VIEWER_URL}?rcpNo=' || rcept_no || '&dcmNo=' || dcm_no || '&eleId=' || ele_id || '&offset=' || "offset" || '&length=' || length
  || '&dtd=dart3.xsd' as url
from r where i % 7 <> 6 or page_id = 9"""


def attachment_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each page as the attachment list of a filing."""

    def option(link: Column, index: Column) -> Column:
        value = F.concat(
            F.lit("rcpNo="), F.when(index % 2 == 0, F.lit("1&amp;")).otherwise("&amp;"), F.lit("dcmNo="), index.cast("string")
        )
        return F.concat(
            F.lit('<option class="c" value="'), F.when(index % 5 == 4, F.lit("null")).otherwise(value),
            F.lit('">\n 첨부 <b>'), F.regexp_replace(link, "[^A-Za-z0-9]", ""), F.lit("</b> &amp; 감사보고서</option>"),
        )

    listed = F.array_join(F.transform("links", option), "")
    pages = _page_links(spark, sf_dir).select(
        F.col("page_id").cast("string").alias("rcept_no"),
        F.concat(
            F.col("html"), F.lit('<select id="other"><option value="dcmNo=0">감사보고서</option></select><select name="s" id="att">'), listed,
            F.lit("</select>"),
        ).alias("html"),
    )
    return viewer.attachment_options(pages)


ATTACHMENT_OPTIONS = """
with l as (select page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) as ls from pages),
e as (select page_id, unnest(ls) as link, generate_subscripts(ls, 1) - 1 as i from l)
select case when i % 2 = 0 then '1' else page_id::varchar end as rcept_no, i::varchar as dcm_no,
  '첨부 ' || case when regexp_replace(link, '[^A-Za-z0-9]', '', 'g') = '' then '' else regexp_replace(link, '[^A-Za-z0-9]', '', 'g') || ' ' end
  || '& 감사보고서' as title, i::int as ordinal
from e where i % 5 <> 4"""

QUERIES = {
    "opinion_classify": (opinion_classify, OPINION_CLASSIFY),
    "reason_split": (reason_split, REASON_SPLIT),
    "kam_items": (kam_items, KAM_ITEMS),
    "section_extract": (section_extract, SECTION_EXTRACT),
    "going_concern": (going_concern_section, GOING_CONCERN),
    "audit_summary": (audit_summary, AUDIT_SUMMARY),
    "html_blocks": (html_blocks, None),
    "shared_blocks": (shared_blocks, SHARED_BLOCKS),
    "html_text": (html_text, HTML_TEXT),
    "charset_tag": (charset_tag, CHARSET_TAG),
    "charset_decode": (charset_decode, CHARSET_DECODE),
    "assemble_fragments": (assemble_fragments, ASSEMBLE_FRAGMENTS),
    "audit_report_latest": (audit_report_latest, AUDIT_REPORT_LATEST),
    "assembled_files": (assembled_files, ASSEMBLED_FILES),
    "section_assign": (section_assign, SECTION_ASSIGN),
    "viewer_refs": (viewer_refs, VIEWER_REFS),
    "attachment_options": (attachment_options, ATTACHMENT_OPTIONS),
}
