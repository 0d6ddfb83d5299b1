"""Whole audit reports: document kind, assembly from fragments, one row with every section."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.documents import kam, markup, opinion, sections
from ledgerloom.documents.going_concern import going_concern
from ledgerloom.functions.nested import contains_any
from ledgerloom.functions.text import as_column, safe_file_name, squeeze

# Document names by kind, and markers of a full report.
AUDIT_DOCUMENTS = ("감사보고서", "연결감사보고서")
BUSINESS_DOCUMENTS = ("사업보고서", "반기보고서", "분기보고서")
REPORT_TITLES = ("독립된감사인의감사보고서", "독립된감사인의연결감사보고서")
REPORT_SECTIONS = ("감사의견", "감사의견근거", "재무제표에대한경영진", "재무제표감사에대한감사인의책임", "감사인의책임")


def is_full_report(text: Column | str) -> Column:
    """Visible text names a responsibility section and an opinion."""
    text = as_column(text)
    return contains_any(text, opinion.RESPONSIBILITY_WORDS) & contains_any(text, opinion.OPINION_KINDS)


def is_report_body(text: Column | str) -> Column:
    """Title and a section of a report, white space ignored."""
    plain = squeeze(as_column(text))
    return contains_any(plain, REPORT_TITLES) & contains_any(plain, REPORT_SECTIONS)


def document_kind(name: Column | str, text: Column | str) -> Column:
    """Kind by document name; unknown when the text is not a full report."""
    plain = squeeze(as_column(name))
    return (
        F.when(~is_full_report(text), "unknown")
        .when(plain.isin(*AUDIT_DOCUMENTS), "audit_report")
        .when(plain.isin(*BUSINESS_DOCUMENTS), "business_report")
        .otherwise("unknown")
    )


def escape_html(text: Column | str) -> Column:
    text = as_column(text)
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


def assemble(fragments: DataFrame, keys: Sequence[str], title: str = "title") -> DataFrame:
    """One row per document from its viewer fragments (``ele_id``, ``url``, ``html``), in fragment order."""
    body = F.regexp_extract("html", r"(?is)<body\b[^>]*>(.*?)</body>", 1)
    has_body = F.col("html").rlike(r"(?is)<body\b[^>]*>.*?</body>")
    wrapped = F.concat(
        F.lit('<section data-ele-id="'), F.col("ele_id").cast("string"),
        F.lit('" data-source-url="'), escape_html("url"), F.lit('">\n'),
        F.when(has_body, body).otherwise(F.col("html")), F.lit("\n</section>"),
    )
    parts = (
        fragments.groupBy(*keys)
        .agg(
            F.min(title).alias("title"),
            F.array_sort(F.collect_list(F.struct(F.col("ele_id"), wrapped.alias("section")))).alias("sections"),
        )
    )
    head = F.concat(
        F.lit('<!DOCTYPE html>\n<html lang="ko">\n<head>\n<meta charset="utf-8">\n<title>'),
        escape_html("title"),
        F.lit("</title>\n</head>\n<body>\n"),
    )
    joined = F.array_join(F.transform("sections", lambda s: s["section"]), "\n")
    return parts.select(
        *keys, "title", F.concat(head, joined, F.lit("\n</body>\n</html>")).alias("html")
    )


def with_file_name(documents: DataFrame, key: str = "rcept_no") -> DataFrame:
    name = F.coalesce(F.nullif(safe_file_name("title"), F.lit("")), F.lit("audit_report"))
    return documents.withColumn("file_name", F.concat(F.col(key), F.lit("_"), name, F.lit(".html")))


def parse(documents: DataFrame, html: str = "html", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Adds ``doc``: text, blocks, units and inline headings. Parse once, then use any section."""
    return documents.select(*keep, markup.parse_markup(html).alias("doc"))


def sections_of(parsed: DataFrame, leaf_only: bool = False) -> DataFrame:
    """Every section of each parsed document in one row; nothing leaves the row, so nothing is shuffled.

    Nested blocks with different text both count, so a body may hold a paragraph twice; ``leaf_only`` keeps
    the innermost ones.
    """
    text, blocks = F.col("doc.text"), F.col("doc.blocks")
    if leaf_only:
        blocks = F.filter(blocks, lambda b: b["leaf"])
    return parsed.select(
        *[c for c in parsed.columns if c != "doc"],
        is_full_report(text).alias("is_full_report"),
        opinion.opinion(text, F.col("doc.units")).alias("opinion"),
        kam.key_audit_matters(blocks).alias("key_audit_matters"),
        sections.extract_section(blocks, sections.EMPHASIS).alias("emphasis"),
        sections.extract_section(blocks, sections.OTHER_MATTER).alias("other_matter"),
        going_concern(blocks, F.col("doc.inline")).alias("going_concern"),
    )
