"""Key audit matters: introduction and items of the section."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.documents.sections import join_blocks
from ledgerloom.functions.nested import let
from ledgerloom.functions.text import spaced

TITLE_LIMIT = 120

# Headings of the section, of what follows it, and of the parts of one item.
SECTION_START = "핵심감사사항"
SECTION_ENDS = (
    "기타사항", "강조사항", "계속기업 관련 중요한 불확실성", "재무제표에 대한 경영진과 지배기구의 책임",
    "연결재무제표에 대한 경영진과 지배기구의 책임", "재무제표감사에 대한 감사인의 책임",
    "연결재무제표감사에 대한 감사인의 책임",
)
PART_HEADINGS = (
    "핵심감사사항으로 결정된 이유", "핵심감사사항으로 결정한 이유", "핵심감사사항이 감사에서 다루어진 방법",
    "감사에서 다루어진 방법", "감사인의 대응", "감사절차",
)
NUMBERED_TITLE = r"(?U)^\s*(?:\(\d+\)|\d+[.)]|[가-힣][.)])\s+"


def _starts_with_any(text: Column, headings) -> Column:
    return text.rlike(rf"(?U)^\s*(?:{'|'.join(spaced(h) for h in headings)})")


def is_item_title(block: Column) -> Column:
    text = block["text"]
    return (
        ~_starts_with_any(text, PART_HEADINGS)
        & (F.length(text) <= TITLE_LIMIT)
        & (block["bold"] | text.rlike(NUMBERED_TITLE))
    )


def _texts(blocks: Column) -> Column:
    return F.transform(blocks, lambda b: b["text"])


def _items(section: Column, titles: Column) -> Column:
    """One item per title position (0-based), from the block after it to the next title."""

    def item(at: Column, number: Column) -> Column:
        end = F.coalesce(F.get(titles, number + 1), F.size(section))
        return F.struct(
            F.get(section, at)["text"].alias("title"),
            join_blocks(_texts(F.slice(section, at + 2, end - at - 1))).alias("text"),
        )

    return F.filter(F.transform(titles, item), lambda i: i["text"] != "")


def key_audit_matters(blocks: Column) -> Column:
    """``struct(heading, introduction, matters: array<struct(title, text)>)``; null without the section.

    A section without titled items is one untitled item.
    """
    start = F.array_position(F.transform(blocks, lambda b: _starts_with_any(b["text"], [SECTION_START])), F.lit(True))

    def cut(position: Column) -> Column:
        tail = F.slice(blocks, position + 1, F.size(blocks))
        end = F.array_position(F.transform(tail, lambda b: _starts_with_any(b["text"], SECTION_ENDS)), F.lit(True))
        section = let(
            F.struct(tail.alias("tail"), end.cast("int").alias("end")),
            lambda t: F.when(t["end"] == 0, t["tail"]).otherwise(F.slice(t["tail"], 1, t["end"] - 1)),
        )
        return let(section, lambda s: build(F.get(blocks, position - 1)["text"], s))

    def build(heading: Column, section: Column) -> Column:
        flagged = F.transform(section, lambda b, i: F.when(is_item_title(b), i))
        return let(F.array_compact(flagged), lambda titles: let(
            _items(section, titles), lambda items: result(heading, section, titles, items)))

    def result(heading: Column, section: Column, titles: Column, items: Column) -> Column:
        introduction = join_blocks(_texts(F.slice(section, 1, F.coalesce(F.get(titles, F.lit(0)), F.lit(0)))))
        whole = join_blocks(_texts(section))
        untitled = F.array(F.struct(F.lit(None).cast("string").alias("title"), whole.alias("text")))
        has_items = F.size(items) > 0
        return F.struct(
            heading.alias("heading"),
            F.when(has_items, F.nullif(introduction, F.lit(""))).alias("introduction"),
            F.when(has_items, items).otherwise(F.filter(untitled, lambda i: i["text"] != "")).alias("matters"),
        )

    return let(start.cast("int"), lambda position: F.when(position > 0, cut(position)))
