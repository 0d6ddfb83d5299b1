"""Sections between headings, as expressions over the block array of a document (no shuffle)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.nested import contains_any, let
from ledgerloom.functions.text import spaced, squeeze, strip

HEADING_LIMIT = 120

# Numbering that may stand before a heading.
NUMBERING = r"(?:\d+[.)]|[가-힣][.)]|\([0-9가-힣]+\))"
NUMBERED_START = rf"^\s*{NUMBERING}?\s*"
_DASHES = r"[:：\-–—]"
_SENTENCE_END = ".!?:："

_RESPONSIBILITY_BOUNDARIES = (
    r"(?:연결\s*)?재무제표에\s*대한\s*(?:(?:회사|경영진)(?:의)?\s*)?경영진과\s*지배기구의\s*책임",
    r"(?:연결\s*)?재무제표에\s*대한\s*(?:회사(?:의)?\s*)?경영진의\s*책임",
    r"(?:연결\s*)?재무제표에\s*대한\s*지배기구의\s*책임",
    r"(?:연결\s*)?재무제표\s*감사에\s*대한\s*감사인의\s*책임",
    r"감사인의\s*(?:연결\s*)?재무제표\s*감사에\s*대한\s*책임",
    r"감사인의\s*책임",
    r"내부회계관리제도에\s*대한\s*감사인의\s*감사보고서",
    r"내부회계관리제도\s*감사\s*또는\s*검토",
)
_OPINION_BOUNDARIES = (
    r"감사\s*의견", r"감사\s*의견\s*근거", r"한정\s*의견\s*근거", r"부적정\s*의견\s*근거", r"의견\s*거절\s*근거",
)
# Every boundary has one of these words; a text without any of them is not searched for boundaries.
BOUNDARY_WORDS = ("사항", "의견", "책임", "계속기업", "내부회계관리제도")
_GOING_CONCERN_BOUNDARY = r"계속기업\s*(?:과\s*)?관련(?:된)?\s*중요한\s*불확실성"


@dataclass(frozen=True)
class SectionSpec:
    """What a section is called and where it ends."""

    headings: tuple[str, ...]
    boundaries: tuple[str, ...]
    blank_separates: bool = True
    cut_needs_sentence_end: bool = True


# Headings and boundaries of the sections.
EMPHASIS = SectionSpec(
    headings=("강조사항", "강조 사항"),
    boundaries=(
        r"핵심\s*감사\s*사항",
        r"기타\s*사항",
        _GOING_CONCERN_BOUNDARY,
        r"(?:연결)?재무제표에\s*대한\s*(?:회사\s*)?경영진과\s*지배기구의\s*책임",
        r"(?:연결)?재무제표감사에\s*대한\s*감사인의\s*책임",
        r"감사인의\s*(?:연결)?재무제표감사에\s*대한\s*책임",
    ),
)
OTHER_MATTER = SectionSpec(
    headings=("기타사항", "기타 사항"),
    boundaries=(
        *_OPINION_BOUNDARIES,
        r"핵심\s*감사\s*사항",
        r"강조\s*사항",
        _GOING_CONCERN_BOUNDARY,
        *_RESPONSIBILITY_BOUNDARIES,
        r"(?:연결\s*)?내부회계관리제도에\s*대한\s*경영진과\s*지배기구의\s*책임",
        r"(?:연결\s*)?내부회계관리제도\s*감사에\s*대한\s*감사인의\s*책임",
    ),
    blank_separates=False,
)
GOING_CONCERN = SectionSpec(
    headings=(
        "계속기업 관련 중요한 불확실성", "계속기업과 관련된 중요한 불확실성", "계속기업과 관련한 중요한 불확실성",
        "계속기업 관련 중대한 불확실성", "계속기업과 관련된 중대한 불확실성", "계속기업과 관련한 중대한 불확실성",
        "계속기업 존속능력에 대한 중요한 불확실성", "계속기업 존속능력과 관련된 중요한 불확실성",
        "계속기업 존속능력에 관한 중요한 불확실성", "계속기업관련 중요한 불확실성",
        "계속기업 가정에 대한 중요한 불확실성", "계속기업 가정과 관련된 중요한 불확실성",
        "계속기업 가정과 관련한 중요한 불확실성", "계속기업 가정에 관한 중요한 불확실성",
        "계속기업 가정에 대한 중대한 불확실성",
    ),
    boundaries=(
        *_OPINION_BOUNDARIES,
        r"핵심\s*감사\s*사항",
        r"강조\s*사항",
        r"기타\s*사항",
        *_RESPONSIBILITY_BOUNDARIES,
    ),
    cut_needs_sentence_end=False,
)


def strip_number(text: Column) -> Column:
    return let(F.regexp_replace(text, rf"(?U)^\s*{NUMBERING}\s*", ""), strip)


def join_blocks(texts: Column) -> Column:
    """Paragraphs joined by an empty line; blanks inside collapse, empty ones are dropped."""
    tidy = F.transform(F.transform(texts, lambda t: F.regexp_replace(t, r"[ \t]+", " ")), strip)
    return F.array_join(F.filter(tidy, lambda t: t != ""), "\n\n")


def _any(patterns: tuple[str, ...]) -> str:
    return "(?:" + "|".join(patterns) + ")"


def _cut_pattern(spec: SectionSpec) -> str:
    """Boundary anywhere, or only at the start and after the end of a sentence."""
    before = rf"(?<![^{_SENTENCE_END}])\s*" if spec.cut_needs_sentence_end else ""
    return rf"(?U){before}{_any(spec.boundaries)}"


def cut_text(text: Column, spec: SectionSpec) -> Column:
    """Text before the first boundary inside a block; null when there is none."""
    cut = let(F.split(text, _cut_pattern(spec), 2), lambda parts: F.when(F.size(parts) > 1, let(parts[0], strip)))
    return F.when(contains_any(text, BOUNDARY_WORDS), cut)


# The tests below are single anchored patterns: a long paragraph fails at its first characters.


def is_boundary(text: Column, spec: SectionSpec) -> Column:
    whole = text.rlike(rf"(?U){NUMBERED_START}{_any(spec.boundaries)}\s*$")
    return contains_any(text, BOUNDARY_WORDS) & whole & (F.length(squeeze(strip_number(text))) <= HEADING_LIMIT)


def is_standalone(text: Column, spec: SectionSpec) -> Column:
    """The block is the heading, perhaps numbered or followed by a remark in parentheses."""
    names = _any(tuple(dict.fromkeys(spaced(h) for h in spec.headings)))
    return text.rlike(rf"(?U){NUMBERED_START}{names}\s*(?:\(|$)")


def inline_heading(text: Column, spec: SectionSpec) -> Column:
    """``struct(heading, body)`` of a block that starts with the heading; null otherwise."""
    names = "|".join(h.replace(" ", r"\s*") for h in sorted(spec.headings, key=len, reverse=True))
    separator = rf"(?:\s*{_DASHES}\s*|\s+)" if spec.blank_separates else rf"\s*{_DASHES}\s*"
    pattern = rf"(?sU){NUMBERED_START}({names}){separator}(.+)$"
    found = F.struct(
        let(F.regexp_extract(text, pattern, 1), strip).alias("heading"),
        let(F.regexp_extract(text, pattern, 2), strip).alias("body"),
    )
    return F.when(text.rlike(pattern), let(found, lambda f: F.when(f["body"] != "", f)))


def marked_blocks(blocks: Column, spec: SectionSpec) -> Column:
    """Per block: text, whether it is a boundary heading, and the text before a boundary inside it."""
    return F.transform(
        blocks,
        lambda b: F.struct(
            b["text"].alias("text"), is_boundary(b["text"], spec).alias("stops"), cut_text(b["text"], spec).alias("cut")
        ),
    )


def section_body(marked: Column, index: Column, first_body: Column, spec: SectionSpec) -> Column:
    """Text from the block after ``index`` (0-based) to the next boundary."""
    first_cut = cut_text(first_body, spec)
    tail = F.slice(marked, index + 2, F.size(marked))

    def rest(after: Column) -> Column:
        end = F.array_position(F.transform(after, lambda b: b["stops"] | b["cut"].isNotNull()), F.lit(True))

        def build(position: Column) -> Column:
            taken = F.when(position == 0, after).otherwise(F.slice(after, 1, position.cast("int") - 1))
            last = F.get(after, position.cast("int") - 1)
            tail_text = F.when((position > 0) & ~last["stops"], last["cut"])
            texts = F.concat(
                F.array(F.coalesce(first_body, F.lit(""))),
                F.transform(taken, lambda b: b["text"]),
                F.array(F.coalesce(tail_text, F.lit(""))),
            )
            return join_blocks(texts)

        return let(end, build)

    return F.when(first_cut.isNotNull(), join_blocks(F.array(first_cut))).otherwise(let(tail, rest))


def candidates(blocks: Column, spec: SectionSpec) -> Column:
    """Blocks that open the section: ``array<struct(ix, heading, body)>``."""

    def open_at(block: Column, index: Column) -> Column:
        text = block["text"]
        alone = F.struct(text.alias("heading"), F.lit(None).cast("string").alias("body"))
        named = contains_any(text, dict.fromkeys(h[0] for h in spec.headings))
        opened = F.when(named, F.when(is_standalone(text, spec), alone).otherwise(inline_heading(text, spec)))
        return let(
            opened,
            lambda o: F.struct(index.alias("ix"), o["heading"].alias("heading"), o["body"].alias("body")),
        )

    return F.filter(F.transform(blocks, open_at), lambda c: c["heading"].isNotNull())


def first_section(blocks: Column, opened: Column, spec: SectionSpec) -> Column:
    """First candidate with a body; a heading in a table of contents has none.

    Blocks are searched for boundaries only when there is a candidate, and only from the first one on.
    """

    def read(found: Column, marked: Column) -> Column:
        start = found[0]["ix"]
        sections = F.transform(
            found,
            lambda c: F.struct(
                c["heading"].alias("heading"), section_body(marked, c["ix"] - start, c["body"], spec).alias("text")
            ),
        )
        return F.get(F.filter(sections, lambda s: s["text"] != ""), F.lit(0))

    def search(found: Column) -> Column:
        following = F.slice(blocks, found[0]["ix"] + 1, F.size(blocks))
        return let(marked_blocks(following, spec), lambda marked: read(found, marked))

    return let(opened, lambda found: F.when(F.size(found) > 0, search(found)))


def extract_section(blocks: Column, spec: SectionSpec) -> Column:
    """``struct(heading, text)`` of the section, or null."""
    return let(candidates(blocks, spec), lambda opened: first_section(blocks, opened, spec))
