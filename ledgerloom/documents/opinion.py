"""Audit opinion: headings in text units, candidate scoring, basis and classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.nested import contains_any, count_contained, first_where, let
from ledgerloom.functions.text import collapse, strip

# Opinion headings, their kinds, basis headings, spellings and other section headings.
OPINION_KINDS = {"감사의견": "적정의견", "한정의견": "한정의견", "부적정의견": "부적정의견", "의견거절": "의견거절"}
BASIS_KINDS = {"감사의견근거": "적정의견", "한정의견근거": "한정의견", "부적정의견근거": "부적정의견", "의견거절근거": "의견거절"}
MODIFIED_KINDS = ("한정의견", "부적정의견", "의견거절")
UNMODIFIED_KIND = "적정의견"
BASIS_SPELLINGS = {
    "감사의견의 근거": "감사의견근거",
    "한정의견의 근거": "한정의견근거",
    "부적정의견의 근거": "부적정의견근거",
    "의견거절의 근거": "의견거절근거",
    "감사의견 근거": "감사의견근거",
    "한정의견 근거": "한정의견근거",
    "부적정의견 근거": "부적정의견근거",
    "의견거절 근거": "의견거절근거",
    "감사 의견 근거": "감사의견근거",
    "한정 의견 근거": "한정의견근거",
    "부적정 의견 근거": "부적정의견근거",
    "의견 거절 근거": "의견거절근거",
}
OTHER_HEADINGS = (
    "계속기업 관련 중요한 불확실성", "핵심감사사항", "강조사항", "기타사항", "재무제표에 대한 경영진과 지배기구의 책임",
    "경영진과 지배기구의 책임", "경영진의 책임", "재무제표감사에 대한 감사인의 책임", "재무제표에 대한 감사인의 책임",
    "감사인의 책임",
)
RESPONSIBILITY_WORDS = (
    "재무제표감사에 대한 감사인의 책임", "재무제표에 대한 감사인의 책임", "감사인의 책임",
    "재무제표에 대한 경영진과 지배기구의 책임", "경영진과 지배기구의 책임", "경영진의 책임",
)
# Wording that is counted in, or decides, an opinion.
BODY_WORDS = (
    "재무제표를 감사하였습니다", "연결재무제표를 감사하였습니다", "우리의 의견으로는", "중요성의 관점에서", "재무상태",
    "재무성과", "현금흐름",
)
KIND_WORDS = {
    "감사의견": ("우리의 의견으로는", "공정하게 표시하고 있습니다"),
    "한정의견": ("한정의견근거", "영향을 제외하고는", "가능한 영향을 제외하고는"),
    "부적정의견": ("부적정의견근거", "공정하게 표시하고 있지 않습니다"),
    "의견거절": (
        "의견거절근거", "감사의견을 표명하지 않습니다", "의견을 표명하지 않습니다", "감사의견을 표명할 수 없습니다",
        "의견을 표명할 수 없습니다", "충분하고 적합한 감사증거를 입수할 수 없었습니다",
        "충분하고 적합한 감사증거를 입수하지 못하였습니다",
    ),
}
DISCLAIMER_PHRASES = (
    "감사의견을 표명하지 않습니다", "의견을 표명하지 않습니다", "감사의견을 표명할 수 없습니다", "의견을 표명할 수 없습니다",
)
ADVERSE_PHRASES = ("공정하게 표시하고 있지 않습니다", "적정하게 표시하고 있지 않습니다")
QUALIFIED_PHRASES = ("영향을 제외하고는", "가능한 영향을 제외하고는")

TARGET_LENGTH, SHORT_TEXT, LONG_TEXT, TABLE_SHARE = 1500, 30, 8000, 0.35

# Where a numbered reason starts, and where the body of a reason starts.
REASON_NUMBER = r"\(\s*\d+\s*\)|\d+\s*[.)]"
REASON_BODY_STARTS = (
    r"연결회사의\s+", r"회사의\s+", r"당사의\s+", r"연결회사는\s+", r"회사는\s+", r"당사는\s+", r"우리는\s+", r"본인은\s+",
    r"감사인은\s+", r"경영진은\s+", r"20\d{2}년\s+",
)

_CANONICAL = {
    **{h: h for h in (*OPINION_KINDS, *BASIS_KINDS, *OTHER_HEADINGS)},
    **BASIS_SPELLINGS,
}
KNOWN_HEADINGS = frozenset(_CANONICAL)


def heading_of(text: Column) -> Column:
    """Canonical heading when the whole text is a known heading, else null."""
    pairs = [F.lit(part) for pair in _CANONICAL.items() for part in pair]
    return F.try_element_at(F.create_map(*pairs), text)


def headed_units(units: Column) -> Column:
    """Units with their heading; a heading split over several inline elements counts on its first unit."""
    return F.transform(
        units,
        lambda u: F.struct(
            u["text"].alias("text"),
            u["block"].alias("block"),
            F.coalesce(heading_of(u["text"]), heading_of(u["block_text"])).alias("heading"),
        ),
    )


def heading_positions(units: Column) -> Column:
    tagged = F.transform(units, lambda u, i: F.struct(i.alias("ix"), u["heading"].alias("heading")))
    return F.filter(tagged, lambda h: h["heading"].isNotNull())


def join_units(units: Column) -> Column:
    """Units of one block are joined by a blank, blocks by an empty line."""

    def glue(unit: Column, index: Column) -> Column:
        same = F.get(units, index - 1)["block"] == unit["block"]
        return F.concat(F.when(index == 0, "").when(same, " ").otherwise("\n\n"), unit["text"])

    return F.array_join(F.transform(units, glue), "")


def section_after(units: Column, positions: Column, index: Column) -> Column:
    """Text after the heading at ``index`` up to the next heading."""
    following = first_where(positions, lambda h: h["ix"] > index)["ix"]
    length = F.coalesce(following, F.size(units)) - index - 1
    return let(F.slice(units, index + 2, length), join_units)


def _table_like(text: Column) -> Column:
    lines = F.filter(F.split(text, r"\n"), lambda s: s != "")
    short = F.filter(lines, lambda s: (s == "-") | s.rlike(r"(?U)^\d+$") | (F.length(s) <= 3))
    return (F.size(lines) > 0) & (F.size(short) / F.size(lines) >= TABLE_SHARE)


def opinion_score(heading: Column, text: Column, has_basis: Column) -> Column:
    """How much a section looks like the opinion itself and not like a table of contents or a table."""
    by_kind = F.lit(0)
    for kind, words in KIND_WORDS.items():
        by_kind = F.when(heading == kind, count_contained(text, words)).otherwise(by_kind)

    def points(condition: Column, value: int) -> Column:
        return F.when(condition, value).otherwise(0)

    return (
        count_contained(text, BODY_WORDS) * 2
        + by_kind * 6
        + points(has_basis, 20)
        + points(F.length(text) < SHORT_TEXT, -10)
        + points(F.length(text) > LONG_TEXT, -15)
        + points(_table_like(text), -15)
    )


def _next_decisive(positions: Column, index: Column) -> Column:
    """Next opinion or basis heading after ``index``."""
    return first_where(
        positions, lambda h: (h["ix"] > index) & h["heading"].isin(*OPINION_KINDS, *BASIS_KINDS)
    )


def best_candidate(units: Column, positions: Column) -> Column:
    """Highest score, then length nearest to the usual one, then first in the document."""
    opinions = F.filter(positions, lambda h: h["heading"].isin(*OPINION_KINDS))

    def judge(h: Column) -> Column:
        basis = _next_decisive(positions, h["ix"])
        has_basis = F.coalesce(basis["heading"].isin(*BASIS_KINDS), F.lit(False))
        return let(
            section_after(units, positions, h["ix"]),
            lambda text: F.struct(
                opinion_score(h["heading"], text, has_basis).alias("score"),
                (-F.abs(F.length(text) - TARGET_LENGTH)).alias("closeness"),
                (-h["ix"]).alias("order"),
                h["ix"].alias("ix"),
                h["heading"].alias("heading"),
                text.alias("text"),
                F.when(has_basis, basis["ix"]).alias("basis_ix"),
                F.when(has_basis, basis["heading"]).alias("basis_heading"),
            ),
        )

    return F.array_max(F.transform(opinions, judge))


def classify(heading: Column, text: Column, basis_heading: Column) -> Column:
    """Modified heading, then modified basis heading, then phrases, else unmodified."""
    basis_kind = F.lit(None).cast("string")
    for name, kind in BASIS_KINDS.items():
        if kind in MODIFIED_KINDS:
            basis_kind = F.when(basis_heading == name, kind).otherwise(basis_kind)
    plain = F.replace(text, F.lit("\n\n"), F.lit(" "))
    return (
        F.when(heading.isin(*MODIFIED_KINDS), heading)
        .when(basis_kind.isNotNull(), basis_kind)
        .when(contains_any(plain, DISCLAIMER_PHRASES), "의견거절")
        .when(contains_any(plain, ADVERSE_PHRASES), "부적정의견")
        .when(contains_any(plain, QUALIFIED_PHRASES), "한정의견")
        .otherwise(UNMODIFIED_KIND)
    )


def split_reasons(text: Column) -> Column:
    """Numbered reasons without their numbers; text before the first number is kept."""
    parts = F.split(strip(text), rf"(?U)(?<!\S)(?={REASON_NUMBER})")
    bare = F.transform(F.transform(parts, strip), lambda p: F.regexp_replace(p, rf"(?U)^(?:{REASON_NUMBER})\s*", ""))
    return F.filter(F.transform(bare, strip), lambda p: p != "")


def split_reason_title(reason: Column) -> Column:
    """``struct(title, body)``: the body starts at the first subject phrase that is not at the beginning."""
    return let(
        collapse(reason),
        lambda text: let(
            _first_inner_start(text),
            lambda at: F.struct(
                F.when(at.isNull(), text).otherwise(let(F.substring(text, F.lit(1), at - 1), strip)).alias("title"),
                F.when(at.isNull(), "").otherwise(let(F.substring(text, at, F.length(text)), strip)).alias("body"),
            ),
        ),
    )


def _first_inner_start(text: Column) -> Column:
    """1-based start of the earliest body; a phrase that first occurs at the very beginning is no start."""


    def start(pattern: str) -> Column:
        parts = F.split(text, f"(?U){pattern}", 2)
        return let(parts, lambda p: F.when((F.size(p) > 1) & (p[0] != ""), F.length(p[0]) + 1))

    return F.least(*[start(pattern) for pattern in REASON_BODY_STARTS])


def opinion(text: Column, units: Column) -> Column:
    """``struct(status, opinion_type, heading, opinion_text, basis_heading, basis_text, reasons)``."""

    def decide(headed: Column) -> Column:
        return let(heading_positions(headed), lambda positions: choose(headed, positions))

    def choose(headed: Column, positions: Column) -> Column:
        return let(best_candidate(headed, positions), lambda best: describe(headed, positions, best))

    def describe(headed: Column, positions: Column, best: Column) -> Column:
        basis = F.nullif(section_after(headed, positions, best["basis_ix"]), F.lit(""))
        kind = classify(best["heading"], best["text"], best["basis_heading"])
        found = F.struct(F.when(best["basis_ix"].isNotNull(), basis).alias("basis_text"), kind.alias("kind"))
        return let(found, lambda f: _result(text, best, f["basis_text"], f["kind"]))

    return let(headed_units(units), decide)


def _result(text: Column, best: Column, basis_text: Column, kind: Column) -> Column:
    status = (
        F.when(~contains_any(text, RESPONSIBILITY_WORDS), "not_full_report")
        .when(best.isNull(), "no_opinion_heading")
        .when(best["text"] == "", "no_opinion_text")
        .otherwise("ok")
    )
    ok = status == "ok"
    no_reasons = F.array().cast("array<string>")
    return F.struct(
        status.alias("status"),
        F.when(ok, kind).alias("opinion_type"),
        F.when(ok, best["heading"]).alias("heading"),
        F.when(ok, best["text"]).alias("opinion_text"),
        F.when(ok, best["basis_heading"]).alias("basis_heading"),
        F.when(ok, basis_text).alias("basis_text"),
        F.when(ok & kind.isin(*MODIFIED_KINDS) & basis_text.isNotNull(), split_reasons(basis_text))
        .otherwise(no_reasons)
        .alias("reasons"),
    )
