"""Going-concern uncertainty section with its exclusions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.documents.sections import (
    GOING_CONCERN,
    NUMBERED_START,
    candidates,
    first_section,
    is_boundary,
    join_blocks,
    strip_number,
)
from ledgerloom.functions.nested import contains_any, let
from ledgerloom.functions.text import spaced, squeeze

# How opinion sections start and what ends them.
MODIFIED_BASIS_STARTS = (r"한정\s*의견\s*근거(?:\s|$)", r"부적정\s*의견\s*근거(?:\s|$)", r"의견\s*거절\s*근거(?:\s|$)")
OPINION_STARTS = (r"감사\s*의견\s*근거(?:\s|$)", *MODIFIED_BASIS_STARTS, r"(?:감사\s*)?의견(?:\s|$)")
OPINION_ENDS = (
    r"핵심\s*감사\s*사항(?:\s|$)", r"강조\s*사항(?:\s|$)", r"기타\s*사항(?:\s|$)",
    r"(?:연결\s*)?재무제표에\s*대한\s*.*책임", r"감사인의\s*책임(?:\s|$)", r"내부회계관리제도", r"감사\s*실시\s*내용(?:\s|$)",
)

_PLAIN_HEADINGS = {"".join(h.split()): h for h in GOING_CONCERN.headings}


def _starts(text: Column, patterns) -> Column:
    return text.rlike(rf"(?U){NUMBERED_START}(?:{'|'.join(patterns)})")


def _positions(blocks: Column, test) -> Column:
    return F.array_compact(F.transform(blocks, lambda b, i: F.when(test(b["text"]), i)))


def _last_before(positions: Column, index: Column) -> Column:
    return F.coalesce(F.array_max(F.filter(positions, lambda p: p <= index)), F.lit(-1))


def mentioned_in_modified_basis(blocks: Column) -> Column:
    """A heading phrase lies between the basis of a modified opinion and the next section."""
    names = "(?U)" + "|".join(spaced(h) for h in _PLAIN_HEADINGS)
    firsts = dict.fromkeys(h[0] for h in _PLAIN_HEADINGS)

    def inside(starts: Column) -> Column:
        marks = F.struct(
            _positions(blocks, lambda t: _starts(t, OPINION_ENDS)).alias("ends"),
            _positions(blocks, lambda t: contains_any(t, firsts) & t.rlike(names)).alias("phrases"),
        )
        return let(
            marks,
            lambda m: F.exists(m["phrases"], lambda p: _last_before(starts, p) > _last_before(m["ends"], p)),
        )

    starts = _positions(blocks, lambda t: _starts(t, MODIFIED_BASIS_STARTS))
    return let(starts, lambda s: F.when(F.size(s) > 0, inside(s)).otherwise(False))


def inline_section(inline: Column) -> Column:
    """Bold inline heading inside one block: what follows it in the same element, to the next bold heading."""

    def read(found: Column) -> Column:
        plain = squeeze(strip_number(found["text"]))
        pairs = [F.lit(part) for pair in _PLAIN_HEADINGS.items() for part in pair]
        rest = found["rest"]
        stop = F.array_position(
            F.transform(rest, lambda r: r["bold"] & is_boundary(r["text"], GOING_CONCERN)), F.lit(True)
        ).cast("int")
        taken = let(stop, lambda s: F.when(s == 0, rest).otherwise(F.slice(rest, 1, s - 1)))
        return F.struct(
            F.try_element_at(F.create_map(*pairs), plain).alias("heading"),
            join_blocks(F.transform(taken, lambda r: r["text"])).alias("text"),
        )

    return F.get(
        F.filter(F.transform(inline, read), lambda s: s["heading"].isNotNull() & (s["text"] != "")), F.lit(0)
    )


def block_section(blocks: Column) -> Column:
    """Section headed by a block of its own, outside the opinion and its basis."""

    def outside(found: Column) -> Column:
        marks = F.struct(
            _positions(blocks, lambda t: _starts(t, OPINION_STARTS)).alias("opens"),
            _positions(blocks, lambda t: _starts(t, OPINION_ENDS)).alias("ends"),
        )
        return let(
            marks,
            lambda m: F.filter(found, lambda c: _last_before(m["opens"], c["ix"]) <= _last_before(m["ends"], c["ix"])),
        )

    def search(found: Column) -> Column:
        return F.when(F.size(found) > 0, first_section(blocks, outside(found), GOING_CONCERN))

    return let(candidates(blocks, GOING_CONCERN), search)


def going_concern(blocks: Column, inline: Column) -> Column:
    """``struct(heading, text)`` or null."""
    return F.when(
        ~mentioned_in_modified_basis(blocks), F.coalesce(inline_section(inline), block_section(blocks))
    )
