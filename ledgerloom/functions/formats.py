"""Report columns: numbers and dates as text, and the aliases users type for codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import as_column

# What users type for a report kind and a statement scope.
REPORT_ALIASES = {
    "11011": ("annual", "a", "사업보고서"),
    "11013": ("q1", "1q", "1분기"),
    "11012": ("half", "h", "반기"),
    "11014": ("q3", "3q", "3분기"),
}
SCOPE_ALIASES = {
    "CFS": ("cfs", "연결", "연결재무제표"),
    "OFS": ("ofs", "별도", "개별", "별도재무제표"),
}


def resolve_alias(value: Column | str, aliases: dict[str, tuple[str, ...]]) -> Column:
    """Code for what was typed, ignoring case; a code stands for itself, anything else is null."""
    typed = F.lower(F.trim(as_column(value)))
    code = None
    for target, names in aliases.items():
        hit = typed.isin(target.lower(), *names)
        code = F.when(hit, target) if code is None else code.when(hit, target)
    return code


def ratio_text(value: Column | str, kind: Column | str) -> Column:
    """``1,234.50%``, ``4.20회`` or ``87.00일``; a dash for nothing."""
    value, kind = as_column(value), as_column(kind)
    return (
        F.when(value.isNull(), "-")
        .when(kind == "turnover", F.printf(F.lit("%.2f회"), value))
        .when(kind == "days", F.printf(F.lit("%.2f일"), value))
        .otherwise(F.printf(F.lit("%,.2f%%"), value))
    )


def amount_text(value: Column | str) -> Column:
    return F.coalesce(F.format_number(as_column(value), 0), F.lit("-"))


def signed_amount_text(value: Column | str) -> Column:
    value = as_column(value).cast("bigint")
    return F.when(value.isNotNull(), F.printf(F.lit("%+,d"), value)).otherwise("-")


def signed_rate_text(value: Column | str) -> Column:
    value = as_column(value)
    return F.when(value.isNotNull(), F.printf(F.lit("%+.2f%%"), value)).otherwise("-")


def dashed_date(value: Column | str) -> Column:
    """``YYYYMMDD`` to ``YYYY-MM-DD``; any other text stays."""
    return F.regexp_replace(as_column(value), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
