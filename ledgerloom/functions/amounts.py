"""Amount parsing and ratio arithmetic. Nothing here raises: bad input is null plus a flag."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.nested import let
from ledgerloom.functions.text import as_column, strip

DAYS_PER_YEAR = 365.0


def _signed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\((.*)\)$", "-$1")


def cleaned_amount(value: Column | str) -> Column:
    text = F.regexp_replace(strip(value), r"[, ]", "")
    return F.when(~text.isin("", "-", "－"), _signed(text))


def parse_amount(value: Column | str) -> Column:
    """Whole amount as bigint: thousands separators, dashes for nothing, ``(x)`` for minus x."""
    return cleaned_amount(value).try_cast("bigint")


def amount_is_bad(value: Column | str) -> Column:
    return cleaned_amount(value).isNotNull() & parse_amount(value).isNull()


def parse_decimal(value: Column | str, parentheses: bool = True) -> Column:
    """Amount with decimals. The tolerant readers do not know ``(x)``: pass ``parentheses=False``."""
    text = F.replace(strip(as_column(value).cast("string")), F.lit(","), F.lit(""))
    text = F.when(~text.isin("", "-"), _signed(text) if parentheses else text)
    return exact_decimal(text)


def exact_decimal(text: Column) -> Column:
    """Decimal of a number that 20 digits before and 18 after the point hold exactly; null otherwise, never rounded.

    ``exact_number`` has no such limit. Most numbers show by their shape that they fit and are cast once.
    """
    number = text.try_cast("decimal(38,18)")
    places = F.length(F.rtrim(F.regexp_extract(text, r"\.(\d+)$", 1), F.lit("0")))
    scaled = text.rlike("[eE]") & (number.cast("double") == text.try_cast("double"))
    exact = F.when(text.rlike("[eE]"), scaled).otherwise(places <= 18)
    return F.when(text.rlike(r"^[+-]?[0-9]{1,20}(\.[0-9]{0,18})?$"), number).when(exact, number)


#: Numbers whose first digit stands more places from the point than this are null.
MOST_PLACES = 999_999_999


def exact_number(text: Column | str) -> Column:
    """Any written number, exactly: ``struct(negative, digits, scale, sort_key)``; null if the text is none.

    The number is ``digits`` (without outer zeros, ``0`` for zero) times ten to the power of minus ``scale``, which is
    negative for whole numbers that end in zeros. ``sort_key`` orders numbers by value as texts do: sign, place of the
    first digit, digits; of negative numbers the complements.
    """
    text = strip(as_column(text).cast("string"))
    shape = r"^([+-]?)([0-9]*)(?:\.([0-9]*))?(?:[eE]([+-]?[0-9]{1,9}))?$"
    part = lambda group: F.regexp_extract(text, shape, group)
    is_number = text.rlike(shape) & text.rlike(r"^[+-]?\.?[0-9]")
    parts = F.struct(
        part(1).alias("sign"), F.concat(part(2), part(3)).alias("all"),
        (F.length(part(3)) - F.coalesce(F.nullif(part(4), F.lit("")).cast("int"), F.lit(0))).alias("scale"),
    )

    def stripped(p: Column) -> Column:
        digits = F.ltrim(p["all"], F.lit("0"))
        short = F.rtrim(digits, F.lit("0"))
        zero = digits == ""
        return F.struct(
            ((p["sign"] == "-") & ~zero).alias("negative"), F.when(zero, "0").otherwise(short).alias("digits"),
            F.when(zero, 0).otherwise(p["scale"] - F.length(digits) + F.length(short)).alias("scale"),
        )

    def keyed(n: Column) -> Column:
        place = F.length(n["digits"]) - n["scale"]
        above = F.lpad((place.cast("long") + MOST_PLACES + 1).cast("string"), 10, "0")
        below = F.lpad((MOST_PLACES + 1 - place.cast("long")).cast("string"), 10, "0")
        sort_key = (
            F.when(n["digits"] == "0", "1")
            .when(n["negative"], F.concat(F.lit("0"), below, F.translate(n["digits"], "0123456789", "9876543210"), F.lit("~")))
            .otherwise(F.concat(F.lit("2"), above, n["digits"]))
        )
        return F.struct(n["negative"].alias("negative"), n["digits"].alias("digits"), n["scale"].alias("scale"), sort_key.alias("sort_key"))

    return F.when(is_number, let(let(parts, stripped), keyed))


def plain_number(number: Column) -> Column:
    """An exact number written without exponent."""
    sign = F.when(number["negative"], "-").otherwise("")
    digits, scale = number["digits"], number["scale"]
    padded = F.lpad(digits, F.greatest(F.length(digits), scale + 1), F.lit("0"))
    return (
        F.when(scale <= 0, F.concat(sign, digits, F.repeat(F.lit("0"), -scale)))
        .otherwise(F.concat(sign, F.substr(padded, F.lit(1), F.length(padded) - scale), F.lit("."), F.right(padded, scale)))
    )


def parse_order(value: Column | str) -> Column:
    return F.nullif(strip(as_column(value).cast("string")), F.lit("")).try_cast("int")


def percentage(numerator: Column, denominator: Column) -> Column:
    n, d = numerator.cast("double"), denominator.cast("double")
    return F.try_divide(n, d) * F.lit(100.0)


def average(current: Column, previous: Column) -> Column:
    """Mean of two balances; null when either is missing."""
    return (current.cast("double") + previous.cast("double")) / F.lit(2.0)


def turnover(numerator: Column, balance: Column) -> Column:
    return F.try_divide(numerator.cast("double"), balance.cast("double"))


def days(turnover_value: Column) -> Column:
    return F.try_divide(F.lit(DAYS_PER_YEAR), turnover_value)


def change_amount(current: Column, previous: Column) -> Column:
    return current - previous


def change_rate(current: Column, previous: Column) -> Column:
    """Percent of the absolute previous value; null when that is zero or missing."""
    return F.try_divide(
        (current - previous).cast("double"), F.abs(previous).cast("double")
    ) * F.lit(100.0)


def effective_rate(tax: Column, profit: Column) -> Column:
    return F.when(profit > 0, tax.cast("double") / profit.cast("double") * F.lit(100.0))
