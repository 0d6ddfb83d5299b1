"""Text normalisers. Each rule is separate on purpose: the callers depend on the differences."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as the source data uses it (Unicode spaces and separator controls).
SPACE = r"[\s\x1c-\x1f]"

SPACE_CHARACTERS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

# The outline marks that may stand before an account name.
OUTLINE_MARKS = (
    r"[IVXLCDM]+[.)]",
    r"[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩⅪⅫ]+[.)]",
    r"\d+[.)]",
    r"\(\d+\)",
    r"[①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳]",
    r"[가-하][.)]",
)
OUTLINE_PREFIX = rf"(?U)^{SPACE}*(?:{'|'.join(OUTLINE_MARKS)}){SPACE}*"

# Words that mark an account as current or non-current.
CURRENT_WORDS = ("current", "유동", "단기")
NONCURRENT_WORDS = ("noncurrent", "non-current", "비유동", "장기")


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    """Both ends trimmed of any white space; ``trim`` alone would only remove U+0020.

    Most values have nothing to trim: looking at the end characters first is far cheaper than trimming.
    """
    text = as_column(value)
    spaces = list(SPACE_CHARACTERS)
    padded = F.substring(text, 1, 1).isin(spaces) | F.substring(text, -1, 1).isin(spaces)
    return F.when(padded, F.btrim(text, F.lit(SPACE_CHARACTERS))).otherwise(text)


def spaced(name: str) -> str:
    """Pattern that finds ``name`` with white space anywhere between its characters."""
    return r"\s*".join(re.escape(c) for c in name if not c.isspace())


def clean_text(value: Column | str) -> Column:
    """Trim; empty text becomes null."""
    return F.nullif(strip(value), F.lit(""))


def squeeze(value: Column | str) -> Column:
    """Remove all white space; null stays null."""
    return F.regexp_replace(as_column(value), rf"(?U){SPACE}+", "")


def collapse(value: Column | str) -> Column:
    """White-space runs become one blank, ends are trimmed."""
    return F.trim(F.regexp_replace(as_column(value), rf"(?U){SPACE}+", " "))


def account_label(value: Column | str) -> Column:
    """Drop one leading outline mark, then all white space."""
    text = F.coalesce(strip(value), F.lit(""))
    return squeeze(F.regexp_replace(text, OUTLINE_PREFIX, ""))


def plain_label(name: str) -> str:
    """``account_label`` for the constant names of this package."""
    return "".join(re.sub(OUTLINE_PREFIX.removeprefix("(?U)"), "", name.strip(), count=1).split())


def label_without_blanks(value: Column | str) -> Column:
    """Screening rules compare names with U+0020 removed only."""
    return F.replace(F.coalesce(as_column(value), F.lit("")), F.lit(" "), F.lit(""))


def label_without_loss_mark(value: Column | str) -> Column:
    """Divergence screening also ignores a ``(손실)`` mark."""
    return F.replace(label_without_blanks(value), F.lit("(손실)"), F.lit(""))


def label_without_currency_mark(value: Column | str) -> Column:
    """Per-share names ignore white space and a ``(원)`` mark."""
    return F.replace(F.coalesce(squeeze(value), F.lit("")), F.lit("(원)"), F.lit(""))


def corp_key(value: Column | str) -> Column:
    """Trim and left-pad with zeros to eight characters; longer keys stay whole."""
    text = F.coalesce(strip(as_column(value).cast("string")), F.lit(""))
    return (
        F.when(text == "", text)
        .when(F.length(text) < 8, F.lpad(text, 8, "0"))
        .otherwise(text)
    )


def padded_number(value: Column | str, width: int) -> Column:
    """Number as text with leading zeros; longer numbers stay whole."""
    text = as_column(value).cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def has_text(value: Column | str) -> Column:
    return F.coalesce(strip(value), F.lit("")) != ""


def scope_rank(
    account_id: Column | str,
    account_nm: Column | str,
    account_detail: Column | str,
    prefer_current: bool = True,
) -> Column:
    """0 for the wanted scope, 1 for unknown, 2 for the other one. Non-current is tested first."""
    text = F.replace(
        F.lower(
            F.concat_ws(
                " ",
                *[F.coalesce(as_column(c), F.lit("")) for c in (account_id, account_nm, account_detail)],
            )
        ),
        F.lit("_"),
        F.lit(" "),
    )
    noncurrent = text.rlike("|".join(NONCURRENT_WORDS))
    current = text.rlike("|".join(CURRENT_WORDS))
    first, last = (2, 0) if prefer_current else (0, 2)
    return F.when(noncurrent, first).when(current, last).otherwise(1)


def safe_file_name(value: Column | str) -> Column:
    return F.regexp_replace(as_column(value), r'[\\/:*?"<>|]', "_")


def after_hash(href: Column | str, keep_whole: bool = False) -> Column:
    """Fragment of a locator reference. Without ``#``: empty, or the whole text for label links."""
    href = as_column(href)
    return F.when(F.instr(href, "#") > 0, F.substring_index(href, "#", -1)).otherwise(
        href if keep_whole else F.lit("")
    )


def local_name_of_concept(concept_id: Column | str) -> Column:
    """``prefix_Name`` to ``Name``: everything after the first underscore."""
    return F.regexp_replace(as_column(concept_id), r"^[^_]*_", "")


def local_name_of_qname(qname: Column | str) -> Column:
    return F.regexp_replace(as_column(qname), r"^[^:]*:", "")


def local_name_of_clark(tag: Column | str) -> Column:
    return F.regexp_replace(as_column(tag), r"^\{[^}]*\}", "")


def strip_markup(html: Column | str) -> Column:
    """Script, style and tags become blanks, blanks collapse; entities stay for ``unescape``."""
    text = F.regexp_replace(as_column(html), r"(?is)<(script|style)\b.*?</\1>", " ")
    return collapse(F.regexp_replace(text, r"(?s)<[^>]+>", " "))


def _replace_once(text: Column, pattern: str, by: str) -> Column:
    """``regexp_replace`` changes every match; anchoring at the start keeps it to the first one."""
    return F.regexp_replace(text, rf"(?is)^(.*?){pattern}", f"$1{by}")


def normalise_charset_tag(html: Column | str) -> Column:
    """First charset and first content-type declaration become utf-8; without any, one is added to the head."""
    tag = '<meta charset="utf-8">'
    text = _replace_once(as_column(html), r"<meta[^>]+charset\s*=\s*[\"']?[^\"'>\s]+[\"']?[^>]*>", tag)
    text = _replace_once(text, r"<meta[^>]+http-equiv\s*=\s*[\"']content-type[\"'][^>]*>", tag)
    return F.when(text.rlike(r"(?i)<meta[^>]+charset="), text).otherwise(
        F.regexp_replace(text, r"(?is)^(.*?<head[^>]*>)", f"$1\n{tag}")
    )
