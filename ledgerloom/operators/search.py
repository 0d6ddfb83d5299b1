"""Registry search and filing selection."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom import dims
from ledgerloom.functions.text import as_column, collapse, squeeze, strip
from ledgerloom.operators.select import pick_first
from ledgerloom.session import cut_lineage

# How periodic reports are named, by report code.
REPORT_NAMES = {
    "11011": ("사업보고서", "12"),
    "11012": ("반기보고서", "06"),
    "11013": ("분기보고서", "03"),
    "11014": ("분기보고서", "09"),
}
# Words in names of filings and attachments.
AUDIT_FILING_WORDS = ("감사보고서", "사업보고서")
AUDIT_TITLE_END = "감사보고서"
AUDIT_TITLE_EXCLUDED = ("영문감사보고서", "감사의감사보고서", "감사의의견서", "내부감시장치", "내부회계관리제도")
CONSOLIDATED_TITLE = "연결감사보고서"

SEARCH_LIMIT = 20


def _active(df: DataFrame, active_only: bool) -> DataFrame:
    return df.filter(F.col("is_active")) if active_only else df


def search_by_name(
    corporations: DataFrame, keywords: Sequence[str], active_only: bool = True, limit: int = SEARCH_LIMIT
) -> DataFrame:
    """Companies whose name contains a keyword: exact names first, then by name, ``limit`` per keyword.

    Case is ignored and the keyword is taken literally. All keywords share one pass over the registry.
    """
    if limit <= 0:
        raise ValueError("limit has to be positive")
    words = [k.strip() for k in keywords]
    if not all(words):
        raise ValueError("a keyword must not be blank")
    hits = F.filter(
        F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(F.col("corp_name")), F.lower(w))
    )
    found = _active(corporations, active_only).select("*", F.explode(hits).alias("query"))
    order = Window.partitionBy("query").orderBy(
        F.when(F.col("corp_name") == F.col("query"), 0).otherwise(1), "corp_name", "corp_code"
    )
    return found.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit)


def find_corporations(
    corporations: DataFrame, queries: Sequence[str], active_only: bool = True, limit: int = SEARCH_LIMIT
) -> DataFrame:
    """Route each query: six digits are a stock code, eight a company code, anything else a name."""
    texts = [q.strip() for q in queries]
    if not all(texts):
        raise ValueError("a query must not be blank")
    stock = [q for q in texts if re.fullmatch(r"\d{6}", q)]
    corp = [q for q in texts if re.fullmatch(r"\d{8}", q)]
    names = [q for q in texts if q not in stock and q not in corp]
    active = _active(corporations, active_only)
    parts = []
    if stock:
        parts.append(active.filter(F.col("stock_code").isin(*stock)).withColumn("query", F.col("stock_code")))
    if corp:
        parts.append(active.filter(F.col("corp_code").isin(*corp)).withColumn("query", F.col("corp_code")))
    parts = [p.withColumn("position", F.lit(1)) for p in parts]
    if names:
        parts.append(search_by_name(corporations, names, active_only, limit))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


# ---- queries from a table ------------------------------------------------------------------------
#: At most so many lengths of grams are listed; queries of a length between them are verified.
GRAM_SIZES = 16


def _grams(text: Column, size: Column) -> Column:
    """Distinct stretches of ``size`` code points; a shorter text has none."""
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(starts, lambda at: F.substring(text, at, size)))).otherwise(
        F.array().cast("array<string>")
    )


def _sizes(words: DataFrame) -> list[int]:
    """Lengths of the words in ascending order; of more than ``GRAM_SIZES`` the least and some between."""
    lengths = sorted(words.agg(F.collect_set(F.length("_word")).alias("l")).first()["l"])  # one row
    steps = min(len(lengths), GRAM_SIZES)
    return [lengths[i * len(lengths) // steps] for i in range(steps)]


def containing(rows: DataFrame, fields: Sequence[str], queries: DataFrame) -> DataFrame:
    """``(query, columns of rows)`` for every row and query where a field contains the query; case is ignored.

    An inverted index instead of a test of every row against every query. Grams are as long as the queries are: most
    queries are a gram and meet only rows that hold them. If there are more lengths than ``GRAM_SIZES``, a query between
    two is looked up under the one of its grams with the shortest list. The index holds numbers of rows, and only of
    grams that queries have; hits are verified. Blank queries find nothing.
    """
    words = queries.select("query").distinct().withColumn("_word", F.lower(strip("query"))).where("_word <> ''")
    sizes = F.array(*[F.lit(n) for n in _sizes(words)]).cast("array<int>")
    size = F.array_max(F.filter(sizes, lambda n: n <= F.length("_word")))
    asked = words.select("query", "_word", F.explode(_grams(F.col("_word"), size)).alias("_gram"))
    numbered = cut_lineage(rows.withColumn("_row", F.monotonically_increasing_id()))
    texts = F.array(*[F.lower(F.coalesce(F.col(f), F.lit(""))) for f in fields])
    listed = F.flatten(F.transform(texts, lambda text: F.flatten(F.transform(sizes, lambda n: _grams(text, n)))))
    listed = F.array_distinct(listed) if len(fields) > 1 else listed
    postings = cut_lineage(numbered.select("_row", F.explode(listed).alias("_gram")).join(
        asked.select("_gram").distinct().hint("shuffle_hash"), "_gram", "left_semi"
    ))
    lengths = postings.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    counted = asked.join(lengths, "_gram", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    shortest = pick_first(counted, ["query"], [F.col("_n").asc(), F.col("_gram").asc()])
    found = shortest.join(postings, "_gram").select("query", "_word", "_row").join(numbered, "_row")
    return found.where(F.exists(texts, lambda text: F.contains(text, F.col("_word")))).select("query", *rows.columns)


def _ranked(found: DataFrame, limit: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(
        F.when(F.col("corp_name") == strip("query"), 0).otherwise(1), "corp_name", "corp_code"
    )
    return found.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit)


def search_names(corporations: DataFrame, queries: DataFrame, active_only: bool = True, limit: int = SEARCH_LIMIT) -> DataFrame:
    """``search_by_name`` for a table of queries: exact names first, then by name, ``limit`` for each query."""
    return _ranked(containing(_active(corporations, active_only), ["corp_name"], queries), limit)


def route_queries(corporations: DataFrame, queries: DataFrame, active_only: bool = True, limit: int = SEARCH_LIMIT) -> DataFrame:
    """``find_corporations`` for a table of queries: codes are found by equality, anything else as a name.

    A code is a key of its own, so that it is not looked for in names and names are not looked for in codes.
    """
    text = strip("query")
    code = F.when(text.rlike(r"^[0-9]{6}$"), F.concat(F.lit("s"), text)).when(text.rlike(r"^[0-9]{8}$"), F.concat(F.lit("c"), text))
    asked = queries.select("query").distinct().withColumn("_code", code)
    rows = _active(corporations, active_only)
    keys = F.array_compact(F.array(F.concat(F.lit("s"), "stock_code"), F.concat(F.lit("c"), "corp_code")))
    coded = rows.withColumn("_code", F.explode(keys)).join(asked.where(F.col("_code").isNotNull()), "_code").drop("_code")
    named = containing(rows, ["corp_name"], asked.where(F.col("_code").isNull()))
    found = named.unionByName(coded)
    return _ranked(found, limit)


def count_matches(corporations: DataFrame, queries: DataFrame) -> DataFrame:
    """``count_by_keyword`` for a table of queries: active companies with it in name, stock code or company code."""
    found = containing(corporations.filter(F.col("is_active")), ["corp_name", "stock_code", "corp_code"], queries)
    counts = found.groupBy(F.col("query").alias("_of")).agg(F.count(F.lit(1)).alias("total_count"))
    asked = queries.select("query").distinct()
    return asked.join(counts, F.col("query") == F.col("_of"), "left").select("query", F.coalesce("total_count", F.lit(0)).alias("total_count"))


def count_by_keyword(corporations: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """Active companies with the keyword in name, stock code or company code, per keyword."""
    fields = [F.lower(F.coalesce(c, F.lit(""))) for c in ("corp_name", "stock_code", "corp_code")]
    active = corporations.filter(F.col("is_active"))
    counts = active.agg(
        *[
            F.count_if(
                fields[0].contains(w.strip().lower())
                | fields[1].contains(w.strip().lower())
                | fields[2].contains(w.strip().lower())
            ).alias(f"c{i}")
            for i, w in enumerate(keywords)
        ]
    )
    pairs = F.array(
        *[F.struct(F.lit(w.strip()).alias("query"), F.col(f"c{i}").alias("total_count")) for i, w in enumerate(keywords)]
    )
    return counts.select(F.inline(pairs))


def periodic_reports(disclosures: DataFrame, ordinal: str) -> DataFrame:
    """Latest filing per (company, business year, report code).

    The name, year and month are read from the filing name, so no request list has to be joined. A
    filing counts when it was received between the start of the year and the end of the next one.
    """
    names = "|".join(dict.fromkeys(name for name, _ in REPORT_NAMES.values()))
    pattern = rf"(?:{names})\([0-9]{{4}}\.[0-9]{{2}}\)"
    plain = F.replace(F.coalesce("report_nm", F.lit("")), F.lit(" "), F.lit(""))
    mention = F.explode(F.array_distinct(F.regexp_extract_all(plain, F.lit(f"({pattern})"), 1)))
    code = None
    for report_code, (name, month) in REPORT_NAMES.items():
        hit = F.col("mention").startswith(name) & F.col("mention").endswith(f".{month})")
        code = F.when(hit, report_code) if code is None else code.when(hit, report_code)
    dated = (
        disclosures.withColumn("mention", mention)
        .withColumn("bsns_year", F.regexp_extract("mention", r"\(([0-9]{4})\.", 1))
        .withColumn("reprt_code", code)
        .filter(F.col("reprt_code").isNotNull())
    )
    start = F.concat("bsns_year", F.lit("0101"))
    end = F.concat((F.col("bsns_year").cast("int") + 1).cast("string"), F.lit("1231"))
    windowed = dated.filter(F.col("rcept_dt").between(start, end))
    return pick_first(
        windowed, ["corp_code", "bsns_year", "reprt_code"], [F.col("rcept_dt").desc(), F.col(ordinal).asc()]
    ).drop("mention")


def is_audit_filing(report_name: Column | str) -> Column:
    name = squeeze(as_column(report_name))
    return name.contains(AUDIT_FILING_WORDS[0]) | name.contains(AUDIT_FILING_WORDS[1])


def audit_filings(disclosures: DataFrame, ordinal: str) -> DataFrame:
    """Audit-related filings, one per receipt number (the last listed), with the business year they report on."""
    related = disclosures.filter(is_audit_filing("report_nm") & (F.coalesce("rcept_no", F.lit("")) != ""))
    once = pick_first(related, ["rcept_no"], [F.col(ordinal).desc()])
    return once.withColumn("bsns_year", (F.substring("rcept_dt", 1, 4).cast("int") - 1).cast("string"))


def latest_audit_filings(disclosures: DataFrame, ordinal: str) -> DataFrame:
    """Latest audit filing per company and business year: received in the year after it."""
    return pick_first(
        audit_filings(disclosures, ordinal),
        ["corp_code", "bsns_year"],
        [F.col("rcept_dt").desc(), F.col("rcept_no").desc()],
    )


def is_audit_title(title: Column | str) -> Column:
    name = squeeze(as_column(title))
    return name.endswith(AUDIT_TITLE_END) & ~name.rlike("|".join(AUDIT_TITLE_EXCLUDED))


def canonical_title(title: Column | str) -> Column:
    text = collapse(as_column(title))
    return (
        F.when(text.contains(CONSOLIDATED_TITLE), CONSOLIDATED_TITLE)
        .when(text.contains(AUDIT_TITLE_END), AUDIT_TITLE_END)
        .otherwise(text)
    )


def audit_attachments(attachments: DataFrame, ordinal: str) -> DataFrame:
    """Audit reports among the attachments (titles already unescaped), one per (document, scope)."""
    chosen = (
        attachments.filter(is_audit_title("title") & (F.coalesce("dcm_no", F.lit("")) != ""))
        .withColumn("title", canonical_title("title"))
        .withColumn("is_consolidated", squeeze("title").contains(CONSOLIDATED_TITLE))
    )
    return pick_first(chosen, ["rcept_no", "dcm_no", "is_consolidated"], [F.col(ordinal).desc()])


def pick_attachment(attachments: DataFrame, ordinal: str, consolidated: bool | None = None) -> DataFrame:
    """One attachment per filing; the consolidated one first unless a scope is asked for."""
    candidates = audit_attachments(attachments, ordinal)
    if consolidated is not None:
        candidates = candidates.filter(F.col("is_consolidated") == F.lit(consolidated))
    order = [F.col("is_consolidated").desc(), F.col("title").asc(), F.col(ordinal).asc()]
    return pick_first(candidates, ["rcept_no"], order)


def pick_attachments(attachments: DataFrame, ordinal: str) -> DataFrame:
    """``pick_attachment`` for ``asked`` = any scope and separate alone, from one pass over the candidates."""
    candidates = audit_attachments(attachments, ordinal)
    asked = F.array_compact(F.array(F.lit("any"), F.when(~F.col("is_consolidated"), "separate")))
    order = [F.col("is_consolidated").desc(), F.col("title").asc(), F.col(ordinal).asc()]
    return pick_first(candidates.withColumn("asked", F.explode(asked)), ["rcept_no", "asked"], order)


def statement_view(statements: DataFrame, **equals: str | None) -> DataFrame:
    """Stored rows with any of the equality filters given; filters reach the scan."""
    for column, value in equals.items():
        if value is not None:
            statements = statements.filter(F.col(column) == value)
    return statements


def with_statement_name(statements: DataFrame) -> DataFrame:
    names = dims.rows_frame(statements.sparkSession, list(dims.STATEMENT_NAMES.items()), "sj_div string, statement_name string")
    return statements.join(names, "sj_div", "left")


def ratio_view(ratios: DataFrame, **equals: str | None) -> DataFrame:
    """Stored ratios with any of year, report, scope and version given, in report order."""
    return statement_view(ratios, **equals).orderBy("reprt_code", "fs_div", "ratio_code", "corp_code", "bsns_year")


def lookup(rows: DataFrame, requests: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored rows that equal a request in every key. Requests with a blank key match nothing; see ``blank_requests``."""
    return rows.join(requests.filter(_complete(keys)).select(*keys), list(keys), "left_semi")


def blank_requests(requests: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Requests that leave a key blank."""
    return requests.filter(~_complete(keys))


def _complete(keys: Sequence[str]) -> Column:
    complete = F.lit(True)
    for key in keys:
        complete = complete & (F.coalesce(F.col(key), F.lit("")) != "")
    return complete


def ratio_lookup(
    ratios: DataFrame, corp_code: str, bsns_year: str, reprt_code: str, fs_div: str, ratio_code: str, version: str = "v1"
) -> DataFrame:
    """The one stored result of a ratio, or nothing."""
    return statement_view(
        ratios, corp_code=corp_code, bsns_year=bsns_year, reprt_code=reprt_code, fs_div=fs_div, ratio_code=ratio_code,
        calculation_version=version,
    )


def all_corporations(corporations: DataFrame, active_only: bool = True) -> DataFrame:
    return _active(corporations, active_only).orderBy("corp_name", "corp_code")


def industry_corporations(members: DataFrame, corporations: DataFrame, industry_id: int | None = None) -> DataFrame:
    """Companies of one industry, or of every industry, by name."""
    chosen = members if industry_id is None else members.filter(F.col("industry_id") == industry_id)
    return chosen.join(corporations, "corp_code").orderBy("industry_id", "corp_name", "corp_code")


def row_counts(corporations: DataFrame, statements: DataFrame) -> DataFrame:
    """Stored rows per company; companies without statements count zero."""
    stored = statements.groupBy("corp_code").agg(F.count(F.lit(1)).alias("statement_rows"))
    return corporations.select("corp_code").join(stored, "corp_code", "left").withColumn(
        "statement_rows", F.coalesce("statement_rows", F.lit(0))
    )
