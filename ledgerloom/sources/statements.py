"""Delivered statement answers: ``{status, message, list: [row]}`` to typed rows and rejects."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.amounts import amount_is_bad, parse_amount, parse_order
from ledgerloom.functions.text import clean_text
from ledgerloom.operators.quality import required, with_reasons
from ledgerloom.operators.select import with_once
from ledgerloom.session import cut_lineage

# The delivered fields and the answer codes.
TEXT_FIELDS = (
    "rcept_no", "reprt_code", "bsns_year", "corp_code", "fs_nm", "sj_div", "sj_nm", "account_id", "account_nm",
    "account_detail", "thstrm_nm", "frmtrm_nm", "frmtrm_q_nm", "bfefrmtrm_nm", "currency",
)
AMOUNT_FIELDS = (
    "thstrm_amount", "thstrm_add_amount", "frmtrm_amount", "frmtrm_q_amount", "frmtrm_add_amount", "bfefrmtrm_amount",
)
REQUIRED_FIELDS = ("rcept_no", "reprt_code", "bsns_year", "corp_code", "sj_div", "account_nm")
STATUS_OK = "000"
STATUS_NO_DATA = "013"

ROW = T.StructType([T.StructField(n, T.StringType()) for n in (*TEXT_FIELDS, *AMOUNT_FIELDS, "ord")])
ENVELOPE = T.StructType(
    [
        T.StructField("status", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("list", T.ArrayType(ROW)),
    ]
)


#: Position of a row in its answer, from 0: the first delivered row of a key is the one that is stored.
PLACE = "delivered_place"


@dataclass(frozen=True)
class Ingest:
    """Delivered answers as rows: a row of a statement with the reasons against it, or an answer that was an error."""

    parsed: DataFrame

    @property
    def checked_rows(self) -> DataFrame:
        return self.parsed.filter(F.col("_answer").isNull()).drop("_answer")

    @property
    def rows(self) -> DataFrame:
        return self.checked_rows.filter(F.size("reasons") == 0).drop("reasons")

    @property
    def rejected_rows(self) -> DataFrame:
        return self.checked_rows.filter(F.size("reasons") > 0)

    @property
    def rejected_answers(self) -> DataFrame:
        return self.parsed.filter(F.col("_answer").isNotNull()).select("_answer.*")


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """Landed answers, one JSON document per file; the requested scope is the ``fs_div=`` folder."""
    return spark.read.schema(ENVELOPE).option("multiLine", True).json(path)


def answers_from_text(payloads: DataFrame, payload: str = "payload", **requested: Column) -> DataFrame:
    raw = payloads.select(*[c.alias(n) for n, c in requested.items()], F.col(payload).alias("_payload"))
    return with_once(raw, "_answer", F.from_json("_payload", ENVELOPE)).select(*requested, "_answer.*")


def answer_reason() -> Column:
    """Why an answer cannot be used, or null. One without data is rejected with its own reason, so callers can tell."""
    status = F.coalesce("status", F.lit(""))
    return (
        F.when(status == STATUS_NO_DATA, "no_data")
        .when(status != STATUS_OK, "status_error")
        .when(F.col("list").isNull(), "missing_list")
    )


def ingest(answers: DataFrame, strict: bool = False, keep: Sequence[str] = ()) -> Ingest:
    """``answers`` has the envelope columns and the requested ``fs_div``.

    ``strict`` fails on the first bad row, as a reader that aborts the whole batch does. ``keep``: columns of the answers
    that their rows carry on.
    """
    reason = answer_reason()
    others = [F.col(c) for c in answers.columns if c != "list"]
    tagged = answers.select(
        *keep, F.col("fs_div").alias("_scope"), F.when(reason.isNotNull(), F.struct(*others, reason.alias("reason"))).alias("_answer"),
        F.when(reason.isNull(), F.col("list")).alias("_list"),
    )
    placed = tagged.select(*keep, "_scope", "_answer", F.posexplode_outer("_list").alias("_place", "_row"))
    # an answer that is an error stays as one row, a usable one without rows does not
    raw = placed.filter(F.col("_place").isNotNull() | F.col("_answer").isNotNull()).select(
        *keep, "_scope", "_answer", F.col("_place").alias(PLACE), "_row.*"
    )
    checked = with_reasons(
        raw,
        {
            **required(REQUIRED_FIELDS),
            **{f"amount:{n}": ~F.coalesce(amount_is_bad(n), F.lit(False)) for n in AMOUNT_FIELDS},
            "order": clean_text("ord").isNull() | parse_order("ord").isNotNull(),
        },
    )
    typed = checked.select(
        *[clean_text(n).alias(n) for n in TEXT_FIELDS],
        clean_text("_scope").alias("fs_div"),
        *[parse_amount(n).alias(n) for n in AMOUNT_FIELDS],
        parse_order("ord").alias("ord"),
        PLACE,
        *keep,
        "reasons",
        "_answer",
    )
    if strict:
        message = F.concat(F.lit("invalid statement row: "), F.array_join("reasons", ", "))
        bad = F.col("_answer").isNull() & (F.size("reasons") > 0)
        typed = typed.filter(F.when(bad, F.raise_error(message).cast("boolean")).otherwise(True))
    return Ingest(typed)


def settle(result: Ingest) -> Ingest:
    """The same with everything parsed written once, for jobs that use it several times."""
    return Ingest(cut_lineage(result.parsed))


def for_storage(rows: DataFrame) -> DataFrame:
    """Account id and detail are part of the unique key: empty text instead of null."""
    return rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("account_id", "account_detail")})
