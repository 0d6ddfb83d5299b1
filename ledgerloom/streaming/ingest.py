"""Statement ingest over a growing landing folder: the batch job per micro-batch, or keyed state beside the table."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StringType, StructField, StructType

from ledgerloom.operators import merge
from ledgerloom.plans import tables
from ledgerloom.plans.jobs import Store, append_statements, corporations, sync_statements
from ledgerloom.sources import statements as delivered
from ledgerloom.sources.statements import ENVELOPE


def stream_answers(spark: SparkSession, landing: str, files_per_batch: int = 1000) -> DataFrame:
    """Answers as they land; the requested scope is the ``fs_div=`` folder."""
    schema = StructType([*ENVELOPE.fields, StructField("fs_div", StringType())])
    return (
        spark.readStream.schema(schema)
        .option("multiLine", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(landing)
    )


def _begun(at: str | None) -> str:
    return at or datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")


def ingest_stream(
    spark: SparkSession, store: Store, landing: str, progress: str, at: str | None = None, files_per_batch: int = 1000
) -> StreamingQuery:
    """Process everything that has landed and stop. A repeated micro-batch stores nothing twice.

    Rows carry the time ``at``, or else the time at which their micro-batch was begun.
    """

    def run(batch: DataFrame, _: int) -> None:
        sync_statements(batch.sparkSession, store, batch, _begun(at))

    return (
        stream_answers(spark, landing, files_per_batch)
        .writeStream.foreachBatch(run)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )


def new_statements(answers: DataFrame, corporations: DataFrame) -> DataFrame:
    """Rows of a stream of answers (with ``file``) whose key was never seen before, by one state per key.

    Of several rows of a key in a micro-batch the first delivered counts. A row without order number has a key of its own:
    its file and place. The state is all that is kept of stored rows, so a micro-batch does not read the table.
    """
    rows = delivered.for_storage(delivered.ingest(answers, keep=["file"]).rows)
    known = rows.join(corporations.select("corp_code"), "corp_code", "left_semi")
    own = F.when(F.col("ord").isNull(), F.concat_ws(":", "file", F.col(delivered.PLACE).cast("string"))).otherwise("")
    key = F.to_json(F.struct(*merge.STATEMENT_KEY, own.alias("own")))
    keyed = known.withColumn("key", F.sha2(key, 256))
    schema = keyed.drop("key", "file").schema
    names = schema.names

    def first(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            return
        state.update((True,))
        whole = pd.concat(list(parts), ignore_index=True)
        yield whole.sort_values([delivered.PLACE, "thstrm_amount", "frmtrm_amount"], na_position="first", kind="stable")[names].iloc[:1]

    return keyed.groupBy("key").applyInPandasWithState(first, schema, "stored boolean", "append", GroupStateTimeout.NoTimeout)


def ingest_keyed_stream(
    spark: SparkSession, store: Store, landing: str, progress: str, at: str | None = None, files_per_batch: int = 1000
) -> StreamingQuery:
    """``ingest_stream`` for a table that only this stream writes: what is stored is known from its state.

    A micro-batch that is run again after a failure finds the commit of its number and stores nothing.
    """
    answers = stream_answers(spark, landing, files_per_batch).withColumn("file", F.col("_metadata.file_path"))

    def run(batch: DataFrame, number: int) -> None:
        session, path, name = batch.sparkSession, store.path("commits"), f"stream {progress} {number}"
        done = tables.last_commit(session, path, name)
        rows = batch.filter(done.select("commit").scalar() == 0)
        append_statements(session, store, rows, _begun(at))
        tables.add_commit(done, path, name, session.createDataFrame([(0,)], "id bigint"))

    return (
        new_statements(answers, corporations(spark, store))
        .writeStream.foreachBatch(run)
        .outputMode("append")
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
