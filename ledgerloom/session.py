"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "ledgerloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    ship_package(session)
    return session


def ship_package(spark: SparkSession) -> None:
    """Send the package to the workers, which import it by name and need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_ledgerloom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="ledgerloom-"), "ledgerloom"), "zip", os.path.dirname(root), os.path.basename(root)
    )
    context.addPyFile(archive)
    context._ledgerloom_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that ``spark.checkpoint.dir`` names; a local master without one gets its own."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        shared = tempfile.mkdtemp(prefix="ledgerloom-checkpoints-")
    context.setCheckpointDir(shared)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal the rows of a scan to ``spark.ledgerloom.spread`` tasks; without that setting the splits stay as they are.

    For tables of few large row groups, which a scan cannot split, before heavy work on each row.
    """
    wanted = df.sparkSession.conf.get("spark.ledgerloom.spread", None)
    return df.repartition(int(wanted), *keys) if wanted else df


def cut_lineage(df: DataFrame) -> DataFrame:
    """Persist ``df`` reliably so that later passes see the same rows in the same partitions."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, for files that a job writes and reads back; deleted when the driver ends."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{label}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as compressed Parquet in the shared folder and read again: its lineage ends there.

    For wide rows: a checkpoint is computed twice and holds them uncompressed.
    """
    folder = f"{scratch_folder(df.sparkSession, label)}/table"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
