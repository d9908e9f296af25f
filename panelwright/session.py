"""Session helpers: local session for tests and bench, shared working folders."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; cluster jobs bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("panelwright")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session without the setting gets a temporary folder; on a
    cluster the setting is required, because a machine-local folder is lost with
    its executor.
    """
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_KEY, None) or context.getCheckpointDir()
    if folder:
        return folder
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError(f"{CHECKPOINT_KEY} must name a shared folder")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="panelwright-"))
    return context.getCheckpointDir()


def work_folder(spark: SparkSession, label: str) -> str:
    """A new, never reused folder below the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/panelwright/{label}-{uuid.uuid4().hex}"


def written_once(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Cuts the lineage like a checkpoint, but in a columnar file with a known size:
    later reads prune columns, and a lost executor never recomputes what led here.
    """
    path = work_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
