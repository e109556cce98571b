"""Session defaults and the shared folder that lineage cuts and tables are written to."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings tests and benchmarks use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("maskloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A local session without the setting gets a temporary folder. A cluster session without it
    is an error: a machine-local folder would be lost together with its executor.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None)
    context = spark.sparkContext
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by the whole cluster")
        root = tempfile.mkdtemp(prefix="maskloom-")
        spark.conf.set(CHECKPOINT_CONF, root)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a frame to the checkpoint folder and continue from there.

    For narrow results that several later steps read, such as a random order or a sample.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint()
