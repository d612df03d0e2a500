"""Session settings and shared scratch space."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(name: str = "beckon", cores: str = "8", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine; Python workers find this package wherever it starts."""
    home = str(Path(__file__).resolve().parent.parent)
    if home not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [home, os.environ.get("PYTHONPATH")]))
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_local_scratch: tempfile.TemporaryDirectory | None = None


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A new folder for data written along the way.

    Taken from ``spark.checkpoint.dir``, else from the context's checkpoint folder,
    which every executor can reach.  Where both are unset, a session on one machine
    (``local`` master) uses a temporary folder, which goes away with the process; any
    other session raises an error, since executors would write to their own disks.
    """
    global _local_scratch
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if _local_scratch is None:
            _local_scratch = tempfile.TemporaryDirectory(prefix="beckon-")
        shared = _local_scratch.name
    return f"{shared.rstrip('/')}/beckon/{purpose}-{uuid.uuid4().hex}"


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """The same rows, written to scratch space and read back.

    Cuts the lineage of a narrow table that a plan needs several times: it is
    computed once, survives lost executors, its size is known to the join
    planner, and AQE can split a skewed join on it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def where_computed(df: DataFrame, condition: str) -> DataFrame:
    """Filter on columns that are costly to compute, without computing them twice.

    The optimizer moves a filter below the projections by repeating their
    expressions inside it.  A row number is not deterministic, so a filter that
    mentions one stays above, where the columns are ready.
    """
    return df.withColumn("_at", F.monotonically_increasing_id()).where(
        f"({condition}) AND _at >= 0").drop("_at")
