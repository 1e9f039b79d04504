"""Session defaults shared by the command-line tools, the bench and the tests."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cpus: int | str = "*", app: str = "shelfsight") -> SparkSession:
    """A local session for tests and the bench. On a cluster the caller passes its own."""
    parts = os.environ.get("SHELFSIGHT_SHUFFLE_PARTITIONS", "8")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", parts)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the session.

    Only a local session that names none, as in tests, gets one of its own, the same for all its jobs.
    """
    ctx = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_KEY, None) or ctx.getConf().get(CHECKPOINT_KEY) or ctx.getCheckpointDir()
    if not named:
        if not ctx.master.startswith("local["):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that every executor can reach")
        ctx.setCheckpointDir(tempfile.mkdtemp(prefix="shelfsight-ckpt-"))
        named = ctx.getCheckpointDir()
    return named
