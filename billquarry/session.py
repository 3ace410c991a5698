"""Session defaults and the shared folder used for checkpoints and written tables."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def build_session(app: str = "billquarry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the adaptive settings every plan here relies on.

    Nothing about partition counts is fixed for a cluster: adaptive execution
    coalesces small shuffle partitions and splits skewed ones at run time.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster in ``spark.checkpoint.dir``.

    Only a session whose driver and executors are one process may go without: it gets a fresh folder of its own.
    A cluster that names no folder gets an error instead of a folder that other machines cannot read.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    chosen = tempfile.mkdtemp(prefix="billquarry-")
    spark.conf.set("spark.checkpoint.dir", chosen)
    return chosen
