"""Helpers of the pipeline operators: written tables that cut lineage, and the size of Python batches."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

def stash(df: DataFrame, label: str) -> DataFrame:
    """Write a table into the folder all executors share and read it back.

    The result no longer depends on earlier stages, so a lost executor costs only
    the tasks it was running. The folder is removed when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``.

    Only a session on one machine may go without: it gets a folder of its own. On a cluster that names none this is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[[^,]*\]|\[\*.*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="billquarry-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Let Spark send texts to Python in batches of about 4 MB instead of 10,000 rows, whatever their length.

    The setting stays in the session, because it is read when a result is computed; a smaller one is left as it is.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name, None)
    if not (held and held.isdigit() and 0 < int(held) <= most):
        spark.conf.set(name, str(most))
