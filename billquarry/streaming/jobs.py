"""Structured Streaming jobs: ingest, content de-duplication, monthly totals, current state.

A job has a name and keeps its checkpoint and its output below the folder all executors share. Started again under its name
it goes on where it ended and reads only files that are new since. Totals and states are Spark's own streaming state; each
batch writes the rows that changed into a folder of its own, so a batch that runs again after a loss replaces its output.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from billquarry.session import shared_dir
from billquarry.sources.blobs import with_digest
from billquarry.sources.files import admitted
from billquarry.streaming.digests import DigestStore

Write = Callable[[DataFrame, int], None]


@dataclass
class Result:
    """Where a job wrote its batches, what their rows look like, and how many rows this run read."""

    spark: SparkSession
    path: str
    schema: StructType
    rows_read: int = 0
    #: of each batch of this run that compares with stored digests, the buckets it opened
    opened: list[int] = field(default_factory=list)

    def rows(self) -> DataFrame:
        """Rows of all batches with the number of their ``batch``; none if no batch ran."""
        kinds = StructType.fromJson(self.schema.jsonValue()).add("batch", "long")
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], kinds)
        return self.spark.read.schema(kinds).parquet(self.path)

    def latest(self, keys: list[str]) -> DataFrame:
        """The last row written for each key."""
        rest = [c for c in self.schema.names if c not in keys]
        newest = self.rows().groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row"))
        return newest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def job_of(name: str, source: str) -> str:
    """Name under which a job over one source goes on where it ended."""
    return f"{name}-{hashlib.md5(source.encode()).hexdigest()[:12]}"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def parquet_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream over one table: a folder of part files, or a single file."""
    path = f"{folder}/{name}.parquet"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    is_folder = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()
    arriving = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    return arriving.parquet(path) if is_folder else arriving.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def file_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Arriving files with their path, size and content."""
    kinds = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(kinds).option("recursiveFileLookup", "true").load(folder).withColumnRenamed("length", "size")


def run_to_end(stream: DataFrame, job: str | None = None, mode: str = "append", write: Callable[[str], Write] | None = None, result: Result | None = None) -> Result:
    """Process everything that arrived since the last run of ``job``, then stop; a job without a name starts anew.

    ``write`` makes the function that stores a batch, given the folder of the job; by default each batch is a folder.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/streams/{job or uuid.uuid4().hex}"
    result = result or Result(spark, "", stream.schema)
    result.path = f"{base}/out"

    def folder(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{result.path}/batch={number}")

    started = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    query = started.foreachBatch(write(base) if write else folder).start()
    query.awaitTermination()
    result.rows_read = sum(p["numInputRows"] for p in query.recentProgress)
    return result


def ingest(listing: DataFrame) -> DataFrame:
    """Admitted files of a stream of (path, size, ...)."""
    return admitted(listing)


def ingest_texts(arriving: DataFrame) -> DataFrame:
    """Rows of a text table from arriving files with content: path, size, digest and the decoded text."""
    kept = with_digest(admitted(arriving), "content")
    return kept.select("path", "size", "digest", F.decode("content", "UTF-8").alias("text"))


def new_contents(stream: DataFrame, content: str = "content", job: str | None = None) -> Result:
    """First occurrence of every content, however much later a copy arrives, through a store of digests with a filter for
    each bucket: a batch of new contents opens no bucket, whatever the store holds."""
    keyed = with_digest(stream, content).select("digest", F.octet_length(content).cast("long").alias("size"))
    result = Result(stream.sparkSession, "", keyed.schema)

    def write(base: str) -> Write:
        store = DigestStore(stream.sparkSession, base)
        return lambda batch, number: result.opened.append(store.add(batch, number))

    return run_to_end(keyed, job, write=write, result=result)


def monthly_amounts(stream: DataFrame, date: str, cents: str = "cents", job: str | None = None) -> Result:
    """Sum and count per month, kept in Spark's state: one row per month, so late rows count in their month and there is no
    watermark. ``latest(["month"])`` are the totals."""
    monthly = stream.groupBy(F.date_format(date, "yyyy-MM").alias("month")).agg(F.sum(F.col(cents).cast("long")).alias("cents"), F.count(F.lit(1)).alias("count"))
    return run_to_end(monthly, job, "update")


def current_state(stream: DataFrame, key: str, order: list[str], payload: list[str], job: str | None = None) -> Result:
    """Newest payload per key by ``order``, kept in Spark's state: one row per key. ``latest([key])`` is the state."""
    names = list(dict.fromkeys([*order, *payload]))
    newest = stream.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(*order)).alias("_row"))
    return run_to_end(newest.select(key, *[F.col(f"_row.{c}").alias(c) for c in names]), job, "update")
