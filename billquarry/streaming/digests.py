"""Digests of all contents seen, in buckets with a filter for each.

A digest's first two hexadecimal digits name its bucket, three of its further digits places in the bucket's Bloom filter.
Filters have a fixed size. A batch reads them first, and of the digests only those buckets in which one of its own digests
may be; contents that are new open none but by chance, however long the history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Bits of a filter as a power of two, and places of a digest in it.
BITS, PLACES = 20, 3
_ROWS = StructType([StructField("digest", StringType()), StructField("size", LongType()), StructField("bucket", StringType()), StructField("batch", LongType())])
_FILTER = "bucket string, word long, bits long"


def _places(rows: DataFrame) -> DataFrame:
    """A row for each place of a digest: ``word`` of the filter and the ``bit`` in it."""
    at = F.array(*[F.conv(F.substring("digest", 3 + 6 * n, 6), 16, 10).cast("long") % (1 << BITS) for n in range(PLACES)])
    return rows.withColumn("_at", F.explode(F.array_distinct(at))).withColumn("word", F.shiftright("_at", 6)).withColumn("bit", F.expr("shiftleft(1L, CAST(_at % 64 AS INT))")).drop("_at")


class DigestStore:
    """Digests in ``out`` by bucket and batch; filters of all buckets after each batch in ``filters``."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.digests, self.filters = spark, f"{base}/out", f"{base}/filters"

    def filter_before(self, number: int) -> DataFrame:
        return self.spark.read.schema(_FILTER).parquet(f"{self.filters}/batch={number - 1}") if number else self.spark.createDataFrame([], _FILTER)

    def add(self, batch: DataFrame, number: int) -> int:
        """Stores the digests (``digest``, ``size``) that no batch before had; returns the number of buckets opened."""
        rows = batch.dropDuplicates(["digest"]).withColumn("bucket", F.substring("digest", 1, 2)).persist()
        try:
            known = self.filter_before(number)
            placed = _places(rows).join(known, ["bucket", "word"], "left")
            held = F.bool_and(F.coalesce(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.lit(False)))
            maybe = placed.groupBy("digest", "bucket").agg(held.alias("held")).where("held").select("digest", "bucket").persist()
            opened = [r["bucket"] for r in maybe.select("bucket").distinct().collect()]  # 256 at most
            new = rows
            if opened:
                stored = self.spark.read.schema(_ROWS).parquet(self.digests).where(F.col("bucket").isin(opened) & (F.col("batch") < number))
                new = rows.join(maybe.join(stored.select("bucket", "digest"), ["bucket", "digest"], "left_semi"), ["bucket", "digest"], "left_anti")
            stamped = new.select("digest", "size", "bucket", F.lit(number).cast("long").alias("batch"))
            stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(self.digests)
            fresh = _places(new).select("bucket", "word", F.col("bit").alias("bits"))
            merged = known.unionByName(fresh).groupBy("bucket", "word").agg(F.expr("bit_or(bits)").alias("bits"))
            merged.write.mode("overwrite").parquet(f"{self.filters}/batch={number}")
            maybe.unpersist()
            return len(opened)
        finally:
            rows.unpersist()
