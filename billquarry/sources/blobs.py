"""Content-addressed storage: one row per distinct content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX = "sha256:"


def with_digest(df: DataFrame, content: str = "content") -> DataFrame:
    return df.withColumn("digest", F.sha2(F.col(content).cast("binary"), 256))


def new_contents(incoming: DataFrame, stored_digests: DataFrame, content: str = "content", order: str = "id") -> DataFrame:
    """Contents not stored yet, each once: only digest, size and first id are shuffled, never content."""
    keyed = with_digest(incoming, content).select("digest", F.octet_length(content).cast("long").alias("size"), order)
    return (
        keyed.groupBy("digest")
        .agg(F.min("size").alias("size"), F.min(order).alias("first_id"), F.count(F.lit(1)).alias("copies"))
        .join(stored_digests.select("digest").distinct(), "digest", "left_anti")
        .withColumn("reference", F.concat(F.lit(PREFIX), F.col("digest")))
    )


def resolve(references: DataFrame, store: DataFrame, reference: str = "reference") -> DataFrame:
    """Content of well-formed references; malformed ones are reported, unknown ones found nowhere."""
    well_formed = F.col(reference).rlike(f"^{PREFIX}[0-9a-f]{{64}}$")
    keyed = references.withColumn(
        "digest", F.when(well_formed, F.substring(F.col(reference), len(PREFIX) + 1, 64))
    )
    return keyed.join(store, "digest", "left").withColumn(
        "state",
        F.when(F.col("digest").isNull(), "invalid").when(F.col("size").isNull(), "missing").otherwise("found"),
    )


def stored_bytes(store: DataFrame) -> DataFrame:
    """Total bytes over distinct contents."""
    return store.groupBy("digest").agg(F.max("size").alias("size")).agg(
        F.coalesce(F.sum("size"), F.lit(0)).alias("stored_bytes"), F.count(F.lit(1)).alias("contents")
    )
