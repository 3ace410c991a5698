"""File listings: what each path is, what is admitted, what changed since last time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billquarry import vocabulary as V


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Listing of a folder tree; file contents are never read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    )


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension_of(path: Column) -> Column:
    """Lower-case suffix with its dot, empty when the name has none."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))


def describe_files(listing: DataFrame) -> DataFrame:
    """Kind, extension, image name and annotation format of every path."""
    extension = extension_of(F.col("path"))
    kind = (
        F.when(extension.isin(".jpg", ".jpeg", ".png"), "image")
        .when(extension == ".json", "annotation")
        .when(extension == ".csv", "split_csv")
        .when(extension == ".txt", "metadata")
        .otherwise("other")
    )
    return listing.select(
        "path",
        kind.alias("kind"),
        extension.alias("extension"),
        F.col("size").alias("size_bytes"),
        F.concat(F.regexp_replace(base_name(F.col("path")), r"(?<=.)\.[^.]+$", ""), F.lit(".jpg")).alias("image_name"),
        F.nullif(F.regexp_extract("path", r"(?:^|/)Annotations/([^/]*)", 1), F.lit("")).alias("annotation_format"),
    )


def admitted(listing: DataFrame, max_bytes: int = V.MAX_FILE_BYTES) -> DataFrame:
    """Files whose last dotted part is an allowed extension and that are not too large."""
    suffix = F.lower(F.regexp_extract("path", r"([^.]*)$", 1))
    return listing.filter(suffix.isin(*V.ALLOWED_EXTENSIONS) & (F.col("size") <= max_bytes))


def changed_files(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose path, size or time stamp is not in the manifest of the last import."""
    return listing.join(manifest.select("path", "size", "mtime"), ["path", "size", "mtime"], "left_anti")
