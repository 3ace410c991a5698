"""Annotation data sets: split lists, JSON annotations, keyed refresh."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPLIT_SCHEMA = T.StructType([T.StructField("img_path", T.StringType()), T.StructField("annot_path", T.StringType())])
PAYLOAD_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("words", T.ArrayType(T.StringType())),
        T.StructField("bboxes", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("ner_tags", T.ArrayType(T.StringType())),
    ]
)


def split_rows(rows: DataFrame, root: str = "dataset") -> DataFrame:
    """Trimmed split rows with both names present, and the two paths they imply."""
    image, annotation = F.trim(F.col("img_path")), F.trim(F.col("annot_path"))
    return rows.filter((image != "") & (annotation != "")).select(
        "split",
        image.alias("image_name"),
        annotation.alias("annotation_name"),
        F.concat(F.lit(f"{root}/images/"), image).alias("image_path"),
        F.concat(F.lit(f"{root}/Annotations/Original_Format/"), annotation).alias("annotation_path"),
    )


def read_split_csv(spark: SparkSession, folder: str, splits: tuple[str, ...] = ("train", "dev", "test")) -> DataFrame:
    """One CSV file per split; a byte-order mark on the header is tolerated."""

    def one(split: str) -> DataFrame:
        raw = spark.read.option("header", "true").csv(f"{folder}/strat1_{split}.csv")
        clean = raw.toDF(*[name.lstrip("﻿").strip() for name in raw.columns])
        return clean.select(F.lit(split).alias("split"), "img_path", "annot_path")

    return split_rows(reduce(DataFrame.unionByName, [one(s) for s in splits]))


def read_split_folder(spark: SparkSession, folder: str) -> DataFrame:
    """CSV files in a folder for each split (``split=name``); a byte-order mark before a header is tolerated."""
    raw = spark.read.option("header", "true").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(folder)
    return split_rows(raw.toDF(*[name.lstrip("\ufeff").strip() for name in raw.columns]))


def split_lines_csv(lines: DataFrame, column: str = "line") -> DataFrame:
    """The same rows from CSV lines already held in a column."""
    parsed = F.from_csv(F.regexp_replace(F.col(column), "^﻿", ""), F.lit("img_path STRING, annot_path STRING"))
    return split_rows(lines.withColumn("_csv", parsed).select("split", "_csv.img_path", "_csv.annot_path"))


def annotation_counts(payload: Column) -> list[Column]:
    """Words, boxes and tags of a JSON payload; anything but an object counts zero."""
    is_object = F.trim(payload).startswith("{")
    parsed = F.from_json(payload, PAYLOAD_SCHEMA)

    def count(field: str) -> Column:
        size = F.size(F.when(is_object, parsed[field]))
        return F.when(size > 0, size).otherwise(0).cast("long")

    return [
        F.coalesce(F.when(is_object, parsed["path"]), F.lit("")).alias("image_name"),
        count("words").alias("words_count"),
        count("bboxes").alias("boxes_count"),
        F.coalesce(F.array_join(F.when(is_object, parsed["ner_tags"]), ","), F.lit("")).alias("tags"),
    ]


def latest_per_key(df: DataFrame, keys: list[str], arrival: list[str]) -> DataFrame:
    """Last row per key by arrival order, as a combinable aggregate instead of a sort per key."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*arrival))
    return df.groupBy(*keys).agg(newest.alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def write_keyed(df: DataFrame, path: str, keys: list[str], arrival: list[str]) -> None:
    """Full refresh of a keyed table: the last row per key replaces the others."""
    latest_per_key(df, keys, arrival).write.mode("overwrite").parquet(path)
