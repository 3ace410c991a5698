"""Sinks for processed documents and validated invoices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billquarry.functions.text import safe_filename

#: Lines on a printed page.
LINES_PER_PAGE = 64


def document_record(df: DataFrame) -> DataFrame:
    """One record per processed document, fields as a map, ready to append."""
    return df.select(
        "doc_id",
        "document_type",
        (F.col("document_type") == "invoice").alias("is_invoice"),
        F.col("classification_confidence"),
        F.create_map(F.lit("invoice_number"), F.col("invoice_number"), F.lit("total_amount"), F.col("total_amount")).alias(
            "fields"
        ),
        F.coalesce(F.col("status"), F.lit("draft")).alias("status"),
    )


def append_records(records: DataFrame, path: str) -> None:
    records.write.mode("append").partitionBy("document_type").parquet(path)


def paged(lines: DataFrame) -> DataFrame:
    """Adds ``page``: lines 1 to ``LINES_PER_PAGE`` of an invoice stand on page 0, the next ones on page 1, and so on.

    The rule is the same for every invoice and looks at the printed line number alone.
    """
    return lines.withColumn("page", F.floor((F.col("line") - 1) / LINES_PER_PAGE).cast("long"))


def export_headers(invoices: DataFrame) -> DataFrame:
    """Validated invoices with the name of their file."""
    name = F.concat(safe_filename(F.concat(F.lit("facture "), F.col("invoice_number"))), F.lit(".json"))
    return invoices.filter(F.col("status") == "validated").select("id", "invoice_number", "status", "cents", name.alias("file_name"))


def export_lines(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines of validated invoices, one row each: an invoice of any length is never gathered."""
    validated = invoices.filter(F.col("status") == "validated").select(F.col("id").alias("_id"))
    return paged(lines.join(validated, F.col("invoice_id") == F.col("_id"), "left_semi"))


def write_export(invoices: DataFrame, lines: DataFrame, path: str) -> None:
    """Two folders below ``path``: ``headers``, a JSON object for each invoice, and ``lines``, one for each line."""
    export_headers(invoices).write.mode("overwrite").json(f"{path}/headers")
    export_lines(invoices, lines).write.mode("overwrite").json(f"{path}/lines")


def read_export(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Headers and lines as ``write_export`` wrote them."""
    headers = spark.read.schema("id long, invoice_number string, status string, cents long, file_name string").json(f"{path}/headers")
    lines = spark.read.schema("invoice_id long, line long, page long, quantity long, total_cents long, part_id long, source_id long, description string").json(f"{path}/lines")
    return headers, lines
