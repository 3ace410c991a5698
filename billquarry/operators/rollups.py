"""Aggregates of the dashboard, directories, data sets and readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cents_avg(cents: Column) -> Column:
    """Average of integer cents in currency units, four decimals, engine-independent."""
    n = F.count(cents)
    return F.coalesce(F.expr("0D") + F.floor((F.sum(cents) * 200 + n) / F.nullif(n * 2, F.lit(0))) / 10000, F.lit(0.0))


def pct_avg(pct: Column) -> Column:
    """Average of integer hundredths as a fraction."""
    return F.coalesce(F.sum(pct).cast("double") / F.nullif(F.count(pct) * 100, F.lit(0)), F.lit(0.0))


def dashboard_totals(invoices: DataFrame) -> DataFrame:
    return invoices.agg(
        F.count(F.lit(1)).alias("total_invoices"),
        F.count_if(F.col("status") == "validated").alias("validated_invoices"),
        F.count_if(F.col("status") != "validated").alias("draft_invoices"),
        (F.coalesce(F.sum("cents"), F.lit(0)).cast("double") / 100).alias("total_amount"),
        pct_avg(F.col("confidence_pct")).alias("avg_confidence"),
    )


def monthly_amounts(invoices: DataFrame, date: str = "created_date") -> DataFrame:
    return invoices.groupBy(F.date_format(date, "yyyy-MM").alias("month")).agg(
        (F.coalesce(F.sum("cents"), F.lit(0)).cast("double") / 100).alias("amount"), F.count(F.lit(1)).alias("count")
    )


def status_split(invoices: DataFrame) -> DataFrame:
    """Slices of the status chart; empty slices are dropped."""
    totals = dashboard_totals(invoices)
    other = F.greatest(F.lit(0).cast("long"), F.col("total_invoices") - F.col("validated_invoices") - F.col("draft_invoices"))
    slices = F.array(
        F.struct(F.lit("Validées").alias("name"), F.col("validated_invoices").alias("value")),
        F.struct(F.lit("À vérifier").alias("name"), F.col("draft_invoices").alias("value")),
        F.struct(F.lit("Autres statuts").alias("name"), other.alias("value")),
    )
    return totals.select(F.inline(slices)).filter("value > 0")


def supplier_totals(invoices: DataFrame) -> DataFrame:
    """Count, total and average per supplier; combined before the shuffle, so one huge supplier costs nothing extra."""
    return invoices.groupBy("supplier_id").agg(
        F.count(F.lit(1)).alias("invoices_count"),
        (F.sum("cents").cast("double") / 100).alias("total_amount"),
        cents_avg(F.col("cents")).alias("average_amount"),
    )


def supplier_directory(suppliers: DataFrame, invoices: DataFrame) -> DataFrame:
    """Suppliers with totals and their latest invoice, one aggregate for both."""
    newest = F.max_by(
        F.struct("invoice_number", "invoice_date", "status"), F.struct(F.coalesce("invoice_date", "created_date"), F.col("id"))
    )
    per_supplier = invoices.groupBy("supplier_id").agg(
        F.count(F.lit(1)).alias("invoices_count"),
        (F.sum("cents").cast("double") / 100).alias("total_amount"),
        cents_avg(F.col("cents")).alias("average_amount"),
        newest.alias("_last"),
    )
    return suppliers.join(per_supplier, suppliers["id"] == per_supplier["supplier_id"], "left").select(
        "id",
        "name",
        F.coalesce("invoices_count", F.lit(0)).alias("invoices_count"),
        F.coalesce("total_amount", F.lit(0.0)).alias("total_amount"),
        F.coalesce("_last.invoice_number", F.lit("")).alias("last_invoice_number"),
        F.coalesce(F.date_format("_last.invoice_date", "yyyy-MM-dd"), F.lit("")).alias("last_invoice_date"),
        F.coalesce("_last.status", F.lit("")).alias("last_invoice_status"),
        F.coalesce("average_amount", F.lit(0.0)).alias("average_amount"),
    )


def counts_by(df: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """Counts per value of several dimensions in one pass over the input."""
    pairs = F.array(*[F.struct(F.lit(name).alias("dimension"), c.cast("string").alias("bucket")) for name, c in dimensions.items()])
    return df.select(F.inline(pairs)).groupBy("dimension", "bucket").agg(F.count(F.lit(1)).alias("n"))


def entity_stats(detections: DataFrame) -> DataFrame:
    """Per class; confidences are hundredths so that averages are exact."""
    return detections.groupBy("class_name").agg(
        F.count(F.lit(1)).alias("n"),
        (F.floor((F.sum("confidence_pct") * 20 + F.count(F.lit(1))) / (F.count(F.lit(1)) * 2)).cast("double") / 1000).alias(
            "avg_confidence"
        ),
        (F.min("confidence_pct").cast("double") / 100).alias("min_confidence"),
        (F.max("confidence_pct").cast("double") / 100).alias("max_confidence"),
    )


def text_capture(detections: DataFrame) -> DataFrame:
    """How much text the detections carry; averages only over those that have text."""
    has = F.coalesce(F.length("text") > 0, F.lit(False))
    n = F.count_if(has)

    def scaled(total: Column, factor: int) -> Column:
        """total/n rounded half up to 1/factor, in integers."""
        return F.coalesce(F.floor((total * (2 * factor) + n) / F.nullif(n * 2, F.lit(0))), F.lit(0)).cast("double") / factor

    return detections.groupBy("class_name").agg(
        n.alias("with_text"),
        F.count_if(~has).alias("without_text"),
        scaled(F.sum(F.when(has, F.length("text"))), 10).alias("avg_text_length"),
        (scaled(F.sum(F.when(has, F.col("ocr_pct"))), 10) / 100).alias("avg_ocr_confidence"),
        (F.sum(F.when(has, F.col("confidence_pct") + F.col("ocr_pct")).otherwise(F.col("confidence_pct") * 2)).cast("double") / 200).alias(
            "combined_confidence"
        ),
    )


def page_confidence(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Document confidence: mean over pages read with some confidence, else 0."""
    return pages.groupBy(doc).agg(pct_avg(F.when(F.col("confidence_pct") > 0, F.col("confidence_pct"))).alias("confidence"))


def passage_confidence(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Mean line confidence; unknown when any line's is unknown."""
    complete = F.count("confidence_pct") == F.count(F.lit(1))
    return lines.groupBy(*keys).agg(F.when(complete, pct_avg(F.col("confidence_pct"))).alias("confidence"))


def passage_box(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Union of line boxes; unknown when any line has no box. Edges in thousandths of the page."""
    complete = F.count("x") == F.count(F.lit(1))
    return lines.groupBy(*keys).agg(
        F.when(complete, F.min("x")).alias("x"),
        F.when(complete, F.min("y")).alias("y"),
        F.when(complete, F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"),
        F.when(complete, F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"),
    )


def extra_tax_once(rows: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Sum of distinct printed FODEC rows; VAT is accounted elsewhere."""
    fodec = rows.filter(F.col("label") == "FODEC").groupBy(doc, "label", "rate", "amount_milli", "source").agg(F.lit(1).alias("_"))
    return fodec.groupBy(doc).agg(F.sum("amount_milli").alias("extra_tax_milli"))
