"""Record views: precedence of candidates, catalogue records, review lines, readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billquarry import vocabulary as V
from billquarry.functions import text as X
from billquarry.functions.money import AMOUNT, ocr_amount

# Sources of a candidate, best first (fixed values)
SOURCE_RANK = {"hosted": 0, "local": 1, "rule": 2, "model": 3}


def candidate_precedence(candidates: DataFrame) -> DataFrame:
    """One value per (document, field): hosted, else local (its NULL counts), else rule, else model.

    ``hosted_mode`` marks documents read by the hosted model: only its values count there.
    """
    money = F.col("field").isin(*V.MONEY_FIELDS)
    filled = X.non_empty(F.col("value"))
    usable = (
        F.when(F.col("hosted_mode"), F.col("source") == "hosted")
        .when(F.col("source") == "hosted", filled.isNotNull())
        .when(F.col("source") == "local", True)
        .when(money, ocr_amount(F.col("value")) > 0)
        .otherwise(filled.isNotNull())
    )
    rank = F.lit(9)
    for name, position in SOURCE_RANK.items():
        rank = F.when(F.col("source") == name, position).otherwise(rank)
    best = F.min_by(F.when(usable, F.struct(filled.alias("value"), F.col("source"))), F.when(usable, rank))
    return candidates.groupBy("doc_id", "field").agg(best.alias("_b")).select(
        "doc_id", "field", F.col("_b.value").alias("value"), F.col("_b.source").alias("source")
    )


def clean_words(words: Column) -> Column:
    return F.filter(F.transform(words, lambda w: F.trim(w)), lambda w: w != "")


def _position(words: Column, labels: list[str], strip: str, before_end: bool = False) -> Column:
    """Zero-based position of the first label word, NULL when absent."""
    plain = F.transform(words, lambda w: F.btrim(F.lower(w), F.lit(strip)) if strip else F.lower(w))
    found = F.get(
        F.filter(F.transform(plain, lambda w, i: F.when(w.isin(*labels), i)), lambda i: i.isNotNull()), F.lit(0)
    )
    return F.when(found < F.size(words) - 1, found) if before_end else found


def words_after(words: Column, labels: list[str]) -> Column:
    """Three words after the first label; empty when no label has a follower."""
    at = _position(words, labels, ":#", before_end=True)
    return F.coalesce(F.btrim(F.array_join(F.slice(words, at + 2, 3), " "), F.lit(" :#")), F.lit(""))


def amount_after_total(words: Column) -> Column:
    """First number among the four words after "total"; 0 when there is none."""
    at = _position(words, ["total", "balance_due", "ttc"], "")
    window = F.when(at.isNotNull(), F.slice(words, F.coalesce(at, F.lit(0)) + 2, 4))
    numbers = F.transform(window, lambda w: F.regexp_replace(F.translate(w, ",", "."), r"[^\d.\-]", "").try_cast(AMOUNT))
    return F.coalesce(F.get(F.filter(numbers, lambda n: n.isNotNull()), F.lit(0)), F.lit(0).cast(AMOUNT))


def first_currency(words: Column) -> Column:
    known = F.filter(
        F.transform(words, lambda w: F.btrim(F.upper(w), F.lit(".,:;"))), lambda w: w.isin("TND", "EUR", "USD", "GBP")
    )
    return F.coalesce(F.get(known, F.lit(0)), F.lit("TND"))


def guessed_supplier(words: Column) -> Column:
    at = _position(words, ["seller", "supplier", "fournisseur", "vendor"], "")
    return F.btrim(F.array_join(F.slice(words, F.coalesce(at + 2, F.lit(1)), 3), " "), F.lit(" :"))


def word_lookups(df: DataFrame, words: str = "words") -> DataFrame:
    """Label look-ups over a word list, all inside the row."""
    cleaned = df.withColumn("_w", clean_words(F.col(words)))
    w = F.col("_w")
    return cleaned.select(
        *df.columns,
        words_after(w, ["invoice", "facture", "#", "n°", "numéro", "number"]).alias("found_number"),
        words_after(w, ["date"]).alias("found_date"),
        words_after(w, ["buyer", "client", "customer"]).alias("found_customer"),
        guessed_supplier(w).alias("found_supplier"),
        amount_after_total(w).alias("found_total"),
        first_currency(w).alias("found_currency"),
    )


def catalog_record(df: DataFrame) -> DataFrame:
    """Invoice-shaped record of an annotated image."""
    found = word_lookups(df)
    return found.select(
        F.concat(F.lit("dataset:"), F.col("image_name")).alias("id"),
        F.col("image_name").alias("filename"),
        F.lit("dataset").alias("status"),
        F.coalesce(F.nullif("found_number", F.lit("")), F.col("annotation_name")).alias("invoice_number"),
        F.coalesce(F.nullif("found_supplier", F.lit("")), F.lit("Facture dataset")).alias("supplier_name"),
        F.col("found_customer").alias("customer_name"),
        F.col("found_date").alias("invoice_date"),
        F.col("found_total").cast("double").alias("total_amount"),
        F.col("found_currency").alias("currency"),
        F.substring(F.array_join("words", " "), 1, 500).alias("text_preview"),
    )


def chosen_text(native: Column, scanned: Column, scanned_confidence: Column) -> tuple[Column, Column]:
    """Native text when it has enough letters and digits, else scanned text, else native."""
    enough = F.length(F.regexp_replace(F.coalesce(native, F.lit("")), r"[^\p{L}\p{N}]", "")) >= V.MIN_TEXT_CHARS
    scanned_ok = X.non_empty(scanned).isNotNull()
    text = F.when(enough, native).when(scanned_ok, scanned).otherwise(native)
    confidence = (
        F.when(enough, 0.95)
        .when(scanned_ok, scanned_confidence)
        .when(X.non_empty(native).isNotNull(), 0.3)
        .otherwise(0.0)
    )
    return text, confidence


def row_text(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda c: F.coalesce(F.trim(c), F.lit(""))), " | ")


def quality_flag(text: Column, confidence: Column) -> Column:
    return F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) < V.MIN_TEXT_CHARS, "text_too_short").when(
        confidence < V.LOW_OCR, "low_ocr_confidence"
    )


def missing_required(number: Column, date: Column, vendor: Column, total: Column, currency: Column) -> Column:
    """Names of required fields without a value; an amount needs to be positive."""
    absent = [
        F.when(X.non_empty(number).isNull(), "invoice_number"),
        F.when(X.non_empty(date).isNull(), "date"),
        F.when(X.non_empty(vendor).isNull(), "vendor_name"),
        F.when(~F.coalesce(total > 0, F.lit(False)), "total_amount"),
        F.when(X.non_empty(currency).isNull(), "currency"),
    ]
    return F.array_compact(F.array(*absent))


def with_best_evidence(fields: DataFrame, evidence: DataFrame, default: int) -> DataFrame:
    """Fields (doc_id, field, value, document) with the proof and confidence of their best evidence row.

    Evidence: doc_id, field, rank, preview, text, confidence, score; the row with the smallest rank counts, an aggregate that
    combines before the shuffle. Proof: its preview, else its text, else the beginning of the document, 500 characters.
    Confidence in percent: its own (a share or a percentage), else its score as a bounded percentage, else the default; none
    for a field without a value.
    """
    row = F.struct("preview", "text", "confidence", "score")
    best = evidence.groupBy("doc_id", "field").agg(F.min_by(row, "rank").alias("_e"))
    own, score = F.col("_e.confidence"), F.col("_e.score")
    shown = F.coalesce(F.nullif("_e.preview", F.lit("")), F.nullif("_e.text", F.lit("")), F.col("document"), F.lit(""))
    percent = F.coalesce(
        F.floor(F.when(own <= 1, own * 100).otherwise(own) + 0.5),
        F.when(score.isNotNull(), F.least(F.lit(99), F.greatest(F.lit(55), F.floor(score * 10 + 0.5)))), F.lit(default),
    )
    joined = fields.join(best, ["doc_id", "field"], "left")
    return joined.withColumn("preview", F.trim(F.substring(shown, 1, 500))).withColumn("confidence", F.when(F.col("value") == "", 0).otherwise(percent).cast("long")).drop("_e")
