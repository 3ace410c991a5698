"""Printed totals against printed components in exact decimals; issues, routing, recommendation.

Components and reasons of an invoice are arrays of its row: reconciling is a
projection, and only reporting them as rows makes more rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billquarry import vocabulary as V
from billquarry.functions import text as X
from billquarry.functions.money import AMOUNT, strict_amount

MONEY = "decimal(24,6)"
_COMPONENT = f"struct<kind:string,amount:{MONEY}>"
BLOCKING, WARNING, INFO = "blocking", "warning", "info"


def rounding_bound(currency: Column, terms: Column) -> Column:
    """Half a currency unit per printed term and for the result; no margin for other currencies."""
    unit = F.lit(None).cast(MONEY)
    for code, places in V.CURRENCY_DECIMALS.items():
        unit = F.when(F.upper(currency) == code, F.lit(f"{10 ** -places:.{places}f}").cast(MONEY)).otherwise(unit)
    return F.coalesce((unit * (terms + 1) / 2).cast(MONEY), F.lit(0).cast(MONEY))


def tax_kind(label: Column) -> Column:
    folded = X.fold(label)
    return (
        F.when(folded.rlike(X.U + r"\b(t[. ]*v[. ]*a|vat)\b"), "vat").when(folded.rlike(X.U + r"\bfodec\b"), "fodec")
        .when(folded.rlike(X.U + r"\b(timbre|stamp)\b"), "stamp").when(folded.rlike(X.U + r"\b(redevance|levy)\b"), "levy").otherwise("other_tax")
    )


def discount_basis(text: Column, subtotal: Column, declared: Column | None = None) -> Column:
    """net or gross, from the label on the line that prints the subtotal; NULL when neither is said."""

    def of_line(s: Column) -> Column:
        amounts = F.transform(F.regexp_extract_all(s, F.lit(r"(?<!\w)\d+(?:[ ,.]\d+)*(?!\w)"), F.lit(0)), lambda t: strict_amount(t))
        return F.when(
            F.exists(amounts, lambda a: a == subtotal),
            F.when(s.rlike(X.U + r"\b(net\s*h\.?t|h\.?t\s*net)\b"), "net").when(s.rlike(X.U + r"\b(brut|gross|sub[_ ]?total)\b"), "gross"),
        )

    found = F.array_compact(F.transform(X.split_lines(X.fold(text)), of_line))
    last = F.try_element_at(found, F.lit(-1))
    return F.coalesce(last, declared) if declared is not None else last


def tax_conflicts(vat: Column, vat_rows: Column, extra: Column, extra_rows: Column, stamp: Column, stamp_rows: Column, vat_complete: Column) -> Column:
    """Where an aggregate and its printed rows disagree. Rows are arrays of amounts."""

    def total(rows: Column) -> Column:
        return F.aggregate(rows, F.lit(0).cast(MONEY), lambda a, x: (a + x).cast(MONEY))

    some = [F.size(r) > 0 for r in (vat_rows, extra_rows, stamp_rows)]
    return F.array_compact(
        F.array(
            F.when(some[0] & vat.isNotNull() & ((vat_complete & (total(vat_rows) != vat)) | ((vat >= 0) & (total(vat_rows) > vat))), "conflicting_vat_aggregate_and_rows"),
            F.when(some[1] & extra.isNotNull() & (total(extra_rows) != extra), "conflicting_additional_tax_aggregate_and_rows"),
            F.when(some[2] & stamp.isNotNull() & (total(stamp_rows) != stamp), "conflicting_stamp_aggregate_and_rows"),
        )
    )


def reconcile(df: DataFrame) -> DataFrame:
    """Printed total against proven components.

    Input columns: total, subtotal, vat, stamp, discount, extra, adjustment (NULL when absent or unproven);
    ``unproven`` (array of field names given without proof); ``taxes`` (array of label, rate, amount, line_id, already
    proven); ``context`` (evidence text); ``basis`` (net/gross/NULL), ``discount_scope``, ``vat_complete``,
    ``tax_exempt``; ``ttc_lines`` (amounts of lines priced including tax, NULL otherwise) and ``table_complete``; currency.
    """
    distinct = F.array_distinct(F.transform("taxes", lambda t: F.struct(tax_kind(t["label"]).alias("kind"), t["rate"].alias("rate"), t["amount"].cast(MONEY).alias("amount"), t["line_id"].alias("line_id"))))
    base = df.withColumn("_taxes", distinct)

    def amounts(kinds: list[str]) -> Column:
        return F.transform(F.filter("_taxes", lambda t: t["kind"].isin(*kinds)), lambda t: t["amount"])

    base = (
        base.withColumn("_vat_rows", amounts(["vat"]))
        .withColumn("_stamp_rows", amounts(["stamp"]))
        .withColumn("_extra_rows", amounts(["fodec", "levy", "other_tax"]))
    )
    c = F.col

    def part(kind: str, value: Column, present: Column) -> Column:
        return F.when(present, F.array(F.struct(F.lit(kind).alias("kind"), value.cast(MONEY).alias("amount")))).otherwise(F.array().cast(f"array<{_COMPONENT}>"))

    def rows(kinds: list[str], present: Column) -> Column:
        found = F.transform(F.filter("_taxes", lambda t: t["kind"].isin(*kinds)), lambda t: F.struct(t["kind"].alias("kind"), t["amount"].alias("amount")))
        return F.when(present, found).otherwise(F.array().cast(f"array<{_COMPONENT}>"))

    has_ht, has_ttc_lines = c("subtotal").isNotNull(), c("subtotal").isNull() & (F.size("ttc_lines") > 0)
    discount = F.coalesce(c("discount"), F.lit(0).cast(AMOUNT))
    taken_off = has_ht & (discount != 0) & (c("basis") == "gross") & ~F.coalesce(c("discount_scope") == "item", F.lit(False))
    components = F.concat(
        part("vat", c("vat"), c("vat").isNotNull()), rows(["vat"], c("vat").isNull()),
        part("additional_tax", c("extra"), c("extra").isNotNull() & (F.size("_extra_rows") == 0)), rows(["fodec", "levy", "other_tax"], F.lit(True)),
        part("stamp", c("stamp"), c("stamp").isNotNull()), rows(["stamp"], c("stamp").isNull()),
        part("adjustment", c("adjustment"), c("adjustment").isNotNull()),
        part("ht_base", c("subtotal"), has_ht), part("discount", -F.abs(discount), F.coalesce(taken_off, F.lit(False))),
        F.when(has_ttc_lines, F.transform("ttc_lines", lambda a: F.struct(F.lit("ttc_line").alias("kind"), a.cast(MONEY).alias("amount")))).otherwise(
            F.array().cast(f"array<{_COMPONENT}>")
        ),
    )
    base = base.withColumn("components", components)
    kinds = F.transform("components", lambda k: k["kind"])
    folded = X.fold(F.coalesce(c("context"), F.lit("")))

    def mentioned(pattern: str, kind: str) -> Column:
        return F.when(folded.rlike(X.U + pattern) & ~F.array_contains(kinds, kind), "mentioned_component_without_proven_amount:" + kind)

    ambiguous = has_ht & (discount != 0) & ~F.coalesce((c("basis") == "net") | taken_off, F.lit(False))
    reasons = F.concat(
        F.transform("unproven", lambda f: F.concat(F.lit("unproven_component:"), f)),
        tax_conflicts(c("vat"), c("_vat_rows"), c("extra"), c("_extra_rows"), c("stamp"), c("_stamp_rows"), F.coalesce("vat_complete", F.lit(False))),
        F.array_compact(
            F.array(
                F.when(c("total").isNull(), "missing_printed_total"),
                F.when(c("vat").isNull() & (F.size("_vat_rows") > 0) & ~F.coalesce("vat_complete", F.lit(False)), "vat_breakdown_completeness_unknown"),
                mentioned(r"\bfodec\b", "fodec"), mentioned(r"\b(redevance|levy)\b", "levy"), mentioned(r"\b(timbre|stamp)\b", "stamp"),
                F.when(folded.rlike(X.U + r"\b(remise|discount)\b") & c("discount").isNull(), "mentioned_discount_without_proven_amount"),
                F.when(has_ht & c("vat").isNull() & (F.size("_vat_rows") == 0) & ~F.coalesce("tax_exempt", F.lit(False)), "missing_proven_vat_or_exemption"),
                F.when(ambiguous, "discount_ht_basis_or_scope_ambiguous"),
                F.when(has_ttc_lines & ~F.coalesce("table_complete", F.lit(False)), "ttc_table_completeness_unproven"),
                F.when(has_ttc_lines & (c("vat").isNotNull() | (F.size("_vat_rows") > 0) | (F.size("_extra_rows") > 0) | c("extra").isNotNull()), "tax_inclusion_in_ttc_lines_ambiguous"),
                F.when(has_ttc_lines & (discount != 0), "discount_inclusion_in_ttc_lines_ambiguous"),
                F.when(~has_ht & ~has_ttc_lines, "missing_proven_ht_or_complete_ttc_lines"),
            )
        ),
    )
    out = base.withColumn("reasons", F.array_distinct(reasons))
    return with_status(out, c("total")).drop("_taxes", "_vat_rows", "_stamp_rows", "_extra_rows")


def with_status(df: DataFrame, printed: Column, prefix: str = "") -> DataFrame:
    """Status of a check from its ``components`` and ``reasons``."""
    calculated = F.aggregate("components", F.lit(0).cast(MONEY), lambda a, x: (a + x["amount"]).cast(MONEY))
    terms = F.size(F.filter("components", lambda x: x["amount"] != 0))
    out = df.withColumn("difference", F.when(F.size("reasons") == 0, printed.cast(MONEY) - calculated)).withColumn("bound", rounding_bound(F.col("currency"), terms))
    status = (
        F.when(F.col("difference").isNull(), "INSUFFICIENT_EVIDENCE").when(F.col("difference") == 0, "VALID")
        .when(F.abs("difference") <= F.col("bound"), "ROUNDING_DIFFERENCE").otherwise("INVALID")
    )
    return out.withColumn("status", status)


def reconcile_net(df: DataFrame) -> DataFrame:
    """Net payable against the printed total and a settlement adjustment; needs a complete settlement.

    Input: net, total, settlement (nullable decimals), settlement_complete, currency.
    """
    c = F.col
    reasons = F.array_compact(
        F.array(
            F.when(c("total").isNull(), "missing_proven_ttc_for_net_payable"),
            F.when(~F.coalesce("settlement_complete", F.lit(False)), "settlement_components_unknown"),
            F.when(c("net").isNull(), "missing_proven_net_payable"),
        )
    )
    parts = F.array_compact(
        F.array(
            F.when(c("total").isNotNull(), F.struct(F.lit("printed_ttc").alias("kind"), c("total").cast(MONEY).alias("amount"))),
            F.when(c("settlement").isNotNull(), F.struct(F.lit("settlement").alias("kind"), c("settlement").cast(MONEY).alias("amount"))),
        )
    )
    return with_status(df.withColumn("reasons", reasons).withColumn("components", parts), c("net"))


FINANCE_CODES = {
    "VALID": ("invoice_total_valid", INFO), "INVALID": ("invoice_total_math_mismatch", BLOCKING),
    "INSUFFICIENT_EVIDENCE": ("invoice_financial_insufficient_evidence", WARNING), "ROUNDING_DIFFERENCE": ("invoice_total_rounding_difference", INFO),
}


def issues(df: DataFrame) -> DataFrame:
    """One row per issue: (doc_id, code, severity).

    Input: the five required fields, subtotal, ``supported`` (map field -> proven), ``review`` (array of fields whose
    proof needs review), ``currency_default``, ``table_detected``, ``items`` (count), ``ttc_items`` (all lines priced
    including tax), ``analysis`` status and the ``status`` of the reconciliation.
    """
    c = F.col

    def row(code: Column | str, severity: Column | str, when: Column) -> Column:
        as_column = [v if isinstance(v, Column) else F.lit(v) for v in (code, severity)]
        return F.when(F.coalesce(when, F.lit(False)), F.struct(as_column[0].alias("code"), as_column[1].alias("severity")))

    filled = {f: (c(f) > 0 if f == "total_amount" else X.non_empty(c(f).cast("string")).isNotNull()) for f in V.REQUIRED_FIELDS}
    rows = [row("llm_extraction_incomplete", BLOCKING, c("analysis") != "completed")]
    rows += [row("missing_" + f, BLOCKING, ~F.coalesce(filled[f], F.lit(False))) for f in V.REQUIRED_FIELDS]
    for f in V.REQUIRED_FIELDS:
        default = c("currency_default") if f == "currency" else F.lit(False)
        rows.append(row("unproven_" + f, BLOCKING, filled[f] & ~F.coalesce(F.try_element_at("supported", F.lit(f)), F.lit(False)) & ~default))
    rows += [
        row("currency_workflow_default", WARNING, c("currency_default")),
        row("currency_not_tnd", WARNING, F.upper("currency") != "TND"),
        row("invoice_date_format_uncertain", WARNING, X.non_empty(c("date")).isNotNull() & ~c("date").rlike(r"\d{1,2}[-/]\d{1,2}[-/]\d{2,4}")),
        row("missing_subtotal_for_total", F.when(c("ttc_items"), WARNING).otherwise(BLOCKING), c("total_amount").isNotNull() & c("subtotal").isNull()),
        row("no_verified_line_items", BLOCKING, c("total_amount").isNotNull() & c("table_detected") & (c("items") == 0)),
    ]
    rows += [row(code, severity, c("status") == status) for status, (code, severity) in FINANCE_CODES.items()]
    reviews = F.transform("review", lambda f: F.struct(F.concat(F.lit("evidence_review_"), f).alias("code"), F.lit(BLOCKING).alias("severity")))
    return df.select("doc_id", F.inline(F.concat(F.array_compact(F.array(*rows)), reviews)))


def destination(is_invoice: Column, class_pct: Column, extraction_pct: Column, blocking: Column) -> Column:
    """Where a document goes next."""
    return (
        F.when(~is_invoice, F.when(class_pct < 85, "non_invoice_review").otherwise("non_invoice_archive"))
        .when(extraction_pct < 45, "ocr_quality_review").when(blocking, "human_validation_required").otherwise("ready_for_human_validation")
    )


def route(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Destination per document; issues are first reduced to one row per document."""
    per_doc = found.groupBy("doc_id").agg(F.max(F.col("severity") == BLOCKING).alias("_blocking"))
    return docs.join(per_doc, "doc_id", "left").withColumn(
        "destination", destination(F.col("is_invoice"), F.col("class_pct"), F.col("extraction_pct"), F.coalesce("_blocking", F.lit(False)))
    ).drop("_blocking")


def recommendation(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Review reasons and the recommended action. Codes per document are bounded by the rules above."""
    blocking = found.filter(F.col("severity") == BLOCKING).groupBy("doc_id").agg(F.sort_array(F.collect_set("code")).alias("_codes"))
    none = F.array().cast("array<string>")
    joined = docs.join(blocking, "doc_id", "left").withColumn("_codes", F.coalesce("_codes", none))
    reasons = F.array_distinct(
        F.concat(
            F.array_compact(F.array(F.when(F.col("class_pct") < 70, "classification_confidence_low"), F.when(F.col("extraction_pct") < 45, "ocr_confidence_low"))),
            F.col("_codes"),
            F.array_compact(F.array(F.when(~F.col("indexed"), "rag_document_not_indexed"))),
        )
    )
    out = joined.withColumn("_reasons", reasons)
    return out.select(
        "doc_id",
        F.when(~F.col("is_invoice"), "confirm_non_invoice").when(F.size("_reasons") > 0, "send_to_human_review").otherwise("ready_for_validation").alias("action"),
        F.when(~F.col("is_invoice"), F.col("class_pct") < 85).otherwise(F.size("_reasons") > 0).alias("human_review"),
        F.when(~F.col("is_invoice"), F.array(F.lit("document_classified_as_non_invoice")))
        .when(F.size("_reasons") > 0, F.col("_reasons")).otherwise(F.array(F.lit("classification_ocr_fields_and_rag_ok"))).alias("reasons"),
    )
