"""Display values: status, class, percentages, evidence comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from billquarry.functions.text import U


def status_label(status: Column) -> Column:
    value = F.lower(F.coalesce(status, F.lit("")))
    return (
        F.when(value.contains("dataset"), "Dataset")
        .when(value.contains("valid"), "Validée")
        .when(value.contains("reject") | value.contains("rejet"), "Rejetée")
        .when(value.contains("classified") | value.contains("review") | value.contains("draft"), "En attente de validation")
        .otherwise("En cours d'analyse")
    )


def classification_label(
    flag: Column, document_type: Column, has_signals: Column, total: Column, confidence: Column
) -> Column:
    """Explicit flag, else type, else signals with a positive total; low confidence is uncertain."""
    kind = F.lower(F.coalesce(document_type, F.lit("")))
    derived = kind.contains("invoice") | kind.contains("facture") | (has_signals & (F.coalesce(total, F.lit(0.0)) > 0))
    return (
        F.when(F.coalesce(flag, derived), "Facture")
        .when((F.coalesce(confidence, F.lit(0.0)) < 0.7) & has_signals, "Incertain")
        .otherwise("Non-facture")
    )


def percent(score: Column) -> Column:
    return F.round(F.when(score <= 1, score * 100).otherwise(score)).cast("long")


def same_evidence(a: Column, b: Column) -> Column:
    """Equal up to blanks, comma or dot, case and trailing decimal zeros."""

    def clean(c: Column) -> Column:
        return F.lower(F.translate(F.regexp_replace(F.coalesce(c, F.lit("")), U + r"\s", ""), ",", "."))

    x, y = clean(a), clean(b)
    numeric = x.rlike(r"^-?\d+\.\d+$") & y.rlike(r"^-?\d+(\.\d+)?$")
    return (x == y) | F.coalesce(numeric & (x.try_cast("decimal(38,10)") == y.try_cast("decimal(38,10)")), F.lit(False))


def detection_class(name: Column) -> Column:
    value = F.lower(F.coalesce(name, F.lit("")))
    return (
        F.when(value.contains("logo"), "logo")
        .when(value.contains("cachet") | value.contains("stamp"), "stamp")
        .when(value.contains("signature"), "signature")
    )


def detection_score(score: Column) -> Column:
    value = F.when(score > 1, score / 100).otherwise(score)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value, F.lit(0.0))))


def prefer_second_script(latin_score: Column, other_text: Column, other_score: Column) -> Column:
    """Take the Arabic reading when it is mostly Arabic letters and clearly the better one."""
    letters = F.regexp_count(other_text, F.lit(r"\p{L}"))
    arabic = F.regexp_count(other_text, F.lit("[؀-ۿ&&\\p{L}]"))
    share = arabic / F.greatest(letters, F.lit(1))
    return (share >= 0.5) & (other_score >= 0.6) & ((latin_score < 0.8) | (other_score > latin_score + 0.05))
