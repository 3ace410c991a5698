"""Money expressions. Values are exact decimals; NULL means not readable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from billquarry import vocabulary as V
from billquarry.functions.text import U, let

AMOUNT = "decimal(20,6)"


def ocr_amount_or_null(c: Column) -> Column:
    """Amount as printed by scanners, separators resolved; NULL when unreadable.

    With both separators the last one is decimal; several dots followed by groups
    of three keep the last as decimal (millimes); a lone comma is decimal.
    """

    def read(kept: Column) -> Column:
        dots = F.length(kept) - F.length(F.replace(kept, F.lit("."), F.lit("")))
        return (
            F.when(
                kept.contains(",") & kept.contains("."),
                F.when(kept.rlike(r",[^.,]*$"), F.translate(kept, ",.", ".")).otherwise(F.translate(kept, ",", "")),
            )
            .when(
                dots > 1,
                F.when(kept.rlike(r"^[^.]*(?:\.[^.]{3})+$"), F.regexp_replace(kept, r"\.(?=.*\.)", "")).otherwise(
                    F.translate(kept, ".", "")
                ),
            )
            .otherwise(F.translate(kept, ",", "."))
            .try_cast(AMOUNT)
        )

    return let(F.regexp_replace(c, U + r"[^\d,.\-]", ""), read)


def ocr_amount(c: Column) -> Column:
    """As above with unreadable text counted as zero."""
    return F.coalesce(ocr_amount_or_null(c), F.lit(0).cast(AMOUNT))


def strict_amount(c: Column) -> Column:
    """NULL unless the whole text is one number (spaces may group thousands)."""
    trimmed = F.trim(c)
    return F.when(
        trimmed.rlike(f"^(?:{V.STRICT_NUMBER})$"),
        F.translate(F.regexp_replace(trimmed, "[ \u00a0\u202f]", ""), ",", ".").try_cast(AMOUNT),
    )


def optional_number(c: Column) -> Column:
    """Number of a stored field; missing stays NULL, never zero."""
    return F.translate(F.regexp_replace(F.trim(c), "[ \u00a0\u202f]", ""), ",", ".").try_cast(AMOUNT)


def amounts_in(c: Column) -> Column:
    """Every positive amount of a text, in order."""
    found = F.regexp_extract_all(
        F.coalesce(c, F.lit("")), F.lit(U + r"\b\d+(?:[ .]\d{3})*(?:[,.]\d{1,3})?\b"), F.lit(0)
    )
    return F.filter(F.transform(found, ocr_amount), lambda x: x > 0)


def scale_fixed(value: Column, reading: Column) -> Column:
    """Model amount corrected by the printed reading when off by thousands or far too small."""
    ratio = F.try_divide(value, reading)
    return (
        F.when((reading > 0) & (value > 0) & ratio.between(900, 1100), reading)
        .when((reading >= 10) & (value > 0) & (value < reading * F.lit("0.1").cast("decimal(3,1)")), reading)
        .when((value >= 100000) & (value == F.floor(value)), (value / 1000).cast(AMOUNT))
        .otherwise(value)
    )


def french_format(value: Column) -> Column:
    """Three decimals, comma, narrow no-break space between thousands."""
    return F.translate(F.format_number(value, 3), ",.", "\u202f,")
