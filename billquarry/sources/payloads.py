"""JSON payload columns to typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from billquarry import vocabulary as V
from billquarry.functions.money import optional_number
from billquarry.functions.text import first_non_empty, non_empty


def json_object(payload: Column, schema: str) -> Column:
    """Typed view of a JSON text; unreadable text gives an empty object."""
    return F.from_json(payload, schema, {"mode": "PERMISSIVE"})


def resolve_aliases(df: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """Every known field from the first of its aliases that holds a value.

    The payload is parsed once into its top-level entries; objects among them are
    parsed once more, so aliases cost map look-ups and not one JSON scan each.
    """
    text_map = T.MapType(T.StringType(), T.StringType())
    parsed = df.withColumn("_top", F.from_json(payload, text_map)).withColumn(
        "_nested",
        F.flatten(
            F.transform(
                F.filter(F.map_values("_top"), lambda v: v.startswith("{")),
                lambda v: F.map_entries(F.from_json(v, text_map)),
            )
        ),
    )

    def value(alias: str) -> list[Column]:
        below = F.filter("_nested", lambda e: e["key"] == alias)
        return [non_empty(F.col("_top")[alias]), non_empty(F.get(below, F.lit(0))["value"])]

    cols = {name: F.coalesce(*[v for a in aliases for v in value(a)]) for name, aliases in V.FIELD_ALIASES.items()}
    cols["currency"] = F.coalesce(cols["currency"], F.lit("TND"))
    return parsed.select(*keep, *[c.alias(name) for name, c in cols.items()])


def structured_fields(payload: Column) -> list[Column]:
    """Stored columns of a normalised record with their fallbacks."""

    def value(*keys: str) -> Column:
        return first_non_empty(*[F.get_json_object(payload, f"$.{k}") for k in keys])

    return [
        F.coalesce(value("invoice_number"), F.lit("")).alias("invoice_number"),
        F.coalesce(value("vendor_name", "supplier_name"), F.lit("Inconnu")).alias("supplier_name"),
        F.coalesce(value("tax_id", "vendor_tax_id"), F.lit("")).alias("tax_id"),
        F.coalesce(value("customer_name"), F.lit("")).alias("customer_name"),
        F.coalesce(value("date", "invoice_date"), F.lit("")).alias("invoice_date"),
        F.coalesce(value("currency"), F.lit("TND")).alias("currency"),
        F.get_json_object(payload, "$.total_amount").alias("total_text"),
    ]


def backfill(rows: DataFrame, payload: str = "payload", number: str = "number", total: str = "total") -> DataFrame:
    """Rows that lack a number or a total, with both recomputed from the stored record."""
    lacking = rows.filter(F.col(number).isNull() | (F.trim(number) == "") | F.col(total).isNull())
    fields = F.from_json(payload, "invoice_number STRING, total_amount STRING")
    return lacking.withColumn(number, F.coalesce(non_empty(fields["invoice_number"]), F.lit(""))).withColumn(
        total, optional_number(fields["total_amount"])
    )
