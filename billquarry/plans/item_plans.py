"""Article rows of rendered invoices: extraction must give the source lines back."""

from __future__ import annotations

from pyspark.sql import functions as F

from billquarry.operators import items
from billquarry.plans import rendering as R
from billquarry.plans.registry import query


def _amounts(df):
    return df.select(
        "doc_id", "item_no", "description", F.col("quantity").cast("double").alias("quantity"),
        F.col("unit_price").cast("double").alias("unit_price"), F.col("total").cast("double").alias("total"),
    )


def _expected(price: str = "CAST(unit_milli AS DOUBLE) / 1000", total: str = "CAST(milli AS DOUBLE) / 1000", quantity: str = "CAST(quantity AS DOUBLE)", having: str = "") -> str:
    return R.sheets_sql(
        f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line, part_id, source_id, total_cents, discount_pct, quantity, milli, unit_milli, description) AS item_no,
            description, {quantity} AS quantity, {price} AS unit_price, {total} AS total FROM lines {having}"""
    )


@query("txt_items_unit", _expected())
def txt_items_unit(spark, d):
    return _amounts(items.items_by(R.texts(spark, d, "unit"), "unit"))


MANY = "WHERE doc_id IN (SELECT doc_id FROM sums WHERE n >= 2)"


@query("txt_items_alternating", _expected(total="CAST(unit_milli * quantity AS DOUBLE) / 1000", having=MANY))
def txt_items_alternating(spark, d):
    return _amounts(items.items_by(R.texts(spark, d, "alternating"), "alternating"))


@query("txt_items_vertical", _expected())
def txt_items_vertical(spark, d):
    return _amounts(items.items_by(R.texts(spark, d, "vertical"), "vertical", whole_text=False))


@query("txt_items_columnar", _expected(price="CAST(milli AS DOUBLE) / 1000", quantity="1.0", having=MANY))
def txt_items_columnar(spark, d):
    return _amounts(items.items_by(R.texts(spark, d, "columnar"), "columnar", whole_text=False))


@query("txt_items_free", _expected(price="CAST(unit_milli // 10 AS DOUBLE) / 100", total="CAST(milli // 10 AS DOUBLE) / 100"))
def txt_items_free(spark, d):
    return _amounts(items.items_by(R.texts(spark, d, "free"), "free", whole_text=False))


@query(
    "txt_items_first_method",
    R.sheets_sql("""SELECT doc_id, CASE order_id % 5 WHEN 0 THEN 'unit' WHEN 1 THEN CASE WHEN n >= 2 THEN 'alternating' END
        WHEN 2 THEN 'vertical' WHEN 3 THEN CASE WHEN n >= 2 THEN 'columnar' END ELSE 'free' END AS method,
        CASE WHEN order_id % 5 IN (1, 3) AND n < 2 THEN 0 ELSE n END AS items FROM sheets"""),
)
def txt_items_first_method(spark, d):
    """Table shape by order number; the first method that reads it is reported."""
    key = F.col("order_id") % 5
    rows = F.when(key == 0, R.unit_rows()).when(key == 1, R.alternating_rows()).when(key == 2, R.vertical_rows()).when(key == 3, R.columnar_rows()).otherwise(R.free_rows())
    docs = R.sheets(spark, d).select(
        "doc_id", F.array_join(F.concat(F.array(F.concat(F.lit("FACTURE N° "), F.col("invoice_number"))), rows, F.array(F.lit("Total TTC 1,000"))), "\n").alias("text")
    )
    return items.with_items(docs).select("doc_id", "method", F.size("items").cast("long").alias("items"))


@query("txt_table_section", R.sheets_sql("""SELECT doc_id, n + 1 AS table_lines, 'Désignation | Unité | Quantité | P.U.H.T | TVA | Total HT' AS first_line FROM sheets"""))
def txt_table_section(spark, d):
    from billquarry.functions.text import split_lines

    found = R.texts(spark, d, "unit").select("doc_id", split_lines(items.table_section(F.col("text"))).alias("t"))
    kept = F.filter("t", lambda s: ~s.rlike("^(?:Total HT|TVA|FODEC|Timbre)") & (F.trim(s) != ""))
    return found.select("doc_id", F.size(kept).cast("long").alias("table_lines"), F.get("t", F.lit(0)).alias("first_line"))
