"""Invoice texts rendered from orders, line items and customers.

The expected extraction of a rendered invoice is the row it came from, so the
checks of the extraction queries are plain SQL on the source tables. Every
invoice is printed in pages ("sheets") by the number of its lines; each page
carries the totals of the whole invoice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from billquarry.plans import bindings as B
from billquarry.sources.records import paged


def milli_text(m: Column) -> Column:
    """Thousandths as printed: 12345 -> 12,345."""
    return F.concat(F.floor(m / 1000).cast("string"), F.lit(","), F.lpad((m % 1000).cast("string"), 3, "0"))


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per printed page: header values, exact amounts of the whole invoice and the page's lines in print order.

    A page holds at most as many lines as line numbers fit on it; amounts are aggregates over all lines. Lines are dealt out
    by invoice once: pages, amounts of the whole invoice and its header meet in that partition.
    """
    priced = paged(B.items(spark, sf_dir)).repartition("invoice_id").withColumn("milli", F.expr("(total_cents * (100 - discount_pct) + 5) div 10")).withColumn(
        "unit_milli", F.expr("(2 * milli + quantity) div (2 * quantity)")
    )
    pages = priced.groupBy("invoice_id", "page").agg(
        F.array_sort(
            F.collect_list(
                F.struct("line", "part_id", "source_id", "total_cents", "discount_pct", "quantity", "milli", "unit_milli", "description")
            )
        ).alias("lines"),
        F.sum("milli").alias("page_ht"),
        F.sum(F.col("unit_milli") * F.col("quantity")).alias("page_qu"),
    )
    whole = Window.partitionBy("invoice_id")  # one row a page
    per_sheet = pages.withColumn("ht", F.sum("page_ht").over(whole)).withColumn("qu", F.sum("page_qu").over(whole)).drop("page_ht", "page_qu")
    inv = B.invoices(spark, sf_dir).select("id", "invoice_number", "supplier_id", "invoice_date")
    ttc_shift = F.when(F.col("order_id") % 4 == 1, 1).when(F.col("order_id") % 4 == 2, 1000).otherwise(0)
    return (
        per_sheet.join(inv, per_sheet["invoice_id"] == inv["id"])
        .withColumnRenamed("invoice_id", "order_id")
        .select(
            F.concat(F.col("order_id").cast("string"), F.lit("/"), F.col("page").cast("string")).alias("doc_id"),
            "order_id", "page", "invoice_number", "supplier_id",
            F.date_format("invoice_date", "dd/MM/yyyy").alias("day"),
            F.concat(F.lit("STE ATLAS "), B.digits(F.col("supplier_id"), 9)).alias("vendor"),
            F.concat(F.lit("STE BORNE "), B.digits(F.col("supplier_id") + 1, 9)).alias("customer"),
            F.concat(B.digits(F.col("supplier_id"), 7), F.lit("A/M/000")).alias("vendor_tax"),
            F.concat(B.digits(F.col("supplier_id") + 1, 7), F.lit("B/P/001")).alias("customer_tax"),
            F.concat(F.lit("71 "), F.substring(B.digits(F.col("supplier_id") % 1000000, 6), 1, 3), F.lit(" "),
                     F.substring(B.digits(F.col("supplier_id") % 1000000, 6), 4, 3)).alias("vendor_phone"),
            "lines", "ht", "qu",
            F.expr("(ht * 19 + 50) div 100").alias("tva"),
            F.lit(600).cast("long").alias("stamp"),
            ttc_shift.cast("long").alias("shift"),
        )
        .withColumn("ttc", F.col("ht") + F.col("tva") + F.col("stamp") + F.col("shift"))
    )


SHEETS = f"""priced AS (SELECT *, (total_cents * (100 - discount_pct) + 5) // 10 AS milli FROM paged),
 lines AS (SELECT *, (2 * milli + quantity) // (2 * quantity) AS unit_milli, invoice_id || '/' || page AS doc_id FROM priced),
 wholes AS (SELECT invoice_id, CAST(sum(milli) AS BIGINT) AS ht, CAST(sum(unit_milli * quantity) AS BIGINT) AS qu FROM lines GROUP BY invoice_id),
 sums AS (SELECT doc_id, invoice_id, any_value(w.ht) AS ht, any_value(w.qu) AS qu, count(*) AS n FROM lines JOIN wholes w USING (invoice_id) GROUP BY doc_id, invoice_id),
 sheets AS (
  SELECT s.doc_id, s.invoice_id AS order_id, s.ht, s.qu, s.n, i.invoice_number, i.supplier_id, strftime(i.invoice_date, '%d/%m/%Y') AS day,
         'STE ATLAS ' || {B.sql_digits('i.supplier_id', 9)} AS vendor, 'STE BORNE ' || {B.sql_digits('i.supplier_id + 1', 9)} AS customer,
         {B.sql_digits('i.supplier_id', 7)} || 'A/M/000' AS vendor_tax, {B.sql_digits('i.supplier_id + 1', 7)} || 'B/P/001' AS customer_tax,
         '71 ' || substr({B.sql_digits('i.supplier_id % 1000000', 6)}, 1, 3) || ' ' || substr({B.sql_digits('i.supplier_id % 1000000', 6)}, 4, 3) AS vendor_phone,
         (s.ht * 19 + 50) // 100 AS tva, 600 AS stamp,
         s.ht + (s.ht * 19 + 50) // 100 + 600 + CASE s.invoice_id % 4 WHEN 1 THEN 1 WHEN 2 THEN 1000 ELSE 0 END AS ttc
  FROM sums s JOIN invoices i ON i.id = s.invoice_id)"""


def sheets_sql(body: str, *more: str) -> str:
    return B.with_ctes(B.INVOICES, B.ITEMS, B.PAGED, SHEETS, *more, body=body)


def unit_rows() -> Column:
    head = F.lit("Désignation | Unité | Quantité | P.U.H.T | TVA | Total HT")
    rows = F.transform(
        "lines",
        lambda r: F.concat_ws(
            " | ", r["description"], F.lit("U"), r["quantity"].cast("string"), milli_text(r["unit_milli"]), F.lit("19"), milli_text(r["milli"])
        ),
    )
    return F.concat(F.array(head), rows)


def alternating_rows() -> Column:
    head = F.lit("Désignation | Qte | Prix HT | Montant HT")
    rows = F.flatten(
        F.transform(
            "lines",
            lambda r: F.array(
                F.concat_ws(" | ", r["quantity"].cast("string"), milli_text(r["unit_milli"]), milli_text(r["unit_milli"] * r["quantity"])),
                r["description"],
            ),
        )
    )
    return F.concat(F.array(head), rows)


def vertical_rows() -> Column:
    rows = F.flatten(
        F.transform(
            "lines",
            lambda r: F.array(
                B.digits(r["part_id"], 6), r["description"], r["quantity"].cast("string"), milli_text(r["unit_milli"]), milli_text(r["milli"])
            ),
        )
    )
    return F.concat(F.array(F.lit("Référence")), rows)


def columnar_rows() -> Column:
    amounts = F.transform("lines", lambda r: F.translate(milli_text(r["milli"]), ",", "."))
    return F.concat(F.array(F.lit("Désignation")), F.transform("lines", lambda r: r["description"]), amounts)


def free_rows() -> Column:
    """Rows without a unit column, two decimals: description, quantity, price, rate, total."""
    def cents(m: Column) -> Column:
        c = F.floor(m / 10)
        return F.concat(F.floor(c / 100).cast("string"), F.lit(","), F.lpad((c % 100).cast("string"), 2, "0"))

    rows = F.transform(
        "lines",
        lambda r: F.concat_ws(" | ", r["description"], r["quantity"].cast("string"), cents(r["unit_milli"]), F.lit("19"), cents(r["milli"])),
    )
    return F.concat(F.array(F.lit("Code Article")), rows)


SHAPES = {"unit": unit_rows, "alternating": alternating_rows, "vertical": vertical_rows, "columnar": columnar_rows, "free": free_rows}


def texts(spark: SparkSession, sf_dir: str, shape: str = "unit", title: str | Column = "FACTURE") -> DataFrame:
    """Rendered invoices: (doc_id, order_id, text) plus the values they were rendered from."""
    heading = title if isinstance(title, Column) else F.lit(title)
    key = F.col("order_id")
    parts = F.concat(
        F.array(
            F.lit("--- Page 1 ---"),
            F.concat(heading, F.lit(" N° "), F.col("invoice_number")),
            F.concat(F.lit("Date : "), F.col("day")),
            F.concat(F.lit("Fournisseur : "), F.col("vendor")),
            F.concat(F.lit("Adresse : 12 rue de Tunis "), F.col("supplier_id").cast("string")),
            F.concat(F.lit("MF : "), F.col("vendor_tax")),
            F.concat(F.lit("Tél : "), F.col("vendor_phone")),
            F.concat(F.lit("Client : "), F.col("customer")),
            F.concat(F.lit("MF : "), F.col("customer_tax")),
            F.concat(F.lit("Adresse : 9 avenue de Sfax "), F.col("supplier_id").cast("string")),
        ),
        SHAPES[shape](),
        F.array(F.concat(F.lit("Total HT "), milli_text(F.col("ht")))),
        F.when(key % 4 != 3, F.array(F.concat(F.lit("TVA (19%) "), milli_text(F.col("tva"))))).otherwise(F.array().cast("array<string>")),
        F.when((key % 5 == 0) & F.lit(shape != "free"), F.array(F.concat(F.lit("FODEC 1% "), milli_text(F.col("ht") - F.col("ht") % 100)))).otherwise(F.array().cast("array<string>")),
        F.array(F.concat(F.lit("Timbre fiscal "), milli_text(F.col("stamp"))), F.concat(F.lit("Total TTC "), milli_text(F.col("ttc")))),
        F.when(key % 3 == 0, F.array(F.lit("Payée en espèces")))
        .when(key % 3 == 1, F.array(F.lit("non payée en espèces")))
        .otherwise(F.array(F.lit("Arrêtée la présente facture à la somme de : Deux Cent Dinars et Cinq Millimes"))),
    )
    return sheets(spark, sf_dir).withColumn("text", F.array_join(parts, "\n"))
