"""Views over the shared tables that stand for the application's tables.

Each Spark view has a twin SQL fragment, so that a check can name the same
columns. Derived values use key arithmetic only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def digits(c: Column, width: int) -> Column:
    """Left-padded number that never loses digits when longer than the width."""
    text = c.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def sql_digits(expr: str, width: int) -> str:
    return (
        f"CASE WHEN length(CAST({expr} AS VARCHAR)) < {width} THEN lpad(CAST({expr} AS VARCHAR), {width}, '0') "
        f"ELSE CAST({expr} AS VARCHAR) END"
    )


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    key = F.col("o_orderkey")
    date = F.col("o_orderdate").cast("date")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        key.alias("id"),
        digits(key, 6).alias("invoice_number"),
        F.concat(F.lit("scan_"), key.cast("string"), F.lit(".pdf")).alias("filename"),
        F.col("o_custkey").alias("supplier_id"),
        F.col("c_name").alias("supplier_name"),
        F.col("c_mktsegment").alias("customer_name"),
        date.alias("created_date"),
        date.alias("invoice_date"),
        F.when(key % 10 != 0, F.date_add(date, (key % 60).cast("int"))).alias("due_date"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"),
        F.when(F.col("o_orderstatus") == "F", "validated").otherwise("draft").alias("status"),
        (key % 100).alias("confidence_pct"),
        F.element_at(F.array(F.lit("TND"), F.lit("EUR"), F.lit("USD")), (key % 3 + 1).cast("int")).alias("currency"),
        F.concat(F.lit('{"company":"'), "c_mktsegment", F.lit('","tax_id":"'), digits(F.col("o_custkey"), 7), F.lit('A/M/000"}')).alias("normalized_json"),
        F.concat(F.lit("FACTURE N "), digits(key, 6), F.lit("\n"), "c_name", F.lit("\nMF "), digits(F.col("o_custkey"), 7), F.lit("A/M/000")).alias("extracted_text"),
    )


INVOICES = f"""invoices AS (
  SELECT o_orderkey AS id,
         CASE WHEN length(CAST(o_orderkey AS VARCHAR)) < 6 THEN lpad(CAST(o_orderkey AS VARCHAR), 6, '0')
              ELSE CAST(o_orderkey AS VARCHAR) END AS invoice_number,
         'scan_' || o_orderkey || '.pdf' AS filename,
         o_custkey AS supplier_id, c_name AS supplier_name, c_mktsegment AS customer_name,
         CAST(o_orderdate AS DATE) AS created_date, CAST(o_orderdate AS DATE) AS invoice_date,
         CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INTEGER) END AS due_date,
         CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
         CASE WHEN o_orderstatus = 'F' THEN 'validated' ELSE 'draft' END AS status,
         o_orderkey % 100 AS confidence_pct,
         CASE o_orderkey % 3 WHEN 0 THEN 'TND' WHEN 1 THEN 'EUR' ELSE 'USD' END AS currency,
         '{{"company":"' || c_mktsegment || '","tax_id":"' || {sql_digits('o_custkey', 7)} || 'A/M/000"}}' AS normalized_json,
         'FACTURE N ' || {sql_digits('o_orderkey', 6)} || chr(10) || c_name || chr(10) || 'MF ' || {sql_digits('o_custkey', 7)} || 'A/M/000' AS extracted_text
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    blank = key % 5 == 0
    return table(spark, sf_dir, "customer").select(
        key.alias("id"),
        F.col("c_name").alias("name"),
        F.when(blank, "").otherwise(F.concat(digits(key, 7), F.lit("A/M/000"))).alias("tax_id"),
        F.when(blank, "").otherwise(F.col("c_mktsegment")).alias("address"),
        F.when(blank, "").otherwise(F.concat(F.lit("71"), digits(key % 1000000, 6))).alias("phone"),
    )


SUPPLIERS = f"""suppliers AS (
  SELECT c_custkey AS id, c_name AS name,
         CASE WHEN c_custkey % 5 = 0 THEN '' ELSE {sql_digits('c_custkey', 7)} || 'A/M/000' END AS tax_id,
         CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END AS address,
         CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '71' || {sql_digits('c_custkey % 1000000', 6)} END AS phone
  FROM customer)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("invoice_id"),
        F.col("l_linenumber").alias("line"),
        F.col("p_name").alias("description"),
        F.col("l_quantity").cast("long").alias("quantity"),
        F.round(F.col("p_retailprice") * 100).cast("long").alias("price_cents"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("total_cents"),
        F.round(F.col("l_discount") * 100).cast("long").alias("discount_pct"),
        F.round(F.col("l_tax") * 100).cast("long").alias("tax_pct"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_suppkey").alias("source_id"),
    )


ITEMS = """items AS (
  SELECT l_orderkey AS invoice_id, l_linenumber AS line, p_name AS description,
         CAST(l_quantity AS BIGINT) AS quantity,
         CAST(round(p_retailprice * 100) AS BIGINT) AS price_cents,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS total_cents,
         CAST(round(l_discount * 100) AS BIGINT) AS discount_pct,
         CAST(round(l_tax * 100) AS BIGINT) AS tax_pct,
         l_partkey AS part_id, l_suppkey AS source_id
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


# pages of printed invoices: one rule for all of them
PAGED = "paged AS (SELECT *, (line - 1) // 64 AS page FROM items)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("invoice_id"),
        F.col("event_type").alias("action"),
        F.col("ts").alias("created_at"),
        F.col("value"),
        F.col("props").alias("payload"),
    )


EVENTS = """ev AS (
  SELECT event_id AS id, user_id AS invoice_id, event_type AS action, ts AS created_at, value, props AS payload
  FROM events)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive members: one path shape per page, size of its content, a time stamp."""
    key = F.col("page_id")
    name = key.cast("string")
    return pages(spark, sf_dir).select(
        key.alias("file_id"),
        F.when(key % 5 == 0, F.concat(F.lit("dataset/images/Scan"), name, F.lit(".JPG")))
        .when(key % 5 == 1, F.concat(F.lit("dataset/Annotations/Original_Format/Scan"), name, F.lit(".json")))
        .when(key % 5 == 2, F.concat(F.lit("dataset/strat1_"), name, F.lit(".csv")))
        .when(key % 5 == 3, F.concat(F.lit("dataset/notes/"), name, F.lit(".txt")))
        .otherwise(F.col("url"))
        .alias("path"),
        F.length("html").cast("long").alias("size"),
        (key * 7 % 1000).alias("mtime"),
    )


LISTING = """listing AS (
  SELECT page_id AS file_id,
         CASE page_id % 5 WHEN 0 THEN 'dataset/images/Scan' || page_id || '.JPG'
                          WHEN 1 THEN 'dataset/Annotations/Original_Format/Scan' || page_id || '.json'
                          WHEN 2 THEN 'dataset/strat1_' || page_id || '.csv'
                          WHEN 3 THEN 'dataset/notes/' || page_id || '.txt'
                          ELSE url END AS path,
         CAST(length(html) AS BIGINT) AS size, page_id * 7 % 1000 AS mtime
  FROM pages)"""


def money(cents: Column) -> Column:
    """Cents as a double of currency units."""
    return cents.cast("double") / 100


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body
