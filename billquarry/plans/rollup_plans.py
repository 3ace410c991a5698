"""Aggregations, ordered reports and set operations on the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from billquarry.functions import text as X
from billquarry.operators import fields as E
from billquarry.operators import rollups, search
from billquarry.plans import bindings as B
from billquarry.plans import rendering as R
from billquarry.plans.registry import query
from billquarry.sources import blobs, files


@query(
    "agg_dashboard_totals",
    B.with_ctes(B.INVOICES, body="""SELECT count(*) AS total_invoices, count(*) FILTER (status = 'validated') AS validated_invoices,
       count(*) FILTER (status <> 'validated') AS draft_invoices, CAST(coalesce(sum(cents), 0) AS DOUBLE) / 100 AS total_amount,
       coalesce(CAST(sum(confidence_pct) AS DOUBLE) / nullif(count(confidence_pct) * 100, 0), 0.0) AS avg_confidence FROM invoices"""),
)
def agg_dashboard_totals(spark, d):
    return rollups.dashboard_totals(B.invoices(spark, d))


@query(
    "agg_monthly_amounts",
    B.with_ctes(B.INVOICES, body="""SELECT strftime(created_date, '%Y-%m') AS month, CAST(sum(cents) AS DOUBLE) / 100 AS amount, count(*) AS count
       FROM invoices GROUP BY 1 ORDER BY 1"""),
)
def agg_monthly_amounts(spark, d):
    return rollups.monthly_amounts(B.invoices(spark, d)).orderBy("month")


@query(
    "agg_status_split",
    B.with_ctes(B.INVOICES, body="""SELECT CASE WHEN status = 'validated' THEN 'Validées' ELSE 'À vérifier' END AS name, count(*) AS value FROM invoices GROUP BY 1"""),
)
def agg_status_split(spark, d):
    return rollups.status_split(B.invoices(spark, d))


AVG_CENTS = "CAST((sum(cents) * 200 + count(cents)) // (count(cents) * 2) AS DOUBLE) / 10000"


@query(
    "agg_supplier_totals",
    B.with_ctes(B.INVOICES, B.SUPPLIERS, body="""SELECT s.id, s.name, count(i.id) AS invoices_count, CAST(coalesce(sum(i.cents), 0) AS DOUBLE) / 100 AS total_amount
       FROM suppliers s LEFT JOIN invoices i ON i.supplier_id = s.id GROUP BY s.id, s.name"""),
)
def agg_supplier_totals(spark, d):
    totals = rollups.supplier_totals(B.invoices(spark, d))
    return B.suppliers(spark, d).join(totals, F.col("id") == F.col("supplier_id"), "left").select(
        "id", "name", F.coalesce("invoices_count", F.lit(0)).alias("invoices_count"), F.coalesce("total_amount", F.lit(0.0)).alias("total_amount")
    )


@query(
    "agg_supplier_average",
    B.with_ctes(B.INVOICES, B.SUPPLIERS, body=f"""SELECT s.id, coalesce({AVG_CENTS}, 0.0) AS average_amount
       FROM suppliers s LEFT JOIN invoices i ON i.supplier_id = s.id GROUP BY s.id"""),
)
def agg_supplier_average(spark, d):
    totals = rollups.supplier_totals(B.invoices(spark, d))
    return B.suppliers(spark, d).join(totals, F.col("id") == F.col("supplier_id"), "left").select(
        "id", F.coalesce("average_amount", F.lit(0.0)).alias("average_amount")
    )


@query(
    "agg_dataset_counts",
    """SELECT 'split' AS dimension, lang AS bucket, count(*) AS n FROM documents GROUP BY lang
       UNION ALL SELECT 'format', source, count(*) FROM documents GROUP BY source
       UNION ALL SELECT 'kind', CASE page_id % 5 WHEN 0 THEN 'image' WHEN 1 THEN 'annotation' WHEN 2 THEN 'split_csv' WHEN 3 THEN 'metadata' ELSE 'other' END, count(*) FROM pages GROUP BY 2""",
)
def agg_dataset_counts(spark, d):
    docs = rollups.counts_by(B.documents(spark, d), {"split": F.col("lang"), "format": F.col("source")})
    kinds = rollups.counts_by(files.describe_files(B.file_listing(spark, d)), {"kind": F.col("kind")})
    return docs.unionByName(kinds)


@query(
    "agg_dataset_totals",
    """SELECT count(*) AS annotations, CAST(sum(len(string_split(text, ' '))) AS BIGINT) AS words, count(*) FILTER (turn % 2 = 0) AS boxes FROM conversations""",
)
def agg_dataset_totals(spark, d):
    return B.table(spark, d, "conversations").agg(
        F.count(F.lit(1)).alias("annotations"), F.sum(F.size(F.split("text", " "))).alias("words"), F.count_if(F.col("turn") % 2 == 0).alias("boxes")
    )


DETECTIONS = """det AS (SELECT event_id AS id, event_id // 10 AS doc_id, CASE event_id % 3 WHEN 0 THEN 'logo' WHEN 1 THEN 'stamp' ELSE 'signature' END AS class_name,
   event_id * 37 % 100 AS confidence_pct, CASE WHEN event_id % 4 = 0 THEN '' ELSE props END AS text, event_id * 13 % 100 AS ocr_pct FROM events)"""


def detections(spark, d):
    key = F.col("event_id")
    return B.table(spark, d, "events").select(
        key.alias("id"), F.floor(key / 10).alias("doc_id"),
        F.element_at(F.array(F.lit("logo"), F.lit("stamp"), F.lit("signature")), (key % 3 + 1).cast("int")).alias("class_name"),
        (key * 37 % 100).alias("confidence_pct"), F.when(key % 4 == 0, "").otherwise(F.col("props")).alias("text"), (key * 13 % 100).alias("ocr_pct"),
        ((key % 10).cast("double") / 20).alias("x1"), ((key % 7).cast("double") / 20).alias("y1"),
    )


@query(
    "agg_entity_stats",
    B.with_ctes(DETECTIONS, body="""SELECT class_name, count(*) AS n, CAST((sum(confidence_pct) * 20 + count(*)) // (count(*) * 2) AS DOUBLE) / 1000 AS avg_confidence,
       CAST(min(confidence_pct) AS DOUBLE) / 100 AS min_confidence, CAST(max(confidence_pct) AS DOUBLE) / 100 AS max_confidence FROM det GROUP BY class_name"""),
)
def agg_entity_stats(spark, d):
    return rollups.entity_stats(detections(spark, d))


@query(
    "agg_text_capture",
    B.with_ctes(DETECTIONS, body="""SELECT class_name, count(*) FILTER (text <> '') AS with_text, count(*) FILTER (text = '') AS without_text,
       CAST((sum(length(text)) FILTER (text <> '') * 20 + count(*) FILTER (text <> '')) // (count(*) FILTER (text <> '') * 2) AS DOUBLE) / 10 AS avg_text_length,
       CAST((sum(ocr_pct) FILTER (text <> '') * 20 + count(*) FILTER (text <> '')) // (count(*) FILTER (text <> '') * 2) AS DOUBLE) / 10 / 100 AS avg_ocr_confidence,
       CAST(sum(CASE WHEN text <> '' THEN confidence_pct + ocr_pct ELSE confidence_pct * 2 END) AS DOUBLE) / 200 AS combined_confidence FROM det GROUP BY class_name"""),
)
def agg_text_capture(spark, d):
    return rollups.text_capture(detections(spark, d))


@query(
    "agg_page_confidence",
    """SELECT l_orderkey AS doc_id, coalesce(CAST(sum(round(l_discount * 100)) FILTER (l_discount > 0) AS DOUBLE) / nullif(count(*) FILTER (l_discount > 0) * 100, 0), 0.0) AS confidence
       FROM lineitem GROUP BY l_orderkey""",
)
def agg_page_confidence(spark, d):
    return rollups.page_confidence(
        B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.round(F.col("l_discount") * 100).cast("long").alias("confidence_pct"))
    )


def ocr_lines(spark, d):
    """Line boxes per order in thousandths of the page; confidence unknown when the tax is zero."""
    return B.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part_id"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("total_cents"),
        (F.col("l_linenumber") % 5 * 100).cast("long").alias("x"), (F.col("l_linenumber") * 50).cast("long").alias("y"),
        F.lit(200).cast("long").alias("w"), F.lit(30).cast("long").alias("h"),
        F.when(F.col("l_tax") > 0, F.round(F.col("l_discount") * 1000).cast("long")).alias("confidence_pct"),
    )


@query(
    "agg_passage_confidence",
    """SELECT l_orderkey AS doc_id, CASE WHEN count(*) = count(*) FILTER (l_tax > 0) THEN CAST(sum(CAST(round(l_discount * 1000) AS BIGINT)) AS DOUBLE) / (count(*) * 100) END AS confidence
       FROM lineitem GROUP BY l_orderkey""",
)
def agg_passage_confidence(spark, d):
    return rollups.passage_confidence(ocr_lines(spark, d), ["doc_id"])


@query(
    "agg_passage_box",
    """WITH l AS (SELECT l_orderkey AS doc_id, CASE WHEN l_linenumber <> 7 THEN CAST(l_linenumber % 5 * 100 AS BIGINT) END AS x, CAST(l_linenumber * 50 AS BIGINT) AS y FROM lineitem)
       SELECT doc_id, CASE WHEN count(x) = count(*) THEN min(x) END AS x, CASE WHEN count(x) = count(*) THEN min(y) END AS y,
         CASE WHEN count(x) = count(*) THEN max(x + 200) - min(x) END AS w, CASE WHEN count(x) = count(*) THEN max(y + 30) - min(y) END AS h FROM l GROUP BY doc_id""",
)
def agg_passage_box(spark, d):
    lines = ocr_lines(spark, d).withColumn("x", F.when(F.col("line") != 7, F.col("x")))
    return rollups.passage_box(lines, ["doc_id"])


@query(
    "agg_storage_bytes",
    "SELECT CAST(sum(octet_length(encode(t))) AS BIGINT) AS stored_bytes, count(*) AS contents FROM (SELECT DISTINCT text AS t FROM documents)",
)
def agg_storage_bytes(spark, d):
    store = blobs.with_digest(B.documents(spark, d), "text").select("digest", F.octet_length("text").cast("long").alias("size"))
    return blobs.stored_bytes(store)


@query(
    "agg_extra_tax_once",
    """WITH r AS (SELECT DISTINCT l_orderkey AS doc_id, CAST(round(l_tax * 100) AS BIGINT) AS rate, CAST(round(l_extendedprice * l_tax * 100) AS BIGINT) * 10 AS amount_milli, l_linenumber AS line
          FROM lineitem WHERE l_linenumber % 2 = 0)
       SELECT doc_id, CAST(sum(amount_milli) AS BIGINT) AS extra_tax_milli FROM r GROUP BY doc_id""",
)
def agg_extra_tax_once(spark, d):
    """Tax rows per order: even lines are FODEC, printed again under the same source; odd ones are VAT."""
    rows = B.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_linenumber") % 2 == 0, "FODEC").otherwise("TVA").alias("label"),
        F.round(F.col("l_tax") * 100).cast("long").alias("rate"),
        (F.round(F.col("l_extendedprice") * F.col("l_tax") * 100).cast("long") * 10).alias("amount_milli"),
        F.col("l_linenumber").cast("string").alias("source"),
    )
    return rollups.extra_tax_once(rows.unionByName(rows))


# --- ordered reports ---------------------------------------------------------


@query(
    "top_suppliers",
    B.with_ctes(B.INVOICES, body="""SELECT supplier_id AS id, supplier_name AS name, count(*) AS invoices_count, CAST(sum(cents) AS DOUBLE) / 100 AS total_amount
       FROM invoices GROUP BY 1, 2 ORDER BY invoices_count DESC, total_amount DESC, name LIMIT 5"""),
)
def top_suppliers(spark, d):
    per = B.invoices(spark, d).groupBy(F.col("supplier_id").alias("id"), F.col("supplier_name").alias("name")).agg(
        F.count(F.lit(1)).alias("invoices_count"), (F.sum("cents").cast("double") / 100).alias("total_amount")
    )
    return per.orderBy(F.desc("invoices_count"), F.desc("total_amount"), "name").limit(5)


@query(
    "due_soon",
    B.with_ctes(B.INVOICES, body="""SELECT id, invoice_number, supplier_name, strftime(coalesce(due_date, invoice_date), '%Y-%m-%d') AS due, status
       FROM invoices WHERE coalesce(due_date, invoice_date) IS NOT NULL ORDER BY coalesce(due_date, invoice_date), id LIMIT 8"""),
)
def due_soon(spark, d):
    due = B.invoices(spark, d).withColumn("_due", F.coalesce("due_date", "invoice_date")).filter(F.col("_due").isNotNull())
    return due.orderBy("_due", "id").limit(8).select(
        "id", "invoice_number", "supplier_name", F.date_format("_due", "yyyy-MM-dd").alias("due"), "status"
    )


@query(
    "page_invoices",
    B.with_ctes(B.INVOICES, body="""SELECT id, invoice_number, (SELECT count(*) FROM invoices WHERE status = 'validated') AS total, 3 AS page,
        greatest(1, ((SELECT count(*) FROM invoices WHERE status = 'validated') + 24) // 25) AS total_pages
       FROM invoices WHERE status = 'validated' ORDER BY created_date DESC, id DESC LIMIT 25 OFFSET 50"""),
)
def page_invoices(spark, d):
    found = search.search_invoices(B.invoices(spark, d), status="validated")
    return search.page_of(found, [F.desc("created_date"), F.desc("id")], 3, 25).select("id", "invoice_number", "total", "page", "total_pages")


@query(
    "page_invoices_deep",
    B.with_ctes(B.INVOICES, body="""SELECT id, invoice_number, (SELECT count(*) FROM invoices WHERE status = 'validated') AS total, 25 AS page,
        greatest(1, ((SELECT count(*) FROM invoices WHERE status = 'validated') + 24) // 25) AS total_pages
       FROM invoices WHERE status = 'validated' ORDER BY created_date DESC, id DESC LIMIT 25 OFFSET 600"""),
)
def page_invoices_deep(spark, d):
    """A page located by counts of days, then of ranges of ids."""
    found = search.search_invoices(B.invoices(spark, d), status="validated")
    ranges = [-F.datediff("created_date", F.lit("1970-01-01").cast("date")), -F.floor(F.col("id") / 4096)]
    page = search.page_of(found, [F.desc("created_date"), F.desc("id")], 25, 25, ranges=ranges, shallow=500)
    return page.select("id", "invoice_number", "total", "page", "total_pages")


@query(
    "list_recent",
    B.with_ctes(B.EVENTS, body="""SELECT id, invoice_id, action, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM ev ORDER BY ev.created_at DESC, id DESC"""),
)
def list_recent(spark, d):
    return B.events(spark, d).orderBy(F.desc("created_at"), F.desc("id")).select(
        "id", "invoice_id", "action", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at")
    )


@query("dataset_samples", "SELECT lang AS split, source, doc_id FROM documents WHERE lang = 'en' ORDER BY source, doc_id LIMIT 100")
def dataset_samples(spark, d):
    """Samples of one split by name; the requested size is clamped to 1..100."""
    size = min(100, max(1, 5000))
    chosen = search.where_given(B.documents(spark, d), F.col("lang") == "en")
    return chosen.orderBy("source", "doc_id").limit(size).select(F.col("lang").alias("split"), "source", "doc_id")


@query(
    "recent_unique",
    """SELECT user_id, event_type, k, min(event_id) AS event_id FROM (SELECT user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id FROM events) GROUP BY 1, 2, 3""",
)
def recent_unique(spark, d):
    rows = B.table(spark, d, "events").select("user_id", "event_type", F.from_json("props", "k BIGINT")["k"].alias("k"), "event_id")
    return search.first_per(rows, ["user_id", "event_type", "k"], ["event_id"])


# --- set operations ----------------------------------------------------------


@query(
    "union_catalog",
    B.with_ctes(B.INVOICES, body=""", u AS (SELECT 0 AS rank, CAST(id AS VARCHAR) AS id, supplier_name, status, created_date, CAST(NULL AS VARCHAR) AS name, id AS num FROM invoices WHERE status = 'validated'
        UNION ALL SELECT 1, 'dataset:' || doc_id, 'Facture dataset', 'dataset', NULL, source || '/' || doc_id, 0 FROM documents)
       SELECT id, supplier_name, status, (SELECT count(*) FROM u) AS total FROM u ORDER BY rank, created_date DESC NULLS LAST, num DESC, name LIMIT 100 OFFSET 4900"""),
)
def union_catalog(spark, d):
    """Processed invoices then data set invoices, paged as one list."""
    done = search.search_invoices(B.invoices(spark, d), status="validated").select(
        F.lit(0).alias("rank"), F.col("id").cast("string").alias("id"), "supplier_name", "status", "created_date", F.lit(None).cast("string").alias("name"), F.col("id").alias("num")
    )
    sample = B.documents(spark, d).select(
        F.lit(1).alias("rank"), F.concat(F.lit("dataset:"), F.col("doc_id").cast("string")).alias("id"), F.lit("Facture dataset").alias("supplier_name"),
        F.lit("dataset").alias("status"), F.lit(None).cast("date").alias("created_date"),
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("name"), F.lit(0).cast("long").alias("num"),
    )
    order = [F.col("rank"), F.desc_nulls_last("created_date"), F.desc("num"), F.col("name")]
    return search.page_of(done.unionByName(sample), order, 50, 100).select("id", "supplier_name", "status", "total")


@query(
    "union_items_dedup",
    """WITH m AS (SELECT l_orderkey AS doc_id, lower(regexp_replace(p_name, '[^\\p{L}\\p{N}]', '', 'g')) AS k, CAST(round(l_extendedprice * 100) AS BIGINT) AS total_cents, l_linenumber AS line FROM lineitem JOIN part ON l_partkey = p_partkey),
       u AS (SELECT doc_id, k, total_cents, 'model' AS source FROM m WHERE line % 2 = 0 UNION ALL SELECT doc_id, k, total_cents, 'rule' FROM m)
       SELECT doc_id, k AS item_key, total_cents, min(source) AS source FROM u GROUP BY 1, 2, 3""",
)
def union_items_dedup(spark, d):
    """Model rows before rule rows; the first per canonical description and total stays."""
    rule = B.items(spark, d).select("invoice_id", "line", X.canonical(F.col("description")).alias("item_key"), "total_cents")
    model = rule.filter(F.col("line") % 2 == 0).withColumn("item_key", X.canonical(F.upper("item_key")))
    both = model.withColumn("rank", F.lit(0)).unionByName(rule.withColumn("rank", F.lit(1)))
    kept = both.groupBy(F.col("invoice_id").alias("doc_id"), "item_key", "total_cents").agg(F.min("rank").alias("rank"))
    return kept.select("doc_id", "item_key", "total_cents", F.when(F.col("rank") == 0, "model").otherwise("rule").alias("source"))


@query("distinct_tax_ids", R.sheets_sql("""SELECT doc_id, vendor_tax || ',' || customer_tax AS ids FROM sheets"""))
def distinct_tax_ids(spark, d):
    """Identifiers printed on every invoice, each once in the order of its first place; the vendor's stands there again,
    grouped by blanks and in small letters."""
    again = F.concat(F.lit("\nRappel MF "), F.lower("vendor_tax"), F.lit("\nMF : "), F.regexp_replace("vendor_tax", "/", " / "))
    return R.texts(spark, d).select("doc_id", F.array_join(E.distinct_tax_ids(F.concat("text", again)), ",").alias("ids"))
