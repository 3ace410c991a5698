"""Change data and audit trail on the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from billquarry.operators import audit, matching
from billquarry.plans import bindings as B
from billquarry.plans.join_plans import DUPLICATES, duplicate_input
from billquarry.plans.registry import query
from billquarry.sources import payloads


@query(
    "cdc_create_draft",
    B.with_ctes(B.INVOICES, DUPLICATES, body="""SELECT i.id, i.supplier_name, i.invoice_number, d.dup IS NOT NULL AS is_duplicate, coalesce(d.dup, '') AS duplicates, 'created_draft' AS action
       FROM invoices i LEFT JOIN (SELECT id, string_agg(CAST(candidate_id AS VARCHAR), ',' ORDER BY position) AS dup FROM ranked WHERE position <= 5 GROUP BY id) d ON i.id = d.id"""),
)
def cdc_create_draft(spark, d):
    new = B.invoices(spark, d).select("id", "supplier_name", "invoice_number")
    found = matching.duplicate_candidates(duplicate_input(spark, d))
    out = audit.drafts(new, found)
    return out.select("id", "supplier_name", "invoice_number", "is_duplicate", F.coalesce(F.array_join("duplicates", ","), F.lit("")).alias("duplicates"), "action")


@query("cdc_merge_patch", """SELECT event_id, CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'new ' || event_type ELSE event_type END AS type,
    CAST(user_id AS VARCHAR) AS owner, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events""")
def cdc_merge_patch(spark, d):
    """Stored record merged with a patch: a patched key wins, also by NULL; new keys are added."""
    key = F.col("event_id")
    before = F.create_map(F.lit("type"), F.col("event_type"), F.lit("owner"), F.col("user_id").cast("string"))
    k = F.from_json("props", "k STRING")["k"]
    changed = F.when(key % 6 != 0, F.concat(F.lit("new "), F.col("event_type")))
    patch = F.when(key % 3 == 0, F.create_map(F.lit("k"), k, F.lit("type"), changed)).otherwise(F.create_map(F.lit("k"), k))
    rows = B.table(spark, d, "events").select("event_id", audit.merged(before, patch).alias("m"))
    return rows.select("event_id", *[F.try_element_at("m", F.lit(n)).alias(n) for n in ("type", "owner", "k")])


@query("cdc_correction_diff", B.with_ctes(B.INVOICES, body="""SELECT id, concat_ws(',', CASE WHEN id % 2 = 0 THEN 'tax_id=T' || id END, CASE WHEN id % 3 = 0 THEN 'total_amount=' || CAST(CAST(cents + 100 AS DECIMAL(20,0)) / 100 AS DECIMAL(20,3)) END,
    CASE WHEN id % 5 = 0 THEN 'vendor_name=' || supplier_name || ' SA' END, CASE WHEN id % 2 = 0 THEN 'vendor_tax_id=T' || id END) AS patch FROM invoices"""))
def cdc_correction_diff(spark, d):
    """Edited form against the stored record; untouched, blank and missing values send nothing."""
    key = F.col("id")
    total = F.translate((F.col("cents") / 100).cast("decimal(20,2)").cast("string"), ".", ",")
    edited = F.translate(((F.col("cents") + 100) / 100).cast("decimal(20,2)").cast("string"), ".", ",")
    before = F.create_map(F.lit("total_amount"), total, F.lit("vendor_name"), F.col("supplier_name"), F.lit("notes"), F.lit(None).cast("string"))
    after = F.create_map(
        F.lit("total_amount"), F.when(key % 3 == 0, F.concat(F.lit(" "), edited)).otherwise(total),
        F.lit("vendor_name"), F.when(key % 5 == 0, F.concat("supplier_name", F.lit(" SA "))).otherwise(F.col("supplier_name")),
        F.lit("notes"), F.lit(""), F.lit("vendor_tax_id"), F.when(key % 2 == 0, F.concat(F.lit("T"), key.cast("string"))).otherwise(""),
    )
    entries = F.array_sort(F.transform(F.map_entries(audit.correction(before, after)), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return B.invoices(spark, d).select("id", F.array_join(entries, ",").alias("patch"))


@query("cdc_validate", """SELECT user_id AS invoice_id, 'validated' AS status, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS validated_at, arg_max(event_id, (ts, event_id)) AS event_id
    FROM events WHERE event_type = 'purchase' GROUP BY user_id""")
def cdc_validate(spark, d):
    """Invoices with a validation event: validated since the last one, by its actor."""
    done = B.events(spark, d).filter(F.col("action") == "purchase")
    last = audit.current_state(done, "invoice_id", ["created_at", "id"], ["created_at", "id"])
    return last.select("invoice_id", F.lit("validated").alias("status"), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("validated_at"), F.col("id").alias("event_id"))


def log(spark, d):
    return B.events(spark, d).select("id", "invoice_id", "action", F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"), F.col("payload").alias("after"))


@query("cdc_event_append", B.with_ctes(B.EVENTS, body="""SELECT id, invoice_id, action, lag(payload) OVER (PARTITION BY invoice_id ORDER BY created_at, id) AS before, payload AS after FROM ev"""))
def cdc_event_append(spark, d):
    """Audit rows: the record after the change and the one before it."""
    return audit.with_before(log(spark, d), "after").select("id", "invoice_id", "action", "before", "after")


@query("cdc_current_state", """SELECT user_id AS invoice_id, arg_max(event_type, (ts, event_id)) AS action, arg_max(props, (ts, event_id)) AS after FROM events GROUP BY user_id""")
def cdc_current_state(spark, d):
    return audit.current_state(log(spark, d), "invoice_id", ["at", "id"], ["action", "after"])


@query("cdc_supplier_upsert", """SELECT user_id AS name, arg_max('T' || event_id, event_id) FILTER (event_id % 3 = 0) AS tax_id, arg_max(event_type, event_id) FILTER (event_type <> 'view') AS address,
    arg_max('71' || event_id, event_id) FILTER (event_id % 50 = 0) AS phone FROM events GROUP BY user_id""")
def cdc_supplier_upsert(spark, d):
    """One row per supplier; blanks never overwrite a known value."""
    key = F.col("event_id")
    rows = B.table(spark, d, "events").select(
        F.col("user_id").alias("name"), "event_id", F.when(key % 3 == 0, F.concat(F.lit("T"), key.cast("string"))).otherwise("").alias("tax_id"),
        F.when(F.col("event_type") != "view", F.col("event_type")).otherwise("  ").alias("address"), F.when(key % 50 == 0, F.concat(F.lit("71"), key.cast("string"))).alias("phone"),
    )
    return audit.last_non_empty(rows, "name", F.col("event_id"), ["tax_id", "address", "phone"])


@query("cdc_items_replace", """SELECT l_orderkey AS invoice_id, l_linenumber AS line, l_partkey AS part_id, CAST(round(l_extendedprice * 100) AS BIGINT) AS total_cents FROM lineitem l
    WHERE CAST(l_shipdate AS DATE) = (SELECT max(CAST(m.l_shipdate AS DATE)) FROM lineitem m WHERE m.l_orderkey = l.l_orderkey)""")
def cdc_items_replace(spark, d):
    """Items of the latest version only; the ship date stands for the version."""
    rows = B.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("invoice_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part_id"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("total_cents"), F.col("l_shipdate").cast("date").alias("version"),
    )
    return audit.latest_version(rows, "invoice_id", "version").drop("version")


@query("cdc_backfill_columns", B.with_ctes(B.INVOICES, body="""SELECT id, invoice_number AS number, CASE WHEN id % 8 <> 0 THEN CAST(cents AS DOUBLE) / 100 END AS total FROM invoices WHERE id % 3 = 0 OR id % 4 = 0"""))
def cdc_backfill_columns(spark, d):
    """Stored rows that lack number or total, recomputed from their record; some records lack the total too."""
    key = F.col("id")
    payload = F.to_json(F.struct("invoice_number", F.when(key % 8 != 0, (F.col("cents") / 100).cast("decimal(18,2)").cast("string")).alias("total_amount")))
    rows = B.invoices(spark, d).select(
        "id", payload.alias("payload"), F.when(key % 3 == 0, " ").otherwise(F.col("invoice_number")).alias("number"),
        F.when(key % 4 != 0, (F.col("cents") / 100).cast("decimal(20,6)")).alias("total"),
    )
    return payloads.backfill(rows).select("id", "number", F.col("total").cast("double").alias("total"))
