"""Sources and sinks on the shared tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from billquarry.functions import money as M
from billquarry.plans import bindings as B
from billquarry.plans.registry import query
from billquarry.session import shared_dir
from billquarry.sources import annotations, blobs, files, payloads, records


@query(
    "src_file_listing",
    B.with_ctes(
        B.LISTING,
        body="""
  , named AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS base FROM listing),
  ext AS (SELECT *, lower(regexp_extract(base, '^.+(\\.[^.]+)$', 1)) AS extension FROM named)
  SELECT path, CASE WHEN extension IN ('.jpg','.jpeg','.png') THEN 'image' WHEN extension = '.json' THEN 'annotation'
                    WHEN extension = '.csv' THEN 'split_csv' WHEN extension = '.txt' THEN 'metadata' ELSE 'other' END AS kind,
         extension, size AS size_bytes,
         CASE WHEN extension = '' THEN base ELSE left(base, length(base) - length(extension)) END || '.jpg' AS image_name,
         nullif(regexp_extract(path, '(?:^|/)Annotations/([^/]*)', 1), '') AS annotation_format
  FROM ext""",
    ),
)
def src_file_listing(spark, d):
    return files.describe_files(B.file_listing(spark, d))


@query(
    "src_split_csv",
    """SELECT lang AS split, 'img' || doc_id || '.jpg' AS image_name, 'ann' || doc_id || '.json' AS annotation_name,
              'dataset/images/img' || doc_id || '.jpg' AS image_path,
              'dataset/Annotations/Original_Format/ann' || doc_id || '.json' AS annotation_path
       FROM documents WHERE doc_id % 9 <> 0""",
)
def src_split_csv(spark, d):
    """CSV files of every split, with a byte-order mark before the header, blanks around names and no annotation on some;
    written once, then read by the CSV reader."""
    key = F.col("doc_id").cast("string")
    annotation = F.when(F.col("doc_id") % 9 == 0, "  ").otherwise(F.concat(F.lit("ann"), key, F.lit(".json ")))
    rows = B.documents(spark, d).select("lang", F.concat(F.lit(" img"), key, F.lit(".jpg")), annotation).toDF("split", "\ufeffimg_path", "annot_path")
    folder = f"{shared_dir(spark)}/splits-{uuid.uuid4().hex}"
    plain = {"header": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    rows.write.options(**plain).partitionBy("split").csv(folder)
    return annotations.read_split_folder(spark, folder)


@query(
    "src_annotation_json",
    """SELECT conv_id, turn,
         CASE WHEN turn % 4 = 3 THEN '' ELSE 'conv' || conv_id || '.jpg' END AS image_name,
         CASE WHEN turn % 4 = 3 THEN 0 ELSE CAST(len(string_split(text, ' ')) AS BIGINT) END AS words_count,
         CASE WHEN turn % 4 IN (3, 2) THEN 0 ELSE 1 END AS boxes_count,
         CASE WHEN turn % 4 = 3 THEN '' ELSE role || ',' || turn END AS tags
       FROM conversations""",
)
def src_annotation_json(spark, d):
    body = F.to_json(
        F.struct(
            F.concat(F.lit("conv"), F.col("conv_id").cast("string"), F.lit(".jpg")).alias("path"),
            F.split("text", " ").alias("words"),
            F.when(F.col("turn") % 4 != 2, F.array(F.array(*[F.lit(float(v)) for v in (0, 0, 1, 1)]))).alias("bboxes"),
            F.array(F.col("role"), F.col("turn").cast("string")).alias("ner_tags"),
        )
    )
    payload = F.when(F.col("turn") % 4 == 3, F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("]"))).otherwise(body)
    df = B.table(spark, d, "conversations").withColumn("payload", payload)
    return df.select("conv_id", "turn", *annotations.annotation_counts(F.col("payload")))


@query(
    "src_incremental_manifest",
    B.with_ctes(
        B.LISTING,
        body="SELECT path, size, mtime FROM listing WHERE file_id % 5 = 0 OR file_id % 3 = 0",
    ),
)
def src_incremental_manifest(spark, d):
    """Last import knew all but one path shape, and another size for every third file."""
    listing = B.file_listing(spark, d)
    manifest = listing.filter(F.col("file_id") % 5 != 0).withColumn(
        "size", F.col("size") + F.when(F.col("file_id") % 3 == 0, 1).otherwise(0)
    )
    return files.changed_files(listing.select("path", "size", "mtime"), manifest)


@query(
    "snk_keyed_overwrite",
    """SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value
       FROM events GROUP BY user_id""",
)
def snk_keyed_overwrite(spark, d):
    """Writes the keyed table to the shared folder and reads it back."""
    df = B.table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    path = f"{shared_dir(spark)}/keyed-{uuid.uuid4().hex}"
    annotations.write_keyed(df, path, ["user_id"], ["event_id"])
    return spark.read.schema(df.schema).parquet(path)


@query(
    "src_upload_admission",
    """WITH f AS (SELECT doc_id, 'in/' || source || '_' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.png'
                       WHEN 2 THEN '.exe' ELSE '' END AS path, n_chars * 500 AS size FROM documents)
       SELECT doc_id, path, size FROM f
       WHERE lower(regexp_extract(path, '([^.]*)$', 1)) IN ('png','jpg','jpeg','tiff','bmp','webp','pdf') AND size <= 10485760""",
)
def src_upload_admission(spark, d):
    key = F.col("doc_id")
    suffix = F.when(key % 4 == 0, ".PDF").when(key % 4 == 1, ".png").when(key % 4 == 2, ".exe").otherwise("")
    listing = B.documents(spark, d).select(
        "doc_id",
        F.concat(F.lit("in/"), F.col("source"), F.lit("_"), key.cast("string"), suffix).alias("path"),
        (F.col("n_chars") * 500).alias("size"),
    )
    return files.admitted(listing)


@query(
    "snk_content_dedup",
    """SELECT sha256(text) AS digest, CAST(octet_length(encode(min(text))) AS BIGINT) AS size, min(doc_id) AS first_id,
              count(*) AS copies, 'sha256:' || sha256(text) AS reference
       FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM benchmark) GROUP BY sha256(text)""",
)
def snk_content_dedup(spark, d):
    """Documents offered to a store that already holds the benchmark passages."""
    incoming = B.documents(spark, d).select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    stored = blobs.with_digest(B.table(spark, d, "benchmark"), "text")
    return blobs.new_contents(incoming, stored)


@query(
    "src_content_by_ref",
    """SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'invalid' WHEN doc_id % 4 = 2 THEN 'missing' ELSE 'found' END AS state,
              CASE WHEN doc_id % 4 IN (0, 3) THEN CAST(octet_length(encode(text)) AS BIGINT) END AS size
       FROM documents""",
)
def src_content_by_ref(spark, d):
    """References to document contents: one shape malformed, one pointing to nothing stored."""
    docs = blobs.with_digest(B.documents(spark, d), "text")
    key = F.col("doc_id")
    references = docs.select(
        "doc_id",
        F.when(key % 4 == 1, F.concat(F.lit("sha256:"), F.upper(F.concat(F.lit("a"), F.substring("digest", 2, 63)))))
        .when(key % 4 == 2, F.concat(F.lit("sha256:"), F.sha2(F.col("digest").cast("binary"), 256)))
        .otherwise(F.concat(F.lit("sha256:"), F.col("digest")))
        .alias("reference"),
    )
    store = docs.groupBy("digest").agg(F.max(F.octet_length("text").cast("long")).alias("size"))
    return blobs.resolve(references, store).select("doc_id", "state", "size")


@query(
    "src_json_payload",
    """SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k,
              event_type = 'error' AS empty FROM events""",
)
def src_json_payload(spark, d):
    """Event properties; those of errors are cut so that they no longer parse."""
    raw = F.when(F.col("event_type") == "error", F.substring("props", 1, 4)).otherwise(F.col("props"))
    parsed = payloads.json_object(raw, "k BIGINT")
    return B.table(spark, d, "events").select("event_id", parsed["k"].alias("k"), parsed["k"].isNull().alias("empty"))


@query(
    "src_alias_resolver",
    B.with_ctes(
        B.INVOICES,
        body="""SELECT id, invoice_number, strftime(invoice_date, '%d/%m/%Y') AS invoice_date,
                  CASE WHEN id % 2 = 0 THEN supplier_name END AS supplier_name,
                  CASE WHEN id % 3 = 1 THEN 'EUR' ELSE 'TND' END AS currency, CAST(cents AS DOUBLE) / 100 AS total
                FROM invoices""",
    ),
)
def src_alias_resolver(spark, d):
    """Records whose keys differ by source: top level, nested one level, blank before filled."""
    inv = B.invoices(spark, d)
    day = F.date_format("invoice_date", "dd/MM/yyyy")
    total = (F.col("cents") / 100).cast("decimal(18,2)").cast("string")
    flat = F.struct(
        F.lit("  ").alias("numero_facture"), F.col("invoice_number").alias("numero"), day.alias("date"), total.alias("total"),
        F.when(F.col("id") % 2 == 0, F.col("supplier_name")).alias("fournisseur"),
        F.when(F.col("id") % 3 == 1, "EUR").alias("devise"),
    )
    nested = F.struct(
        F.struct(F.col("invoice_number").alias("n_facture"), day.alias("date_emission")).alias("facture"),
        total.alias("montant_total"),
        F.when(F.col("id") % 2 == 0, F.col("supplier_name")).alias("organisation"),
        F.when(F.col("id") % 3 == 1, "EUR").alias("monnaie"),
    )
    payload = F.when(F.col("id") % 4 < 2, F.to_json(flat)).otherwise(F.to_json(nested))
    out = payloads.resolve_aliases(inv.withColumn("payload", payload), "payload", ["id"])
    return out.select(
        "id", "invoice_number", "invoice_date", "supplier_name", "currency",
        M.optional_number(F.col("total_amount")).cast("double").alias("total"),
    )


@query(
    "snk_document_record",
    B.with_ctes(
        B.INVOICES,
        body="""SELECT id AS doc_id, CASE WHEN id % 5 = 4 THEN 'other' ELSE 'invoice' END AS document_type, id % 5 <> 4 AS is_invoice,
                  CAST(confidence_pct AS DOUBLE) / 100 AS classification_confidence, invoice_number,
                  CAST(cents AS VARCHAR) AS total_cents, status FROM invoices""",
    ),
)
def snk_document_record(spark, d):
    inv = B.invoices(spark, d).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 5 == 4, "other").otherwise("invoice").alias("document_type"),
        (F.col("confidence_pct").cast("double") / 100).alias("classification_confidence"),
        "invoice_number",
        F.col("cents").cast("string").alias("total_amount"),
        "status",
    )
    path = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    records.append_records(records.document_record(inv), path)
    return spark.read.parquet(path).select(
        "doc_id", "document_type", "is_invoice", "classification_confidence",
        F.col("fields")["invoice_number"].alias("invoice_number"), F.col("fields")["total_amount"].alias("total_cents"), "status",
    )


@query(
    "snk_validated_export",
    B.with_ctes(
        B.INVOICES,
        B.ITEMS,
        body="""SELECT id, 'facture_' || invoice_number || '.json' AS file_name, count(invoice_id) AS lines,
                  coalesce(sum(quantity), 0)::BIGINT AS quantity, coalesce(sum(total_cents), 0)::BIGINT AS total_cents
                FROM invoices LEFT JOIN items ON id = invoice_id WHERE status = 'validated' GROUP BY id, invoice_number""",
    ),
)
def snk_validated_export(spark, d):
    """Writes the export to the shared folder and sums up what is read back."""
    path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    records.write_export(B.invoices(spark, d), B.items(spark, d), path)
    headers, lines = records.read_export(spark, path)
    sums = lines.groupBy("invoice_id").agg(F.count("*").alias("n"), F.sum("quantity").alias("q"), F.sum("total_cents").alias("c"))
    zero = F.lit(0).cast("long")
    return headers.join(sums, F.col("id") == F.col("invoice_id"), "left").select(
        "id", "file_name", F.coalesce("n", zero).alias("lines"), F.coalesce("q", zero).alias("quantity"), F.coalesce("c", zero).alias("total_cents")
    )
