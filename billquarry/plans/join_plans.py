"""Joins and window computations on the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from billquarry.functions import text as X
from billquarry.operators import lines as L
from billquarry.operators import matching, passages, rollups, totals
from billquarry.plans import bindings as B
from billquarry.plans import rendering as R
from billquarry.plans.registry import query
from billquarry.plans.rollup_plans import AVG_CENTS, detections, ocr_lines
from billquarry.storage import written


@query("join_split_annotation", "SELECT d.doc_id, d.lang AS split, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def join_split_annotation(spark, d):
    return B.documents(spark, d).select("doc_id", F.col("lang").alias("split")).join(B.table(spark, d, "labels"), "doc_id", "left")


# text without outer blanks; one window of 900 characters, then one more every 780
CHUNKS = r"""stripped AS (SELECT doc_id, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS n FROM documents),
 counted AS (SELECT doc_id, n, CASE WHEN n = 0 THEN 0 WHEN n <= 900 THEN 1 ELSE (n - 900 + 779) // 780 + 1 END AS chunks FROM stripped)"""


@query("join_doc_chunks", B.with_ctes(CHUNKS, body="SELECT doc_id, CAST(chunks AS BIGINT) AS chunks FROM counted"))
def join_doc_chunks(spark, d):
    docs = B.documents(spark, d)
    counted = passages.chunks(docs.select("doc_id", "text")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return docs.select("doc_id").join(counted, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("chunks"))


@query(
    "join_supplier_last_invoice",
    B.with_ctes(B.INVOICES, B.SUPPLIERS, f"""agg AS (SELECT supplier_id, count(*) AS n, CAST(sum(cents) AS DOUBLE) / 100 AS total, {AVG_CENTS} AS average FROM invoices GROUP BY 1)""",
        """newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY supplier_id ORDER BY coalesce(invoice_date, created_date) DESC, id DESC) AS r FROM invoices) WHERE r = 1)""",
        body="""SELECT s.id, s.name, coalesce(n, 0) AS invoices_count, coalesce(total, 0.0) AS total_amount, coalesce(invoice_number, '') AS last_invoice_number,
           coalesce(strftime(invoice_date, '%Y-%m-%d'), '') AS last_invoice_date, coalesce(status, '') AS last_invoice_status, coalesce(average, 0.0) AS average_amount
           FROM suppliers s LEFT JOIN agg ON s.id = agg.supplier_id LEFT JOIN newest ON s.id = newest.supplier_id"""),
)
def join_supplier_last_invoice(spark, d):
    return rollups.supplier_directory(B.suppliers(spark, d), B.invoices(spark, d))


@query("join_supplier_key", B.with_ctes(B.INVOICES, B.SUPPLIERS, body="SELECT i.id AS invoice_id, s.id AS supplier_id FROM invoices i LEFT JOIN suppliers s ON s.name = i.supplier_name"))
def join_supplier_key(spark, d):
    named = B.suppliers(spark, d).select(F.col("id").alias("key"), "name")
    inv = B.invoices(spark, d).select(F.col("id").alias("invoice_id"), "supplier_name")
    return inv.join(named, F.col("supplier_name") == F.col("name"), "left").select("invoice_id", F.col("key").alias("supplier_id"))


DUPLICATES = """inv AS (SELECT id, created_date AS day, CASE WHEN id % 15 = 14 THEN id - 1 ELSE id END AS number, lower(supplier_name) AS supplier, cents FROM invoices),
 pairs AS (SELECT a.id, a.day, b.id AS candidate_id, b.day AS bday, a.number = b.number AS n, a.supplier = b.supplier AND a.cents = b.cents AS s FROM inv a JOIN inv b ON a.number = b.number AND (b.day, b.id) < (a.day, a.id)
   UNION SELECT a.id, a.day, b.id, b.day, a.number = b.number, a.supplier = b.supplier AND a.cents = b.cents FROM inv a JOIN inv b ON a.cents = b.cents AND (a.cents > 0 OR a.supplier = b.supplier) AND (b.day, b.id) < (a.day, a.id)),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY bday DESC, candidate_id DESC) AS position FROM pairs)"""


def duplicate_input(spark, d):
    """Invoices whose number is shared by one in fifteen."""
    key = F.col("id")
    return B.invoices(spark, d).select(
        "id", F.col("created_date").alias("day"), F.when(key % 15 == 14, key - 1).otherwise(key).cast("string").alias("number"),
        F.col("supplier_name").alias("supplier"), (F.col("cents") * 10).alias("milli"),
    )


@query(
    "join_duplicate_candidates",
    B.with_ctes(B.INVOICES, DUPLICATES, body="""SELECT id, position, candidate_id, CASE WHEN n THEN 'same_invoice_number' WHEN s THEN 'same_supplier_and_total' ELSE 'same_total' END AS match_reason
       FROM ranked WHERE position <= 5"""),
)
def join_duplicate_candidates(spark, d):
    return matching.duplicate_candidates(duplicate_input(spark, d))


@query(
    "join_layout_overlap",
    """WITH b(block, lx, ly, lw, lh, label) AS (VALUES (0, 0, 0, 1000, 200, 'header'), (1, 0, 100, 450, 300, 'table'), (2, 50, 120, 400, 200, 'text'), (3, 380, 0, 620, 1000, 'footer')),
       l AS (SELECT l_orderkey AS doc_id, l_linenumber AS line, l_partkey AS part_id, CAST(round(l_extendedprice * 100) AS BIGINT) AS total_cents, l_linenumber % 5 * 100 AS x, l_linenumber * 50 AS y FROM lineitem),
       c AS (SELECT l.*, block, label, CAST(greatest(0, least(x + 200, lx + lw) - greatest(x, lx)) * greatest(0, least(y + 30, ly + lh) - greatest(y, ly)) AS DOUBLE) / 6000 AS overlap, lw * lh AS area FROM l, b)
       SELECT l.doc_id, l.line, l.part_id, l.total_cents, k.block, k.label FROM l LEFT JOIN
         (SELECT line, arg_max(block, (overlap, -area, block)) AS block, arg_max(label, (overlap, -area, block)) AS label FROM (SELECT DISTINCT line, block, label, overlap, area FROM c) WHERE overlap >= 0.65 GROUP BY line) k
       ON l.line = k.line""",
)
def join_layout_overlap(spark, d):
    """Line boxes of orders against four layout blocks on every page."""
    lines = ocr_lines(spark, d)
    shapes = F.array(*[
        F.struct(F.lit(i).alias("block"), *[F.lit(v).cast("long").alias(n) for n, v in zip(("bx", "by", "bw", "bh"), box)], F.lit(label).alias("label"))
        for i, (box, label) in enumerate([((0, 0, 1000, 200), "header"), ((0, 100, 450, 300), "table"), ((50, 120, 400, 200), "text"), ((380, 0, 620, 1000), "footer")])
    ])
    blocks = B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id")).distinct().select("doc_id", F.inline(shapes))
    return matching.attach_layout(lines, blocks, ["doc_id"]).select("doc_id", "line", "part_id", "total_cents", "block", "label")


@query(
    "join_value_to_passage",
    R.sheets_sql("""SELECT doc_id, 'vendor_name' AS field, vendor AS value, 'p0' AS passage_id, 1 AS rank FROM sheets UNION ALL SELECT doc_id, 'customer_name', customer, 'p1', 2 FROM sheets"""),
)
def join_value_to_passage(spark, d):
    """Proposed party names looked up in the invoice's passages in page order; the first supporting passage wins.

    The vendor stands on line 4, in the first passage of six lines, the customer on line 8, in the second one.
    """
    docs = R.texts(spark, d)
    proposals = docs.select("doc_id", F.inline(F.array(
        F.struct(F.lit("vendor_name").alias("field"), F.col("vendor").alias("value")), F.struct(F.lit("customer_name").alias("field"), F.col("customer").alias("value"))))).withColumn("sought", X.canonical(F.col("value")))
    found = passages.line_passages(docs.select("doc_id", "text")).select(
        "doc_id", (F.col("chunk_index") + 1).alias("rank"), F.concat(F.lit("p"), F.col("chunk_index")).alias("passage_id"), X.canonical(F.col("text")).alias("has")
    )
    supports = F.col("has").contains(F.col("sought"))
    return matching.first_supporting_passage(proposals, found, ["doc_id"], supports, "field").select("doc_id", "field", "value", "passage_id", "rank")


@query("join_citation_catalog", "SELECT doc_id, chunk_index, accepted FROM (SELECT doc_id, unnest(range(0, chunks)) AS chunk_index FROM (SELECT doc_id, CASE WHEN n = 0 THEN 0 WHEN n <= 900 THEN 1 ELSE (n - 900 + 779) // 780 + 1 END AS chunks FROM (SELECT doc_id, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS n FROM documents))), LATERAL (SELECT (doc_id + chunk_index) % 3 <> 0 AS accepted)")
def join_citation_catalog(spark, d):
    """Every third retrieved passage was altered or re-numbered; only identical ones are accepted."""
    catalogue = passages.chunks(B.documents(spark, d).select("doc_id", "text")).withColumn("source_id", F.concat(F.lit("c"), F.col("chunk_index").cast("string")))
    altered = (F.col("doc_id") + F.col("chunk_index")) % 3 == 0
    retrieved = catalogue.withColumn("text", F.when(altered & (F.col("doc_id") % 2 == 0), F.concat("text", F.lit("."))).otherwise(F.col("text"))).withColumn(
        "source_id", F.when(altered & (F.col("doc_id") % 2 == 1), F.lit("c-1")).otherwise(F.col("source_id"))
    )
    return matching.accepted_citations(retrieved, catalogue, ["doc_id", "source_id"]).select("doc_id", "chunk_index", "accepted")


@query(
    "join_unique_location",
    R.sheets_sql("""SELECT doc_id, 'invoice_number' AS field, 2 AS line_id FROM sheets UNION ALL SELECT doc_id, 'vendor_tax_id', 6 FROM sheets UNION ALL SELECT doc_id, 'customer_name', 8 FROM sheets"""),
)
def join_unique_location(spark, d):
    """Field values to the one cell that shows them; an address shown in several cells stays unlocated."""
    docs = R.texts(spark, d)
    fields = docs.select("doc_id", F.inline(F.array(
        F.struct(F.lit("invoice_number").alias("field"), F.concat(F.lit("FACTURE N "), F.col("invoice_number")).alias("value")),
        F.struct(F.lit("vendor_tax_id").alias("field"), F.col("vendor_tax").alias("value")),
        F.struct(F.lit("customer_name").alias("field"), F.concat(F.lit("Client "), F.col("customer")).alias("value")),
        F.struct(F.lit("unit").alias("field"), F.lit("mf").alias("value")),
    ))).withColumn("key", X.compact(F.col("value")))
    cells = docs.select("doc_id", F.posexplode(X.split_lines(F.col("text"))).alias("pos", "cell")).withColumn(
        "named", F.regexp_replace("cell", X.IU + r"^\s*(?:MF|Tél|Adresse)\s*:\s*", "")
    )
    # whether a cell has a name in front of its key is told where the cell is; only its key is shuffled
    keyed = cells.select("doc_id", (F.col("pos") + 1).alias("line_id"), "cell", "named", X.compact(F.col("named")).alias("key")).select(
        "doc_id", "line_id", "key", F.when(F.col("named") == F.col("cell"), True).otherwise(X.compact(F.col("cell")) == F.col("key")).alias("exact")
    )
    exact = fields.join(keyed, ["doc_id", "key"]).select("doc_id", "field", "line_id", "exact")
    return matching.unique_only(exact, ["doc_id", "field"])


@query(
    "join_item_discount",
    """SELECT l_orderkey AS doc_id, l_linenumber AS line, CASE WHEN min(l_discount) > 0 THEN CAST(CAST(round(min(l_discount) * 100) AS BIGINT) AS DOUBLE) END AS discount
       FROM lineitem GROUP BY 1, 2 HAVING count(*) = 1""",
)
def join_item_discount(spark, d):
    """Discount cells joined to item rows by the quoted line; rows quoting the same line twice get none."""
    base = B.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line"), F.concat(F.lit("ligne "), F.col("l_linenumber").cast("string")).alias("row_text"),
        F.round(F.col("l_discount") * 100).cast("long").alias("pct"),
    )
    keys = ["doc_id", "row_text"]
    one_row = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("line")).filter("n = 1")
    entries = base.filter("pct > 0").groupBy(*keys).agg(F.count(F.lit(1)).alias("m"), F.min("pct").alias("pct")).filter("m = 1")
    return one_row.join(entries, keys, "left").select("doc_id", "line", F.col("pct").cast("double").alias("discount"))


@query(
    "join_tax_support",
    R.sheets_sql("""SELECT doc_id, 'TVA' AS label, order_id % 5 <> 2 AND CASE order_id % 7 WHEN 0 THEN order_id % 3 <> 0 WHEN 1 THEN false ELSE true END AS supported FROM sheets WHERE order_id % 4 <> 3"""),
)
def join_tax_support(spark, d):
    """Proposed VAT rows against the printed ones; for some the amount is off by one, some give a base that is printed,
    not printed or another."""
    key = F.col("order_id")
    docs = R.texts(spark, d).withColumn("text", F.when(key % 3 != 0, F.concat("text", F.lit("\nBase HT : "), R.milli_text(F.col("ht")))).otherwise(F.col("text")))
    printed = docs.select("doc_id", F.inline(totals.tax_rows(F.col("text"))))
    docs = docs.filter(key % 4 != 3)
    dec = lambda milli: (milli / 1000).cast("decimal(20,6)")
    proposed = docs.select(
        "doc_id", F.lit(19).cast("decimal(20,6)").alias("rate"), dec(F.col("tva") + F.when(key % 5 == 2, 1000).otherwise(0)).alias("amount"),
        F.when(key % 7 == 0, dec(F.col("ht"))).when(key % 7 == 1, dec(F.col("ht") + 1)).alias("base"),
    )
    out = totals.supported_tax(proposed, printed, docs.select("doc_id", totals.printed_base(F.col("text")).alias("printed_base")))
    return out.select("doc_id", F.lit("TVA").alias("label"), "supported")


NMS = """boxes AS (SELECT event_id // 10 AS doc_id, ['logo', 'stamp', 'signature'][event_id % 3 + 1] AS class_name, event_id AS id, CAST(event_id * 37 % 100 AS DOUBLE) / 100 AS score,
   CAST(event_id % 10 AS DOUBLE) / 20 AS x1, CAST(event_id % 7 AS DOUBLE) / 20 AS y1, CAST(event_id % 10 AS DOUBLE) / 20 + CAST(0.3 AS DOUBLE) AS x2, CAST(event_id % 7 AS DOUBLE) / 20 + CAST(0.2 AS DOUBLE) AS y2 FROM events),
 ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, class_name ORDER BY score DESC, id) AS n, {'id': id, 'score': score, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2} AS box FROM boxes),
 greedy AS (SELECT doc_id, class_name, n, [box] AS kept FROM ordered WHERE n = 1
   UNION ALL SELECT g.doc_id, g.class_name, o.n, CASE WHEN len(list_filter(kept, lambda k:
       greatest(0, least(k.x2, o.x2) - greatest(k.x1, o.x1)) * greatest(0, least(k.y2, o.y2) - greatest(k.y1, o.y1))
       / ((k.x2 - k.x1) * (k.y2 - k.y1) + (o.x2 - o.x1) * (o.y2 - o.y1) - greatest(0, least(k.x2, o.x2) - greatest(k.x1, o.x1)) * greatest(0, least(k.y2, o.y2) - greatest(k.y1, o.y1))) >= 0.5)) > 0
     THEN kept ELSE list_append(kept, o.box) END FROM greedy g JOIN ordered o ON o.doc_id = g.doc_id AND o.class_name = g.class_name AND o.n = g.n + 1)"""


@query("join_box_nms", "WITH RECURSIVE " + NMS + """
    SELECT doc_id, class_name, b.id AS id, b.score AS score FROM (SELECT doc_id, class_name, unnest(arg_max(kept, n)) AS b FROM greedy GROUP BY 1, 2)""")
def join_box_nms(spark, d):
    boxes = detections(spark, d).select(
        "doc_id", F.col("class_name"), "id", (F.col("confidence_pct") / 100).alias("score"), "x1", "y1", (F.col("x1") + 0.3).alias("x2"), (F.col("y1") + 0.2).alias("y2")
    )
    return matching.non_overlapping(boxes, ["doc_id", "class_name"])


# --- windows -----------------------------------------------------------------

PAGED = """paged AS (SELECT doc_id, '--- Page 1 ---' || chr(10) || text || chr(10) || ' --- page 3 --- ' || chr(10) || chr(10) || source AS text FROM documents),
 raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_id FROM paged),
 marked AS (SELECT *, CASE WHEN regexp_full_match(line, '\\s*---\\s*[Pp]age\\s+\\d+\\s*---\\s*') THEN line_id END AS m FROM raw),
 st AS (SELECT *, max(m) OVER (PARTITION BY doc_id ORDER BY line_id) AS mark, count(m) OVER (PARTITION BY doc_id ORDER BY line_id) AS k FROM marked)"""


@query(
    "win_line_numbers",
    B.with_ctes(PAGED, body=r"""SELECT doc_id, CAST(line_id AS INTEGER) AS line_id, CASE WHEN k = 1 THEN 1 ELSE 3 END AS page, CAST(line_id - mark AS INTEGER) AS local, regexp_replace(line, '^\s+|\s+$', '', 'g') AS text
       FROM st WHERE m IS NULL AND trim(line) <> ''"""),
)
def win_line_numbers(spark, d):
    """Documents with two page markers around their text."""
    paged = B.documents(spark, d).select("doc_id", F.concat(F.lit("--- Page 1 ---\n"), F.col("text"), F.lit("\n --- page 3 --- \n\n"), F.col("source")).alias("text"))
    return L.numbered_lines(paged)


@query("win_table_scope", R.sheets_sql("""SELECT doc_id, line_id, line_id > 10 AND line_id <= 11 + n AS in_table FROM (SELECT doc_id, n, unnest(range(1, 16 + n + CASE WHEN order_id % 4 <> 3 THEN 1 ELSE 0 END + CASE WHEN order_id % 5 = 0 THEN 1 ELSE 0 END)) AS line_id FROM sheets)"""))
def win_table_scope(spark, d):
    return L.table_scope(R.texts(spark, d).select("doc_id", "text"))


@query("win_event_transitions", B.with_ctes(B.EVENTS, body="""SELECT id, invoice_id, action, lag(action) OVER w AS previous, lead(action) OVER w AS next,
    CAST(epoch_us(created_at) // 1000000 - epoch_us(lag(created_at) OVER w) // 1000000 AS BIGINT) AS seconds_since FROM ev WINDOW w AS (PARTITION BY invoice_id ORDER BY created_at, id)"""))
def win_event_transitions(spark, d):
    """Previous and next action per invoice; groups above the block limit are looked up in blocks."""
    ev = B.events(spark, d).select("id", "invoice_id", "action", F.unix_seconds(F.col("created_at").cast("timestamp")).alias("at"))
    from billquarry.operators.audit import neighbours

    return neighbours(ev).select("id", "invoice_id", "action", "previous", "next", "seconds_since")


@query("win_best_reading", """WITH r AS (SELECT doc_id, 1 AS reading, text AS t, doc_id % 100 AS pct FROM documents UNION ALL SELECT doc_id, 2, source || text, (doc_id * 7 + 3) % 100 FROM documents UNION ALL SELECT doc_id, 3, source, 99 FROM documents),
    s AS (SELECT *, length(regexp_replace(t, '[^\\p{L}\\p{N}]', '', 'g')) * greatest(pct, 5) AS score FROM r)
    SELECT doc_id, arg_max(reading, (score, -reading)) AS reading, max(score) AS score FROM s GROUP BY doc_id""")
def win_best_reading(spark, d):
    """Of three readings of a document the one with most useful characters times confidence."""
    docs, key = B.documents(spark, d), F.col("doc_id")
    readings = docs.select("doc_id", F.inline(F.array(
        F.struct(F.lit(1).alias("reading"), F.col("text").alias("t"), (key % 100).alias("pct")),
        F.struct(F.lit(2).alias("reading"), F.concat("source", "text").alias("t"), ((key * 7 + 3) % 100).alias("pct")),
        F.struct(F.lit(3).alias("reading"), F.col("source").alias("t"), F.lit(99).cast("long").alias("pct")),
    )))
    score = F.length(F.regexp_replace("t", r"[^\p{L}\p{N}]", "")) * F.greatest("pct", F.lit(5))
    scored = readings.select("doc_id", "reading", score.alias("score"))
    return scored.groupBy("doc_id").agg(F.max_by("reading", F.struct("score", -F.col("reading"))).alias("reading"), F.max("score").alias("score"))


@query("txt_split_pages", r"""SELECT doc_id, p.page, length(p.t) AS chars FROM (SELECT doc_id, unnest(CASE WHEN doc_id % 2 = 0 THEN
    [{'page': 1, 't': regexp_replace(text, '^\s+|\s+$', '', 'g')}, {'page': 12, 't': regexp_replace(source, '^\s+|\s+$', '', 'g')}] ELSE [{'page': NULL, 't': regexp_replace(text, '^\s+|\s+$', '', 'g')}] END) AS p FROM documents)""")
def txt_split_pages(spark, d):
    marked = F.concat(F.lit("lost --- PAGE 1 ---\n"), F.col("text"), F.lit("\n---Page 12---"), F.col("source"), F.lit("\n--- Page 13 ---  \n"))
    docs = B.documents(spark, d).select("doc_id", F.when(F.col("doc_id") % 2 == 0, marked).otherwise(F.col("text")).alias("text"))
    return docs.select("doc_id", F.inline(passages.pages_of(F.col("text")))).select("doc_id", "page", F.length("text").alias("chars"))


CHUNK_ROWS = r"""stripped AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents),
 chunks AS (SELECT doc_id, k AS chunk_index, regexp_replace(substr(t, k * 780 + 1, 900), '^\s+|\s+$', '', 'g') AS text
   FROM (SELECT doc_id, t, unnest(range(0, CASE WHEN length(t) = 0 THEN 0 WHEN length(t) <= 900 THEN 1 ELSE (length(t) - 900 + 779) // 780 + 1 END)) AS k FROM stripped))"""


@query("txt_chunk", B.with_ctes(CHUNK_ROWS, body="SELECT doc_id, chunk_index, CAST(NULL AS INTEGER) AS page, text FROM chunks"))
def txt_chunk(spark, d):
    return passages.chunks(B.documents(spark, d).select("doc_id", "text"))


@query("txt_passages_lines")
def txt_passages_lines(spark, d):
    return passages.line_passages(R.texts(spark, d).select("doc_id", "text"))


@query("txt_passages_sections")
def txt_passages_sections(spark, d):
    """Sections inside layout blocks: lines get boxes by their place on the page and the block that covers them."""
    numbered = L.numbered_lines(R.texts(spark, d).select("doc_id", "text"))
    boxed = numbered.select("*", F.lit(50).alias("x"), (F.col("local") * 30).alias("y"), F.lit(800).alias("w"), F.lit(20).alias("h"))
    shapes = F.array(*[
        F.struct(F.lit(name).alias("block"), F.lit(0).alias("bx"), F.lit(top).alias("by"), F.lit(1000).alias("bw"), F.lit(height).alias("bh"), F.lit(label).alias("label"))
        for name, top, height, label in (("b0", 0, 110, "header"), ("b1", 110, 200, "text"), ("b2", 310, 100_000, "table"))
    ])
    pages = written(numbered.select("doc_id", "page").distinct(), "numbered-pages")  # read twice
    blocks = pages.select("doc_id", "page", F.inline(shapes))
    return passages.section_passages(matching.attach_layout(boxed, blocks, ["doc_id", "page"]))
