"""Projections, filters and predicates on the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from billquarry.functions import display, geometry
from billquarry.functions import money as M
from billquarry.functions import text as X
from billquarry.operators import search, views
from billquarry.plans import bindings as B
from billquarry.plans.registry import query
from billquarry.sources import payloads


def invoice_search_sql(status: str, **needles: str) -> str:
    """Every search looks into its columns; all have to find something."""
    parts = ["(" + " OR ".join(f"contains(lower({c}), '{n.lower()}')" for c in search.SEARCHED[name]) + ")" for name, n in needles.items()]
    return B.with_ctes(B.INVOICES, body=f"SELECT id, invoice_number, supplier_name, status FROM invoices WHERE {' AND '.join(parts)} AND status = '{status}'")


DIRECT = {"search": "12", "supplier": "customer#00000", "company": "BUILD", "tax_id": "A/m/0"}
INDEXED = {"search": "0012", "supplier": "customer#00000", "company": "\"BUILD", "tax_id": "a/M/00"}


@query("flt_invoice_search", invoice_search_sql("validated", **DIRECT))
def flt_invoice_search(spark, d):
    return search.search_invoices(B.invoices(spark, d), status="validated", **DIRECT).select("id", "invoice_number", "supplier_name", "status")


@query("flt_invoice_search_index", invoice_search_sql("validated", **INDEXED))
def flt_invoice_search_index(spark, d):
    """A search through stored trigrams of all six columns."""
    index = search.text_index(B.invoices(spark, d), "id", search.SEARCHED["search"])
    return search.search_indexed(index, status="validated", **INDEXED).select("id", "invoice_number", "supplier_name", "status")


@query(
    "flt_dataset_search",
    """SELECT d.doc_id, d.lang AS split, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
       WHERE contains(lower(d.lang), 'and') OR contains(lower(d.source), 'and') OR contains(lower(d.text), 'and')""",
)
def flt_dataset_search(spark, d):
    joined = B.documents(spark, d).join(B.table(spark, d, "labels"), "doc_id", "left")
    found = search.where_given(joined, search.text_filter(["lang", "source", "text"], "And"))
    return found.select("doc_id", F.col("lang").alias("split"), "quality")


@query(
    "flt_supplier_text",
    B.with_ctes(B.SUPPLIERS, body="""SELECT id, name FROM suppliers
       WHERE contains(lower(concat_ws(' ', name, tax_id, address, phone)), '12a/m')"""),
)
def flt_supplier_text(spark, d):
    joined = B.suppliers(spark, d).withColumn("_all", F.concat_ws(" ", "name", "tax_id", "address", "phone"))
    return joined.filter(search.contains_text(["_all"], " 12A/M")).select("id", "name")


@query(
    "flt_by_parent_optional",
    B.with_ctes(B.EVENTS, body="""SELECT 'one' AS scope, id, invoice_id, action FROM ev WHERE invoice_id = 42
       UNION ALL SELECT 'all', id, invoice_id, action FROM ev"""),
)
def flt_by_parent_optional(spark, d):
    ev = B.events(spark, d).select("id", "invoice_id", "action")
    one = search.by_parent(ev, "invoice_id", 42).withColumn("scope", F.lit("one"))
    return one.unionByName(search.by_parent(ev, "invoice_id").withColumn("scope", F.lit("all")))


@query(
    "get_by_id",
    B.with_ctes(B.INVOICES, body="""SELECT 'invoice' AS kind, CAST(id AS VARCHAR) AS id, supplier_name AS name FROM invoices WHERE id = 77
       UNION ALL SELECT 'document', CAST(doc_id AS VARCHAR), source FROM documents WHERE doc_id = 77
       UNION ALL (SELECT 'image', source, lang FROM documents WHERE source = (SELECT min(source) FROM documents) ORDER BY lang LIMIT 1)"""),
)
def get_by_id(spark, d):
    docs = B.documents(spark, d)
    one = B.invoices(spark, d).filter("id = 77").select(F.lit("invoice").alias("kind"), F.col("id").cast("string").alias("id"), F.col("supplier_name").alias("name"))
    doc = docs.filter("doc_id = 77").select(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("id"), F.col("source").alias("name"))
    wanted = docs.agg(F.min("source")).scalar()
    image = docs.filter(F.col("source") == wanted).orderBy("lang").limit(1).select(F.lit("image").alias("kind"), F.col("source").alias("id"), F.col("lang").alias("name"))
    return one.unionByName(doc).unionByName(image)


@query(
    "prj_structured_fields",
    B.with_ctes(B.INVOICES, body="""SELECT id, invoice_number,
         CASE WHEN id % 3 = 2 THEN 'Inconnu' ELSE supplier_name END AS supplier_name,
         CASE WHEN id % 2 = 0 THEN 'T' || id ELSE 'V' || id END AS tax_id, customer_name,
         strftime(invoice_date, '%d/%m/%Y') AS invoice_date,
         CASE WHEN id % 4 = 0 THEN 'TND' ELSE currency END AS currency,
         CASE WHEN id % 7 <> 0 THEN CAST(cents AS DOUBLE) / 100 END AS total_amount FROM invoices"""),
)
def prj_structured_fields(spark, d):
    """Normalised records: blank, missing and renamed keys by number."""
    key, day = F.col("id"), F.date_format("invoice_date", "dd/MM/yyyy")
    payload = F.to_json(
        F.struct(
            F.concat(F.lit(" "), F.col("invoice_number")).alias("invoice_number"),
            F.when(key % 3 == 0, F.col("supplier_name")).when(key % 3 == 1, "  ").alias("vendor_name"),
            F.when(key % 3 == 1, F.col("supplier_name")).alias("supplier_name"),
            F.when(key % 2 == 0, F.concat(F.lit("T"), key.cast("string"))).alias("tax_id"),
            F.concat(F.lit("V"), key.cast("string")).alias("vendor_tax_id"),
            F.col("customer_name"),
            F.when(key % 2 == 0, day).alias("date"),
            day.alias("invoice_date"),
            F.when(key % 4 == 0, "").otherwise(F.col("currency")).alias("currency"),
            F.when(key % 7 != 0, F.translate((F.col("cents") / 100).cast("decimal(18,2)").cast("string"), ".", ",")).alias("total_amount"),
        )
    )
    out = B.invoices(spark, d).select("id", payload.alias("payload")).select("id", *payloads.structured_fields(F.col("payload")))
    return out.withColumn("total_amount", M.optional_number(F.col("total_text")).cast("double")).drop("total_text")


@query(
    "prj_candidate_precedence",
    B.with_ctes(B.INVOICES, body="""SELECT id AS doc_id, 'vendor_name' AS field,
         CASE WHEN id % 5 = 0 THEN 'hosted ' || supplier_name WHEN id % 5 = 1 THEN NULL WHEN id % 5 = 2 THEN 'rule ' || supplier_name
              ELSE 'model ' || supplier_name END AS value,
         CASE id % 5 WHEN 0 THEN 'hosted' WHEN 1 THEN 'local' WHEN 2 THEN 'rule' ELSE 'model' END AS source FROM invoices
       UNION ALL SELECT id, 'total_amount', CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 = 1 THEN CAST(cents AS VARCHAR)
              WHEN id % 5 = 2 THEN CAST(cents + 1 AS VARCHAR) ELSE CAST(cents + 2 AS VARCHAR) END,
         CASE id % 5 WHEN 0 THEN 'hosted' WHEN 1 THEN 'local' WHEN 2 THEN 'rule' ELSE 'model' END FROM invoices"""),
)
def prj_candidate_precedence(spark, d):
    """Candidates of four sources; by number the hosted model answered, the local one abstained, or rules only."""
    key, name, cents = F.col("id"), F.col("supplier_name"), F.col("cents")
    case = key % 5

    def row(field, source, value, present=F.lit(True)):
        return F.when(present, F.struct(F.lit(field).alias("field"), F.lit(source).alias("source"), value.cast("string").alias("value")))

    rows = F.array_compact(F.array(
        row("vendor_name", "hosted", F.concat(F.lit("hosted "), name), case == 0),
        row("vendor_name", "local", F.lit(None), case == 1),
        row("vendor_name", "rule", F.when(case == 2, F.concat(F.lit("rule "), name)).otherwise(F.lit(" "))),
        row("vendor_name", "model", F.concat(F.lit("model "), name)),
        row("total_amount", "hosted", F.lit(None), case == 0),
        row("total_amount", "local", cents, case == 1),
        row("total_amount", "rule", F.when(case == 2, cents + 1).otherwise(F.lit(0))),
        row("total_amount", "model", cents + 2),
    ))
    candidates = B.invoices(spark, d).select(key.alias("doc_id"), (case == 0).alias("hosted_mode"), F.inline(rows))
    return views.candidate_precedence(candidates)


WORDS_SQL = """w AS (
  SELECT conv_id, turn, string_split(CASE turn % 3
      WHEN 0 THEN 'Invoice Number: INV' || conv_id || ' of ' || role || ' Date 01/02/2020 Seller: Atlas Trading House Buyer Borne Ltd Tunis Total tbd ' || (conv_id * 10 + turn) || ',500 EUR. ' || text
      WHEN 1 THEN 'Supplier Nord Textile Sfax total ' || conv_id || '.25 x ' || text ELSE text END, ' ') AS words
  FROM conversations)"""


def word_lists(spark, d):
    """Words of annotated images: conversation texts, two in three opened by an invoice heading."""
    conv, turn = F.col("conv_id").cast("string"), F.col("turn")
    text = (
        F.when(turn % 3 == 0, F.concat(
            F.lit("Invoice Number: INV"), conv, F.lit(" of "), F.col("role"),
            F.lit(" Date 01/02/2020 Seller: Atlas Trading House Buyer Borne Ltd Tunis Total tbd "),
            (F.col("conv_id") * 10 + turn).cast("string"), F.lit(",500 EUR. "), F.col("text")))
        .when(turn % 3 == 1, F.concat(F.lit("Supplier Nord Textile Sfax total "), conv, F.lit(".25 x "), F.col("text")))
        .otherwise(F.col("text"))
    )
    return B.table(spark, d, "conversations").select("conv_id", "turn", F.split(text, " ").alias("words"))


WORDS_FOUND = """c AS (SELECT conv_id, turn, words, list_filter(list_transform(words, lambda x: trim(x)), lambda x: x <> '') AS cw FROM w),
 pos AS (SELECT *,
   list_filter(list_transform(range(1, len(cw)), lambda i: CASE WHEN list_contains(['invoice','facture','#','n°','numéro','number'], trim(lower(cw[i]), ':#')) THEN i END), lambda i: i IS NOT NULL)[1] AS pn,
   list_filter(list_transform(range(1, len(cw)), lambda i: CASE WHEN trim(lower(cw[i]), ':#') = 'date' THEN i END), lambda i: i IS NOT NULL)[1] AS pd,
   list_filter(list_transform(range(1, len(cw)), lambda i: CASE WHEN list_contains(['buyer','client','customer'], trim(lower(cw[i]), ':#')) THEN i END), lambda i: i IS NOT NULL)[1] AS pc,
   list_filter(list_transform(range(1, len(cw) + 1), lambda i: CASE WHEN list_contains(['seller','supplier','fournisseur','vendor'], lower(cw[i])) THEN i END), lambda i: i IS NOT NULL)[1] AS ps,
   list_filter(list_transform(range(1, len(cw) + 1), lambda i: CASE WHEN list_contains(['total','balance_due','ttc'], lower(cw[i])) THEN i END), lambda i: i IS NOT NULL)[1] AS pt
   FROM c),
 found AS (SELECT conv_id, turn, words,
   coalesce(trim(array_to_string(cw[pn + 1:pn + 3], ' '), ' :#'), '') AS found_number,
   coalesce(trim(array_to_string(cw[pd + 1:pd + 3], ' '), ' :#'), '') AS found_date,
   coalesce(trim(array_to_string(cw[pc + 1:pc + 3], ' '), ' :#'), '') AS found_customer,
   trim(array_to_string(cw[coalesce(ps + 1, 1):coalesce(ps + 3, 3)], ' '), ' :') AS found_supplier,
   coalesce(list_filter(list_transform(cw[pt + 1:pt + 4], lambda x: TRY_CAST(regexp_replace(replace(x, ',', '.'), '[^0-9.\\-]', '', 'g') AS DECIMAL(20,6))), lambda x: x IS NOT NULL)[1], 0) AS found_total,
   coalesce(list_filter(list_transform(words, lambda x: trim(upper(x), '.,:;')), lambda x: list_contains(['TND','EUR','USD','GBP'], x))[1], 'TND') AS found_currency
   FROM pos)"""


@query(
    "fn_words_label_lookup",
    B.with_ctes(WORDS_SQL, WORDS_FOUND, body="""SELECT conv_id, turn, found_number, found_date, found_customer, found_supplier,
       CAST(found_total AS DOUBLE) AS found_total, found_currency FROM found"""),
)
def fn_words_label_lookup(spark, d):
    return views.word_lookups(word_lists(spark, d)).drop("words").withColumn("found_total", F.col("found_total").cast("double"))


@query(
    "prj_catalog_record",
    B.with_ctes(WORDS_SQL, WORDS_FOUND, body="""SELECT 'dataset:c' || conv_id || '_' || turn || '.jpg' AS id, 'c' || conv_id || '_' || turn || '.jpg' AS filename,
       'dataset' AS status, coalesce(nullif(found_number, ''), 'a' || conv_id || '.json') AS invoice_number,
       coalesce(nullif(found_supplier, ''), 'Facture dataset') AS supplier_name, found_customer AS customer_name, found_date AS invoice_date,
       CAST(found_total AS DOUBLE) AS total_amount, found_currency AS currency, left(array_to_string(words, ' '), 500) AS text_preview FROM found"""),
)
def prj_catalog_record(spark, d):
    conv = F.col("conv_id").cast("string")
    named = word_lists(spark, d).select(
        "words",
        F.concat(F.lit("c"), conv, F.lit("_"), F.col("turn").cast("string"), F.lit(".jpg")).alias("image_name"),
        F.concat(F.lit("a"), conv, F.lit(".json")).alias("annotation_name"),
    )
    return views.catalog_record(named)


@query(
    "prj_review_view",
    B.with_ctes(B.INVOICES, body="""SELECT id, CASE WHEN id % 3 = 2 THEN 'Fournisseur à confirmer' ELSE supplier_name END AS supplier, invoice_number AS number,
       strftime(invoice_date, '%Y-%m-%d') AS date, CASE WHEN id % 2 = 0 THEN currency ELSE 'TND' END AS currency,
       CAST(cents AS DOUBLE) / 100 AS total, 1 + CASE WHEN id % 4 = 0 THEN 0 ELSE 1 END AS lines FROM invoices"""),
)
def prj_review_view(spark, d):
    """Flat record by field aliases and kept line count; a line without description, total or price is dropped."""
    key = F.col("id")
    items = F.array(
        F.struct(F.col("supplier_name").alias("designation"), F.lit(None).cast("string").alias("total")),
        F.struct(F.lit(" ").alias("designation"), F.when(key % 4 != 0, F.col("cents").cast("string")).alias("total")),
    )
    payload = F.to_json(F.struct(
        F.when(key % 3 == 0, F.col("supplier_name")).alias("vendor_name"), F.when(key % 3 == 1, F.col("supplier_name")).alias("raison_sociale"),
        F.col("invoice_number").alias("num_facture"), F.date_format("invoice_date", "yyyy-MM-dd").alias("date_facture"),
        F.when(key % 2 == 0, F.col("currency")).alias("devise"), (F.col("cents") / 100).cast("decimal(18,2)").cast("string").alias("montant_ttc"),
        items.alias("items"),
    ))
    top = F.from_json("payload", "map<string,string>")

    def value(*aliases):
        return F.coalesce(*[X.non_empty(F.col("top")[a]) for a in aliases])

    lines = F.filter(
        F.from_json(F.col("top")["items"], "array<map<string,string>>"),
        lambda m: F.coalesce(X.non_empty(m["description"]), X.non_empty(m["designation"]), X.non_empty(m["total"]), X.non_empty(m["unit_price"])).isNotNull(),
    )
    from billquarry.vocabulary import REVIEW_ALIASES as A

    return B.invoices(spark, d).select("id", payload.alias("payload")).select("id", top.alias("top")).select(
        "id",
        F.coalesce(value(*A["supplier"]), F.lit("Fournisseur à confirmer")).alias("supplier"),
        F.coalesce(value(*A["number"]), F.lit("Numéro non renseigné")).alias("number"),
        F.coalesce(value(*A["date"]), F.lit("Date non renseignée")).alias("date"),
        F.coalesce(value(*A["currency"]), F.lit("TND")).alias("currency"),
        M.optional_number(value(*A["total"])).cast("double").alias("total"),
        F.size(lines).alias("lines"),
    )


@query(
    "prj_text_source_choice",
    """WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text WHEN doc_id % 3 = 1 THEN source ELSE '' END AS native,
                  CASE WHEN doc_id % 2 = 0 THEN lower(text) ELSE ' ' END AS scanned, CAST(doc_id % 100 AS DOUBLE) / 100 AS conf FROM documents),
       e AS (SELECT *, length(regexp_replace(native, '[^\\p{L}\\p{N}]', '', 'g')) >= 80 AS enough FROM t)
       SELECT doc_id, length(CASE WHEN enough THEN native WHEN trim(scanned) <> '' THEN scanned ELSE native END) AS chars,
              CASE WHEN enough THEN 0.95 WHEN trim(scanned) <> '' THEN conf WHEN trim(native) <> '' THEN 0.3 ELSE 0.0 END AS confidence FROM e""",
)
def prj_text_source_choice(spark, d):
    key = F.col("doc_id")
    native = F.when(key % 3 == 0, F.col("text")).when(key % 3 == 1, F.col("source")).otherwise("")
    scanned = F.when(key % 2 == 0, F.lower("text")).otherwise(" ")
    text, confidence = views.chosen_text(native, scanned, (key % 100).cast("double") / 100)
    return B.documents(spark, d).select("doc_id", F.length(text).alias("chars"), confidence.alias("confidence"))


@query(
    "prj_row_text",
    B.with_ctes(B.ITEMS, body="""SELECT invoice_id, line, part_id, total_cents, trim(description) || ' | ' || coalesce(CASE WHEN quantity % 3 <> 0 THEN CAST(quantity AS VARCHAR) END, '') || ' | ' || total_cents AS row_text FROM items"""),
)
def prj_row_text(spark, d):
    cells = F.array(
        F.concat(F.lit(" "), F.col("description")), F.when(F.col("quantity") % 3 != 0, F.col("quantity").cast("string")), F.col("total_cents").cast("string")
    )
    return B.items(spark, d).select("invoice_id", "line", "part_id", "total_cents", views.row_text(cells).alias("row_text"))


STATUS_SQL = """CASE WHEN contains(s, 'dataset') THEN 'Dataset' WHEN contains(s, 'valid') THEN 'Validée'
  WHEN contains(s, 'reject') OR contains(s, 'rejet') THEN 'Rejetée'
  WHEN contains(s, 'classified') OR contains(s, 'review') OR contains(s, 'draft') THEN 'En attente de validation' ELSE 'En cours d''analyse' END"""


@query(
    "prj_status_label",
    f"""WITH t AS (SELECT o_orderkey AS id, lower(CASE o_orderkey % 6 WHEN 0 THEN 'Validated' WHEN 1 THEN 'updated_draft' WHEN 2 THEN 'rejeté'
          WHEN 3 THEN 'dataset_valid' WHEN 4 THEN o_orderstatus ELSE 'needs_REVIEW' END) AS s FROM orders) SELECT id, {STATUS_SQL} AS label FROM t""",
)
def prj_status_label(spark, d):
    key = F.col("o_orderkey")
    status = (
        F.when(key % 6 == 0, "Validated").when(key % 6 == 1, "updated_draft").when(key % 6 == 2, "rejeté")
        .when(key % 6 == 3, "dataset_valid").when(key % 6 == 4, F.col("o_orderstatus")).otherwise("needs_REVIEW")
    )
    return B.table(spark, d, "orders").select(key.alias("id"), display.status_label(status).alias("label"))


@query(
    "prj_classification_label",
    """WITH t AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS flag,
          CASE WHEN o_orderkey % 3 = 0 THEN 'Facture PDF' ELSE 'autre' END AS kind, o_orderkey % 5 <> 0 AS signals,
          CASE WHEN o_orderkey % 7 < 3 THEN 0 ELSE o_totalprice END AS total, CAST(o_orderkey % 100 AS DOUBLE) / 100 AS conf FROM orders)
       SELECT id, CASE WHEN coalesce(flag, contains(lower(kind), 'facture') OR (signals AND total > 0)) THEN 'Facture'
                       WHEN conf < 0.7 AND signals THEN 'Incertain' ELSE 'Non-facture' END AS label FROM t""",
)
def prj_classification_label(spark, d):
    key = F.col("o_orderkey")
    label = display.classification_label(
        F.when(key % 4 == 0, True).when(key % 4 == 1, False),
        F.when(key % 3 == 0, "Facture PDF").otherwise("autre"),
        key % 5 != 0,
        F.when(key % 7 < 3, 0.0).otherwise(F.col("o_totalprice")),
        (key % 100).cast("double") / 100,
    )
    return B.table(spark, d, "orders").select(key.alias("id"), label.alias("label"))


EVIDENCE = """parts AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS part FROM documents),
 evidence AS (SELECT doc_id, CASE n % 2 WHEN 0 THEN 'date' ELSE 'total' END AS field, 1000000 - n AS rank, CASE WHEN n % 3 = 0 THEN part END AS preview, CASE WHEN n % 3 = 1 THEN part ELSE '' END AS text,
   CASE WHEN doc_id % 3 = 0 THEN CAST((doc_id + n) % 100 AS DOUBLE) / 100 WHEN doc_id % 3 = 1 AND n % 2 = 0 THEN CAST((doc_id + n) % 100 AS DOUBLE) END AS confidence,
   CASE WHEN doc_id % 3 = 1 THEN CAST((doc_id + n) % 20 AS DOUBLE) / 2 END AS score FROM parts),
 best AS (SELECT doc_id, field, arg_min({'preview': preview, 'text': text, 'confidence': confidence, 'score': score}, rank) AS e FROM evidence GROUP BY 1, 2),
 fields AS (SELECT doc_id, field, text AS document, CASE WHEN doc_id % 11 = 0 THEN '' ELSE source END AS value FROM documents, (SELECT unnest(['date', 'total', 'name']) AS field))"""


@query(
    "prj_evidence_view",
    B.with_ctes(EVIDENCE, body="""SELECT f.doc_id, f.field, trim(left(coalesce(nullif(e.preview, ''), nullif(e.text, ''), document, ''), 500)) AS preview,
         CASE WHEN value = '' THEN 0 WHEN e.confidence IS NOT NULL THEN CAST(floor(CASE WHEN e.confidence <= 1 THEN e.confidence * 100 ELSE e.confidence END + 0.5) AS BIGINT)
              WHEN e.score IS NOT NULL THEN least(99, greatest(55, CAST(floor(e.score * 10 + 0.5) AS BIGINT))) ELSE 86 END AS confidence
       FROM fields f LEFT JOIN best b ON f.doc_id = b.doc_id AND f.field = b.field"""),
)
def prj_evidence_view(spark, d):
    """Three fields of every document with the best of their evidence rows, which are the lines of the text, last ones first."""
    docs, key, n = B.documents(spark, d), F.col("doc_id"), F.col("n")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "part")).withColumn("n", F.col("at") + 1)
    number = (key + n) % 100
    evidence = lines.select(
        "doc_id", F.when(n % 2 == 0, "date").otherwise("total").alias("field"), (F.lit(1000000) - n).alias("rank"),
        F.when(n % 3 == 0, F.col("part")).alias("preview"), F.when(n % 3 == 1, F.col("part")).otherwise("").alias("text"),
        F.when(key % 3 == 0, number.cast("double") / 100).when((key % 3 == 1) & (n % 2 == 0), number.cast("double")).alias("confidence"),
        F.when(key % 3 == 1, ((key + n) % 20).cast("double") / 2).alias("score"),
    )
    fields = docs.select(
        "doc_id", F.explode(F.array(F.lit("date"), F.lit("total"), F.lit("name"))).alias("field"),
        F.when(key % 11 == 0, "").otherwise(F.col("source")).alias("value"), F.col("text").alias("document"),
    )
    return views.with_best_evidence(fields, evidence, 86).select("doc_id", "field", "preview", "confidence")


BOX_SQL = "CAST(event_id % 10 AS DOUBLE) * 50 - 20 AS x1, CAST(event_id % 7 AS DOUBLE) * 60 AS y1, CAST(event_id % 10 AS DOUBLE) * 50 + 130 AS x2, CAST(event_id % 7 AS DOUBLE) * 60 + 101.5 AS y2"


def boxes(spark, d):
    key = F.col("event_id")
    return B.table(spark, d, "events").select(
        key.alias("id"), ((key % 10).cast("double") * 50 - 20).alias("x1"), ((key % 7).cast("double") * 60).alias("y1"),
        ((key % 10).cast("double") * 50 + 130).alias("x2"), ((key % 7).cast("double") * 60 + 101.5).alias("y2"),
    )


@query(
    "prj_box_normalise",
    f"""WITH b AS (SELECT event_id AS id, {BOX_SQL} FROM events)
       SELECT id, round(greatest(0.0, least(1.0, x1 / 512)), 6) AS nx1, round(greatest(0.0, least(1.0, y1 / 400)), 6) AS ny1,
         round(greatest(0.0, least(1.0, x2 / 512)), 6) AS nx2, round(greatest(0.0, least(1.0, y2 / 400)), 6) AS ny2,
         round(greatest(0.0, x2 - x1), 2) AS box_width, round(greatest(0.0, y2 - y1), 2) AS box_height,
         round(x1 + (x2 - x1) / 2, 2) AS center_x, round(y1 + (y2 - y1) / 2, 2) AS center_y FROM b""",
)
def prj_box_normalise(spark, d):
    c = F.col
    return boxes(spark, d).select("id", *geometry.normalised_box(c("x1"), c("y1"), c("x2"), c("y2"), F.lit(512), F.lit(400)))


@query(
    "prj_valid_box",
    f"""WITH b AS (SELECT event_id AS id, {BOX_SQL} FROM events), n AS (SELECT id, x1 / 512 AS x, y1 / 400 AS y, (x2 - x1) / 512 AS w, CASE WHEN id % 11 <> 0 THEN (y2 - y1) / 400 END AS h FROM b)
       SELECT id, coalesce(x >= 0 AND y >= 0 AND w > 0 AND h > 0 AND x + w <= 1.001 AND y + h <= 1.001, false) AS valid FROM n""",
)
def prj_valid_box(spark, d):
    x, y = F.col("x1") / 512, F.col("y1") / 400
    w, h = (F.col("x2") - F.col("x1")) / 512, F.when(F.col("id") % 11 != 0, (F.col("y2") - F.col("y1")) / 400)
    return boxes(spark, d).select("id", geometry.valid_box(x, y, w, h).alias("valid"))


@query(
    "prj_detection_class",
    """SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'logo' WHEN 1 THEN 'stamp' WHEN 2 THEN 'signature' END AS class_name,
         CASE WHEN event_id % 5 = 0 THEN CAST(event_id * 37 % 100 AS DOUBLE) / 100 WHEN event_id % 5 = 1 THEN CAST(greatest(event_id * 37 % 100, 2) AS DOUBLE) / 100 ELSE 1.0 END AS score FROM events""",
)
def prj_detection_class(spark, d):
    """Class names in several spellings; scores as fractions, percentages or out of range."""
    key = F.col("event_id")
    name = F.when(key % 4 == 0, "Company_Logo").when(key % 4 == 1, F.when(key % 8 == 1, "Cachet rond").otherwise("STAMP")).when(key % 4 == 2, "signature-1").otherwise(F.col("event_type"))
    pct = (key * 37 % 100).cast("double")
    score = F.when(key % 5 == 0, pct / 100).when(key % 5 == 1, F.greatest(pct, F.lit(2.0))).otherwise(250.0)
    return B.table(spark, d, "events").select(key.alias("id"), display.detection_class(name).alias("class_name"), display.detection_score(score).alias("score"))


@query(
    "prj_prefer_reading",
    """WITH t AS (SELECT doc_id, CAST(doc_id % 100 AS DOUBLE) / 100 AS ls, CAST(doc_id * 7 % 100 AS DOUBLE) / 100 AS os,
          repeat('فاتورة ', CAST(doc_id % 40 AS INTEGER)) || text AS other FROM documents),
       s AS (SELECT *, length(regexp_replace(other, '[^\\p{L}]', '', 'g')) AS letters, CAST(doc_id % 40 AS BIGINT) * 6 AS arabic FROM t)
       SELECT doc_id, CAST(arabic AS DOUBLE) / greatest(letters, 1) >= 0.5 AND os >= 0.6 AND (ls < 0.8 OR os > ls + 0.05) AS prefer FROM s""",
)
def prj_prefer_reading(spark, d):
    key = F.col("doc_id")
    other = F.concat(F.repeat(F.lit("فاتورة "), (key % 40).cast("int")), F.col("text"))
    return B.documents(spark, d).select(
        "doc_id", display.prefer_second_script((key % 100).cast("double") / 100, other, (key * 7 % 100).cast("double") / 100).alias("prefer")
    )


@query(
    "flt_quality_gates",
    """SELECT doc_id, CASE WHEN length(trim(t)) < 80 THEN 'text_too_short' WHEN doc_id % 100 < 45 THEN 'low_ocr_confidence' END AS flag
       FROM (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN source ELSE text END AS t FROM documents)""",
)
def flt_quality_gates(spark, d):
    key = F.col("doc_id")
    text = F.when(key % 6 == 0, F.col("source")).otherwise(F.col("text"))
    return B.documents(spark, d).select("doc_id", views.quality_flag(text, (key % 100).cast("double") / 100).alias("flag"))


@query(
    "prj_missing_required",
    B.with_ctes(B.INVOICES, body="""SELECT id, concat_ws(',', CASE WHEN id % 2 = 0 THEN 'invoice_number' END, CASE WHEN due_date IS NULL THEN 'date' END,
       CASE WHEN id % 3 = 0 THEN 'vendor_name' END, CASE WHEN id % 5 = 0 THEN 'total_amount' END, CASE WHEN currency = 'USD' THEN 'currency' END) AS missing FROM invoices"""),
)
def prj_missing_required(spark, d):
    key = F.col("id")
    missing = views.missing_required(
        F.when(key % 2 != 0, F.col("invoice_number")), F.date_format("due_date", "dd/MM/yyyy"), F.when(key % 3 == 0, "  ").otherwise(F.col("supplier_name")),
        F.when(key % 5 != 0, F.col("cents")).otherwise(0), F.when(F.col("currency") != "USD", F.col("currency")),
    )
    return B.invoices(spark, d).select("id", F.array_join(missing, ",").alias("missing"))
