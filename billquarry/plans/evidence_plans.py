"""Evidence, quality and reconciliation of rendered invoices."""

from __future__ import annotations

from pyspark.sql import functions as F

from billquarry.functions import dates, parties
from billquarry.functions import text as X
from billquarry.functions.money import AMOUNT, strict_amount
from billquarry.operators import fields as E
from billquarry.operators import grounding as G
from billquarry.operators import items as I
from billquarry.operators import reconcile as C
from billquarry.operators import totals
from billquarry.plans import bindings as B
from billquarry.plans import rendering as R
from billquarry.plans.registry import query
from billquarry.storage import written


def dec(milli_column):
    return (milli_column / 1000).cast(AMOUNT)


TITLES = ["FACTURE", "Devis", "Bon de livraison", "Note interne"]


def titled(spark, d):
    key = F.col("order_id") % 4
    title = F.element_at(F.array(*[F.lit(t) for t in TITLES]), (key + 1).cast("int"))
    return R.texts(spark, d, title=title)


@query("q_classify_text", R.sheets_sql("""SELECT doc_id, order_id % 4 = 0 AS is_invoice,
    CASE order_id % 4 WHEN 0 THEN 97 ELSE 68 END AS score_pct, order_id % 4 IN (1, 2) AS other_title FROM sheets"""))
def q_classify_text(spark, d):
    """Four titles over the same body; the closing line that names the invoice is left out."""
    docs = titled(spark, d).withColumn("text", F.regexp_replace("text", "Arrêtée la présente facture.*", ""))
    return G.classify(docs).select("doc_id", "is_invoice", "score_pct", "other_title")


@query("q_classify_layout", R.sheets_sql("""SELECT doc_id, order_id % 4 = 0 AS is_invoice, CASE order_id % 4 WHEN 0 THEN 97 WHEN 3 THEN 68 ELSE 15 END AS score_pct FROM sheets"""))
def q_classify_layout(spark, d):
    docs = titled(spark, d).withColumn("text", F.regexp_replace("text", "Arrêtée la présente facture.*", ""))
    blocks = F.array(F.struct(F.lit("table").alias("label"), F.lit(0.8).alias("score")), F.struct(F.lit("text").alias("label"), F.lit(0.9).alias("score")))
    out = G.classify_with_layout(G.classify(docs, keep=["text"]), F.col("text"), blocks)
    return out.select("doc_id", F.col("layout_invoice").alias("is_invoice"), F.col("layout_score").alias("score_pct"))


def proposals(spark, d, fallbacks=()):
    """Model output per invoice and field: right, raised by one, or missing, by order number.

    Fallback amounts are read by the rules in the document's own row, before its
    proposals become rows, so texts are never shuffled.
    """
    case = F.col("order_id") % 5
    shift = F.when(case == 0, 1000).otherwise(0)

    def row(name, value):
        read = F.translate(F.col("read_" + name).cast("decimal(18,3)").cast("string"), ".", ",") if name in fallbacks else F.lit(None).cast("string")
        return F.struct(F.lit(name).alias("field"), F.when(case != 2, value).alias("value"), read.alias("fallback"))

    def money(c):
        return R.milli_text(c + shift)

    docs = R.texts(spark, d).withColumn("low", X.sought(F.col("text"))).withColumn("marked", totals.label_lines(F.col("low"))).withColumn("seen", X.canonical(F.col("text")))
    for name in fallbacks:
        docs = docs.withColumn("read_" + name, totals.labelled_among(F.col("marked"), name))
    return docs.select(
        "doc_id", "order_id", "text", "seen", "low",
        F.inline(F.array(
            row("subtotal", money(F.col("ht"))), row("tax_amount", money(F.col("tva"))), row("stamp_duty", money(F.col("stamp"))), row("total_amount", money(F.col("ttc"))),
            row("date", F.col("day")), row("vendor_name", F.col("vendor")), row("customer_tax_id", F.col("customer_tax")),
            row("invoice_number", F.when(case == 0, F.lit("facture")).otherwise(F.col("invoice_number"))), row("currency", F.lit("TND")), row("tax_rate", F.lit("19%")),
        )),
    )


FIELDS = "(SELECT unnest(['subtotal','tax_amount','stamp_duty','total_amount','date','vendor_name','customer_tax_id','invoice_number','currency','tax_rate']) AS field)"
OK = """CASE WHEN order_id % 5 = 2 THEN false WHEN field = 'currency' THEN false WHEN field IN ('tax_amount', 'tax_rate') AND order_id % 4 = 3 THEN false
  WHEN order_id % 5 = 0 AND field IN ('subtotal', 'tax_amount', 'stamp_duty', 'total_amount', 'invoice_number') THEN false ELSE true END"""


@query("q_value_supported", R.sheets_sql(f"SELECT doc_id, field, {OK} AS supported FROM sheets, {FIELDS}"))
def q_value_supported(spark, d):
    rows = proposals(spark, d)
    return rows.select("doc_id", "field", G.value_supported(F.col("field"), F.col("value"), F.col("text"), F.col("seen"), F.col("low")).alias("supported"))


@query("q_money_in_source", R.sheets_sql("""SELECT doc_id, field, order_id % 5 NOT IN (0, 2) AND NOT (field = 'tax_amount' AND order_id % 4 = 3) AS supported
    FROM sheets, (SELECT unnest(['subtotal','tax_amount','stamp_duty','total_amount']) AS field)"""))
def q_money_in_source(spark, d):
    rows = proposals(spark, d).filter(F.col("field").isin("subtotal", "tax_amount", "stamp_duty", "total_amount"))
    return rows.select("doc_id", "field", totals.money_in_source(F.col("field"), strict_amount(F.col("value")), F.col("text")).alias("supported"))


@query("q_date_in_source", R.sheets_sql("SELECT doc_id, order_id % 3 <> 2 AS supported FROM sheets"))
def q_date_in_source(spark, d):
    """The printed date in another format, in its own, or a day that is not printed."""
    key = F.col("order_id") % 3
    iso = F.date_format(F.try_to_date("day", "dd/MM/yyyy"), "yyyy-MM-dd")
    value = F.when(key == 0, iso).when(key == 1, F.col("day")).otherwise(F.lit("01/01/1901"))
    return R.texts(spark, d).select("doc_id", dates.date_in_text(value, F.col("text")).alias("supported"))


@query("q_tax_id_complete", R.sheets_sql("SELECT doc_id, order_id % 3 = 0 AS complete FROM sheets"))
def q_tax_id_complete(spark, d):
    """The whole identifier, its root alone, or one that carries a label."""
    key = F.col("order_id") % 3
    value = F.when(key == 0, F.col("vendor_tax")).when(key == 1, F.substring_index("vendor_tax", "/", 1)).otherwise(F.concat(F.lit("MF : "), F.col("vendor_tax")))
    return R.texts(spark, d).select("doc_id", parties.tax_id_complete(value, F.col("text")).alias("complete"))


@query("q_identifier_whole", R.sheets_sql("SELECT doc_id, order_id % 3 = 0 AS whole FROM sheets"))
def q_identifier_whole(spark, d):
    key = F.col("order_id") % 3
    text = F.concat(F.lit("RC : B "), F.col("invoice_number"), F.when(key == 0, " ;").when(key == 1, "7").otherwise("-2021"), F.lit(" fin"))
    return R.sheets(spark, d).select("doc_id", parties.whole_identifier(F.concat(F.lit("B"), F.col("invoice_number")), text).alias("whole"))


@query("q_evidence_guard", R.sheets_sql(f"""SELECT doc_id, field, supported,
      CASE WHEN supported THEN 'ocr_text' WHEN field = 'currency' AND order_id % 5 <> 2 THEN 'workflow_default_tnd' END AS source
    FROM (SELECT doc_id, order_id, field, CASE WHEN order_id % 5 IN (0, 2) AND field IN ('subtotal', 'total_amount') THEN true ELSE {OK} END AS supported FROM sheets, {FIELDS})"""))
def q_evidence_guard(spark, d):
    """Refused totals are replaced by the amounts the rules read, when those are supported."""
    rows = proposals(spark, d, fallbacks=["subtotal", "total_amount"])
    return G.guarded(rows).select("doc_id", "field", "supported", "source")


@query("q_ambiguous_amount", R.sheets_sql("SELECT doc_id, CASE WHEN order_id % 3 = 0 THEN 2 END AS line_id FROM sheets"))
def q_ambiguous_amount(spark, d):
    """An orphan amount under the labelled one; the same amount again, or another label, is not ambiguous."""
    shown = R.milli_text(F.col("ht"))
    below = F.when(F.col("order_id") % 3 == 0, R.milli_text(F.col("ht") + 7)).when(F.col("order_id") % 3 == 1, shown).otherwise(F.concat(R.milli_text(F.col("ht") + 7), F.lit(" | Total TVA")))
    text = F.concat(F.lit("FACTURE\nTotal HT "), shown, F.lit("\n"), below)
    return R.sheets(spark, d).select("doc_id", totals.ambiguous_amount("subtotal", dec(F.col("ht")), text).alias("line_id"))


@query("q_party_conflicts", R.sheets_sql("""SELECT doc_id, field, reason FROM sheets JOIN (VALUES (1, 'vendor_name', 'heading_word'), (2, 'vendor_name', 'explicit_customer'),
    (3, 'vendor_tax_id', 'identifier_in_customer_zone'), (5, 'vendor_address', 'same_as_customer'), (5, 'vendor_phone', 'same_as_customer'), (5, 'vendor_email', 'same_as_customer')) AS c(k, field, reason) ON order_id % 7 = k"""))
def q_party_conflicts(spark, d):
    """Sound vendors, a heading word, the client itself, its contacts; the vendor's identifier in the client's block, whole
    or only as part of a longer one, which leaves all its places with the vendor."""
    case = F.col("order_id") % 7
    in_zone = F.when(case == 3, F.col("vendor_tax")).when(case == 4, F.concat("vendor_tax", F.lit("/9"))).otherwise(F.col("customer_tax"))
    text = F.concat("text", F.lit("\nNom du client : "), "customer", F.lit("\nMF : "), in_zone, F.lit("\nDésignation"))
    shared = case.isin(5, 6)
    docs = R.texts(spark, d).select(
        "doc_id", text.alias("text"),
        F.when(case == 1, "Facture").when(case == 2, F.col("customer")).otherwise(F.col("vendor")).alias("vendor_name"),
        F.when(case == 6, "ABSENT SARL").otherwise(F.col("customer")).alias("customer_name"),
        F.col("vendor_tax").alias("vendor_tax_id"), F.col("customer_tax").alias("customer_tax_id"),
        F.when(shared, "9, avenue de Sfax").otherwise("12 rue de Tunis").alias("vendor_address"), F.lit("9 Avenue de Sfax").alias("customer_address"),
        F.when(shared, "71 222 333").otherwise(F.col("vendor_phone")).alias("vendor_phone"), F.lit("71222333").alias("customer_phone"),
        F.when(shared, "a@b.tn").alias("vendor_email"), F.lit("A@B.TN").alias("customer_email"),
    )
    return G.party_conflicts(docs, E.cell_roles)


@query("q_party_role", R.sheets_sql("SELECT doc_id, 'vendor_tax_id' AS field, order_id % 2 = 0 AS supported FROM sheets UNION ALL SELECT doc_id, 'customer_tax_id', true FROM sheets"))
def q_party_role(spark, d):
    """Two party columns; every second proposal cites the vendor's value as it also stands in the client's column."""
    odd = F.col("order_id") % 2 == 1
    text = F.concat(F.lit("Fournisseur : A | Client : B\n"), F.col("vendor_tax"), F.lit(" | "), F.when(odd, F.concat(F.col("customer_tax"), F.lit(" "), F.col("vendor_tax"))).otherwise(F.col("customer_tax")))
    docs = R.sheets(spark, d).withColumn("text", text)
    cited = docs.select("doc_id", F.inline(F.array(
        F.struct(F.lit("vendor_tax_id").alias("field"), F.col("vendor_tax").alias("value"), F.lit(1).alias("line_start"), F.lit(2).alias("line_end")),
        F.struct(F.lit("customer_tax_id").alias("field"), F.col("customer_tax").alias("value"), F.lit(2).alias("line_start"), F.lit(2).alias("line_end")))))
    return G.role_supported(cited, E.cell_roles(docs.select("doc_id", "text"))).select("doc_id", "field", "supported")


NUMBERED = "numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line, part_id, source_id, total_cents, discount_pct, quantity, milli, unit_milli, description) - 1 AS pos FROM lines)"


def line_items(change=None):
    """Sheet lines as item structs; ``change`` maps (row, position) to altered values."""
    def build(r, i):
        base = {
            "description": r["description"], "quantity": r["quantity"].cast(AMOUNT), "unit_price": dec(r["unit_milli"]), "total": dec(r["milli"]),
            "source": F.concat_ws(" | ", r["description"], F.lit("U"), r["quantity"].cast("string"), R.milli_text(r["unit_milli"]), F.lit("19"), R.milli_text(r["milli"])),
        }
        base.update(change(r, i) if change else {})
        return F.struct(*[v.alias(k) for k, v in base.items()])

    return F.transform("lines", build)


@query("q_item_grounding", R.sheets_sql("""SELECT doc_id, pos, CASE part_id % 4 WHEN 1 THEN 'missing_source' WHEN 2 THEN 'description_not_in_source' WHEN 3 THEN 'number_not_in_source' END AS reason FROM numbered""", NUMBERED))
def q_item_grounding(spark, d):
    """Item proposals with a foreign citation, another description or a changed number, by part."""
    def change(r, i):
        kind = r["part_id"] % 4
        source = F.concat_ws(" | ", r["description"], F.lit("U"), r["quantity"].cast("string"), R.milli_text(r["unit_milli"]), F.lit("19"), R.milli_text(r["milli"]))
        return {
            "source": F.when(kind == 1, F.concat(source, F.lit(" x"))).otherwise(source),
            "description": F.when(kind == 2, F.concat(r["description"], F.lit(" neuf"))).otherwise(r["description"]),
            "total": F.when(kind == 3, dec(r["milli"] + 1)).otherwise(dec(r["milli"])),
        }

    # the text is made flat before its items become rows; items are exploded as they are made, since a filter for empty
    # arrays would make them a second time
    flat = R.texts(spark, d).select("doc_id", "lines", G.flat(F.col("text")).alias("flat"))
    rows = flat.select("doc_id", "flat", F.posexplode(line_items(change)).alias("pos", "item"))
    return rows.select("doc_id", "pos", G.item_grounding(F.col("item"), F.col("flat")).alias("reason"))


@query("q_visual_grounding", R.sheets_sql("""SELECT doc_id, field, order_id % 3 <> 1 AS kept, order_id % 3 = 2 AS review FROM sheets, (SELECT unnest(['vendor_name', 'total_amount']) AS field)"""))
def q_visual_grounding(spark, d):
    """A quote with the value, a quote without it, a quote that is not in the text."""
    key = F.col("order_id") % 3
    def rows(field, value, lead):
        quote = F.when(key == 0, F.concat(F.lit(lead), value)).when(key == 1, F.lit(lead)).otherwise(F.concat(F.lit("Vu : "), value, F.lit(" ici")))
        return F.struct(F.lit(field).alias("field"), value.alias("value"), quote.alias("quote"))

    docs = R.texts(spark, d).withColumn("seen", X.compact(F.col("text"))).select("doc_id", "seen", F.inline(F.array(rows("vendor_name", F.col("vendor"), "Fournisseur : "), rows("total_amount", R.milli_text(F.col("ttc")), "Total TTC "))))
    kept, review = G.visual_grounding(F.col("field"), F.col("value"), F.col("quote"), F.col("seen"))
    return docs.select("doc_id", "field", kept.alias("kept"), review.alias("review"))


LINE_REASONS = """SELECT doc_id, pos, CASE (part_id + pos) % 9 WHEN 0 THEN 'description_missing' WHEN 1 THEN 'ocr_table_artifact' WHEN 2 THEN 'table_header' WHEN 3 THEN 'metadata_or_address'
   WHEN 4 THEN 'not_proven_inside_article_table' WHEN 5 THEN 'missing_line_amount' WHEN 6 THEN 'negative_line_amount' WHEN 7 THEN 'line_math_mismatch'
   ELSE CASE WHEN row_number() OVER (PARTITION BY doc_id, (part_id + pos) % 9, description, milli, quantity, unit_milli ORDER BY pos) > 1 THEN 'duplicate_ocr_line' END END AS reason FROM numbered"""


def altered_items():
    def change(r, i):
        kind = (r["part_id"] + i) % 9
        none = F.lit(None).cast(AMOUNT)
        return {
            "description": F.when(kind == 0, "x1").when(kind == 1, F.concat(r["description"], F.lit(" |"))).when(kind == 2, F.concat(F.lit("Prix "), r["description"]))
            .when(kind == 3, F.concat(F.lit("Rue "), r["description"])).when(kind == 4, F.concat(F.lit("zzzz "), r["description"])).otherwise(r["description"]),
            "quantity": F.when(kind == 5, none).when(kind == 6, -r["quantity"].cast(AMOUNT)).otherwise(r["quantity"].cast(AMOUNT)),
            "unit_price": F.when(kind == 5, none).otherwise(dec(r["unit_milli"])),
            "total": F.when(kind == 7, dec(r["milli"] * 2 + 1000)).otherwise(dec(r["milli"])),
        }

    return line_items(change)


@query("q_line_filter", R.sheets_sql(LINE_REASONS, NUMBERED))
def q_line_filter(spark, d):
    """Every line with one defect in turn, or none."""
    # exploded as they are made: a filter for empty arrays would judge all lines a second time, in a join below
    verdicts = G.item_verdicts(altered_items(), I.table_section(F.col("text")), F.lit(None).cast(AMOUNT))
    return R.texts(spark, d).select("doc_id", F.posexplode(verdicts).alias("pos", "row")).select("doc_id", "pos", "row.reason")


@query("txt_candidate_pack", R.sheets_sql("""SELECT s.doc_id, 13 + CASE WHEN order_id % 4 <> 3 THEN 1 ELSE 0 END + CASE WHEN order_id % 4 <> 3 OR order_id % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN order_id % 3 <> 1 THEN 1 ELSE 0 END - 0 AS fields,
    least(30, CAST(f.kept AS BIGINT)) AS kept, least(30, CAST(f.lost AS BIGINT)) AS rejected, true AS table_detected
    FROM sheets s JOIN (SELECT doc_id, count(*) FILTER (reason IS NULL) AS kept, count(*) FILTER (reason IS NOT NULL) AS lost FROM (""" + LINE_REASONS + """) GROUP BY 1) f ON s.doc_id = f.doc_id""", NUMBERED))
def txt_candidate_pack(spark, d):
    """Non-empty fields, kept and rejected rows and the table flag of every document."""
    docs = R.texts(spark, d)
    judged = docs.withColumn("table", I.table_section(F.col("text"))).select(
        "doc_id", "text", G.item_verdicts(altered_items(), F.col("table"), F.lit(None).cast(AMOUNT)).alias("v"), (F.col("table") != "").alias("table_detected")
    )
    verdicts = judged.select("doc_id", "text", G.kept_items(F.col("v")).alias("kept"), G.rejected_items(F.col("v")).alias("rejected"), "table_detected")
    wide = E.wide_fields(verdicts, keep=["kept", "rejected", "table_detected"])
    pack = G.candidate_pack(docs, wide, None, [c for c in wide.columns if c not in verdicts.columns])
    return pack.select("doc_id", F.size("field_values").alias("fields"), F.size("kept").alias("kept"), F.size("rejected").alias("rejected"), "table_detected")


# --- reconciliation ----------------------------------------------------------


def extracted(spark, d):
    """Components read from the rendered text, as reconciliation input."""
    docs = R.texts(spark, d).withColumn("marked", totals.label_lines(X.sought(F.col("text")))).withColumn("rows", totals.tax_rows(F.col("text")))
    amount = {n: totals.labelled_among(F.col("marked"), n) for n in ("subtotal", "tax_amount", "stamp_duty", "total_amount")}
    none = F.lit(None).cast(AMOUNT)
    return docs.select(
        "doc_id", "order_id", "rows", F.col("text"),
        amount["total_amount"].alias("total"), amount["subtotal"].alias("subtotal"), amount["tax_amount"].alias("vat"), amount["stamp_duty"].alias("stamp"),
        none.alias("discount"), none.alias("extra"), none.alias("adjustment"),
        F.array().cast("array<string>").alias("unproven"), F.col("rows").alias("taxes"),
        F.lit("").alias("context"), F.lit(None).cast("string").alias("basis"), F.lit(None).cast("string").alias("discount_scope"),
        F.lit(False).alias("vat_complete"), F.lit(False).alias("tax_exempt"), F.lit(None).cast(f"array<{AMOUNT}>").alias("ttc_lines"), F.lit(False).alias("table_complete"),
        F.lit("TND").alias("currency"),
    ).drop("rows")


RECONCILED = """rec AS (SELECT doc_id, order_id, CASE order_id % 4 WHEN 1 THEN 1 WHEN 2 THEN 1000 ELSE 0 END - CASE WHEN order_id % 5 = 0 THEN ht - ht % 100 ELSE 0 END AS diff,
    3 + CASE WHEN order_id % 5 = 0 AND ht >= 100 THEN 1 ELSE 0 END AS terms FROM sheets),
  stat AS (SELECT doc_id, order_id, diff, CASE WHEN order_id % 4 = 3 THEN 'INSUFFICIENT_EVIDENCE' WHEN diff = 0 THEN 'VALID' WHEN abs(diff) * 2 <= terms + 1 THEN 'ROUNDING_DIFFERENCE' ELSE 'INVALID' END AS status FROM rec)"""


@query("q_reconcile_total", R.sheets_sql("SELECT doc_id, status, CASE WHEN order_id % 4 <> 3 THEN diff END AS diff_milli FROM stat", RECONCILED))
def q_reconcile_total(spark, d):
    """Printed total against HT, TVA, FODEC and stamp read from the text; one in four prints no TVA."""
    return C.reconcile(extracted(spark, d)).select("doc_id", "status", (F.col("difference") * 1000).cast("long").alias("diff_milli"))


@query("q_rounding_bound", B.with_ctes(B.INVOICES, body="""SELECT id, CAST(CASE WHEN id % 7 = 0 THEN 0 WHEN currency = 'TND' THEN (id % 6 + 1) * 5 ELSE (id % 6 + 1) * 50 END AS DOUBLE) / 10000 AS bound FROM invoices"""))
def q_rounding_bound(spark, d):
    code = F.when(F.col("id") % 7 == 0, "JPY").otherwise(F.lower("currency"))
    return B.invoices(spark, d).select("id", C.rounding_bound(code, F.col("id") % 6).cast("double").alias("bound"))


@query("q_reconcile_net", B.with_ctes(B.INVOICES, body="""SELECT id, CASE WHEN id % 5 = 0 OR id % 7 = 0 THEN 'INSUFFICIENT_EVIDENCE' WHEN id % 3 = 0 THEN 'VALID' WHEN id % 3 = 1 AND currency <> 'TND' THEN 'ROUNDING_DIFFERENCE' ELSE 'INVALID' END AS status FROM invoices"""))
def q_reconcile_net(spark, d):
    """Net payable after a deposit: exact, a cent off, two units off; without net amount or settlement undecided."""
    key, total = F.col("id"), (F.col("cents") / 100).cast(AMOUNT)
    off = (F.when(key % 3 == 0, 0).when(key % 3 == 1, 1).otherwise(200) / 100).cast(AMOUNT)
    rows = B.invoices(spark, d).select(
        "id", "currency", total.alias("total"), F.lit("-12.5").cast(AMOUNT).alias("settlement"),
        F.when(key % 7 != 0, (total - F.lit("12.5").cast(AMOUNT) + off).cast(AMOUNT)).alias("net"), (key % 5 != 0).alias("settlement_complete"),
    )
    return C.reconcile_net(rows).select("id", "status")


@query("q_discount_basis", R.sheets_sql("SELECT doc_id, CASE order_id % 3 WHEN 0 THEN 'net' WHEN 1 THEN 'gross' END AS basis FROM sheets"))
def q_discount_basis(spark, d):
    """The label on the line that prints the subtotal decides; labels on other lines do not."""
    shown, key = R.milli_text(F.col("ht")), F.col("order_id") % 3
    text = F.concat(F.lit("Brut 1,000\n"), F.when(key == 0, "Total Net H.T ").when(key == 1, "Montant brut ").otherwise("Total HT "), shown, F.lit("\nNet HT 2,000"))
    return R.sheets(spark, d).select("doc_id", C.discount_basis(text, dec(F.col("ht"))).alias("basis"))


@query("q_tax_conflicts", """SELECT l_orderkey AS doc_id, CAST(sum(round(l_tax * 100)) AS BIGINT) AS row_sum,
    CASE WHEN l_orderkey % 3 = 1 AND sum(round(l_tax * 100)) > 0 THEN 'conflicting_vat_aggregate_and_rows' WHEN l_orderkey % 3 = 2 THEN 'conflicting_vat_aggregate_and_rows' ELSE '' END AS conflict FROM lineitem GROUP BY l_orderkey""")
def q_tax_conflicts(spark, d):
    """VAT rows summed per order before they are compared with the aggregate, so no row list is collected."""
    rows = B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.round(F.col("l_tax") * 100).cast("long").alias("a"))
    sums = rows.groupBy("doc_id").agg(F.sum("a").alias("row_sum"))
    key = F.col("doc_id") % 3
    scalar = F.when(key == 0, F.col("row_sum")).when(key == 1, 0).otherwise(F.col("row_sum") + 1).cast(AMOUNT)
    none = F.array().cast(f"array<{AMOUNT}>")
    conflicts = C.tax_conflicts(
        scalar, F.array(F.col("row_sum").cast(AMOUNT)), F.lit(None).cast(AMOUNT), none, F.lit(None).cast(AMOUNT), none, key == 2
    )
    return sums.select("doc_id", "row_sum", F.array_join(conflicts, ",").alias("conflict"))


def issue_input(spark, d):
    """Fields, proofs and reconciliation of every rendered invoice, some withheld by order number."""
    rec = C.reconcile(extracted(spark, d)).select("doc_id", "order_id", "status", "total", "subtotal", "text")
    key, text = F.col("order_id"), F.col("text")
    date = E.dates.printed_date(text)
    return rec.select(
        "doc_id", "order_id", "status",
        F.when(key % 7 != 0, E.invoice_number(text)).alias("invoice_number"),
        F.when(key % 11 == 0, "demain").otherwise(date).alias("date"), E.vendor_name(text).alias("vendor_name"),
        F.col("total").alias("total_amount"), F.when(key % 13 != 0, F.col("subtotal")).alias("subtotal"),
        F.when(key % 6 == 0, "EUR").otherwise("TND").alias("currency"),
        F.create_map(*[v for f in ("invoice_number", "date", "vendor_name", "total_amount") for v in (F.lit(f), (key % 10 != 9) | F.lit(f != "vendor_name"))], F.lit("currency"), key % 6 == 0).alias("supported"),
        F.when(key % 17 == 0, F.array(F.lit("total_amount"))).otherwise(F.array().cast("array<string>")).alias("review"),
        (key % 6 != 0).alias("currency_default"), F.lit(True).alias("table_detected"), F.when(key % 19 == 0, 0).otherwise(3).alias("items"),
        F.lit(False).alias("ttc_items"), F.when(key % 23 == 0, "failed").otherwise("completed").alias("analysis"),
    )


ISSUES = """iss AS (
  SELECT doc_id, order_id, 'llm_extraction_incomplete' AS code, 'blocking' AS severity FROM stat WHERE order_id % 23 = 0
  UNION ALL SELECT doc_id, order_id, 'evidence_review_total_amount', 'blocking' FROM stat WHERE order_id % 17 = 0
  UNION ALL SELECT doc_id, order_id, 'missing_invoice_number', 'blocking' FROM stat WHERE order_id % 7 = 0
  UNION ALL SELECT doc_id, order_id, 'unproven_vendor_name', 'blocking' FROM stat WHERE order_id % 10 = 9
  UNION ALL SELECT doc_id, order_id, 'currency_workflow_default', 'warning' FROM stat WHERE order_id % 6 <> 0
  UNION ALL SELECT doc_id, order_id, 'currency_not_tnd', 'warning' FROM stat WHERE order_id % 6 = 0
  UNION ALL SELECT doc_id, order_id, 'invoice_date_format_uncertain', 'warning' FROM stat WHERE order_id % 11 = 0
  UNION ALL SELECT doc_id, order_id, 'missing_subtotal_for_total', 'blocking' FROM stat WHERE order_id % 13 = 0
  UNION ALL SELECT doc_id, order_id, 'no_verified_line_items', 'blocking' FROM stat WHERE order_id % 19 = 0
  UNION ALL SELECT doc_id, order_id, CASE status WHEN 'VALID' THEN 'invoice_total_valid' WHEN 'INVALID' THEN 'invoice_total_math_mismatch'
       WHEN 'ROUNDING_DIFFERENCE' THEN 'invoice_total_rounding_difference' ELSE 'invoice_financial_insufficient_evidence' END,
     CASE status WHEN 'INVALID' THEN 'blocking' WHEN 'INSUFFICIENT_EVIDENCE' THEN 'warning' ELSE 'info' END FROM stat),
  blk AS (SELECT doc_id, bool_or(severity = 'blocking') AS blocking, string_agg(code, ',' ORDER BY code) FILTER (severity = 'blocking') AS codes FROM iss GROUP BY doc_id)"""


@query("q_issues", R.sheets_sql("SELECT doc_id, code, severity FROM iss", RECONCILED, ISSUES))
def q_issues(spark, d):
    return C.issues(issue_input(spark, d))


def decided(df):
    key = F.col("order_id")
    return df.select("doc_id", (key % 9 != 8).alias("is_invoice"), (60 + key % 40).alias("class_pct"), (key * 7 % 100).alias("extraction_pct"), (key % 29 != 0).alias("indexed"))


@query("q_route", R.sheets_sql("""SELECT s.doc_id, CASE WHEN order_id % 9 = 8 THEN CASE WHEN 60 + order_id % 40 < 85 THEN 'non_invoice_review' ELSE 'non_invoice_archive' END
    WHEN order_id * 7 % 100 < 45 THEN 'ocr_quality_review' WHEN blocking THEN 'human_validation_required' ELSE 'ready_for_human_validation' END AS destination FROM stat s JOIN blk USING (doc_id)""", RECONCILED, ISSUES))
def q_route(spark, d):
    found = written(issue_input(spark, d), "issue-input")  # read twice
    return C.route(decided(found), C.issues(found)).select("doc_id", "destination")


@query("q_recommend", R.sheets_sql("""SELECT doc_id, CASE WHEN order_id % 9 = 8 THEN 'confirm_non_invoice' WHEN why <> '' THEN 'send_to_human_review' ELSE 'ready_for_validation' END AS action,
      CASE WHEN order_id % 9 = 8 THEN 60 + order_id % 40 < 85 ELSE why <> '' END AS human_review,
      CASE WHEN order_id % 9 = 8 THEN 'document_classified_as_non_invoice' WHEN why <> '' THEN why ELSE 'classification_ocr_fields_and_rag_ok' END AS reasons
    FROM (SELECT s.doc_id, order_id, concat_ws(',', CASE WHEN order_id % 40 < 10 THEN 'classification_confidence_low' END, CASE WHEN order_id * 7 % 100 < 45 THEN 'ocr_confidence_low' END, codes,
        CASE WHEN order_id % 29 = 0 THEN 'rag_document_not_indexed' END) AS why FROM stat s JOIN blk USING (doc_id))""", RECONCILED, ISSUES))
def q_recommend(spark, d):
    found = written(issue_input(spark, d), "issue-input")  # read twice
    out = C.recommendation(decided(found), C.issues(found))
    return out.select("doc_id", "action", "human_review", F.array_join("reasons", ",").alias("reasons"))
