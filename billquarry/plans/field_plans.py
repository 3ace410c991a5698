"""Header fields of rendered invoices: extraction must give the source values back."""

from __future__ import annotations

from pyspark.sql import functions as F

from billquarry.functions import text as X
from billquarry.operators import fields as E
from billquarry.operators import passages as P
from billquarry.operators import retrieval as T
from billquarry.operators import totals
from billquarry.plans import rendering as R
from billquarry.plans.registry import query
from billquarry.vocabulary import FIELD_PHRASES


def milli(c):
    return (c * 1000).cast("long")


@query("txt_labelled_money", R.sheets_sql("""SELECT doc_id, ht AS subtotal, CASE WHEN order_id % 4 <> 3 THEN tva END AS tax_amount, stamp AS stamp_duty, ttc AS total_amount FROM sheets"""))
def txt_labelled_money(spark, d):
    docs = R.texts(spark, d).withColumn("marked", totals.label_lines(X.sought(F.col("text"))))
    names = ["subtotal", "tax_amount", "stamp_duty", "total_amount"]
    return docs.select("doc_id", *[milli(totals.labelled_among(F.col("marked"), n)).alias(n) for n in names])


@query("txt_invoice_number", R.sheets_sql("SELECT doc_id, CASE order_id % 3 WHEN 0 THEN invoice_number WHEN 1 THEN 'A-' || invoice_number ELSE invoice_number || '/X' END AS number FROM sheets"))
def txt_invoice_number(spark, d):
    """Three printed forms of the number; words that follow the title but hold no digit are passed over."""
    key, number = F.col("order_id") % 3, F.col("invoice_number")
    text = (
        F.when(key == 0, F.concat(F.lit("Facture client\nINVOICE No: "), number, F.lit(" du jour")))
        .when(key == 1, F.concat(F.lit("FACTU RE N° A-"), number, F.lit(".\n")))
        .otherwise(F.concat(F.lit("Avoir N° de facture : "), number, F.lit("/X-")))
    )
    return R.sheets(spark, d).select("doc_id", E.invoice_number(text).alias("number"))


@query("txt_amount_in_words", R.sheets_sql("SELECT doc_id, CASE order_id % 4 WHEN 3 THEN NULL ELSE 'Deux Cent Dinars et Cinq Millimes' END AS words FROM sheets"))
def txt_amount_in_words(spark, d):
    key, number = F.col("order_id") % 4, F.col("invoice_number")
    phrase = F.lit("Deux Cent Dinars et Cinq Millimes")
    text = (
        F.when(key == 0, F.concat(F.lit("Facture "), number, F.lit("\nArrêtée la présente facture à la somme de : Deux Cent\n Dinars et Cinq Millimes\nCachet et signature")))
        .when(key == 1, F.concat(F.lit("Montant en lettres: "), phrase, F.lit(". Page 2 "), number))
        .when(key == 2, F.concat(F.lit("TTC 12,000\n"), phrase, F.lit("\nNo "), number))
        .otherwise(F.concat(F.lit("somme de : cent unités "), number))
    )
    return R.sheets(spark, d).select("doc_id", E.amount_in_words(text).alias("words"))


@query("txt_party_names", R.sheets_sql("""SELECT doc_id, vendor AS vendor_name, customer AS customer_name, '12 rue de Tunis ' || supplier_id AS vendor_address, '9 avenue de Sfax ' || supplier_id AS customer_address FROM sheets"""))
def txt_party_names(spark, d):
    text = F.col("text")
    vendor, customer = E.party_addresses(text)
    return R.texts(spark, d).select(
        "doc_id", E.vendor_name(text).alias("vendor_name"), E.customer_name(text).alias("customer_name"), vendor.alias("vendor_address"), customer.alias("customer_address")
    )


@query("txt_tax_ids_by_party", R.sheets_sql("SELECT doc_id, vendor_tax AS vendor, customer_tax AS customer FROM sheets"))
def txt_tax_ids_by_party(spark, d):
    return R.texts(spark, d).select("doc_id", E.tax_ids_by_party(F.col("text")).alias("ids")).select("doc_id", "ids.vendor", "ids.customer")


@query("txt_phone_by_label", R.sheets_sql("SELECT doc_id, vendor_phone, CASE WHEN order_id % 2 = 0 THEN '+216 71 000 111' END AS customer_phone FROM sheets"))
def txt_phone_by_label(spark, d):
    extra = F.when(F.col("order_id") % 2 == 0, "\nClient tel: +216 71 000 111").otherwise("\nfax 71 000 222")
    text = F.concat("text", extra)
    return R.texts(spark, d).select(
        "doc_id", E.phone(text, ["fournisseur", "vendeur", "seller", "supplier"], 0).alias("vendor_phone"), E.phone(text, ["client", "acheteur", "buyer", "customer"], 1).alias("customer_phone")
    )


@query("txt_tax_rows", R.sheets_sql("""SELECT doc_id, 'TVA' AS label, 19.0 AS rate, tva AS milli, 13 + n AS line_id FROM sheets WHERE order_id % 4 <> 3
    UNION ALL SELECT doc_id, 'FODEC', 1.0, ht - ht % 100, 13 + n + CASE WHEN order_id % 4 <> 3 THEN 1 ELSE 0 END FROM sheets WHERE order_id % 5 = 0"""))
def txt_tax_rows(spark, d):
    rows = R.texts(spark, d).select("doc_id", F.inline(totals.tax_rows(F.col("text"))))
    return rows.select("doc_id", "label", F.col("rate").cast("double").alias("rate"), milli(F.col("amount")).alias("milli"), "line_id")


@query("txt_discounts", R.sheets_sql("""SELECT doc_id, 'item' AS scope, CAST(round(sum(milli)) AS BIGINT) AS milli, count(*) AS n, CASE WHEN order_id % 2 = 0 THEN 5.0 END AS rate FROM (SELECT l.*, invoice_id AS order_id FROM lines l) GROUP BY doc_id, order_id
    UNION ALL SELECT doc_id, 'invoice', 12500, 1, 10.0 FROM sheets WHERE order_id % 3 = 0"""))
def txt_discounts(spark, d):
    """A discount column in the article table, and for one in three a discount line of the invoice."""
    head = F.when(F.col("order_id") % 2 == 0, "Désignation | Quantité | Remise 5% | Total").otherwise("Désignation | Quantité | Remise | Total")
    rows = F.transform("lines", lambda r: F.concat_ws(" | ", r["description"], r["quantity"].cast("string"), R.milli_text(r["milli"]), F.lit("1,000")))
    foot = F.when(F.col("order_id") % 3 == 0, F.array(F.lit("Total"), F.lit("Remise (10%) : 12,500"))).otherwise(F.array(F.lit("Remise 10 %")))
    text = F.array_join(F.concat(F.array(F.lit("Remise"), head), rows, foot), "\n")
    found = R.sheets(spark, d).select("doc_id", F.inline(totals.discounts(text)))
    return found.groupBy("doc_id", "scope").agg(milli(F.sum("amount")).alias("milli"), F.count(F.lit(1)).alias("n"), F.max("rate").cast("double").alias("rate"))


@query("txt_stamp_pairs", R.sheets_sql("SELECT doc_id, 600 + order_id % 7 AS milli, 2 AS line_id FROM sheets WHERE order_id % 2 = 0"))
def txt_stamp_pairs(spark, d):
    """Stamp label and amount on two lines; a line between them breaks the pair."""
    amount = R.milli_text(F.col("order_id") % 7 + 600)
    text = F.concat(F.lit("Facture\nTimbre fiscal :\n"), F.when(F.col("order_id") % 2 == 0, "").otherwise("TVA\n"), amount, F.lit("\nTimbre fiscal 0,600"))
    rows = R.sheets(spark, d).select("doc_id", F.inline(totals.stamp_pairs(text)))
    return rows.select("doc_id", milli(F.col("amount")).alias("milli"), "line_id")


@query("txt_customer_code", R.sheets_sql("SELECT doc_id, CASE WHEN order_id % 4 <> 3 THEN 'C-' || invoice_number END AS code, CASE WHEN order_id % 4 < 2 THEN customer END AS company FROM sheets"))
def txt_customer_code(spark, d):
    """Code on the label's line, on the next or after a blank line; two codes cancel each other."""
    key, code = F.col("order_id") % 4, F.concat(F.lit("C-"), F.col("invoice_number"))
    label = F.when(key == 0, F.concat(F.lit("Code client : "), code)).when(key == 1, F.concat(F.lit("code client\n"), code)).when(
        key == 2, F.concat(F.lit("Customer ID:\n\n"), code)
    ).otherwise(F.concat(F.lit("Code client : "), code, F.lit("\nCode client : "), code, F.lit("9")))
    block = F.when(key < 2, F.concat(F.lit("Code client | "), F.col("customer"), F.lit("\n"), code, F.lit(" | x"))).otherwise(F.concat(F.lit("Fournisseur | "), F.col("customer")))
    return R.sheets(spark, d).select("doc_id", E.customer_code(label).alias("code"), E.customer_company(block).alias("company"))


@query("txt_party_block", R.sheets_sql("SELECT doc_id, '9 avenue de Sfax ' || supplier_id || ' Zone Nord' AS address, 'STE BORNE Industrie' AS customer FROM sheets"))
def txt_party_block(spark, d):
    """Address and customer continued below their label in the same column, next to another party's column."""
    text = F.concat(
        F.lit("Fournisseur : X | Client : STE BORNE\nMF : 1 | Industrie\nAdresse : 9 avenue de Sfax "), F.col("supplier_id").cast("string"),
        F.lit(" | Tel : 2\nZone Nord | Fax : 3\nTunis | Date"),
    )
    docs = R.sheets(spark, d).select("doc_id", E.party_block(text, "address").alias("a"), E.party_block(text, "customer_name").alias("c"))
    return docs.select("doc_id", F.get("a", F.lit(0))["value"].alias("address"), F.get("c", F.lit(0))["value"].alias("customer"))


@query("txt_supplier_header", R.sheets_sql("SELECT doc_id, vendor AS vendor_name, vendor_tax AS vendor_tax_id, '12 rue de Tunis ' || supplier_id AS vendor_address FROM sheets WHERE order_id % 3 <> 2"))
def txt_supplier_header(spark, d):
    """Heading repeated in the company line below it; for one in three the company line names another firm."""
    other = F.when(F.col("order_id") % 3 == 2, F.col("customer")).otherwise(F.col("vendor"))
    text = F.concat(
        F.col("vendor"), F.lit(" | Original\nSociété "), other, F.lit(" SARL\nMF : "), F.col("vendor_tax"), F.lit("\nS.S : 12 rue de Tunis "),
        F.col("supplier_id").cast("string"), F.lit("\nFACTURE 1\nMF : 9999999Z/A/B/000"),
    )
    text = F.regexp_replace(text, "A/M/000", "A/M/B/000")
    docs = R.sheets(spark, d).select("doc_id", E.supplier_header(text).alias("h")).filter(F.col("h").isNotNull())
    return docs.select("doc_id", "h.vendor_name", F.replace("h.vendor_tax_id", F.lit("A/M/B/000"), F.lit("A/M/000")).alias("vendor_tax_id"), "h.vendor_address")


@query("txt_named_contacts", R.sheets_sql("SELECT doc_id, '12 rue de Tunis' AS address, vendor_phone AS phone, 'a' || supplier_id || '@atlas.tn' AS email FROM sheets WHERE order_id % 3 <> 2"))
def txt_named_contacts(spark, d):
    """A line "name: address" with contact lines under it; named twice it is not used."""
    line = F.concat(F.upper("vendor"), F.lit(" : 12 rue de Tunis\n"))
    text = F.concat(
        F.lit("FACTURE\n"), line, F.lit("Tél : "), F.col("vendor_phone"), F.lit("\nEmail : a"), F.col("supplier_id").cast("string"), F.lit("@atlas.tn\nDate : x\nTél : 71 999 999\n"),
        F.when(F.col("order_id") % 3 == 2, line).otherwise(""),
    )
    # a generator is evaluated once; a filter on the contacts would find them a second time
    return R.sheets(spark, d).select("doc_id", F.inline(F.array_compact(F.array(E.named_contacts(F.col("vendor"), text)))))


@query("txt_cash_payment", R.sheets_sql("SELECT doc_id, CASE WHEN order_id % 3 = 0 THEN 'Payée en espèces' END AS payment FROM sheets"))
def txt_cash_payment(spark, d):
    return R.texts(spark, d).select("doc_id", E.cash_payment(F.col("text")).alias("payment"))


WIDE = """SELECT doc_id, invoice_number, day AS date, vendor AS vendor_name, customer AS customer_name, vendor_tax AS vendor_tax_id, customer_tax AS customer_tax_id, vendor_phone,
  ht AS subtotal, CASE WHEN order_id % 4 <> 3 THEN tva END AS tax_amount, 600 AS stamp_duty, ttc AS total_amount, CASE WHEN order_id % 4 <> 3 THEN '19%' WHEN order_id % 5 = 0 THEN '1%' END AS tax_rate, 'TND' AS currency,
  CASE WHEN order_id % 3 = 0 THEN 'Payée en espèces' END AS payment_method, CASE WHEN order_id % 3 = 2 THEN 'Deux Cent Dinars et Cinq Millimes' END AS amount_in_words FROM sheets"""


@query("txt_fields_wide", R.sheets_sql(WIDE))
def txt_fields_wide(spark, d):
    wide = E.wide_fields(R.texts(spark, d))
    amounts = ["subtotal", "tax_amount", "stamp_duty", "total_amount"]
    return wide.select(
        "doc_id", "invoice_number", "date", "vendor_name", "customer_name", "vendor_tax_id", "customer_tax_id", "vendor_phone",
        *[milli(F.col(a)).alias(a) for a in amounts], "tax_rate", "currency", "payment_method", "amount_in_words",
    )


@query("txt_fields_minimal", R.sheets_sql("SELECT doc_id, invoice_number, ttc AS milli, 0.4 AS confidence FROM sheets"))
def txt_fields_minimal(spark, d):
    got = R.texts(spark, d).select("doc_id", *E.minimal_fields(F.col("text")))
    return got.select("doc_id", "invoice_number", milli(F.col("total_amount")).alias("milli"), "confidence")


@query("txt_fields_targeted", R.sheets_sql("SELECT doc_id, invoice_number, day AS date, ht AS subtotal, ttc AS total_amount FROM sheets"))
def txt_fields_targeted(spark, d):
    """Each field read again from its own best passages; the whole text fills what they lack."""
    docs = R.texts(spark, d).select("doc_id", "text")
    chunks = P.chunks(docs)
    wanted = ["invoice_number", "date", "subtotal", "total_amount"]
    ranked = T.field_overlap(chunks, phrases={f: FIELD_PHRASES[f] for f in wanted}, keep=["text"])
    context = ranked.groupBy("doc_id", "field").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda s: s["text"]), "\n").alias("text")
    )
    t = F.col("text")
    marked = totals.label_lines(X.sought(t))
    value = (
        F.when(F.col("field") == "invoice_number", E.invoice_number(t)).when(F.col("field") == "date", E.dates.printed_date(t))
        .when(F.col("field") == "subtotal", totals.labelled_among(marked, "subtotal").cast("string")).otherwise(totals.labelled_among(marked, "total_amount").cast("string"))
    )
    own = context.groupBy("doc_id").pivot("field", wanted).agg(F.first(value))
    full = E.wide_fields(docs).select("doc_id", *[F.col(w).cast("string").alias("_" + w) for w in wanted])
    both = full.join(own, "doc_id", "left").select("doc_id", *[F.coalesce(w, "_" + w).alias(w) for w in wanted])
    return both.select("doc_id", "invoice_number", "date", *[milli(F.col(a).cast("decimal(20,6)")).alias(a) for a in ("subtotal", "total_amount")])


@query("win_role_lookback", R.sheets_sql("""SELECT doc_id, line_id, col, CASE WHEN line_id <= 2 THEN CASE WHEN col = 0 THEN 'supplier' ELSE 'customer' END WHEN line_id = 5 AND col = 0 THEN 'customer' WHEN line_id BETWEEN 6 AND 16 AND col = 0 THEN 'customer' END AS role
   FROM sheets, (SELECT unnest([1,1,2,2,3,4,4,5,6,7,8,9,10,11,12,13,14,15,16,17,18]) AS line_id, unnest([0,1,0,1,0,0,1,0,0,0,0,0,0,0,0,0,0,0,0,0,0]) AS col)"""))
def win_role_lookback(spark, d):
    """Two columns with their parties, a table line, then a customer label twelve lines before the end."""
    filler = "\n".join(f"ligne {i}" for i in range(6, 19))
    text = F.concat(
        F.lit("Fournisseur : A | Client : B\n"), F.col("vendor_tax"), F.lit(" | "), F.col("customer_tax"),
        F.lit("\nDésignation\nx | y\nRaison sociale : "), F.col("invoice_number"), F.lit("\n" + filler),
    )
    return E.cell_roles(R.sheets(spark, d).select("doc_id", text.alias("text"))).select("doc_id", "line_id", "col", "role")
