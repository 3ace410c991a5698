"""Column expressions on values printed from table rows; the check is the row's own value."""

from __future__ import annotations

from pyspark.sql import functions as F

from billquarry.functions import dates, display, parties
from billquarry.functions import money as M
from billquarry.functions import text as X
from billquarry.plans import bindings as B
from billquarry.plans.registry import query


def priced(spark, d):
    """Orders with their total in thousandths and its printed parts."""
    milli = F.round(F.col("o_totalprice") * 1000).cast("long")
    base = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), milli.alias("m"), F.col("o_orderdate").cast("date").alias("day"))
    return base.withColumn("whole", F.floor(F.col("m") / 1000).cast("string")).withColumn("frac", F.lpad((F.col("m") % 1000).cast("string"), 3, "0")).withColumn(
        "dotted", F.regexp_replace("whole", r"(\d)(?=(?:\d{3})+$)", "$1.")
    )


MILLI = "CAST(round(o_totalprice * 1000) AS BIGINT)"


@query("fn_money_ocr", f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 6 THEN 0.0 ELSE CAST({MILLI} AS DOUBLE) / 1000 END AS amount FROM orders")
def fn_money_ocr(spark, d):
    """Seven printed forms: mixed separators both ways, comma, dot, grouped dots, currency text, unreadable."""
    key, dotted, frac, whole = F.col("id") % 7, F.col("dotted"), F.col("frac"), F.col("whole")
    printed = (
        F.when(key == 0, F.concat(dotted, F.lit(","), frac)).when(key == 1, F.concat(F.translate(dotted, ".", ","), F.lit("."), frac))
        .when(key == 2, F.concat(whole, F.lit(","), frac)).when(key == 3, F.concat(whole, F.lit("."), frac))
        .when(key == 4, F.when(F.length(whole) > 3, F.concat(dotted, F.lit("."), frac)).otherwise(F.concat(whole, F.lit("."), frac)))
        .when(key == 5, F.concat(F.lit("TND "), F.translate(dotted, ".", " "), F.lit(","), frac)).otherwise("n/a - -")
    )
    return priced(spark, d).select("id", M.ocr_amount(printed).cast("double").alias("amount"))


@query("fn_money_strict", f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 < 3 THEN CAST({MILLI} AS DOUBLE) / 1000 END AS amount FROM orders")
def fn_money_strict(spark, d):
    key, frac, whole = F.col("id") % 5, F.col("frac"), F.col("whole")
    spaced = F.translate(F.col("dotted"), ".", " ")
    printed = (
        F.when(key == 0, F.concat(spaced, F.lit(","), frac)).when(key == 1, F.concat(F.translate(spaced, " ", " "), F.lit("."), frac))
        .when(key == 2, F.concat(F.lit(" "), whole, F.lit(","), frac)).when(key == 3, F.concat(whole, F.lit(" TND"))).otherwise(F.concat(F.lit("-"), whole))
    )
    return priced(spark, d).select("id", M.strict_amount(printed).cast("double").alias("amount"))


@query("fn_money_extract_all", f"SELECT o_orderkey AS id, 2 + CASE WHEN {MILLI} > 0 THEN 2 ELSE 0 END AS n, (2 * {MILLI} + 12600 + 19000) AS total_milli FROM orders")
def fn_money_extract_all(spark, d):
    text = F.concat(F.lit("TVA 19 % total "), F.col("whole"), F.lit(","), F.col("frac"), F.lit(" timbre 12,600 puis 0,000 et "), F.translate("dotted", ".", " "), F.lit("."), F.col("frac"), F.lit(" N6x"))
    found = priced(spark, d).select("id", M.amounts_in(text).alias("a"))
    total = F.aggregate("a", F.lit(0).cast("decimal(30,6)"), lambda acc, x: (acc + x).cast("decimal(30,6)"))
    return found.select("id", F.size("a").alias("n"), (total * 1000).cast("long").alias("total_milli"))


@query("fn_money_scale_fix", f"""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 3 AND {MILLI} % 1000 = 0 AND {MILLI} >= 100000000 THEN CAST({MILLI} AS DOUBLE) / 1000000
    ELSE CAST({MILLI} AS DOUBLE) / 1000 END AS amount FROM orders""")
def fn_money_scale_fix(spark, d):
    """A model that lost the comma, answered the quantity instead, agreed, or stood alone."""
    m, key = F.col("m").cast(M.AMOUNT), F.col("id") % 4
    exact = (m / 1000).cast(M.AMOUNT)
    value = F.when(key == 0, m).when(key == 1, F.lit(7).cast(M.AMOUNT)).when((key == 2) & (m >= 100000), m).otherwise(exact)
    reading = F.when((key < 2) & (exact > 100), exact).when(key < 2, exact).otherwise(F.lit(0).cast(M.AMOUNT))
    usable = F.when((key == 1) & (exact <= 100), exact).otherwise(value)
    return priced(spark, d).select("id", M.scale_fixed(usable, reading).cast("double").alias("amount"))


@query("fn_money_format", f"SELECT o_orderkey AS id, replace(replace(replace(format('{{:,}}', {MILLI} // 1000), ',', '#'), '.', ','), '#', chr(8239)) || ',' || lpad(CAST({MILLI} % 1000 AS VARCHAR), 3, '0') AS printed FROM orders")
def fn_money_format(spark, d):
    return priced(spark, d).select("id", M.french_format((F.col("m") / 1000).cast("decimal(18,3)")).alias("printed"))


LATIN = "translate(lower(text), 'àáâäãåçèéêëìíîïñòóôöõùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"


@query("fn_fold_text", f"SELECT doc_id, replace({LATIN}, 'ß', 'ss') AS folded FROM documents")
def fn_fold_text(spark, d):
    return B.documents(spark, d).select("doc_id", X.fold(F.col("text")).alias("folded"))


@query("fn_canonical", f"""SELECT doc_id, regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS plain,
    regexp_replace(replace({LATIN}, 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS folded FROM documents""")
def fn_canonical(spark, d):
    return B.documents(spark, d).select("doc_id", X.canonical(F.col("text")).alias("plain"), X.compact(F.col("text")).alias("folded"))


@query("fn_tokens", f"""WITH t AS (SELECT doc_id, regexp_extract_all(replace({LATIN}, 'ß', 'ss'), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+') AS tok FROM documents)
    SELECT doc_id, CAST(len(tok) AS INTEGER) AS n, CAST(len(list_filter(tok, lambda x: length(x) > 1)) AS INTEGER) AS n_long, md5(array_to_string(tok, ' ')) AS digest FROM t""")
def fn_tokens(spark, d):
    tok = B.documents(spark, d).select("doc_id", X.word_tokens(F.col("text")).alias("tok"))
    return tok.select("doc_id", F.size("tok").alias("n"), F.size(F.filter("tok", lambda t: F.length(t) > 1)).alias("n_long"), F.md5(F.array_join("tok", " ")).alias("digest"))


@query("fn_date_normalize", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 8 < 6 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS iso FROM orders")
def fn_date_normalize(spark, d):
    key, day = F.col("id") % 8, F.col("day")
    printed = (
        F.when(key == 0, F.date_format(day, "yyyy-MM-dd")).when(key == 1, F.date_format(day, "d/M/yyyy")).when(key == 2, F.date_format(day, "dd-MM-yyyy"))
        .when(key == 3, F.date_format(day, "dd.MM.yyyy")).when(key == 4, F.date_format(day, "dd-MMM-yyyy")).when(key == 5, F.date_format(day, "d MMM yyyy"))
        .when(key == 6, F.date_format(day, "'31'/'02'/yyyy")).otherwise("demain")
    )
    return priced(spark, d).select("id", F.coalesce(F.date_format(dates.normalized_date(printed), "yyyy-MM-dd"), F.lit("")).alias("iso"))


@query("fn_date_extract", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 2 THEN strftime(o_orderdate, '%d-%m-%y') ELSE strftime(o_orderdate, '%d/%m/%Y') END AS found FROM orders")
def fn_date_extract(spark, d):
    """An impossible token first, a labelled date later, other dates before it; two-digit years."""
    key, day = F.col("id") % 3, F.date_format("day", "dd/MM/yyyy")
    text = (
        F.when(key == 0, F.concat(F.lit("recu 20-14-2019 et 01/01/2001\nDate de la facture : "), day))
        .when(key == 1, F.concat(F.lit("vu le 20-14-2019 puis "), day, F.lit(" ok 02/02/2002")))
        .otherwise(F.concat(F.lit("20.14.2019 "), F.date_format("day", "dd-MM-yy")))
    )
    return priced(spark, d).select("id", dates.printed_date(text).alias("found"))


@query("fn_phone_clean", "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN '71 ' || lpad(CAST(c_custkey % 1000000 AS VARCHAR), 6, '0') WHEN 1 THEN '+216 71' || lpad(CAST(c_custkey % 1000000 AS VARCHAR), 6, '0') END AS phone FROM customer")
def fn_phone_clean(spark, d):
    six, key = F.lpad((F.col("c_custkey") % 1000000).cast("string"), 6, "0"), F.col("c_custkey") % 4
    raw = F.when(key == 0, F.concat(F.lit("(71) "), six)).when(key == 1, F.concat(F.lit("+216-71"), six)).when(key == 2, six).otherwise(F.concat(F.lit("12345"), six, F.lit("9")))
    return B.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), parties.clean_phone(raw).alias("phone"))


@query("fn_tax_id_clean", "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN lpad(CAST(c_custkey AS VARCHAR), 7, '0') || 'A/M/000' WHEN 1 THEN lpad(CAST(c_custkey AS VARCHAR), 7, '0') || 'AB123' WHEN 2 THEN lpad(CAST(c_custkey AS VARCHAR), 7, '0') || ' A M 0B0' END AS tax_id FROM customer")
def fn_tax_id_clean(spark, d):
    seven, key = F.lpad(F.col("c_custkey").cast("string"), 7, "0"), F.col("c_custkey") % 4
    raw = (
        F.when(key == 0, F.concat(F.lit("MF : "), seven, F.lit(" a / M / 000"))).when(key == 1, F.concat(seven, F.lit("ab123.")))
        .when(key == 2, F.concat(seven, F.lit(" A  M 0B0"))).otherwise("MF 12")
    )
    return B.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), parties.clean_tax_id(raw).alias("tax_id"))


@query("fn_tax_rate", """SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
    CASE WHEN l_linenumber % 3 = 2 AND l_discount = 0 THEN NULL WHEN l_linenumber % 3 = 2 THEN CAST(round(l_discount * 100) AS BIGINT) || '%'
         ELSE greatest(7, CAST(round(l_tax * 100) AS BIGINT)) || CASE WHEN l_linenumber % 3 = 1 THEN ',5%' ELSE '%' END END AS rate FROM lineitem""")
def fn_tax_rate(spark, d):
    from billquarry.operators.totals import tax_rate

    line, tax, disc = F.col("l_linenumber") % 3, F.round(F.col("l_tax") * 100).cast("long"), F.round(F.col("l_discount") * 100).cast("long").cast("string")
    half = F.when(line == 1, ",5").otherwise("")
    text = F.when(line == 2, F.concat(F.lit("remise "), disc, F.lit(" % 45%"))).otherwise(
        F.concat(F.lit("TVA : "), F.least(F.lit(7), tax).cast("string"), half, F.lit("% VAT ("), F.greatest(F.lit(7), tax).cast("string"), half, F.lit("%) 25 % TVA 90%"))
    )
    return B.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), tax_rate(text).alias("rate"),
    )


@query("fn_filename_safe", "SELECT page_id, regexp_replace(url, '[^\\p{L}\\p{N}._-]', '_', 'g') AS name FROM pages")
def fn_filename_safe(spark, d):
    return B.pages(spark, d).select("page_id", X.safe_filename(F.col("url")).alias("name"))


@query("fn_language", "SELECT doc_id, CASE WHEN doc_id % 5 IN (0, 2) THEN 'ar' ELSE 'fr' END AS answer_language FROM documents")
def fn_language(spark, d):
    key = F.col("doc_id") % 5
    question = (
        F.when(key == 0, F.concat(F.col("text"), F.lit(" en Arabe"))).when(key == 1, F.concat(F.lit("ما هو المجموع en français ")))
        .when(key == 2, "ما هو المبلغ").when(key == 3, F.col("text")).otherwise("بالفرنسية من فضلك")
    )
    return B.documents(spark, d).select("doc_id", X.answer_language(question).alias("answer_language"))


@query("fn_query_expand", """SELECT item_id, text || CASE item_id % 4 WHEN 0 THEN ' total ttc TTC total montant شامل الضريبة باحتساب الاداء' WHEN 1 THEN ' Date du Téléphone date facture تاريخ الفاتورة telephone phone الهاتف'
    WHEN 2 THEN ' القيمة المضافة TVA taxe valeur ajoutee القيمة المضافة' ELSE '' END AS expanded FROM benchmark""")
def fn_query_expand(spark, d):
    key = F.col("item_id") % 4
    extra = F.when(key == 0, " total ttc").when(key == 1, " Date du Téléphone").when(key == 2, " القيمة المضافة").otherwise("")
    return B.table(spark, d, "benchmark").select("item_id", X.expand_question(F.concat("text", extra)).alias("expanded"))


HINTS = ["Désignation | Quantité", "Total TTC 12,000", "Code TVA : 12", "Payée en espèces", "Date facture client", "Nom du client : X", "Client signature", "Fournisseur : Y", "Date : 01/02/2020", "bonjour"]
HINT_NAMES = ["line_items", "totals", None, "payment_information", "other", "customer", None, "supplier", "invoice_info", None]


@query("fn_section_hint", "SELECT event_id AS id, CASE event_id % 10 " + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(HINT_NAMES) if h) + " END AS section FROM events")
def fn_section_hint(spark, d):
    """One line of every kind, followed by an event's own words."""
    lines = F.array(*[F.lit(h) for h in HINTS])
    line = F.concat(F.get(lines, (F.col("event_id") % 10).cast("int")), F.lit(" "), F.col("event_type"))
    return B.table(spark, d, "events").select(F.col("event_id").alias("id"), X.section_hint(line).alias("section"))


@query("fn_value_equal", "SELECT o_orderkey AS id, o_orderkey % 4 <> 3 AS same FROM orders")
def fn_value_equal(spark, d):
    key, whole, frac = F.col("id") % 4, F.col("whole"), F.col("frac")
    a = F.concat(whole, F.lit("."), frac)
    b = (
        F.when(key == 0, F.concat(F.lit(" "), F.translate("dotted", ".", " "), F.lit(","), frac)).when(key == 1, F.concat(whole, F.lit("."), frac, F.lit("00")))
        .when(key == 2, a).otherwise(F.concat(whole, F.lit("1."), frac))
    )
    return priced(spark, d).select("id", display.same_evidence(a, b).alias("same"))


@query("fn_percent", "SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN event_id % 101 ELSE 2 + event_id % 99 END AS pct FROM events")
def fn_percent(spark, d):
    key = F.col("event_id")
    score = F.when(key % 2 == 0, (key % 101).cast("double") / 100).otherwise((key % 99 + 2).cast("double"))
    return B.table(spark, d, "events").select(key.alias("id"), display.percent(score).alias("pct"))
