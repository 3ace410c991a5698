"""Work that must not be done twice: what plans read, shuffle and compute."""

import __spark_entry__ as entry
from billquarry.operators import lines as L
from billquarry.operators import retrieval as T
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_page_number_casts_marker_lines_only(spark):
    rows = [("--- Page 12 ---",), ("Page 12",), ("",), (None,), (" ---page 3---",), ("--- Page 99999999999 ---",)]
    got = [r[0] for r in spark.createDataFrame(rows, "line string").select(L.page_number(F.col("line"))).collect()]
    assert got == [12, None, None, None, 3, None]


def test_line_passages_carry_their_cost(spark, data):
    # the cost of the pending lines was added up again at every line, several times
    folded = plan(entry.queries()["txt_passages_lines"](spark, data))
    assert folded.count("aggregate(") == 1


def test_field_queries_cut_texts_once(spark, data):
    for name in ("ret_field_queries", "win_round_robin_budget"):
        text = plan(entry.queries()[name](spark, data))
        assert text.count("posexplode(") == 1, name
    # written before they are used five times
    assert "posexplode(" not in plan(entry.queries()["ret_field_overrides"](spark, data))


def test_overrides_move_up_places(spark):
    passages = spark.createDataFrame(
        [(1, 0, "text", "a"), (1, 1, "text", "b"), (1, 2, "table", "c"), (2, 0, "table", "d"), (2, 1, "text", "e")], "doc_id int, chunk_index int, kind string, text string"
    )
    ranked = spark.createDataFrame(
        [(1, "vendor_name", 1, 1, 3.0), (1, "vendor_name", 0, 2, 2.0), (1, "vendor_name", 2, 3, 1.0), (1, "items", 2, 1, 1.0), (2, "vendor_name", 0, 1, 2.0), (1, "rib", 0, 1, 1.0)],
        "doc_id int, field string, chunk_index int, rank int, score double",
    )
    got = sorted((r["doc_id"], r["field"], r["rank"], r["chunk_index"]) for r in T.with_field_overrides(ranked, passages).collect())
    assert got == [
        (1, "items", 1, 2), (1, "rib", 1, 0), (1, "vendor_name", 1, 0), (1, "vendor_name", 2, 1), (1, "vendor_name", 3, 2), (2, "items", 1, 0), (2, "vendor_name", 1, 0),
    ]


def test_led_patterns_find_the_same(spark):
    from billquarry.functions import text as X
    from billquarry.operators import totals

    assert X.led(r"\btotal\b") == r"(?=t)\btotal\b" and X.led("total") == "total"
    lines = ["TOTAL HT 12,000", "Sous-total ht 5", "Tımbre fiscal 0,600", "ſubtotal 4,000", "net à payer 3", "\ttotal 7,500", "Taxe 1", "x y", "a \tb", " a  b\t"]
    for pattern, _ in totals.LABELS.values():
        plain, first = X.IU + "|".join(pattern), X.IU + X.any_of(pattern)
        rows = spark.createDataFrame([(s,) for s in lines], "s string").select(F.col("s").rlike(plain), F.col("s").rlike(first)).collect()
        assert all(r[0] == r[1] for r in rows)
    got = spark.createDataFrame([(s,) for s in lines], "s string").select(X.squeeze(F.col("s")).alias("q"), F.regexp_replace("s", X.U + r"\s+", " ").alias("w"), F.size(X.split_lines(F.col("s"))).alias("n")).collect()
    assert all(r["q"] == r["w"] for r in got) and [r["n"] for r in got] == [1] * 7 + [2, 1, 1]


def test_texts_are_rendered_once_for_the_pack(spark, data):
    assert plan(entry.queries()["txt_candidate_pack"](spark, data)).count("FACTURE") == 1


def test_targeted_fields_do_not_join_texts(spark, data):
    # chunks of the ranked passages, and the whole texts that fill in
    assert plan(entry.queries()["txt_fields_targeted"](spark, data)).count("--- Page 1 ---") == 2


def test_issues_are_rendered_once(spark, data):
    for name in ("q_route", "q_recommend"):
        assert "--- Page 1 ---" not in plan(entry.queries()[name](spark, data)), name


def test_lines_of_an_invoice_are_dealt_out_once(spark, data):
    from billquarry.plans import rendering as R

    executed = R.sheets(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert executed.count("hashpartitioning(invoice_id#") == 1
    assert ", page#" not in "".join(line for line in executed.splitlines() if "Exchange" in line)


def test_contacts_are_found_once(spark, data):
    # a filter on the contacts found them a second time, and the name's letters were made at every line
    text = plan(entry.queries()["txt_named_contacts"](spark, data))
    assert text.count("Generate inline") == 1 and text.count("rue\\b|avenue") == 1


def test_contacts_of_odd_names(spark):
    from billquarry.operators import fields as E

    text = "Ste Été : 12 rue X\nTél : 71 222 333\nste ete: sans adresse\n : 5 rue\n"
    rows = [("STE ETE", text), ("Ste", text), (None, text), ("STE ETE", None), ("STE ETE", text + "STE-ETE:avenue Y")]
    got = spark.createDataFrame(rows, "name string, text string").select(E.named_contacts(F.col("name"), F.col("text")).alias("c")).collect()
    assert [r["c"] and tuple(r["c"]) for r in got] == [("12 rue X", "71 222 333", None), None, None, None, None]


def test_distinct_identifiers_are_not_scored(spark, data):
    from billquarry.operators import fields as E

    assert " AS lead" not in plan(entry.queries()["distinct_tax_ids"](spark, data))
    texts = ["MF : 1234567 puis 1234567A/M/000", "code 12345678ABC123 x", "matricule fiscal 12345678ABC123 x", "sans", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select(E.distinct_tax_ids(F.col("t")).alias("a"), F.array_distinct(F.transform(E.tax_id_candidates(F.col("t")), lambda c: c["value"])).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got) and got[2]["a"] == ["12345678ABC123"]


def test_amounts_are_looked_for_once_an_invoice(spark, data):
    # five questions about an invoice searched its text five times, and took each find apart twice
    text = plan(entry.queries()["ret_labelled_answer"](spark, data))
    assert text.count("montant\\s+(?:total\\s+)?ttc") == 1
    assert text.index("CROSS" if "CROSS" in text else "Join") < text.index("montant\\s+(?:total\\s+)?ttc")


def test_lines_are_judged_once(spark, data):
    # filters for empty arrays, pushed down, judged all lines and made all items a second time
    text = plan(entry.queries()["q_line_filter"](spark, data))
    assert text.count("not_proven_inside_article_table") == 1 and text.count("cachet\\s+et\\s+signature") == 1
    assert plan(entry.queries()["q_item_grounding"](spark, data)).count(" neuf") == 1
    for name in ("q_item_grounding", "q_visual_grounding"):  # texts are prepared below the rows of their items
        rows, below = plan(entry.queries()[name](spark, data)).split("Generate ", 1)
        assert "text#" not in rows, name


def test_cells_are_told_apart_before_the_join(spark, data):
    # what is shuffled is the key of a cell, not its text beside it
    text = entry.queries()["join_unique_location"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert " AS raw" not in text and " AS exact" in text


def test_discount_lines_are_read_once(spark):
    from billquarry.operators import totals

    texts = [
        "Désignation | Qte | Remise 5% | Total\na | 1 | 2,500 | 9\nb\nc | 1 | x | 9\nd | 1 | 3,000 | 9",
        "Remise\nDesignation | Remise | Rabais | Prix\na | 1 | 2 | 3\nRemise (10%) : 12,500", "Prix | Remise : 4,000 | x", "rabais 3 000,500\nDISCOUNT (-) 7\nprix unitaire remise 8",
        "Article | Remise | Total\na | 1,5 | 2\nTotal\nb | 2,5 | 2", "Article | Remise | Total\nRemise 10 %\nb | 2,5 | 2\n\nc | 3 | 2", "sans", None, "",
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(totals.discounts(F.col("t")).alias("d"))
    got = [r["d"] and [(e["scope"], float(e["amount"]), e["rate"] and float(e["rate"]), e["line_id"]) for e in r["d"]] for r in rows.collect()]
    assert got == [
        [("item", 2.5, 5.0, 2)], [("invoice", 12.5, 10.0, 4)], [("invoice", 4.0, None, 1)], [("invoice", 3000.5, None, 1), ("invoice", 7.0, None, 2)],
        [("item", 1.5, None, 2)], [("item", 2.5, None, 3), ("item", 3.0, None, 5)], [], [], [],
    ]
    assert plan(rows).count("^(?:remise|discount|rabais)") == 1


def test_table_borders_of_lines_without_words(spark, data):
    lines = ["Désignation | Qté", "small ring | U | 2", "Total HT 5", "unit price", "prix reference", "Adresse : x", "--- Page 2 ---", "montant ttc", "", None, "TÉLÉPHONE 1", "mon total"]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in lines], "s string").select(L.table_border(F.col("s"))).collect()]
    assert got == [True, None, False, True, True, False, False, False, None, None, False, None]


def test_scoped_scores_shuffle_texts_once(spark, data):
    # passages of a document meet its own question where they were dealt to; they were shuffled for every join and sum
    words = ["total", "ht", "tva", "a b", "net net", "", "z"]
    passages = spark.createDataFrame([(d, c, " ".join(words[(d + c * k) % 7] for k in range(5))) for d in range(6) for c in range(4)], "doc_id int, chunk_index int, text string")
    asked = spark.createDataFrame([(0, "total ht"), (1, "tva tva b"), (2, "nothing")], "qid int, query string")
    pairs = spark.createDataFrame([(d, q) for d in range(5) for q in (d % 3, (d + 1) % 3)], "doc_id int, qid int")
    keys = ["doc_id", "chunk_index"]
    weights = T.hash_weights(asked, ["qid"], "query")
    got = T.sparse_cosine(pairs.join(weights, "qid"), T.hash_weights(passages, keys, deal=["doc_id"]), ["doc_id", "qid"], keys, ["doc_id"])
    every = T.sparse_cosine(weights, T.hash_weights(passages, keys), ["qid"], keys).join(pairs, ["doc_id", "qid"])
    told = lambda df: {(r["doc_id"], r["qid"], r["chunk_index"]): round(r["semantic"], 9) for r in df.collect()}
    assert told(got) == told(every) and told(got)
    scores = {(r["doc_id"], r["qid"], r["chunk_index"]): r["bm25"] for r in T.bm25(asked, passages, keys, ["doc_id"], pairs).collect()}
    for d in range(5):
        one = passages.where(F.col("doc_id") == d)
        plain = {(r["doc_id"], r["qid"], r["chunk_index"]): r["bm25"] for r in T.bm25(asked, one, keys).collect() if r["qid"] in (d % 3, (d + 1) % 3)}
        mine = {k: v for k, v in scores.items() if k[0] == d}
        assert plain.keys() == mine.keys() and all(abs(plain[k] - mine[k]) < 1e-9 for k in plain)
    whole = plan(entry.queries()["ret_rrf"](spark, data))
    assert whole.count("md5(") <= 4  # of questions and passages, each once: digests were made again for the lengths


def test_tax_rows_look_at_a_line_once(spark):
    from billquarry.operators import fields as E
    from billquarry.operators import totals

    texts = ["TVA (19%) 5,000 | fodec 1 % 2,000\nx | 19 | 3\nvat: 7% : 1 000,5", "TVA 19", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(totals.tax_rows(F.col("t")).alias("r"), E.vendor_name(F.col("t")).alias("v"))
    got = [r["r"] and [(e["label"], float(e["rate"]), float(e["amount"]), e["line_id"]) for e in r["r"]] for r in rows.collect()]
    assert got == [[("TVA", 19.0, 5.0, 1), ("FODEC", 1.0, 2.0, 1), ("VAT", 7.0, 1000.5, 3)], [], [], None]
    assert "RLIKE" in plan(rows).split("(FODEC")[0]  # one look before three
    heads = ["Facture N° 12-3", "INVOICE #A7", "BL", "B.L. - Facture N°77", "N° de facture : 00456", "FOURNISSEUR : X\nSupplier - Y", "ſupplier : Z"]
    plain = spark.createDataFrame([(t,) for t in heads], "t string").select(E.invoice_number(F.col("t")), E.vendor_name(F.col("t"))).collect()
    assert [tuple(r) for r in plain] == [("12-3", None), ("A7", "INVOICE #A7"), (None, None), ("77", None), ("00456", None), (None, "X"), (None, "Z")]


ODD = [
    "Facture N° 12-3\nTOTAL HT 12,000\nTımbre fıscal 0,600\nTotal TTC\n15,600 TND\n\nPayée en espèces", "ſous-total : 5,000\tKg\nCLİENT : İzmir\r\nclient tel: 71 222 333\nRemiſe 4,000",
    "net  à payer\x0b7,000\x1cMONTANT TTC 9,000 DT TVA : 19%", "code TVA : 7\nT.V.A. 19% 3,000\nPrix total ht 8,000", "Date : 31/02/2020 et 01/02/2020 date 03/04/2021",
    "Total T T C\n--- Page 2 ---\nraiſon sociale: A&B\nnom du client ; X\nRIB: TN59\nMode paiement : chèque\nUSD 4 EUR", "1234567 A / M / 000 fournisseur client société 1234568/B/P\nMF : 1234567AM000",
    "non " + " " * 27 + "payé en espèces", "non" + " " * 28 + "payé en espèces", "pas encore réglement en espèces", "Somme de : Cent Dinars\nDinar", "€", "", None,
]


def test_cheap_looks_find_the_same(spark):
    # texts were searched by a pattern for every field, whether or not they hold a word of it
    from billquarry.functions import text as X
    from billquarry.operators import fields as E
    from billquarry.operators import totals

    t = F.col("t")
    rows = spark.createDataFrame([(s,) for s in ODD], "t string")
    low, lines = X.sought(t), totals.tidy_lines(t)
    pairs = {
        "lines": (F.concat_ws("/", lines), F.concat_ws("/", F.transform(F.filter(X.split_lines(t), lambda s: F.trim(s) != ""), lambda s: F.btrim(F.regexp_replace(s, X.U + r"\s+", " "), F.lit(" |:;"))))),
        "split": (F.size(X.split_lines(t)), F.size(F.split(F.regexp_replace(t, "(?:" + X.LINE_BREAK + ")$", ""), X.LINE_BREAK)) - (t == "").cast("int")),
        "currency": (E.currency(t), F.when(X.match(t, r"\beur\b|€"), "EUR").when(X.match(t, r"\busd\b|\$"), "USD").otherwise("TND")),
        "cash": (E.cash_payment(t), F.when(X.match(t, E.CASH) & ~X.tail(F.regexp_extract(t, "(?siU)^(.*?)" + E.CASH, 1), 30).rlike(X.IU + r"(?:non|pas(?:\s+encore)?)\s*$"), X.grab(t, E.CASH, 0))),
        "customer": (E.customer_name(t), E.customer_name(t, F.lit("raison nom client"))), "words": (E.amount_in_words(t), E.amount_in_words(t, F.lit("dinar"))),
        "phone": (E.phone(t, ["client", "buyer"], 0), E.phone(t, ["client", "buyer"], 0, None, F.lit("client"))),
        "discounts": (totals.discounts(t).cast("string"), F.when(t.isNull(), "[]").otherwise(totals.discounts(t, F.lit("remise")).cast("string"))),
    }
    for word in ("total", "timbre", "sous", "client", "izmir", "raison", "remise", "kg"):
        pairs["word " + word] = (low.contains(word), t.rlike(X.IU + word))
    for name, (patterns, _) in totals.LABELS.items():
        pairs["mark " + name] = (totals.labelled_among(totals.label_lines(low), name), totals.labelled_money(lines, name))
    got = rows.select("t", *[F.struct(a.alias("a"), b.alias("b")).alias(n) for n, (a, b) in pairs.items()]).collect()
    for r in got:
        for n in pairs:
            assert r[n]["a"] == r[n]["b"], (n, r["t"])
    told = {n: [r["mark " + n]["a"] and float(r["mark " + n]["a"]) for r in got[:4]] for n in ("subtotal", "stamp_duty", "total_amount", "net_payable")}
    assert told == {"subtotal": [12.0, None, None, None], "stamp_duty": [0.6, None, None, None], "total_amount": [15.6, None, 9.0, None], "net_payable": [None, None, 7.0, None]}


def test_wide_fields_look_once(spark):
    from billquarry.operators import fields as E

    wide = plan(E.wide_fields(spark.createDataFrame([(1, "x")], "doc_id int, text string")))
    assert wide.count("[tmns]") == 1  # lines with a label were looked for in all lines for every amount
    assert wide.count("_common_expr") == 0  # a group that a pattern found was looked for twice under a condition


def test_line_passages_carry_numbers(spark):
    # every pending line was copied at every line; a fold over numbers cuts the same passages
    from billquarry.operators import passages as P

    text = "A\n\n --- Page 2 ---\n\xa0b \n" + "\n".join(f"ligne {i}" for i in range(9)) + "\nDésignation | Prix\nx | 1\n\t\ny | 2\nTotal TTC 3\n--- Page 99999999999 ---\nfin\n---page 7---\n\n" + "z" * 460 + "\n" + "w" * 300 + "\nTotal HT 1\n--- Page 8 ---"
    rows = P.line_passages(spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "--- Page 3 ---"), (5, "\n \nseul")], "doc_id int, text string")).collect()
    got = [(r["doc_id"], r["chunk_index"], r["source_id"], r["kind"], r["line_start"], r["line_end"], r["text"][:7]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["chunk_index"]))]
    assert got == PASSAGES
    assert "ends" not in plan(P.line_passages(spark.createDataFrame([(1, text)], "doc_id int, text string")))


PASSAGES = [
    (1, 0, "P1:L1-1", "text", 1, 1, "A"),
    (1, 1, "P2:L1-6", "text", 4, 9, "b\nligne"),
    (1, 2, "P2:L6-10", "text", 9, 13, "ligne 4"),
    (1, 3, "P2:L11-14", "table", 14, 17, "Désigna"),
    (1, 4, "P2:L15-17", "text", 18, 20, "Total T"),
    (1, 5, "P7:L2-2", "text", 23, 23, "zzzzzzz"),
    (1, 6, "P7:L2-3", "text", 23, 24, "zzzzzzz"),
    (1, 7, "P7:L3-4", "text", 24, 25, "wwwwwww"),
    (5, 0, "P1:L3-3", "text", 3, 3, "seul"),
]


def test_words_are_looked_for_before_patterns(spark, data):
    from billquarry import vocabulary as V
    from billquarry.functions import text as X
    from billquarry.operators import grounding as G

    assert X.needed(r"\bnet\s+[aà]\s+payer\b") == ["payer"] and X.needed(r"t\.?v") is None and X.needed(r"\btotal?") is None
    assert X.word_first(r"\btotal\s+ht\b") == r"total(?<=\btotal)\s+ht\b" and X.word_first(r"\btotals?\b") == r"total(?<=\btotal)s?\b"
    texts = [
        "facture n 123 total ht 5", "subtotal", "xtotal total_ totalé", "net\tà\npayer", "net a  payer tva", "المبلغ  الجملي", "المبلغ", "مجموع", "taxes", "tax", "le montant\x85ttc", "price.", "", None,
        "totaĺ x́total", "FACTU RE N° A12", "İNVOICE", "ınvoice ſ", "bon de livraison 12/01/2020", "Bon de  livraison facture", "عرض سعر", "DEVIS", "proforma",
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    low = F.lower("text")
    found = rows.select("text", *[X.has_pattern(low, p).alias(f"a{i}") for i, p in enumerate(V.AMOUNT_LABEL_PATTERNS)], *[low.rlike(X.U + p).alias(f"b{i}") for i, p in enumerate(V.AMOUNT_LABEL_PATTERNS)])
    for r in found.collect():
        assert [r[f"a{i}"] for i in range(16)] == [r[f"b{i}"] for i in range(16)], r["text"]
    blocks = F.array(F.struct(F.lit("table").alias("label"), F.lit(0.8).alias("score")))
    out = G.classify_with_layout(G.classify(rows, keep=["text"]), F.col("text"), blocks)
    plain = X.match(F.col("text"), V.INVOICE_WORD), low.rlike(X.U + V.INVOICE_WORD), low.rlike(X.U + V.INVOICE_NUMBER_HINT), low.rlike(X.U + V.OTHER_TITLE) | (low.rlike(X.U + V.DELIVERY_TITLE) & ~low.rlike(X.U + V.INVOICE_WORD))
    for r in out.select("*", *[p.alias(f"p{i}") for i, p in enumerate(plain)]).collect():
        assert (r["labelled"], r["numbered"], r["other_title"]) == (r["p1"], r["p2"], r["p3"]), r["text"]
        assert "_sought" not in r and (r["layout_score"] == 15 or r["layout_score"] >= 0 or r["text"] is None)
    text = plan(entry.queries()["q_classify_layout"](spark, data))
    assert text.count("subtotal(?<=") == 1 and "Contains(_low" in text


def test_section_hints_try_few_patterns(spark):
    # every line was tried by up to ten patterns
    from billquarry.functions import text as X

    lines = {
        "Désignation | Qté | Prix": "line_items", "DESCRIPTION": None, "Total HT 5": "totals", "code T.V.A : total": None, "Identifiant fiscal": None, "t.va 19%": "totals", "TVA": "totals", "Montant H.T": "totals",
        "Payée en espèces": None, "paye en especes": "payment_information", "RIB : 1": "payment_information", "Client : A date : B": "other", "Cachet client": None, "Bill To x": "customer",
        "Émetteur X": "supplier", "FACTURE 1": "invoice_info", "المورد : س": "supplier", "تاريخ": "invoice_info", "البيان كمية": "line_items", "subtotals": None, "attractive": None, "": None,
    }
    got = spark.createDataFrame([(s,) for s in lines], "s string").select("s", X.section_hint(F.col("s")).alias("h"))
    assert {r["s"]: r["h"] for r in got.collect()} == {**lines, "Payée en espèces": "payment_information", "Total HT 5": "totals"}
    text = plan(got)
    assert text.count("Contains(") > 20


def test_pages_of_sections_are_found_once(spark, data):
    # lines were cut from the texts for the blocks' pages twice
    assert plan(entry.queries()["txt_passages_sections"](spark, data)).count("--- Page 1 ---") == 1


def test_party_zones_and_roles_try_few_patterns(spark, data):
    # every line and cell was tried by up to five patterns, the identifier's letters were made at every line
    from billquarry import vocabulary as V
    from billquarry.functions import text as X
    from billquarry.operators import fields as E
    from billquarry.operators import grounding as G

    texts = [
        "NOM DU CLIENT : A\nMF : 1\nDéSIGNATION\nx", "sold\tto | B\nprix unitaire", "Raison Sociale X\nCode  client 7\nfin", "raiſon sociale Y\nx\ncode client", "raison sociale Z", "Client : C", "CUſTOMER: ſ\nQuantity", "", None,
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    zones = [r[0] for r in rows.select(G.customer_zone(F.col("text"))).collect()]
    assert zones == ["NOM DU CLIENT : A\nMF : 1", "sold\tto | B", "Raison Sociale X\nCode  client 7\nfin", "raiſon sociale Y\nx\ncode client", "", "", "CUſTOMER: ſ", "", ""]
    cells = ["Fournisseur : A", "ÉMETTEUR", "Client", "clients", "ſeller", "Livré à", "Ship  to", "RAISON SOCIALE", "raiſonsocial", "Bill to x", "Items", "quantité", "--- Page 2", "unsold to", ""]
    docs = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "doc_id int, text string")
    plain = F.coalesce(*[F.when(F.col("cell").rlike(X.IU + p), F.lit(n)) for n, p in V.ROLE_WORDS.items()], F.when(F.col("cell").rlike(X.IU + r"raison\s*sociale?"), F.lit("customer")))
    told = E.cell_roles(docs).select("cell", "role", plain.alias("p"), F.col("cell").rlike(X.IU + V.ROLE_ZONE_END).alias("end")).collect()
    assert len(told) == len(cells) - 1 and all(r["role"] == (None if r["end"] else r["p"]) for r in told)
    assert plan(entry.queries()["q_party_conflicts"](spark, data)).count("--- Page 1 ---") == 0  # written once, read twice


def test_postings_are_sorted_by_trigram_alone(spark, data, monkeypatch):
    # rows of equal trigrams were compared by their ids as well, most of what sorting costs
    from billquarry.operators import search
    from billquarry.storage import written

    plans = []
    monkeypatch.setattr(search, "written", lambda df, *args: plans.append(plan(df)) or written(df, *args))
    rows = spark.createDataFrame([(i, f"abc{i}", "xabcx") for i in range(50)], "id long, a string, b string")
    index = search.text_index(rows, "id", ["a", "b"])
    assert "Sort [trigram#" in plans[1] and "ASC NULLS FIRST], false" in plans[1].split("Sort [trigram#")[1].split("\n")[0] and ", id#" not in plans[1].split("Sort [")[1].split("]")[0]
    assert sorted(r["id"] for r in index.candidates(["a"], "ABC4").collect()) == [4, *range(40, 50)]
    assert index.postings.count() == sum(len({f"abc{i}"[k : k + 3] for k in range(len(f"abc{i}") - 2)}) for i in range(50)) + 50 * 3


def test_amounts_are_found_in_lowered_texts(spark, data):
    # amounts were looked for without regard to case in every proposal's copy of the text
    from billquarry.functions import text as X
    from billquarry.operators import totals

    texts = [*ODD, "TOTAL HT TND 1 234,500", "Tımbre Fıscal : 0,600\ntotal 7,000\nTotal HT 8", "T.V.A (19%) 3,000 €\nmontant TTC 5,000USD", "المبلغ دون احتساب الأداء 12", "Timbre fiscal\n0,600"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    both = [F.struct(totals.source_amounts(F.col("t"), n).alias("a"), totals.source_amounts(X.sought(F.col("t")), n, True).alias("b")).alias(n) for n in totals.SOURCE_LABELS]
    got = rows.select("t", *both).collect()
    assert all(r[n]["a"] == r[n]["b"] for r in got for n in totals.SOURCE_LABELS) and any(r["subtotal"]["a"] for r in got)
    assert "low#" in plan(entry.queries()["q_evidence_guard"](spark, data))
