"""Passages, retrieval without SQL twin, sources on real files."""

import json
import math
import re
import time
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from billquarry.operators import lines as L
from billquarry.operators import passages as P
from billquarry.operators import retrieval as T
from billquarry.plans import rendering as R
from billquarry.sources import annotations, files, records
from billquarry.vocabulary import FIELD_QUERIES


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_chunks_pack_paragraphs(spark):
    a, b, c = "a" * 400, "b" * 400, "c" * 2000
    got = [r["text"] for r in P.chunks(docs_of(spark, [f"{a}\n\n{b}\n \n{c}"])).orderBy("chunk_index").collect()]
    assert got[0] == f"{a}\n\n{b}"
    assert [len(t) for t in got[1:]] == [900, 900, 440] and all(len(t) <= 900 for t in got)


def test_chunks_of_pages(spark):
    got = P.chunks(docs_of(spark, ["lost\n--- Page 3 ---\nun\n--- PAGE 4 ---\n \n--- Page 5 ---\ndeux"])).orderBy("chunk_index").collect()
    assert [(r["page"], r["text"]) for r in got] == [(3, "un"), (5, "deux")]


def test_line_passages_cover_all_lines(spark, data):
    docs = R.texts(spark, data).select("doc_id", "text").limit(200).persist()
    found = P.line_passages(docs).collect()
    by_doc = defaultdict(list)
    for r in found:
        by_doc[r["doc_id"]].append(r)
    numbered = defaultdict(set)
    for r in L.numbered_lines(docs).collect():
        numbered[r["doc_id"]].add(r["line_id"])
    scope = {(r["doc_id"], r["line_id"]): r["in_table"] for r in L.table_scope(docs).collect()}
    for doc, rows in by_doc.items():
        seen = set()
        for r in rows:
            span = list(range(r["line_start"], r["line_end"] + 1))
            seen.update(span)
            assert len(span) <= 6 and r["text"].count("\n") + 1 == len(span)
            assert len(r["text"]) <= 450 or len(span) == 1
            assert len({scope[(doc, i)] for i in span}) == 1
            assert (r["kind"] == "table") == scope[(doc, span[0])]
        assert seen == numbered[doc]


def test_section_passages_repeat_the_header(spark):
    rows = ["Fournisseur : X", "Désignation | Quantité"] + [f"article numéro {i} " + "x" * 80 for i in range(20)] + ["Total TTC 12,000"]
    lines = spark.createDataFrame([(1, i + 1, 1, t, None) for i, t in enumerate(rows)], "doc_id long, line_id int, page int, text string, block string")
    got = P.section_passages(lines).orderBy("chunk_index").collect()
    tables = [r for r in got if r["section"] == "line_items"]
    assert got[0]["section"] == "supplier" and got[-1]["section"] == "totals"
    assert len(tables) > 1 and all(r["text"].startswith("Désignation") and len(r["text"]) <= 1000 for r in tables)
    covered = {int(i) for r in got for i in r["line_ids"].split(",")}
    assert covered == set(range(1, len(rows) + 1)) and len({r["chunk_id"] for r in got}) == len(got)


def words(text):
    return re.findall(r"\w+", text.lower())


def test_field_bm25_equals_brute_force(spark):
    texts = [
        "facture numero 12\ndate facture 2020", "total ttc 12 montant\nclient abc date\n\nfournisseur",
        "timbre fiscal\ntotal ht montant tva\nreference designation prix\nvis 3 4 12",
    ]
    rows = [(d, i, line) for d, t in enumerate(texts) for i, line in enumerate(x for x in t.split("\n") if x)]
    got = {(r["doc_id"], r["field"], r["rank"]): (r["chunk_index"], r["score"]) for r in T.field_bm25(spark.createDataFrame(rows, "doc_id int, chunk_index int, text string")).collect()}
    want = {}
    for d in {r[0] for r in rows}:
        counts = [(i, Counter(words(t))) for dd, i, t in rows if dd == d]
        average = sum(sum(c.values()) for _, c in counts) / len(counts)
        frequency = Counter(w for _, c in counts for w in c)
        for field, q in FIELD_QUERIES.items():
            scored = []
            for i, c in counts:
                s = sum(
                    math.log(1 + (len(counts) - frequency[w] + 0.5) / (frequency[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / average))
                    for w in set(words(q)) if c[w]
                )
                if s > 0:
                    scored.append((-round(s, 4), i))
            for rank, (s, i) in enumerate(sorted(scored)[:3], 1):
                want[(d, field, rank)] = (i, -s)
    assert set(got) == set(want)
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-4 for k in want)


def test_overrides(spark):
    kinds = ["text", "text"] + ["table"] * 15
    passages = spark.createDataFrame([(1, i, k, "x") for i, k in enumerate(kinds)], "doc_id int, chunk_index int, kind string, text string")
    ranked = spark.createDataFrame([(1, "vendor_name", 1, 1, 2.0), (1, "vendor_name", 0, 2, 1.0), (1, "items", 5, 1, 1.0), (1, "date", 1, 1, 1.0)], "doc_id int, field string, chunk_index int, rank int, score double")
    got = T.with_field_overrides(ranked, passages, cap=12).collect()
    every = sorted((r["rank"], r["chunk_index"], r["omitted"]) for r in T.with_field_overrides(ranked, passages).collect() if r["field"] == "items")
    assert every == [(i + 1, i + 2, 0) for i in range(15)]
    vendor = sorted((r["rank"], r["chunk_index"]) for r in got if r["field"] == "vendor_name")
    table = sorted((r["rank"], r["chunk_index"], r["omitted"]) for r in got if r["field"] == "items")
    assert vendor == [(1, 0), (2, 1)]
    assert table == [(i + 1, i + 2, 3) for i in range(12)]
    assert [r["chunk_index"] for r in got if r["field"] == "date"] == [1]


def test_round_robin_budget(spark):
    passages = spark.createDataFrame([(1, 0, "a" * 50), (1, 1, "b" * 60), (1, 2, "c" * 30)], "doc_id int, chunk_index int, text string")
    ranked = spark.createDataFrame([(1, "date", 0, 1), (1, "date", 2, 2), (1, "invoice_number", 1, 1), (1, "due_date", 0, 1)], "doc_id int, field string, chunk_index int, rank int")
    got = T.round_robin(ranked, passages, budget=100).first()
    # invoice_number takes 60, date does not fit, due_date neither; rank two takes 30
    assert (got["used"], got["taken"], got["dropped"]) == (90, 2, 2)


def test_split_csv_files(spark, tmp_path):
    for split, body in {"train": "﻿img_path,annot_path\n a.jpg , a.json\n,b.json\n", "dev": "img_path,annot_path\nc.jpg,\n", "test": "img_path,annot_path\nd.jpg,d.json\n"}.items():
        (tmp_path / f"strat1_{split}.csv").write_text(body, encoding="utf-8")
    got = sorted((r["split"], r["image_name"], r["annotation_path"]) for r in annotations.read_split_csv(spark, str(tmp_path)).collect())
    assert got == [("test", "d.jpg", "dataset/Annotations/Original_Format/d.json"), ("train", "a.jpg", "dataset/Annotations/Original_Format/a.json")]


def test_file_listing_and_manifest(spark, tmp_path):
    (tmp_path / "images").mkdir()
    (tmp_path / "images" / "x.JPG").write_bytes(b"12345")
    (tmp_path / "notes.txt").write_text("n")
    listing = files.list_files(spark, str(tmp_path)).persist()
    got = {r["kind"]: r["size_bytes"] for r in files.describe_files(listing).collect()}
    assert got == {"image": 5, "metadata": 1}
    assert files.changed_files(listing, listing).count() == 0
    assert files.changed_files(listing, listing.filter("path like '%txt'")).count() == 1
    assert files.admitted(listing).count() == 1


def test_keyed_write_and_records(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, at int, v string")
    annotations.write_keyed(df, str(tmp_path / "t"), ["k"], ["at"])
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(1, "b"), (2, "c")]
    docs = spark.createDataFrame([(1, "invoice", 0.9, "A1", "10", None)], "doc_id int, document_type string, classification_confidence double, invoice_number string, total_amount string, status string")
    records.append_records(records.document_record(docs), str(tmp_path / "r"))
    records.append_records(records.document_record(docs), str(tmp_path / "r"))
    back = spark.read.parquet(str(tmp_path / "r"))
    assert back.count() == 2 and back.first()["status"] == "draft"


def test_every_invoice_is_paged_by_one_rule(spark):
    """Invoices of 64, 65 and 500 lines: consecutive lines, pages of 64, nothing gathered."""
    base = spark.range(500).select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("n")) for i, n in ((7, 64), (8, 65), (9, 500))])).alias("of"), "id")
    lines = base.where("id < of.n").selectExpr("of.i AS invoice_id", "id + 1 AS line", "'x' AS description", "1L AS quantity", "3L AS total_cents", "5L AS part_id", "1L AS source_id")
    invoices = spark.createDataFrame([(n, f"00000{n}", "validated", 100) for n in (7, 8, 9)], "id long, invoice_number string, status string, cents long")
    got = records.export_lines(invoices, lines).groupBy("invoice_id", "page").agg(F.min("line").alias("low"), F.max("line").alias("high")).collect()
    pages = {(r.invoice_id, r.page): (r.low, r.high) for r in got}
    assert pages == {(i, p): (64 * p + 1, min(64 * p + 64, n)) for i, n in ((7, 64), (8, 65), (9, 500)) for p in range((n + 63) // 64)}
    names = [r.file_name for r in records.export_headers(invoices).collect()]
    assert len(set(names)) == len(names) == 3


def test_json_lines_export_is_readable(spark, tmp_path):
    lines = spark.createDataFrame([(7, 1, "x", 1, 10, 1, 1)], "invoice_id long, line int, description string, quantity long, total_cents long, part_id long, source_id long")
    invoices = spark.createDataFrame([(7, "000007", "validated", 100), (8, "000008", "draft", 1)], "id long, invoice_number string, status string, cents long")
    records.write_export(invoices, lines, str(tmp_path / "j"))
    rows = [json.loads(line) for f in (tmp_path / "j" / "headers").glob("*.json") for line in f.read_text().splitlines()]
    assert [r["file_name"] for r in rows] == ["facture_000007.json"]
    headers, back = records.read_export(spark, str(tmp_path / "j"))
    assert [r.id for r in headers.collect()] == [7] and [(r.invoice_id, r.line, r.page) for r in back.collect()] == [(7, 1, 0)]


def test_long_document_is_cut_in_linear_time(spark):
    """40,000 paragraphs: gathered pieces are put away in blocks, so that no step copies all of them."""
    text = "\n".join(f"line {i}" + ("\n" if i % 3 == 0 else "") for i in range(120_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.time()
    count, longest = P.chunks(docs).select(F.count("*"), F.max(F.length("text"))).first()
    assert count > 1000 and longest <= 900 and time.time() - start < 60


def test_passages_cover_every_line_beyond_one_block(spark):
    text = "\n".join(f"line {i}" for i in range(3000))
    found = P.line_passages(spark.createDataFrame([(1, text)], "doc_id long, text string")).select("line_start", "line_end").collect()
    assert len(found) > 2 * 256 and {n for r in found for n in range(r.line_start, r.line_end + 1)} == set(range(1, 3001))
