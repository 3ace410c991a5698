"""Searches through trigrams, deep pages, party conflicts and files of splits on small fixtures."""

import random

from pyspark.sql import functions as F

from billquarry.operators import fields, grounding, search


def test_indexed_searches_have_the_rows_of_direct_ones(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abAB1%_é ") for _ in range(rng.randrange(12)))
    names = ["filename", "supplier_name", "customer_name", "invoice_number", "normalized_json", "extracted_text"]
    rows = [(i, *(None if rng.random() < 0.1 else word() for _ in names), rng.choice(["draft", "validated"])) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} string" for n in names) + ", status string")
    index = search.text_index(df, "id", names, str(tmp_path / "index"))
    for given in ({"search": "aba"}, {"search": "AB1a"}, {"search": "%_é"}, {"search": " b1 "}, {"supplier": "aab", "status": "draft"}, {"company": "bab", "tax_id": "1a"}, {"invoice_name": "zzz"}, {}):
        want = sorted(r.id for r in search.search_invoices(df, **given).collect())
        for held in (index, search.open_text_index(spark, str(tmp_path / "index"), "id")):
            assert sorted(r.id for r in search.search_indexed(held, **given).collect()) == want
    found = index.candidates(names, "ab1a")
    assert found.count() < 100 and index.candidates(names, "ab") is None


def test_deep_pages(spark):
    df = spark.range(5000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7 ELSE id % 11 END AS day")
    order, ranges = [F.desc("day"), F.col("id")], [-F.col("day"), F.floor(F.col("id") / 64)]
    want = [r.id for r in df.orderBy(*order).collect()]
    for page in (1, 9, 40, 63, 98, 99, 100, 101, 100_000):
        got = search.page_of(df, order, page, 50, ranges=ranges, shallow=100).orderBy(*order).collect()
        assert [r.id for r in got] == want[(page - 1) * 50 : page * 50]
        assert all((r.total, r.total_pages) == (5000, 100) for r in got)
    here, before = search.located(df, ranges, 4000, 50)
    assert here.count() <= 128 and before <= 4000
    empty = search.page_of(df.where("id < 0"), order, 50, 50, ranges=ranges, shallow=100)
    assert empty.collect() == []


def conflicts(spark, text, **values):
    named = {f"{p}_{k}": None for p in ("vendor", "customer") for k in grounding.PARTY_VALUES} | values
    docs = spark.createDataFrame([(1, text, *named.values())], "doc_id int, text string, " + ", ".join(f"{n} string" for n in named))
    return sorted((r.field, r.reason) for r in grounding.party_conflicts(docs, fields.cell_roles).collect())


def test_party_conflicts(spark):
    text = "Fournisseur : ATLAS | Client : BORNE SA\nMF : 1234567A/M/000 | MF : 7654321B/P/000\n"
    zone = "Nom du client : BORNE SA\nMF : {}\nDésignation\n"
    assert conflicts(spark, text, vendor_name="ATLAS", vendor_tax_id="1234567A/M/000", customer_name="BORNE SA") == []
    assert conflicts(spark, text, vendor_name="Commercial Invoice") == [("vendor_name", "heading_word")]
    assert conflicts(spark, text, vendor_name="borne s.a.") == [("vendor_name", "explicit_customer")]
    # the identifier in the customer block: its own place there, or only inside a longer one
    assert conflicts(spark, text + zone.format("1234567A/M/000"), vendor_tax_id="1234567A/M/000") == [("vendor_tax_id", "identifier_in_customer_zone")]
    assert conflicts(spark, text + zone.format("1234567A/M/000/22"), vendor_tax_id="1234567A/M/000") == []
    # nowhere whole: no owner
    assert conflicts(spark, zone.format("1234567A/M/000/22"), vendor_tax_id="1234567A/M/000") == [("vendor_tax_id", "identifier_in_customer_zone")]
    same = {f"{p}_{k}": v for p in ("vendor", "customer") for k, v in (("address", "9 rue X"), ("phone", "71 222 333"), ("email", "a@b.tn"), ("tax_id", "7654321B/P/000"))}
    assert conflicts(spark, text, **same, customer_name="BORNE SA") == [(f"vendor_{k}", "same_as_customer") for k in ("address", "email", "phone", "tax_id")]
    assert conflicts(spark, text, **same, customer_name="BOR") == conflicts(spark, text, **same) == conflicts(spark, None, **same) == []
