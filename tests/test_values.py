"""Edge cases of printed values."""

import datetime

import pytest
from pyspark.sql import functions as F

from billquarry.functions import dates, display, parties
from billquarry.functions import money as M
from billquarry.functions import text as X
from billquarry.operators import fields, items, totals
from billquarry.operators import reconcile as C


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "printed,amount",
    [
        ("5.534.100", 5534.1), ("1.603,641", 1603.641), ("1,603.641", 1603.641), ("12,600", 12.6), ("12.600", 12.6), ("1.22.3", 1223.0),
        ("TND 6 064,634", 6064.634), ("abc", 0.0), ("1,2,3", 0.0), ("-5", -5.0), ("", 0.0),
    ],
)
def test_ocr_amount(spark, printed, amount):
    assert float(one(spark, M.ocr_amount, printed)) == pytest.approx(amount)


@pytest.mark.parametrize("printed,amount", [("1 234,5", 1234.5), ("12,600", 12.6), ("12 TND", None), ("", None), ("-1", None), ("1 000", 1000.0)])
def test_strict_amount(spark, printed, amount):
    got = one(spark, M.strict_amount, printed)
    assert got is None if amount is None else float(got) == pytest.approx(amount)


def test_lost_comma(spark):
    row = spark.sql("SELECT CAST(6064634 AS decimal(20,6)) a, CAST(6064.634 AS decimal(20,6)) b, CAST(0 AS decimal(20,6)) z")
    got = row.select(M.scale_fixed(F.col("a"), F.col("b")).alias("x"), M.scale_fixed(F.col("a"), F.col("z")).alias("y")).first()
    assert float(got["x"]) == 6064.634 and float(got["y"]) == 6064.634


@pytest.mark.parametrize(
    "printed,day", [("2019-11-28", (2019, 11, 28)), ("28/11/2019", (2019, 11, 28)), ("1.2.2020", (2020, 2, 1)), ("5 Mar 2021", (2021, 3, 5)), ("31/02/2020", None), ("x", None)]
)
def test_normalized_date(spark, printed, day):
    assert one(spark, dates.normalized_date, printed) == (datetime.date(*day) if day else None)


def test_impossible_date_is_skipped(spark):
    assert one(spark, dates.printed_date, "20-14-2019 puis 28-11-2019") == "28-11-2019"


def test_rate_is_not_an_amount(spark):
    text = "FACTURE\nTVA (19%)\nTotal TTC 12,600"
    assert one(spark, lambda c: totals.labelled_money(totals.tidy_lines(c), "tax_amount"), text) is None
    assert float(one(spark, lambda c: totals.labelled_money(totals.tidy_lines(c), "total_amount"), text)) == 12.6


def test_amount_below_or_above_label(spark):
    assert float(one(spark, lambda c: totals.labelled_money(totals.tidy_lines(c), "subtotal"), "Total HT\n4650,000 TND\nTVA")) == 4650
    assert float(one(spark, lambda c: totals.labelled_money(totals.tidy_lines(c), "total_amount"), "5534,100\nTOTAL TTC\nfin")) == 5534.1


def test_table_header_is_no_subtotal(spark):
    assert one(spark, lambda c: totals.labelled_money(totals.tidy_lines(c), "subtotal"), "Désignation | Prix unitaire | Total HT\n12,000") is None


def test_negated_cash(spark):
    assert one(spark, fields.cash_payment, "non payée en espèces") is None
    assert one(spark, fields.cash_payment, "réglée : payée en espèces") == "payée en espèces"


def test_product_code_is_never_the_quantity(spark):
    got = one(spark, lambda c: items.free_items(X.split_lines(c)), "Code Article\nVis N6/5 acier | 12 | 4,500 | 54,000")
    assert [(float(r["quantity"]), float(r["unit_price"]), float(r["total"])) for r in got] == [(12.0, 4.5, 54.0)]


def test_carried_description(spark):
    got = one(spark, lambda c: items.free_items(X.split_lines(c)), "Code\nPeinture blanche mate\nseau 3 | 10,500 | 31,500")
    assert len(got) == 1 and float(got[0]["total"]) == 31.5


def test_whole_identifier(spark):
    df = spark.createDataFrame([("B123", "RC : B 123 ;"), ("B123", "RC B1234"), ("B123", "xB123"), ("B123", "B123-7")], "v string, t string")
    assert [r[0] for r in df.select(parties.whole_identifier(F.col("v"), F.col("t"))).collect()] == [True, False, False, False]


def test_fold(spark):
    assert one(spark, X.fold, "Éçà Straße أحمد إلى ﬁn ½") .startswith("eca strasse احمد الى")


def test_same_evidence(spark):
    df = spark.createDataFrame([("12,600", "12.6"), ("12.600", "12,6000"), ("a b", "AB"), ("12", "12.0")], "a string, b string")
    assert [r[0] for r in df.select(display.same_evidence(F.col("a"), F.col("b"))).collect()] == [True, True, True, False]


def test_demo_invoice_stays_undecided_without_complete_table(spark):
    """Two lines priced with tax plus stamp give the total, but an unproven table keeps it undecided."""
    base = spark.sql(
        """SELECT CAST(12.6 AS decimal(20,6)) total, CAST(NULL AS decimal(20,6)) subtotal, CAST(NULL AS decimal(20,6)) vat, CAST(0.6 AS decimal(20,6)) stamp,
                  CAST(NULL AS decimal(20,6)) discount, CAST(NULL AS decimal(20,6)) extra, CAST(NULL AS decimal(20,6)) adjustment, CAST(array() AS array<string>) unproven,
                  CAST(array() AS array<struct<label:string,rate:decimal(20,6),amount:decimal(20,6),line_id:int>>) taxes, 'timbre 0,600' context, CAST(NULL AS string) basis,
                  CAST(NULL AS string) discount_scope, false vat_complete, false tax_exempt, array(CAST(6 AS decimal(20,6)), CAST(6 AS decimal(20,6))) ttc_lines, x table_complete, 'TND' currency
           FROM VALUES (false), (true) t(x)"""
    )
    got = {r["table_complete"]: r["status"] for r in C.reconcile(base).collect()}
    assert got == {False: "INSUFFICIENT_EVIDENCE", True: "VALID"}


def test_discount_columns_and_wrapped_rows(spark):
    text = "Désignation | Quantité | Remise 5% | Total\nVis | 2 | 1,500 | 9,000\nsuite de la vis\nClou | 1 | 0,500 | 1,000\nTotal\n"
    got = one(spark, totals.discounts, text)
    assert [(e["scope"], float(e["amount"]), float(e["rate"]), e["line_id"]) for e in got] == [("item", 1.5, 5.0, 2), ("item", 0.5, 5.0, 4)]
