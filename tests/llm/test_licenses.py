"""Base phrases against a plain search, notices found where they stand, and the SQL of the query."""

import re

from billquarry.llm import licenses, queries
from tests.test_queries import table


def plain_base(text):
    lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    starts = [(i, label) for i in range(len(words)) for p, label in licenses.BASE_PHRASES.items() if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in starts]
    return len(words), len(starts), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in starts}))


def test_base_and_method_labels(spark):
    bsd = licenses.TEMPLATES[6][1]
    texts = [
        None, "", "MIT License, mit-license; the Apache LICENSE", "General public license general public license", "mit licenses", "mİt license éMIT license",
        "x " * 70_000 + "released under the MIT License", f"Some words first. {bsd.capitalize()}: more", bsd.replace("binary", "other"), "license " * 50,
        "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.", "free of charge to any person obtaining a copy of this software",
        "1 2 3 \x7f\x80 ß", licenses.TEMPLATES[0][1].replace("hereby", "hereby also"), bsd + " " + licenses.TEMPLATES[12][1],
    ]
    rows = list(enumerate(texts)) + [(None, texts[2]), (2, texts[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS words", "2 AS label", "3 AS text_hash", "4 AS score")
    got = {}
    for r in licenses.scan(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    for doc_id, text in rows:
        for r in got[doc_id]:
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_base(text)
            assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert len(got[2]) == 2 and len(got[None]) == 1
    labels = {i: rows_[0].labels for i, rows_ in got.items()}
    assert labels[7] == "bsd" and labels[8] == "" and labels[10] == "cc-by-nc" and labels[11] == "apache" and labels[12] == "" and labels[15] == "bsd,unlicense"
    assert licenses.scan(docs.where("false")).count() == 0


def test_every_template_is_found_by_its_own_text(spark):
    docs = spark.createDataFrame([(n, f"before it {text} and after") for n, (_, text, _) in enumerate(licenses.TEMPLATES)], "doc_id long, text string")
    for r in licenses.scan(docs).collect():
        assert licenses.TEMPLATES[r.doc_id][0] in r.labels.split(",")


def test_sql_gives_the_same_rows(spark, data, con_llm):
    df = queries.op10_license_scan(spark, data)
    result = con_llm.execute(queries.SQL["op10_license_scan"])
    assert table(df.columns, df.collect()) == table([c[0] for c in result.description], result.fetchall())
