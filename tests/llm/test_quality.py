"""Counts against a plain count, sketches against their rank, and defined results for edge rows."""

import random
import re

from billquarry.llm import quality, queries
from tests.test_queries import table


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(lines),
        sum(a == b for a, b in zip(words, words[1:])),
    )


def test_counts_match_a_plain_count(monkeypatch):
    chance = random.Random(5)
    letters = ["a", "b", "é", "日", " ", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "#", "|", "$"]
    monkeypatch.setattr(quality, "_BLOCK", 50)
    for n in [0, 1, 5, 50, 200, 400] * 20:
        text = "".join(chance.choice(letters) for _ in range(n)) + " ".join(chance.choice(["x y z", "q"]) for _ in range(n // 10))
        assert quality.base_counts(text) == plain_counts(text)
    assert quality.base_counts(None) == (0,) * 7


def test_edge_rows_and_group_limits(spark):
    plain = " ".join(f"word{i}" for i in range(40))
    junk = " ".join(f"w{i}###" for i in range(40))
    rows = [(i, plain.replace("word", "abcd"[i % 4] * 4), "en", "s") for i in range(150)]
    rows += [(900, junk, "en", "s"), (901, None, None, None), (902, "", "en", None), (903, plain, None, "s"), (None, plain, "en", "s"), (None, plain, "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 AS kept", "2 AS n_words", "3 AS row")
    got = {}
    for r in quality.judge(docs).collect():
        got.setdefault(r.doc_id, []).append((r.base_failed, r.kept))
    assert got.pop(900) == [(False, False)] and got.pop(901) == [(True, False)] and got.pop(902) == [(True, False)]
    assert got.pop(None) == [(False, True)] * 2 and set(map(tuple, got.values())) == {((False, True),)}
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == 153
    assert quality.judge(docs.where("false")).count() == quality.keep_good(docs.where("false")).count() == 0


def test_limits_stay_right_where_a_third_of_a_group_is_junk(spark):
    good = [(i, " ".join(f"word{(i * 31 + k) % 977}" for k in range(60)), "en", "hot") for i in range(400)]
    bad = [(1000 + i, " ".join(f"word{(i * 17 + k) % 977}$$$" for k in range(60)), "en", "hot") for i in range(200)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string")
    assert all(r.kept == (r.doc_id < 1000) for r in quality.judge(docs).collect())


def plain_limit(values, factor, step):
    """The body of sorted values ends before the first jump between neighbouring quantiles."""
    ordered = sorted(values)
    at = [ordered[-(-k * len(ordered) // 100) - 1] for k in quality.SHARES]
    for now, following in zip(at, at[1:]):
        if following > factor * now + step:
            return factor * now + step
    return factor * at[-1] + step


def test_each_group_has_limits_of_its_own(spark):
    """Buckets up to 63 are exact, so the limits of small values equal those of the values themselves."""
    chance = random.Random(8)
    rows, values = [], {}
    for source, spread, junk in [("calm", 5, 0), ("wide", 60, 0), ("soiled", 20, 130)]:
        for n in range(400):
            doubled = 900 if n < junk else chance.randrange(spread)
            values.setdefault(source, []).append(doubled)
            rows.append(("en", source, 1000, 5000, 0, 0, 0, 10, doubled))
    counts = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{c} long" for c in quality.COUNTS))
    got = {r.source: r.doubled_median + r.doubled_above for r in quality.limits(counts).collect()}
    assert got == {s: plain_limit(v, *quality.MEASURES["doubled"][1:3]) for s, v in values.items()}
    assert len(set(got.values())) == 3 and got["soiled"] < 130


def test_sql_gives_the_same_rows(spark, data, con_llm):
    df = queries.op1_quality_rules(spark, data)
    result = con_llm.execute(queries.SQL["op1_quality_rules"])
    assert table(df.columns, df.collect()) == table([c[0] for c in result.description], result.fetchall())
