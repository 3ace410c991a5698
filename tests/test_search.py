"""Pruned searches against plain ones: same rows, few pairs compared, and recall where an index may miss something."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from billquarry import vocabulary as V
from billquarry.operators import hybrid, ranking, retrieval, vectors
from billquarry.plans import retrieval_plans as R


def told(df):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())


def plain_bm25(queries, passages, keys, k):
    scores = retrieval.bm25(queries, passages, keys)
    return retrieval.top_k(scores, ["qid"], [F.desc(F.round("bm25", 6)), *[F.col(c) for c in keys]], k).select("qid", *keys, "bm25", "rank")


def test_pruned_bm25_has_the_rows_of_the_plain_one(spark):
    folder, keys = "/root/testdata/sf0.01", ["doc_id", "chunk_index"]
    passages, queries = R.corpus(spark, folder).cache(), R.questions(spark, folder).withColumnRenamed("question", "query")
    index = ranking.build(passages, keys)
    for k in (1, 20):
        got = ranking.search(index, queries, k).select("qid", *keys, "bm25", "rank")
        assert told(got) == told(plain_bm25(queries, passages, keys, k))
    known, blocks = ranking.asked_terms(index, queries)
    pairs = known.select("qid", "term").join(index.postings, "term").select("qid", *keys).distinct().count()
    # the larger the corpus, the fewer: of ten times as many passages a twentieth is left for the twenty best
    for k, share in ((1, 10), (20, 4)):
        assert share * ranking.candidates(index, known, blocks, k)[0].count() < pairs


def test_bm25_edge_rows(spark, tmp_path):
    chance = random.Random(2)
    words = ["le", "total", "ttc", "facture", "a", "b", "c", "d", "e"]
    rows = [(i, " ".join(chance.choices(words, weights=[40, 9, 5, 3, 1, 1, 1, 1, 1], k=chance.randrange(1, 30)))) for i in range(300)]
    rows += [(i + 1000, "total total ttc") for i in range(50)] + [(2000, None), (2001, ""), (2002, "...")]
    passages = spark.createDataFrame(rows, "id long, text string")
    queries = spark.createDataFrame([(1, "total ttc"), (2, "le le le"), (3, "unknown"), (4, None), (5, "a b c d e le total facture"), (6, "")], "qid int, query string")
    index = ranking.build(passages, ["id"], str(tmp_path / "index"))
    again = ranking.open_index(spark, str(tmp_path / "index"), ["id"])
    for k in (1, 5, 400):
        want = told(plain_bm25(queries, passages, ["id"], k))
        assert told(ranking.search(index, queries, k).select("qid", "id", "bm25", "rank")) == want
        assert told(ranking.search(again, queries, k).select("qid", "id", "bm25", "rank")) == want
    empty = ranking.build(passages.where("false"), ["id"])
    assert ranking.search(empty, queries, 3).collect() == []


def cosines(rows, queries, k):
    out = []
    for q, a in queries:
        best = sorted((-round(float(np.dot(a, b) / math.sqrt(np.dot(a, a) * np.dot(b, b))), 6), i) for i, b in rows)[:k]
        out += [(q, i, r) for r, (_, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("count", [600, 3000])
def test_vectors(spark, count):
    """All rows without probes; recall of 0.9 or more with them, at two sizes; copies of one vector are a third of the rows."""
    chance = np.random.default_rng(count)
    centres = chance.normal(size=(30, 24))
    rows = [(i, (centres[i % 30] + 0.45 * chance.normal(size=24)).astype(np.float32).tolist()) for i in range(count)]
    rows += [(10_000 + i, rows[5][1]) for i in range(count // 2)]
    rows = [(i, np.array(v, dtype=np.float32).astype(float).tolist()) for i, v in rows]
    given = spark.createDataFrame(rows + [(-1, None), (-2, []), (-3, [0.0] * 24), (-4, [1.0] * 23), (-5, [float("nan")] * 24)], "id long, v array<double>")
    queries = given.where("id % 25 = 0 OR id < 0")
    asked = [(i, v) for i, v in rows if i % 25 == 0]
    index = vectors.build(given, "id", "v")
    want = cosines(rows, asked, 10)
    got = sorted((r.qid, r.id, r["rank"]) for r in vectors.search(index, queries, "id", "v", 10).collect())
    assert got == want
    some = {(r.qid, r.id) for r in vectors.search(index, queries, "id", "v", 10, probes=8).collect()}
    assert len(some & {w[:2] for w in want}) >= 0.9 * len(want)


def test_vector_index_without_rows(spark):
    given = spark.createDataFrame([(1, None)], "id long, v array<float>")
    assert vectors.search(vectors.build(given, "id", "v"), given, "id", "v", 3).collect() == []
    one = spark.createDataFrame([(1, [0.5, 0.5])], "id long, v array<float>")
    assert [(r.qid, r.id, r["rank"]) for r in vectors.search(vectors.build(one, "id", "v"), one, "id", "v", 3).collect()] == [(1, 1, 1)]


def plain_hybrid(questions, passages, keys, k):
    """Joins of all words and all dimensions."""
    from billquarry.functions import text as X

    expanded = questions.select("qid", X.expand_question(F.col("question")).alias("question"))
    lexical = retrieval.lexical_overlap(expanded, passages, keys)
    semantic = retrieval.sparse_cosine(retrieval.hash_weights(expanded, ["qid"], "question"), retrieval.hash_weights(passages, keys), ["qid"], keys)
    scored = lexical.join(semantic, ["qid", *keys], "left").select("qid", *keys, F.round(F.coalesce("semantic", F.lit(0.0)) * 0.75 + F.col("lexical") * 0.25, 4).alias("score"))
    return retrieval.top_k(scored, ["qid"], [F.desc("score"), *[F.col(c) for c in keys]], k)


def test_hybrid_has_the_rows_of_the_plain_one(spark, monkeypatch):
    chance = random.Random(6)
    words = ["le", "total", "ttc", "facture", "client", "rib", "tva", "date", "x1", "x2", "x3", "élan", "a"]
    text = lambda n: " ".join(chance.choices(words, weights=[30, 9, 5, 3, 3, 2, 2, 2, 1, 1, 1, 1, 1], k=n))
    rows = [(i % 40, i // 40, text(chance.randrange(1, 25))) for i in range(600)] + [(100 + i, 0, "total ttc de la facture") for i in range(300)] + [(900, 0, None), (901, 0, ""), (902, 0, "!")]
    passages = spark.createDataFrame(rows, "doc int, part int, text string").repartition(6)
    questions = spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(["total ttc ?", "quel est le rib du client", "x1 x2 x3", "unknown", "", None, "date facture", *[text(6) for _ in range(20)]])], "qid string, question string")
    want = told(plain_hybrid(questions, passages, ["doc", "part"], 5))
    assert told(hybrid.search(questions, passages, ["doc", "part"], 5)) == want
    monkeypatch.setattr(hybrid, "BLOCK", 8)
    assert told(hybrid.search(questions, passages, ["doc", "part"], 5)) == want
    assert told(hybrid.search(questions, passages, ["doc", "part"], 99)) == told(plain_hybrid(questions, passages, ["doc", "part"], 20))
    assert V.HASH_DIMENSIONS == 384 and hybrid.search(questions.where("false"), passages, ["doc", "part"]).collect() == []
    plain = retrieval.top_k(retrieval.lexical_overlap(questions, passages, ["doc", "part"]), ["qid"], [F.desc("lexical"), F.col("doc"), F.col("part")], 7)
    assert told(hybrid.lexical(questions, passages, ["doc", "part"], 7)) == told(plain)


def test_trigrams_of_all_texts(spark):
    """Pieces of plain and of other texts, with characters beyond two bytes, are those of a walk over the characters."""
    from billquarry.operators import search

    texts = ["ABCabc", "ab", "", None, "aaaa", "été\n12", "x\U0001f600y\U0001f600z", "a\nb\r\nc", "___%"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(search.trigrams(F.col("t")).alias("p")).collect()
    for text, row in zip(texts, got):
        low = (text or "").lower()
        assert sorted(row["p"] or []) == sorted({low[i : i + 3] for i in range(len(low) - 2)})


def test_postings_are_not_shuffled(spark):
    """Postings are written where their rows are; the files of a range of ids are in the order of trigrams."""
    from billquarry.operators import search

    table = spark.range(300).selectExpr("id", "concat('name ', id) AS name")
    index = search.text_index(table, "id", ["name"])
    files = index.postings.select("id", "trigram", F.input_file_name().alias("f")).collect()
    spans = {}
    for r in files:
        spans.setdefault(r["f"], []).append(r)
    assert len(files) == sum(len(set(f"name {i}"[j : j + 3] for j in range(len(f"name {i}") - 2))) for i in range(300))
    ranges = sorted((min(r["id"] for r in v), max(r["id"] for r in v)) for v in spans.values())
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))  # before, a file held a range of trigrams of all ids
    assert all([r["trigram"] for r in v] == sorted(r["trigram"] for r in v) for v in spans.values())
