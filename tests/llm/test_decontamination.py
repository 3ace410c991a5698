"""Alignment against a plain table, planted items found, and defined results for edge rows."""

import random

import numpy as np

from billquarry.llm import decontamination, queries


def plain_align(passage, item):
    best, table = 0, [[0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    for i in range(1, len(item) + 1):
        for j in range(1, len(passage) + 1):
            same = decontamination.EQUAL if item[i - 1] == passage[j - 1] else decontamination.UNEQUAL
            table[i][j] = max(0, table[i - 1][j - 1] + same, table[i - 1][j] + decontamination.GAP, table[i][j - 1] + decontamination.GAP)
            best = max(best, table[i][j])
    return best


def test_alignment_matches_a_plain_table():
    chance = random.Random(2)
    pairs = [(np.array([chance.randrange(1, 5) for _ in range(chance.randrange(1, 30))]), np.array([chance.randrange(1, 5) for _ in range(chance.randrange(1, 12))])) for _ in range(300)]
    for (passage, item), (score, start, end) in zip(pairs, decontamination.align(pairs)):
        assert score == plain_align(passage, item) == plain_align(passage[start:end], item)


def plain_query(docs, items):
    """Every document against every item of four words or more, whether they share a seed or not."""
    hasher, out = decontamination.Hasher(), {}
    hashed = {i: words for i, t in items if len(words := hasher(t).view(np.int64)) >= decontamination.WORDS}
    for doc_id, text in docs:
        words = hasher(text).view(np.int64)
        if len(words) and hashed:
            for (item_id, item), (top, _, _) in zip(hashed.items(), decontamination.align([(words, item) for item in hashed.values()])):
                if (score := top / (2 * len(item))) >= decontamination.THRESHOLD:
                    out[doc_id, item_id] = round(score, 9)
    return out


def test_query_matches_all_against_all(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): round(r.score, 9) for r in queries.op7_decontamination(spark, data).collect()}
    assert got and got == plain_query(docs, items)


def test_edited_copies_shared_grams_and_edge_rows(spark):
    chance = random.Random(4)
    word = lambda: "".join(chance.choice("abcdefg") for _ in range(6))
    common = [word() for _ in range(6)]
    items = [(i, " ".join([*common, *(word() for _ in range(24))])) for i in range(20)] + [(90, None), (91, ""), (92, "too short"), (None, "an item without id has none of this"), (93, " ".join(common))]
    docs, texts = [], dict(items)
    for i in range(20):
        words = texts[i].upper().split()
        words[10] = "changed"
        words[20:22] = []
        words.insert(26, "put, in!")
        docs.append((i, " ".join([*(word() for _ in range(300)), *words, *(word() for _ in range(300))])))
    docs += [(50, None), (51, ""), (52, " ".join(word() for _ in range(500))), (None, texts[3]), (None, texts[3]), (53, " ".join(texts[5].split()[6:14] + [word() for _ in range(40)]))]
    docs_df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS words", "3 AS text_hash")
    items_df = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(docs_df, items_df).collect()}
    assert {k: round(r.score, 9) for k, r in got.items()} == plain_query(docs, [i for i in items if i[0] is not None])
    assert all((i, i) in got for i in range(20)) and (None, 3) in got and (53, 5) not in got
    assert abs(got[0, 0].start - 300) <= 1 and 28 <= got[0, 0].length <= 34
    kept = decontamination.without_contaminated(docs_df, items_df)
    assert kept.columns == docs_df.columns and sorted(r.doc_id for r in kept.collect()) == [50, 51, 52, 53]
    assert decontamination.contaminated(docs_df.where("false"), items_df).count() == 0
    assert decontamination.contaminated(docs_df, items_df.where("false")).count() == 0


def test_words_changed_all_over_and_items_that_share_their_text(spark):
    chance = random.Random(6)
    word = lambda: "".join(chance.choice("abcdefghijkl") for _ in range(6))
    own = [[word() for _ in range(30)] for _ in range(8)]
    template = [word() for _ in range(28)]
    items = [(i, " ".join(w)) for i, w in enumerate(own)]
    items += [(100 + i, " ".join(own[0])) for i in range(30)]  # many items with one text
    items += [(200 + i, " ".join([*template[:14], word(), *template[14:], word()])) for i in range(20)]  # and many of one template
    docs = []
    for step in (4, 5, 6, 9):
        for i, words in enumerate([*own, template]):
            changed = [word() if n % step == step - 1 else w for n, w in enumerate(words)]
            docs.append((step * 100 + i, " ".join([*(word() for _ in range(200)), *changed, *(word() for _ in range(200))])))
    docs.append((1, " ".join(word() for _ in range(3000))))
    got = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id): round(r.score, 9) for r in got}
    assert len(found) == len(got) and found == plain_query(docs, items)
    assert all((step * 100 + i, i) in found for step in (4, 5, 6, 9) for i in range(8)) and all((900, 100 + i) in found for i in range(30))
