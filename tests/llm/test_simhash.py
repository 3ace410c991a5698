"""Fingerprints, BK-tree search and components against brute force."""

import random

import numpy as np
import pytest
import xxhash

from billquarry.llm import simhash


def plain_fingerprint(text, words=4):
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    shingles = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, radius=4):
    prints = {i: plain_fingerprint(t) for i, t in rows}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (f"{prints[i]:016x}", find(i)) for i in ids}


def texts(seed, count, vocabulary=400):
    chance = random.Random(seed)
    words = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(vocabulary)]
    out = []
    for i in range(count):
        if out and chance.random() < 0.6:  # a copy with a word or two changed
            parts = out[chance.randrange(len(out))].split(" ")
            for _ in range(chance.randrange(3)):
                parts[chance.randrange(len(parts))] = chance.choice(words)
            out.append(" ".join(parts))
        else:
            out.append(" ".join(chance.choice(words) for _ in range(chance.randrange(1, 200))))
    return out


def test_components_match_brute_force(spark):
    rows = list(enumerate(["", "   \t\n", None, "one", "One", "two words", "A B C D", "a b c d\x0b", *texts(1, 260)]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == plain_components(rows)


def test_large_shards_are_cut_into_parts(spark):
    rows = list(enumerate(texts(2, 200, vocabulary=9)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cut = simhash.Plan(part=3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, cut).collect()}
    assert got == plain_components(rows)


def test_shared_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == plain_components(rows)


def test_wide_fingerprints_group_like_jaccard(spark):
    base = texts(3, 1, 5000)[0].split(" ") + [f"x{i}" for i in range(300)]
    near, far = list(base), list(base)
    near[50] = "changed"
    far[::3] = [f"y{i}" for i in range(len(far[::3]))]
    docs = spark.createDataFrame([(5, " ".join(base)), (9, " ".join(near)), (2, " ".join(far))], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, simhash.JACCARD_80).collect()}
    assert got == {5: 5, 9: 5, 2: 2}


def test_nulls_repeats_and_empty_table(spark):
    rows = [(None, "same text here now"), (3, "same text here now"), (3, "same text here now"), (None, "alone and far from others")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS fingerprint", "2 AS fp", "3 AS component_id")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == [(3, 3), (3, 3), (None, 3), (None, None)]
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_long_text_in_blocks(monkeypatch):
    text = " ".join(texts(4, 40))
    whole = simhash.fingerprints_of([text, "a b", text], simhash.EXACT)
    monkeypatch.setattr(simhash, "SHINGLES", 1000)
    assert (simhash.fingerprints_of([text, "a b", text], simhash.EXACT) == whole).all()
    assert int(whole[0, 0]) == plain_fingerprint(text)


@pytest.mark.parametrize("radius", [0, 2, 6])
def test_forest_finds_every_neighbour(radius):
    chance = np.random.default_rng(7)
    words = chance.integers(0, 1 << 12, size=(300, 1), dtype=np.uint64)
    unit = np.sort(chance.integers(0, 4, size=300))
    pairs = {(q, n) for query, node in simhash.Forest(words, unit, 64).search(words, unit, radius) for q, n in zip(query.tolist(), node.tolist())}
    want = {(q, n) for q in range(300) for n in range(300) if unit[q] == unit[n] and int(words[q, 0] ^ words[n, 0]).bit_count() <= radius}
    assert pairs == want


def test_one_row_of_each_group_stays(spark):
    rows = [(4, "same text here now and more"), (3, "same text here now and more"), (None, "same text here now and more"), (None, "alone " * 9), (7, None), (8, ""), (9, "quite another one of its own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS other_id", "2 AS fp")
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [3, 7, 9, None]
    assert simhash.keep_first(docs.where("false")).count() == 0


def test_links_are_those_of_the_exact_similarity(spark):
    chance = random.Random(11)
    word = lambda: f"v{chance.randrange(10**6)}"
    rows = []
    for g in range(120):  # copies with 2 to 12 of 200 words changed: similarities from 0.5 to 0.95
        base = [word() for _ in range(200)]
        rows.append((len(rows), " ".join(base)))
        for _ in range(2):
            copy = list(base)
            for at in chance.sample(range(0, 200, 7), chance.randrange(2, 13)):
                copy[at] = word()
            rows.append((len(rows), " ".join(copy)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(196)} for i, t in rows}
    want = {i: i for i, _ in rows}
    for g in range(0, len(rows), 3):
        linked = [(a, b) for a in range(g, g + 3) for b in range(a) if b >= g and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
        for a, b in [*linked, *linked]:
            want[a] = want[b] = min(want[a], want[b])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, simhash.JACCARD_80).collect()}
    assert got == want and len(set(want.values())) > 150


def test_shortest_pairs_keep_rows_together():
    chance = np.random.default_rng(5)
    a, b, apart = chance.integers(0, 60, 400), chance.integers(0, 60, 400), chance.integers(0, 9, 400)
    some = simhash._shortest(60, a, b, apart)
    for most in range(9):
        near, kept = apart <= most, some[apart[some] <= most]
        label, of_kept = simhash._merge(np.arange(60), a[near], b[near]), simhash._merge(np.arange(60), a[kept], b[kept])
        assert (label == of_kept).all() and len(kept) == 60 - len(set(label.tolist()))
