"""Components of shingle sets against all pairs, with blocks small enough that groups are cut."""

import random

import numpy as np
import pytest

from billquarry.llm import linkage, minhash

SCHEMA = "doc_id long, text string, node string, payload int, grp string"


def plain(rows, size=4, percent=80):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and sets[j] and 100 * common >= percent * (len(a) + len(sets[j]) - common):
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    out = []
    for i, (doc, _) in enumerate(rows):
        first = min((d for d in groups[find(i)] if d is not None), default=None)
        out.append((doc, len(sets[i]), first, doc == first))
    return sorted(out, key=str)


def copies(count, seed=3):
    chance = random.Random(seed)
    word = lambda: "".join(chance.choice("abcdefghij") for _ in range(4))
    bases = [[word() for _ in range(n)] for n in (60, 40, 24, 80)]
    rows = []
    for i in range(count):
        words = list(bases[chance.choice((0, 0, 0, 1, 2, 3))])
        for _ in range(chance.randrange(4)):
            words[chance.randrange(len(words))] = word()
        rows.append((i, " ".join(words)))
    return rows


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("plan", [minhash.FOUR_WORDS, minhash.Plan(signatures=2000, shingles=6000)])
def test_near_copies(spark, plan):
    rows = copies(150)
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)
    want = plain(rows)
    assert len({r[2] for r in want}) < 120
    assert told(minhash.near_duplicates(docs, plan)) == want


def test_edge_rows(spark):
    long = " ".join(str(i * 7919 % 100003) for i in range(60000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "Two words"), (5, "two  WORDS"), (6, "two"), (7, long), (8, long + " more"), (None, long), (9, "É é a b"), (10, "é é a b"), (None, "alone it is here"), (7, long), (None, None), (11, "x " * 9)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    got = told(minhash.near_duplicates(docs))
    want = plain(rows)
    # no row of "alone it is here" has an id, so it is kept
    assert got == sorted([(d, n, c, True if d is None and c is None else k) for d, n, c, k in want], key=str)
    assert minhash.near_duplicates(docs.where("false")).collect() == []


def test_jaccard_finder_in_both_forms():
    chance = np.random.default_rng(5)
    sets = []
    for _ in range(40):
        base = np.arange(100) if chance.random() < 0.7 else np.arange(1000, 1060)
        sets.append(np.sort(np.unique(np.concatenate([base[chance.random(len(base)) < 0.93], chance.integers(5000, 9000, 4)]))))
    payloads = [s.astype("<i8").tobytes() for s in sets]
    every = np.arange(len(sets))
    whole = linkage.jaccard(80)(payloads, every, every, every.copy())
    pairs = every.copy()
    for i in range(len(sets)):
        for j in range(i):
            two = linkage.jaccard(80)([payloads[i], payloads[j]], np.array([0, 1]), np.array([0, 1]), np.array([0, 1]))
            common = len(set(sets[i]) & set(sets[j]))
            assert (two[0] == two[1]) == (100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common))
            if two[0] == two[1]:
                pairs = linkage.merged(pairs, np.array([i]), np.array([j]))
    assert (whole == pairs).all()
