"""Phrases against plain counting."""

import random
import re
from collections import Counter

import pytest

from billquarry.llm import phrases

SCHEMA = "doc_id long, text string, lang string, n int, chunk string, own int, rank int"


def plain(rows, plan):
    counts, total = {}, Counter()
    for text, lang in rows:
        lang = lang or "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for size in range(1, plan.longest + 1):
                for i in range(len(words) - size + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + size])] += 1
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= plan.least}
        rows = []
        for p, a in often.items():
            if any(len(q) > len(p) and 100 * b >= plan.contained * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in often.items()):
                continue
            score, _, left, right = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[: plan.top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def rows_of(count):
    chance = random.Random(4)
    vocabulary = ["the", "of", "New", "york", "CITY", "é", "hall", "日本", "a", "b"]
    rows = []
    for _ in range(count):
        words = []
        for _ in range(chance.randrange(60)):
            words.append(chance.choice([*vocabulary, "new york city", "New\tYork  city hall", ". ", ", ", "\n", "\r\n", "\x0b", "  "]))
        rows.append((" ".join(words), chance.choice(["en", "de", None, "und"])))
    return rows + rows[:7]


@pytest.mark.parametrize("plan", [phrases.Plan(least=3, every=2, bits=12, held=8), phrases.Plan(least=5, top=7), phrases.Plan(longest=6, least=4, every=1 << 20, contained=50)])
def test_plain_counts(spark, plan):
    rows = rows_of(150)
    docs = spark.createDataFrame([(i, t, lang, 1, "x", 2, 3) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(5)
    want = plain(rows, plan)
    assert len(want) > 20 or plan.top < 20
    assert sorted(tuple(r) for r in phrases.collocations(docs, plan).collect()) == want


def test_edge_rows(spark):
    plan = phrases.Plan(least=30)
    long = "same " * 100_000 + "x" * 200_000 + " y z" * 40
    rows = [(None, "en"), ("", "en"), (" .\n,", None), (long, "en"), (long.upper(), None), ("one word", "")]
    docs = spark.createDataFrame([(i, t, lang, 1, "x", 2, 3) for i, (t, lang) in enumerate(rows)], SCHEMA)
    assert sorted(tuple(r) for r in phrases.collocations(docs, plan).collect()) == plain(rows, plan)
    assert phrases.collocations(docs.where("false"), plan).collect() == []
    assert phrases.collocations(docs.where("text IS NULL"), plan).collect() == []
