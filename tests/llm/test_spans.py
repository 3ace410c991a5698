"""Runs and removal against brute force, planted passages, and edge rows."""

import random

import xxhash

from billquarry.llm import queries, spans


def plain_sentences(text):
    words, ends = [], set()
    for line in (text or "").split("\n"):
        for w in line.split():
            words.append(w)
            if w[-1] in ".!?":
                ends.add(len(words))
        if line.split():
            ends.add(len(words))
    cuts = set(ends)
    for i in range(len(words) - spans.WINDOW + 1):
        if not any(i < e <= i + spans.WINDOW for e in ends):
            cuts.add(min(range(i + 1, i + spans.WINDOW + 1), key=lambda k: (xxhash.xxh64_intdigest(words[k - 1].encode()) >> 32, -k)))
    out, start = [], 0
    for end in sorted(cuts):
        out.append(words[start:end])
        start = end
    return out


def plain_runs(sentences):
    size = [len(s) for s in sentences]
    found = set()
    for i in range(len(sentences)):
        for j in range(i + spans.SENTENCES, len(sentences) + 1):
            if sum(size[i:j]) >= spans.WORDS:
                found.add((i, j))
                break
    for j in range(len(sentences) + 1):
        for i in range(j - spans.SENTENCES, -1, -1):
            if sum(size[i:j]) >= spans.WORDS:
                found.add((i, j))
                break
    return sorted(found)


def plain_removed(docs):
    """Sentence numbers to remove of each (id, text); ids are unique and not null."""
    first, where = {}, {}
    for doc_id, text in sorted(docs):
        sentences = plain_sentences(text)
        for i, j in plain_runs(sentences):
            key = tuple(w for s in sentences[i:j] for w in s)
            first.setdefault(key, (doc_id, i, j))
            where.setdefault(doc_id, []).append((key, (doc_id, i, j)))
    texts, out = dict(docs), {}
    for d, found in where.items():
        sentences = plain_sentences(texts[d])
        covered = {n for key, at in found if first[key] != at for n in range(*at[1:])}
        out[d] = set()
        for n in sorted(covered):
            stretch = [n]
            while stretch[-1] + 1 in covered:
                stretch.append(stretch[-1] + 1)
            while stretch[0] - 1 in covered:
                stretch.insert(0, stretch[0] - 1)
            if sum(len(sentences[k]) for k in stretch) >= spans.PASSAGE:
                out[d].add(n)
    return out


def check(rows, docs):
    removed = plain_removed(docs)
    for r in rows:
        text = dict(docs)[r.doc_id]
        sentences = plain_sentences(text)
        gone = removed.get(r.doc_id, set())
        assert (r.n_removed, r.n_sentences) == (len(gone), len(sentences))
        assert r.text.split() == [w for n, s in enumerate(sentences) if n not in gone for w in s]
        if not gone:
            assert r.text == (text or "")


def test_made_documents_match_brute_force(spark):
    chance = random.Random(6)
    sentence = lambda: " ".join(chance.choice("abcdefghijk") * chance.randrange(1, 4) for _ in range(chance.choice([1, 3, 8, 30, 50]))) + chance.choice([".", "!", "\n", ""])
    passages = [chance.choice([" ", "\n"]).join(sentence() for _ in range(chance.randrange(1, 9))) for _ in range(12)]
    docs = [(i, " ".join(chance.choice([sentence(), chance.choice(passages) + "."]) for _ in range(chance.randrange(1, 14)))) for i in range(120)]
    rows = spans.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    check(rows, docs)
    assert sum(r.n_removed for r in rows) > 50


def test_shared_table(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    check(queries.op3_sentence_spans(spark, data).collect(), docs)


def windows(text, size=51):
    words = (text or "").split()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def test_no_long_passage_is_left_wherever_it_begins(spark):
    """Passages of 51 to 90 words set down inside sentences, with and without ends of their own; own words around them stay."""
    chance = random.Random(9)
    word = lambda tag: f"{tag}{chance.randrange(900)}"
    passages = [[word("p") + chance.choice(["", "", "", "", "", ".", "!"] if n % 2 else [""]) for _ in range(chance.randrange(51, 91))] for n in range(20)]
    docs = []
    for i in range(200):
        own = [[f"d{i}x{k}" + ("." if chance.random() < 0.1 else "") for k in range(60)] for _ in range(2)]
        docs.append((i, " ".join(own[0][chance.randrange(50) :] + passages[i % 20] + own[1][: chance.randrange(60)])))
    rows = {r.doc_id: r.text for r in spans.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    seen = set()
    for i, text in docs:
        assert not windows(rows[i]) & seen
        seen |= windows(rows[i])
        if i < 20:
            assert rows[i] == text
        gone = len(text.split()) - len(rows[i].split())
        own = sum(w.startswith("d") for w in text.split()) - sum(w.startswith("d") for w in rows[i].split())
        assert own == 0 and (i < 20 or gone >= 25)


def test_shared_table_keeps_no_long_passage(spark, data):
    seen = set()
    for r in sorted(queries.op3_sentence_spans(spark, data).collect(), key=lambda r: r.doc_id):
        assert not windows(r.text) & seen
        seen |= windows(r.text)


def test_edge_rows(spark):
    passage = " ".join(f"Word{n} one two three four five six." for n in range(9))
    rows = [(1, None), (2, ""), (3, "Short. Same. Text."), (4, "Short. Same. Text."), (5, f"Before it.\n{passage}\n Own end. "), (6, f"  {passage}  After that."), (6, f"  {passage}  After that."), (None, passage), (None, passage), (8, "no end " * 4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS text_hash", "2 AS covered", "3 AS spans")
    got = {}
    for r in spans.remove_repeats(docs).collect():
        got.setdefault(r.doc_id, []).append((r.text, r.n_removed))
    assert got[1] == got[2] == [("", 0)] and got[3] == got[4] == [("Short. Same. Text.", 0)]
    assert got[5] == [(rows[4][1], 0)] and got[6] == [("After that.", 9)] * 2 and got[None] == [("", 9)] * 2
    assert len(got[8][0][0].split()) < 100
    assert spans.remove_repeats(docs.where("false")).count() == 0
