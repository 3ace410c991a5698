"""The stages against brute force on the shared table, and on edge rows."""

import os
import random
import sys

import numpy as np
import public_tokenizers

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline
from billquarry.llm import decontamination, quality, secrets, simhash
from billquarry.llm.tokens import Encoder
from tests.llm.test_decontamination import plain_query


def shingles(text, size=5):
    words = text.encode().lower().split()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or {tuple(words)}


def staged(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        out.append(docs)
    return out


def test_stages_match_brute_force(spark):
    data = "/root/testdata/sf0.01"
    docs, good, first, clean, redacted, packed = staged(spark, data)
    for stage in (good, first, clean, redacted):
        assert stage.columns == docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    verdicts = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    left = {r.doc_id: r.text for r in good.collect()}
    assert left == {i: r.text for i, r in rows.items() if verdicts[i]}

    ids = sorted(left)
    sets = {i: shingles(left[i]) for i in ids}
    holders = {}
    for i in ids:
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    # every pair of documents that share a shingle, by the exact similarity of their sets
    for pair in {(a, b) for held in holders.values() if len(held) > 1 for n, a in enumerate(held) for b in held[n + 1 :]}:
        a, b = (sets[i] for i in pair)
        common = len(a & b)
        if 100 * common >= 80 * (len(a) + len(b) - common):
            a, b = (find(i) for i in pair)
            root[max(a, b)] = min(a, b)
    # pairs beyond the reach of the trees may be missed: no other rows go, hardly any more stay
    kept = {r.doc_id: r.text for r in first.collect()}
    alone = {i for i in ids if find(i) == i}
    assert alone <= set(kept) and len(set(kept) - alone) <= 0.005 * len(ids) and len(alone) < len(ids)
    left = {i: t for i, t in left.items() if i in kept}

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    leaked = {d for d, _ in plain_query(list(left.items()), items)}
    left = {i: t for i, t in left.items() if i not in leaked}
    assert {r.doc_id: r.text for r in clean.collect()} == left

    found = {}
    for r in secrets.scan(clean).where("secret").collect():
        found.setdefault(r.doc_id, []).append((r.start, r.length))
    for i, places in found.items():
        for start, length in sorted(places, reverse=True):
            left[i] = left[i][:start] + secrets.REDACTED + left[i][start + length :]
    assert found and {r.doc_id: (r.text, r.n_chars) for r in redacted.collect()} == {i: (t, len(t) if i in found else rows[i].n_chars) for i, t in left.items()}

    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"), True)
    pieces = {}
    for r in packed.collect():
        pieces.setdefault(r.doc_id, {})[r.start] = r.ids
    for i, raw in zip(left, encoder.encode(list(left.values()))):
        ids_ = np.append(np.frombuffer(raw, dtype=encoder.dtype), 1).astype("<u4").tobytes()
        assert b"".join(bytes(v) for _, v in sorted(pieces.pop(i).items())) == ids_
    assert not pieces


def test_run_gives_the_last_stage(spark, data):
    assert corpus_pipeline.run(spark, data).groupBy().sum("length").first()[0] == staged(spark, data)[-1].groupBy().sum("length").first()[0]


def test_edge_rows(spark, tmp_path, data):
    spark.read.parquet(f"{data}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    chance = random.Random(8)
    plain = [" ".join("".join(chance.choice("abcdefghij") for _ in range(5)) for _ in range(60)) for _ in range(40)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(plain)] + [(50, None, None, None, None), (51, "", "en", "s", 0), (None, plain[0], "en", "s", 1), (None, "only " + plain[3][::-1], None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").selectExpr("*", "1 AS fp", "2 AS score", "3 AS row")
    for given, count in ((docs, None), (docs.where("false"), 0)):
        for name, stage in corpus_pipeline.STAGES:
            given = stage(spark, given, str(tmp_path))
            if name != "pack":
                assert given.columns == docs.columns
        if count is not None:
            assert given.count() == count
        else:
            assert given.select("doc_id").distinct().count() == 41


def test_wide_threshold_is_the_jaccard_one():
    assert abs(simhash.JACCARD_80.radius - 256 / np.pi * np.arccos(2 * 0.8 / 1.8)) < 3
    assert decontamination.THRESHOLD == 0.6
