"""Packing: ids equal to the library's, each in exactly one piece, windows full, neighbours by score."""

import math
import os
import zlib

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from billquarry.llm import packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def check(pieces, texts, library, window):
    """``texts``: (doc_id, text); ids must be unique or null."""
    of, sequences = {}, {}
    for p in pieces:
        of.setdefault(p["doc_id"], []).append(p)
        sequences.setdefault(p["sequence_id"], []).append(p)
    for doc_id, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for p in sorted(of.pop(doc_id), key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], dtype="<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    assert not of
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window
    return [sum(p["length"] for p in parts) for parts in sequences.values()]


def test_query_over_the_shared_table(spark, data, library):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    pieces = [r.asDict() for r in queries.op2_retrieval_packing(spark, data).collect()]
    sizes = check(pieces, [(r.doc_id, r.text) for r in rows], library, 2048)
    assert sum(s < 2048 for s in sizes) <= 8


def test_edge_rows(spark, library):
    rows = [(1, None), (2, ""), (3, "word " * 9000), (4, "a<|endoftext|>b"), (None, "no id"), (6, " \n\n x"), (7, "é" * 70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS ids", "2 AS near", "3 AS start")
    pieces = [r.asDict() for r in packing.pack(docs, PATH, window=64).selectExpr("*", "crc32(ids) AS ids_crc32").collect()]
    check(pieces, rows, library, 64)
    assert packing.pack(docs.where("false"), PATH).count() == 0


def test_repeated_rows_are_all_packed(spark):
    docs = spark.createDataFrame([(1, "same words")] * 50, "doc_id long, text string")
    pieces = packing.pack(docs, PATH, window=16).collect()
    assert sum(p.length for p in pieces) == 50 * 3


def test_scores_are_bm25():
    chance = np.random.default_rng(3)
    rests = [packing.Rest(i, chance.integers(0, 40, size=chance.integers(1, 30)).astype(np.uint16)) for i in range(25)]
    held_by = np.array([sum(t in r.ids for r in rests) for t in range(40)], dtype=float)
    statistics = packing.Statistics(held_by, 25, sum(map(len, rests)))
    got = packing.Index(rests, statistics).scores(4)
    for d, rest in enumerate(rests):
        want = 0.0
        for t in set(rests[4].ids.tolist()):
            tf = int((rest.ids == t).sum())
            idf = max(0, math.log((25 - held_by[t] + 0.5) / (held_by[t] + 0.5)))
            want += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(rest) / statistics.mean))
        assert got[d] == pytest.approx(want)


def test_best_neighbour_follows_its_seed():
    groups = [np.arange(100 * g, 100 * g + 20, dtype=np.uint16) for g in range(4)]
    rests = [packing.Rest(10 * g + n, groups[g].copy()) for n in range(2) for g in range(4)]
    held_by = np.zeros(400)
    for g in groups:
        held_by[g] = 2
    full, left = packing.pack_shard(rests, packing.Statistics(held_by, 8, 160), 40)
    assert not left and all(taken[0][0].doc_id // 10 == taken[1][0].doc_id // 10 for taken in full)
