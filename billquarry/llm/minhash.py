"""MinHash near-duplicates: banded minima propose links, signatures and then whole shingle sets confirm them.

Each document is its set of word shingles, held as 64-bit hashes. Equal sets are one node. A node's signature holds the
minima of many universal hash functions; nodes with an equal band of minima meet in a group, and those whose signatures
agree well enough become candidates. Candidates are joined into components by alternating large-star and small-star, and
inside each of them whole sets are compared. What that confirms is joined into components the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billquarry.llm import linkage, words
from billquarry.llm.shared import small_batches, stash
from billquarry.llm.simhash import components

SEPARATORS = bytes([32, *range(9, 14)])


@dataclass(frozen=True)
class Plan:
    """``words`` in a shingle; links from ``percent`` of the union on; ``minima`` in bands of ``rows``.

    A pair with a similarity of 0.8 shares no band with a probability of (1 - 0.8 ** rows) ** (minima / rows), 5e-8 here. ``agree`` of the minima
    must be equal: 102 are on average at 0.8, with a deviation of 4.5, so 80 are missed in 3 of 10 million pairs.
    ``signatures`` and ``shingles``: bytes of signatures or sets compared in one task at once; they change no result.
    """

    words: int = 4
    percent: int = 80
    minima: int = 128
    rows: int = 4
    agree: int = 80
    signatures: int = 1 << 20
    shingles: int = 1 << 22


FOUR_WORDS = Plan()
_BLOCK = 4096


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; all words are one shingle if they are fewer."""
    found = words.words_of(texts, words.LOWER, SEPARATORS)
    whole = words.windows(found.hashes, size)
    out = []
    for low, high in zip(found.first[:-1].tolist(), found.first[1:].tolist()):
        if high - low >= size:
            out.append(np.unique(whole[low : high - size + 1]))
        else:
            out.append(words.windows(found.hashes[low:high], high - low) if high > low else np.empty(0, dtype=np.uint64))
    return out


def signature(shingles: np.ndarray, count: int) -> np.ndarray:
    """16 bits of each of ``count`` minima under functions (a x + b) mod 2 ** 64."""
    a, b = (words.mixed(np.arange(1 + s, count + 1 + s, dtype=np.uint64))[:, None] for s in (0, 1 << 20))
    a |= np.uint64(1)
    least = np.full(count, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(shingles), _BLOCK):
        np.minimum(least, (a * shingles[None, at : at + _BLOCK] + b).min(axis=1), out=least)
    return (words.mixed(least) >> np.uint64(48)).astype("<u2")


def _sketches(plan: Plan):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(2), plan.words)
            node, signed = [], []
            for s in sets:
                sums = [words.mixed(s ^ np.uint64(salt)).sum(dtype=np.uint64) for salt in (0x5BD1E995, 0x2545F4914F6CDD1D)]
                node.append(np.array(sums, dtype="<u8").tobytes() if len(s) else None)
                signed.append(signature(s, plan.minima).tobytes() if len(s) else None)
            columns = [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], type=pa.int64()), pa.array(node, type=pa.binary()), pa.array(signed, type=pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_shingles", "node", "signature"])

    return rows


def _bands(plan: Plan):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            signed = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<u2").reshape(batch.num_rows, -1).astype(np.uint64)
            for band in range(0, plan.minima, plan.rows):
                key = np.full(len(signed), np.uint64(band))
                for n in range(band, min(band + plan.rows, plan.minima)):
                    key = words.mixed(key * np.uint64(0x9E3779B97F4A7C15) + signed[:, n])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0)], ["grp", "node"])

    return rows


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One byte of each minimum."""
    for batch in batches:
        short = [np.frombuffer(s, dtype="<u2").astype(np.uint8).tobytes() for s in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(short, type=pa.binary())], ["node", "payload"])


def near_duplicates(docs: DataFrame, plan: Plan = FOUR_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(``doc_id``, ``n_shingles``, ``component_id``, ``kept``) of every row of ``docs``.

    Two documents are linked if their sets have ``plan.percent`` of their union in common; ``component_id`` is the smallest
    id reachable, ``kept`` says that it is the row's own. A missing, empty or blank text has an empty set and is linked with
    nothing, not even with another such. A row without an id takes part; its component's id is null only if no row of the
    component has one, and it is kept only then. Repeated rows stay, all of them kept or none.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    hashed = stash(
        source.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
        .mapInArrow(_sketches(plan), f"doc_id {kind}, text_hash long, n_shingles long, node binary, signature binary"),
        "minhash",
    )
    distinct = stash(
        hashed.where("node IS NOT NULL").groupBy("node")
        .agg(F.min("doc_id").alias("first_id"), F.max(F.struct("doc_id", "text_hash")).alias("row"), F.max("signature").alias("signature")),
        "minhash-distinct",
    )
    banded = distinct.select("node", "signature").mapInArrow(_bands(plan), "grp long, node binary")
    shared = stash(banded.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1").select("grp"), "minhash-shared")
    met = stash(banded.join(shared, "grp"), "minhash-met")
    signed = distinct.join(met.select("node").distinct(), "node").select("node", "signature").mapInArrow(_short, "node binary, payload binary")
    groups = stash(met.join(stash(signed, "minhash-signed"), "node").select("grp", "node", "payload"), "minhash-groups")
    candidates = stash(linkage.linked(groups, linkage.agreeing(plan.agree), plan.signatures).distinct(), "minhash-candidates")
    grouped = components(candidates).select("node", F.xxhash64("root").alias("grp"))
    found = components(linkage.confirmed(source, distinct, grouped, lambda texts: shingle_sets(texts, plan.words), plan.percent, plan.shingles))
    rooted = stash(found.join(distinct.select("node", "first_id"), "node"), "minhash-found")
    named = stash(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "minhash-named")
    linked = stash(rooted.join(named, "root").select("node", F.col("component_id").alias("of_all"), F.lit(True).alias("linked")), "minhash-linked")
    of_node = stash(distinct.join(linked, "node", "left").select("node", F.when(F.col("linked"), F.col("of_all")).otherwise(F.col("first_id")).alias("component_id"), F.lit(True).alias("has_set")), "minhash-components")
    component = F.when(F.col("has_set"), F.col("component_id")).otherwise(F.col("doc_id"))
    return hashed.join(of_node, "node", "left").select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
