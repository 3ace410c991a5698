"""Lexical retrieval packing: neighbours from a sharded BM25 index fill the window of each seed document.

Every document is encoded once and its ids are written down. Document frequencies and lengths are counted over all
documents; they are as many numbers as the vocabulary has ids. Documents are then dealt by range of a MinHash over
their less common ids, so that texts with common rare terms are neighbours, and a task reads its range in order and
cuts it into shards of a bounded number of ids. Each shard has its own inverted index. A seed takes the unused
documents of its shard by falling BM25 score until its window is full; the last one is cut, and what is left of it is
the next seed. An unfinished window goes back into the next shard, so a task leaves at most one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billquarry.llm.shared import small_batches, stash
from billquarry.llm.tokens import Encoder, ranks_of

#: BM25 constants; ids below COMMON are left out of the MinHash if a document has others; ids of a shard's documents.
K1, B, COMMON, SHARD = 1.2, 0.75, 3000, 1 << 19


@dataclass
class Statistics:
    """Counts over all documents: how many hold each id, documents, and ids in all."""

    held_by: np.ndarray
    documents: int
    ids: int
    idf: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        # an id in half of the documents or more weighs nothing
        self.idf = np.maximum(0, np.log((self.documents - self.held_by + 0.5) / (self.held_by + 0.5)))
        self.mean = self.ids / max(self.documents, 1)


@dataclass
class Rest:
    """What is not yet packed of a document."""

    doc_id: int | None
    ids: np.ndarray
    start: int = 0

    def __len__(self) -> int:
        return len(self.ids) - self.start


class Index:
    """Postings of one shard: for each id the documents that hold it, with their BM25 weight."""

    def __init__(self, rests: list[Rest], statistics: Statistics):
        count = len(rests)
        lengths = np.array([len(r) for r in rests])
        flat = np.concatenate([r.ids[r.start :] for r in rests]).astype(np.int64)
        owner = np.repeat(np.arange(count), lengths)
        weighs = statistics.idf[flat] > 0
        codes, frequency = np.unique(flat[weighs] * count + owner[weighs], return_counts=True)
        terms, self.document = np.divmod(codes, count)
        scale = K1 * (1 - B + B * lengths[self.document] / statistics.mean)
        self.weight = statistics.idf[terms] * frequency * (K1 + 1) / (frequency + scale)
        self.first = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if len(terms) else np.empty(0, dtype=np.int64)
        self.size = np.diff(np.append(self.first, len(terms)))
        # the same postings by document: which lists a seed looks up
        number = np.repeat(np.arange(len(self.first)), self.size)
        order = np.argsort(self.document, kind="stable")
        self.lists = number[order]
        self.ends = np.cumsum(np.bincount(self.document, minlength=count))
        self.count = count

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document of the shard for the ids of the seed."""
        lists = self.lists[self.ends[seed - 1] if seed else 0 : self.ends[seed]]
        size = self.size[lists]
        at = np.repeat(self.first[lists] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.bincount(self.document[at], weights=self.weight[at], minlength=self.count)


Window = list[tuple[Rest, int, int]]


def pack_shard(rests: list[Rest], statistics: Statistics, window: int) -> tuple[list[Window], list[Rest]]:
    """Full windows of (document, start, length), and what is left for the next shard: less than a window."""
    full: list[Window] = []
    pool = []
    for rest in rests:
        while len(rest) >= window:
            full.append([(rest, rest.start, window)])
            rest.start += window
        if len(rest):
            pool.append(rest)
    left = sum(map(len, pool))
    if left < window:
        return full, pool
    index = Index(pool, statistics)
    used = np.zeros(len(pool), dtype=bool)
    seed, unseen = -1, 0
    while left >= window:
        if seed < 0:
            while used[unseen]:
                unseen += 1
            seed = unseen
        room = window - len(pool[seed])
        taken: Window = [(pool[seed], pool[seed].start, len(pool[seed]))]
        pool[seed].start += taken[0][2]
        used[seed] = True
        scores = index.scores(seed)
        scores[used] = -1
        seed = -1
        for neighbour in np.argsort(-scores, kind="stable") if room else ():
            rest = pool[neighbour]
            part = min(room, len(rest))
            taken.append((rest, rest.start, part))
            rest.start += part
            room -= part
            if not len(rest):
                used[neighbour] = True
            else:
                seed = int(neighbour)
            if not room:
                break
        full.append(taken)
        left -= window
    return full, [r for r in pool if len(r)]


def _encoded(path: str, end_id: int):
    ranks = ranks_of(path)
    chance = np.random.default_rng(7).permutation(ranks.width).astype(np.int64)
    order = np.where(np.arange(ranks.width) < COMMON, chance + ranks.width, chance)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, True)
        end = np.array([end_id], dtype=encoder.dtype).tobytes()
        for batch in batches:
            ids = [value + end for value in encoder.encode(batch.column(1).to_pylist())]
            near = [int(order[np.frombuffer(i, dtype=encoder.dtype)].min()) for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near, type=pa.int64()), pa.array(ids, type=pa.binary())], ["doc_id", "near", "ids"])

    return encode


def _counted(width: int, dtype: np.dtype):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_by, few, here = np.zeros(width, dtype=np.int64), np.zeros(width, dtype=np.uint8), np.zeros(width, dtype=np.uint8)
        documents = total = 0
        for batch in batches:
            for raw in batch.column(0):
                ids = np.frombuffer(raw.as_buffer(), dtype=dtype)
                here[ids] = 1
                few += here
                here[ids] = 0
                documents += 1
                total += len(ids)
                if documents % 255 == 0:  # as far as a byte counts
                    held_by += few
                    few[:] = 0
        held_by += few
        some = np.flatnonzero(held_by)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [-1, -2])), pa.array(np.append(held_by[some], [documents, total]))], ["id", "n"])

    return count


def _statistics(encoded: DataFrame, width: int, dtype: np.dtype) -> Statistics:
    """Gathers one number for each id of the vocabulary and two more: a size that does not grow with the documents."""
    counts = encoded.select("ids").mapInArrow(_counted(width, dtype), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    by_id = dict(zip(counts["id"].tolist(), counts["n"].tolist()))
    held_by = np.array([by_id.get(i, 0) for i in range(width)], dtype=np.float64)
    return Statistics(held_by, by_id.get(-1, 0), by_id.get(-2, 0))


PIECE = "doc_id {id}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _packed(shared, dtype: np.dtype, window: int, id_type: pa.DataType):
    def rows(windows: list[Window], first: int) -> pa.RecordBatch:
        flat = [(first + n, rest, start, length) for n, taken in enumerate(windows) for rest, start, length in taken]
        number, length = np.array([f[0] for f in flat], dtype=np.int64), np.array([f[3] for f in flat], dtype=np.int64)
        before = np.cumsum(length) - length
        new = np.r_[True, number[1:] != number[:-1]] if len(flat) else np.empty(0, dtype=bool)
        offset = before - np.maximum.accumulate(np.where(new, before, 0))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([f[1].doc_id for f in flat], type=id_type), pa.array([f[2] for f in flat], type=pa.int64()), pa.array(length),
                pa.array([f[1].ids[f[2] : f[2] + f[3]].astype("<u4").tobytes() for f in flat], type=pa.binary()),
                pa.array([len(f[1].ids) for f in flat], type=pa.int64()), pa.array(number), pa.array(offset),
            ],
            ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
        )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        statistics, next_id = shared.value, TaskContext.get().partitionId() << 40
        rests: list[Rest] = []
        room = 0
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                rests.append(Rest(doc_id, np.frombuffer(raw.as_py(), dtype=dtype)))
                room += len(rests[-1])
                if room >= SHARD:
                    windows, rests = pack_shard(rests, statistics, window)
                    room = sum(map(len, rests))
                    if windows:
                        yield rows(windows, next_id)
                        next_id += len(windows)
        windows, rests = pack_shard(rests, statistics, window)
        if rests:
            windows = [*windows, [(r, r.start, len(r)) for r in rests]]
        if windows:
            yield rows(windows, next_id)

    return pack


def pack(docs: DataFrame, vocabulary: str, window: int = 2048, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of sequences of at most ``window`` ids, one row each.

    ``doc_id``; ``start`` and ``length`` of the piece in its document; ``ids`` (little-endian unsigned 32-bit);
    ``doc_tokens`` of the document with ``end_id``, which closes every document; ``sequence_id``; ``offset`` in the sequence.
    Each id of each row of ``docs`` is in exactly one piece. A missing or empty text is ``end_id`` alone; rows that repeat
    or have no id are packed like any other; a text longer than a window is cut into whole windows and a rest.
    All sequences are full but at most one a task. Other columns of ``docs`` are not used.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[doc_id].dataType.simpleString()
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    encoded = stash(source.mapInArrow(_encoded(vocabulary, end_id), f"doc_id {kind}, near long, ids binary"), "packing-ids")
    ranks = ranks_of(vocabulary)
    shared = spark.sparkContext.broadcast(_statistics(encoded, ranks.width, ranks.dtype))
    dealt = encoded.repartitionByRange("near", "doc_id").sortWithinPartitions("near", "doc_id", F.crc32("ids")).select("doc_id", "ids")
    id_type = pa.int32() if kind == "int" else pa.string() if kind == "string" else pa.int64()
    return dealt.mapInArrow(_packed(shared, ranks.dtype, window, id_type), PIECE.format(id=kind))
