"""Benchmark decontamination: rare n-gram seeds find passages, Smith-Waterman alignment scores them.

Words are case-folded and stripped of everything but letters, digits and underscores; what is empty then is no word.
Texts are hashed word by word and their n-grams looked up in a bitmap of a fixed size that holds the seeds of all
items; only around a hit a passage of hashed words leaves the task. Passages join distinct item texts on equal seeds,
each pair once, and every pair is aligned word by word. Seeds are runs of four words and three words on either side of
any one, all over the item: a copy with every fourth word changed still holds some. Those that few item texts share are
used; an item text of which they are less than half uses all of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billquarry.llm.shared import small_batches, stash

#: Places of the words of a seed, run and gapped; words of the shortest and reach of the longest; item texts that may share a rare one.
SEEDS = ((0, 1, 2, 3), (0, 1, 2, 4, 5, 6))
WORDS, SPAN, SHARED = 4, 7, 8
#: Scores of equal words, of unequal ones and of a gap; a passage counts from this share of the highest possible score.
EQUAL, UNEQUAL, GAP, THRESHOLD = 2, -1, -1, 0.6
#: Size of the bitmap (a power of two), cells aligned at a time, words a worker remembers.
BITS, CELLS, REMEMBERED = 24, 1 << 21, 300_000
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(SPAN)], dtype=np.uint64)
_MARKS = re.compile(r"\W+")
_BLOCK = 1 << 20
_SPACE = re.compile(r"\s")


class Hasher:
    """64-bit hashes of normalised words; a word without letters or digits has none (0)."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        found, at, text = [], 0, (text or "").casefold()
        while at < len(text):
            cut = _SPACE.search(text, at + _BLOCK)
            to = cut.start() if cut else len(text)
            found.append(self._block(text[at:to].split()))
            at = to
        return np.concatenate(found) if found else np.empty(0, dtype=np.uint64)

    def _block(self, words: list[str]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        for word in {w for w in words if w not in known}:
            plain = word if word.isalnum() else _MARKS.sub("", word)
            known[word] = xxhash.xxh64_intdigest(plain.encode("utf-8", "surrogatepass")) | 1 if plain else 0
        hashes = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        return hashes[hashes != 0]


def grams(hashes: np.ndarray, places: tuple[int, ...] = SEEDS[0]) -> np.ndarray:
    """Hash of the words at ``places`` from each word on."""
    count = max(len(hashes) - places[-1], 0)
    out = np.full(count, len(places), dtype=np.uint64)
    mixed = hashes ^ (hashes >> np.uint64(29))
    for k in places:
        out += mixed[k : k + count] * _FACTORS[k]
    out ^= out >> np.uint64(32)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def all_grams(hashes: np.ndarray) -> np.ndarray:
    return np.concatenate([grams(hashes, places) for places in SEEDS])


def _places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of the bitmap that stand for an n-gram."""
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64), (hashes & np.uint64((1 << BITS) - 1)).astype(np.int64)


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for batch in batches:
        hashed = [hasher(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([h.view(np.int64) for h in hashed], type=pa.list_(pa.int64())), pa.array([all_grams(h).view(np.int64) for h in hashed], type=pa.list_(pa.int64()))],
            ["item_id", "words", "grams"],
        )


def _seeds(texts: DataFrame) -> DataFrame:
    """(``item``, ``gram``): the rare seeds of every item text, or all of them where less than half are rare."""
    each = texts.select("item", F.explode(F.array_distinct("grams")).alias("gram"))
    shared = each.groupBy("gram").agg(F.count("*").alias("items"))
    counted = each.join(shared, "gram").withColumn("rare", F.col("items") <= SHARED)
    few = counted.groupBy("item").agg(F.expr("2 * count_if(rare) < count(*)").alias("few"))
    return stash(counted.join(few, "item").where(F.col("rare") | F.col("few")).select("item", "gram"), "seeds")


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """All seeds as one bitmap; what the driver gets has at most 2 ** BITS bits, however many items there are."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << BITS, dtype=bool)
        for batch in batches:
            for places in _places(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)):
                bits[places] = True
        packed = np.packbits(bits, bitorder="little").view("<i8")
        at = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(packed[at])], ["at", "bits"])

    parts = seeds.select("gram").mapInArrow(words, "at long, bits long").groupBy("at").agg(F.expr("bit_or(bits)").alias("bits")).toPandas()
    packed = np.zeros(1 << (BITS - 6), dtype="<i8")
    packed[parts["at"].to_numpy(dtype=np.int64)] = parts["bits"].to_numpy(dtype=np.int64)
    return packed.view(np.uint8)


PASSAGE = "doc_id {id}, text_hash long, start long, words array<long>, grams array<long>"


def _passages(shared, reach: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hasher = np.unpackbits(shared.value, bitorder="little").view(bool), Hasher()
        for batch in batches:
            rows: list[tuple] = []
            for i, text in enumerate(batch.column(2)):
                hashes = hasher(text.as_py())
                found = []
                for places in SEEDS:
                    seeds = grams(hashes, places)
                    first, second = _places(seeds)
                    hits = np.flatnonzero(bits[first])
                    hits = hits[bits[second[hits]]]
                    found.append((hits, seeds[hits]))
                hits, seeds = (np.concatenate(part) for part in zip(*found))
                if len(hits):  # hits whose surroundings meet make one passage
                    order = np.argsort(hits, kind="stable")
                    hits, seeds = hits[order], seeds[order]
                    cuts = np.flatnonzero(np.diff(hits) > 2 * reach) + 1
                    for near, own in zip(np.split(hits, cuts), np.split(seeds, cuts)):
                        low, high = max(0, near[0] - reach), near[-1] + SPAN + reach
                        rows.append((i, int(low), hashes[low:high].view(np.int64), np.unique(own).view(np.int64)))
            at = pa.array([r[0] for r in rows], type=pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at), batch.column(1).take(at), pa.array([r[1] for r in rows], type=pa.int64()),
                    pa.array([r[2] for r in rows], type=pa.list_(pa.int64())), pa.array([r[3] for r in rows], type=pa.list_(pa.int64())),
                ],
                ["doc_id", "text_hash", "start", "words", "grams"],
            )

    return find


def align(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, int]]:
    """Best local alignment of each (passage, item): score, first word and end in the passage.

    All pairs go through one table, row by row of the items. A cell holds its score and, below it, where its alignment
    began (earlier is better); a gap along a row is a running maximum.
    """
    bits = np.int64(32)
    unit, low = np.int64(1) << bits, (np.int64(1) << bits) - 1
    width, height = max(len(p) for p, _ in pairs), max(len(i) for _, i in pairs)
    passages = np.zeros((len(pairs), width), dtype=np.int64)
    items = np.zeros((len(pairs), height), dtype=np.int64)
    for n, (p, i) in enumerate(pairs):
        passages[n, : len(p)], items[n, : len(i)] = p, i
    column = np.arange(width + 1, dtype=np.int64)
    fresh = low - column  # a score of 0 whose alignment would begin at the next word
    slope = -GAP * unit * column
    above = np.broadcast_to(fresh, (len(pairs), width + 1)).copy()
    best, end = np.zeros(len(pairs), dtype=np.int64), np.zeros(len(pairs), dtype=np.int64)
    for row in range(height):
        word = items[:, row : row + 1]
        same = (passages == word) & (word != 0)
        cells = np.maximum(above + GAP * unit, fresh)
        cells[:, 1:] = np.maximum(cells[:, 1:], above[:, :-1] + np.where(same, EQUAL * unit, UNEQUAL * unit))
        cells = np.maximum(np.maximum.accumulate(cells + slope, axis=1) - slope, fresh)
        at = cells.argmax(axis=1)
        top = cells[np.arange(len(pairs)), at]
        better = top > best
        best[better], end[better] = top[better], at[better]
        above = cells
    return [(int(b >> bits), int(low - (b & low)) if b >= unit else 0, int(e)) for b, e in zip(best.tolist(), end.tolist())]


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns 0-3 stay; words of the passage and of the item become score, start and length."""
    for batch in batches:
        pairs = [(np.array(p, dtype=np.int64), np.array(i, dtype=np.int64)) for p, i in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())]
        order = sorted(range(len(pairs)), key=lambda n: (len(pairs[n][0]), len(pairs[n][1])))
        found: list[tuple] = [()] * len(pairs)
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and (to - at + 1) * (len(pairs[order[to]][0]) + 1) <= CELLS:
                to += 1
            for n, result in zip(order[at:to], align([pairs[n] for n in order[at:to]])):
                found[n] = result
            at = to
        score = [r[0] / (EQUAL * len(p[1])) for r, p in zip(found, pairs)]
        start = [s + r[1] for s, r in zip(batch.column(3).to_pylist(), found)]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(3)), pa.array(score, type=pa.float64()), pa.array(start, type=pa.int64()), pa.array([r[2] - r[1] for r in found], type=pa.int64())],
            ["doc_id", "text_hash", "item", "score", "start", "length"],
        )


def contaminated(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """The best passage of each document for each item that scores ``threshold`` or more.

    ``doc_id``, ``text_hash`` (of the whole text), ``item_id``, ``score`` (share of the highest score the item allows),
    ``start`` and ``length`` of the passage in normalised words. Missing and empty texts hold no passages; an item with
    fewer than four words has no seed and is not looked for; items with the same text are aligned once and each reported; rows of
    ``docs`` that repeat give one result; other columns are not used.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kinds = {"id": docs.schema[doc_id].dataType.simpleString(), "item": benchmark.schema[item_id].dataType.simpleString()}
    items = stash(
        benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where("text IS NOT NULL AND item_id IS NOT NULL").distinct()
        .mapInArrow(_item_rows, f"item_id {kinds['item']}, words array<long>, grams array<long>").where(F.size("grams") > 0),
        "items",
    )
    named = items.withColumn("item", F.xxhash64("words"))
    texts = stash(named.select("item", "words", "grams").dropDuplicates(["item"]), "item-texts")
    seeds = _seeds(texts)
    longest = texts.agg(F.max(F.size("words"))).first()[0] or 0
    shared = spark.sparkContext.broadcast(_bitmap(seeds))
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    reach = int(1.5 * longest)  # an alignment that scores has fewer gaps than the item has words
    found = stash(
        narrow.mapInArrow(_passages(shared, reach), PASSAGE.format(**kinds)).withColumn("passage", F.xxhash64("doc_id", "text_hash", "start")), "passages"
    )
    pairs = found.select("passage", F.explode("grams").alias("gram")).join(seeds, "gram").select("passage", "item").distinct()
    both = pairs.join(found.dropDuplicates(["passage"]), "passage").join(texts.select("item", F.col("words").alias("item_words")), "item")
    result = "doc_id {id}, text_hash long, item long, score double, start long, length long".format(**kinds)
    scored = both.select("doc_id", "text_hash", "item", "start", "words", "item_words").mapInArrow(_scored, result).where(F.col("score") >= threshold)
    best = F.max_by(F.struct("score", "start", "length"), F.struct("score", -F.col("start"))).alias("best")
    of_text = scored.groupBy("doc_id", "text_hash", "item").agg(best)
    return of_text.join(named.select("item", "item_id"), "item").select("doc_id", "text_hash", "item_id", "best.*")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item, with their columns; rows without a text stay."""
    hashes = stash(contaminated(docs, benchmark, text=text).select("text_hash").distinct(), "contaminated")
    known = hashes.select(F.col("text_hash").alias("contaminated_hash"))
    return docs.join(known, F.xxhash64(docs["`" + text.replace("`", "``") + "`"]) == known["contaminated_hash"], "left_anti")
