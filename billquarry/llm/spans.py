"""Substring de-duplication by sliding sentence spans.

A text is read as sentences: they end with a word that ends with ``.``, ``!`` or ``?``, or with a line. In every window of
``WINDOW`` words without such an end the word with the smallest hash (the last of equal ones) ends a piece, and pieces are
sentences too. So cuts depend on the words around them alone: a passage is cut alike wherever it stands, but for some words
at its ends if it begins or ends inside a sentence, and no sentence has more than ``WINDOW`` words.

From every sentence forwards and backwards the shortest run with at least ``SENTENCES`` sentences and ``WORDS`` words is
hashed. A passage that repeats is made of such runs up to both of its ends. Runs join globally by their hash; the first is
the one of the smallest document id, and there the first place. Sentences covered by any other one are removed, where those
that follow each other have ``PASSAGE`` words or more.

One document sends each run once, however often it holds it. The smallest document of a run and the number of its
documents are plain aggregates, and only runs of several documents are joined back, so a passage that a third of all
documents share is combined before each shuffle.
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

#: Least sentences and words of a run; words in a window that holds an end; least words of a stretch that is removed.
SENTENCES, WORDS, WINDOW, PASSAGE = 2, 16, 12, 25
_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
_ENDS = frozenset(".!?")
_WORD = re.compile(r"\S+")


class _Codes(dict):
    """A 64-bit hash of each word asked for, its lowest bit set if the word ends a sentence; forgets all when it is full."""

    def __missing__(self, word: str) -> int:
        code = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) & ~1 | (word[-1] in _ENDS)
        if len(word) <= 40:
            if len(self) >= 1 << 18:
                self.clear()
            self[word] = code
        return code


_CODES = _Codes()


class Powers:
    """Powers of an odd base and of its inverse modulo 2 ** 64, as many as are asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def __call__(self, count: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < count:
            size = np.uint64(pow(_BASE, len(self.up), 1 << 64)), np.uint64(pow(pow(_BASE, -1, 1 << 64), len(self.up), 1 << 64))
            self.up, self.down = np.concatenate([self.up, self.up * size[0]]), np.concatenate([self.down, self.down * size[1]])
        return self.up[:count], self.down[:count]


_POWERS = Powers()


def sentence_ends(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words of a text, and for each sentence the number of words up to its end."""
    found: list[np.ndarray] = []
    lines, count = [], 0
    for line in text.split("\n"):
        if words := line.split():
            found.append(np.fromiter(map(_CODES.__getitem__, words), dtype=np.uint64, count=len(words)))
            count += len(words)
            lines.append(count)
    codes = np.concatenate(found) if found else np.empty(0, dtype=np.uint64)
    ends = np.zeros(count + 1, dtype=bool)
    ends[1:] = (codes & np.uint64(1)).astype(bool)
    ends[lines] = True
    if count >= WINDOW:
        upto = np.cumsum(ends)  # ends[n] says that n words end a sentence
        free = np.flatnonzero(upto[WINDOW:] == upto[: count - WINDOW + 1])
        if len(free):
            # upper half of the hash, then the place counted backwards: the least of a window is the last of equal hashes
            least, size = codes & np.uint64(0xFFFFFFFF00000000) | np.uint64(0xFFFFFFFF) - np.arange(count, dtype=np.uint64), 1
            while size < WINDOW:
                more = min(size, WINDOW - size)
                least = np.minimum(least[:-more], least[more:])
                size += more
            ends[(np.uint64(0x100000000) - (least[free] & np.uint64(0xFFFFFFFF))).astype(np.int64)] = True
    return codes, np.flatnonzero(ends)


def runs(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first sentence and end of every run of a text; runs of the same words have the same hash."""
    words, ends = sentence_ends(text)
    count = len(ends)
    if count < SENTENCES:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    upto = np.concatenate([[0], ends])
    forward = np.maximum(np.searchsorted(upto, upto[:-1] + WORDS), np.arange(count) + SENTENCES)
    backward = np.minimum(np.searchsorted(upto, upto[1:] - WORDS, side="right") - 1, np.arange(1, count + 1) - SENTENCES)
    low, high = np.flatnonzero(forward <= count), np.flatnonzero(backward >= 0)
    codes = np.unique(np.concatenate([low * (count + 1) + forward[low], backward[high] * (count + 1) + high + 1]))
    first, end = np.divmod(codes, count + 1)
    up, down = _POWERS(len(words) + 1)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(words * up[: len(words)], dtype=np.uint64)])
    hashes = (sums[upto[end]] - sums[upto[first]]) * down[upto[first]] + (upto[end] - upto[first]).astype(np.uint64)
    hashes ^= hashes >> np.uint64(32)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    return hashes ^ (hashes >> np.uint64(29)), first, end


def without(text: str, spans: list[int]) -> tuple[str, int, int]:
    """The text without the sentences of the spans (first << 32 | end), how many are gone, and how many it had.

    What stands between two kept sentences that are neighbours stays as it is; where sentences are gone between them, the
    white space before the later one parts them.
    """
    _, ends = sentence_ends(text)
    gone = np.zeros(len(ends) + 1, dtype=np.int64)
    for span in spans:
        gone[span >> 32] += 1
        gone[span & 0xFFFFFFFF] -= 1
    covered = np.cumsum(gone[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
    upto = np.concatenate([[0], ends])
    removed = np.zeros(len(ends), dtype=bool)
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        removed[a:b] = upto[b] - upto[a] >= PASSAGE
    if not removed.any():
        return text, 0, len(ends)
    places = [m.span() for m in _WORD.finditer(text)]
    starts = [0, *ends[:-1].tolist()]
    kept: list[str] = []
    for n, (a, b) in enumerate(zip(starts, ends.tolist())):
        if not removed[n]:
            if kept or n == 0:
                kept.append(text[places[a - 1][1] if a else 0 : places[a][0]])
            kept.append(text[places[a][0] : places[b - 1][1]])
    if kept and not removed[-1]:
        kept.append(text[places[-1][1] :])
    return "".join(kept), int(removed.sum()), len(ends)


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, spans, again = [], [], []
        for text in batch.column(2).to_pylist():
            hashed, first, end = runs(text)
            code = (first << 32) | end
            distinct, at = np.unique(hashed, return_index=True)  # places are ascending, so each is the first one
            later = np.ones(len(hashed), dtype=bool)
            later[at] = False
            hashes.append(distinct.view(np.int64))
            spans.append(code[at])
            again.append(code[later])
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *(pa.array(c, type=longs) for c in (hashes, spans, again))], ["doc_id", "text_hash", "hashes", "spans", "again"]
        )


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [without(text, spans or []) for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([f[0] for f in found], type=pa.string()), *(pa.array([f[n] for f in found], type=pa.int64()) for n in (1, 2))],
            ["doc_id", "text", "n_removed", "n_sentences"],
        )


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``text`` without repeated passages, ``n_removed`` and ``n_sentences`` of every row of ``docs``.

    A missing text is given as empty; a text with fewer than ``SENTENCES`` sentences or ``WORDS`` words is never changed.
    Rows that share an id are one document: what repeats only between them stays. Rows without an id come after all
    others and count as one document too. Repeated rows stay; other columns of ``docs`` are not used.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    source = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    listed = f"doc_id {kind}, text_hash long, hashes array<long>, spans array<long>, again array<long>"
    held = stash(source.mapInArrow(_run_rows, listed), "spans")
    each = held.select("doc_id", "text_hash", F.explode(F.arrays_zip("hashes", "spans")).alias("r")).select("doc_id", "text_hash", F.col("r.hashes").alias("hash"), F.col("r.spans").alias("span"))
    # a missing id is ignored by min and max: a run with ids has its first among them
    several = each.groupBy("hash").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.max(F.col("doc_id").isNull()).alias("without_id"))
    several = several.where((F.col("first_id") != F.col("last_id")) | F.col("first_id").isNotNull() & F.col("without_id")).select("hash", "first_id")
    several = stash(several, "repeated-runs")  # the join below is then fed by shuffles alone, and a hot run can be split
    other = each.join(several, "hash").where(~F.col("doc_id").eqNullSafe(F.col("first_id"))).select("doc_id", "text_hash", "span")
    own = held.where(F.size("again") > 0).select("doc_id", "text_hash", F.explode("again").alias("span"))
    # the spans of one text: as many as it has sentences, twice at most
    covered = other.unionByName(own).groupBy("doc_id", "text_hash").agg(F.collect_set("span").alias("covered"))
    covered = stash(covered, "covered").select(F.col("doc_id").alias("other_id"), F.col("text_hash").alias("other_hash"), "covered")
    joined = source.join(covered, (F.col("text_hash") == F.col("other_hash")) & F.col("doc_id").eqNullSafe(F.col("other_id")), "left")
    return joined.select("doc_id", "text", "covered").mapInArrow(_cleaned, f"doc_id {kind}, text string, n_removed long, n_sentences long")
