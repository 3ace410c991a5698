"""Best passages by 0.75 semantic + 0.25 lexical score, by a threshold over two ranked lists.

The semantic score is the cosine of hashed vectors: one matrix product of a block of questions with a batch of passages.
The lexical score is at most 1, so a passage whose semantic score leaves it below the k-th best score seen is dropped
before its words are compared with the question. Each task keeps its k best passages of a question and what may tie with
them; the exact scores are then computed once more from whole numbers and ranked by Spark. Nothing is joined on words or
on dimensions, and no list of pairs is ever written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billquarry import vocabulary as V
from billquarry.functions import text as X
from billquarry.operators.retrieval import top_k
from billquarry.storage import written

SEMANTIC, LEXICAL, PHRASE = 0.75, 0.25, 0.35
#: Questions compared at a time, words a task remembers, and room for rounding to four places.
BLOCK, REMEMBERED, ROOM = 512, 500_000, 2e-4


class Hashed:
    """Dimension and sign of tokens, by their MD5 digests."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, int]] = {}

    def _of(self, token: str) -> tuple[int, int]:
        if token not in self.known:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            digest = hashlib.md5(token.encode("utf-8", "surrogatepass")).digest()
            self.known[token] = (int.from_bytes(digest[:4], "big") % V.HASH_DIMENSIONS, 1 if digest[4] % 2 == 0 else -1)
        return self.known[token]

    def matrix(self, tokens: pa.ListArray) -> np.ndarray:
        """Signed counts, a row for each list."""
        lengths = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        words = tokens.flatten().dictionary_encode()
        where = np.array([self._of(w) for w in words.dictionary.to_pylist()], dtype=np.int64).reshape(-1, 2)
        at = words.indices.to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(tokens)), lengths)
        cells = np.bincount(row * V.HASH_DIMENSIONS + where[at, 0], weights=where[at, 1], minlength=len(tokens) * V.HASH_DIMENSIONS)
        return cells.reshape(len(tokens), V.HASH_DIMENSIONS)


@dataclass
class Questions:
    """A block of questions: vectors, square lengths, tokens with their repeats, phrases."""

    ids: list
    vectors: np.ndarray
    norms: np.ndarray
    sizes: np.ndarray
    phrases: np.ndarray
    vocabulary: dict[str, int]
    repeats: list[tuple[np.ndarray, np.ndarray]]


def _asked(questions: DataFrame, expand: bool) -> DataFrame:
    expanded = questions.select("qid", X.expand_question(F.col("question")).alias("question")) if expand else questions
    tokens = X.long_tokens(F.col("question"))
    phrases = F.array(*[F.array_join(tokens, " ").contains(p) for p in V.IMPORTANT_PHRASES])
    return expanded.select("qid", X.plain_tokens(F.col("question")).alias("plain"), tokens.alias("long"), phrases.alias("phrases"))


def _block(rows: list) -> Questions:
    vectors = Hashed().matrix(pa.array([r["plain"] or [] for r in rows], type=pa.list_(pa.string())))
    vocabulary: dict[str, int] = {}
    repeats = []
    for r in rows:
        counts: dict[int, int] = {}
        for token in r["long"] or []:
            at = vocabulary.setdefault(token, len(vocabulary))
            counts[at] = counts.get(at, 0) + 1
        repeats.append((np.array(list(counts), dtype=np.int64), np.array(list(counts.values()), dtype=np.int64)))
    phrases = np.array([[bool(p) for p in r["phrases"] or [False] * len(V.IMPORTANT_PHRASES)] for r in rows], dtype=bool).reshape(len(rows), -1 if rows else len(V.IMPORTANT_PHRASES))
    return Questions([r["qid"] for r in rows], vectors, (vectors * vectors).sum(axis=1), np.array([len(r["long"] or []) for r in rows]), phrases, vocabulary, repeats)


class Best:
    """The best passages of one question so far: scores, keys and the whole numbers behind the score."""

    def __init__(self, k: int):
        self.k, self.floor = k, -np.inf
        self.rows: list[tuple] = []

    def add(self, rows: list[tuple]) -> None:
        kept = sorted([*self.rows, *rows], key=lambda r: (-r[0], r[1]))
        if len(kept) > self.k:
            self.floor = kept[self.k - 1][0]
            out, same = [], 0
            for n, row in enumerate(kept):
                if row[0] < self.floor - ROOM:
                    break
                same = same + 1 if n and kept[n - 1][0] == row[0] else 1
                if same <= self.k:  # of equal scores only the first keys can be among the k best
                    out.append(row)
            kept = out
        self.rows = kept


def _compared(asked: Questions, keys: int, k: int, names: list[str], kinds: list[pa.DataType], semantic: float, lexical: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, best = Hashed(), [Best(k) for _ in asked.ids]
        for batch in batches:
            if not batch.num_rows:
                continue
            rows_keys = list(zip(*(c.to_pylist() for c in batch.columns[:keys])))
            vectors = hashed.matrix(batch.column(keys)) if semantic else np.zeros((batch.num_rows, V.HASH_DIMENSIONS))
            norms = (vectors * vectors).sum(axis=1)
            long = batch.column(keys + 1)
            lengths = long.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            words = long.flatten().dictionary_encode()
            place = np.array([asked.vocabulary.get(w, -1) for w in words.dictionary.to_pylist()] or [-1], dtype=np.int64)
            at = place[words.indices.to_numpy(zero_copy_only=False)]
            row = np.repeat(np.arange(batch.num_rows), lengths)[at >= 0]
            holds = np.zeros((batch.num_rows, len(asked.vocabulary) + 1), dtype=bool)
            holds[row, at[at >= 0]] = True
            flags = np.array([[bool(x) for x in v or []] or [False] * asked.phrases.shape[1] for v in batch.column(keys + 2).to_pylist()])
            dots = asked.vectors @ vectors.T
            cosine = dots / np.sqrt(np.maximum(np.outer(asked.norms, norms), 1e-300))
            for n, held in enumerate(best):
                tokens, repeats = asked.repeats[n]
                if not len(tokens):
                    continue
                # what even a lexical score of 1 could not lift to the k-th place is left out
                able = np.flatnonzero(semantic * cosine[n] + lexical >= held.floor - ROOM)
                overlap = holds[np.ix_(able, tokens)] @ repeats
                able, overlap = able[overlap > 0], overlap[overlap > 0]
                both = (flags[able] & asked.phrases[n]).sum(axis=1)
                score = semantic * cosine[n, able] + lexical * np.minimum(1.0, overlap / asked.sizes[n] + both * PHRASE)
                if len(able) > 4 * k:
                    floor = max(held.floor, np.partition(score, len(score) - k)[len(score) - k])
                    high = np.flatnonzero(score >= floor - ROOM)
                    able, overlap, both, score = able[high], overlap[high], both[high], score[high]
                else:
                    high = np.flatnonzero(score >= held.floor - ROOM)
                    able, overlap, both, score = able[high], overlap[high], both[high], score[high]
                if len(able):
                    held.add([(s, rows_keys[i], int(dots[n, i]), int(norms[i]), int(o), int(b)) for s, i, o, b in zip(score.tolist(), able.tolist(), overlap.tolist(), both.tolist())])
        found = [(asked.ids[n], *r[1], r[2], int(asked.norms[n]), r[3], r[4], int(asked.sizes[n]), r[5]) for n, held in enumerate(best) for r in held.rows]
        columns = list(zip(*found)) or [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(columns, kinds)], names)

    return run


def _found(questions: DataFrame, passages: DataFrame, passage_keys: list[str], k: int, expand: bool, semantic: float, lexical: float) -> DataFrame:
    """What each task kept, as whole numbers: the k best passages of each question are among it."""
    from pyspark.sql.pandas.types import to_arrow_type

    asked = written(_asked(questions, expand), "hybrid-questions")
    flags = F.array(*[F.lower("text").contains(p) for p in V.IMPORTANT_PHRASES])
    plain = X.plain_tokens(F.col("text")) if semantic else F.array().cast("array<string>")
    prepared = passages.select(*passage_keys, plain.alias("_plain"), X.long_tokens(F.col("text")).alias("_long"), flags.alias("_phrases"))
    blocks = max(1, -(-asked.count() // BLOCK))
    if blocks > 1:
        prepared = written(prepared, "hybrid-passages")
    names = ["qid", *passage_keys, "_dot", "_nq", "_np", "_overlap", "_asked", "_both"]
    fields = [questions.schema["qid"], *(passages.schema[c] for c in passage_keys)]
    kinds = [to_arrow_type(f.dataType) for f in fields] + [pa.int64()] * 6
    schema = ", ".join([f"`{n}` {f.dataType.simpleString()}" for n, f in zip(names, fields)] + [f"{n} long" for n in names[len(fields) :]])
    found = None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block).collect()
        part = prepared.mapInArrow(_compared(_block(rows), len(passage_keys), k, names, kinds, semantic, lexical), schema)
        found = part if found is None else found.unionByName(part)
    return found


def _lexical() -> Column:
    return F.least(F.lit(1.0), F.col("_overlap") / F.col("_asked") + F.col("_both") * F.lit(PHRASE))


def search(questions: DataFrame, passages: DataFrame, passage_keys: list[str], k: int = 5) -> DataFrame:
    """(``qid``, keys, ``score``, ``rank``) of the best passages of each question; k is clamped to 1..20.

    A passage without a word of the question does not appear, whatever its semantic score; scores are rounded to four
    places and equal ones ranked by key. ``questions``: ``qid``, ``question``, read in blocks of at most about ``BLOCK``.
    """
    k = max(1, min(20, k))
    found = _found(questions, passages, passage_keys, k, True, SEMANTIC, LEXICAL)
    semantic = F.coalesce(F.try_divide(F.col("_dot").cast("double"), F.sqrt(F.col("_nq").cast("double") * F.col("_np"))), F.lit(0.0))
    scored = found.select("qid", *passage_keys, F.round(semantic * SEMANTIC + _lexical() * LEXICAL, 4).alias("score"))
    return top_k(scored, ["qid"], [F.desc("score"), *[F.col(c) for c in passage_keys]], k)


def lexical(questions: DataFrame, passages: DataFrame, passage_keys: list[str], k: int) -> DataFrame:
    """(``qid``, keys, ``lexical``, ``rank``) of the k passages of each question with the largest share of its words, plus
    0.35 per important phrase in both, at most 1; equal ones are ranked by key."""
    found = _found(questions, passages, passage_keys, k, False, 0.0, 1.0)
    scored = found.select("qid", *passage_keys, _lexical().alias("lexical"))
    return top_k(scored, ["qid"], [F.desc("lexical"), *[F.col(c) for c in passage_keys]], k)
