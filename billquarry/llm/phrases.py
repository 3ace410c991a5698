"""Phrase collocations by prefix-free parsing: texts become a dictionary of chunks, n-grams are counted inside it.

A text is cut where the hash of two words meets a condition, so that equal passages are cut alike wherever they stand.
Each chunk also holds the words an n-gram may need beyond its end, but owns only the words up to there: an n-gram belongs
to the chunk that owns its first word, and overlaps are counted once. Equal chunks are one dictionary entry with its
frequency, and n-grams are counted in distinct chunks only, weighted by it.

Counts come in two passes. Hashes of words and word pairs are summed first, and those frequent enough marked in a bitmap
of fixed size. The second pass counts phrases as text, all of whose words and pairs are marked; a mark too many costs work
and changes nothing. Later steps are joins and aggregates over frequent phrases.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billquarry.llm import marks, words
from billquarry.llm.shared import small_batches, stash

#: Lower-case letters; marks that end a piece become line ends, tabs become spaces.
TABLE = bytes(10 if b in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if b == 9 else words.LOWER[b] for b in range(256))
SEPARATORS = b" \n"


@dataclass(frozen=True)
class Plan:
    """Phrases of up to ``longest`` words that occur ``least`` times; the first ``top`` of each language.

    ``every``: words between cuts on average (a power of two); ``bits``: size of the bitmap, as a power of two;
    ``held``: phrases a task counts before it hands them on. They change no result.
    """

    longest: int = 4
    least: int = 30
    contained: int = 80
    top: int = 2000
    every: int = 64
    bits: int = 26
    held: int = 1 << 20


COLLOCATIONS = Plan()


def _piece_of(found: words.Words) -> np.ndarray:
    """Number of the piece each word is in; a text begins a new one."""
    raw = np.frombuffer(found.data, dtype=np.uint8)
    return np.cumsum(raw == 10)[found.starts] + found.text


def _chunks(plan: Plan):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            found = words.words_of(batch.column(1), TABLE, SEPARATORS)
            count = len(found.starts)
            if not count:
                continue
            pairs = np.append(words.windows(found.hashes, 2), np.uint64(0))
            cut = (pairs & np.uint64(plan.every - 1)) == 0
            cut[found.first[:-1][found.first[:-1] < count]] = True
            begin = np.flatnonzero(cut)
            # a stretch without a cut is cut by length
            own = np.diff(np.append(begin, count))
            most = 16 * plan.every
            pieces = -(-own // most)
            begin = np.repeat(begin, pieces) + most * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
            end = np.append(begin[1:], count)
            last = np.minimum(end + plan.longest - 1, found.first[found.text[begin] + 1]) - 1
            lows, highs = found.starts[begin].tolist(), found.ends[last].tolist()
            counted: dict[tuple, int] = {}
            for low, high, text, size in zip(lows, highs, found.text[begin].tolist(), (end - begin).tolist()):
                key = (langs[text], size, found.data[low:high])
                counted[key] = counted.get(key, 0) + 1
            columns = list(zip(*counted))
            kinds = [pa.string(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, type=k) for c, k in zip(columns, kinds)), pa.array(list(counted.values()), type=pa.int64())], ["lang", "own", "chunk", "n"])

    return rows


def _grams(batch: pa.RecordBatch, plan: Plan):
    """Of a batch of the dictionary: words, and for 1, 2, ... words the places where a phrase may begin that the chunk owns."""
    found = words.words_of(batch.column(2), words.LOWER, SEPARATORS)
    piece = _piece_of(found)
    count = len(found.starts)
    of_chunk = np.arange(count) - found.first[found.text]
    owned = of_chunk < batch.column(1).to_numpy()[found.text]
    weight = batch.column(3).to_numpy()[found.text]
    langs = batch.column(0).dictionary_encode()
    salt = words.mixed(np.array([_name_hash(v) for v in langs.dictionary.to_pylist()] or [0], dtype=np.uint64))
    lang = salt[langs.indices.to_numpy()][found.text]
    places = []
    for size in range(1, plan.longest + 1):
        at = np.flatnonzero(owned[: max(count - size + 1, 0)])
        places.append(at[piece[at + size - 1] == piece[at]])
    return found, weight, lang, places


def _name_hash(name: str) -> int:
    found = words.words_of(pa.array([name]), words.LOWER, b"")
    return int(found.hashes[0]) if len(found.hashes) else 0


def _keys(found: words.Words, lang: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    whole = words.windows(found.hashes, size)
    return words.mixed(whole[at] + lang[at] * np.uint64(2 * size + 1))


def _summed(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the first place of each, and their sums."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.empty(0, dtype=np.int64)
    return ordered[first], order[first], np.add.reduceat(weight[order], first) if len(first) else weight[:0]


def _hashed(plan: Plan):
    """Counts of the hashes of words and pairs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        room = 0

        def handed() -> pa.RecordBatch:
            keys, _, sums = _summed(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sums)], ["key", "n"])

        for batch in batches:
            found, weight, lang, places = _grams(batch, plan)
            for size in (1, 2):
                at = places[size - 1]
                keys, _, sums = _summed(_keys(found, lang, at, size), weight[at])
                held.append((keys, sums))
                room += len(keys)
            if room > 4 * plan.held:
                yield handed()
                held, room = [], 0
        if held:
            yield handed()

    return rows


def _counted(shared, plan: Plan):
    """Counts of phrases, as text, all of whose words and pairs are marked."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, int] = {}

        def handed() -> pa.RecordBatch:
            langs, sizes, phrases = zip(*held)
            columns = [pa.array(langs, type=pa.string()), pa.array(sizes, type=pa.int32()), pa.array(phrases, type=pa.binary()).cast(pa.string()), pa.array(list(held.values()), type=pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["lang", "words", "phrase", "n"])

        for batch in batches:
            found, weight, lang, places = _grams(batch, plan)
            langs = batch.column(0).to_pylist()
            # of every word, also of those a chunk doesn't own: is it marked, and the pair it begins
            count = len(found.starts)
            everywhere = np.arange(count)
            good = marks.marked(shared.value, _keys(found, lang, everywhere, 1), plan.bits)
            pair = np.zeros(count, dtype=bool)
            pair[: max(count - 1, 0)] = marks.marked(shared.value, _keys(found, lang, everywhere[: max(count - 1, 0)], 2), plan.bits)
            for size in range(1, plan.longest + 1):
                at = places[size - 1]
                keep = good[at]
                for k in range(size - 1):
                    keep &= pair[at + k]
                at = at[keep]
                keys, first, sums = _summed(_keys(found, lang, at, size), weight[at])
                at = at[first]
                for low, high, text, n in zip(found.starts[at].tolist(), found.ends[at + size - 1].tolist(), found.text[at].tolist(), sums.tolist()):
                    phrase = found.data[low:high]
                    key = (langs[text], size, b" ".join(phrase.split(b" ")) if b"  " not in phrase else b" ".join(filter(None, phrase.split(b" "))))
                    held[key] = held.get(key, 0) + n
            if len(held) > plan.held:
                yield handed()
                held = {}
        if held:
            yield handed()

    return rows


def frequent_phrases(docs: DataFrame, plan: Plan = COLLOCATIONS, lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two written tables: (``lang``, ``words``, ``phrase``, ``n``) of all phrases that occur often enough, single words
    too; and (``lang``, ``n``), the words of each language."""
    small_batches(docs.sparkSession)
    source = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parsed = source.mapInArrow(_chunks(plan), "lang string, own int, chunk binary, n long")
    dictionary = stash(parsed.groupBy("lang", "own", "chunk").agg(F.sum("n").alias("n")).select("lang", "own", "chunk", "n"), "phrases-dictionary")
    totals = stash(dictionary.groupBy("lang").agg(F.expr("sum(own * n)").alias("n")), "phrases-totals")
    sums = dictionary.mapInArrow(_hashed(plan), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    often = stash(sums.where(F.col("n") >= plan.least).select("key"), "phrases-marks")
    shared = docs.sparkSession.sparkContext.broadcast(marks.marks_of(often, plan.bits))
    counted = dictionary.mapInArrow(_counted(shared, plan), "lang string, words int, phrase string, n long")
    often = counted.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= plan.least)
    return stash(often, "phrases-frequent"), totals


def collocations(docs: DataFrame, plan: Plan = COLLOCATIONS, lang: str = "lang", text: str = "text") -> DataFrame:
    """(``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``): the best phrases of each language.

    Words are runs without spaces or tabs inside pieces between marks or line ends, A-Z in lower case. ``a``: how often the
    phrase occurs; of all cuts into two parts, ``l`` and ``r`` are how often the parts of the worst one do, and ``score`` is
    floor(2000000 a / (l + r)); of equal ones the one with the shortest first part counts. Phrases that stand inside longer
    ones are left out if one of those occurs ``contained`` percent as often. Missing and empty texts have no words; a missing
    language is ``und``; a language without frequent phrases has no rows. Repeated rows count as often as they stand.
    """
    often, totals = frequent_phrases(docs, plan, lang, text)
    held = often.where("words > 1").select("lang", "words", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("_w"))
    part = "array_join(slice(_w, {}, {}), ' ')".format
    cuts = held.select("lang", "phrase", "words", "a", "_w", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = stash(cuts.select("lang", "phrase", "words", "a", "k", F.expr(part(1, "k")).alias("left"), F.expr(part("k + 1", "words - k")).alias("right")), "phrases-cuts")
    of_left = often.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    of_right = often.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    with_left = stash(cuts.join(of_left, ["lang", "left"]), "phrases-left")
    # decimals: the products may pass 64 bits
    score = F.expr("(CAST(2000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(19, 0))) DIV (CAST(l AS DECIMAL(19, 0)) + CAST(r AS DECIMAL(19, 0)))")
    scored = with_left.join(of_right, ["lang", "right"]).withColumn("score", score)
    worst = scored.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = held.where("words > 2").select("lang", "words", "a", "_w", F.explode(F.expr("sequence(2, words - 1)")).alias("size"))
    inner = inner.select("lang", "a", "_w", "size", F.explode(F.expr("sequence(1, words - size + 1)")).alias("at"))
    longer = inner.groupBy("lang", F.expr(part("at", "size")).alias("phrase")).agg(F.max("a").alias("most"))
    kept = worst.join(longer, ["lang", "phrase"], "left").where(
        F.expr(f"most IS NULL OR CAST(100 AS DECIMAL(3, 0)) * CAST(most AS DECIMAL(19, 0)) < CAST({plan.contained} AS DECIMAL(3, 0)) * CAST(a AS DECIMAL(19, 0))")
    )
    flat = kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    ranked = flat.withColumn("rank", F.expr("row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)")).where(F.col("rank") <= plan.top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
