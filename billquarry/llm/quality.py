"""Quality rules with limits taken from the data: quantile sketches per language and source, then a joined filter.

A sketch is a histogram of buckets with a relative width of at most 1/32, one row a bucket: two sketches are merged by
adding counts, so they are built by partial aggregates, and those of a language or of everything are sums of the finer
ones. A group with few documents takes the limits of its language, and a small language those of all documents.

A limit is read off the quantiles of its sketch. From the median outwards the body of a group goes on as long as the next
quantile follows the one before without a jump; the limit is the farthest value that would still have followed on from the
body's last quantile. What a jump is (a factor and a step) is fixed for a measure; where it lies is each group's own.
Quantiles are shares, so junk of up to some 40 % of a group does not move its limits, and the size of a group does not either.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billquarry.llm.shared import small_batches, stash

#: Base rules: fewest words; most words in repeated windows, in hundredths.
LEAST_WORDS, MOST_REPEATED = 20, 30
#: Words in a window, and documents a group needs for limits of its own.
WINDOW, GROUP = 8, 100
#: Per cents of the quantiles from the median outwards, above it; below it they are mirrored.
SHARES = (50, 60, 70, 80, 85, 90, 95, 98, 99)
#: Measures, each an integer per document; a quantile above ``factor`` times the one before plus ``step`` is a jump; lower limits too?
MEASURES = {
    "length": ("100 * word_chars DIV GREATEST(n_words, 1)", 1, 80, True),
    "symbols": ("1000 * n_symbols DIV GREATEST(n_words, 1)", 2, 100, False),
    "repeats": ("1000 * n_repeat_words DIV GREATEST(n_words, 1)", 2, 180, False),
    "copies": ("1000 * n_dup_lines DIV GREATEST(n_lines, 1)", 1, 250, False),
    "doubled": ("1000 * n_doubled DIV GREATEST(n_words, 1)", 2, 80, False),
}
#: Short texts scatter more: widths grow by this many words over the number of words.
SLACK = 40

_CUT = re.compile(r"[\x20\x09-\x0D]")
_BLOCK = 1 << 20
_SPACE, _SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WINDOW)], dtype=np.uint64)
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_doubled"]


def _word_hashes(text: str) -> np.ndarray:
    found, at = [], 0
    while at < len(text):
        cut = _CUT.search(text, at + _BLOCK)
        to = cut.start() if cut else len(text)
        words = text[at:to].encode("utf-8", "surrogatepass").split()  # bytes know only the ASCII spaces
        found.append(np.fromiter(map(hash, words), dtype=np.int64, count=len(words)))
        at = to
    return np.concatenate(found) if found else np.empty(0, dtype=np.int64)


def _repeated(hashes: np.ndarray) -> int:
    """Words in windows that occur twice or more; windows are compared by 64-bit hashes."""
    count = len(hashes) - WINDOW + 1
    if count < 2:
        return 0
    words = hashes.view(np.uint64)
    windows = np.zeros(count, dtype=np.uint64)
    for k in range(WINDOW):
        windows += (words[k : k + count] ^ (words[k : k + count] >> np.uint64(29))) * _FACTORS[k]
    ordered = np.sort(windows)
    twice = ordered[1:] == ordered[:-1]
    if not twice.any():
        return 0
    at = np.flatnonzero(np.isin(windows, ordered[1:][twice]))
    edges = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + WINDOW, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def base_counts(text: str | None) -> tuple[int, ...]:
    """The counts of one text, in the order of COUNTS; ``n_doubled`` are words equal to the word before."""
    if not text:
        return (0,) * len(COUNTS)
    hashes = _word_hashes(text)
    lines = [line for line in text.split("\n") if line.strip(_SPACE)]
    return (
        len(hashes), len(text) - sum(map(text.count, _SPACE)), sum(map(text.count, _SYMBOLS)),
        len(lines) - len(set(lines)), _repeated(hashes), len(lines), int((hashes[1:] == hashes[:-1]).sum()),
    )


def with_counts(docs: DataFrame, name: str, text: str = "text") -> DataFrame:
    """``docs`` with a struct column of the base counts."""

    small_batches(docs.sparkSession)

    @F.pandas_udf(", ".join(f"{c} long" for c in COUNTS))
    def counts(texts):
        import pandas as pd

        return pd.DataFrame([base_counts(t if isinstance(t, str) else None) for t in texts], columns=COUNTS, dtype="int64")

    return docs.withColumn(name, counts(F.coalesce(F.col(text), F.lit(""))))


def _base_failed() -> Column:
    return F.expr(f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words")


def _limit(struct: str, factor: int, step: int, above: bool) -> str:
    """SQL: the farthest value that follows on from the body, by the quantiles in a struct."""
    names = [f"{struct}.q{k if above else 100 - k}" for k in SHARES]
    follows = [f"{factor} * {q} + {step}" if above else f"{q} - {step}" for q in names]
    jumps = "".join(f"WHEN {nxt} {'>' if above else '<'} {far} THEN {far} " for far, nxt in zip(follows, names[1:]))
    return f"CASE {jumps}ELSE {follows[-1]} END"


def limits(counts: DataFrame) -> DataFrame:
    """Median and distances of the limits from it, of every measure for each (``lang``, ``source``) of ``counts``.

    Documents without words are in no sketch, but their groups are in the result.
    """
    bucket = "IF(v < 64, v, shiftleft(shiftright(v, length(bin(v)) - 6), length(bin(v)) - 6))"
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.expr(f"IF(n_words > 0, {e[0]}, NULL)").alias("v")) for m, e in MEASURES.items()]))
    fine = stash(
        counts.select("lang", "source", values.alias("x")).select("lang", "source", "x.m", F.col("x.v").alias("v"))
        .groupBy("lang", "source", "m", F.expr(bucket).alias("bucket")).agg(F.count("*").alias("n")),
        "quality-sketch",
    )
    full = fine.where("bucket IS NOT NULL")
    levels = (
        full.selectExpr("2 AS level", "lang", "source", "m", "bucket", "n")
        .unionByName(full.groupBy("lang", "m", "bucket").agg(F.sum("n").alias("n")).selectExpr("1 AS level", "lang", "CAST(NULL AS STRING) AS source", "m", "bucket", "n"))
        .unionByName(full.groupBy("m", "bucket").agg(F.sum("n").alias("n")).selectExpr("0 AS level", "CAST(NULL AS STRING) AS lang", "CAST(NULL AS STRING) AS source", "m", "bucket", "n"))
    )
    # a sketch has some hundred buckets at most, so that its window is small however many documents it counts
    running = levels.selectExpr(
        "*", "SUM(n) OVER (PARTITION BY level, lang, source, m ORDER BY bucket) AS upto", "SUM(n) OVER (PARTITION BY level, lang, source, m) AS total"
    )
    shares = sorted({*SHARES, *(100 - k for k in SHARES)})
    quantiles = running.groupBy("level", "lang", "source", "m").agg(
        F.max("total").alias("total"), *[F.expr(f"MIN(IF(100 * upto >= {k} * total, bucket, NULL))").alias(f"q{k}") for k in shares]
    )
    columns = ["total", *(f"q{k}" for k in shares)]
    own, language, everything = (quantiles.where(F.col("level") == k).select("lang", "source", "m", F.struct(*columns).alias(f"s{k}")) for k in (2, 1, 0))
    groups = fine.select("lang", "source", "m").distinct()
    found = (
        groups.alias("g")
        .join(own.alias("o"), F.expr("g.lang <=> o.lang AND g.source <=> o.source AND g.m = o.m"), "left")
        .join(language.alias("l"), F.expr("g.lang <=> l.lang AND g.m = l.m"), "left")
        .join(everything.alias("e"), F.expr("g.m = e.m"), "left")
        .selectExpr("g.lang", "g.source", "g.m", f"CASE WHEN s2.total >= {GROUP} THEN s2 WHEN s1.total >= {GROUP} THEN s1 ELSE s0 END AS s")
    )
    wide = []
    for m, (_, factor, step, lower) in MEASURES.items():
        wide += [F.expr(f"MAX(IF(m = '{m}', s.q50, NULL))").alias(f"{m}_median"), F.expr(f"MAX(IF(m = '{m}', {_limit('s', factor, step, True)} - s.q50, NULL))").alias(f"{m}_above")]
        if lower:
            wide.append(F.expr(f"MAX(IF(m = '{m}', s.q50 - ({_limit('s', factor, step, False)}), NULL))").alias(f"{m}_below"))
    return stash(found.groupBy("lang", "source").agg(*wide), "quality-limits")


def _outside() -> str:
    """SQL: some measure is further from its group's median than the limit allows."""
    tests = []
    for m, (value, _, _, lower) in MEASURES.items():
        tests.append(f"(({value}) - {m}_median) * n_words > {m}_above * (n_words + {SLACK})")
        if lower:
            tests.append(f"({m}_median - ({value})) * n_words > {m}_below * (n_words + {SLACK})")
    return " OR ".join(tests)


def _judged(counted: DataFrame, limits_: DataFrame) -> DataFrame:
    """``counted`` with ``base_failed``, ``outlier`` and ``kept``; limits are joined by language and source, nulls alike."""
    known = limits_.withColumnRenamed("lang", "limits_lang").withColumnRenamed("source", "limits_source")
    joined = counted.join(known, F.expr("lang <=> limits_lang AND source <=> limits_source"), "left")
    return joined.withColumn("base_failed", _base_failed()).withColumn(
        "outlier", F.expr(f"COALESCE(n_words > 0 AND ({_outside()}), false)")
    ).withColumn("kept", ~F.col("base_failed") & ~F.col("outlier"))


def _narrow(docs: DataFrame, doc_id: str, text: str, lang: str, source: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row for each row of ``docs``: id, counts, ``base_failed``, ``outlier`` and ``kept``.

    A missing or empty text has no words and fails the base rules. A missing language or source is a group like any other.
    Repeated rows and rows without an id are judged each; other columns of ``docs`` are not used; no rows give no rows.
    """
    counted = with_counts(_narrow(docs, doc_id, text, lang, source), "c").select("doc_id", "lang", "source", "c.*")
    counted = stash(counted, "quality-counts")
    return _judged(counted, limits(counted)).select("doc_id", *COUNTS, "base_failed", "outlier", "kept")


def keep_good(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their columns.

    Counts are taken twice, once for the sketches and once beside the text: that is cheaper than to shuffle the texts.
    """
    narrow = with_counts(_narrow(docs, doc_id, text, lang, source), "c").select("lang", "source", "c.*")
    found = limits(narrow)
    row = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row")
    beside = with_counts(docs.select(row, F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source")), "c")
    return _judged(beside.select("row", "lang", "source", "c.*"), found).where("kept").select("row.*")
