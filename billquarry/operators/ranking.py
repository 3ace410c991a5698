"""BM25 over a stored index, with dynamic pruning.

The index is written once: postings ordered by term, impact-ordered blocks of them with the largest weight in each, and
the length of every passage. A search for the k best passages of each question does not score every passage that shares a
word with it:

1. Blocks of a question are taken by falling maximum until they hold enough postings. The k-th best partial score of their
   passages is a first threshold: weights are positive, so k passages reach it for sure.
2. The terms with the smallest maxima are set aside as long as their sum stays below the threshold; a passage with none of
   the other, essential terms cannot reach it. Only postings of essential terms are read, and the k-th best of their
   partial scores lifts the threshold.
3. Passages whose partial score with the maxima of the terms set aside stays below the threshold are dropped. The others
   look up their postings of those terms, and only they are scored in full.

Rows are those of the plain scores: a bound is never below the score it stands for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from billquarry import vocabulary as V
from billquarry.functions import text as X
from billquarry.operators.retrieval import top_k
from billquarry.storage import written

#: Impact classes of a term, the largest weight of a term without its rarity, and the room for rounding in bounds.
CLASSES, LIMIT, ROOM = 16, V.BM25_K1 + 1, 1e-4
#: The term that stands for a passage's length; no word is empty.
_LENGTH = ""


@dataclass(frozen=True)
class Index:
    """Stored postings (``term``, ``tf``, ``len``, keys), blocks (``term``, ``class``, ``rows``, ``best``) and totals."""

    postings: DataFrame
    blocks: DataFrame
    keys: list[str]
    passages: int
    words: int

    def weight(self) -> Column:
        """Weight of a posting without the rarity of its term."""
        average = self.words / self.passages if self.passages else 1.0
        return F.col("tf") * LIMIT / (F.col("tf") + V.BM25_K1 * ((1 - V.BM25_B) + V.BM25_B * F.col("len") / F.lit(average)))

    def impact(self) -> Column:
        return F.least(F.floor(self.weight() * CLASSES / LIMIT), F.lit(CLASSES - 1)).cast("int")

    def rarity(self, held_by: Column) -> Column:
        return F.log(1 + (F.lit(self.passages) - held_by + 0.5) / (held_by + 0.5))


def _counted(keys: int):
    """Postings of passages: each passage's words are counted where the passage is, without a shuffle."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column(keys)
            lengths = tokens.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            words = tokens.flatten().dictionary_encode()
            size = max(len(words.dictionary), 1)
            pairs, tf = np.unique(np.repeat(np.arange(batch.num_rows), lengths) * size + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
            row = pa.array(pairs // size)
            # the mark of the length is no word
            columns = [*(c.take(row) for c in batch.columns[:keys]), pa.array((lengths - 1).astype(np.int32)).take(row), words.dictionary.take(pa.array(pairs % size)), pa.array(tf.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:keys], "len", "term", "tf"])

    return rows


def build(passages: DataFrame, keys: list[str], path: str | None = None) -> Index:
    """Index of passages (keys, ``text``). Texts are read and cut into words once; with a ``path`` the index stays there."""
    words = F.coalesce(X.word_tokens(F.col("text")), F.array().cast("array<string>"))
    tokenised = passages.select(*keys, F.array_append(words, F.lit(_LENGTH)).alias("_tokens"))
    kinds = ", ".join(f"`{c}` {passages.schema[c].dataType.simpleString()}" for c in keys)
    postings = written(tokenised.mapInArrow(_counted(len(keys)), f"{kinds}, len int, term string, tf int"), "postings", path and f"{path}/postings")
    totals = postings.where(F.col("term") == _LENGTH).agg(F.count(F.lit(1)).alias("passages"), F.coalesce(F.sum("len"), F.lit(0)).alias("words")).first()
    index = Index(postings, postings, keys, totals["passages"], totals["words"])
    blocks = postings.where(F.col("term") != _LENGTH).groupBy("term", index.impact().alias("class")).agg(F.count(F.lit(1)).alias("rows"), F.max(index.weight()).alias("best"))
    return Index(postings, written(blocks, "blocks", path and f"{path}/blocks"), keys, totals["passages"], totals["words"])


def open_index(spark: SparkSession, path: str, keys: list[str]) -> Index:
    """An index that ``build`` left at ``path``."""
    postings = spark.read.parquet(f"{path}/postings")
    totals = postings.where(F.col("term") == _LENGTH).agg(F.count(F.lit(1)).alias("passages"), F.coalesce(F.sum("len"), F.lit(0)).alias("words")).first()
    return Index(postings, spark.read.parquet(f"{path}/blocks"), keys, totals["passages"], totals["words"])


def asked_terms(index: Index, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each question (``qid``, ``query``) its indexed terms with rarity and largest score, and their blocks; as many rows
    as the questions have terms."""
    terms = queries.select("qid", F.explode(F.array_distinct(X.word_tokens(F.col("query")))).alias("term"))
    blocks = written(terms.join(index.blocks, "term"), "asked-blocks")
    of_term = blocks.groupBy("qid", "term").agg(F.sum("rows").alias("held_by"), F.max("best").alias("best"))
    known = of_term.select("qid", "term", index.rarity(F.col("held_by")).alias("rarity"), "best").withColumn("most", F.col("rarity") * F.col("best"))
    known = written(known, "asked-terms")
    return known, blocks.join(known.select("qid", "term", "rarity"), ["qid", "term"]).withColumn("most", F.col("rarity") * F.col("best"))


def _kth(scores: DataFrame, k: int, score: str) -> DataFrame:
    return top_k(scores, ["qid"], [F.desc(score)], k, "_place").where(F.col("_place") == k).select("qid", F.col(score).alias("reached"))


def candidates(index: Index, known: DataFrame, blocks: DataFrame, k: int, seeds: int = 32) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Passages (``qid``, keys, ``part``) that may be among the k best, with their score by essential terms; the terms of
    each question that were set aside; and the postings of all terms asked for. ``seeds``: postings per place wanted that the first threshold is taken from."""
    keys = index.keys
    # what the questions ask for, read from the index once
    postings = written(index.postings.join(known.select("term").distinct(), "term", "left_semi").withColumn("class", index.impact()).withColumn("weight", index.weight()), "asked-postings")
    falling = Window.partitionBy("qid").orderBy(F.desc("most"), "term", F.desc("class"))
    before = F.coalesce(F.sum("rows").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = blocks.withColumn("_before", before).where(F.col("_before") < seeds * k).select("qid", "term", "class", "rarity")
    partial = postings.join(first, ["term", "class"]).groupBy("qid", *keys).agg(F.sum(F.col("rarity") * F.col("weight")).alias("part"))
    floor = _kth(partial, k, "part")
    rising = Window.partitionBy("qid").orderBy("most", "term")
    ranked = known.join(floor, "qid", "left").withColumn("_upto", F.sum("most").over(rising))
    aside = F.col("_upto") < F.coalesce(F.col("reached"), F.lit(0.0)) - ROOM
    split = written(ranked.withColumn("aside", aside), "asked-split")
    essential = split.where(~F.col("aside")).select("qid", "term", "rarity")
    scored = postings.join(essential, "term").groupBy("qid", *keys).agg(F.sum(F.col("rarity") * F.col("weight")).alias("part"))
    scored = written(scored, "partial-scores")
    bound = split.groupBy("qid").agg(F.max("reached").alias("_floor"), F.sum(F.when(F.col("aside"), F.col("most")).otherwise(0.0)).alias("_rest"))
    bound = bound.join(_kth(scored, k, "part"), "qid", "left").select("qid", F.greatest(F.coalesce("_floor", F.lit(0.0)), F.coalesce("reached", F.lit(0.0))).alias("_least"), "_rest")
    left = scored.join(bound, "qid").where(F.col("part") + F.col("_rest") >= F.col("_least") - ROOM).select("qid", *keys, "part")
    return written(left, "candidates"), split.where("aside").select("qid", "term", "rarity"), postings


def search(index: Index, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """(``qid``, keys, ``bm25``, ``rank``) of the k best passages of each question; scores that are equal to ``digits``
    places are ranked by key. A question without any word of the corpus has no rows."""
    keys = index.keys
    known, blocks = asked_terms(index, queries)
    left, aside, postings = candidates(index, known, blocks, k)
    common = postings.join(aside.select("term").distinct(), "term", "left_semi").select(*keys, "term", "weight")
    asked = left.select("qid", *keys).join(aside, "qid")
    rest = asked.join(common, [*keys, "term"]).groupBy("qid", *keys).agg(F.sum(F.col("rarity") * F.col("weight")).alias("_rest"))
    whole = left.join(rest, ["qid", *keys], "left").select("qid", *keys, (F.col("part") + F.coalesce("_rest", F.lit(0.0))).alias("bm25"))
    return top_k(whole, ["qid"], [F.desc(F.round("bm25", digits)), *[F.col(c) for c in keys]], k)
