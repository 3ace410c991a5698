"""Vector search through an inverted file: coarse cells, residual codes, exact re-ranking.

Vectors are scaled to length one. K-means on a bounded sample gives the centres of coarse cells; every vector goes to the
cell of its nearest centre, as one byte a dimension of what it differs from the centre, with the length of the error that
this leaves. So a code bounds the cosine from both sides, and so does a cell, by the distance of its farthest vector.

A search reads the codes of the cells nearest to a query first. Without ``probes`` it goes on to every cell whose bound
reaches the k-th best score found, and its rows are those of a comparison with all vectors; with ``probes`` it stops there.
Only vectors whose bound reaches the k-th place are compared in full. Equal vectors are one entry, so that copies of one
vector, however many, are compared once; their ids are put in at the end, at most k of each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billquarry.operators.retrieval import dense_cosine, top_k
from billquarry.storage import written

#: Rows k-means is fitted on, rounds, codes and queries compared at a time, and room for rounding in bounds.
SAMPLE, ROUNDS, CODES, ASKED, ROOM = 50_000, 10, 65_536, 1_024, 1e-5
_LEVELS = 127


@dataclass(frozen=True)
class Index:
    """Of distinct vectors ``codes``: id, cell, code, scale, error; ``cells``: cell, rows, radius; ``centres`` by cell.
    ``vectors``: all rows, ``distinct``: one id of each."""

    codes: DataFrame
    cells: DataFrame
    centres: np.ndarray
    vectors: DataFrame
    distinct: DataFrame
    dimensions: int


def unit_rows(column: pa.Array, dimensions: int) -> np.ndarray:
    """Rows of numbers, scaled to length one."""
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def usable(vector: Column, dimensions: int) -> Column:
    """Has so many numbers, all there, and a length. Other vectors have a cosine of 0 with all and are not found."""
    length = F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return (F.size(vector) == dimensions) & (length > 0) & (length < float("inf"))


def fit(vectors: DataFrame, vector: str, dimensions: int, cells: int, seed: int = 7) -> np.ndarray:
    """Centres of k-means over the vectors with the smallest hashes, at most ``SAMPLE`` of them."""
    if cells < 2:
        return np.zeros((cells, dimensions))
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    chosen = vectors.select(vector).orderBy(F.xxhash64(vector)).limit(SAMPLE)
    unit = F.transform(F.col(vector), lambda x: x.cast("double") / F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, y: acc + y.cast("double") * y.cast("double"))))
    sample = written(chosen.select(unit.alias("features")), "vector-sample").select(array_to_vector("features").alias("features"))
    model = KMeans(k=cells, maxIter=ROUNDS, seed=seed).fit(sample)
    return np.array(model.clusterCenters())


def build(vectors: DataFrame, key: str, vector: str, cells: int | None = None) -> Index:
    """Index of all usable vectors; the number of cells grows with the square root of their number, up to 16,384."""
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("vector"))
    sizes = rows.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "size").first()
    dimensions = int(sizes["size"]) if sizes and sizes["size"] else 0
    good = written(rows.where(usable(F.col("vector"), dimensions)).groupBy("vector").agg(F.min("id").alias("id")).select("id", "vector"), "vector-distinct")
    count = good.count()
    kind = rows.schema["id"].dataType.simpleString()
    centres = fit(good, "vector", dimensions, max(1, min(cells or round(count**0.5), 16_384, count))) if count else np.zeros((0, dimensions))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = (centres * centres).sum(axis=1) / 2
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = unit_rows(batch.column(1), dimensions)
            cell = (unit @ centres.T - half).argmax(axis=1)
            rest = unit - centres[cell]
            scale = np.maximum(np.abs(rest).max(axis=1), 1e-30) / _LEVELS
            code = np.rint(rest / scale[:, None]).astype(np.int8)
            error = np.sqrt(((rest - code * scale[:, None]) ** 2).sum(axis=1))
            apart = np.sqrt((rest * rest).sum(axis=1))
            columns = [batch.column(0), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in code], type=pa.binary()), pa.array(scale), pa.array(error), pa.array(apart)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "cell", "code", "scale", "error", "apart"])

    codes = written(good.mapInArrow(coded, f"id {kind}, cell int, code binary, scale double, error double, apart double"), "vector-codes")
    held = written(codes.groupBy("cell").agg(F.count("*").alias("rows"), F.max("apart").alias("radius")), "vector-cells")
    return Index(codes, held, centres, rows, good, dimensions)


def _order(index: Index, asked: DataFrame, kind: str) -> DataFrame:
    """(``qid``, ``cell``, ``place``, ``most``): cells of each query by falling cosine of their centres, with the bound of each."""
    centres, dimensions = index.centres, index.dimensions
    radius = np.full(len(centres), -np.inf)  # no more cells than the index may have
    for row in index.cells.collect():
        radius[row["cell"]] = row["radius"]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            score = unit_rows(batch.column(1), dimensions) @ centres.T
            order = np.argsort(-score, axis=1, kind="stable")
            count = len(centres)
            bound = np.take_along_axis(score + radius, order, axis=1)
            columns = [batch.column(0).take(pa.array(np.repeat(np.arange(len(score)), count))), pa.array(order.ravel().astype(np.int32)), pa.array(np.tile(np.arange(count, dtype=np.int32), len(score))), pa.array(bound.ravel())]
            yield pa.RecordBatch.from_arrays(columns, ["qid", "cell", "place", "most"])

    return asked.mapInArrow(near, f"qid {kind}, cell int, place int, most double")


def _probed(index: Index, pairs: DataFrame, asked: DataFrame, k: int, kind: str, query_kind: str) -> DataFrame:
    """(``qid``, ``id``, ``least``, ``most``): vectors of the cells asked for that may be among the k best of their block."""
    centres, dimensions = index.centres, index.dimensions
    parts = index.cells.select("cell", F.ceil(F.col("rows") / CODES).cast("int").alias("parts"))
    askers = pairs.groupBy("cell").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("rounds"))
    dealt = parts.join(askers, "cell")
    part, batch_of = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"), F.pmod(F.xxhash64("qid"), F.col("rounds")).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    left = index.codes.join(dealt, "cell").select("id", "cell", "code", "scale", "error", part.alias("part"), every("rounds").alias("round"))
    right = pairs.join(asked, "qid").join(dealt, "cell").select("qid", "cell", "vector", batch_of.alias("round"), every("parts").alias("part"))

    def compare(codes: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(codes) or not len(queries):
            return pd.DataFrame({"qid": [], "id": [], "least": [], "most": []})
        held = np.frombuffer(b"".join(codes["code"]), dtype=np.int8).reshape(len(codes), dimensions) * codes["scale"].to_numpy()[:, None]
        held = held + centres[int(codes["cell"].iloc[0])]
        given = np.stack(queries["vector"].to_numpy()).astype(np.float64)
        given /= np.sqrt((given * given).sum(axis=1, keepdims=True))
        error = codes["error"].to_numpy() + ROOM
        ids, out = codes["id"].to_numpy(), []
        for qid, query in zip(queries["qid"], given):
            score = held @ query
            least = score - error
            floor = np.partition(least, len(least) - k)[len(least) - k] if len(least) > k else -np.inf
            at = np.flatnonzero(score + error >= floor)
            out.append(pd.DataFrame({"qid": qid, "id": ids[at], "least": least[at], "most": score[at] + error[at]}))
        return pd.concat(out, ignore_index=True)

    keys = ["cell", "part", "round"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, f"qid {query_kind}, id {kind}, least double, most double")


def search(index: Index, queries: DataFrame, key: str, vector: str, k: int, probes: int | None = None, digits: int = 6) -> DataFrame:
    """(``qid``, ``id``, ``cosine``, ``rank``) of the k nearest vectors of each query; cosines equal to ``digits`` places are
    ranked by id. Queries whose vectors are not usable have no rows. ``probes``: cells read, None for all that may count."""
    kind, query_kind = (df.schema[c].dataType.simpleString() for df, c in ((index.vectors, "id"), (queries, key)))
    named = queries.select(F.col(key).alias("qid"), F.col(vector).alias("vector"))
    if not len(index.centres):
        return named.join(index.vectors.select("id").where("false"), F.lit(False)).select("qid", "id", F.lit(0.0).alias("cosine"), F.lit(0).alias("rank"))
    asked = written(named.where(usable(F.col("vector"), index.dimensions)), "vector-asked")
    order = written(_order(index, asked, query_kind), "vector-order")
    first = min(len(index.centres), probes or 4)
    found = written(_probed(index, order.where(F.col("place") < first).select("qid", "cell"), asked, k, kind, query_kind), "vector-first")

    def reached(rows: DataFrame) -> DataFrame:
        best = top_k(rows, ["qid"], [F.desc("least")], k, "_place").where(F.col("_place") == k)
        return best.select("qid", F.col("least").alias("floor"))

    if probes is None and first < len(index.centres):
        more = order.where(F.col("place") >= first).join(reached(found), "qid", "left")
        more = more.where(F.col("floor").isNull() | (F.col("most") >= F.col("floor") - ROOM)).select("qid", "cell")
        found = found.unionByName(written(_probed(index, more, asked, k, kind, query_kind), "vector-more"))
    left = found.join(reached(found), "qid", "left").where(F.col("floor").isNull() | (F.col("most") >= F.col("floor") - ROOM)).select("qid", "id")
    compared = left.join(asked.withColumnRenamed("vector", "_asked"), "qid").join(index.distinct, "id")
    scored = compared.select("qid", "vector", "id", dense_cosine(F.col("vector"), F.col("_asked")).alias("cosine"))
    order_of = [F.desc(F.round("cosine", digits)), F.col("id")]
    best = written(top_k(scored, ["qid"], order_of, k).select("qid", "vector", "cosine"), "vector-best")
    copies = index.vectors.join(best.select("vector").distinct(), "vector", "left_semi")
    copies = top_k(copies, ["vector"], [F.col("id")], k, "_nth").select("id", "vector")
    return top_k(best.join(copies, "vector").select("qid", "id", "cosine"), ["qid"], order_of, k)
