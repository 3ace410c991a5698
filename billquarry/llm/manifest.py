"""Merkle manifest of a dataset, with a witness of every row.

Rows become leaves by SHA-256. Leaves are ordered and numbered by one range partitioning, then appended to blocks of
4,096 places. Inside a block an append leaves a partial witness with every open subtree: the siblings complete by then.
Each sibling that is completed later extends the witnesses of the subtrees beside it, up to the block's root. Block roots
are further appends, to blocks of the next tier, until one root is left per language; the roots of languages are appended
the same way. A row's whole witness is that of its own block followed by those of the roots above it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billquarry.llm.shared import stash

#: Children of a node, and levels of the subtree that one block completes.
WIDTH, LEVELS = 8, 4
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


class Append:
    """Leaves appended one by one; after ``close`` the root is known and every leaf has its witness.

    ``levels``: the height to which the subtree is completed; None: until one node is left. A witness has, for each level,
    the siblings before and those after the node on the leaf's path. Without ``track`` only the root is found.
    """

    def __init__(self, levels: int | None, track: bool = True):
        self.levels, self.track, self.count = levels, track, 0
        #: of each level the nodes of the open run, with the leaves below each
        self.open: list[list[tuple[str, range]]] = [[]]
        self.witness: list[list[tuple[list[str], list[str]]]] = []

    def add(self, leaf: str) -> None:
        self.witness.append([])
        self._attach(0, leaf, range(self.count, self.count + 1))
        self.count += 1

    def _attach(self, level: int, node: str, below: range) -> None:
        if level == len(self.open):
            self.open.append([])
        run = self.open[level]
        if self.track:
            for _, others in run:  # the new sibling extends the witnesses to its left
                for leaf in others:
                    self.witness[leaf][level][1].append(node)
            left = [n for n, _ in run]
            for leaf in below:  # and starts with those to its left
                self.witness[leaf].append((left, []))
        run.append((node, below))
        if len(run) == WIDTH and level != self.levels:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        self._attach(level + 1, digest([n for n, _ in run]), range(run[0][1].start, run[-1][1].stop))

    def close(self) -> str:
        """Completes the open runs, also those of fewer nodes, and returns the root."""
        level = 0
        while level != self.levels:
            if len(self.open[level]) == 1 and not any(self.open[level + 1 :]) and self.levels is None:
                break
            if self.open[level]:
                self._complete(level)
            level += 1
        ((root, below),) = self.open[level]
        for leaf in below:
            del self.witness[leaf][level:]  # a root has no siblings
        return root


def fold(leaf: str, witness: list[str]) -> str:
    """The root that a leaf and its witness lead to; of each level the siblings before, a dot, the siblings after."""
    for siblings in witness:
        leaf = hashlib.sha256(siblings.replace(".", leaf).encode()).hexdigest()
    return leaf


def leaf_of(columns: list[Column]) -> Column:
    """SHA-256 of the values in order: ``-`` for a missing one, else its UTF-8 length, a colon and itself."""

    def encoded(value: Column) -> Column:
        return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return F.sha2(F.concat(*[encoded(c.cast("string")) for c in columns]), 256)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``rank``, the place within ``tree`` by ``order``, from 0, and ``total``, the rows of the tree.

    A range knows its rows, sums of the ranges before do the rest: no tree is gathered in one task.
    """
    # equal rows may be many: with the place they were read from, a range can end between them
    salted = stash(rows.withColumn("_salt", F.monotonically_increasing_id()), "manifest-leaves")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = salted.repartitionByRange(parts, "tree", *order, "_salt").sortWithinPartitions("tree", *order, "_salt")
    placed = stash(ranged.drop("_salt").withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33)), "manifest-ranged")
    counts = placed.groupBy("tree", "_range").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    # as many rows as there are ranges and trees
    before = stash(counts.withColumn("_before", F.expr("sum(_rows) OVER (PARTITION BY tree ORDER BY _range) - _rows - _first")).drop("_first"), "manifest-before")
    offsets = before.join(before.groupBy("tree").agg(F.sum("_rows").alias("total")), "tree").select("tree", "_range", "_before", "total")
    return placed.join(offsets, ["tree", "_range"]).withColumn("rank", F.col("_at") + F.col("_before")).drop("_at", "_range", "_before")


def _blocks(nodes: DataFrame) -> DataFrame:
    return nodes.repartition("tree", "block").sortWithinPartitions("tree", "block", "rank")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of one block after the other."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (held[-1]["block"], held[-1]["tree"]) != (row["block"], row["tree"]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _appended(rows: list[dict], levels: int, track: bool) -> tuple[str, list[list[str]]]:
    tree = Append(levels if rows[0]["total"] > WIDTH**levels else None, track)
    for row in rows:
        tree.add(row["node"])
    root = tree.close()
    return root, [["".join(left) + "." + "".join(right) for left, right in w] for w in tree.witness]


def _roots(levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _gathered(batches):
            values = [[rows[0]["tree"]], [rows[0]["block"]], [rows[0]["total"]], [_appended(rows, levels, False)[0]]]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], ["tree", "block", "total", "node"])

    return run


def _raised(levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, *rows in _gathered(batches):
            _, pieces = _appended(rows, levels, True)
            columns = [[r["tree"] for r in rows], [r["rank"] for r in rows], [p + head["above"] for p in pieces], [head["root"]] * len(rows)]
            kinds = [pa.string(), pa.int64(), pa.list_(pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, type=k) for v, k in zip(columns, kinds)], ["tree", "rank", "above", "root"])

    return run


def in_blocks(nodes: DataFrame, levels: int) -> DataFrame:
    return stash(nodes.withColumn("block", F.shiftright("rank", 3 * levels)), "manifest-nodes")


def witnesses(nodes: DataFrame, above: DataFrame, rows, schema: str) -> DataFrame:
    """Calls ``rows`` with the blocks of ``nodes``; the first row of each (without a rank) has what ``above`` says of it."""
    return _blocks(nodes.unionByName(above, allowMissingColumns=True)).mapInArrow(rows, schema)


def raised(nodes: DataFrame, levels: int) -> DataFrame:
    """(tree, rank, above, root) of every node: the witness up to the root of its tree."""
    return witnesses(nodes, blocks_above(nodes, levels), _raised(levels), "tree string, rank long, above array<string>, root string")


def blocks_above(nodes: DataFrame, levels: int) -> DataFrame:
    """(tree, block, above, root) of every block of ``nodes``: the witness of its root, and the root of its tree."""
    most = WIDTH**levels
    roots = _blocks(nodes.select("tree", "block", "rank", "total", "node")).mapInArrow(_roots(levels), "tree string, block long, total long, node string")
    roots = stash(roots, "manifest-roots")
    alone = roots.where(F.col("total") <= most).select("tree", "block", F.array().cast("array<string>").alias("above"), F.col("node").alias("root"))
    further = roots.where(F.col("total") > most)
    if further.isEmpty():
        return alone
    further = in_blocks(further.select("tree", F.col("block").alias("rank"), F.ceil(F.col("total") / most).cast("long").alias("total"), "node"), levels)
    return alone.unionByName(stash(raised(further, levels).withColumnRenamed("rank", "block"), "manifest-above"))


PROVEN = "leaf string, subroot string, root string, witness array<string>, proof_sha256 string, folded_root string"


def _proven(levels: int, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def typed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in source:
                kind = batch.schema.field("doc_id").type
                yield batch

        for head, *rows in _gathered(typed(batches)):
            _, pieces = _appended(rows, levels, True)
            whole = [p + head["above"] + head["over"] for p in pieces]
            proofs = [hashlib.sha256("".join(w).replace(".", "").encode()).hexdigest() for w in whole]
            folded = [fold(r["node"] if r["claimed"] is None else r["claimed"], w) for r, w in zip(rows, whole)]
            text = [[r["node"] for r in rows], [head["root"]] * len(rows), [head["top"]] * len(rows)]
            arrays = [pa.array([r["doc_id"] for r in rows], type=kind), *(pa.array(t, type=pa.string()) for t in text)]
            arrays += [pa.array(whole if keep else [None] * len(rows), type=pa.list_(pa.string())), pa.array(proofs, type=pa.string()), pa.array(folded, type=pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "leaf", "subroot", "root", "witness", "proof_sha256", "folded_root"])

    return run


def manifest(docs: DataFrame, claimed: Column | None = None, keep_witness: bool = True, levels: int = LEVELS) -> DataFrame:
    """(``doc_id``, ``leaf``, ``subroot``, ``root``, ``witness``, ``proof_sha256``, ``folded_root``, ``verified``) of every row.

    Leaves of a language are in the order of ``doc_id``, rows without one first, rows with the same id by their leaf;
    languages are in the order of their UTF-8 bytes, rows without one (another language than the empty text) first.
    ``witness``: by level, from the leaf to the root, the siblings before, a dot, the siblings after; ``proof_sha256`` is
    the hash of all of them, and stays when ``keep_witness`` is off. ``claimed``: the leaf to be verified where it isn't null, else the row's own; ``folded_root``
    is the root that it leads to, ``verified`` says that it is the manifest's. Repeated rows are leaves of their own. Columns
    other than the five are not covered. No rows give no rows. ``levels``: height of a block, which changes no result.
    """
    own = leaf_of([F.col(c) for c in COLUMNS])
    tree = F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("lang").cast("string")))
    claim = F.lit(None).cast("string") if claimed is None else claimed
    leaves = docs.select(F.col("doc_id"), tree.alias("tree"), own.alias("node"), claim.alias("claimed"))
    nodes = in_blocks(numbered(leaves, ["doc_id", "node"]), levels)
    above = stash(blocks_above(nodes, levels), "manifest-tier")
    tops = above.groupBy("tree").agg(F.max("root").alias("node")).select(F.lit("").alias("tree"), F.col("tree").alias("of_tree"), "node")
    tops = numbered(tops, ["of_tree"])
    over = raised(in_blocks(tops.drop("of_tree"), levels), levels).select("rank", F.col("above").alias("over"), F.col("root").alias("top"))
    over = tops.join(over, "rank").select(F.col("of_tree").alias("tree"), "over", "top")
    heads = stash(above.join(stash(over, "manifest-tops"), "tree"), "manifest-heads")
    kind = docs.schema["doc_id"].dataType.simpleString()
    proven = witnesses(nodes, heads, _proven(levels, keep_witness), f"doc_id {kind}, {PROVEN}")
    return proven.withColumn("verified", F.col("folded_root") == F.col("root"))
