"""Links between similar rows of a group, whatever the size of the group.

A group is compared in one task if it is small. A large one is cut into blocks by hash. Blocks are compared inside, then
one row of each label found so far, dealt anew, until those agree. What is left are pairs whose ends still have different
labels: rows of a group's most frequent label stay in their blocks, all others are shown to every block. Rows are shipped
once if a group is linked throughout, as near copies of one text are, and no task ever holds more than a block and the
rows shown to it in pieces of the same size. A task reports one link a row, not its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billquarry.llm import marks
from billquarry.llm.shared import stash

#: Adds links between rows ``asks`` and ``tree`` to the labels: (payloads, asks, tree, label) -> label.
Finder = Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray], np.ndarray]
_HELD = 16 << 20
#: Bits of the bitmap of texts whose sets are wanted, as a power of two.
MARKS = 26


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking a with b: each row carries the smallest row of its component."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not ((further := label[label]) == label).all():
            label = further


def _units(find: Finder):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # unit, whole, role, node, root, payload
        size = 0

        def settle(rows: list[tuple]) -> pa.RecordBatch:
            nodes = [r[3] for r in rows]
            known: dict = {}
            label = np.array([known.setdefault((r[0], r[4]), i) for i, r in enumerate(rows)])
            role = np.array([r[2] for r in rows])
            unit = np.cumsum([0] + [a[0] != b[0] for a, b in zip(rows, rows[1:])])
            now = label.copy()
            edges = np.flatnonzero(np.diff(unit, prepend=-1, append=-1))
            for low, high in zip(edges, edges[1:]):
                if high - low > 1:
                    of_unit = role[low:high]
                    tree = np.flatnonzero(of_unit == 0)
                    asks = np.flatnonzero(of_unit == 1) if (of_unit == 1).any() else tree
                    if len(tree):
                        now[low:high] = find([r[5] for r in rows[low:high]], asks, tree, now[low:high] - low) + low
            # of rows known to be linked one speaks for all; labels of large groups are reported whole
            told = [i for i in range(len(rows)) if rows[i][1] or (label[i] == i and now[i] != i)]
            kinds = [pa.int64(), pa.binary(), pa.binary()]
            values = ([rows[i][0][0] for i in told], [nodes[i] for i in told], [nodes[now[i]] for i in told])
            return pa.RecordBatch.from_arrays([pa.array(v, type=k) for v, k in zip(values, kinds)], ["grp", "node", "root"])

        for batch in batches:
            grp, block, *rest = (c.to_pylist() for c in batch.columns)
            for row in zip(zip(grp, block), *rest):
                if size > _HELD and held and held[-1][0] != row[0]:
                    yield settle(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5]) + 256
        if held:
            yield settle(held)

    return run


def _compared(rows: DataFrame, find: Finder) -> DataFrame:
    """``rows``: grp, block, whole, role, node, root, payload."""
    ordered = rows.select("grp", "block", "whole", "role", "node", "root", "payload").repartition("grp", "block").sortWithinPartitions("grp", "block", "role", "node")
    return ordered.mapInArrow(_units(find), "grp long, node binary, root binary")


def linked(rows: DataFrame, find: Finder, limit: int) -> DataFrame:
    """Links (``a``, ``b``) that join every pair of rows of a group that ``find`` finds similar into one component.

    ``rows``: ``grp`` long, ``node`` binary (once in a group), ``payload`` binary; read several times, so a written table.
    ``limit``: bytes of payloads in one block.
    """
    weight = F.sum(F.octet_length("payload") + F.lit(64))
    sizes = rows.groupBy("grp").agg(weight.alias("bytes"))
    large = stash(sizes.where(F.col("bytes") > limit).select("grp", F.ceil(F.col("bytes") / limit).cast("int").alias("parts")), "linkage-large")

    def block(nth: int):
        return F.when(F.col("parts") > 1, F.pmod(F.xxhash64("node", F.lit(nth)), F.col("parts")).cast("int")).otherwise(0)

    given = rows.select("grp", "node", "payload").join(large, "grp", "left")
    first = stash(_compared(given.select("*", block(0).alias("block"), F.col("parts").isNotNull().alias("whole"), F.lit(0).alias("role"), F.col("node").alias("root")), find), "linkage-first")
    links = [first]
    if not large.isEmpty():
        hot = stash(rows.join(large, "grp").select("grp", "node", "payload", "parts"), "linkage-hot")
        labels = stash(first.join(large.select("grp"), "grp", "left_semi"), "linkage-labels")
        nth = 0
        while True:
            nth += 1
            speakers = stash(labels.where("node = root").select("grp", "node").join(hot.drop("parts"), ["grp", "node"]), "linkage-speakers")
            dealt = speakers.groupBy("grp").agg(F.ceil(weight / limit).cast("int").alias("parts"))
            found = stash(_compared(speakers.join(dealt, "grp").select("*", block(nth).alias("block"), F.lit(True).alias("whole"), F.lit(0).alias("role"), F.col("node").alias("root")), find), "linkage-found")
            links.append(found)
            settled = dealt.where("parts > 1").isEmpty() or found.where("node <> root").isEmpty()
            named = found.select("grp", F.col("node").alias("root"), F.col("root").alias("now"))
            labels = stash(labels.join(named, ["grp", "root"]).select("grp", "node", F.col("now").alias("root")), "linkage-labels")
            if settled:
                break
        counted = labels.groupBy("grp", "root").agg(F.count("*").alias("rows"))
        most = counted.groupBy("grp").agg(F.max_by("root", F.struct("rows", "root")).alias("most"))
        known = stash(hot.join(labels, ["grp", "node"]).join(most, "grp"), "linkage-known")
        held = known.select("*", block(0).alias("block"), F.lit(False).alias("whole"), F.lit(0).alias("role"))
        shown = known.where("root <> most").select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"), F.lit(False).alias("whole"), F.lit(1).alias("role"))
        # a block that is shown nothing has nothing left to compare
        asked = shown.select("grp", "block").distinct()
        rest = held.join(asked, ["grp", "block"], "left_semi").unionByName(shown)
        links.append(stash(_compared(rest, find), "linkage-rest"))
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))


def agreeing(least: int) -> Finder:
    """Rows whose payloads, signatures of one length, agree in ``least`` bytes or more."""

    def find(payloads: list[bytes], asks: np.ndarray, tree: np.ndarray, label: np.ndarray) -> np.ndarray:
        held = np.frombuffer(b"".join(payloads), dtype=np.uint8).reshape(len(payloads), -1)
        of_tree = held[tree]
        for i in asks.tolist():
            other = label[tree] != label[i]
            if other.any():
                hits = tree[other][(of_tree[other] == held[i]).sum(axis=1) >= least]
                if len(hits):
                    label = merged(label, np.full(len(hits), i), hits)
        return label

    return find


def jaccard(percent: int) -> Finder:
    """Rows whose payloads, sorted sets of 64-bit numbers, have ``percent`` of their union in common or more."""

    def find(payloads: list[bytes], asks: np.ndarray, tree: np.ndarray, label: np.ndarray) -> np.ndarray:
        sets = [np.frombuffer(p, dtype="<i8") for p in payloads]
        sizes = np.array([len(s) for s in sets])
        if len(sets) <= 8:
            for i in asks.tolist():
                for j in tree.tolist():
                    if label[i] != label[j] and 100 * min(sizes[i], sizes[j]) >= percent * max(sizes[i], sizes[j]):
                        common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                        if 100 * common >= percent * (sizes[i] + sizes[j] - common):
                            label = merged(label, np.array([i]), np.array([j]))
            return label
        # postings of the tree: owners of each number, numbers ascending; those that all rows hold are only counted
        numbers = np.concatenate([sets[j] for j in tree])
        owners = np.repeat(tree, sizes[tree])
        order = np.argsort(numbers, kind="stable")
        numbers, owners = numbers[order], owners[order]
        distinct, first, held_by = np.unique(numbers, return_index=True, return_counts=True)
        everywhere = held_by == len(tree)
        for i in asks.tolist():
            if not (label[tree] != label[i]).any():
                continue
            at = np.searchsorted(distinct, sets[i])
            at[at == len(distinct)] = 0
            at = at[distinct[at] == sets[i]]
            common = int(everywhere[at].sum())
            at = at[~everywhere[at]]
            low, count = first[at], held_by[at]
            places = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
            shared = np.bincount(owners[places], minlength=len(sets))[tree] + common
            hits = tree[(100 * shared >= percent * (sizes[i] + sizes[tree] - shared)) & (label[tree] != label[i])]
            if len(hits):
                label = merged(label, np.full(len(hits), i), hits)
        return label

    return find


def _sets(sets_of: Callable[[pa.Array], list[np.ndarray]], shared):
    """Sets of the texts whose hash is marked."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.filter(pa.array(marks.marked(shared.value, batch.column(1).to_numpy(), MARKS)))
            payload = [np.sort(s.view(np.int64)).astype("<i8").tobytes() for s in sets_of(kept.column(2))]
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(payload, type=pa.binary())], ["doc_id", "text_hash", "payload"])

    return rows


def confirmed(source: DataFrame, distinct: DataFrame, grouped: DataFrame, sets_of: Callable[[pa.Array], list[np.ndarray]], percent: int, limit: int) -> DataFrame:
    """Links (``a``, ``b``) that join every pair of nodes of a group whose sets have ``percent`` of their union in common.

    ``source``: ``doc_id``, ``text``. ``distinct``: ``node`` and ``row`` (id and hash of one text that has it). ``grouped``:
    ``node`` and its ``grp``, such as the component of its candidates. ``sets_of``: distinct 64-bit hashes of every text.
    Texts stay where they are; each wanted set is shipped once to its group, and pairs are compared there and never listed.
    """
    grouped = stash(grouped, "confirmed-groups")
    wanted = stash(grouped.join(distinct, "node").select("node", "grp", F.col("row.doc_id").alias("of_id"), F.col("row.text_hash").alias("of_hash")), "confirmed-wanted")
    shared = source.sparkSession.sparkContext.broadcast(marks.marks_of(wanted.select("of_hash"), MARKS))
    kind = source.schema["doc_id"].dataType.simpleString()
    texts = source.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    sets = texts.mapInArrow(_sets(sets_of, shared), f"doc_id {kind}, text_hash long, payload binary")
    found = sets.join(wanted, (F.col("text_hash") == F.col("of_hash")) & F.col("doc_id").eqNullSafe(F.col("of_id"))).select("grp", "node", "payload")
    rows = stash(found.groupBy("grp", "node").agg(F.max("payload").alias("payload")), "confirmed-rows")
    return linked(rows, jaccard(percent), limit)
