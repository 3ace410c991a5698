"""SimHash near-duplicates: sharded BK-trees find fingerprints within a radius, links become components.

A fingerprint bit is set when it is set in more than half of the hashes of a document's word shingles.
Distinct fingerprints are dealt to shards by equal bit bands. Every shard builds BK-trees whose children
are keyed by their integer Hamming distance to the parent, and a search follows only the edges within
the radius of the distance just seen. A shard too large for one tree is cut into parts, and each part's
tree is sent to every other part of its shard, so that no task holds more than two parts of a shard.
Within a unit links are merged at once; at most one link a fingerprint and tree group leaves it.

A plan with a Jaccard similarity takes what the trees find as candidates only. Of each unit the shortest links that keep
it together leave the task; they join candidates into components, and inside each of those whole shingle sets are
compared. So each link is exact, and no list of pairs is ever made, however many candidates are no links.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billquarry.llm import linkage
from billquarry.llm.shared import small_batches, stash

#: Shingles hashed at a time, rows of complete units searched at a time, and pairs in one search step.
SHINGLES, ROWS, FRONTIER = 1 << 17, 1 << 16, 1 << 18
_LANES = np.uint64(0x0101010101010101)


@dataclass(frozen=True)
class Plan:
    """What is hashed and linked.

    ``words`` in a shingle; ``bits`` of a fingerprint (a multiple of 64); ``radius`` of a link. The bits are cut into
    ``bands``; two fingerprints meet if ``match`` bands are equal. With ``bands >= radius + match`` no link is missed;
    otherwise a pair that differs in d bits meets with a probability of about
    ``1 - (1 - (1 - d / bits) ** (bits / bands)) ** (bands * layouts)`` (for a match of 1): bands are cut from ``layouts``
    different orders of the bits. ``part`` is the most fingerprints in one tree.

    With a ``jaccard`` pairs within ``reach`` bits are candidates, and those whose shingle sets are at least that similar
    are linked; ``radius`` is then the distance to be expected at that similarity.
    """

    words: int = 4
    bits: int = 64
    radius: int = 4
    bands: int = 6
    match: int = 2
    layouts: int = 1
    part: int = 4096
    reach: int = 0
    jaccard: float = 0.0


#: Fingerprints of the contract: no link is missed.
EXACT = Plan()
#: Five words and a Jaccard similarity of 0.8: shingle sets that alike differ in about 39 of 256 bits
#: (1 / pi * acos(2 * 0.8 / 1.8) of them), with a deviation of about 6. A pair that differs in 40 bits meets with 99.98 %,
#: one in 50 bits with 99 %, one in 60 bits with 91 %.
JACCARD_80 = Plan(words=5, bits=256, radius=40, bands=21, match=1, layouts=3, reach=60, jaccard=0.8)
#: Candidate pairs of a unit held before they are reduced to the shortest links, and bytes of shingle sets compared at once.
HELD, SETS = 1 << 21, 1 << 22


def _shingle_hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of each shingle, in blocks; a text with fewer words is one shingle, one without words has none."""
    if not text:
        return
    # bytes.lower and bytes.split know only ASCII: A-Z, and white space 09-0D and 20
    joined = b" ".join(text.encode("utf-8", "surrogatepass").lower().split())
    if not joined:
        return
    spaces = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    starts = np.concatenate([[0], spaces + 1])
    ends = np.concatenate([spaces, [len(joined)]])
    if len(starts) > words:
        starts, ends = starts[: len(starts) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), SHINGLES):
        block = zip(starts[at : at + SHINGLES].tolist(), ends[at : at + SHINGLES].tolist())
        yield np.fromiter((digest(joined[a:b], 42) for a, b in block), dtype=np.uint64, count=min(SHINGLES, len(starts) - at))


def _mixed(hashes: np.ndarray, nth: int) -> np.ndarray:
    """Another 64 bits from a hash; the first 64 are the hash itself."""
    if nth == 0:
        return hashes
    x = hashes + np.uint64(nth * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How often each of 64 bits is set in every run of hashes; runs are not empty.

    Eight counters share a 64-bit word, so sums are taken over at most 255 hashes first.
    """
    ends = np.append(starts[1:], len(hashes))
    chunks = -(-(ends - starts) // 255)
    first = np.cumsum(chunks) - chunks
    cuts = np.repeat(starts - 255 * first, chunks) + 255 * np.arange(chunks.sum())
    counts = np.empty((len(starts), 8, 8), dtype=np.int64)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, cuts)
        counts[:, :, k] = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
    return counts.reshape(len(starts), 64)


def fingerprints_of(texts: list[str | None], plan: Plan) -> np.ndarray:
    """Fingerprints as rows of 64-bit words; without words, zero."""
    wide = plan.bits // 64
    out = np.zeros((len(texts), wide), dtype=np.uint64)
    owners: list[int] = []
    held: list[np.ndarray] = []
    room = 0
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)

    def work_off() -> None:
        nonlocal room
        if held:
            sizes = np.array([len(h) for h in held])
            _settle(np.concatenate(held), np.cumsum(sizes) - sizes, sizes, np.array(owners))
        held.clear()
        owners.clear()
        room = 0

    def _settle(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, owner: np.ndarray) -> None:
        for n in range(wide):
            counts = _bit_counts(_mixed(hashes, n), starts)
            out[owner, n] = np.where(2 * counts > sizes[:, None], weights, np.uint64(0)).sum(axis=1, dtype=np.uint64)

    for i, text in enumerate(texts):
        blocks = _shingle_hashes(text, plan.words)
        if (first := next(blocks, None)) is None:
            continue
        if (second := next(blocks, None)) is None:
            owners.append(i)
            held.append(first)
            room += len(first)
            if room > SHINGLES:
                work_off()
            continue
        total, size = np.zeros((wide, 64), dtype=np.int64), 0  # a very long text: counts are summed block by block
        for block in chain((first, second), blocks):
            size += len(block)
            for n in range(wide):
                total[n] += _bit_counts(_mixed(block, n), np.zeros(1, dtype=np.int64))[0]
        for n in range(wide):
            out[i, n] = np.where(2 * total[n] > size, weights, np.uint64(0)).sum(dtype=np.uint64)
    work_off()
    return out


def with_fingerprints(docs: DataFrame, plan: Plan, name: str, text: str = "text") -> DataFrame:
    """``docs`` with a fingerprint column: a long for 64 bits, otherwise little-endian bytes."""
    narrow = plan.bits == 64

    @F.pandas_udf("long" if narrow else "binary")
    def fingerprint(texts):
        import pandas as pd

        found = fingerprints_of([t if isinstance(t, str) else None for t in texts], plan)
        return pd.Series(found[:, 0].view(np.int64) if narrow else [row.tobytes() for row in found.astype("<u8")])

    return docs.withColumn(name, fingerprint(F.coalesce(F.col(text), F.lit(""))))


def _with_nodes(docs: DataFrame, plan: Plan) -> DataFrame:
    """``docs`` with a column ``fp``: the fingerprint and, if links are confirmed, a hash of the lower-case words behind it."""
    if not plan.jaccard:
        return with_fingerprints(docs, plan, "fp")

    @F.pandas_udf("binary")
    def node(texts):
        import pandas as pd

        words = [b" ".join(t.encode("utf-8", "surrogatepass").lower().split()) if isinstance(t, str) else b"" for t in texts]
        return pd.Series([row.tobytes() + xxhash.xxh64_digest(w) for row, w in zip(fingerprints_of(list(texts), plan).astype("<u8"), words)])

    return docs.withColumn("fp", node(F.coalesce(F.col("text"), F.lit(""))))


# --- shards ---------------------------------------------------------------------------------------------------------


def _words_of(column: pa.Array, plan: Plan) -> np.ndarray:
    """Fingerprint column as rows of 64-bit words."""
    if plan.bits == 64:
        return np.asarray(column.to_numpy(zero_copy_only=False), dtype=np.int64).view(np.uint64).reshape(-1, 1)
    wide = plan.bits // 64
    return np.ascontiguousarray(np.frombuffer(b"".join(column.to_pylist()), dtype="<u8").reshape(-1, wide + bool(plan.jaccard))[:, :wide])


def _column_of(words: np.ndarray, plan: Plan) -> pa.Array:
    if plan.bits == 64:
        return pa.array(words[:, 0].view(np.int64))
    return pa.array([row.tobytes() for row in words], type=pa.binary())


def _band(words: np.ndarray, low: int, high: int) -> np.ndarray:
    """Bits low..high-1 as one number."""
    at, shift = divmod(low, 64)
    value = words[:, at] >> np.uint64(shift)
    if (low % 64) + (high - low) > 64:
        value = value | (words[:, at + 1] << np.uint64(64 - shift))
    return (value & np.uint64((1 << (high - low)) - 1)).astype(np.int64)


def _layout(words: np.ndarray, nth: int) -> np.ndarray:
    """The same bits in another order; the first layout is the order they have."""
    if nth == 0:
        return words
    order = np.random.default_rng(nth).permutation(64 * words.shape[1])
    bits = np.unpackbits(words.astype("<u8").view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits[:, order], axis=1, bitorder="little")).view("<u8")


def _shards(plan: Plan):
    edges = [plan.bits * i // plan.bands for i in range(plan.bands + 1)]
    groups = list(combinations(range(plan.bands), plan.match))
    width = max(b - a for a, b in zip(edges, edges[1:]))
    if plan.match * width > 48 or len(groups) * plan.layouts > 1 << 14:
        raise ValueError("a shard's key has at most 48 bits of bands and 16384 kinds")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = _words_of(batch.column(0), plan)
            if not len(words):
                continue
            for layout in range(plan.layouts):
                ordered = _layout(words, layout)
                bands = [_band(ordered, a, b) for a, b in zip(edges, edges[1:])]
                for n, group in enumerate(groups):
                    key = np.full(len(words), layout * len(groups) + n, dtype=np.int64)
                    for g in group:
                        key = (key << width) | bands[g]
                    yield pa.RecordBatch.from_arrays([pa.array(key), *batch.columns], ["shard", *batch.schema.names])

    return emit


# --- trees ----------------------------------------------------------------------------------------------------------


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class Forest:
    """BK-trees of many units, built level by level: all rows that reach a node by one distance go below its first such row."""

    def __init__(self, words: np.ndarray, unit: np.ndarray, bits: int):
        self.words, self.step = words, bits + 1
        units, first = np.unique(unit, return_index=True)
        self.root = dict(zip(units.tolist(), first.tolist()))
        self.units, self.roots = units, first
        current = first[np.searchsorted(units, unit)]
        active = np.flatnonzero(np.arange(len(unit)) != current)
        keys, children = [], []
        while len(active):
            at = current[active] * self.step + _distance(words[active], words[current[active]])
            distinct, where, back = np.unique(at, return_index=True, return_inverse=True)
            child = active[where]
            keys.append(distinct)
            children.append(child)
            current[active] = child[back]
            active = active[current[active] != active]
        self.keys = np.concatenate(keys) if keys else np.empty(0, dtype=np.int64)
        order = np.argsort(self.keys, kind="stable")
        self.keys = self.keys[order]
        self.children = np.concatenate(children)[order] if children else np.empty(0, dtype=np.int64)

    def search(self, words: np.ndarray, unit: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) within the radius, in blocks."""
        place = np.searchsorted(self.units, unit)
        place[place == len(self.units)] = 0
        has = self.units[place] == unit
        query = np.flatnonzero(has)
        waiting = [(query, self.roots[place[query]])]
        while waiting:
            query, node = waiting.pop()
            if len(query) > FRONTIER:
                half = len(query) // 2
                waiting += [(query[half:], node[half:]), (query[:half], node[:half])]
                continue
            if not len(query):
                continue
            apart = _distance(words[query], self.words[node])
            near = apart <= radius
            if near.any():
                yield query[near], node[near]
            low = np.searchsorted(self.keys, node * self.step + np.maximum(apart - radius, 0))
            high = np.searchsorted(self.keys, node * self.step + np.minimum(apart + radius, self.step - 1), side="right")
            count = high - low
            if count.any():
                at = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
                waiting.append((np.repeat(query, count), self.children[at]))


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking a with b: every row carries the smallest row of its group."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further


def _links(plan: Plan):
    def unit_links(words: np.ndarray, unit: np.ndarray, role: np.ndarray) -> pa.RecordBatch | None:
        tree, asks = np.flatnonzero(role != 2), np.flatnonzero(role != 1)
        if not len(tree) or not len(asks):
            return None
        forest = Forest(words[tree], unit[tree], plan.bits)
        label = np.arange(len(words))
        for query, node in forest.search(words[asks], unit[asks], plan.radius):
            label = _merge(label, asks[query], tree[node])
        linked = np.flatnonzero(label != np.arange(len(words)))
        if not len(linked):
            return None
        return pa.RecordBatch.from_arrays([_column_of(words[linked], plan), _column_of(words[label[linked]], plan)], ["a", "b"])

    def found(columns: list[np.ndarray], unit: np.ndarray) -> Iterator[pa.RecordBatch]:
        if (batch := unit_links(_words_of(pa.array(columns[4]), plan), unit, columns[3])) is not None:
            yield batch

    return _over_units(found)


def _shortest(count: int, a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Which pairs make a shortest spanning forest of ``count`` rows."""
    label, taken = np.arange(count), []
    order = np.argsort(apart, kind="stable")
    for layer in np.split(order, np.flatnonzero(np.diff(apart[order])) + 1):
        while True:
            x, y = label[a[layer]], label[b[layer]]
            layer, low, high = layer[x != y], np.minimum(x, y)[x != y], np.maximum(x, y)[x != y]
            if not len(layer):
                break
            hung, first = np.unique(high, return_index=True)  # each goes below a smaller one: no circles
            taken.append(layer[first])
            label[hung] = low[first]
            while not ((further := label[label]) == label).all():
                label = further
    return np.concatenate(taken) if taken else np.empty(0, dtype=np.int64)


def _candidates(plan: Plan):
    """Of the pairs within reach in each unit the shortest that keep it together."""

    def found(columns: list[np.ndarray], unit: np.ndarray) -> Iterator[pa.RecordBatch]:
        role, nodes = columns[3], columns[4]
        tree, asks = np.flatnonzero(role != 2), np.flatnonzero(role != 1)
        if not len(tree) or not len(asks):
            return
        words = _words_of(pa.array(nodes), plan)
        forest = Forest(words[tree], unit[tree], plan.bits)
        held: list[tuple[np.ndarray, ...]] = []
        room = 0

        def reduced() -> tuple[np.ndarray, ...]:
            a, b, apart = (np.concatenate(c) for c in zip(*held))
            some = _shortest(len(nodes), a, b, apart)
            return a[some], b[some], apart[some]

        for query, node in forest.search(words[asks], unit[asks], plan.reach):
            a, b = asks[query], tree[node]
            once = (a < b) | (role[a] == 2)  # rows that are both in the tree and looked up are found from either side
            a, b = a[once], b[once]
            held.append((a, b, _distance(words[a], words[b])))
            room += len(a)
            if room > HELD:
                held = [reduced()]
                room = len(held[0][0])
        if held:
            a, b, _ = reduced()
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[a].tolist(), type=pa.binary()), pa.array(nodes[b].tolist(), type=pa.binary())], ["a", "b"])

    return _over_units(found)


def _over_units(found_in):
    """Gathers rows sorted by unit and calls ``found_in`` with their columns and unit numbers, complete units at a time."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            rows += batch.num_rows
            if rows < ROWS:
                continue
            columns = [np.concatenate(c) for c in zip(*held)]
            number = _numbered(columns)
            whole = number < number[-1]  # the last unit may go on in the next batch
            if whole.any():
                yield from found_in([c[whole] for c in columns], number[whole])
            held = [tuple(c[~whole] for c in columns)]
            rows = int((~whole).sum())
        if held:
            columns = [np.concatenate(c) for c in zip(*held)]
            yield from found_in(columns, _numbered(columns))

    return search


def _numbered(columns: list[np.ndarray]) -> np.ndarray:
    """Number of each row's unit (shard, low part, high part); rows are sorted by it."""
    new = np.zeros(len(columns[0]), dtype=bool)
    for c in columns[:3]:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def links(fingerprints: DataFrame, plan: Plan) -> DataFrame:
    """Links (``a``, ``b``) that join every pair of fingerprints within the radius into one component.

    ``fingerprints``: distinct, in a column ``fp``.
    """
    kind = fingerprints.schema["fp"].dataType.simpleString()
    return _units(fingerprints.select("fp"), plan).mapInArrow(_links(plan), f"a {kind}, b {kind}")


def _units(fingerprints: DataFrame, plan: Plan) -> DataFrame:
    """Rows of every unit: shard, low and high part, role, ``fp`` and what else the rows have."""
    given = [(c.name, c.dataType.simpleString()) for c in fingerprints.schema]
    names = [c for c, _ in given]
    sharded = fingerprints.mapInArrow(_shards(plan), "shard long, " + ", ".join(f"{c} {t}" for c, t in given))
    large = stash(sharded.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > plan.part), "simhash-large")
    parts = large.select("shard", F.ceil(F.col("n") / plan.part).cast("int").alias("parts"))
    own = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0))))
    units = (
        sharded.join(parts, "shard", "left")
        .select("shard", *names, own.alias("own"), others.alias("other"))
        .select(
            "shard", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
            F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("role"), *names,
        )
    )
    return units.repartition("shard", "low", "high").sortWithinPartitions("shard", "low", "high", "role")


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    return [np.unique(np.concatenate([np.empty(0, dtype=np.uint64), *_shingle_hashes(t, words)])) for t in texts.to_pylist()]


def confirmed_links(source: DataFrame, distinct: DataFrame, plan: Plan) -> DataFrame:
    """Links (``a``, ``b``) that join every pair of candidates at least as similar as ``plan.jaccard`` into one component.

    ``source``: ``doc_id``, ``text``. ``distinct``: ``fp`` and, of one row that has it, ``row`` (id and hash of the text).
    """
    found = _units(distinct.select("fp"), plan).mapInArrow(_candidates(plan), "a binary, b binary")
    first = stash(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "simhash-shortest")
    grouped = components(first).select("node", F.xxhash64("root").alias("grp"))
    nodes = distinct.select(F.col("fp").alias("node"), "row")
    return linkage.confirmed(source, nodes, grouped, lambda texts: shingle_sets(texts, plan.words), round(100 * plan.jaccard), SETS)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(``node``, ``root``) of every node with an edge; the root is the smallest node of the component.

    Large-star and small-star steps in turn: each hangs neighbours below the smallest one known. Minima are aggregates,
    and both joins may be split, so that a node with a third of all edges is in no single task.
    """
    edges = stash(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    for _ in range(most_rounds):
        # written tables on both sides: adaptive execution can split a join only where it is fed by shuffles alone
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = stash(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("at"), F.least("a", "m").alias("m")), "links-lowest")
        hung = both.where(F.col("b") > F.col("a")).join(lowest, F.col("a") == F.col("at")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        hung = stash(hung.where(F.col("a") != F.col("b")).distinct(), "links-hung")
        lowest = stash(hung.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("at"), "m"), "links-lowest")
        below = hung.join(lowest, F.col("a") == F.col("at"))
        edges = stash(
            below.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lowest.select(F.col("at").alias("a"), F.col("m").alias("b"))).where(F.col("a") != F.col("b")).distinct(),
            "links",
        )
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            roots = edges.select(F.col("b").alias("node")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
        seen = now
    raise RuntimeError(f"links did not settle in {most_rounds} rounds")


def _grouped(docs: DataFrame, plan: Plan, doc_id: str, text: str) -> DataFrame:
    """``doc_id``, ``text_hash``, ``fp`` and ``component_id`` of every row."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    hashed = stash(_with_nodes(source, plan).select("doc_id", F.xxhash64("text").alias("text_hash"), "fp"), "simhash")
    row = [F.max(F.struct("doc_id", "text_hash")).alias("row")] if plan.jaccard else []
    distinct = stash(hashed.groupBy("fp").agg(F.min("doc_id").alias("first_id"), *row), "simhash-distinct")
    found = components(confirmed_links(source, distinct, plan) if plan.jaccard else links(distinct, plan))
    named = stash(found.join(distinct.withColumnRenamed("fp", "node"), "node").groupBy("root").agg(F.min("first_id").alias("component_id")), "simhash-named")
    linked = stash(found.join(named, "root").select(F.col("node").alias("fp"), "component_id", F.lit(True).alias("linked")), "simhash-linked")
    of_each = distinct.join(linked, "fp", "left").select("fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("first_id")).alias("component_id"))
    return hashed.join(stash(of_each, "simhash-components"), "fp")


def near_duplicates(docs: DataFrame, plan: Plan = EXACT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(``doc_id``, ``fingerprint``, ``component_id``) of every row of ``docs``.

    ``component_id`` is the smallest id reachable over links; a row without an id takes part and gets its component's id,
    or null if no row of the component has one. Missing and empty texts and texts without words have fingerprint zero and
    are linked like any other; a text with fewer words than a shingle is one shingle. Repeated rows stay.
    """
    digits: Column = F.lower(F.lpad(F.hex("fp"), plan.bits // 4, "0"))
    return _grouped(docs, plan, doc_id, text).select("doc_id", F.substring(digits, 1, plan.bits // 4).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, plan: Plan = JACCARD_80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component, with their columns.

    Rows that share id and text stay or go together. A row without an id goes if a row of its component has one; a
    component without any id stays whole.
    """
    others = _grouped(docs, plan, doc_id, text).where("NOT doc_id <=> component_id").select(F.col("doc_id").alias("other_id"), F.col("text_hash").alias("other_hash"))
    known = stash(others.distinct(), "near-duplicates")
    row_id, row_text = (docs["`" + c.replace("`", "``") + "`"] for c in (doc_id, text))
    return docs.join(known, (F.xxhash64(row_text) == known["other_hash"]) & row_id.eqNullSafe(known["other_id"]), "left_anti")
