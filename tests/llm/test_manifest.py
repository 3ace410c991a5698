"""Roots, witnesses and verdicts against a tree built level by level."""

import hashlib

import pytest
from pyspark.sql import functions as F

from billquarry.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, tree string, rank string, block int, node string"


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(nodes):
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [sha(nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        levels.append(nodes)
    return levels


def witness_of(levels, at):
    out = []
    for nodes in levels[:-1]:
        run = at // 8 * 8
        out.append("".join(nodes[run:at]) + "." + "".join(nodes[at + 1 : run + 8]))
        at //= 8
    return out


def plain(rows, claim):
    leaf = lambda row: sha("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)
    key = lambda v: (v is not None, v)
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    ordered = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (key(r[0]), leaf(r))) for x in langs}
    trees = {x: levels_of([leaf(r) for r in ordered[x]]) for x in langs}
    over = levels_of([trees[x][-1][0] for x in langs])
    out = []
    for n, x in enumerate(langs):
        for at, row in enumerate(ordered[x]):
            whole = witness_of(trees[x], at) + witness_of(over, n)
            folded = leaf(row[:4] + (row[4].lower(),) if claim(row) and row[4] is not None else row)
            for siblings in whole:
                folded = sha([siblings.replace(".", folded)])
            out.append((row[0], leaf(row), trees[x][-1][0], over[-1][0], tuple(whole), sha([w.replace(".", "") for w in whole]), folded, folded == over[-1][0]))
    return sorted(out, key=str)


def told(df):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, tuple(r.witness), r.proof_sha256, r.folded_root, r.verified) for r in df.collect()), key=str)


@pytest.mark.parametrize("count", [*range(1, 20), 63, 64, 65, 512, 513, 4095, 4096])
def test_append(count):
    leaves = [sha([str(i)]) for i in range(count)]
    tree = manifest.Append(None)
    for leaf in leaves:
        tree.add(leaf)
    levels = levels_of(leaves)
    assert tree.close() == levels[-1][0]
    for at in range(count):
        assert ["".join(a) + "." + "".join(b) for a, b in tree.witness[at]] == witness_of(levels, at)


def test_blocks_are_completed_to_their_height():
    tree = manifest.Append(4)
    tree.add("x")
    want = "x"
    for _ in range(4):
        want = sha([want])
    assert tree.close() == want and tree.witness == [[([], [])] * 4]


def test_manifest(spark):
    # one language of two full blocks and one leaf, small ones, missing values, ties and repeated rows
    rows = [(i // 2, "s", "en", i, f"Text {i}") for i in range(2 * 4096 + 1)]
    rows += [(i, None, f"l{i % 11}", None, None if i % 3 else "É\x00ß") for i in range(40)]
    rows += [(None, "s", None, 1, "A"), (None, "s", None, 1, "A"), (None, None, "", None, None), (-5, "s", None, 1, ""), (7, "s", "zz", 1, "One" * 50_000)]
    docs = spark.createDataFrame([(*r, "t", "r", 1, "n") for r in rows], SCHEMA).repartition(7)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    claimed = F.when(F.col("doc_id") % 3 == 0, manifest.leaf_of([lower if c == "text" else F.col(c) for c in manifest.COLUMNS]))
    ascii_lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    class Text(str):
        def lower(self):
            return self.translate(ascii_lower)

    rows = [(*r[:4], None if r[4] is None else Text(r[4])) for r in rows]
    assert told(manifest.manifest(docs, claimed)) == plain(rows, lambda r: r[0] is not None and r[0] % 3 == 0)


def test_tiers(spark):
    """With blocks of 64 places, three tiers."""
    rows = [(i, "s", "en", i, "x") for i in range(64 * 64 + 3)]
    docs = spark.createDataFrame([(*r, "t", "r", 1, "n") for r in rows], SCHEMA)
    assert told(manifest.manifest(docs, levels=2)) == plain(rows, lambda r: False)


def test_no_rows_and_one_row(spark):
    docs = spark.createDataFrame([(3, None, None, None, None, "t", "r", 1, "n")], SCHEMA)
    assert manifest.manifest(docs.where("false")).collect() == []
    (row,) = manifest.manifest(docs).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root == sha(["1:3----"]) and row.witness == [] and row.verified
