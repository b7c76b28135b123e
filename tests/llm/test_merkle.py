"""The Merkle manifest against a plain tree."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from docgate.llm.merkle import folded, leaf_of, prove, siblings
from docgate.llm.queries import op11_merkle
from tests.llm.helpers import AZ, SMALL, edge_docs, small_docs

H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()


def value(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes, fanout):
    """The root, and for each node the (before, after) of each level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, i in zip(paths, at, strict=True):
            run = i // fanout * fanout
            path.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + fanout])))
        nodes = [H(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        at = [i // fanout for i in at]
    return nodes[0], paths


def brute(rows, fanout=8):
    """(by, leaf) of each tree -> rows of (tree, by, leaf, subroot, root, path)."""
    trees = {}
    for tree, by, leaf in rows:
        trees.setdefault(tree, []).append((by is not None, by or 0, leaf, by))
    keys = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    done = {t: climb([x[2] for x in sorted(trees[t], key=lambda x: x[:3])], fanout) for t in keys}
    root, above = climb([done[t][0] for t in keys], fanout)
    out = []
    for t, up in zip(keys, above, strict=True):
        for x, path in zip(sorted(trees[t], key=lambda x: x[:3]), done[t][1], strict=True):
            out.append((t, x[3], x[2], done[t][0], root, tuple(path + up)))
    return out


def found(proven, tree="lang", by="doc_id", leaf="leaf"):
    return [(r[tree], r[by], r[leaf], r.subroot, r.root, tuple(zip(r.before, r.after, strict=True))) for r in proven.collect()]


def ordered(rows):
    return sorted(rows, key=repr)


def test_query_against_a_plain_tree(spark):
    docs = small_docs(spark)
    rows = docs.collect()
    leaf = lambda r, text: H(*map(value, (r.doc_id, r.source, r.lang, r.n_chars, text)))
    want = {x[1]: x for x in brute([(r.lang, r.doc_id, leaf(r, r.text)) for r in rows])}
    got = {r.doc_id: r for r in op11_merkle(spark, SMALL).collect()}
    assert len(got) == len(rows)
    tampered = 0
    for r in rows:
        _, _, own, subroot, root, path = want[r.doc_id]
        x = got[r.doc_id]
        node = leaf(r, r.text.translate(AZ) if zlib.crc32(str(r.doc_id).encode()) % 3 == 0 else r.text)
        for before, after in path:
            node = H(before, node, after)
        assert (x.leaf, x.subroot, x.root, x.proof_sha256, x.folded_root, x.verified) == (own, subroot, root, H(*(b + a for b, a in path)), node, node == root)
        tampered += not x.verified
    assert 0 < tampered < len(rows) / 2


@pytest.mark.parametrize(("fanout", "levels"), [(2, 1), (2, 3), (8, 1), (3, 2)])
def test_shapes_of_trees(spark, fanout, levels):
    """Trees of one leaf, of whole runs, of more superblocks than one, and many small trees."""
    sizes = {"a": 1, "b": 2, "c": fanout**levels, "d": fanout**levels + 1, None: 37, "": 3, "é": 64} | {f"z{i}": 1 for i in range(11)}
    rows = [(t, i, H(str(t), str(i))) for t, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "lang string, doc_id long, leaf string").repartition(3)
    assert ordered(found(prove(df, "lang", "doc_id", "leaf", fanout, levels))) == ordered(brute(rows, fanout))


def test_nulls_repeated_rows_and_clashing_names(spark):
    docs = edge_docs(spark)
    docs = docs.unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long"))).withColumn("node", F.lit("n")).withColumn("idx", F.lit(7)).withColumn("tree", F.lit("t"))
    leaves = docs.withColumn("leaf", leaf_of("doc_id", "lang", "text"))
    proven = prove(leaves, "lang", "doc_id", "leaf")
    assert proven.columns == [*leaves.columns, "subroot", "root", "before", "after"]
    assert ordered(found(proven)) == ordered(brute([(r.lang, r.doc_id, r.leaf) for r in leaves.collect()]))
    assert {(r.node, r.idx, r.tree) for r in proven.collect()} == {("n", 7, "t")}
    ok = proven.select((folded(F.col("leaf"), F.col("before"), F.col("after")) == F.col("root")).alias("ok"), siblings(F.col("before"), F.col("after")).alias("s")).collect()
    assert all(r.ok and len(r.s) % 64 == 0 for r in ok)


def test_one_row_and_none(spark):
    one = spark.createDataFrame([("en", 1, "ab")], "lang string, doc_id long, leaf string")
    assert found(prove(one, "lang", "doc_id", "leaf")) == [("en", 1, "ab", "ab", "ab", ())]
    assert prove(one.limit(0), "lang", "doc_id", "leaf").count() == 0


def test_leaf_tells_null_from_empty_and_counts_bytes(spark):
    df = spark.createDataFrame([(None, "x"), ("", "é"), ("-", "1:x")], "a string, b string")
    assert [r[0] for r in df.select(leaf_of("a", "b")).collect()] == [H("-", "1:x"), H("0:", "2:é"), H("1:-", "3:1:x")]
