"""One root for any partitioning, updates that hash few nodes, proofs that hold and proofs that do not."""

import hashlib

from pyspark.sql import functions as F

from docsluice.operators import merkle


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def plain_root(ids, depth):
    counts = {}
    for i in ids:
        if i is not None:
            counts[sha(i)] = counts.get(sha(i), 0) + 1
    level = {}
    for h in sorted(counts):
        level.setdefault(h[:depth], []).append(f"{h}:{counts[h]}")
    nodes = {p: sha(",".join(x)) for p, x in level.items()}
    for d in range(depth - 1, -1, -1):
        up = {}
        for p in sorted(nodes):
            up.setdefault(p[:d], []).append(f"{p[-1]}:{nodes[p]}")
        nodes = {p: sha(",".join(x)) for p, x in up.items()}
    return nodes.get("", sha(""))


def frame(spark, ids, parts):
    return spark.createDataFrame([(i,) for i in ids], "id string").repartition(parts)


def test_root_is_that_of_a_plain_tree_for_any_partitioning(spark):
    ids = [f"chunk {i}" for i in range(3000)] + ["twice", "twice", None]
    depth = merkle.depth_of(3001)
    assert depth == 1 and merkle.depth_of(0) == 0 and merkle.depth_of(256 * 16 + 1) == 2
    roots = {merkle.root(merkle.tree(merkle.entries(frame(spark, ids, n), "id"))) for n in (1, 7)}
    assert roots == {plain_root(ids, depth)}
    assert merkle.root(merkle.tree(merkle.entries(frame(spark, ids, 3), "id"), 3)) == plain_root(ids, 3)
    assert merkle.root(merkle.tree(merkle.entries(frame(spark, ids, 2).limit(0), "id"))) == sha("")


def test_update_hashes_few_nodes(spark):
    ids, new, gone = [f"chunk {i}" for i in range(2000)], ["new 1", "new 2"], ["chunk 5", "chunk 77"]
    rows = merkle.entries(frame(spark, ids, 3), "id")
    before = merkle.tree(rows, 2)
    added, removed = merkle.entries(frame(spark, new, 1), "id"), merkle.entries(frame(spark, gone, 1), "id")
    after = merkle.changed(rows, added, removed)
    nodes, hashed = merkle.updated(before, after, added.unionByName(removed))
    left = [i for i in ids + new if i not in gone]
    assert merkle.root(nodes) == plain_root(left, 2) == merkle.root(merkle.tree(after, 2)) and hashed <= 4 + 4 + 1
    assert sorted(map(tuple, nodes.collect())) == sorted(map(tuple, merkle.tree(after, 2).collect()))
    few = merkle.entries(frame(spark, ["a", "b"], 1), "id")
    emptied, _ = merkle.updated(merkle.tree(few, 2), few.limit(0), few)
    assert merkle.root(emptied) == sha("")


def test_proofs(spark):
    ids = [f"chunk {i}" for i in range(700)]
    rows = merkle.entries(frame(spark, ids, 3), "id")
    for depth in (0, 1, 2):
        nodes = merkle.tree(rows, depth)
        proof = merkle.proofs(nodes, rows, frame(spark, ["chunk 3", "chunk 699", "unknown", None], 1), "id")
        got = {r["h"]: r["proven"] for r in merkle.proven(proof, merkle.root(nodes)).collect()}
        assert got == {sha("chunk 3"): True, sha("chunk 699"): True}
        assert not any(r["proven"] for r in merkle.proven(proof, sha("other root")).collect())
        forged = proof.withColumn("parts", F.when(F.col("level") == depth, F.array_append("parts", F.lit("f" * 64 + ":1"))).otherwise(F.col("parts")))
        assert not any(r["proven"] for r in merkle.proven(forged, merkle.root(nodes)).collect())
        other = proof.withColumn("h", F.sha2(F.lit("unknown"), 256)).where("level < 3").dropDuplicates(["level"])
        assert not any(r["proven"] for r in merkle.proven(other, merkle.root(nodes)).collect())
