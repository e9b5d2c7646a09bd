"""A Merkle tree over ids: one root for any partitioning, updates that touch few nodes, proofs of membership.

An id's place is given by its sha256: the leaf is the first ``depth`` hex digits,
so leaves are of about one size, LEAF ids, whatever the ids are, and the tree
grows by a level for each sixteenfold of ids. A leaf hashes its entries (digest
and how often the id occurs) in order, a node its up to 16 children. So no task
holds more than a leaf, and levels are groupings that shrink by 16.

Null ids take no part. Repeated ids are one entry with their count. No ids: the
tree is a root over nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tables import stored

LEAF = 256
NODES = "level int, prefix string, n bigint, hash string"


def depth_of(n: int, leaf: int = LEAF) -> int:
    return max(0, math.ceil(math.log(n / leaf, 16))) if n else 0


def entries(ids: DataFrame, key: str) -> DataFrame:
    """(h, n): digest of each id and how often it occurs."""
    return ids.where(F.col(key).isNotNull()).groupBy(T.sha256(F.col(key).cast("string")).alias("h")).agg(F.count(F.lit(1)).alias("n"))


def _hash(parts: Column) -> Column:
    """sha256 of an array of (place, text) in order."""
    return T.sha256(F.array_join(F.transform(F.array_sort(parts), lambda x: x["t"]), ","))


def _leaves(rows: DataFrame, depth: int) -> DataFrame:
    part = F.struct("h", F.concat_ws(":", "h", F.col("n").cast("string")).alias("t"))
    return rows.groupBy(F.left("h", F.lit(depth)).alias("prefix")).agg(F.sum("n").alias("n"), _hash(F.collect_list(part)).alias("hash")).select(F.lit(depth).alias("level"), "prefix", "n", "hash")


def _parents(nodes: DataFrame, level: int) -> DataFrame:
    """Nodes of ``level`` from all their children."""
    part = F.struct("prefix", F.concat_ws(":", F.right("prefix", F.lit(1)), "hash").alias("t"))
    return nodes.groupBy(F.left("prefix", F.lit(level)).alias("p")).agg(F.sum("n").alias("n"), _hash(F.collect_list(part)).alias("hash")).select(F.lit(level).alias("level"), F.col("p").alias("prefix"), "n", "hash")


def tree(rows: DataFrame, depth: int | None = None) -> DataFrame:
    """All nodes (level, prefix, n, hash) over ``rows`` of ``entries``; the root is level 0. Stored, as each level reads the one below."""
    depth = depth_of(rows.count()) if depth is None else depth
    level = stored(_leaves(rows, depth), "leaves")
    out = level
    for at in range(depth - 1, -1, -1):
        level = stored(_parents(level, at), "nodes")
        out = out.unionByName(level)
    if level.isEmpty():
        return rows.sparkSession.range(1).select(F.lit(0).alias("level"), F.lit("").alias("prefix"), F.lit(0).cast("bigint").alias("n"), T.sha256(F.lit("")).alias("hash"))
    return out


def root(nodes: DataFrame) -> str:
    return nodes.where("level = 0").first()["hash"]


def changed(rows: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """``rows`` of entries with the counts of others added and taken away; what falls to 0 goes."""
    out = rows
    for other, sign in ((added, 1), (removed, -1)):
        if other is not None:
            out = out.unionByName(other.select("h", (F.col("n") * sign).alias("n")))
    return out.groupBy("h").agg(F.sum("n").alias("n")).where("n > 0")


def updated(nodes: DataFrame, rows: DataFrame, delta: DataFrame) -> tuple[DataFrame, int]:
    """The tree over ``rows`` (entries after the change) from the tree before it, and how many nodes were hashed anew.

    ``delta``: entries (h) of all ids that were added or removed. Only their leaves and the
    nodes above these are hashed; the depth stays.
    """
    depth = nodes.agg(F.max("level")).first()[0]
    touched = stored(delta.select(F.left("h", F.lit(depth)).alias("prefix")).distinct(), "touched")
    fresh = stored(_leaves(rows.withColumn("prefix", F.left("h", F.lit(depth))).join(touched, "prefix", "left_semi"), depth), "leaves")
    out, level = None, fresh
    for at in range(depth, -1, -1):
        if at < depth:
            below = nodes.where(F.col("level") == at + 1).join(touched, "prefix", "left_anti").unionByName(level)
            above = touched.select(F.left("prefix", F.lit(at)).alias("prefix")).distinct()
            children = below.withColumn("up", F.left("prefix", F.lit(at))).join(above.withColumnRenamed("prefix", "up"), "up", "left_semi").drop("up")
            level, touched = stored(_parents(children, at), "nodes"), above
        whole = nodes.where(F.col("level") == at).join(touched, "prefix", "left_anti").select("level", "prefix", "n", "hash").unionByName(level)
        out = whole if out is None else out.unionByName(whole)
        fresh = fresh if at == depth else fresh.unionByName(level)
    out = stored(out, "tree")
    if out.isEmpty():
        return tree(rows, 0), 0
    return out, fresh.count()


def proofs(nodes: DataFrame, rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """(h, level, parts): for each id what its leaf and the nodes above it hash, from the leaf up; ids that are not in the tree have no rows."""
    depth = nodes.agg(F.max("level")).first()[0]
    asked = ids.where(F.col(key).isNotNull()).select(T.sha256(F.col(key).cast("string")).alias("h")).distinct().join(rows.select("h"), "h", "left_semi")
    held = rows.select(F.left("h", F.lit(depth)).alias("prefix"), F.struct("h", F.concat_ws(":", "h", F.col("n").cast("string")).alias("t")).alias("x"))
    leaf = held.join(asked.select(F.left("h", F.lit(depth)).alias("prefix")).distinct(), "prefix", "left_semi").groupBy("prefix").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]).alias("parts"))
    out = asked.withColumn("prefix", F.left("h", F.lit(depth))).join(leaf, "prefix").select("h", F.lit(depth).alias("level"), "parts")
    for at in range(depth - 1, -1, -1):
        part = F.struct("prefix", F.concat_ws(":", F.right("prefix", F.lit(1)), "hash").alias("t"))
        up = nodes.where(F.col("level") == at + 1).groupBy(F.left("prefix", F.lit(at)).alias("up")).agg(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]).alias("parts"))
        out = out.unionByName(asked.withColumn("up", F.left("h", F.lit(at))).join(up, "up").select("h", F.lit(at).alias("level"), "parts"))
    return out


def proven(proof: DataFrame, top: str) -> DataFrame:
    """(h, proven): whether each proof leads from its id to the root ``top``: the id is among its leaf's entries, and every hash among the parts one level up."""
    each = proof.groupBy("h").agg(F.reverse(F.array_sort(F.collect_list(F.struct("level", "parts")))).alias("steps"))
    hashed = lambda s: T.sha256(F.array_join(s["parts"], ","))
    depth = F.size("steps") - 1
    leaf = F.exists(F.get("steps", F.lit(0))["parts"], lambda p: F.substring_index(p, ":", 1) == F.col("h"))
    # step i stands at level depth - i; its hash is named in step i + 1 by the digit below that level
    climbs = F.forall(F.when(depth > 0, F.sequence(F.lit(0), depth - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.array_contains(F.get("steps", i + 1)["parts"], F.concat_ws(":", F.substring(F.col("h"), F.get("steps", i)["level"], F.lit(1)), hashed(F.get("steps", i)))))
    whole = (F.get("steps", F.lit(0))["level"] == depth) & (hashed(F.element_at("steps", -1)) == top)
    return each.select("h", F.coalesce(leaf & climbs & whole, F.lit(False)).alias("proven"))


def sql(ids: str, key: str, levels: int = 6) -> str:
    """The whole tree in SQL, for a depth of at most ``levels``. ``ids``: CTEs that define a table ``ids``."""
    steps = [f"""e AS (SELECT sha256(CAST({key} AS VARCHAR)) AS h, count(*) AS n FROM ids WHERE {key} IS NOT NULL GROUP BY 1),
      d AS (SELECT CAST(greatest(0, ceil(ln(count(*) / {LEAF}.0) / ln(16))) AS INTEGER) AS depth FROM e),
      l0 AS (SELECT depth AS level, substr(h, 1, depth) AS prefix, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(h || ':' || n, ',' ORDER BY h)) AS hash FROM e, d GROUP BY 1, 2)"""]
    for i in range(levels):
        steps.append(f"l{i + 1} AS (SELECT level - 1 AS level, substr(prefix, 1, level - 1) AS prefix, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(right(prefix, 1) || ':' || hash, ',' ORDER BY prefix)) AS hash FROM l{i} WHERE level > 0 GROUP BY 1, 2)")
    return f"{ids}, {', '.join(steps)} " + " UNION ALL ".join(f"SELECT level, prefix, n, hash FROM l{i}" for i in range(levels + 1))
