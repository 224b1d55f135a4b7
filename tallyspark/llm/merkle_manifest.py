"""Merkle manifest of a dataset: a tree of threes per source, one over the sources, and a proof
for every document.

A source's tree may have billions of leaves, so it is cut into *superblocks* of ``3 ** HEIGHT``
neighbouring nodes, whatever the source's size:

* **Up.** Leaves get their position in their source from a range sort and the counts of its
  partitions. Every superblock is reduced by itself to one node; these are the nodes of the next
  round, until each source has its subroot. The subroots, in order of their sources, are the
  leaves of one more tree of the same make.
* **Down: the subtree exchange.** A superblock's proofs need the siblings on the way from its top to
  the root (its *outer nodes*). From the root down, nodes and the outer nodes of their superblock
  are cogrouped in ``applyInPandas``, which reduces the superblock once more, joins inner and
  outer siblings to proofs and, at the leaves, folds the claimed leaf up to a root.

A group holds ``3 ** HEIGHT`` nodes and one row of outer nodes at most, so one source with a
third of all rows is many groups. Only counts and the one root reach the driver.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import read, ship_package, stored

HEIGHT = 6                  # levels of a superblock
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def depth(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    d = 0
    while n > 1:
        n, d = -(-n // 3), d + 1
    return d


def levels(nodes: list[str], steps: int) -> list[list[str]]:
    """The nodes and the ``steps`` levels above them."""
    out = [nodes]
    for _ in range(steps):
        low = out[-1]
        out.append([h("".join(low[i:i + 3])) for i in range(0, len(low), 3)])
    return out


def siblings(tree: list[list[str]], i: int) -> list[str]:
    """``left.right`` of every level on the way up from node ``i``."""
    out = []
    for low in tree[:-1]:
        a = i - i % 3
        out.append("".join(low[a:i]) + "." + "".join(low[i + 1:a + 3]))
        i //= 3
    return out


def fold(node: str, proof: list[str]) -> str:
    """The root that a leaf and its siblings give."""
    for step in proof:
        left, right = step.split(".")
        node = h(left + node + right)
    return node


def encoded(c: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, ``:`` and value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_of(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, fields)), 256)


def placed(nodes: DataFrame, order: list[str], name: str) -> DataFrame:
    """``nodes`` (with a ``tree``) with ``pos`` in their tree by ``order`` and the tree's size
    ``n``. Sorted by ranges, so a large tree is many partitions; a partition numbers its own rows
    and the sizes of those before it (a row a partition and tree) are added."""
    keys = ["tree", *order]

    def number(batches):
        part, last, k = TaskContext.get().partitionId(), None, 0
        for b in batches:
            at = []
            for t in b.column("tree").to_pylist():
                k = k + 1 if t == last else 0
                last = t
                at.append(k)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([part] * len(at), pa.int64()), pa.array(at, pa.int64())],
                names=[*b.schema.names, "part", "k"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
    rows = stored(nodes.repartitionByRange(*keys).sortWithinPartitions(*keys)
                  .mapInArrow(number, f"{schema}, part long, k long"), name)
    sizes = rows.groupBy("tree", "part").agg((F.max("k") + 1).alias("size"))
    trees = Window.partitionBy("tree")
    before = (F.sum("size").over(trees.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    sizes = stored(sizes.select("tree", "part", F.coalesce(before, F.lit(0)).alias("before"),
                                F.sum("size").over(trees).alias("n")), f"{name}-sizes")
    return (rows.join(sizes, ["tree", "part"]).withColumn("pos", F.col("before") + F.col("k"))
            .drop("part", "k", "before"))


def climb(nodes: DataFrame, height: int) -> list[DataFrame]:
    """The stored nodes (``tree, pos, n, node``) of every round; the last has one a tree."""
    width = 3 ** height

    def reduce(key, g):
        g = g.sort_values("pos")
        n = int(g["n"].iloc[0])
        steps = min(height, depth(n))
        top = levels(g["node"].tolist(), steps)[-1]
        return pd.DataFrame({"tree": [key[0]], "pos": [key[1]], "n": [-(-n // 3 ** steps)], "node": top})
    rounds = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        up = rounds[-1].select("tree", "n", "pos", "node", F.expr(f"pos div {width}").alias("block"))
        rounds.append(stored(up.groupBy("tree", "block").applyInPandas(
            reduce, "tree string, pos long, n long, node string"), "merkle-round"))
        most = -(-most // width)
    return rounds


def descend(rounds: list[DataFrame], outer: DataFrame, height: int) -> DataFrame:
    """``tree, pos, proof`` of the superblocks of leaves; ``outer`` has them for the last round
    (one a tree)."""
    for nodes in reversed(rounds[1:-1]):
        outer = stored(exchange(nodes, outer, height, _paths, "tree string, pos long, proof array<string>"),
                       "merkle-outer")
    return outer


def exchange(nodes: DataFrame, outer: DataFrame, height: int, finish, schema: str) -> DataFrame:
    """Nodes and their superblock's outer nodes, cogrouped. ``finish(nodes, tree, proofs)`` makes
    the rows from the sorted nodes, the superblock's levels and the proofs."""
    width = 3 ** height

    def run(key, g, above):
        g = g.sort_values("pos")
        tree = levels(g["node"].tolist(), min(height, depth(int(g["n"].iloc[0]))))
        rest = list(above["proof"].iloc[0])
        return finish(g, [siblings(tree, i) + rest for i in range(len(g))], above)
    left = nodes.withColumn("block", F.expr(f"pos div {width}"))
    return left.groupBy("tree", "block").cogroup(
        outer.withColumnRenamed("pos", "block").groupBy("tree", "block")).applyInPandas(run, schema)


def _paths(g, proofs, above):
    return pd.DataFrame({"tree": g["tree"], "pos": g["pos"], "proof": proofs})


def manifest(docs: DataFrame, fields=FIELDS, group: str = "source", order: str = "doc_id",
             claim: dict[str, Column] | None = None, height: int = HEIGHT, digest: bool = False) -> DataFrame:
    """``order, leaf, subroot, root``, the ``proof`` (array of ``left.right`` siblings, bottom up;
    with ``digest`` the hash of all siblings, ``proof_sha256``), ``folded_root`` and ``verified``
    of every row.

    A leaf hashes the ``fields``. Per ``group``, leaves ascend by ``order`` (nulls first, equal ones
    by their hash). ``claim`` gives other values of some fields: the leaf they make is folded with
    the original siblings, and ``verified`` tells whether that gives the root.

    Nulls are encoded apart from every value; a null group is a group of its own, the first. Empty
    and very long texts are hashed whole. Repeated rows are each a leaf. An empty table has no root
    and gives no rows. Extra columns, whatever their names, are not looked at.
    """
    spark = docs.sparkSession
    ship_package(spark)
    at = {f: F.col(f"`{f}`") for f in {*fields, group, order}}
    own = leaf_of([at[f] for f in fields])
    told = leaf_of([{**at, **(claim or {})}[f] for f in fields])
    tree = F.coalesce(F.concat(F.lit("s"), at[group].cast("string")), F.lit("n"))
    kind = docs.schema[order].dataType
    kind = "string" if kind.simpleString() == "void" else kind.simpleString()
    # Stored, as the range sort reads its input twice and the texts should be hashed once.
    leaves = stored(docs.select(tree.alias("tree"), at[order].cast(kind).alias("key"), own.alias("node"),
                                told.alias("told")), "merkle-leaves")
    base = placed(leaves, ["key", "node"], "merkle-placed")
    rounds = climb(base, height)
    tops = rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("member"), "node")
    over = climb(placed(tops, ["member"], "merkle-tops"), height)
    top = over[-1].select("node").first()
    schema = (f"leaf string, subroot string, root string, proof {'string' if digest else 'array<string>'}, "
              "folded_root string, verified boolean")
    if top is None:
        got = spark.createDataFrame([], f"key {kind}, {schema}")
        return _named(got, kind, order, digest)
    root = top[0]
    start = spark.createDataFrame([("", 0, [])], "tree string, pos long, proof array<string>")

    def named(g, proofs, above):
        return pd.DataFrame({"tree": g["member"], "pos": 0, "subroot": g["node"], "proof": proofs})
    ways = stored(exchange(over[0], descend(over, start, height), height, named,
                           "tree string, pos long, subroot string, proof array<string>"), "merkle-ways")
    below = descend(rounds, ways.select("tree", "pos", "proof"), height).join(
        ways.select("tree", "subroot"), "tree")

    def finish(g, proofs, above):
        folded = [fold(x, p) for x, p in zip(g["told"], proofs)]
        out = [h("".join(p).replace(".", "")) for p in proofs] if digest else proofs
        return pd.DataFrame({"key": g["key"], "leaf": g["node"], "subroot": above["subroot"].iloc[0], "root": root,
                             "proof": out, "folded_root": folded, "verified": [x == root for x in folded]})
    # As text, for pandas has no integers beside nulls.
    got = exchange(base.withColumn("key", F.col("key").cast("string")), below, height, finish, f"key string, {schema}")
    return _named(got, kind, order, digest)


def _named(got: DataFrame, kind: str, order: str, digest: bool) -> DataFrame:
    return got.select(F.col("key").cast(kind).alias(order), "leaf", "subroot", "root",
                      F.col("proof").alias("proof_sha256" if digest else "proof"), "folded_root", "verified")


def op12_merkle_manifest(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    even = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    tampered = F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return manifest(docs, claim={"text": tampered}, digest=True)


def _leaf_sql(text: str) -> str:
    parts = [f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in (*FIELDS[:-1], text)]
    return f"sha256({' || '.join(parts)})"


# Bit by bit; 3988292384 is the reflected CRC-32 polynomial.
_CRC_SQL = ("xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), "
            "lambda c: CAST(ascii(c) AS BIGINT)), lambda acc, b: list_reduce([xor(acc, b)] || range(8), "
            "lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)")


def _tree_sql(name: str, leaves: str) -> str:
    """Levels of the trees over ``leaves`` (tree, pos, node, n), and the siblings of each leaf."""
    return f"""{name}(tree, lvl, pos, node, n) AS (
  SELECT tree, 0, pos, node, n FROM {leaves}
  UNION ALL
  SELECT tree, lvl + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (n + 2) // 3
  FROM {name} WHERE n > 1 GROUP BY tree, lvl, pos // 3, n),
{name}_step AS (
  SELECT l.tree, l.pos, u.lvl,
         coalesce(string_agg(u.node, '' ORDER BY u.pos) FILTER (WHERE u.pos < l.pos // CAST(pow(3, u.lvl) AS BIGINT)), '') AS a,
         coalesce(string_agg(u.node, '' ORDER BY u.pos) FILTER (WHERE u.pos > l.pos // CAST(pow(3, u.lvl) AS BIGINT)), '') AS z
  FROM {leaves} l JOIN {name} u ON u.tree = l.tree AND u.n > 1 AND u.pos // 3 = l.pos // CAST(pow(3, u.lvl + 1) AS BIGINT)
  GROUP BY l.tree, l.pos, u.lvl)"""


OP12_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS tree, {_leaf_sql("text")} AS node,
         CASE WHEN {_CRC_SQL} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")}
              ELSE {_leaf_sql("text")} END AS told FROM documents),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, node) - 1 AS pos,
         count(*) OVER (PARTITION BY tree) AS n FROM d),
{_tree_sql("inner_tree", "leaves")},
tops AS (
  SELECT 'all' AS tree, tree AS member, node, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n
  FROM inner_tree WHERE n = 1),
{_tree_sql("outer_tree", "tops")},
steps AS (
  SELECT tree, pos, lvl AS step, a, z FROM inner_tree_step
  UNION ALL
  SELECT l.tree, l.pos, 1000 + s.lvl, s.a, s.z FROM leaves l JOIN tops t ON t.member = l.tree
  JOIN outer_tree_step s ON s.pos = t.pos),
path AS (
  SELECT tree, pos, list(a ORDER BY step) AS a, list(z ORDER BY step) AS z,
         sha256(string_agg(a || z, '' ORDER BY step)) AS proof_sha256 FROM steps GROUP BY tree, pos),
folded(tree, pos, i, node) AS (
  SELECT tree, pos, CAST(0 AS BIGINT), told FROM leaves
  UNION ALL
  SELECT f.tree, f.pos, i + 1, sha256(a[i + 1] || node || z[i + 1]) FROM folded f
  JOIN path p ON p.tree = f.tree AND p.pos = f.pos AND i < len(a)),
root AS (SELECT node FROM outer_tree WHERE n = 1)
SELECT l.doc_id, l.node AS leaf, t.node AS subroot, r.node AS root,
       coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.node AS folded_root, f.node = r.node AS verified
FROM leaves l JOIN tops t ON t.member = l.tree CROSS JOIN root r
LEFT JOIN path p ON p.tree = l.tree AND p.pos = l.pos
JOIN folded f ON f.tree = l.tree AND f.pos = l.pos AND f.i = coalesce(len(p.a), 0)
"""
