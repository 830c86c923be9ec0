"""Connected components of an edge table, without collecting any part of it.

Each partition first contracts its edges to a spanning forest (union-find over
bounded chunks, so memory is bounded), then rounds of large-star and small-star
run as joins until nothing changes. Each round is checkpointed."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeflow.runtime import cut

#: Edges that one task contracts at a time.
CHUNK = 1_000_000


def _forest(pairs: list[tuple]) -> pa.RecordBatch:
    parent: dict = {}

    def find(x):
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    out = [(x, find(x)) for x in parent]
    out = [(x, r) for x, r in out if x != r]
    return [x for x, _ in out], [r for _, r in out]


def _contract(kind: pa.DataType, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def flush():
        a, b = _forest(held)
        return pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], ["u", "v"])

    for batch in it:
        held.extend(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        if len(held) >= CHUNK:
            yield flush()
            held = []
    if held:
        yield flush()


def contract(edges: DataFrame) -> DataFrame:
    """Edges (u, v), u > v, with the same components, from each partition a
    forest of stars."""
    kind = pa.int64() if dict(edges.dtypes)["u"] == "bigint" else pa.string()
    return edges.mapInArrow(lambda it: _contract(kind, it), edges.schema)


def settled(edges: DataFrame) -> bool:
    """Whether edges (u, v) are stars: each u has one edge and no v is a u.
    Edges of stars are components, as no step changes what is connected."""
    many = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1)
    chain = edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").limit(1).select("u", F.lit(1).alias("n"))
    return many.select("u", "n").unionAll(chain).count() == 0


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, component) for each node that has an edge; component is the
    least node. a and b are long or string columns; null ends and loops are
    left out. An empty edge table gives an empty result."""
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    now = cut(contract(contract(both).repartition("v")))
    for _ in range(rounds):
        if settled(now):
            break
        sym = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
    else:
        raise RuntimeError(f"no components after {rounds} rounds")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)
