"""Connected components over an edge table, by alternating star contractions.

Before the first round and after each, every task contracts the edges that it
holds, some hundred thousand at a time, to stars of their own; a small graph is then done.
Every round re-hangs each node's larger neighbours on the node's smallest
neighbour ("large star") and then each node's smaller neighbours on their
minimum ("small star").  The rounds needed grow with the logarithm of the
longest path, and a hub never has to sit in one task: per-node minima are
algebraic aggregates, written first so that AQE can split the joins that use them.
These joins are merge joins by hint: a table of ids takes so little room on disk
that Spark would send millions of rows through the driver as a broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeweave.operators.fixpoint import discard, written
from typeweave.sources.package import ship

#: Edges that a task contracts by itself, and nodes that its worker remembers, about.
LOCAL = 400_000


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the (u, v) of a task: each node but the least of its component, with that one.

    A task of more edges than it may hold contracts block by block, which leaves more to the rounds.
    """
    above: dict = {}

    def top(x):
        while (up := above.get(x, x)) != x:
            above[x] = above.get(up, up)
            x = up
        return x

    def block(schema):
        nodes = list(above)
        for at in range(0, len(nodes), 50_000):
            part = nodes[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, schema.field(0).type), pa.array([top(x) for x in part], schema.field(1).type)], ["u", "v"])
        above.clear()

    schema = None
    for batch in batches:
        schema = batch.schema
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(u), top(v)
            if a != b:
                above[max(a, b)] = min(a, b)
        if len(above) >= LOCAL:
            yield from block(schema)
    if above:
        yield from block(schema)


def _contracted(links: DataFrame, number: int) -> DataFrame:
    """links as stars within each task; no node changes its component."""
    kinds = dict(links.dtypes)
    return written(links.coalesce(-(-max(number, 1) // LOCAL)).mapInArrow(_stars, f"u {kinds['u']}, v {kinds['v']}"), "stars")


def _settled(links: DataFrame) -> bool:
    """Whether every node hangs on one node, which hangs on none."""
    ends = links.select("u", F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(links.select(F.col("v").alias("u"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    each = ends.groupBy("u").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return each.where("below > 1 or (below = 1 and above = 1)").isEmpty()


def _hang(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each (u, v) with the minimum of u's neighbourhood, u included; and the table of minima, written."""
    least = written(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return edges.join(least.hint("merge"), "u"), least


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", *, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node reachable.

    Edges with a null end are ignored, repeated edges and self-loops are
    harmless, and a node whose only edge is a self-loop is its own component.
    An empty edge table gives an empty result.
    """
    ship(edges.sparkSession)
    clean = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    clean = written(clean.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    loops, links = clean.where("u = v").select(F.col("u").alias("node")), clean.where("u <> v")
    links = _contracted(links, links.count())
    for _ in range(max_rounds):
        if _settled(links):
            break
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hung, least = _hang(both)
        large = written(hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        discard(least)
        small, least = _hang(large)
        after = written(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "links")
        discard(large, least, links)
        links = _contracted(after, after.count())
        discard(after)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = links.select(F.col("v").alias("node")).unionByName(loops.join(stars.hint("merge"), "node", "left_anti")).distinct()
    return stars.unionByName(roots.select("node", F.col("node").alias("component")))
