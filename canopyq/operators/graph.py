"""Connected components over edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyq.plans.storage import discard, stored


#: Most edges, counted in both directions, that one task contracts at once; larger graphs shrink by rounds until so few are left.
LAST_EDGES = 100_000
#: Types of nodes that such a task tells apart; graphs of others go by rounds to their end.
_PLAIN_NODES = ("binary", "string", "bigint", "int")


def _contracted(edges: DataFrame) -> DataFrame:
    """(node, parent) of a graph of few edges, each of which stands there in both directions: parent is one node of the component, the same for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        a, b = (c.combine_chunks() for c in pa.Table.from_batches(held).columns)
        nodes = a.unique()
        left, right = (pc.index_in(c, nodes).to_numpy(zero_copy_only=False) for c in (a, b))
        root = np.arange(len(nodes))
        while True:  # each root takes the least root that it meets; names then follow to their roots
            least = root.copy()
            np.minimum.at(least, root[left], root[right])
            while (least[least] != least).any():
                least = least[least]
            if (least[root] == root).all():
                break
            root = least[root]
        yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(root))], ["node", "parent"])

    kind = edges.schema["a"].dataType.simpleString()
    return edges.coalesce(1).mapInArrow(run, f"node {kind}, parent {kind}")


def connected_components(edges: DataFrame, source: str = "src", target: str = "dst", last_edges: int = LAST_EDGES) -> DataFrame:
    """The component of each node that has an edge: (node, component), the component's smallest node.

    Contraction: in each round every node joins the first of its neighbours and itself in an order by a hash that differs from round to round, edges are drawn between
    what the ends joined, and repeated edges and loops go. The graph shrinks by a constant factor in expectation, so rounds are logarithmic in the longest
    chain and all rounds together read a small multiple of the edges. Once ``last_edges`` are left, or fewer, one task contracts them in a last round, since rounds over so few cost the
    driver more jobs than work. Then names are handed down from the last round to the first. Rounds are written to the shared folder while the call lasts; only the number of edges
    that remain reaches the driver. Any ordered node type does; repeated edges are harmless, edges with a null end are left out.
    """
    pairs = edges.select(F.col(source).alias("a"), F.col(target).alias("b")).where("a is not null and b is not null")
    now = stored(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    least: DataFrame | None = None
    levels: list[tuple[DataFrame, DataFrame]] = []
    plain = now.schema["a"].dataType.simpleString() in _PLAIN_NODES and now.schema["a"].dataType == now.schema["b"].dataType
    while left := now.count():
        turn, last = len(levels), plain and left <= last_edges

        def rank(node: Column) -> Column:
            return F.struct(F.xxhash64(node, F.lit(turn)).alias("h"), node.alias("node"))  # noqa: B023

        if last:
            joins = _contracted(now)
        else:
            first = now.groupBy("a").agg(F.min(rank(F.col("b"))).alias("first"))
            joins = first.select(F.col("a").alias("node"), F.least(F.col("first"), rank(F.col("a")))["node"].alias("parent"))
        joins = stored(joins, "joins")
        named = joins.withColumn("least", F.col("node")) if least is None else joins.join(least, "node")
        met = stored(named.groupBy("parent").agg(F.min("least").alias("least")).withColumnRenamed("parent", "node"), "met")
        levels.append((joins, met))
        if last:
            break
        one = now.join(joins.select(F.col("node").alias("a"), F.col("parent").alias("p")), "a").select("p", "b")
        two = one.join(joins.select(F.col("node").alias("b"), F.col("parent").alias("q")), "b").where("p <> q")
        after = stored(two.select(F.col("p").alias("a"), F.col("q").alias("b")).distinct(), "edges")
        discard(now)
        now, least = after, met
    discard(now)
    if not levels:
        return pairs.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    names: DataFrame | None = None
    for joins, met in reversed(levels):
        known = met.withColumnRenamed("least", "component")
        if names is not None:
            known = met.join(names.withColumnRenamed("component", "deeper"), "node", "left").select("node", F.coalesce("deeper", "least").alias("component"))
        below = joins.join(known.withColumnRenamed("node", "parent"), "parent").select("node", "component")
        finished = stored(below, "components")
        if names is not None:
            discard(names)
        names = finished
    discard(*(t for level in levels for t in level))
    return names
