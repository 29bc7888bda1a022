"""Connected components of an edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, cut_small, release


#: Edges of a list that is joined up in one step, as a forest that one task holds (16 bytes an edge); longer ones take steps over all.
SHORT = 200_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label) of the nodes of all edges (u, v) of a task."""
    ends = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not ends:
        return
    u, v = (np.concatenate(c) for c in zip(*ends, strict=True))
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while len(a):
        np.minimum.at(label, np.maximum(label[a], label[b]), np.minimum(label[a], label[b]))  # the greater root goes to the lesser one
        while (label[label] != label).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "label"])


def _star(edges: DataFrame, both: DataFrame, keep) -> DataFrame:
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return edges.join(least, "u").select(*keep)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most: int | None = None) -> DataFrame:
    """(node, label) of each node of an undirected edge list; the label is the least node of its component.

    Loops and repeated edges are allowed; null ends are left out; no edges give no rows. Each step sends an edge to the
    least neighbour of one of its ends, so a node with many neighbours is summed up before the shuffle. ``most`` says that there
    are no more edges than that; a ``SHORT`` list needs no shuffle.
    """
    plain = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    if most is not None and most <= SHORT:
        return cut_lineage(plain.coalesce(1).mapInArrow(_forest, "node bigint, label bigint"))
    now = cut_lineage(plain.distinct())
    mark = None
    rows = now.count()
    while True:
        # large star: neighbours above a node go to its least neighbour
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both.where("v > u"), both, [F.col("v").alias("u"), F.col("m").alias("v")]).union(now.where("false")).distinct().where("u != v")
        ordered = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        # small star: a node and its lesser neighbours go to the least of them
        least = ordered.groupBy("u").agg(F.min("v").alias("m"))
        small = ordered.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        now = cut_small(small, rows)
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(found) == mark:
            break
        mark, rows = tuple(found), found[0]
    release(edges.sparkSession)
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v"), F.col("v")).distinct())
