"""Connected components by alternating large-star and small-star rounds over edge tables; small graphs in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastra.storage import stage_table

#: Edges for each file of a work table: small graphs are not written as hundreds of files.
FILE_EDGES = 250_000
#: A graph of at most so many edges (16 MB) is solved in one task. The result is that of the rounds.
SMALL = 1_000_000


def solved(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, component) of a graph's edges, a component being its least node: labels fall along edges, then along labels."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        np.minimum.at(low, label, low)  # a component's old least node hears of the new one
        low = low[low]
        if (low == label).all():
            return nodes, nodes[label]
        label = low


def _star(edges: DataFrame, large: bool, files: int) -> DataFrame:
    """edges: u > v, distinct. Hub nodes are handled by joining two staged tables, which adaptive execution can split."""
    if large:  # every larger neighbour of a node goes to the node's least neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage_table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).coalesce(files), "least")
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # a node and all its smaller neighbours go to the least of them
        least = stage_table(edges.groupBy("u").agg(F.min("v").alias("m")).coalesce(files), "least")
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return stage_table(moved.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().coalesce(files), "star")


def _summary(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _solved_at_once(edges: DataFrame) -> DataFrame:
    kind = edges.schema["u"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if parts:
            found = solved(*(np.concatenate(side) for side in zip(*parts)))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["node", "component"])

    out = edges.select(*[edges[c].cast("long").alias(c) for c in "uv"]).coalesce(1).mapInArrow(run, "node long, component long")
    return stage_table(out.select(*[out[c].cast(kind).alias(c) for c in ("node", "component")]), "components")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", small: int = SMALL) -> DataFrame:
    """node and component (the least node reachable) for every node that an edge between two nodes names. Graphs of at most `small`
    edges go to one task, with 0 all go through the rounds."""
    edges = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges, before = stage_table(edges, "edges"), None
    now = _summary(edges)
    if now[0] <= small:
        return _solved_at_once(edges)
    while now != before:
        before, files = now, 1 + now[0] // FILE_EDGES
        edges = _star(_star(edges, True, files), False, files)
        now = _summary(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
