"""Exact top-k inner-product search by a dual-tree cover-tree traversal.

A cover tree is fitted on a bounded sample (`sample` vectors, the smallest id hashes): nested farthest-first nets whose
covering radii halve from level to level, down to a leaf for about `leaf_rows` vectors (`leaves` at most); a node's parent is
its nearest node in the net above. Every vector, query or candidate, is dealt to its nearest leaf, and every node gets the
covering radius, the covering angle, the range of norms and the count of all candidates below it, so the tree's statistics
are exact and as small as the sample. Leaves are split into blocks of at most `block` candidates by id hash; a leaf that
holds a third of all rows is many blocks. Inside a block a net of its own splits the candidates once more.

A query group is the queries of one leaf (in chunks). First each group probes its most promising leaves, which gives every
query a kth score. Then the group and the tree are walked together. Two bounds hold for a pair of nodes: with q, n the
centres and r, s the covering radii, no inner product exceeds q.n + r|n| + s|q| + rs; and with t the angle between the
centres and u, v the covering angles, none exceeds |q||x| cos(t - u - v) for the norms that do most. The pair is pruned when
the lesser is below the group's worst kth score. Surviving leaves are probed for the queries whose own kth score they can
reach, and inside a block every query opens only the nodes that can still reach its kth score, best nodes first. Nothing is
approximate: the bounds only skip what cannot be in a result. How much they skip depends on the vectors: pruned_share tells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rastra.llm.common import shuffle_width
from rastra.storage import stage_table


_PROBE = "leaf int, query_id long, vec binary, tau double"


@dataclass(frozen=True)
class Settings:
    sample: int = 4096
    leaf_rows: int = 512
    leaves: int = 1024
    block: int = 2048
    queries: int = 512
    first_leaves: int = 4


def usable(vector: Column) -> Column:
    """Neither null nor holding null or non-finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False))


def quantized(vector: Column, scale: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))


def _matrix(rows: list[bytes], width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are padded with zeros, which changes no inner product."""
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        v = np.frombuffer(r, "<f8")
        out[i, : len(v)] = v
    return out


def farthest_first(x: np.ndarray, n: int) -> tuple[list[int], list[float]]:
    """The first n points of a farthest-first traversal, or all distinct ones, and the covering radius after each: nested nets."""
    picked, gap = [0], ((x - x[0]) ** 2).sum(1)
    radii = [float(gap.max()) ** 0.5]
    while len(picked) < n and gap.max() > 0:
        picked.append(int(gap.argmax()))
        gap = np.minimum(gap, ((x - x[picked[-1]]) ** 2).sum(1))
        radii.append(float(gap.max()) ** 0.5)
    return picked, radii


def _sizes(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x**2).sum(-1))


def _angles(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Angles between the rows of x and c (broadcast); a zero vector is at angle 0 to all but itself of no account."""
    scale = _sizes(x) * _sizes(c)
    cosine = (x * c).sum(-1) / np.where(scale > 0, scale, 1)
    return np.where(scale > 0, np.arccos(np.clip(cosine, -1, 1)), 0.0)


@dataclass
class Shape:
    """What is known of the vectors below some nodes: centres, covering radii and angles, least and greatest norms."""

    centers: np.ndarray
    radius: np.ndarray
    angle: np.ndarray
    least: np.ndarray
    most: np.ndarray

    def at(self, which: np.ndarray) -> Shape:
        return Shape(self.centers[which], self.radius[which], self.angle[which], self.least[which], self.most[which])

    @classmethod
    def of(cls, x: np.ndarray, centers: np.ndarray, near: np.ndarray) -> Shape:
        """Of rows of x under their nodes."""
        n, norm = len(centers), _sizes(x)
        out = cls(centers, np.zeros(n), np.zeros(n), np.full(n, np.inf), np.zeros(n))
        np.maximum.at(out.radius, near, _sizes(x - centers[near]))
        np.maximum.at(out.angle, near, _angles(x, centers[near]))
        np.minimum.at(out.least, near, norm)
        np.maximum.at(out.most, near, norm)
        return out

    def bounds(self, q: Shape) -> np.ndarray:
        """The greatest inner product that any vector below a node of q (rows) and one below a node of self can have."""
        product, a, b = q.centers @ self.centers.T, _sizes(q.centers)[:, None], _sizes(self.centers)[None, :]
        ball = product + q.radius[:, None] * b + a * self.radius[None, :] + q.radius[:, None] * self.radius[None, :]
        known = (a > 0) & (b > 0)
        between = np.where(known, np.arccos(np.clip(product / np.where(known, a * b, 1), -1, 1)), 0.0)
        cosine = np.cos(np.maximum(0.0, between - q.angle[:, None] - self.angle[None, :]))
        cone = np.where(cosine > 0, q.most[:, None] * self.most[None, :], q.least[:, None] * self.least[None, :]) * cosine
        bound = np.minimum(ball, cone)
        return bound + 1e-6 * (np.abs(bound) + a * b) + 1e-6  # rounding never prunes


def _points(x: np.ndarray) -> Shape:
    """Every row a node of its own."""
    zero = np.zeros(len(x))
    return Shape(x, zero, zero, _sizes(x), _sizes(x))


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers**2).sum(1)[None, :] - 2 * x @ centers.T).argmin(1)


@dataclass
class CoverTree:
    """shape, parent, level and count by node; the leaves are the nodes of the last level, in order."""

    centers: np.ndarray
    parent: np.ndarray
    level: np.ndarray
    shape: Shape | None = None
    count: np.ndarray | None = None

    @classmethod
    def fit(cls, sample: np.ndarray, leaves: int) -> CoverTree:
        order, radii = farthest_first(sample, leaves)
        nets = [1]
        while nets[-1] < len(order):  # the next net halves the covering radius
            half = next((i + 1 for i, r in enumerate(radii) if r <= radii[nets[-1] - 1] / 2), len(order))
            nets.append(min(len(order), max(half, nets[-1] + 1)))
        centers, parent, level, above = [], [], [], None
        for k, size in enumerate(nets):
            net = sample[order[:size]]
            start = sum(map(len, centers[:-1])) if centers else -1
            parent.append(np.full(len(net), -1) if above is None else start + _nearest(net, above))
            centers.append(net)
            level.append(np.full(len(net), k))
            above = net
        return cls(np.vstack(centers), np.concatenate(parent), np.concatenate(level))

    @property
    def leaves(self) -> np.ndarray:
        return np.flatnonzero(self.level == self.level[-1])

    def paths(self) -> np.ndarray:
        """The nodes from each leaf up to the root, leaf first."""
        path = [self.leaves]
        while self.level[path[-1][0]] > 0:
            path.append(self.parent[path[-1]])
        return np.stack(path, 1)


def _dealt(vectors: DataFrame, tree: CoverTree) -> DataFrame:
    """id, vec, leaf, norm, and the distances and angles to the leaf and the nodes above it."""
    leaves, paths, width = tree.centers[tree.leaves], tree.paths(), tree.centers.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, 2000) for whole in batches for i in range(0, len(whole), 2000)):
            raw = [np.asarray(v.values.to_numpy(), "<f8").tobytes() for v in batch.column(1)]
            x = _matrix(raw, width)
            leaf = _nearest(x, leaves)
            nodes = tree.centers[paths[leaf]]
            far, angle = _sizes(x[:, None, :] - nodes), _angles(x[:, None, :], nodes)
            cols = [batch.column(0), pa.array(raw, pa.binary()), pa.array(leaf.astype(np.int32)), pa.array(_sizes(x)), *(pa.array(v.tolist(), pa.list_(pa.float64())) for v in (far, angle))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "vec", "leaf", "norm", "far", "angle"])

    return vectors.mapInArrow(run, "id long, vec binary, leaf int, norm double, far array<double>, angle array<double>")


def _blocks(rows: DataFrame, size: int, *extra: str) -> DataFrame:
    """leaf, part, members (at most about `size` rows each, however large a leaf is)."""
    counts = rows.groupBy("leaf").agg(F.ceil(F.count("*") / size).alias("parts"))  # as many rows as the tree has leaves
    parted = rows.join(F.broadcast(counts), "leaf").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    return parted.groupBy("leaf", "part").agg(F.collect_list(F.struct("id", "vec", *extra)).alias("members"))


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of the rows of q and x as whole numbers: by doubles where those hold them all, else by integers."""
    if q.shape[1] * np.abs(q).max(initial=0) * np.abs(x).max(initial=0) < 2**53:
        return (q @ x.T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


def _safe(tau: np.ndarray) -> np.ndarray:
    """Scores as doubles that are not greater."""
    return tau - 1e-15 * np.abs(tau)


def _best_of_block(q: np.ndarray, qid: np.ndarray, tau: np.ndarray, x: np.ndarray, vid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query row, candidate row, score) of each query's k best that reach its tau, and how many products were taken."""
    net = x[farthest_first(x, max(1, int(len(x) ** 0.5)))[0]]
    near = _nearest(x, net)
    shape = Shape.of(x, net, near)
    bound = shape.bounds(_points(q))
    tau, taken = tau.copy(), 0
    best = np.full((len(q), 0), -np.inf)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for node in np.argsort(-bound.max(0), kind="stable"):
        asks, mine = np.flatnonzero(bound[:, node] >= tau), np.flatnonzero(near == node)
        if not len(asks) or not len(mine):
            continue
        taken += len(asks) * len(mine)
        score = _products(q[asks], x[mine])
        close = np.where(qid[asks][:, None] == vid[mine][None, :], -np.inf, _safe(score.astype(float)))
        a, m = np.nonzero((close >= tau[asks][:, None]) & (close > -np.inf))
        found.append((asks[a], mine[m], score[a, m]))
        top = np.full((len(q), k), -np.inf)
        some = -np.sort(-close, axis=1)[:, :k]
        top[asks, : some.shape[1]] = some
        best = -np.sort(-np.hstack([best, top]), axis=1)[:, :k]
        tau = np.maximum(tau, _safe(best[:, k - 1]))
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.int64), taken
    row, at, value = (np.concatenate(part) for part in zip(*found))
    order = np.lexsort((vid[at], -value, row))
    row, at, value = row[order], at[order], value[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row, side="left")
    keep = rank < k
    return row[keep], at[keep], value[keep], taken


def _probed(probes: DataFrame, blocks: DataFrame, k: int, width: int, s: Settings) -> DataFrame:
    """query_id, vec_id, score: for each probe the k best of every block that reach its tau; and for each batch of probes of a
    block a row whose score is the number of products taken (query_id null)."""
    sizes = probes.groupBy("leaf").agg(F.ceil(F.count("*") / s.queries).alias("parts"))
    batched = probes.join(F.broadcast(sizes), "leaf").withColumn("part", F.pmod(F.xxhash64("query_id"), "parts"))
    batched = batched.groupBy("leaf", "part").agg(F.collect_list(F.struct("query_id", "vec", "tau")).alias("asked")).drop("part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                asked, members = (batch.column(c)[i].as_py() for c in (0, 1))
                qid, vid = np.array([q["query_id"] for q in asked]), np.array([m["id"] for m in members])
                q, x = _matrix([q["vec"] for q in asked], width), _matrix([m["vec"] for m in members], width)
                row, at, value, taken = _best_of_block(q, qid, np.array([q["tau"] for q in asked]), x, vid, k)
                ids, vecs = pa.array([None, *qid[row].tolist()], pa.int64()), pa.array([None, *vid[at].tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, vecs, pa.array([taken, *value.tolist()], pa.int64())], ["query_id", "vec_id", "score"])

    # a staged table's files say little of its size, so neither side is broadcast
    return batched.hint("merge").join(blocks, "leaf").select("asked", "members").mapInArrow(run, "query_id long, vec_id long, score long")


def _first_leaves(q: np.ndarray, tree: CoverTree, need: int, s: Settings) -> np.ndarray:
    """The leaves of greatest inner product with a group's centre: at least first_leaves, holding at least `need` rows."""
    leaves = tree.leaves
    order = np.argsort(-(tree.centers[leaves] @ q), kind="stable")
    enough = int(np.searchsorted(np.cumsum(tree.count[leaves][order]), need)) + 1
    return order[: max(s.first_leaves, enough)]


def _walk(group: Shape, tau: float, tree: CoverTree) -> list[int]:
    """The leaves that the walk of a query group (one node, its worst kth score) down the tree does not prune."""
    first, last = int(tree.leaves[0]), tree.level[-1]
    level = np.flatnonzero(tree.level == 0)
    while len(level):
        level = level[tree.count[level] > 0]
        level = level[tree.shape.at(level).bounds(group)[0] >= tau]
        if len(level) and tree.level[level[0]] == last:
            return [int(x) - first for x in level]
        level = np.flatnonzero(np.isin(tree.parent, level))
    return []


def _group_probes(groups: DataFrame, tree: CoverTree, k: int, s: Settings, walk: bool) -> DataFrame:
    """Probes of each query group: its first leaves, or with walk what the dual walk leaves of the others."""
    leaves, width = tree.leaves, tree.centers.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.array([m["id"] for m in row["members"]])
                x = _matrix([m["vec"] for m in row["members"]], width)
                first = _first_leaves(tree.centers[leaves[row["leaf"]]], tree, k + 1, s)
                tau = np.array([m["tau"] for m in row["members"]]) if walk else np.full(len(ids), -np.inf)
                chosen = first
                if walk:
                    group = Shape.of(x, x.mean(0)[None, :], np.zeros(len(x), int))
                    chosen = np.setdiff1d(_walk(group, tau.min(), tree), first).astype(int)
                at, leaf = np.nonzero(tree.shape.at(leaves[chosen]).bounds(_points(x)) >= tau[:, None])
                vecs = pa.array([m["vec"] for m in row["members"]], pa.binary())
                for i in range(0, len(at), 20_000):
                    a, b = at[i : i + 20_000], leaf[i : i + 20_000]
                    yield pa.RecordBatch.from_arrays([pa.array(chosen[b].astype(np.int32)), pa.array(ids[a]), vecs.take(pa.array(a)), pa.array(tau[a])], ["leaf", "query_id", "vec", "tau"])

    groups = groups.select("leaf", "members").repartition(shuffle_width(groups.sparkSession))  # few rows with much work each
    return stage_table(groups.mapInArrow(run, _PROBE), "probes")


def _search(vectors: DataFrame, queries: DataFrame, k: int, s: Settings) -> DataFrame:
    """query_id, vec_id, score: candidates that hold every query's k best, and counts of products (query_id null)."""
    spark = vectors.sparkSession
    most = [F.max(F.array_max(F.transform("vec", F.abs)))]
    width, rows, top = vectors.agg(F.max(F.size("vec")), F.count("*"), *most).first()
    if not rows:
        return spark.createDataFrame([], "query_id long, vec_id long, score long")
    width = max(1, width)
    if width * (top or 0) ** 2 >= 2**63:
        raise ValueError(f"components of {top:.0f} are too large: their inner products may leave the range of a long")
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(s.sample).collect()
    tree = CoverTree.fit(_matrix([np.array(r["vec"], "<f8").tobytes() for r in sample], width), max(1, min(s.leaves, rows // s.leaf_rows)))
    data = stage_table(_dealt(vectors, tree), "dealt")
    n, depth = len(tree.centers), tree.level[-1] + 1
    tree.shape, tree.count = Shape(tree.centers, np.zeros(n), np.zeros(n), np.full(n, np.inf), np.zeros(n)), np.zeros(n, int)
    far = [F.max(F.get(c, F.lit(i))).alias(f"{c}{i}") for c in ("far", "angle") for i in range(depth)]
    for r in data.groupBy("leaf").agg(F.count("*").alias("n"), F.min("norm").alias("least"), F.max("norm").alias("most"), *far).collect():  # as many rows as the tree has leaves
        for i, node in enumerate(tree.paths()[r["leaf"]]):
            tree.count[node] += r["n"]
            tree.shape.radius[node] = max(tree.shape.radius[node], r[f"far{i}"])
            tree.shape.angle[node] = max(tree.shape.angle[node], r[f"angle{i}"])
            tree.shape.least[node] = min(tree.shape.least[node], r["least"])
            tree.shape.most[node] = max(tree.shape.most[node], r["most"])
    blocks = stage_table(_blocks(data, s.block).drop("part"), "blocks")

    asked = stage_table(_dealt(queries.groupBy("id").agg(F.min("vec").alias("vec")), tree).select("id", "vec", "leaf"), "queries")
    first = stage_table(_probed(_group_probes(_blocks(asked, s.queries), tree, k, s, False), blocks, k, width, s), "first")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    named = first.where("query_id is not null")
    kth = named.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), (F.col("score").cast("double") - 1e-15 * F.abs("score")).alias("tau"))
    asked = asked.join(kth, "id", "left").fillna(float("-inf"), ["tau"])
    return first.unionByName(_probed(_group_probes(_blocks(asked, s.queries, "tau"), tree, k, s, True), blocks, k, width, s))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, s: Settings = Settings()) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best inner products of each query, ties to the smaller vec_id.

    vectors and queries: id long, vec array<double> of whole numbers. A query's own id is no candidate of it; fewer
    candidates give fewer rows; a query id that repeats counts once, repeated candidate rows as often as they stand.
    Scores are exact over the whole range of a long; components so large that a score might leave it are an error.
    Vectors of unlike lengths are padded with zeros, empty ones too. Without vectors or queries there are no rows.
    """
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = _search(vectors, queries, k, s).where("query_id is not null").withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def pruned_share(vectors: DataFrame, queries: DataFrame, k: int = 5, s: Settings = Settings()) -> float:
    """The share of all pairs of a query and a candidate whose inner product the search does not take."""
    taken = _search(vectors, queries, k, s).where("query_id is null").agg(F.sum("score")).first()[0] or 0
    pairs = vectors.count() * queries.select("id").distinct().count()
    return 1 - taken / pairs if pairs else 0.0


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """top_k of the contract's queries over all usable embeddings; odd rows as there."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), quantized(F.col("embedding")).alias("vec"))
    return top_k(rows, rows.where(F.col("id") % 50 == 0))


OP7_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, k::INTEGER AS rank, vec_id, score FROM r WHERE k <= 5
"""
