"""Product quantisation: the codebooks of a vector's parts by Yinyang Lloyd rounds on whole numbers.

The entries of each part's codebook fall into a few groups once and for all. A row keeps, for each part, its entry and one lower
bound for each group: no entry of the group but its own is nearer. When the entries have moved, a bound falls by the most that an
entry of its group moved; the distance to the row's own entry is taken anew, and only the groups whose bound doesn't exceed it
are scanned. Distances are sums of squares of whole numbers, so they are exact and ties go to the lower index; bounds are rounded
down, and a group is skipped only if its bound is greater than the best distance, so a skipped group has no tie either.

Rows, entries and bounds are one work table for each round; the driver sees the sums and counts of the codebooks' entries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rastra.llm.topk import usable
from rastra.storage import drop_staged, stage_table


@dataclass(frozen=True)
class Settings:
    parts: int = 4
    entries: int = 256
    rounds: int = 4
    groups: int = 16
    scale: int = 1024


@dataclass
class Codebook:
    """One part's entries (whole numbers), the group of each, and how far each group's entries moved last."""

    entries: np.ndarray
    group: np.ndarray
    drift: np.ndarray

    @classmethod
    def first(cls, entries: np.ndarray, groups: int) -> Codebook:
        """Grouped around far entries, and a few times around the groups' means."""
        x = entries.astype(float)
        groups = max(1, min(groups, len(x)))
        centers, gap = [0], ((x - x[0]) ** 2).sum(1)
        while len(centers) < groups:
            centers.append(int(gap.argmax()))
            gap = np.minimum(gap, ((x - x[centers[-1]]) ** 2).sum(1))
        c = x[centers]
        for _ in range(5):
            near = ((x[:, None, :] - c[None, :, :]) ** 2).sum(-1).argmin(1)
            c = np.array([x[near == g].mean(0) if (near == g).any() else c[g] for g in range(groups)])
        return cls(entries, near, np.zeros(groups))

    def moved(self, entries: np.ndarray) -> Codebook:
        far = np.sqrt(((entries - self.entries).astype(float) ** 2).sum(1)) * (1 + 1e-9)
        return Codebook(entries, self.group, np.array([far[self.group == g].max(initial=0) for g in range(len(self.drift))]))


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x and c, exact as long as they are below 2^63."""
    width, top = x.shape[1], int(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)))
    if 4 * width * top * top < 1 << 53:  # whole numbers that doubles hold
        a, b = x.astype(float), c.astype(float)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in c], 1) if len(c) else np.zeros((len(x), 0), np.int64)


def _down(v: np.ndarray) -> np.ndarray:
    """v as half-precision numbers that are not greater."""
    with np.errstate(over="ignore"):
        h = np.minimum(v, 65504.0).astype(np.float16)
    return np.where(h.astype(float) > v, np.nextafter(h, np.float16(-np.inf)), h)


def nearest(x: np.ndarray, book: Codebook, own: np.ndarray | None, bounds: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(entry, squared distance, bounds, distances taken) of each row of x, from its entry and bounds before the last move."""
    n, groups = len(x), len(book.drift)
    if own is None:
        best, at = np.full(n, np.iinfo(np.int64).max), np.full(n, len(book.entries))
        bounds, taken = np.full((n, groups), -1.0), 0
    else:
        at = own.astype(np.int64)
        best, taken = ((x - book.entries[at]) ** 2).sum(1), n
        bounds = bounds.astype(float) - book.drift[None, :]
    before, at_before = best.copy(), at.copy()
    far = np.full((n, groups), np.iinfo(np.int64).max)  # of the scanned groups: the least distance, the next one, and whose
    next_far, whose = far.copy(), np.full((n, groups), -1)
    for g in range(groups):
        members = np.flatnonzero(book.group == g)
        asks = np.flatnonzero(bounds[:, g] <= np.sqrt(best.astype(float)) * (1 + 1e-9))
        if not len(members) or not len(asks):
            continue
        d = _squares(x[asks], book.entries[members])
        taken += d.size
        k = d.argmin(1)
        far[asks, g], whose[asks, g] = d[np.arange(len(asks)), k], members[k]
        d[np.arange(len(asks)), k] = np.iinfo(np.int64).max
        next_far[asks, g] = d.min(1)
        better = (far[asks, g] < best[asks]) | ((far[asks, g] == best[asks]) & (whose[asks, g] < at[asks]))
        best[asks[better]], at[asks[better]] = far[asks[better], g], whose[asks[better], g]
    scanned = whose >= 0
    least = np.sqrt(np.where(whose == at[:, None], next_far, far).astype(float)) * (1 - 1e-9)
    bounds = np.where(scanned, least, bounds)
    if own is not None:  # an entry that a row has left counts in its group again
        left = np.flatnonzero(at != at_before)
        g = book.group[at_before[left]]
        bounds[left, g] = np.minimum(bounds[left, g], np.sqrt(before[left].astype(float)) * (1 - 1e-9))
    return at, best, _down(np.maximum(bounds, -1.0)), taken


class _Rows:
    """The arrays of a batch: x (row, part, component), and if there are any own (row, part) and bounds (row, part, group)."""

    def __init__(self, batch: pa.RecordBatch, width: int, s: Settings):
        def array(c: int, kind) -> np.ndarray:
            return np.frombuffer(b"".join(batch.column(c).to_pylist()), kind).reshape(len(batch), s.parts, -1)

        self.x = array(1, "<i8").astype(np.int64) if width else np.zeros((len(batch), s.parts, 0), np.int64)
        self.state = (array(2, "<u2")[:, :, 0], array(3, "<f2")) if batch.num_columns > 2 else None


def _binary(x: np.ndarray, kind: str) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(x.reshape(len(x), -1).astype(kind))], pa.binary())


def _fixed(vectors: DataFrame, width: int, s: Settings) -> DataFrame:
    """row, x: the parts of each vector, padded with zeros, as bytes of whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.zeros((len(batch), width * s.parts), np.int64)
            for i, v in enumerate(batch.column(1)):
                x[i, : len(v)] = v.values.to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), _binary(x, "<i8")], ["row", "x"])

    return vectors.mapInArrow(run, StructType().add(vectors.schema["row"]).add("x", "binary"))


def _assigned(rows: DataFrame, books: list[Codebook], width: int, s: Settings, last: bool) -> DataFrame:
    """row, x, own, bounds; in the last round row, code, error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, 2048) for whole in batches for i in range(0, len(whole), 2048)):
            r = _Rows(batch, width, s)
            found = [nearest(r.x[:, p], book, *((r.state[0][:, p], r.state[1][:, p]) if r.state else (None, None))) for p, book in enumerate(books)]
            own, error = np.stack([f[0] for f in found], 1), sum(f[1] for f in found)
            if last:
                code = ["".join(f"{e:02x}" for e in row) for row in own.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["row", "code", "error"])
            else:
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], _binary(own, "<u2"), _binary(np.stack([f[2] for f in found], 1), "<f2")], ["row", "x", "own", "bounds"])

    kind = StructType().add(rows.schema["row"])
    kind = kind.add("code", "string").add("error", "long") if last else kind.add("x", "binary").add("own", "binary").add("bounds", "binary")
    return rows.mapInArrow(run, kind)


def _means(rows: DataFrame, books: list[Codebook], width: int, s: Settings) -> list[Codebook]:
    """The entries moved to the floor of their parts' means: each task adds its rows up, the driver sees parts x entries rows."""
    sizes = [len(b.entries) for b in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = [np.zeros(n, np.int64) for n in sizes]
        total = [np.zeros((n, width), np.int64) for n in sizes]
        for batch in batches:
            r = _Rows(batch, width, s)
            for p in range(s.parts):
                own = r.state[0][:, p].astype(np.int64)
                count[p] += np.bincount(own, minlength=sizes[p])
                np.add.at(total[p], own, r.x[:, p])
        for p in range(s.parts):
            used = np.flatnonzero(count[p])
            columns = [pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(count[p][used]), pa.array(total[p][used].tolist(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "total"])

    sums = rows.select(F.lit(0), "x", "own", "bounds").mapInArrow(run, "part int, entry int, n long, total array<long>")
    each = [F.sum(F.get("total", F.lit(i)).cast("decimal(38,0)")).alias(f"t{i}") for i in range(width)]
    entries = [b.entries.copy() for b in books]
    for r in sums.groupBy("part", "entry").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), *each).collect():
        entries[r["part"]][r["entry"]] = [int(r[f"t{i}"]) // int(r["n"]) for i in range(width)]
    return [b.moved(e) for b, e in zip(books, entries)]


def _seeds(vectors: DataFrame, s: Settings) -> list[list[int]]:
    """The vectors of the smallest ids, ascending; of an id that repeats the least one."""
    ids = vectors.where("id is not null").select("id").distinct().orderBy("id").limit(s.entries).agg(F.max("id")).first()[0]
    if ids is None:
        return []
    some = vectors.where(F.col("id") <= F.lit(ids)).groupBy("id").agg(F.min("vec").alias("vec"))
    return [r["vec"] for r in some.orderBy("id").collect()]


def learn_codes(vectors: DataFrame, id_col: str, vector_col: str, s: Settings = Settings()) -> tuple[DataFrame, list[np.ndarray]]:
    """(row: all columns but the vector, code: an index of two or more hex digits for each part, error: the parts' squared
    distances, added up) of each usable vector, and the codebooks of the parts.

    A component x counts as floor(scale * x). Null vectors and those with a null or non-finite component are left out. Shorter
    vectors, and a width that the parts don't divide, are padded with zeros; empty vectors are zeros too. Codebooks start with the
    smallest ids; a null id is never one of them, of a repeated id the least vector is; without any id there are no codebooks, and
    code and error are null. Repeated rows count as often as they stand; an empty table gives no rows. Components so large that a
    squared distance may leave the range of a long are an error.
    """
    rest = [vectors[f"`{c}`"] for c in vectors.columns if c != vector_col]
    rows = vectors.where(usable(F.col(f"`{vector_col}`"))).select(
        F.struct(*rest).alias("row"), F.transform(F.col(f"`{vector_col}`"), lambda x: F.floor(x.cast("double") * s.scale)).alias("vec"), F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.array_max(F.transform(F.col(f"`{vector_col}`"), lambda x: F.abs(x.cast("double") * s.scale))), F.lit(0.0)).alias("top"),
    )
    longest, top = rows.agg(F.max(F.size("vec")), F.max("top")).first()
    width = -(-(longest or 0) // s.parts)
    if top is not None and 4 * width * (top + 1) ** 2 >= 1 << 63:
        raise ValueError(f"components of {top / s.scale} are too large for whole-number distances")
    seeds = np.zeros((0, width * s.parts), np.int64)
    if some := _seeds(rows, s):
        seeds = np.array([[*v, *[0] * (width * s.parts - len(v))] for v in some], np.int64).reshape(len(some), width * s.parts)
    else:
        return rows.select("row", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")), []
    books = [Codebook.first(seeds[:, p * width : (p + 1) * width], s.groups) for p in range(s.parts)]
    table = stage_table(_fixed(rows.select("row", "vec"), width, s), "parts")
    for _ in range(s.rounds):
        after = stage_table(_assigned(table, books, width, s, False), "assigned")
        drop_staged(table)
        table, books = after, _means(after, books, width, s)
    codes = stage_table(_assigned(table, books, width, s, True), "codes")
    drop_staged(table)
    return codes, [b.entries for b in books]


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """learn_codes on all embeddings, with the error of each label; odd rows as there, null labels together."""
    codes, books = learn_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding"), "vec_id", "embedding")
    digest = hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()
    codes = codes.select(F.col("row.vec_id").alias("vec_id"), F.col("row.label").alias("label"), "code", "error")
    by_label = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    out = codes.join(by_label, F.col("label").eqNullSafe(F.col("of")), "left")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest if books else None).cast("string").alias("codebooks_sha256"))


def _round_sql(r: int) -> str:
    """The codes of round r, and the entries of the next one."""
    return f"""
a{r} AS MATERIALIZED (
  SELECT x.k, x.part, min((x.xx - 2 * list_inner_product(x.v, c.v) + c.cc)::BIGINT * 256 + c.entry) AS m
  FROM x JOIN c{r} c USING (part) GROUP BY x.k, x.part),
s{r} AS (
  SELECT x.part, a.m % 256 AS entry, i, floor(sum(x.v[i]) / count(*)) AS v
  FROM x JOIN a{r} a USING (k, part), unnest(range(1, len(x.v) + 1)) AS u(i) GROUP BY ALL),
n{r} AS (SELECT part, entry, list(v ORDER BY i) AS v FROM s{r} GROUP BY part, entry),
c{r + 1} AS MATERIALIZED (
  SELECT c.part, c.entry, coalesce(n.v, c.v) AS v, list_inner_product(coalesce(n.v, c.v), coalesce(n.v, c.v)) AS cc
  FROM c{r} c LEFT JOIN n{r} n USING (part, entry)),"""


OP11_SQL = f"""
WITH kept AS (
  SELECT row_number() OVER () AS k, vec_id, label, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT range AS part FROM range(4)),
x AS MATERIALIZED (SELECT k, part, v, list_inner_product(v, v) AS xx FROM (
  SELECT k, part, e[part * len(e) // 4 + 1 : (part + 1) * len(e) // 4] AS v FROM kept, p)),
first AS (SELECT e, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM (SELECT vec_id, min(e) AS e FROM kept GROUP BY vec_id ORDER BY vec_id LIMIT 256)),
c0 AS MATERIALIZED (SELECT part, entry, v, list_inner_product(v, v) AS cc FROM (
  SELECT part, entry, e[part * len(e) // 4 + 1 : (part + 1) * len(e) // 4] AS v FROM first, p)),{"".join(map(_round_sql, range(4)))}
a4 AS (
  SELECT x.k, x.part, min((x.xx - 2 * list_inner_product(x.v, c.v) + c.cc)::BIGINT * 256 + c.entry) AS m
  FROM x JOIN c4 c USING (part) GROUP BY x.k, x.part),
codes AS (SELECT k, string_agg(lower(printf('%02x', (m % 256)::INTEGER)), '' ORDER BY part) AS code, sum(m // 256)::BIGINT AS error FROM a4 GROUP BY k),
books AS (SELECT sha256(string_agg(array_to_string([t::BIGINT FOR t IN v], ','), ',' ORDER BY part, entry)) AS h FROM c4)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256
FROM kept JOIN codes USING (k), books
"""
