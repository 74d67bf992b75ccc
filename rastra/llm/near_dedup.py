"""MinHash near-duplicates by a multi-index Hamming join on b-bit signatures, confirmed on full shingle sets.

1. Every text becomes its set of word shingles (64-bit hashes) and a signature of `chunks * rows` minima of 16 bits.
   Equal sets collapse to one representative (the smallest doc_id), so groups of copies cost one node each.
2. Signatures are split into chunks. If two differ in at most `chunks * (errors + 1) - 1` places, the pigeonhole principle
   puts at most `errors` of them into some chunk, so enumerating each chunk with every choice of `errors` places left out
   gives the two a common key: no pair within that distance is missed.
3. A bucket (the representatives of a key) never emits its pairs. Its centre is its least member; a representative's home
   is the centre it meets most often. Links to the homes are confirmed first and make components. Homes are cut into
   blocks of bounded size. A bucket that still holds several components asks for the pairs of blocks that it touches;
   a pair of blocks is compared once, however many buckets ask for it, by multiplying the blocks' incidence matrices, and
   returns a spanning forest of the links it finds between different components. Pairs inside a component need no look:
   they can't change the result.
4. Every link is confirmed on the full sets: 100 * intersection >= percent * union.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rastra.llm.common import ascii_words, boxed, doc_rows, unboxed
from rastra.operators.graph import connected_components
from rastra.storage import stage_table

_SIGNED = "doc_id long, n_shingles long, h1 long, h2 long, sig binary"
#: The odd constants of the splitmix64 finaliser and an odd multiplier for word sequences.
_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Plan:
    """A pair of similarity 0.8 shares no key with a probability of 4e-7; a block has about `block` representatives and
    `block_shingles` shingles at most."""

    words: int = 5
    percent: int = 80
    chunks: int = 14
    rows: int = 6
    errors: int = 1
    block: int = 256
    block_shingles: int = 200_000

    @property
    def slots(self) -> int:
        return self.chunks * self.rows


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all shingles; a shorter text is one shingle, a text without words has none."""
    import xxhash

    tokens = ascii_words(text)
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))
    k = min(words, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = out * _STEP + h[i : len(h) - k + 1 + i]
    return np.unique(_mix(out))


def signature(shingles: np.ndarray, slots: int) -> bytes:
    """The lower 16 bits, after mixing, of each slot's minimum."""
    state = np.arange(1, 2 * slots + 1, dtype=np.uint64) * _STEP
    factor, shift = (_mix(state[:slots]) | np.uint64(1))[:, None], _mix(state[slots:])[:, None]
    least = np.full(slots, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 4096):
        np.minimum(least, (shingles[None, i : i + 4096] * factor + shift).min(axis=1), out=least)
    return (_mix(least) & np.uint64(0xFFFF)).astype("<u2").tobytes()


def signed(docs: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, n_shingles, h1 and h2 (hash of the whole set; null for an empty one), sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            n, h, sig = [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), plan.words)
                n.append(len(s))
                h.append(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8").tolist() if len(s) else (None, None))
                sig.append(signature(s, plan.slots) if len(s) else None)
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array([x[0] for x in h], pa.int64()), pa.array([x[1] for x in h], pa.int64()), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_shingles", "h1", "h2", "sig"])

    return doc_rows(docs).mapInArrow(run, _SIGNED)


def chunk_keys(reps: DataFrame, plan: Plan) -> DataFrame:
    """key, rep, n: every chunk of a signature with every choice of `errors` places left out."""
    kept = list(itertools.combinations(range(plan.rows), plan.rows - plan.errors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u2").reshape(len(batch), plan.chunks, plan.rows).astype(np.uint64)
            keys = np.empty((len(batch), plan.chunks, len(kept)), np.uint64)
            for j, places in enumerate(kept):
                h = np.arange(plan.chunks, dtype=np.uint64)[None, :] * np.uint64(len(kept)) + np.uint64(j)
                h = np.broadcast_to(h, keys.shape[:2])
                for p in places:
                    h = _mix(h * _STEP + sig[:, :, p])
                keys[:, :, j] = h
            each = keys.shape[1] * keys.shape[2]
            rep, n = (np.repeat(batch.column(i).to_numpy(), each) for i in (0, 1))
            for i in range(0, len(rep), 200_000):
                part = slice(i, i + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)[part].view(np.int64)), pa.array(rep[part]), pa.array(n[part])], ["key", "rep", "n"])

    return reps.select("rep", "n", "sig").mapInArrow(run, "key long, rep long, n long")


def _confirmed(pairs: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= plan.percent * (len(x) + len(y) - both))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])

    one, two = (sets.select(F.col("rep").alias(c), F.col("shingles").alias(f"{c}_set")) for c in "ab")
    both = pairs.select("a", "b").distinct().join(one, "a").join(two, "b")
    return both.select("a", "b", "a_set", "b_set").mapInArrow(run, "a long, b long")


def _full_sets(docs: DataFrame, wanted: DataFrame, plan: Plan) -> DataFrame:
    """rep, shingles (sorted little-endian hashes) of the wanted documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.slice(i, 512)
                sets = [shingle_set(t.as_py(), plan.words).tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["rep", "shingles"])

    rows = doc_rows(docs).join(wanted.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    return rows.select("doc_id", "text").mapInArrow(run, "rep long, shingles binary")


def _components_of(nodes: DataFrame, comps: DataFrame) -> DataFrame:
    return nodes.join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def _blocked(homes: DataFrame, plan: Plan) -> DataFrame:
    """rep, n, block: each home cut by hash into as many blocks as its members and their shingles call for."""
    parts = homes.groupBy("home").agg(F.ceil(F.greatest(F.count("*") / plan.block, F.sum("n") / plan.block_shingles)).alias("parts"))
    parts = stage_table(parts, "homes")
    return homes.join(parts, "home").select("rep", "n", F.xxhash64("home", F.pmod(F.xxhash64("rep"), "parts")).alias("block"))


def _block_pairs(members: DataFrame) -> DataFrame:
    """x <= y: the blocks outside a bucket's largest component with all blocks of the bucket."""
    sizes = members.groupBy("key", "component").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "component")).alias("top"), F.count("*").alias("comps"))
    open_buckets = stage_table(sizes.where("comps > 1").select("key", F.col("top.component").alias("major")), "buckets")
    rows = members.join(open_buckets, "key")
    small = stage_table(rows.where("component <> major").select("key", F.col("block").alias("a")).distinct(), "outside")
    every = stage_table(rows.select("key", F.col("block").alias("b")).distinct(), "inside")
    return small.join(every, "key").select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by matrix products over the values that both sides hold."""
    values = [np.concatenate(side) for side in (left, right)]
    common = np.intersect1d(*values)
    out = np.zeros((len(left), len(right)), np.float32)
    place = [np.searchsorted(common, v) for v in values]
    held = [(p < len(common)) & (common[np.minimum(p, max(0, len(common) - 1))] == v) if len(common) else np.zeros(len(v), bool) for p, v in zip(place, values)]
    rows = [np.repeat(np.arange(len(side)), [len(x) for x in side]) for side in (left, right)]
    place, rows = [p[h] for p, h in zip(place, held)], [r[h] for r, h in zip(rows, held)]
    order = [np.argsort(p, kind="stable") for p in place]
    place, rows = [p[o] for p, o in zip(place, order)], [r[o] for r, o in zip(rows, order)]
    for start in range(0, len(common), 4096):
        dense = []
        for p, r, side in zip(place, rows, (left, right)):
            a, b = np.searchsorted(p, (start, start + 4096))
            m = np.zeros((len(side), 4096), np.float32)
            m[r[a:b], p[a:b] - start] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out


def _forest(left: list[dict], right: list[dict], percent: int) -> list[tuple[int, int]]:
    """Links between different components, as few as join what they join."""
    sets = [[np.frombuffer(m["shingles"], np.uint64) for m in side] for side in (left, right)]
    sizes = [np.array([len(x) for x in side]) for side in sets]
    both = _shared(*sets)
    comps = [np.array([m["component"] for m in side]) for side in (left, right)]
    linked = (100 * both >= percent * (sizes[0][:, None] + sizes[1][None, :] - both)) & (comps[0][:, None] != comps[1][None, :])
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    out = []
    for i, j in zip(*np.nonzero(linked)):
        a, b = top(int(comps[0][i])), top(int(comps[1][j]))
        if a != b:
            root[a] = b
            out.append((left[i]["rep"], right[j]["rep"]))
    return out


def _tasks(pairs: DataFrame, placed: DataFrame, plan: Plan) -> DataFrame:
    """big, small, salt, chunk: pairs by the larger block, whose partners are taken together in chunks of about a block's size,
    so that a block with many small partners is not sent once for each. A salt holds the partners of about four chunks:
    blocks of any number of partners are cut into chunks by many tasks."""
    size = F.greatest(F.count("*") / plan.block, F.sum("n") / plan.block_shingles)
    sizes = stage_table(placed.groupBy("block").agg(size.alias("size")), "block-sizes")
    for c in "xy":
        pairs = pairs.join(sizes.withColumnsRenamed({"block": c, "size": f"{c}_size"}), c)
    swap = F.col("y_size") > F.col("x_size")
    turned = pairs.select(F.when(swap, F.col("y")).otherwise(F.col("x")).alias("big"), F.when(swap, F.col("x")).otherwise(F.col("y")).alias("small"), F.least("x_size", "y_size").alias("size"))
    salts = stage_table(turned.groupBy("big").agg(F.ceil(F.sum("size") / 4).alias("salts")), "salts")
    turned = turned.join(salts, "big").withColumn("salt", F.pmod(F.xxhash64("small"), "salts"))
    run = F.sum("size").over(Window.partitionBy("big", "salt").orderBy("small").rowsBetween(Window.unboundedPreceding, -1))
    return turned.select("big", "small", "salt", F.floor(F.coalesce(run, F.lit(0.0))).alias("chunk"))


def _block_links(tasks: DataFrame, contents: DataFrame, plan: Plan) -> DataFrame:
    """a, b: confirmed links between different components of the paired blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                left, right = (batch.column(c)[i].as_py() for c in (0, 1))
                found = _forest(left, right, plan.percent)
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    small = contents.select(F.col("block").alias("small"), "held")
    chunks = tasks.join(small, "small").groupBy("big", "salt", "chunk").agg(F.flatten(F.collect_list("held")).alias("others"))
    both = chunks.join(contents.withColumnRenamed("block", "big"), "big")
    return both.select("held", "others").mapInArrow(run, "a long, b long")


@contextmanager
def _arrow_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """While jobs run in this context, at most n rows go to a Python worker at once: for rows that hold whole sets or texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, n)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def near_duplicates(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Texts without words (null, empty) are linked with nothing. Equal texts are linked. Rows that share a doc_id are one
    document. Rows without a doc_id are counted but linked with nothing and kept. Very long texts are shingled whole. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    with _arrow_rows(spark, 1000):
        rows = stage_table(signed(docs, plan), "signed")
    known = rows.where("h1 is not null and doc_id is not null")
    groups = known.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    reps = stage_table(groups, "representatives")

    keys = stage_table(chunk_keys(reps, plan), "keys")
    centers = stage_table(keys.groupBy("key").agg(F.min("rep").alias("center"), F.count("*").alias("c")).where("c > 1").select("key", "center"), "centers")
    members = stage_table(keys.join(centers, "key"), "members")
    often = members.groupBy("rep", "n", "center").agg(F.count("*").alias("c"))
    homes = stage_table(often.groupBy("rep", "n").agg(F.max(F.struct("c", (-F.col("center")).alias("m"))).alias("top")).select("rep", "n", (-F.col("top.m")).alias("home")), "homes")

    with _arrow_rows(spark, 256):
        sets = stage_table(_full_sets(docs, homes.select("rep"), plan), "sets")
        links = stage_table(_confirmed(homes.where("rep <> home").select(F.col("rep").alias("a"), F.col("home").alias("b")), sets, plan), "links")
    comps = connected_components(links)

    placed = stage_table(_components_of(_blocked(homes, plan), comps), "placed")
    pairs = stage_table(_block_pairs(members.select("key", "rep").join(placed, "rep")), "pairs")
    wanted = pairs.select(F.col("x").alias("block")).unionByName(pairs.select(F.col("y").alias("block"))).distinct()
    held = sets.join(placed.join(wanted, "block", "left_semi"), "rep").groupBy("block")
    contents = stage_table(held.agg(F.collect_list(F.struct("rep", "component", "shingles")).alias("held")), "blocks")
    with _arrow_rows(spark, 4):
        more = stage_table(_block_links(_tasks(pairs, placed, plan), contents, plan), "links")
    comps = connected_components(links.unionByName(more))

    named = _components_of(reps.select("h1", "h2", "rep"), comps).select("h1", "h2", F.col("component").alias("_c"))
    out = rows.drop("sig").join(named, ["h1", "h2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_c", "doc_id")).alias("component_id")
    return out.select("doc_id", "n_shingles", component, F.coalesce(F.col("doc_id") == F.coalesce("_c", "doc_id"), F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """docs, same columns, with one row of each component: of the smallest doc_id, and in this of the least text.

    Rows that share a doc_id are rows of their own here: one is dropped only if its text is linked to a kept one. Rows
    without words or without a doc_id all stay.
    """
    named, unnamed = boxed(docs).where("doc_id is not null"), docs.where(F.col("doc_id").isNull())
    if named.groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = near_duplicates(docs, plan).where("kept and doc_id is not null").select("doc_id")
        return unboxed(named.join(kept, "doc_id", "left_semi"), docs.columns).unionByName(unnamed)
    named = stage_table(named.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(named.select(F.col("_at").alias("doc_id"), "text"), plan)
    found = named.join(found.select(F.col("doc_id").alias("_at"), "component_id"), "_at")
    kept = found.groupBy("component_id").agg(F.min(F.struct("doc_id", "text", "_at")).alias("_first")).select(F.col("_first._at").alias("_at"))
    return unboxed(named.join(kept, "_at", "left_semi"), docs.columns).unionByName(unnamed)


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates of all documents by shingles of four words; odd rows as there."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), Plan(words=4))


OP8_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 3))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
components AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, component_id = d.doc_id AS kept
FROM documents d JOIN components USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""
