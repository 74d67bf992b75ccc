"""Runs of repeated words (maximal repetitions) by Main and Lorentz's divide and conquer on interned word ids.

A text is halved again and again. Whether a repetition of period p crosses the midpoint of a node is told by four Z-functions:
each half against itself, read outwards from the midpoint, and each half against the other one. All nodes of a level, of all
texts of a batch, are done together: the Z-values of the shifts that still match grow word by word, and the nodes where a match
outlasts `_STEPS` words get theirs from the linear scan. A stretch that a neighbouring word extends is left to the node above
that sees all of it; one of period p is found for multiples of p too, with the same interval, of which the smallest stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

#: Words that matches grow by for all shifts at once, before a node's linear scan takes over.
_STEPS = 24
#: Words of the texts that are done together; a longer text is done alone.
_BATCH_WORDS = 150_000
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def z_values(s: list[int]) -> list[int]:
    """For each i, how many ids s[i:] and s share from their starts (at 0: all)."""
    n = len(s)
    z, left, right = [0] * n, 0, 0
    if n:
        z[0] = n
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


class _Nodes:
    """The nodes [lo, hi) of one level. The halves are read outwards: the right one from mid on, the left one from mid - 1 back."""

    def __init__(self, ids: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        self.ids, self.lo, self.hi, self.mid = ids, lo, hi, (lo + hi) // 2

    def half(self, n: int, right: bool) -> list[int]:
        return (self.ids[self.mid[n] : self.hi[n]] if right else self.ids[self.lo[n] : self.mid[n]][::-1]).tolist()

    def pairs(self, node: np.ndarray, p: np.ndarray, right: bool, across: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the compared stretches begin, and how long they can be: a half against itself p words further out, or (across)
        against the last p words before it, which lie in the other half."""
        m, lo, hi = self.mid[node], self.lo[node], self.hi[node]
        a = m if right else m - 1
        if across:
            return a, a - p if right else a + p, np.minimum(p, hi - m if right else m - lo)
        return a, a + p if right else a - p, (hi - m if right else m - lo) - p

    def z(self, node: np.ndarray, p: np.ndarray, right: bool, across: bool) -> np.ndarray:
        """The Z-values of one of the four functions for shifts p of nodes."""
        a, b, room = self.pairs(node, p, right, across)
        step, out, alive = 1 if right else -1, np.zeros(len(p), np.int64), np.arange(len(p))
        for k in range(_STEPS):
            alive = alive[room[alive] > k]
            alive = alive[self.ids[a[alive] + step * k] == self.ids[b[alive] + step * k]]
            out[alive] += 1
        alive = alive[room[alive] > _STEPS]
        alive = alive[np.argsort(node[alive], kind="stable")]
        for its in np.split(alive, np.flatnonzero(np.diff(node[alive])) + 1) if len(alive) else ():
            half, other = self.half(node[its[0]], right), self.half(node[its[0]], not right)
            if across:
                out[its] = np.array(z_values([*half, -1, *other[::-1]]))[len(half) + 1 + len(other) - p[its]]
            else:
                out[its] = np.array(z_values(half))[p[its]]
        return out

    def crossing(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(node, start, end, period) of repetitions with two periods and `least` words that cross a midpoint, inside its node."""
        found = []
        for right in (True, False):
            most = np.minimum((self.hi - self.lo) // 2, self.hi - self.mid if right else self.mid - self.lo)
            node = np.repeat(np.arange(len(self.lo)), most)
            p = np.arange(len(node)) - np.repeat(np.cumsum(most) - most, most) + 1
            some = np.zeros(len(p), bool)  # one of the two functions is not 0
            for side, across in ((right, False), (not right, True)):
                a, b, room = self.pairs(node, p, side, across)
                at = np.flatnonzero((room > 0) & ~some)
                some[at] = self.ids[a[at]] == self.ids[b[at]]
            node, p = node[some], p[some]
            out, back = self.z(node, p, right, False), self.z(node, p, not right, True)
            keep = np.flatnonzero((out + back >= p) & ((back < p) | right))
            node, p, out, back = node[keep], p[keep], out[keep], back[keep]
            whole = np.flatnonzero(back == p)  # a period fits on both sides: the other half goes on outwards
            back[whole] += self.z(node[whole], p[whole], not right, False)
            keep = np.flatnonzero(out + back + p >= least)
            node, p, out, back = node[keep], p[keep], out[keep], back[keep]
            m = self.mid[node]
            found.append((node, m - back, m + p + out, p) if right else (node, m - p - out, m + back, p))
        return tuple(np.concatenate(x) for x in zip(*found))


def batch_runs(ids: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs of texts that end at `ends` in ids, by text, start and period."""
    first = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    doc, lo, hi, found = np.arange(len(ends)), first, ends.astype(np.int64), []
    while True:
        wide = hi - lo >= max(least, 2)
        doc, lo, hi = doc[wide], lo[wide], hi[wide]
        if not len(doc):
            break
        nodes = _Nodes(ids, lo, hi)
        node, start, end, p = nodes.crossing(least)
        d = doc[node]
        left, right = start > first[d], end < ends[d]
        left[left] = ids[start[left] - 1] == ids[start[left] - 1 + p[left]]
        right[right] = ids[end[right]] == ids[end[right] - p[right]]
        keep = ~left & ~right
        found.append((d[keep], start[keep] - first[d[keep]], end[keep] - start[keep], p[keep]))
        doc, lo, hi = np.concatenate([doc, doc]), np.concatenate([lo, nodes.mid]), np.concatenate([nodes.mid, hi])
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    d, start, length, p = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((p, length, start, d))
    d, start, length, p = d[order], start[order], length[order], p[order]
    fresh = np.ones(len(d), bool)
    fresh[1:] = (np.diff(d) != 0) | (np.diff(start) != 0) | (np.diff(length) != 0)
    d, start, length, p = d[fresh], start[fresh], length[fresh], p[fresh]
    order = np.lexsort((p, start, d))
    return d[order], start[order], length[order], p[order]


def _texts_done(texts: list[list[bytes]], least: int) -> tuple[list[list[dict]], list[bytes]]:
    """The runs of each text, and each text less the words that repeat a run's first period."""
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for words in texts for w in words], np.int64)
    ends = np.cumsum([len(words) for words in texts])
    doc, start, length, period = batch_runs(ids, ends, least)
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    runs, kept = [], []
    for i, words in enumerate(texts):
        at = slice(bounds[i], bounds[i + 1])
        s, n, p = start[at], length[at], period[at]
        runs.append([{"start": a, "length": b, "period": c} for a, b, c in zip(s.tolist(), n.tolist(), p.tolist())])
        if len(s):
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, s + p, 1)
            np.add.at(change, s + n, -1)
            words = [words[j] for j in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
        kept.append(b" ".join(words))
    return runs, kept


def find_periodic_runs(docs: DataFrame, text_col: str = "text", least: int = 12) -> DataFrame:
    """row (all columns of docs but the text), n_words, runs (start, length, period of each, in words from 0) and collapsed: the
    text's words joined by one space, less those that any run holds after its first period.

    A run is a stretch of words of smallest period q and at least max(least, 2q) words that no neighbouring word extends. Null
    and empty texts have no words and no runs; their collapsed text is empty. Repeated rows are done alike; an empty table gives
    an empty one; columns of any name pass through inside row. A long text is done alone, in memory that grows with its words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at, size = [], 0, 0
            for i, text in enumerate(batch.column(1)):
                words = (text.as_py() or b"").split()  # bytes split at ASCII white space only, which is the rule here
                if texts and size + len(words) > _BATCH_WORDS:
                    yield done(batch.column(0).slice(at, len(texts)), texts)
                    texts, at, size = [], i, 0
                texts.append(words)
                size += len(words)
            if texts:
                yield done(batch.column(0).slice(at, len(texts)), texts)

    def done(rows: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
        runs, kept = _texts_done(texts, least)
        columns = [rows, pa.array([len(t) for t in texts], pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(kept, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["row", "n_words", "runs", "collapsed"])

    rest = [docs[f"`{c}`"] for c in docs.columns if c != text_col]
    boxed = docs.select(F.struct(*rest or [F.lit(0).alias("_")]).alias("row"), F.col(text_col).cast("binary").alias("text"))
    each = StructType().add("start", "long").add("length", "long").add("period", "long")
    kind = StructType().add("row", boxed.schema["row"].dataType).add("n_words", "long").add("runs", ArrayType(each)).add("collapsed", "string")
    return boxed.mapInArrow(run, kind)


def with_planted_period(docs: DataFrame) -> DataFrame:
    """doc_id, text: the contract's texts. Where crc32(doc_id as text) is divisible by 10, the words from a on repeat with period
    p. A text without an id or a word stays; so do empty and null ones."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    docs = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w"))
    n = F.size("w").cast("long")
    docs = docs.withColumn("n", n).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    docs = docs.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    a, p = F.col("a"), F.col("p")
    changed = F.transform("w", lambda w, i: F.when(i < a, w).otherwise(F.get("w", (a + (i - a) % p).cast("int"))))
    return docs.select("doc_id", F.when(a.isNotNull(), F.array_join(changed, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """find_periodic_runs on the contract's texts of all documents, as digests; null, empty and repeated rows as there."""
    found = find_periodic_runs(with_planted_period(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    best = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("k"), r["start"].alias("s"), r["period"].alias("p")))), F.lit(0))
    found = found.select(F.col("row.doc_id").alias("doc_id"), "runs", "collapsed", best.alias("b"))
    text = F.concat_ws("", F.transform(F.col("runs"), lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("b.s").alias("start"), (-F.col("b.k")).alias("length"), F.col("b.p").alias("period"),
        F.floor(1000 * -F.col("b.k") / F.col("b.p")).alias("exponent_milli"), F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


_CRC32 = """xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

#: Equal words i < i + p of a document; stretches of them for one p; the smallest p of an interval.
OP12_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, [w FOR w IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF w <> ''] AS w, {_CRC32} AS h
  FROM documents),
e AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) ELSE len(w) END AS a FROM d),
x AS (
  SELECT k, doc_id, n, [CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END FOR i IN range(n)] AS w FROM e),
t AS (SELECT k, unnest(w) AS word, unnest(range(n)) AS i FROM x),
m AS (
  SELECT a.k, b.i - a.i AS p, a.i AS i, a.i - row_number() OVER (PARTITION BY a.k, b.i - a.i ORDER BY a.i) AS island
  FROM t a JOIN t b ON a.k = b.k AND a.word = b.word AND a.i < b.i),
r AS (SELECT k, p, min(i) AS s, count(*) + p AS len FROM m GROUP BY k, p, island HAVING count(*) >= p AND count(*) + p >= 12),
u AS (SELECT k, s, len, min(p) AS p FROM r GROUP BY k, s, len),
best AS (SELECT k, s, len, p FROM u QUALIFY row_number() OVER (PARTITION BY k ORDER BY len DESC, s, p) = 1),
agg AS (SELECT k, count(*) AS c, string_agg(s || ',' || len || ',' || p || chr(10), '' ORDER BY s, p) AS runs FROM u GROUP BY k),
dropped AS (SELECT DISTINCT k, unnest(range(s + p, s + len)) AS i FROM u),
kept AS (
  SELECT t.k, string_agg(t.word, ' ' ORDER BY t.i) AS text FROM t LEFT JOIN dropped USING (k, i) WHERE dropped.i IS NULL GROUP BY t.k)
SELECT x.doc_id, coalesce(agg.c, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.len::BIGINT AS length, best.p::BIGINT AS period,
  (1000 * best.len // best.p)::BIGINT AS exponent_milli, sha256(coalesce(agg.runs, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM x LEFT JOIN agg USING (k) LEFT JOIN best USING (k) LEFT JOIN kept USING (k)
"""
