"""Removal of byte spans that repeat in the corpus, by suffix arrays of blocks of equal content (two-stage sorting).

Which windows (200-byte strings) occur twice is decided by suffix arrays, one for each set of blocks that can share a window.
A window's anchor is the 64-byte string in it of least hash, so equal windows have equal anchors, and a text falls into blocks:
stretches of windows with one anchor. Anchors that occur once in the corpus are done with; the blocks of the others meet by
anchor, equal blocks as one with their number. There the suffixes at window starts are sorted in two stages: those smaller than
their successor directly, by their window; the rest are induced by one scan over the buckets of first bytes. A window is
repeated if it shares its whole length with a neighbour in that order, or stands in a block that occurs twice.

An anchor with more unlike blocks than one task should hold gives single windows, dealt by their hash: equal ones still meet.
Copies of a whole text are one text with its number from the start.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rastra.llm.common import shuffle_width
from rastra.storage import drop_staged, new_path, remove_path, stage_table, written

_KEY = ["k1", "k2"]
#: Bytes of texts that are hashed together; longer texts are cut into stretches that overlap by a window.
_CHUNK = 1 << 21
_PLACE = np.uint64((1 << 23) - 1)
#: Windows that one suffix array should hold, and unlike blocks of one anchor that are kept together.
_WINDOWS = 400_000
_BLOCKS = 20_000


def text_key(text: Column) -> list[Column]:
    """k1, k2: 96 bits of a text's SHA-256."""
    h = F.sha2(text, 256)
    low = F.conv(F.substring(h, 17, 8), 16, 10).cast("long") - (1 << 31)
    return [F.conv(F.substring(h, 1, 16), 16, -10).cast("long").alias("k1"), low.cast("int").alias("k2")]


def gram_hashes(x: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the `size` bytes from each place on: polynomial hashes, joined by doubling."""
    h = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    power, span, out, done = np.array([0xD6E8FEB86659FD93], np.uint64), 1, None, 0
    while True:
        if size & span:
            n = len(x) - done - span + 1
            out, done = (h.copy() if out is None else out[:n] * power + h[done : done + n]), done + span
        if done == size:
            break
        h = h[:-span] * power + h[span:]
        power, span = power * power, span * 2
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x9FB21C651E98DF25)
    return out ^ (out >> np.uint64(28))


def _least_of_each(v: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` consecutive values."""
    padded = np.full(-(-len(v) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(v)] = v
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: len(v) - width + 1], ahead[width - 1 : len(v)])


def blocks_of(buffer: np.ndarray, ends: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, anchor) of the blocks of texts that end at `ends` in buffer; each text is no shorter than a window."""
    hashes = gram_hashes(buffer, gram)
    place = np.arange(len(hashes), dtype=np.uint64)
    at = (_least_of_each((hashes & ~_PLACE) | place, window - gram + 1) & _PLACE).astype(np.int64)
    inside = np.ones(len(at), bool)
    for e in ends[:-1].tolist():
        inside[e - window + 1 : e] = False
    starts = np.flatnonzero(inside)
    at = at[starts]
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (at[1:] != at[:-1]) | (np.diff(starts) != 1)
    first = np.flatnonzero(fresh)
    return starts[first], np.diff(np.append(first, len(starts))), hashes[at[first]].view(np.int64)


def _stretches(texts: pa.Array, window: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (row, offset, bytes) of about _CHUNK bytes together."""
    out, size = [], 0
    for i, text in enumerate(texts):
        text = text.as_py()
        for offset in range(0, len(text) - window + 1, _CHUNK):
            part = text[offset : offset + _CHUNK + window - 1]
            out.append((i, offset, part))
            size += len(part)
            if size >= _CHUNK:
                yield out
                out, size = [], 0
    if out:
        yield out


def _text_blocks(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """k1, k2, copies, start, windows, anchor: the blocks of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, copies = (batch.column(c).to_numpy() for c in (0, 1, 2))
            for parts in _stretches(batch.column(3), window):
                row, offset = np.array([p[0] for p in parts]), np.array([p[1] for p in parts])
                ends = np.cumsum([len(p[2]) for p in parts])
                start, windows, anchor = blocks_of(np.frombuffer(b"".join(p[2] for p in parts), np.uint8), ends, window, gram)
                part = np.searchsorted(ends, start, side="right")
                own = start - np.concatenate([[0], ends[:-1]])[part] + offset[part]
                columns = [k1[row[part]], k2[row[part]], copies[row[part]], own, windows.astype(np.int32), anchor]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["k1", "k2", "copies", "start", "windows", "anchor"])

    return texts.where(F.length("bytes") >= window).select(*_KEY, "copies", "bytes").mapInArrow(run, "k1 long, k2 int, copies long, start long, windows int, anchor long")


def _cut(asked: DataFrame, window: int) -> DataFrame:
    """k1, k2, start, anchor, content, copies, block: with its bytes and their hash. asked: places, bytes and copies of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                text, places = batch.column(4)[i].as_py(), batch.column(3).slice(i, 1).flatten()
                start, windows = (places.field(c).to_numpy() for c in (0, 1))
                for at in range(0, len(start), 20_000):
                    s, n = start[at : at + 20_000], windows[at : at + 20_000]
                    blocks = [text[a : a + b + window - 1] for a, b in zip(s.tolist(), n.tolist())]
                    same = [pa.array([batch.column(c)[i].as_py()] * len(s), kind) for c, kind in ((0, pa.int64()), (1, pa.int32()), (2, pa.int64()))]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(s), places.field(2).slice(at, len(s)), pa.array(blocks, pa.binary())], ["k1", "k2", "copies", "start", "anchor", "block"])

    cut = asked.select(*_KEY, "copies", "places", "bytes").mapInArrow(run, "k1 long, k2 int, copies long, start long, anchor long, block binary")
    return cut.withColumn("content", F.xxhash64("block"))


def _smaller_than_next(x: np.ndarray) -> np.ndarray:
    """Whether the suffix at each place is smaller than the one after it; the last one is not."""
    rise = np.diff(x.astype(np.int16), append=-1)
    place = np.where(rise != 0, np.arange(len(x)), len(x) - 1)
    return rise[np.minimum.accumulate(place[::-1])[::-1]] > 0


def suffix_order(x: np.ndarray, asked: np.ndarray, depth: int) -> np.ndarray:
    """The places `asked` in the order of their suffixes' first `depth` bytes, in two stages. x must go on for depth bytes behind
    them, the last of them a rise (0, 1)."""
    small = _smaller_than_next(x)
    wanted = np.zeros(len(x), bool)
    more = asked
    while len(more):  # what is induced needs its successor, up to one that is sorted directly
        wanted[more] = True
        more = more[~small[more]] + 1
        more = more[~wanted[more]]
    direct = np.flatnonzero(wanted & small)
    windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(x, depth)[direct])
    direct = direct[np.argsort(windows.view(f"S{depth}").ravel(), kind="stable")]
    counts = np.bincount(x[wanted], minlength=256)
    first = np.cumsum(counts) - counts  # of each byte's bucket: the induced suffixes, then those sorted directly
    last, fill, order = first + counts, first.copy(), np.empty(int(counts.sum()), np.int64)
    by_byte = np.split(direct, np.searchsorted(x[direct], np.arange(1, 256)))

    def before(places: np.ndarray) -> np.ndarray:
        """The predecessors that are induced, in the order of the places."""
        places = places[places > 0] - 1
        return places[wanted[places] & ~small[places]]

    for c in np.flatnonzero(counts).tolist():
        more = order[first[c] : fill[c]]
        while len(more):  # within a bucket a scan meets what it has just put there
            more = before(more)
            more = more[x[more] == c]
            order[fill[c] : fill[c] + len(more)] = more
            fill[c] += len(more)
        order[fill[c] : last[c]] = by_byte[c]
        more = before(order[first[c] : last[c]])
        more = more[x[more] > c]
        byte = x[more]
        n = np.bincount(byte, minlength=256)
        order[np.arange(len(more)) + np.repeat(fill - (np.cumsum(n) - n), n)] = more[np.argsort(byte, kind="stable")]
        fill += n
    chosen = np.zeros(len(x), bool)
    chosen[asked] = True
    return order[chosen[order]]


def common_prefixes(x: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """How many bytes, depth at most, each suffix shares with the next one in the order."""
    a, b, out, alive = order[:-1], order[1:], np.zeros(max(0, len(order) - 1), np.int64), np.arange(max(0, len(order) - 1))
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(x, 8)).view("<u8").ravel()
    for k in range(0, depth, 8):
        odd = words[a[alive] + k] ^ words[b[alive] + k]
        differ = odd != 0
        lowest = odd[differ] & (~odd[differ] + np.uint64(1))  # its lowest bit lies in the first byte that differs
        out[alive[differ]] = k + (np.log2(lowest.astype(np.float64)).astype(np.int64) >> 3)
        alive = alive[~differ]
    out[alive] = depth
    return np.minimum(out, depth)


def repeated_windows(blocks: list[bytes], copies: np.ndarray, window: int) -> list[np.ndarray]:
    """For each block, whether each of its windows occurs again, in any block or in a copy of its own."""
    x = np.frombuffer(b"".join([*blocks, b"\0\1", b"\0" * (window + 16), b"\1"]), np.uint8)
    ends = np.cumsum([len(b) for b in blocks])
    windows = np.array([len(b) for b in blocks]) - window + 1
    first = ends - windows - window + 1
    asked = np.repeat(first - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    order = suffix_order(x, asked, window)
    same = common_prefixes(x, order, window) >= window
    again = np.zeros(len(x), bool)
    again[order[:-1][same]] = True
    again[order[1:][same]] = True
    return [again[a : a + n] | (c > 1) for a, n, c in zip(first.tolist(), windows.tolist(), copies.tolist())]


def _ranges(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edges[::2], edges[1::2]


def _dealt(blocks: DataFrame, window: int) -> DataFrame:
    """anchor, part, content, base, n, block: whole blocks, or the windows of an anchor with many (parts > 1), dealt by their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "content", "n", "block", "part", "base"]
        for batch in batches:
            parts = batch.column(4).to_numpy()
            whole = batch.filter(pa.array(parts == 1))
            zeros = [pa.array(np.zeros(len(whole), kind)) for kind in (np.int32, np.int64)]
            yield pa.RecordBatch.from_arrays([*whole.columns[:4], *zeros], names)
            for i in np.flatnonzero(parts > 1).tolist():
                text = batch.column(3)[i].as_py()
                cut = [text[a : a + window] for a in range(len(text) - window + 1)]
                same = [pa.array([batch.column(c)[i].as_py()] * len(cut), pa.int64()) for c in range(3)]
                part = np.array([zlib.crc32(w) % int(parts[i]) for w in cut], np.int32)
                yield pa.RecordBatch.from_arrays([*same, pa.array(cut, pa.binary()), pa.array(part), pa.array(np.arange(len(cut)))], names)

    return blocks.select("anchor", "content", "n", "block", "parts").mapInArrow(run, "anchor long, content long, n long, block binary, part int, base long")


def _repeats(dealt: DataFrame, window: int) -> DataFrame:
    """anchor, content, since, until: the ranges of repeated windows of each block. Sets of blocks stand together in a partition."""

    def done(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        again = repeated_windows(t["block"].to_pylist(), t["n"].to_numpy(), window)
        found = [_ranges(m) for m in again]
        at = np.repeat(np.arange(len(again)), [len(f[0]) for f in found])
        base = t["base"].to_numpy()[at]
        since, until = (np.concatenate([f[k] for f in found]).astype(np.int64) + base for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (t["anchor"].to_numpy()[at], t["content"].to_numpy()[at], since, until)], ["anchor", "content", "since", "until"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0  # whole sets, till they have enough windows
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in (0, 4)])
            windows = pc.binary_length(batch.column(3)).to_numpy() - window + 1
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            if rows and (key[:, 0] != [rows[-1].column(c)[-1].as_py() for c in (0, 4)]).any():
                cuts = np.concatenate([[0], cuts])
            at = 0
            total = np.concatenate([[0], np.cumsum(windows)])
            for c in cuts.tolist():
                if size + total[c] - total[at] >= _WINDOWS:
                    rows.append(batch.slice(at, c - at))
                    yield done(rows)
                    rows, size, at = [], 0, c
            rows.append(batch.slice(at))
            size += total[-1] - total[at]
        if rows:
            yield done(rows)

    return dealt.select("anchor", "content", "n", "block", "part", "base").mapInArrow(run, "anchor long, content long, since long, until long")


def _merged(spans: np.ndarray) -> list[tuple[int, int]]:
    """The maximal spans that overlapping and touching (start, end) make."""
    out: list[list[int]] = []
    for a, b in sorted(map(tuple, spans.tolist())):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _without(texts: DataFrame) -> DataFrame:
    """k1, k2, n_bytes, spans, kept. texts: k1, k2, bytes, found (spans that may overlap, or null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, kept, sizes = [], [], []
            for text, found in zip(batch.column(2), batch.column(3)):
                text, found = text.as_py(), found.as_py() or []
                cut = _merged(np.array([(f["a"], f["b"]) for f in found], np.int64).reshape(-1, 2))
                edges = [0, *(x for span in cut for x in span), len(text)]
                spans.append([{"start": a, "end": b} for a, b in cut])
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                sizes.append(len(text))
            columns = [*batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["k1", "k2", "n_bytes", "spans", "kept"])

    return texts.select(*_KEY, "bytes", "found").mapInArrow(run, "k1 long, k2 int, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


class TextTable:
    """The distinct texts, bucketed by their key so that joins read them in place: k1, k2, bytes, copies. drop() after use."""

    def __init__(self, docs: DataFrame, text_col: str):
        self.spark, self.name = docs.sparkSession, f"rastra_texts_{uuid.uuid4().hex}"
        self.path = new_path(self.spark, "texts")
        text = F.coalesce(F.col(text_col), F.lit(""))
        texts = docs.select(*text_key(text), text.cast("binary").alias("bytes")).groupBy(*_KEY).agg(F.first("bytes").alias("bytes"), F.count("*").alias("copies"))
        written(self.spark, lambda: texts.write.format("parquet").option("path", self.path).option("compression", "zstd").bucketBy(shuffle_width(self.spark), *_KEY).saveAsTable(self.name))

    @property
    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")
        remove_path(self.spark, self.path)


def repeated_spans(texts: TextTable, window: int = 200, gram: int = 64) -> DataFrame:
    """k1, k2, n_bytes, spans and kept of every distinct text: the maximal spans of bytes that windows of `window` bytes cover which
    start anywhere else too, and the other bytes. Reads `texts` and work tables until its rows are written."""
    all_blocks = stage_table(_text_blocks(texts.rows, window, gram), "blocks")
    again = stage_table(all_blocks.groupBy("anchor").agg(F.sum("copies").alias("n")).where("n > 1").select("anchor"), "again")
    some = all_blocks.join(again, "anchor").select(*_KEY, "start", "windows", "anchor")  # two tables: a hot anchor can be split
    places = some.groupBy(*_KEY).agg(F.collect_list(F.struct("start", "windows", "anchor")).alias("places"))
    blocks = stage_table(_cut(places.join(texts.rows, _KEY), window), "cut")
    drop_staged(all_blocks, again)

    unlike = blocks.select("anchor", "content").distinct().groupBy("anchor").agg(F.ceil(F.count("*") / _BLOCKS).cast("int").alias("parts")).where("parts > 1")
    sets = blocks.groupBy("anchor", "content").agg(F.first("block").alias("block"), F.sum("copies").alias("n"))
    sets = sets.join(stage_table(unlike, "hot"), "anchor", "left").fillna(1, ["parts"])
    dealt = _dealt(sets, window)
    dealt = dealt.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    found = stage_table(_repeats(dealt, window), "repeats")
    spans = blocks.select(*_KEY, "start", "anchor", "content").join(found, ["anchor", "content"])
    spans = spans.groupBy(*_KEY).agg(F.collect_list(F.struct((F.col("start") + F.col("since")).alias("a"), (F.col("start") + F.col("until") - 1 + window).alias("b"))).alias("found"))
    return _without(texts.rows.join(spans, _KEY, "left"))


def without_repeated_spans(docs: DataFrame, text_col: str = "text", window: int = 200, gram: int = 64) -> DataFrame:
    """row (all columns of docs), spans (start and end of each removed span, in bytes) and kept (the other bytes, which may begin or
    end inside a character).

    A span goes if windows of `window` bytes cover it that start anywhere else too: in another document, in a copy of this one (a
    repeated row is a copy) or further on in it; windows may overlap. Null and empty texts have no bytes; texts shorter than a
    window stay whole; very long ones are hashed in stretches. An empty table gives an empty one; columns may have any name.
    """
    texts = TextTable(docs, text_col)
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *text_key(F.coalesce(F.col(text_col), F.lit(""))))
    return rows.join(repeated_spans(texts, window, gram), _KEY).select("row", "spans", "kept")


def op13_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repeated_spans of all documents' texts, as digests; null, empty, long and repeated texts as without_repeated_spans has them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    texts = TextTable(docs, "text")
    found = repeated_spans(texts)
    removed = (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed")
    digests = stage_table(found.select(*_KEY, "n_bytes", removed, F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")), "digests")
    texts.drop()
    return docs.select("doc_id", *text_key(F.coalesce("text", F.lit("")))).join(digests, _KEY).drop(*_KEY)


#: Every window by itself, in hexadecimal digits; spans as islands of repeated windows.
OP13_SQL = """
WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT k, j, substr(h, 1000 * j + 1, 1398) AS h FROM (SELECT k, h, unnest(range(len(h) // 1000 + 1)) AS j FROM d)),
w AS (SELECT k, 500 * j + t AS i, md5(substr(h, 2 * t + 1, 400)) AS m FROM (SELECT k, j, h, unnest(range(len(h) // 2 - 199)) AS t FROM c WHERE len(h) >= 400)),
r AS (SELECT k, i FROM w WHERE m IN (SELECT m FROM w GROUP BY m HAVING count(*) > 1)),
f AS (SELECT k, i, CASE WHEN i <= lag(i) OVER (PARTITION BY k ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM r),
s AS (
  SELECT k, min(i) AS a, max(i) + 200 AS b
  FROM (SELECT k, i, sum(fresh) OVER (PARTITION BY k ORDER BY i) AS n FROM f) GROUP BY k, n),
p AS (
  SELECT d.k, coalesce(lag(s.b) OVER (PARTITION BY d.k ORDER BY s.a), 0) AS since, s.a AS until, h FROM d JOIN s USING (k)
  UNION ALL
  SELECT d.k, coalesce(max(s.b), 0), len(any_value(h)) // 2, any_value(h) FROM d LEFT JOIN s USING (k) GROUP BY d.k),
kept AS (SELECT k, string_agg(substr(h, 2 * since + 1, 2 * (until - since)), '' ORDER BY since) AS h FROM p GROUP BY k),
n AS (SELECT k, sum(b - a) AS removed, count(*) AS spans FROM s GROUP BY k)
SELECT doc_id, (len(d.h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(kept.h)) AS kept_sha256
FROM d JOIN kept USING (k) LEFT JOIN n USING (k)
"""
