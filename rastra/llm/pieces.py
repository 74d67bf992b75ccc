"""Sampled SentencePiece segmentations by forward filtering and backward sampling; decoding is lossless.

A text is cut into units: a line feed, or a run of spaces, if any, and the run of other characters after it. No piece has a
space after another character, or a line feed and more, so no piece crosses a cut. A unit's lattice has a node at every
character bound and an edge for every vocabulary piece that spells the characters between two nodes, of weight
(rank + 1) ** -sharpness, where rank is the piece's place in the vocabulary; characters without a piece of their own have
one edge, their UTF-8 bytes. The forward filter sums the weights of all paths to each node. Sampling goes back from a
unit's end, taking each incoming edge with its share of the node's sum, which draws a segmentation with exactly its
probability. The random number for a choice is a hash of (seed, row key, place in the text), so a row's result depends
neither on partitions nor on retries. Everything is computed for the distinct units of a batch at once.
"""

from __future__ import annotations

import functools
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastra.llm.common import doc_rows
from rastra.llm.tokens import vocabulary_path

PIECE_MODEL = "piece_bpe_32k.model"
_UNIT = re.compile(r"\n| *[^ \n]+| +")
_CROSSING = re.compile(r"[^▁]▁|\n.|.\n", re.DOTALL)
_SPACE, _MARK, _PLAIN_MARK = 0x20, 0x2581, 0x110000  # a literal mark is no space: it goes to bytes
_STEP = np.uint64(0x9E3779B97F4A7C15)
_WIDE = 1 << 20  # an edge's id from here on: a character of several bytes


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Pieces:
    """The vocabulary as a hash table of all prefixes of its pieces."""

    def __init__(self, model: str, sharpness: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(model))
        self.spelled = [b""] * len(sp)
        self.byte_id = [0] * 256
        ids: dict[str, int] = {}
        for i in range(len(sp)):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.spelled[i] = bytes([int(piece[3:5], 16)])
                self.byte_id[self.spelled[i][0]] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                if _CROSSING.search(piece):
                    raise ValueError(f"piece {piece!r} crosses the bounds of units")
                self.spelled[i] = piece.replace("▁", " ").encode()
                ids[piece] = i
        self.log_weight = -sharpness * np.log(np.arange(len(sp)) + 1.0)
        self.fallback = float(self.log_weight.min())
        prefixes: list[dict[int, int]] = []
        for piece, i in ids.items():
            h = np.uint64(0)
            for n, c in enumerate(piece):
                h = _mix(np.atleast_1d(h) * _STEP + np.uint64(ord(c)))[0]
                if n == len(prefixes):
                    prefixes.append({})
                known = prefixes[n].get(int(h), -1)
                prefixes[n][int(h)] = i if n == len(piece) - 1 else known
        self.longest = len(prefixes)
        self._hash_table({h: i for table in prefixes for h, i in table.items()})

    def _hash_table(self, entries: dict[int, int]) -> None:
        """Open addressing with linear probing in arrays: slot -> (hash, piece id, or -1 for a mere prefix)."""
        self.mask = np.uint64((1 << (4 * len(entries)).bit_length()) - 1)
        self.keys = np.zeros(int(self.mask) + 1, np.uint64)
        self.named = np.full(int(self.mask) + 1, -2, np.int32)  # -2: free
        self.probes = 1
        for h, i in entries.items():
            slot, step = h & int(self.mask), 1
            while self.named[slot] != -2:
                slot, step = (slot + 1) & int(self.mask), step + 1
            self.keys[slot], self.named[slot] = h, i
            self.probes = max(self.probes, step)

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """For each hash its piece id, -1 for a prefix that is no piece, -2 for none."""
        slot = (h & self.mask).astype(np.int64)
        out = self.named[slot]
        wrong = np.flatnonzero((out != -2) & (self.keys[slot] != h))
        slot = slot[wrong]
        for _ in range(self.probes):
            if not len(wrong):
                break
            slot = slot + 1 & int(self.mask)
            found = self.named[slot]
            out[wrong] = found
            again = (found != -2) & (self.keys[slot] != h[wrong])
            wrong, slot = wrong[again], slot[again]
        out[wrong] = -2
        return out

    def edges(self, codes: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, id) of all edges over codes; room: how many characters of its unit are left at each place."""
        at, h = np.arange(len(codes), dtype=np.int32), np.zeros(len(codes), np.uint64)
        starts, lengths, ids = [], [], []
        single = np.zeros(len(codes), bool)
        for n in range(1, self.longest + 1):
            open_ = room[at] >= n
            at, h = at[open_], h[open_]
            h = _mix(h * _STEP + codes[at + n - 1].astype(np.uint64))
            found = self.look_up(h)
            hit = found != -2
            at, h, found = at[hit], h[hit], found[hit]
            whole = found >= 0
            starts.append(at[whole])
            lengths.append(np.full(whole.sum(), n, np.int32))
            ids.append(found[whole])
            if n == 1:
                single[at[whole]] = True
            if not len(at):
                break
        rest = np.flatnonzero(~single).astype(np.int32)
        plain = codes[rest]
        low = np.array(self.byte_id, np.int32)[np.minimum(plain, 127)]
        starts.append(rest)
        lengths.append(np.ones(len(rest), np.int32))
        ids.append(np.where(plain < 128, low, _WIDE + plain.astype(np.int32)))
        return np.concatenate(starts), np.concatenate(lengths), np.concatenate(ids)


@functools.lru_cache(4)
def pieces_of(model: str, sharpness: float) -> Pieces:
    return Pieces(model, sharpness)


class _Lattice:
    """The filtered lattices of distinct units, as arrays over all nodes and edges."""

    def __init__(self, pieces: Pieces, units: list[str]):
        lengths = np.fromiter(map(len, units), np.int32, len(units))
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4").copy()
        codes[codes == _MARK] = _PLAIN_MARK
        codes[codes == _SPACE] = _MARK
        first = np.cumsum(lengths, dtype=np.int32) - lengths
        unit = np.repeat(np.arange(len(units), dtype=np.int32), lengths)
        local = np.arange(len(codes), dtype=np.int32) - first[unit]
        start, length, self_ids = pieces.edges(codes, lengths[unit] - local)
        source = start + unit[start]  # a unit of n characters has n + 1 nodes
        target = source + length
        weight = np.where(self_ids >= _WIDE, pieces.fallback, pieces.log_weight[np.minimum(self_ids, len(pieces.log_weight) - 1)])
        depth = local[start] + length
        order = np.argsort(target, kind="stable")  # sixteen sorted runs
        small = depth.astype(np.uint16) if depth.max(initial=0) < 1 << 16 else depth  # 16 bits sort by radix
        order = order[np.argsort(small[order], kind="stable")]
        source, target, weight, ids, depth = (x[order] for x in (source, target, weight, self_ids, depth))
        self.first_node = first + np.arange(len(units), dtype=np.int32)
        self.last_node = self.first_node + lengths
        total = np.zeros(len(codes) + len(units))
        group = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
        level = np.searchsorted(depth[group], np.arange(1, depth[-1] + 2))
        bounds = np.r_[group, len(target)]
        share = np.empty(len(target))
        for k in range(len(level) - 1):  # nodes at the same distance from their units' starts at once
            g = group[level[k] : level[k + 1]]
            if not len(g):
                continue
            a, b = g[0], bounds[level[k + 1]]
            path = total[source[a:b]] + weight[a:b]
            top = np.maximum.reduceat(path, g - a)
            each = np.diff(np.r_[g, b])
            rest = np.exp(path - np.repeat(top, each))
            mass = np.add.reduceat(rest, g - a)
            total[target[g]] = top + np.log(mass)
            share[a:b] = rest / np.repeat(mass, each)
        self.source, self.ids = source, ids
        self.upto = np.cumsum(share)
        self.low, self.high = np.zeros(len(total), np.int32), np.zeros(len(total), np.int32)
        self.low[target[group]], self.high[target[group]] = group, bounds[1:] - 1
        self.base = np.r_[0.0, self.upto][self.low]

    def sample(self, which: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of one drawn path for each of which (units), and how many each has; keys: uint64 for each."""
        node, end = self.last_node[which], self.first_node[which]
        live = np.argsort(which, kind="stable")  # equal units together: the lookups below stay in the cache
        taken, count = [], np.zeros(len(which), np.int64)
        while len(live):
            at = node[live]
            u = (_mix(keys[live] + (at - end[live]).astype(np.uint64) * _STEP) >> np.uint64(11)) * 2.0**-53
            edge = np.clip(np.searchsorted(self.upto, self.base[at] + u, side="right"), self.low[at], self.high[at])
            taken.append((live, self.ids[edge]))
            count[live] += 1
            node[live] = self.source[edge]
            live = live[node[live] > end[live]]
        after = np.cumsum(count)
        out = np.empty(after[-1] if len(after) else 0, np.int64)
        for k, (live, ids) in enumerate(taken):
            out[after[live] - 1 - k] = ids
        return out, count


def _bytes_for_wide(pieces: Pieces, ids: np.ndarray) -> np.ndarray:
    """ids with every wide character as the ids of its UTF-8 bytes."""
    wide = np.flatnonzero(ids >= _WIDE)
    if not len(wide):
        return ids
    char = lambda code: "▁" if code == _PLAIN_MARK else chr(code)
    spelled = [[pieces.byte_id[b] for b in char(int(ids[i]) - _WIDE).encode("utf-8", "surrogatepass")] for i in wide]
    each = np.ones(len(ids), np.int64)
    each[wide] = [len(s) for s in spelled]
    out = np.repeat(ids, each)
    after = np.cumsum(each)
    for i, s in zip(wide, spelled):
        out[after[i] - len(s) : after[i]] = s
    return out


def sample_batch(pieces: Pieces, texts: list[str], row_keys: list[int | None], seed: int) -> list[np.ndarray]:
    """uint16 piece ids of one sampled segmentation for each text."""
    index: defaultdict[str, int] = defaultdict()
    index.default_factory = index.__len__  # a new unit gets the next number
    place = [np.fromiter(map(index.__getitem__, units), np.int64, len(units)) for units in map(_UNIT.findall, texts)]
    if not index:
        return [np.empty(0, "<u2") for _ in texts]
    sizes = np.fromiter(map(len, place), np.int64, len(place))
    which = np.concatenate(place)
    rows = np.array([(k if k is not None else -1) & (2**64 - 1) for k in row_keys], np.uint64)
    rows = _mix(_mix(rows + np.uint64(seed) * _STEP))
    ordinal = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    ids, count = _Lattice(pieces, list(index)).sample(which, _mix(np.repeat(rows, sizes) + ordinal.astype(np.uint64)))
    bounds = np.r_[0, np.cumsum(count)][np.r_[0, np.cumsum(sizes)]]
    if len(pieces.spelled) > 1 << 16:
        raise ValueError("ids are uint16: a model has at most 65536 pieces")
    return [_bytes_for_wide(pieces, ids[a:b]).astype("<u2") for a, b in zip(bounds[:-1], bounds[1:])]


def decode_ids(pieces: Pieces, ids: np.ndarray) -> str:
    return b"".join(map(pieces.spelled.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")


def _chunks(texts: list[str], limit: int) -> Iterator[slice]:
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= limit:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def encode_sampled(docs: DataFrame, seed: int = 1, sharpness: float = 0.5, model: str = PIECE_MODEL, chunk_chars: int = 4_000_000, with_text: bool = False) -> DataFrame:
    """doc_id, n_pieces, ids (little-endian uint16), one sampled segmentation for each row, reproducible by (seed, doc_id);
    with with_text also what these ids decode to.

    Null and empty texts have no pieces. Rows with the same doc_id and text have the same segmentation; rows without a
    doc_id are seeded alike. Very long texts are read whole. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model, sharpness)
        for batch in batches:
            keys, texts = (batch.column(i).to_pylist() for i in (0, 1))
            for part in _chunks(texts, chunk_chars):
                ids = sample_batch(pieces, texts[part], keys[part], seed)
                cols = [pa.array(keys[part], pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]
                if with_text:
                    cols.append(pa.array([decode_ids(pieces, x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names)

    names = ["doc_id", "n_pieces", "ids"] + ["text"] * with_text
    return doc_rows(docs).mapInArrow(run, "doc_id long, n_pieces long, ids binary" + ", text string" * with_text)


def decode(encoded: DataFrame, ids_col: str = "ids", model: str = PIECE_MODEL) -> DataFrame:
    """encoded with text: what the pieces spell."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + ", text string"
    at = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model, 1.0)
        for batch in batches:
            for i in range(0, len(batch), 1000):
                part = batch.slice(i, 1000)
                texts = [decode_ids(pieces, np.frombuffer(x.as_buffer(), "<u2")) for x in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    return encoded.mapInArrow(run, schema)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's sampled ids, and the hash of what they decode to: that of the document's text."""
    out = encode_sampled(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=True)
    return out.select("doc_id", "n_pieces", "ids", F.sha2("text", 256).alias("decoded_sha256"))
