"""Token ids packed into training sequences by best-fit decreasing, and written as binary columns.

Documents are tokenized where they are read. Best-fit decreasing runs over the histogram of all pieces' lengths, the only
thing that reaches the driver: a segment tree over the open sequences' capacities finds the fullest ones that still fit a
length, and as many pieces of that length are placed at once as they take. The plan (a small table) gives every piece its
sequence and offset by its rank within its length, and one shuffle brings a sequence's ids together. So the packing is that
of the whole corpus, and the same however the input is split.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastra.llm.packing import pack_pieces, token_pieces
from rastra.llm.tokens import VOCABULARY, id_bytes
from rastra.storage import stage_table

PACKED = ["n_tokens int", "input_ids binary", "cu_seqlens array<int>", "position_ids binary", "doc_ids array<bigint>", "starts array<bigint>"]


class CapacityTree:
    """Which free capacities open bins have, as a segment tree: O(log capacity) for a change and for a best fit. Bins of equal
    layout are one group: (number, first sequence, tokens in each)."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.groups: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _change(self, free: int, by: int) -> None:
        node = self.size + free
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, free: int, number: int, first: int) -> None:
        self.groups[free].append((number, first))
        self._change(free, 1)

    def best_fit(self, need: int) -> tuple[int, int, int] | None:
        """(free, number, first) of a group of least free capacity >= need, which is taken out; None if there is none."""
        node = self.size + need
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):  # up until a right sibling has bins
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        free = node - self.size
        self._change(free, -1)
        return free, *self.groups[free].pop()


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """PATTERNS rows. Pieces of one length fill a bin as long as they fit it, as they would one by one, since a bin that has
    just got one is the fullest that fits the next."""
    tree, rows, sequences = CapacityTree(capacity), [], 0
    for length in sorted((x for x, n in counts.items() if n > 0), reverse=True):
        placed, left = 0, counts[length]
        while left:
            fit = tree.best_fit(length)
            if fit is None:
                each = capacity // length
                fit = capacity, -(-left // each), sequences
                sequences += fit[1]
            free, number, first = fit
            each = free // length
            whole = min(number, left // each)
            for bins, m in ((whole, each), (int(whole < number and left > whole * each), left - whole * each)):
                if bins:
                    rows.append((length, placed, placed + bins * m, first, m, capacity - free))
                    if free > m * length:
                        tree.put(free - m * length, bins, first)
                    placed, left, number, first = placed + bins * m, left - bins * m, number - bins, first + bins
            if number:
                tree.put(free, number, first)
    return rows


def packed_sequences(docs: DataFrame, capacity: int = 1024, end_id: int = 50256, vocabulary: str = VOCABULARY) -> DataFrame:
    """Rows of at most capacity tokens: sequence_id and PACKED.

    input_ids are little-endian, of id_bytes(vocabulary) bytes each, and position_ids uint16, one row of the id matrix each
    (unpadded); position_ids restart at 0 with every segment, cu_seqlens has the segments' bounds from 0 to n_tokens, and
    doc_ids and starts tell where each segment comes from. Every document ends with end_id; overlong ones, however long, are
    cut without loss. Null and empty texts are one end_id; repeated rows are documents of their own; an empty table gives no
    rows; other columns of docs don't matter.
    """
    if capacity > 1 << 16:
        raise ValueError("position_ids are uint16: capacity is at most 65536")
    pieces = stage_table(_squeezed(token_pieces(docs, capacity, end_id, vocabulary, with_ids=True)), "pieces")
    placed = pack_pieces(pieces, capacity, planner=best_fit_decreasing)
    parts = F.collect_list(F.struct("offset", "length", "doc_id", "start", "ids"))  # at most `capacity` tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, 512) for whole in batches for i in range(0, len(whole), 512)):
            out: list[list] = [[] for _ in range(7)]
            for sequence, members in zip(batch.column(0).to_pylist(), batch.column(1)):
                members = sorted(members.as_py(), key=lambda m: m["offset"])
                bounds = np.cumsum([0, *(m["length"] for m in members)])
                row = (
                    sequence,
                    int(bounds[-1]),
                    b"".join(zlib.decompress(m["ids"]) for m in members),
                    bounds.tolist(),
                    np.concatenate([np.arange(m["length"], dtype="<u2") for m in members]).tobytes(),
                    [m["doc_id"] for m in members],
                    [m["start"] for m in members],
                )
                for column, value in zip(out, row):
                    column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["sequence_id", *(c.split()[0] for c in PACKED)])

    return placed.groupBy("sequence_id").agg(parts.alias("_p")).mapInArrow(run, ", ".join(["sequence_id long", *PACKED]))


def _squeezed(pieces: DataFrame) -> DataFrame:
    """pieces with their ids (the last column) compressed: they are written once and shuffled twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            small = [zlib.compress(x.as_buffer(), 1) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(small, pa.binary())], batch.schema.names)

    return pieces.mapInArrow(run, pieces.schema)


def id_matrix(sequences: DataFrame, capacity: int = 1024, pad_id: int = 50256, vocabulary: str = VOCABULARY) -> DataFrame:
    """sequences with input_ids and position_ids padded to `capacity` entries, so that rows stack to matrices; n_tokens and
    cu_seqlens tell the padding apart."""
    width = id_bytes(vocabulary)
    pad = F.unhex(F.lit(pad_id.to_bytes(width, "little").hex()))
    rows = {"input_ids": F.rpad("input_ids", capacity * width, pad), "position_ids": F.rpad("position_ids", capacity * 2, F.unhex(F.lit("0000")))}
    return sequences.withColumns(rows)


def write_packed(sequences: DataFrame, path: str) -> None:
    """One Parquet file for each task's sequences; fails if path exists."""
    sequences.write.mode("errorifexists").parquet(path)


def unpack(sequences: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, start, ids (binary): the segments of packed sequences; by start they join to the documents' ids again."""
    at = F.sequence(F.lit(0), F.size("doc_ids") - 1)
    width = id_bytes(vocabulary)
    segments = sequences.select("input_ids", "cu_seqlens", "doc_ids", "starts", F.explode(at).alias("i"))
    a, b = F.get("cu_seqlens", F.col("i")), F.get("cu_seqlens", F.col("i") + 1)
    return segments.select(F.get("doc_ids", "i").alias("doc_id"), F.get("starts", "i").alias("start"), F.substr("input_ids", a * width + 1, (b - a) * width).alias("ids"))


def op4_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences as rows of the id matrix: padded to 1024 entries, n_tokens of them real."""
    return id_matrix(packed_sequences(spark.read.parquet(f"{sf_dir}/documents.parquet")))
