"""Minimum-bin-slack packing of tokenized documents into fixed-length sequences.

Only the histogram of piece lengths (at most `capacity` numbers, whatever the corpus) reaches the driver. Minimum bin
slack runs over it: the longest length left opens a bin, a bitset subset-sum over the lengths still available finds the
fullest combination, and that combination is removed as often as its lengths last. The search is run for several amounts
of slack that a bin may keep, the best run is taken, and its part-filled bins are taken apart with some full ones and
solved again while sequences can be saved. The resulting patterns (a small table) are joined back to the pieces by each piece's rank within its length. Ranks come from salted groups, so a length
that a third of all pieces share is still ranked by many tasks.
"""

from __future__ import annotations

import math
import random
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rastra.llm.common import doc_rows, shuffle_width
from rastra.llm.tokens import VOCABULARY, cut, encoder, id_bytes
from rastra.storage import stage_table

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PATTERNS = "length long, rank_from long, rank_to long, first_sequence long, per_sequence long, first_offset long"


def token_pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (of little-endian uint32), and with with_ids the ids
    (little-endian, of id_bytes(vocabulary) bytes each).

    Null and empty texts are one piece that holds end_id alone; repeated rows are pieces of their own.
    """
    kind = f"<u{id_bytes(vocabulary)}"
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocabulary), np.array([end_id], "<u4")
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.concatenate([encode(text.as_py()), end])
                for k, (start, n) in enumerate(cut(len(ids), capacity)):
                    raw = ids[start : start + n].tobytes()
                    for column, value in zip(out, (doc, k, start, n, zlib.crc32(raw), ids[start : start + n].astype(kind).tobytes() if with_ids else None)):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    return doc_rows(docs).mapInArrow(run, PIECES + ", ids binary" * with_ids)


#: Places of a bin that may stay free, in the order in which they are tried.
ALLOWED_SLACK = (0, 1, 2, 4, 8, 12, 16, 24, 32)

Pattern = tuple[int, dict[int, int]]  # repeats, {length: how many in one bin}


def _bin_slack(counts: dict[int, int], capacity: int, order: Callable[[int], float], slack: int = 0) -> list[Pattern]:
    """Patterns that use up counts; at most one subset-sum run for each. Lengths are tried by falling order(length) until some
    sum leaves no more than `slack`; a length is used as late in that order as the fullest sum allows."""
    left = {length: n for length, n in counts.items() if n > 0}
    patterns = []
    while left:
        top = max(left)
        room = capacity - top
        mask, reach, layers = (1 << (room + 1)) - 1, 1, []
        for length in sorted((x for x in left if x <= room), key=order, reverse=True):
            n = min(left[length] - (length == top), room // length)
            layers.append((length, reach))
            step = 1
            while n > 0:  # n copies as 1, 2, 4, ... copies and a rest
                take = min(step, n)
                reach |= reach << take * length & mask
                n, step = n - take, step * 2
            if reach >> max(0, room - slack):
                break
        total, used = reach.bit_length() - 1, {top: 1}
        for length, before in reversed(layers):
            while not before >> total & 1:
                total -= length
                used[length] = used.get(length, 0) + 1
        repeats = min(left[x] // m for x, m in used.items())
        patterns.append((repeats, used))
        for x, m in used.items():
            left[x] -= repeats * m
            if not left[x]:
                del left[x]
    return patterns


def _filled(pattern: Pattern) -> int:
    return sum(x * m for x, m in pattern[1].items())


def _taken_apart(patterns: list[Pattern], bins: int) -> tuple[dict[int, int], list[Pattern], list[Pattern]]:
    """The pieces of the first `bins` bins of patterns, the patterns without these, and these."""
    counts: dict[int, int] = {}
    rest, taken = [], []
    for repeats, used in patterns:
        take = min(repeats, bins)
        bins -= take
        taken += [(take, used)] * (take > 0)
        for x, m in used.items() if take else ():
            counts[x] = counts.get(x, 0) + m * take
        if repeats > take:
            rest.append((repeats - take, used))
    return counts, rest, taken


def minimum_bin_slack(counts: dict[int, int], capacity: int, rounds: int = 300, bins: int = 48) -> list[Pattern]:
    """Patterns that use up counts. The allowed slack of a bin is tried from none upwards (a bin that may keep a few places free
    saves short pieces for bins that need them) and the best kept. Then up to `rounds` times some part-filled bins and some full ones (`bins` at most) are solved
    anew with the lengths tried in another order; a result is kept if it needs fewer bins, or as many of less even fill. It
    ends where the pieces' lengths allow no fewer bins. The draws are seeded, so equal counts give equal patterns."""
    draw = random.Random(1)
    least = max(-(-sum(x * n for x, n in counts.items()) // capacity), sum(n for x, n in counts.items() if 2 * x > capacity))
    patterns, number = [], math.inf
    for slack in ALLOWED_SLACK:
        found = _bin_slack(counts, capacity, lambda x: x, slack)
        if sum(n for n, _ in found) < number:
            patterns, number = found, sum(n for n, _ in found)
        if number <= least:
            break
    worth = lambda found: (-sum(n for n, _ in found), sum(n * _filled((n, u)) ** 2 for n, u in found))
    for _ in range(rounds):
        if number <= least:
            break
        short, full = [], []
        for p in patterns:
            (short if _filled(p) < capacity else full).append(p)
        draw.shuffle(short)
        draw.shuffle(full)
        a, rest, old = _taken_apart(short, draw.randint(1, bins // 2))
        b, kept, more = _taken_apart(full, draw.randint(1, bins // 2))
        pieces = {x: a.get(x, 0) + b.get(x, 0) for x in {**a, **b}}
        spread = draw.choice([0.05, 0.3, 1.0])
        weight = {x: draw.choice([1, 1, -1]) * x * (1 + spread * draw.uniform(-1, 1)) for x in pieces}
        found = _bin_slack(pieces, capacity, weight.__getitem__)
        if worth(found) >= worth(old + more):
            number += sum(n for n, _ in found) - sum(n for n, _ in old + more)
            patterns = found + rest + kept
    return patterns


def pattern_rows(patterns: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """PATTERNS rows: which ranks of a length go to which sequences and offsets."""
    rows, ranks, sequence = [], {}, 0
    for repeats, used in patterns:
        offset = 0
        for length, m in sorted(used.items(), reverse=True):
            rank = ranks.get(length, 0)
            ranks[length] = rank + m * repeats
            rows.append((length, rank, rank + m * repeats, sequence, m, offset))
            offset += m * length
        sequence += repeats
    return rows


Planner = Callable[[dict[int, int], int], list[tuple[int, int, int, int, int, int]]]


def slack_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    return pattern_rows(minimum_bin_slack(counts, capacity))


def pack_pieces(pieces: DataFrame, capacity: int = 1024, salts: int | None = None, planner: Planner = slack_plan) -> DataFrame:
    """Add sequence_id and offset (gapless from 0) to rows that have doc_id, piece and length <= capacity.

    planner makes PATTERNS rows of the histogram of lengths. An empty input gives an empty result. Equal rows get places of
    their own, rows without a doc_id too.
    """
    spread = [c for c in ("start", "ids_crc32") if c in pieces.columns]  # tell rows without a doc_id apart
    spark = pieces.sparkSession
    salts = salts or max(shuffle_width(spark), 16)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    plan = spark.createDataFrame(planner(counts, capacity), PATTERNS)

    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", *spread), F.lit(salts)).cast("int"))
    cells = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", *spread)
    ranked = (
        salted.withColumn("_row", F.row_number().over(within))
        .join(cells, ["length", "_salt"])
        .withColumn("_rank", F.col("_before") + F.col("_row") - 1)
    )
    # the plan's size depends on the capacity alone: at most a few thousand rows
    placed = ranked.join(F.broadcast(plan), "length").where("_rank >= rank_from and _rank < rank_to")
    at = F.col("_rank") - F.col("rank_from")
    return placed.select(
        *pieces.columns,
        (F.col("first_sequence") + F.floor(at / F.col("per_sequence"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + at % F.col("per_sequence") * F.col("length")).alias("offset"),
    )


def best_fit_pack(docs: DataFrame, capacity: int = 1024, end_id: int = 2, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """Tokenize whole documents, cut the overlong ones losslessly and pack the pieces by minimum bin slack.

    Null and empty texts are one piece that holds end_id alone; very long texts are cut into as many pieces as they need;
    repeated rows are packed as often as they stand; an empty table gives no rows; other columns of docs don't matter.
    """
    return pack_pieces(stage_table(token_pieces(docs, capacity, end_id, vocabulary, with_ids), "pieces"), capacity)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """best_fit_pack of all documents; null and empty texts are one end token, other odd rows as there."""
    return best_fit_pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
