"""A hidden Markov language model: Baum-Welch counts summed across partitions, exact scores by the scaled forward recursion.

Words emit through classes. A word that makes up at least 1/4096 of the training tokens (so at most 4096 words) is a class
of its own; the others share `tail` classes by hash. P(word | state) = P(class | state) * P(word | class), where the second
factor does not depend on the state: the score of a text is the model's log probability of its class sequence plus a sum
over its words. So the model has a fixed size whatever the vocabulary, and the whole vocabulary's counts, which grow with
the corpus, are only joined: words of at least 1/524288 of the tokens (at most 524288) are looked up in a broadcast table
and the rare rest, none of which is frequent enough to skew a shuffle, meets the count table in a join.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rastra.llm.common import ascii_words, doc_rows
from rastra.storage import stage_table

END = b"\n"  # no word holds a line feed
SMOOTH = 0.1


@dataclass(frozen=True)
class Settings:
    states: int = 8
    rounds: int = 4
    gain: float = 1e-3  # of log likelihood a token, below which the rounds end
    own_share: int = 4096
    lookup_share: int = 1 << 19
    tail: int = 256
    group_tokens: int = 600_000
    seed: int = 7


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary), c: over all texts of docs, with one END for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[bytes] = Counter()
            for text in batch.column(1):
                counts.update(ascii_words(text.as_py()))
            counts[END] += len(batch)
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    return docs.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class Vocabulary:
    counts: DataFrame
    total: int
    distinct: int
    lookup: dict[bytes, tuple[int, float]]  # word -> (class or -1, log10(c + 0.1))
    own: int
    class_counts: np.ndarray  # training tokens of each class
    tail_terms: np.ndarray  # log10 of each class's smoothed total; 0 for words of their own

    @property
    def classes(self) -> int:
        return len(self.class_counts)


def vocabulary(counts: DataFrame, s: Settings) -> Vocabulary:
    counts = stage_table(counts, "word-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # at most lookup_share words can have this share of the tokens
    frequent = counts.where(F.col("c") * s.lookup_share >= total).toPandas() if total else None
    rows = [] if frequent is None else sorted(zip(frequent["c"], map(bytes, frequent["word"])), key=lambda r: (-r[0], r[1]))
    own = [(int(c), w) for c, w in rows if c * s.own_share >= total]
    names = {w: i for i, (_, w) in enumerate(own)}
    lookup = {w: (names.get(w, -1), math.log10(c + SMOOTH)) for c, w in rows}
    rare = counts.where(F.col("c") * s.own_share < total).groupBy(F.pmod(F.xxhash64("word"), F.lit(s.tail)).alias("t")).agg(F.sum("c").alias("c"), F.count("*").alias("v"))
    size, kinds = np.zeros(s.tail), np.zeros(s.tail)
    for t, c, v in rare.collect():  # at most `tail` rows
        size[t], kinds[t] = c, v
    terms = np.concatenate([np.zeros(len(own)), np.log10(size + SMOOTH * (kinds + 1))])
    return Vocabulary(counts, total, distinct, lookup, len(own), np.concatenate([[c for c, _ in own], size]), terms)


_CODED = "doc_id long, held_out boolean, n_tokens long, n_known long, words double, tail_words double, classes binary, rare array<struct<word:binary,n:long>>"


def coded(docs: DataFrame, vocab: Vocabulary, s: Settings) -> DataFrame:
    """A row for each document: its class sequence (uint16), sums over the words that the lookup has, and the other words."""
    lookup = docs.sparkSession.sparkContext.broadcast(vocab.lookup)
    own, tail, names = vocab.own, s.tail, [f.split()[0] for f in _CODED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        table = lookup.value
        for batch in (whole.slice(i, 2000) for whole in batches for i in range(0, len(whole), 2000)):
            number: defaultdict[bytes, int] = defaultdict()
            number.default_factory = number.__len__  # a new word gets the next number
            tokens = [[*ascii_words(t.as_py()), END] for t in batch.column(2)]
            sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
            if not len(sizes):
                continue
            ids = np.concatenate([np.fromiter(map(number.__getitem__, t), np.int64, len(t)) for t in tokens])
            del tokens
            words = list(number)
            found = [table.get(w) for w in words]
            rare = np.fromiter((f is None for f in found), bool, len(found))
            log_c = np.fromiter((0.0 if f is None else f[1] for f in found), float, len(found))
            classes = np.fromiter((f[0] if f and f[0] >= 0 else own + xxhash.xxh64_intdigest(w, 42) % tail for f, w in zip(found, words)), "<u2", len(found))
            first = np.cumsum(sizes) - sizes
            row = np.repeat(np.arange(len(sizes)), sizes)
            each, logs, is_rare = classes[ids], log_c[ids], rare[ids]
            pairs, times = np.unique(row[is_rare] * len(words) + ids[is_rare], return_counts=True)
            lists = np.r_[0, np.cumsum(np.bincount(pairs // len(words), minlength=len(sizes)))].astype(np.int32)
            pair = pa.StructArray.from_arrays([pa.array(words, pa.binary()).take(pa.array(pairs % len(words))), pa.array(times, pa.int64())], ["word", "n"])
            cols = [
                batch.column(0),
                batch.column(1),
                pa.array(sizes),
                pa.array(np.add.reduceat((~is_rare).astype(np.int64), first)),
                pa.array(np.add.reduceat(logs, first)),
                pa.array(np.add.reduceat(np.where(each >= own, logs, 0.0), first)),
                pa.array([each[i : i + n].tobytes() for i, n in zip(first, sizes)], pa.binary()),
                pa.ListArray.from_arrays(pa.array(lists), pair),
            ]
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, _CODED)


@dataclass
class Model:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # classes x states

    @classmethod
    def first(cls, vocab: Vocabulary, s: Settings) -> Model:
        """Uneven emissions and states that tend to stay: from a nearly even start the first rounds gain next to nothing."""
        rng = np.random.default_rng(s.seed)
        emit = cls.unigram(vocab)[:, None] * (rng.gamma(1.0, 1.0, (vocab.classes, s.states)) + 0.05)
        move = rng.uniform(0.5, 1.5, (s.states, s.states)) + np.eye(s.states) * s.states * 20
        return cls(np.full(s.states, 1 / s.states), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    @staticmethod
    def unigram(vocab: Vocabulary) -> np.ndarray:
        return (vocab.class_counts + SMOOTH) / (vocab.class_counts + SMOOTH).sum()


def _groups(sequences: list[np.ndarray], limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(indices, lengths, padded classes) of sequences of like length, longest first, about `limit` tokens each."""
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    at = 0
    while at < len(order):
        n = max(1, limit // len(sequences[order[at]]))
        group = order[at : at + n]
        at += n
        lengths = np.array([len(sequences[i]) for i in group])
        padded = np.zeros((lengths[0], len(group)), np.intp)
        for j, i in enumerate(group):
            padded[: lengths[j], j] = sequences[i]
        yield np.array(group), lengths, padded


def _forward(m: Model, lengths: np.ndarray, obs: np.ndarray, every: int = 0) -> tuple[np.ndarray, list, np.ndarray]:
    """Log likelihoods, and with `every` the scaled forward rows that enter steps 0, every, 2 * every ... (None for the first).
    Sequences stand longest first."""
    active = np.searchsorted(-lengths, -np.arange(len(obs)), side="left")  # sequences longer than t
    total, kept = np.zeros(len(lengths)), []
    a = None
    for t in range(len(obs)):
        if every and t % every == 0:
            kept.append(a)
        a, c = _step(m, a, obs[t, : active[t]])
        total[: active[t]] += np.log(c)
    return total, kept, active


def _step(m: Model, a: np.ndarray | None, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The scaled forward rows after `seen`, and the scales."""
    a = (m.start if a is None else a[: len(seen)] @ m.move) * m.emit[seen]
    c = a.sum(1)
    return a / c[:, None], c


def _expected(m: Model, lengths: np.ndarray, obs: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> float:
    """Add a group's expected counts (Baum-Welch) to start, move and emit; returns its log likelihood.

    The forward rows are kept at every sqrt(n)-th step and made again block by block on the way back, so that a text of any
    length needs memory for about two blocks.
    """
    every = max(64, math.isqrt(len(obs)))
    total, kept, active = _forward(m, lengths, obs, every)
    beta, ahead = np.ones((active[-1], len(m.start))), None
    for block in range(len(kept) - 1, -1, -1):
        rows, scales, a = [], [], kept[block]
        steps = range(block * every, min(len(obs), (block + 1) * every))
        for t in steps:
            a, c = _step(m, a, obs[t, : active[t]])
            rows.append(a)
            scales.append(c)
        seen, weight = [], []
        for t in reversed(steps):
            i = t - block * every
            if ahead is not None:  # the emission, backward row and scale of step t + 1
                k = len(ahead)
                move += m.move * (rows[i][:k].T @ ahead)
                beta = np.ones((active[t], len(m.start)))
                beta[:k] = ahead @ m.move.T
            weight.append(rows[i] * beta)
            seen.append(obs[t, : active[t]])
            ahead = m.emit[seen[-1]] * beta / scales[i][:, None]
        if block == 0:
            start += weight[-1].sum(0)
        seen, weight = np.concatenate(seen), np.concatenate(weight)
        for state in range(weight.shape[1]):
            emit[:, state] += np.bincount(seen, weight[:, state], minlength=len(emit))
    return float(total.sum())


def _sequences(batch: pa.RecordBatch, i: int) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), "<u2") for x in batch.column(i)]


def baum_welch(rows: DataFrame, vocab: Vocabulary, s: Settings) -> Model:
    """rows: classes (binary). Every round sums the partitions' expected counts by class and by state in a shuffle."""
    m = Model.first(vocab, s)
    base, before = Model.unigram(vocab), -math.inf
    for _ in range(s.rounds):

        def run(batches: Iterator[pa.RecordBatch], m: Model = m) -> Iterator[pa.RecordBatch]:
            start, move, emit = np.zeros_like(m.start), np.zeros_like(m.move), np.zeros_like(m.emit)
            likely = np.zeros((1, s.states))
            for batch in batches:
                for _, lengths, obs in _groups(_sequences(batch, 0), s.group_tokens):
                    likely[0, 0] += _expected(m, lengths, obs, start, move, emit)
            found = np.vstack([emit, move, start[None], likely])
            where = np.flatnonzero(found.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(where), *(pa.array(found[where, k]) for k in range(s.states))], ["row", *(f"s{k}" for k in range(s.states))])

        states = [f"s{k}" for k in range(s.states)]
        parts = rows.select("classes").mapInArrow(run, "row long, " + ", ".join(f"{c} double" for c in states))
        found = np.zeros((vocab.classes + s.states + 2, s.states))
        for r in parts.groupBy("row").agg(*[F.sum(c).alias(c) for c in states]).collect():  # as many rows as the model has
            found[r["row"]] = r[1:]
        emit, move, start = found[: vocab.classes] + base[:, None], found[vocab.classes : -2] + SMOOTH, found[-2] + SMOOTH
        m, likely = Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0)), found[-1, 0]
        if likely - before < s.gain * vocab.total:  # the gain of the round before last
            break
        before = likely
    return m


def _scored(rows: DataFrame, m: Model, vocab: Vocabulary, s: Settings) -> DataFrame:
    """rows without classes, with chain: log10 P(class sequence) less the tail classes' totals."""
    keep = [c for c in rows.columns if c != "classes"]
    terms = vocab.tail_terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequences, chain = _sequences(batch, len(keep)), np.zeros(len(batch))
            for index, lengths, obs in _groups(sequences, s.group_tokens):
                chain[index] = _forward(m, lengths, obs)[0] / math.log(10)
            chain -= [terms[x].sum() for x in sequences]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(chain, pa.float64())], [*keep, "chain"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema) + ", chain double"
    return rows.select(*keep, "classes").mapInArrow(run, schema)


def score_texts(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row for each row of docs.

    Null and empty texts are one end token. Rows without a doc_id are held out. Without training documents every word is
    unknown and all states emit alike. Repeated rows count as often as they stand and score alike. Very long texts are one
    sequence each, in memory that grows with the root of their length beside the text. An empty table gives no rows.
    """
    docs = doc_rows(docs).withColumn("held_out", held_out(F.col("doc_id")))
    vocab = vocabulary(word_counts(docs.where(~F.col("held_out")).select("doc_id", "text")), s)
    rows = stage_table(coded(docs, vocab, s).withColumn("row", F.monotonically_increasing_id()), "coded")
    model = baum_welch(rows.where(~F.col("held_out")), vocab, s)

    rare = rows.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n")
    log_c = F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)
    rare = rare.join(vocab.counts, "word", "left").groupBy("row").agg(F.sum(F.col("n") * log_c).alias("rare_words"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"))
    scored = _scored(rows.drop("rare"), model, vocab, s).join(rare, "row", "left").fillna(0, ["rare_words", "rare_known"])
    norm = math.log10(vocab.total + SMOOTH * (vocab.distinct + 1))
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.col("rare_known")).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("words") + F.col("rare_words") - F.col("n_tokens") * norm).alias("base_score"),
        (F.col("chain") + F.col("tail_words") + F.col("rare_words")).alias("score"),
    )


def op6_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score_texts on all documents; null texts are empty, other odd rows as there."""
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
