"""Toxicity severity by cumulative-link ordinal regression over sparse word features.

Grades are 0 (clean), 1 (toxic) and 2 (toxic and of low quality). One weight vector is shared by all thresholds:
P(grade >= k) = sigmoid(w * x - theta_k) with theta_1 <= theta_2, and the expected severity is the sum of these. Features
are distinct words, A-Z lower-cased and stripped of punctuation; x is their presence.

The model is fitted on a bounded sample of labelled documents (`sample` rows, the smallest hashes of doc_id), on all their
words: a word's feature is one of 2^`bits` by hash. The sample's features, a list of whole numbers for each row, go to one
task, which fits weights and thresholds by limited-memory BFGS and returns one row. Every document is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rastra.llm.common import boxed, unboxed
from rastra.storage import stage_table

_PUNCTUATION = b".,;:!?\"'()[]{}<>|*%$#&-_/\\"


@dataclass(frozen=True)
class Settings:
    sample: int = 20_000
    bits: int = 20
    steps: int = 100
    memory: int = 10
    ridge: float = 3e-6
    reject_at: float = 0.5


def features_of(text: str | None, bits: int) -> np.ndarray:
    """The sorted distinct features of a text: hashes of its words, A-Z lower-cased and stripped of punctuation."""
    import xxhash

    words = {w.strip(_PUNCTUATION) for w in (text or "").encode("utf-8", "surrogatepass").lower().split()}
    words.discard(b"")
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(w) >> (64 - bits) for w in words), np.int32, len(words)))


@dataclass
class SeverityModel:
    """Weights of features (sorted numbers) and the ordered thresholds; without features it finds nothing toxic."""

    features: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.array([4.0, 5.0]))
    bits: int = 20

    def at_least(self, margins: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2) for each margin w * x."""
        return 1 / (1 + np.exp(-np.clip(margins[:, None] - self.thresholds, -40, 40)))

    def table(self) -> np.ndarray:
        """The weights of all features: 2^bits single-precision numbers, whatever the corpus."""
        out = np.zeros(1 << self.bits, np.float32)
        out[self.features] = self.weights
        return out


def labelled_sample(docs: DataFrame, labels: DataFrame, s: Settings) -> DataFrame:
    """text, grade of at most s.sample documents, drawn by hash; labels without a doc_id or toxic value take no part."""
    grade = F.when(F.col("toxic") == 0, 0).when(F.coalesce("quality", F.lit(1)) == 0, 2).otherwise(1)
    picked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(grade).alias("grade"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample)
    # at most s.sample rows of two numbers
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "grade")


def likelihood(weights: np.ndarray, thresholds: np.ndarray, place: np.ndarray, owner: np.ndarray, grade: np.ndarray) -> tuple[float, np.ndarray]:
    """The log likelihood of grades and its gradient in (weights, thresholds). Row owner[i] has feature place[i]."""
    n, rows = len(weights), np.arange(len(grade))
    margin = np.bincount(owner, weights[place], minlength=len(grade))
    cumulative = 1 / (1 + np.exp(-np.clip(margin[:, None] - thresholds, -40, 40)))
    ge = np.column_stack([np.ones(len(grade)), cumulative, np.zeros(len(grade))])  # P(grade >= 0..3)
    slope = ge * (1 - ge)
    mass = np.maximum(ge[rows, grade] - ge[rows, grade + 1], 1e-12)
    lower, upper = slope[rows, grade] / mass, slope[rows, grade + 1] / mass
    gradient = np.empty(n + 2)
    gradient[:n] = np.bincount(place, (lower - upper)[owner], minlength=n)
    for k in (1, 2):
        gradient[n + k - 1] = upper[grade == k - 1].sum() - lower[grade == k].sum()
    return float(np.log(mass).sum()), gradient


def evidence(place: np.ndarray, toxic: np.ndarray, n: int, all_toxic: np.ndarray) -> np.ndarray:
    """How far each feature's weight is trusted, in (0, 1]: z^2 / (z^2 + 100), z telling how unlike its frequencies are in toxic
    and other rows. The weights' ridge is that of weight / trust, so that words without evidence stay near zero."""
    a, b = max(1, int(all_toxic.sum())), max(1, int((~all_toxic).sum()))
    bad, good = np.bincount(place[toxic], minlength=n), np.bincount(place[~toxic], minlength=n)
    both = (bad + good) / (a + b)
    z2 = (bad / a - good / b) ** 2 / (both * (1 + 1e-9 - both) * (1 / a + 1 / b) + 1e-12)
    return (z2 + 1e-3) / (z2 + 100)


def fitted(lists: list[np.ndarray], grade: np.ndarray, s: Settings) -> SeverityModel:
    """The model of rows of features and their grades; unless both toxic and clean rows are there, it finds nothing toxic."""
    if not (grade > 0).any() or not (grade == 0).any():
        return SeverityModel(bits=s.bits)
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    features, place = np.unique(np.concatenate(lists), return_inverse=True)
    n, total = len(features), len(lists)
    trust = evidence(place, (grade > 0)[owner], n, grade > 0)

    def objective(x: np.ndarray) -> tuple[float, np.ndarray]:
        """The mean negative log likelihood with the ridge, and its gradient."""
        value, slope = likelihood(x[:n] * trust, x[n:], place, owner, grade)
        slope = -slope / total
        slope[:n] = slope[:n] * trust + s.ridge * x[:n]
        return -value / total + s.ridge / 2 * float(x[:n] @ x[:n]), slope

    x = np.concatenate([np.zeros(n), [4.0, 5.0]])
    best, gradient = objective(x)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(s.steps):
        direction, length = -_curved(gradient, moves), 1.0
        while length > 1e-4:  # halve the step until it gains
            there = x + length * direction
            value, slope = objective(there)
            if there[n] < there[n + 1] and value < best + 1e-4 * length * float(gradient @ direction):
                break
            length /= 2
        else:
            break
        done = best - value < 1e-7
        if float((there - x) @ (slope - gradient)) > 1e-12:
            moves = [*moves, (there - x, slope - gradient)][-s.memory :]
        x, best, gradient = there, value, slope
        if done:
            break
    return SeverityModel(features, x[:n] * trust, x[n:], s.bits)


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> SeverityModel:
    """Without labelled toxic documents, or without clean ones, the model finds nothing toxic."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features_of(t.as_py(), s.bits) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column(1)], ["x", "grade"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, grades = [], [np.zeros(0, int)]
        for batch in batches:
            lists += [x.values.to_numpy() for x in batch.column(0)]
            grades.append(batch.column(1).to_numpy())
        m = fitted(lists, np.concatenate(grades).astype(int), s)
        cells = [m.features.astype("<i4").tobytes(), m.weights.astype("<f8").tobytes(), m.thresholds.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([cells[0]], pa.binary()), pa.array([cells[1]], pa.binary()), pa.array([cells[2]], pa.list_(pa.float64()))], ["features", "weights", "thresholds"])

    sparse = stage_table(labelled_sample(docs, labels, s).mapInArrow(rows, "x array<int>, grade int"), "features")
    # at most `sample` rows, in a stable order, to one task
    row = sparse.orderBy(F.xxhash64("x", "grade")).coalesce(1).mapInArrow(solve, "features binary, weights binary, thresholds array<double>").first()
    if row is None:  # no labelled rows
        return SeverityModel(bits=s.bits)
    return SeverityModel(np.frombuffer(row["features"], "<i4"), np.frombuffer(row["weights"], "<f8"), np.array(row["thresholds"]), s.bits)


def _curved(gradient: np.ndarray, moves: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The gradient times the inverse curvature that recent moves show (the two-loop recursion of L-BFGS)."""
    q, shares = gradient.copy(), []
    for step, change in reversed(moves):
        share = float(step @ q) / float(step @ change)
        shares.append(share)
        q -= share * change
    if moves:
        step, change = moves[-1]
        q *= float(step @ change) / float(change @ change)
    for (step, change), share in zip(moves, reversed(shares)):
        q += step * (share - float(change @ q) / float(step @ change))
    return q


def severity(text: Column, model: SeverityModel, spark: SparkSession) -> Column:
    """struct(p_toxic, p_severe, expected_severity) of a text column."""
    shared = spark.sparkContext.broadcast(model.table())

    @F.pandas_udf("p_toxic double, p_severe double, expected_severity double")
    def score(texts: pd.Series) -> pd.DataFrame:
        weights = shared.value
        margins = np.array([weights[features_of(t, model.bits)].sum(dtype=float) for t in texts])
        p = model.at_least(margins.reshape(-1))
        return pd.DataFrame({"p_toxic": p[:, 0], "p_severe": p[:, 1], "expected_severity": p.sum(axis=1)})

    return score(text)


def score_documents(docs: DataFrame, model: SeverityModel, s: Settings = Settings()) -> DataFrame:
    """row (all columns of docs), doc_id, text, severity (struct), rejected; null and empty texts have no features and are
    kept. Rows are judged one by one, so repeated rows are judged alike; very long texts are read whole; an empty table gives
    no rows."""
    out = boxed(docs).withColumn("severity", severity(F.col("text"), model, docs.sparkSession))
    return out.withColumn("rejected", (F.col("severity.p_toxic") >= s.reject_at) & F.col("text").rlike("[^\\x20\\x09-\\x0D]"))


def without_toxic(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """docs, same columns, less the documents that the model fitted on them and labels rejects; nulls, repeated rows and empty
    tables as in score_documents."""
    return unboxed(score_documents(docs, fit(docs, labels, s), s).where(~F.col("rejected")), docs.columns)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's expected severity by the model of all labels; null and empty texts have no words, repeated rows score alike."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score_documents(docs, model)
    p1, p2 = F.col("severity.p_toxic"), F.col("severity.p_severe")
    grade = F.when(p2 >= 0.5, 2).when(p1 >= 0.5, 1).otherwise(0)
    return out.select("doc_id", p1.alias("p_toxic"), p2.alias("p_severe"), F.col("severity.expected_severity").alias("expected_severity"), grade.alias("grade"), "rejected")
