"""Runs of words against a search of every period, and the contract's digests against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import no_docs, odd_docs
from rastra.llm import periodic_runs


def brute_runs(s, least=12):
    """Every stretch s[i:i + p] == s[i + p:...] of every period; of equal intervals the smallest period."""
    n, out = len(s), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and s[j] == s[j + p]:
                j += 1
            if j - i + p >= max(least, 2 * p):
                out.setdefault((i, j - i + p), p)
            i = max(i + 1, j)
    return sorted((i, size, p) for (i, size), p in out.items())


@pytest.mark.parametrize("least", [2, 4, 12])
def test_batch_runs_equal_brute_force(least):
    rng = random.Random(least)
    for _ in range(120):
        docs = []
        for _ in range(rng.randrange(1, 6)):
            n, k = rng.choice([0, 1, 5, 13, 40, 150]), rng.choice([1, 2, 3, 8])
            s = [rng.randrange(k) for _ in range(n)]
            if n > 20 and rng.random() < 0.5:
                q, a = rng.randrange(1, 40), rng.randrange(n)
                s[a:] = [s[a + (i - a) % q] for i in range(a, n)]
            docs.append(s)
        ids, ends = np.array([x for s in docs for x in s], np.int64), np.cumsum([len(s) for s in docs])
        d, start, length, period = periodic_runs.batch_runs(ids, ends, least)
        for i, s in enumerate(docs):
            assert sorted(zip(start[d == i].tolist(), length[d == i].tolist(), period[d == i].tolist())) == brute_runs(s, least)


def test_z_values_equal_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        s = [rng.randrange(2) for _ in range(rng.randrange(0, 30))]
        want = [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
        assert periodic_runs.z_values(s) == want


def contract(doc_id, text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = sorted(brute_runs(w), key=lambda r: (r[0], r[2]))
    gone = {i for s, size, p in runs for i in range(s + p, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    exponent = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, exponent, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_equals_plain_python_on_odd_and_planted_texts(spark, tmp_path):
    rng, rows = random.Random(5), []
    for i in range(150):
        rows.append((i, " ".join(rng.choice("abcdef") for _ in range(rng.randrange(0, 120)))))
    planted = spark.createDataFrame(rows, "doc_id long, text string")
    docs = odd_docs(spark).select("doc_id", "text").unionByName(planted)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = periodic_runs.op12_periodic_runs(spark, str(tmp_path)).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()
    want = [contract(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert sum(r.n_runs for r in got) > 20


def test_operator_passes_odd_columns_and_long_texts(spark):
    docs = odd_docs(spark)
    got = periodic_runs.find_periodic_runs(docs)
    assert got.count() == docs.count() and set(got.select("row.*").columns) == set(docs.columns) - {"text"}
    assert periodic_runs.find_periodic_runs(no_docs(spark)).count() == 0
    long = spark.range(1).select(F.col("id").alias("doc_id"), F.expr("concat(repeat('same ', 60000), repeat('one two ', 30000))").alias("text"))
    r = periodic_runs.find_periodic_runs(long).first()
    assert r.n_words == 120000 and [tuple(x) for x in r.runs] == [(0, 60000, 1), (60000, 60000, 2)] and r.collapsed == "same one two"
