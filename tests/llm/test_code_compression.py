"""Yinyang rounds against plain Lloyd rounds in Python's whole numbers."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from rastra.llm import code_compression as cc


@pytest.mark.parametrize("top", [2, 200, 1 << 28])
def test_nearest_equals_brute_force_over_rounds(top):
    r, skipped = np.random.default_rng(top), 0
    for _ in range(20):
        n, k, width = int(r.integers(1, 200)), int(r.integers(1, 40)), int(r.integers(0, 6))
        x, book, own, bounds = r.integers(-top, top, (n, width)), cc.Codebook.first(r.integers(-top, top, (k, width)), 5), None, None
        for _ in range(5):
            own, d, bounds, taken = cc.nearest(x, book, own, bounds)
            exact = ((x[:, None, :].astype(object) - book.entries[None].astype(object)) ** 2).sum(-1) if width else np.zeros((n, k), object)
            want = [min(range(k), key=lambda j: (row[j], j)) for row in exact.tolist()]
            assert own.tolist() == want and d.tolist() == [exact[i][j] for i, j in enumerate(want)]
            skipped += taken < n * k
            entries = book.entries.copy()
            for j in range(k):
                if (own == j).any():
                    entries[j] = [int(v) // int((own == j).sum()) for v in x[own == j].sum(0)]
            book = book.moved(entries)
    assert skipped


def contract(rows):
    """rows: vec_id, label, embedding."""
    kept = []
    for i, label, v in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, label, [int(np.floor(1024 * float(np.float32(x)))) for x in v]))
    w = max(len(v) for *_, v in kept) // 4
    first = {}
    for i, _, v in kept:
        first[i] = min(first.get(i, v), v)
    seeds = [first[i] for i in sorted(first)[:256]]
    books = [[v[p * w : (p + 1) * w] for v in seeds] for p in range(4)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(4):
        for p in range(4):
            members = defaultdict(list)
            for *_, v in kept:
                x = v[p * w : (p + 1) * w]
                members[near(x, books[p])[1]].append(x)
            books[p] = [[sum(c) // len(c) for c in zip(*members[k])] if k in members else e for k, e in enumerate(books[p])]
    out, total = [], defaultdict(int)
    for i, label, v in kept:
        found = [near(v[p * w : (p + 1) * w], books[p]) for p in range(4)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
        total[label] += out[-1][3]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((i, code, error, total[label], digest) for i, label, code, error in out), key=repr)


KIND = "vec_id long, embedding array<float>, label int"


def test_query_equals_plain_lloyd_with_odd_rows(spark, tmp_path):
    r = np.random.default_rng(1)
    rows = [(int(i), int(i) % 7 if i % 5 else None, [float(x) for x in r.normal(0, 0.02, 8)]) for i in range(400)]
    rows += [rows[3], rows[3], (3, 1, rows[9][2]), (-5, 2, None), (-6, 2, [float("nan")] * 8), (-7, 2, [None, *rows[1][2][1:]]), (-8, 2, [float("inf")] * 8)]
    spark.createDataFrame([(i, v, label) for i, label, v in rows], KIND).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = cc.op11_vector_codes(spark, str(tmp_path)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == contract(rows)


def test_odd_tables(spark, tmp_path):
    spark.createDataFrame([], KIND).write.parquet(str(tmp_path / "a" / "embeddings.parquet"))
    assert cc.op11_vector_codes(spark, str(tmp_path / "a")).count() == 0
    clash = "id long, row string, code int, error int, `a.b` int, vec array<double>"
    unlike = spark.createDataFrame([(1, "r", 1, 1, 1, [1.0, 2.0, 3.0]), (2, "r", 1, 1, 1, []), (None, "r", 1, 1, 1, [0.5] * 6)], clash)
    codes, books = cc.learn_codes(unlike, "id", "vec")
    assert codes.count() == 3 and set(codes.select("row.*").columns) == {"id", "row", "code", "error", "a.b"} and [b.shape for b in books] == [(2, 2)] * 4
    nobody = unlike.where("id is null")
    codes, books = cc.learn_codes(nobody, "id", "vec")
    assert [(r.code, r.error) for r in codes.collect()] == [(None, None)] and books == []
    with pytest.raises(ValueError):
        cc.learn_codes(spark.createDataFrame([(1, "r", 1, 1, 1, [1e18])], clash), "id", "vec")
