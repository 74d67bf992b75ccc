"""Suffix order, blocks and removed spans against brute force over every window."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import no_docs, odd_docs
from rastra.llm import span_dedup


def some_blocks(rng, window):
    letters = bytes(rng.sample(range(256), rng.choice([1, 2, 3])))
    blocks = [bytes(rng.choice(letters) for _ in range(rng.randrange(window, 80))) for _ in range(rng.randrange(1, 8))]
    return blocks + blocks[:1] * rng.randrange(2)


def test_two_stage_order_and_prefixes_equal_a_plain_sort():
    rng = random.Random(2)
    for _ in range(150):
        window = rng.choice([2, 5, 9, 30])
        blocks = some_blocks(rng, window)
        raw = b"".join([*blocks, b"\0\1", b"\0" * (window + 16), b"\1"])
        ends = np.cumsum([len(b) for b in blocks])
        asked = np.concatenate([np.arange(e - len(b), e - window + 1) for b, e in zip(blocks, ends)])
        x = np.frombuffer(raw, np.uint8)
        order = span_dedup.suffix_order(x, asked, window)
        keys = [raw[i : i + window] for i in order.tolist()]
        assert keys == sorted(keys) and sorted(order.tolist()) == asked.tolist()
        want = [next((m for m in range(window) if a[m] != b[m]), window) for a, b in zip(keys, keys[1:])]
        assert span_dedup.common_prefixes(x, order, window).tolist() == want


def test_repeated_windows_equal_counts_of_windows():
    rng = random.Random(3)
    for _ in range(150):
        window = rng.choice([2, 5, 9, 30])
        blocks = some_blocks(rng, window)
        copies = np.array([rng.choice([1, 1, 2]) for _ in blocks])
        count = Counter(b[i : i + window] for b in blocks for i in range(len(b) - window + 1))
        for b, c, got in zip(blocks, copies, span_dedup.repeated_windows(blocks, copies, window)):
            assert got.tolist() == [count[b[i : i + window]] > 1 or c > 1 for i in range(len(b) - window + 1)]


def test_equal_windows_have_equal_anchors_and_blocks_cover_all():
    rng = random.Random(4)
    for _ in range(100):
        window = rng.choice([2, 5, 9, 30])
        blocks = some_blocks(rng, window)
        whole, ends, of = b"".join(blocks), np.cumsum([len(b) for b in blocks]), {}
        start, windows, anchor = span_dedup.blocks_of(np.frombuffer(whole, np.uint8), ends, window, window // 2)
        places = [(i, a) for s, n, a in zip(start.tolist(), windows.tolist(), anchor.tolist()) for i in range(s, s + n)]
        assert [i for i, _ in places] == [i for b, e in zip(blocks, ends.tolist()) for i in range(e - len(b), e - window + 1)]
        assert all(of.setdefault(whole[i : i + window], a) == a for i, a in places)


def brute(texts, window):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + window] for b in raw for i in range(len(b) - window + 1))
    out = []
    for b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - window + 1):
            if count[b[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        starts = [i for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1])]
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), len(starts), hashlib.sha256(kept).hexdigest()))
    return out


def removed(docs, window, gram):
    out = span_dedup.without_repeated_spans(docs, "text", window, gram)
    n = F.coalesce(F.octet_length("row.text"), F.lit(0)).cast("long")
    out = out.select("row.doc_id", n.alias("n"), (n - F.length("kept")).alias("r"), F.size("spans").alias("s"), F.sha2("kept", 256).alias("h"))
    return sorted((tuple(r) for r in out.collect()), key=repr)


def generated(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdé漢") for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    passages = [" ".join(rng.choice(words) for _ in range(20)) for _ in range(6)]
    rows = []
    for i in range(90):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 25))), rng.choice([*passages, ""]), rng.choice(["", "=" * 70, "ab" * 30])]
        rng.shuffle(parts)
        rows.append((i, "\n".join(parts)))
    rows += [(100 + i, rows[i][1]) for i in range(5)] + [(7, rows[7][1]), (None, rows[8][1])]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("window,gram", [(12, 5), (40, 16)])
def test_spans_equal_brute_force(spark, window, gram):
    docs = generated(spark)
    rows = docs.collect()
    want = sorted(((r.doc_id, *w) for r, w in zip(rows, brute([r.text for r in rows], window))), key=repr)
    assert removed(docs, window, gram) == want
    assert sum(w[2] > 0 for w in want) > 20


def test_hot_anchors_are_dealt_by_window(spark, monkeypatch):
    docs = generated(spark)
    want = removed(docs, 12, 5)
    monkeypatch.setattr(span_dedup, "_BLOCKS", 3)
    monkeypatch.setattr(span_dedup, "_WINDOWS", 50)
    assert removed(docs, 12, 5) == want


def test_long_texts_are_hashed_in_stretches(spark, monkeypatch):
    docs = generated(spark)
    want = removed(docs, 12, 5)
    monkeypatch.setattr(span_dedup, "_CHUNK", 64)
    assert removed(docs, 12, 5) == want


def test_odd_rows_empty_tables_and_the_query(spark, tmp_path):
    docs = odd_docs(spark)
    rows = docs.collect()
    want = sorted(((r.doc_id, *w) for r, w in zip(rows, brute([r.text for r in rows], 200))), key=repr)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = span_dedup.op13_suffix_array(spark, str(tmp_path)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == want
    out = span_dedup.without_repeated_spans(docs)
    assert set(out.select("row.*").columns) == set(docs.columns) and out.count() == len(rows)
    assert span_dedup.without_repeated_spans(no_docs(spark)).count() == 0
