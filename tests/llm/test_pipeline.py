"""The pipeline against plain Python stages, and the registered queries' contracts on the smallest tables."""

import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from helpers import texts
from rastra.llm.queries import ORACLE_SQL, QUERIES
from rastra.llm.tokens import cut, encoder
from test_text_ops import base_spans, brute_components, brute_lines

SF = "/root/testdata/sf0.001"


def corpus(spark, path):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghijklm") for _ in range(6)) for _ in range(500)]
    rows, labels, lines = [], [], []
    for i in range(200):
        if i % 4 == 0 or not lines:
            lines = [" ".join(rng.choice(vocabulary) for _ in range(12)) for _ in range(4)]
        w = [x.split() for x in lines]
        if i % 4 == 1:
            w[1][3] = "changed"
        if i % 4 == 2:
            w = [x + [f"mail{i}@example.com", "+1 (543) 555-9258"] for x in w]
        if i % 10 == 3:
            w[0][2], w[3][1] = "Idiot", "scum!"
        labels.append((i, 1, int(i % 10 == 3)))
        text = "\n".join(" ".join(x) for x in w) + ("\nshared boilerplate line" if i % 3 == 0 else "")
        rows.append((i, None if i == 77 else text, "en", f"src{i % 3}", len(text)))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def masked(text):
    out, at = "", 0
    for start, kind, end in base_spans(text):
        if start >= at:
            out += text[at:start] + ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]")[kind]
        at = max(at, end)
    return out + text[at:]


def test_stages_equal_brute_force(spark, tmp_path):
    corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names, columns = [n for n, _ in corpus_pipeline.STAGES], docs.columns
    assert names == ["toxicity", "line_dedup", "near_dedup", "personal_data", "packing"]
    rows = texts(docs)
    rows = {i: t for i, t in rows.items() if i % 10 != 3}
    lines = brute_lines(sorted(rows.items()))
    want = [dict(rows), {i: "\n".join(x) for i, x in lines.items()}]
    comps = brute_components(sorted(want[1].items()), 5)
    want.append({i: t for i, t in want[1].items() if comps[i][1] == i})
    want.append({i: masked(t) for i, t in want[2].items()})
    for (name, stage), after in zip(corpus_pipeline.STAGES[:-1], want):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert texts(docs) == after, name
        assert [(r.doc_id, r.n_chars) for r in docs.where("text is not null").collect() if r.n_chars != len(r.text)] == [], name
    pieces = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[r.doc_id, r.piece] = (r.start, r.length, r.ids_crc32)
    for i, t in want[3].items():
        ids = np.concatenate([encoder()(t), np.array([2], "<u4")])
        for k, (start, n) in enumerate(cut(len(ids), 1024)):
            assert pieces.pop((i, k)) == (start, n, zlib.crc32(ids[start : start + n].tobytes()))
    assert not pieces


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the synthetic tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(ORACLE_SQL[name])
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(r) for r in df.select(*columns).collect()) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the synthetic tables")
def test_personal_data_query_equals_brute_force(spark):
    import hashlib

    kinds = ["email", "ip", "card", "phone"]
    text = texts(spark.read.parquet(f"{SF}/documents.parquet"))
    for r in QUERIES["op1_pii"](spark, SF).collect():
        base = base_spans(text[r.doc_id])
        spelled = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(spelled.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, k, _ in base) for x in range(4)]
        assert set(spelled.split(",")) - {""} <= set(r.spans.split(","))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the synthetic tables")
def test_packing_query_places_every_token(spark):
    from tokenizers import Tokenizer

    from rastra.llm.tokens import vocabulary_path

    exact = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    text, bins, got = texts(spark.read.parquet(f"{SF}/documents.parquet")), defaultdict(list), defaultdict(dict)
    for r in QUERIES["op10_best_fit_packing"](spark, SF).collect():
        bins[r.sequence_id].append((r.offset, r.length))
        got[r.doc_id][r.piece] = (r.start, r.length, r.ids_crc32)
    for i, t in text.items():
        ids = np.array(exact.encode(t, add_special_tokens=False).ids + [2], "<u4")
        assert got[i] == {k: (s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(len(ids), 1024))}
    for parts in bins.values():
        assert [o for o, _ in sorted(parts)] == np.cumsum([0, *(n for _, n in sorted(parts))])[:-1].tolist()
        assert sum(n for _, n in parts) <= 1024
