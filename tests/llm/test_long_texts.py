"""Every operator reads very long texts to their end."""

import hashlib

import numpy as np
import pytest

from rastra.llm import fingerprints, line_dedup, lm, near_dedup, packing, pieces, pii, token_output, toxicity
from rastra.llm.tokens import encoder

WORDS = 60_000


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in rng.integers(0, 500, WORDS)]
    long = "\n".join(" ".join(words[i : i + 1000]) for i in range(0, WORDS, 1000)) + "\nthe end of a long text"
    rows = [(1, "short text here\nthe end of a long text"), (2, long + " mail me@example.org"), (3, long), (4, None), (5, "")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(2).cache()


def text_of(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def test_personal_data_at_the_end(docs):
    out = {r.doc_id: r.personal_data for r in pii.find_personal_data(docs).collect()}
    text = text_of(docs)[2]
    assert [(s.start, s.end) for s in out[2] if s.base] == [(len(text) - 14, len(text))] and not out[3]


def test_lines_of_long_texts(docs):
    out = {r.doc_id: (len(r.lines), len(r.kept)) for r in line_dedup.drop_repeated_lines(docs).collect()}
    assert out == {1: (2, 2), 2: (61, 61), 3: (61, 0), 4: (1, 1), 5: (1, 1)}


def test_tokens_of_long_texts(docs):
    want = {d: len(encoder()(t)) + 1 for d, t in text_of(docs).items()}
    got: dict[int, int] = {}
    for r in packing.best_fit_pack(docs).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want
    ends: dict[int, int] = {}
    for r in token_output.packed_sequences(docs).collect():
        for i, d in enumerate(r.doc_ids):
            ends[d] = max(ends.get(d, 0), r.starts[i] + r.cu_seqlens[i + 1] - r.cu_seqlens[i])
    assert ends == want


def test_pieces_of_long_texts(docs):
    assert {r.doc_id: r.text for r in pieces.decode(pieces.encode_sampled(docs)).collect()} == text_of(docs)


def test_language_model_of_long_texts(docs):
    out = {r.doc_id: r for r in lm.score_texts(docs).collect()}
    assert out[3].n_tokens == WORDS + 6 + 1 and out[4].n_tokens == 1 and all(np.isfinite(r.score) for r in out.values())


def test_near_duplicates_of_long_texts(docs):
    out = {r.doc_id: r for r in near_dedup.near_duplicates(docs, near_dedup.Plan(words=4)).collect()}
    assert out[3].component_id == 2 and out[2].kept and not out[3].kept and out[3].n_shingles > 50_000 and out[5].n_shingles == 0


def test_fingerprints_of_long_texts(docs):
    out = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs).collect()}
    text = text_of(docs)
    edited = text[3][: len(text[3]) - len(text[3]) // 3] + text[2][: len(text[3]) // 3]
    assert out[3].n_chars == len(text[3]) and out[3].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and out[3].near_next > 0.9


def test_toxicity_of_long_texts(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    out = toxicity.score_documents(docs, toxicity.fit(docs, labels)).collect()
    assert len(out) == 5 and not any(r.rejected for r in out if not r.text)
