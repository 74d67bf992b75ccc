"""Brute-force versions of the contracts on generated and odd tables."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import ascii_lower, generated, no_docs, odd_docs, texts, words
from rastra.llm import fingerprints, line_dedup, lm, near_dedup, packing, pieces, pii, token_output, toxicity, topk
from rastra.llm.tokens import cut, encoder, vocabulary_path

BASE = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text):
    out = []
    for k, p in enumerate(BASE):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            if k == 1 and any(int(x) > 255 for x in m.group().split(".")) or k == 2 and not (14 <= len(d) <= 19 and luhn(d)) or k == 3 and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


TRICKY = [
    "a@b.c_d@e.f x@y..z @nope.com a@b a.@b-c.d-",
    "1.2.3.4.5.6.7.8 256.1.1.1 000255.0.0.1 1.1.1.1.",
    "4709559030084884 1 (255) 555-8013 4709-5590-3008-4884 +1 (255) 555-8013 22",
    "🎉 mail é@mail.com, +49 (0) 30 1234567 and 12345678901234567890 +1",
    "@" * 50 + "a" * 3000 + "@b." + "c." * 2000 + "d",
    "call us: 555 123-4567 or (555) 123-4567. john at example dot com",
    "+1 2\n+3 4567890123\n10.0.0.1",
]


def test_pii_base_spans_equal_brute_force_and_stay(spark):
    docs = spark.createDataFrame(list(enumerate(TRICKY + [None, ""])), "doc_id long, text string")
    for r in pii.find_personal_data(docs).collect():
        want = base_spans(r.text)
        spans = [(s.start, s.kind, s.end) for s in r.personal_data]
        assert [(s.start, s.kind, s.end) for s in r.personal_data if s.base] == want
        assert set(want) <= set(spans) and spans == sorted(spans)


def test_pii_model_learns_reliabilities():
    votes = dict(kind=2, v_pattern=-1, digits=5, separators=0)
    rows = [votes | dict(v_check=1, v_gazetteer=1, v_context=0, v_edge=1, n=900), votes | dict(v_check=-1, v_gazetteer=-1, v_context=-1, v_edge=-1, n=900)]
    model = pii.fit(rows)
    logit = lambda r: model.bias + sum(model.weights[f][r[f]] for f in pii.FEATURES)
    assert logit(rows[0]) > 0 > logit(rows[1])
    assert model.reliability["v_check"][1][1] > 0.9 > 0.1 > model.reliability["v_check"][0][1]


def test_pii_masks_and_keeps_columns(spark):
    docs = odd_docs(spark)
    out = pii.mask_personal_data(docs)
    assert out.columns == docs.columns
    text = [r["text"] for r in out.where("doc_id = 9").collect()][0]
    assert "[EMAIL]" in text and "[IP]" in text and "[PHONE]" in text and "4709559030084884" not in text
    assert out.where("doc_id = 1").first()["text"] is None and out.where("doc_id = 7").first()["text"] == docs.where("doc_id = 7").first()["text"]
    assert pii.mask_personal_data(no_docs(spark)).count() == 0


def test_running_sum_over_blocks(spark):
    df = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 255, 256, 257, 700)], "x array<long>")
    for r in df.select("x", pii.running_sum(F.col("x")).alias("s")).collect():
        assert r.s == list(itertools.accumulate(r.x))


def brute_lines(rows):
    key = lambda line: ascii_lower(line.strip(" \t\n\x0b\x0c\r"))
    owner, seen = {}, {i: (t or "").split("\n") for i, t in rows}
    for i in sorted(seen):
        for line in seen[i]:
            owner.setdefault(key(line), i)
    return {i: [x for x in lines if len(key(x)) < 10 or owner[key(x)] == i] for i, lines in seen.items()}


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 3), (5, 2)])
def test_line_dedup_equals_brute_force(spark, batches, fanout):
    shared = ["A shared line of text", "  a SHARED line of text\t", "short", "Ünïcode LINE of text", "ünïcode line of text", ""]
    rows = [(i * 7, "\n".join([f"own line number {i}"] + shared[: i % 7] + [f"line of the pair {i // 2}"] * 2)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = line_dedup.drop_repeated_lines(docs, batches=batches, fanout=fanout)
    assert {r.doc_id: r.kept for r in out.collect()} == brute_lines(rows)


def test_line_dedup_of_odd_rows(spark):
    docs = odd_docs(spark)
    out = line_dedup.without_repeated_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    by_id = defaultdict(list)
    for r in out.collect():
        by_id[r.doc_id].append(r.text)
    assert by_id[1] == [None] and by_id[2] == [""] and by_id[4] == ["", ""]
    assert by_id[3][0].count("\n") == 2  # the owner keeps every line with the key
    assert line_dedup.without_repeated_lines(no_docs(spark)).count() == 0


def test_line_dedup_gathers_a_texts_lines_at_most_for_rows_without_an_id(spark, monkeypatch):
    rows = [(i, f"a shared line of text\nown line number {i}") for i in range(5)]
    rows += [(None, "\n".join([f"unnamed line {i} {k}" for k in range(8)] + ["a shared line of text", "  Common without AN id", "short"])) for i in range(40)]
    rows += [(None, None), (None, rows[-1][1])]
    gathered, real = [], line_dedup.owned_lines
    monkeypatch.setattr(line_dedup, "owned_lines", lambda *a: gathered.append(real(*a)) or gathered[0])
    out = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    want = [(0, rows[0][1])] + [(i, f"own line number {i}") for i in range(1, 5)]
    want += [(None, (t or "").replace("a shared line of text\n", "")) for _, t in rows[5:]]
    assert sorted((r.doc_id is None, r.doc_id or 0, "\n".join(r.kept)) for r in out.collect()) == sorted((i is None, i or 0, t) for i, t in want)
    assert max(sum(map(len, r._cells)) for r in gathered[0].collect()) == 9


def brute_components(rows, k, percent=80):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    comp = {i: i for i in sets}

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = sorted((top(a), top(b)))
            comp[b] = a
    return {i: (len(s), top(i)) for i, s in sets.items()}


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_equal_brute_force(spark, k):
    docs = generated(spark, 150)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = near_dedup.near_duplicates(docs, near_dedup.Plan(words=k, block=4)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_components(rows, k)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_near_duplicates_of_odd_rows(spark):
    out = near_dedup.near_duplicates(odd_docs(spark)).collect()
    assert len(out) == 11
    by = {r.doc_id: r for r in out}
    assert by[1].n_shingles == 0 and by[1].kept and by[2].component_id == 2
    assert by[8].component_id == 7 and not by[8].kept and by[None].kept
    kept = near_dedup.keep_one_of_each(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i in (1, 2, 3, 4, 5, 6, 7, 9, None))
    assert near_dedup.near_duplicates(no_docs(spark)).count() == 0


def test_unlike_texts_under_one_id_all_stay(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(30)) for k in "abcd"}
    rows = [(7, None), (7, text["a"]), (7, text["b"]), (7, text["b"]), (5, text["c"]), (5, text["a"]), (9, text["b"]), (9, text["d"]), (3, "")]
    kept = near_dedup.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    want = [(3, ""), (5, text["a"]), (5, text["c"]), (7, None), (7, text["b"]), (9, text["d"])]
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted((i, t or "") for i, t in want)
    assert near_dedup.keep_one_of_each(no_docs(spark)).count() == 0


def test_chunk_keys_keep_the_pigeonhole_guarantee(spark):
    plan = near_dedup.Plan()
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 16, plan.slots).astype("<u2")
    most = plan.chunks * (plan.errors + 1) - 1
    rows = [(0, 10, bytearray(a.tobytes()))]
    for i in range(1, 20):
        b = a.copy()
        b[rng.choice(plan.slots, most, replace=False)] ^= 1
        rows.append((i, 10, bytearray(b.tobytes())))
    keys = near_dedup.chunk_keys(spark.createDataFrame(rows, "rep long, n long, sig binary"), plan)
    own = defaultdict(set)
    for r in keys.collect():
        own[r.rep].add(r["key"])
    assert all(own[0] & own[i] for i in range(1, 20))


def test_matrix_intersections():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 9000, n).astype(np.uint64)) for n in (0, 1, 500, 6000, 3000)]
    got = near_dedup._shared(sets, sets[::-1])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[::-1]] for a in sets]


def test_fingerprints_follow_generalised_jaccard(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(0, 60, 2):
        a = [f"w{x}" for x in rng.integers(0, 60, 150)]
        b = a[: 20 + 4 * i] + [f"v{x}" for x in rng.integers(0, 60, 130)]
        rows += [(i, " ".join(a)), (i + 1, " ".join(b))]
    sig = {r.doc_id: r.sig for r in fingerprints.signatures(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"], "text", 128).collect()}
    off = []
    for i in range(0, 60, 2):
        x, y = Counter(rows[i][1].split()), Counter(rows[i + 1][1].split())
        want = sum((x & y).values()) / sum((x | y).values())
        off.append(sum(p == q for p, q in zip(sig[i], sig[i + 1])) / 128 - want)
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.06


def test_fingerprint_rows_equal_brute_force(spark):
    docs = generated(spark, 30).unionByName(spark.createDataFrame([(100, None), (101, ""), (102, "é🎉x")], "doc_id long, text string"))
    text = texts(docs)
    order = sorted(text, reverse=True)
    out = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs).collect()}
    assert len(out) == len(text)
    for i, d in enumerate(order):
        following = text[order[(i + 1) % len(order)]]
        n = len(text[d])
        edited = text[d][: n - n // 3] + following[: n // 3]
        assert out[d].n_chars == n and out[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (out[d].near_next == 1) == (out[d].fingerprint == out[order[(i + 1) % len(order)]].fingerprint)
    same = defaultdict(set)
    for d, t in text.items():
        same[t].add(out[d].fingerprint)
    assert all(len(s) == 1 for s in same.values())
    assert fingerprints.edited_fingerprints(no_docs(spark)).count() == 0 and fingerprints.edited_fingerprints(odd_docs(spark)).count() == 11


def test_language_model_base_and_normalisation(spark):
    docs = generated(spark, 80).unionByName(spark.createDataFrame([(200, None), (201, "only unknown words")], "doc_id long, text string"))
    text = texts(docs)
    token = lambda t: words(t) + ["\n"]
    counts = Counter(w for i, t in text.items() if zlib.crc32(str(i).encode()) % 10 for w in token(t))
    total, kinds = sum(counts.values()), len(counts)
    for r in lm.score_texts(docs, lm.Settings(lookup_share=200, own_share=50)).collect():
        t = token(text[r.doc_id])
        want = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in t)
        assert math.isclose(r.base_score, want, rel_tol=1e-9) and r.n_known == sum(counts[w] > 0 for w in t)
        assert r.n_tokens == len(t) and r.train_tokens == total and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        assert math.isfinite(r.score) and r.score < 0
    assert lm.score_texts(no_docs(spark)).count() == 0 and lm.score_texts(odd_docs(spark)).count() == 11


def test_forward_equals_enumeration_and_training_gains():
    rng = np.random.default_rng(0)
    emit = rng.uniform(0.1, 1, (3, 2))
    m = lm.Model(np.array([0.3, 0.7]), np.array([[0.8, 0.2], [0.4, 0.6]]), emit / emit.sum(0))
    for obs in ([0], [0, 1, 2, 1], [2, 2]):
        want = 0.0
        for path in itertools.product((0, 1), repeat=len(obs)):
            p = m.start[path[0]] * m.emit[obs[0], path[0]]
            for a, b, o in zip(path, path[1:], obs[1:]):
                p *= m.move[a, b] * m.emit[o, b]
            want += p
        (_, lengths, padded), = lm._groups([np.array(obs)], 100)
        assert math.isclose(lm._forward(m, lengths, padded)[0][0], math.log(want))
    data = [rng.integers(0, 3, n) for n in (1, 5, 40, 7)]
    start, move, counts = np.zeros(2), np.zeros((2, 2)), np.zeros((3, 2))
    before = 0.0
    for _, lengths, padded in lm._groups(data, 60):
        before += lm._forward(m, lengths, padded)[0].sum()
        lm._expected(m, lengths, padded, start, move, counts)
    assert math.isclose(counts.sum(), 53) and math.isclose(start.sum(), 4) and math.isclose(move.sum(), 49)
    better = lm.Model(start / start.sum(), move / move.sum(1, keepdims=True), counts / counts.sum(0))
    assert sum(lm._forward(better, n, o)[0].sum() for _, n, o in lm._groups(data, 60)) > before


def test_language_model_beats_unigrams_on_held_out_texts(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{x}" for x in rng.integers(0, 30, 60))) for i in range(300)]
    out = lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert out[0] > out[1] + 0.1 * out[2]


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(0, 40, (400, 6)))
    x[50:120] = x[50]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    out = topk.top_k(rows, rows.where("id % 10 = 0"), 5, topk.Settings(sample=100, leaf_rows=20, block=32, queries=8, first_leaves=1))
    want = []
    for q in range(0, 400, 10):
        order = sorted((-int(x[q] @ x[i]), i) for i in range(400) if i != q)[:5]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(order, 1)]
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)


def test_top_k_of_odd_vectors(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0]), (3, []), (4, [0.0, 0.0, 5.0]), (5, None), (6, [float("nan")]), (7, [None, 1.0])]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    good = df.where(topk.usable(F.col("vec")))
    assert sorted(r.id for r in good.collect()) == [1, 2, 3, 4]
    out = [(r.vec_id, r.score) for r in topk.top_k(good, good.where("id = 1")).orderBy("rank").collect()]
    assert out == [(2, 1), (3, 0), (4, 0)]
    assert topk.top_k(good.where("id > 9"), good).count() == 0


def test_byte_pair_ids_equal_the_tokenizers_library(spark):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    for t in ["", " a  b\n\n c\t", "don't é漢字🎉▁ <|endoftext|> x", "123456 ''' ---", "A" * 5000, *filter(None, texts(odd_docs(spark)).values())]:
        assert encoder()(t).tolist() == exact.encode(t, add_special_tokens=False).ids


def test_best_fit_packing_is_gapless_and_tight(spark):
    docs = odd_docs(spark).unionByName(odd_docs(spark).withColumn("doc_id", F.col("doc_id") + 100))
    rows = packing.best_fit_pack(docs, capacity=64, with_ids=True).collect()
    bins, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(np.frombuffer(bytes(r.ids), "<u2").astype("<u4").tobytes()) == r.ids_crc32 and len(r.ids) == 2 * r.length <= 128
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    assert len(bins) <= 1.02 * math.ceil(sum(r.length for r in rows) / 64) + 1
    for r in rows:
        if r.doc_id == 7:
            by_doc[7].append((r.start, np.frombuffer(bytes(r.ids), "<u2").tolist()))
    assert sum((ids for _, ids in sorted(by_doc[7])), []) == encoder()(texts(odd_docs(spark))[7]).tolist() + [2]
    assert packing.best_fit_pack(no_docs(spark)).count() == 0


def test_minimum_bin_slack_uses_every_item_once():
    rng = np.random.default_rng(3)
    counts = Counter(rng.integers(1, 101, 2000).tolist())
    used, bins = Counter(), 0
    for repeats, pattern in packing.minimum_bin_slack(counts, 100):
        assert sum(k * m for k, m in pattern.items()) <= 100
        bins += repeats
        for k, m in pattern.items():
            used[k] += m * repeats
    assert used == counts and bins <= math.ceil(sum(k * n for k, n in counts.items()) / 100) * 1.02 + 1
    assert cut(1, 4) == [(0, 1)] and cut(9, 4) == [(0, 1), (1, 4), (5, 4)] and cut(8, 4) == [(0, 4), (4, 4)]


def test_capacity_tree_is_best_fit_decreasing():
    rng = np.random.default_rng(8)
    lengths = rng.integers(1, 50, 300).tolist()
    bins, free = [], []
    for i in sorted(range(300), key=lambda i: (-lengths[i], i)):
        fits = [(f, -b) for b, f in enumerate(free) if f >= lengths[i]]
        if fits:
            best = min(f for f, _ in fits)
            b = next(-k for f, k in fits if f == best)
        else:
            b = len(bins)
            bins.append([])
            free.append(64)
        bins[b].append(i)
        free[b] -= lengths[i]
    rows = token_output.best_fit_decreasing(Counter(lengths), 64)
    got = defaultdict(dict)  # sequence -> offset -> length
    seen = Counter()
    for length, a, z, first, each, offset in rows:
        seen[length] += z - a
        for rank in range(z - a):
            got[first + rank // each][offset + rank % each * length] = length
    assert seen == Counter(lengths) and len(got) == len(bins)
    for places in got.values():
        at = 0
        for offset, length in sorted(places.items()):
            assert offset == at
            at += length
        assert at <= 64


def test_packings_need_few_sequences():
    """Minimum bin slack needs no more sequences than best-fit decreasing, and about as few as the tokens fill."""
    rng = np.random.default_rng(11)
    for n, spread in ((60, 5.0), (900, 5.5), (9000, 5.8), (500, 6.2)):
        counts = Counter(np.clip(rng.lognormal(spread, 0.8, n), 1, 1024).astype(int).tolist())
        tokens = sum(k * v for k, v in counts.items())
        least = max(-(-tokens // 1024), sum(v for k, v in counts.items() if k > 512))
        slack = sum(r for r, _ in packing.minimum_bin_slack(counts, 1024))
        decreasing = max(r[3] + (r[2] - r[1]) // r[4] for r in token_output.best_fit_decreasing(counts, 1024))
        assert least <= slack <= decreasing and slack <= least * 1.01 + 1




def test_packed_sequences_round_trip(spark, tmp_path):
    docs = odd_docs(spark)
    token_output.write_packed(token_output.packed_sequences(docs, 128), str(tmp_path / "packed"))
    packed = spark.read.parquet(str(tmp_path / "packed"))
    for r in packed.collect():
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens == len(r.input_ids) // 2 <= 128
        places = np.frombuffer(bytes(r.position_ids), "<u2").tolist()
        assert places == [i for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]) for i in range(b - a)]
    for r in token_output.id_matrix(packed, 128, 7).collect():
        ids = np.frombuffer(bytes(r.input_ids), "<u2")
        assert len(ids) == 128 == len(r.position_ids) // 2 and (ids[r.n_tokens :] == 7).all()
    parts = defaultdict(list)
    for r in token_output.unpack(packed).collect():
        parts[r.doc_id].append((r.start, bytes(r.ids)))
    want = texts(docs)
    for i in (1, 2, 3, 6, 7, None):
        ids = np.frombuffer(b"".join(b for _, b in sorted(parts[i])), "<u2").tolist()
        assert ids == encoder()(want[i]).tolist() + [50256]
    assert token_output.packed_sequences(no_docs(spark)).count() == 0


def test_registered_packing_returns_matrix_rows(spark, tmp_path):
    odd_docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    rows = token_output.op4_token_binary(spark, str(tmp_path)).collect()
    assert {(len(r.input_ids), len(r.position_ids)) for r in rows} == {(2048, 2048)}
    assert all(0 < r.n_tokens == r.cu_seqlens[-1] <= 1024 for r in rows) and any(r.n_tokens < 1024 for r in rows)


def test_sampled_pieces_decode_and_repeat(spark):
    docs = odd_docs(spark)
    first = {(r.doc_id, i): bytes(r.ids) for i, r in enumerate(pieces.encode_sampled(docs).collect())}
    again = {(r.doc_id, i): bytes(r.ids) for i, r in enumerate(pieces.encode_sampled(docs.repartition(1), chunk_chars=50).collect())}
    assert sorted(first.values()) == sorted(again.values())
    back = pieces.decode(pieces.encode_sampled(docs))
    assert sorted(r["text"] for r in back.collect()) == sorted((r["text"] or "") for r in docs.collect())
    assert pieces.encode_sampled(docs, seed=2).collect() != pieces.encode_sampled(docs).collect()
    assert pieces.encode_sampled(no_docs(spark)).count() == 0


def test_samples_have_the_lattice_distribution():
    p = pieces.pieces_of(pieces.PIECE_MODEL, 0.5)
    ids = {b: i for i, b in enumerate(p.spelled) if b and i > 258}

    def paths(b):
        if not b:
            yield ()
        for n in range(1, len(b) + 1):
            if b[:n] in ids:
                for rest in paths(b[n:]):
                    yield (b[:n], *rest)

    mass = {s: math.exp(sum(p.log_weight[ids[x]] for x in s)) for s in paths(b" then")}
    drawn = Counter(tuple(p.spelled[i] for i in x) for x in pieces.sample_batch(p, [" then"] * 20_000, list(range(20_000)), 1))
    assert set(drawn) <= set(mass)
    for s, m in mass.items():
        share = m / sum(mass.values())
        assert abs(drawn[s] / 20_000 - share) < 5 * math.sqrt(share * (1 - share) / 20_000) + 1e-4


def test_runs_of_spaces_have_the_distribution_over_all_pieces():
    p = pieces.pieces_of(pieces.PIECE_MODEL, 0.5)
    ids = {b: i for i, b in enumerate(p.spelled) if b and i > 258} | {b"\n": p.byte_id[10]}

    def paths(b):  # of the whole text, cut nowhere
        if not b:
            yield ()
        for n in range(1, len(b) + 1):
            if b[:n] in ids:
                for rest in paths(b[n:]):
                    yield (b[:n], *rest)

    for text in ("    if", "a  \n   b", " x   "):
        mass = {s: math.exp(sum(p.log_weight[ids[x]] for x in s)) for s in paths(text.encode())}
        drawn = Counter(tuple(p.spelled[i] for i in x) for x in pieces.sample_batch(p, [text] * 20_000, list(range(20_000)), 1))
        assert set(drawn) <= set(mass) and any(b"  " in s for s in drawn)
        for s, m in mass.items():
            share = m / sum(mass.values())
            assert abs(drawn[s] / 20_000 - share) < 5 * math.sqrt(share * (1 - share) / 20_000) + 1e-4
    spaces = [b" " * n for n in range(2, 17) if b" " * n in ids]
    drawn = {p.spelled[i] for x in pieces.sample_batch(p, [b.decode() for b in spaces] * 2000, list(range(2000 * len(spaces))), 1) for i in x}
    assert len(spaces) == 14
    assert set(spaces) <= drawn


def toxic_table(spark, n=400):
    rng = np.random.default_rng(9)
    docs, labels = [], []
    for i in range(n):
        w = [f"w{x}" for x in rng.integers(0, 200, 60)]
        toxic = i % 5 == 0
        if toxic:
            w[3], w[17] = "Idiot,", f"scum{'!' * (i % 3)}"
        docs.append((i, " ".join(w)))
        labels.append((i, int(i % 10 != 0), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_generalises_and_orders_grades(spark):
    docs, labels = toxic_table(spark)
    model = toxicity.fit(docs, labels.where("doc_id < 250"), toxicity.Settings(steps=40))
    assert model.thresholds[0] <= model.thresholds[1]
    out = toxicity.score_documents(docs, model).collect()
    assert all(r.rejected == (r.doc_id % 5 == 0) for r in out if r.doc_id >= 250)
    assert all(r.severity.p_toxic >= r.severity.p_severe and math.isclose(r.severity.expected_severity, r.severity.p_toxic + r.severity.p_severe) for r in out)


def test_toxicity_of_odd_rows(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(3, 1, 1), (4, None, 0), (None, 1, 1), (5, 1, None), (77, 0, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.without_toxic(docs, labels, toxicity.Settings(steps=3))
    assert out.columns == docs.columns and out.where("doc_id = 1").count() == 1
    assert toxicity.without_toxic(docs, labels.where("doc_id > 99")).count() == docs.count()
    assert toxicity.without_toxic(no_docs(spark), labels).count() == 0


def test_ordinal_likelihood_and_gradient_equal_brute_force():
    rng = np.random.default_rng(4)
    lists = [np.unique(rng.integers(0, 30, rng.integers(0, 9))) for _ in range(40)]
    grade = rng.integers(0, 3, 40)
    weights, thresholds = rng.normal(0, 1, 30), np.array([0.3, 1.1])

    def value(w, t):
        out = 0.0
        for x, g in zip(lists, grade):
            ge = [1.0, *(1 / (1 + math.exp(-(sum(w[i] for i in x) - k))) for k in t), 0.0]
            out += math.log(ge[g] - ge[g + 1])
        return out

    owner, place = np.repeat(np.arange(40), [len(x) for x in lists]), np.concatenate(lists)
    got, gradient = toxicity.likelihood(weights, thresholds, place, owner, grade)
    assert math.isclose(got, value(weights, thresholds))
    whole = np.concatenate([weights, thresholds])
    for i in range(32):
        up, down = whole.copy(), whole.copy()
        up[i], down[i] = up[i] + 1e-5, down[i] - 1e-5
        assert math.isclose(gradient[i], (value(up[:30], up[30:]) - value(down[:30], down[30:])) / 2e-5, rel_tol=1e-4, abs_tol=1e-6)


def test_registered_toxicity_equals_its_model_by_hand(spark, tmp_path):
    docs = generated(spark, 120).unionByName(odd_docs(spark).select("doc_id", "text").where("doc_id is null"))
    labels = docs.where("doc_id is not null").select("doc_id", (F.col("doc_id") % 3).cast("int").alias("quality"), F.col("text").contains("w1").cast("int").alias("toxic"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    model = toxicity.fit(docs, labels)
    weight = dict(zip(model.features.tolist(), model.weights.tolist()))
    out = toxicity.op2_toxicity(spark, str(tmp_path)).collect()
    assert len(out) == docs.count() and model.thresholds[0] < model.thresholds[1]
    text = texts(docs)
    for r in out:
        if r.doc_id is not None:
            margin = sum(weight.get(i, 0.0) for i in toxicity.features_of(text[r.doc_id], model.bits).tolist())
            p = [1 / (1 + math.exp(-max(-40, min(40, margin - t)))) for t in model.thresholds]
            assert abs(r.p_toxic - p[0]) < 1e-4 and abs(r.expected_severity - sum(p)) < 1e-4 and r.rejected == (r.p_toxic >= 0.5)


def test_blockwise_expectations_equal_plain_ones():
    rng = np.random.default_rng(6)
    m = lm.Model(np.array([0.3, 0.7]), np.array([[0.9, 0.1], [0.2, 0.8]]), rng.dirichlet(np.ones(5), 2).T)
    n = 300
    obs = rng.integers(0, 5, (n, 1))
    start, move, emit = np.zeros(2), np.zeros((2, 2)), np.zeros((5, 2))
    total = lm._expected(m, np.array([n]), obs, start, move, emit)  # blocks of 64 steps
    a, b = np.zeros((n, 2)), np.ones((n, 2))
    scale = np.zeros(n)
    for t in range(n):
        a[t] = (m.start if t == 0 else a[t - 1] @ m.move) * m.emit[obs[t, 0]]
        scale[t] = a[t].sum()
        a[t] /= scale[t]
    for t in range(n - 2, -1, -1):
        b[t] = m.move @ (m.emit[obs[t + 1, 0]] * b[t + 1]) / scale[t + 1]
    assert math.isclose(total, np.log(scale).sum()) and np.allclose(start, a[0] * b[0])
    assert np.allclose(move, sum(m.move * np.outer(a[t], m.emit[obs[t + 1, 0]] * b[t + 1] / scale[t + 1]) for t in range(n - 1)))
    assert np.allclose(emit, [(a * b)[obs[:, 0] == c].sum(0) for c in range(5)])


def test_top_k_prunes_clustered_vectors_and_takes_empty_ones(spark):
    rng = np.random.default_rng(9)
    centers = rng.normal(0, 1, (40, 16))
    data = [(i, np.floor(256 * (centers[i % 40] + rng.normal(0, 0.02, 16))).tolist()) for i in range(4000)]
    rows = spark.createDataFrame(data, "id long, vec array<double>")
    s = topk.Settings(sample=512, leaf_rows=64)
    x = np.array([v for _, v in data])
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(rows, rows.where("id % 50 = 0"), 5, s).collect()}
    for q in range(0, 4000, 50):
        score = x @ x[q]
        best = sorted((-score[i], i) for i in range(4000) if i != q)[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, int(-v)) for v, i in best]
    assert topk.pruned_share(rows, rows.where("id % 50 = 0"), 5, s) > 0.8
    empty = spark.createDataFrame([(0, []), (50, [])], "id long, vec array<double>")
    assert [tuple(r) for r in topk.top_k(empty, empty).orderBy("query_id").collect()] == [(0, 1, 50, 0), (50, 1, 0, 0)]


def test_top_k_scores_are_exact_over_the_range_of_a_long(spark):
    big = 256000001.0
    rows = [(1, [big, 0.0]), (2, [big, 0.0]), (3, [big, 1.0]), (4, [big, 2.0]), (5, [-big, 0.0]), (6, [big - 1, 0.0]), (7, [big, -1.0])]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    got = defaultdict(list)
    for r in topk.top_k(df, df, 3).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    product = lambda a, b: sum(int(x) * int(y) for x, y in zip(a, b))
    for i, v in rows:
        want = sorted(((j, product(v, w)) for j, w in rows if j != i), key=lambda x: (-x[1], x[0]))[:3]
        assert got[i] == want
    with pytest.raises(ValueError, match="too large"):
        topk.top_k(spark.createDataFrame([(1, [4e9]), (2, [1.0])], "id long, vec array<double>"), df)
