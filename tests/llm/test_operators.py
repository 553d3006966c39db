"""The training-data operators against brute force on small fixtures with nulls, blanks, ties, repeated rows and clashing columns."""

import hashlib
import itertools
import os
import random
import re
import time
import tracemalloc
import zlib
from array import array
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quarry.llm import common, gru, license_scan, lm_scoring, near_dedup, nearest, packing, quality_rules, secret_scan, sentencepiece_codec, substring_dedup, token_output
from quarry.llm.queries import BYTE_BPE, PIECES, VOCABULARIES

WORDS = "alpha beta gamma delta omega the of and in to river stone light über café señor naïve wind glass".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (str(r.randint(0, 99)) if r.random() < 0.3 else "") for _ in range(n))


LONG = prose(1, 4000)
TEXTS = [None, "", "  \n ", "word", "two words", prose(2, 120), prose(2, 120), prose(2, 119) + " changed", LONG, LONG + " tail", "x " * 300, "a▁b <|endoftext|> \x1c…\n\n  z", prose(3, 80) + " " + prose(9, 60), prose(4, 70) + " " + prose(9, 60) + " end", "password = hunter22 AKIA" + "A1" * 9 + " 0123456789abcdef0123456789 token: ab"]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5]), (None, prose(5, 60))]
SCHEMA = "doc_id long, text string, lang string, start int, ids string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None if i is None else "en", 7, "clash", len(t or "")) for i, t in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def le(ids) -> bytes:
    return array("I", ids).tobytes()


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTE_BPE)


def test_token_files(docs, empty, tokenizer):
    rows = token_output.token_output(docs, BYTE_BPE).collect()
    assert len(rows) == len(ROWS)
    start = 0
    for row, (_, text) in zip(sorted(rows, key=lambda r: r["start"]), sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(ids), zlib.crc32(le(ids)))
        start += len(ids)
    assert token_output.token_output(empty, BYTE_BPE).count() == 0


def test_chunks_encode_as_whole_texts(tokenizer):
    own, r = token_output.ChunkEncoder(BYTE_BPE), random.Random(3)
    parts = [*"ab Tz.,'’s\n\t éß١²Ⅷж́ \x1c\x85!#_9|", "'s ", " the", " don't", "<|endoftext|>", "  ", ". ", ",\n"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    assert own.encode(texts) == [le(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def test_secrets(docs, empty):
    for row in secret_scan.scan_digest(docs).collect():
        if row["doc_id"] is None:
            continue
        text = TEXTS[row["doc_id"]] or ""
        spans = [("assign", *m.span()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
        spans += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20] + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        count = Counter(s[0] for s in spans)
        spans.sort(key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))
        assert row["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert (row["n_assign"], row["n_access"], row["n_hex"]) == (count["assign"], count["access"], count["hex"])
    assert secret_scan.scan_digest(empty).count() == 0
    assert "hunter22" not in {r["doc_id"]: r["text"] for r in secret_scan.redact(docs).collect()}[14]


def test_entropy_windows_by_definition():
    r = random.Random(5)
    for _ in range(50):
        text = "".join(r.choice("0123456789abcdef") for _ in range(60)) + "a" * r.randint(0, 30)
        held = set()
        for i in range(len(text) - 19):
            n = Counter(text[i : i + 20])
            if -sum(c / 20 * np.log2(c / 20) for c in n.values()) > 3.0 + 1e-12:
                held |= set(range(i, i + 20))
        assert held == {i for a, b in secret_scan.windows(text, 3.0) for i in range(a, b)}
    assert not secret_scan.entropy_spans("123e4567-e89b-12d3-a456-426614174000") and not secret_scan.entropy_spans("EXAMPLE7f3a9c1e5b2d8f4a6c0e")


def test_allow_list_spares_only_what_it_matches():
    key = "q7Zk2Rv9Lw4Xc8Nb5Tm1"
    uuid = "123e4567-e89b-12d3-a456-426614174000"
    for before in ("/sample/", uuid, f"{key}{key[::-1]}AbTeStCd{key}"):
        spans = secret_scan.entropy_spans(before + key)
        assert any(a <= len(before) and b >= len(before) + len(key) for _, a, b in spans)
    assert not secret_scan.entropy_spans("sample" + key) and not secret_scan.entropy_spans(f"/items/{uuid}")


def test_secrets_behind_keys_and_names():
    r = random.Random(9)
    for before in ("key=", "key_", "latest-", "contest/", "123e4567-e89b-12d3-a456-426614174000/", "sk_test_"):
        found = [secret_scan.entropy_spans(before + "".join(r.choice("0123456789abcdef") for _ in range(40))) for _ in range(200)]
        assert sum(any(b > len(before) + 30 for _, _, b in spans) for spans in found) >= 198
    assert not secret_scan.entropy_spans("the_quick-brown/fox=jumps_over_the-lazy-dog") and not secret_scan.entropy_spans("1234567890" * 4)


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words)} if 0 < len(words) < k else {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def test_near_duplicates(spark, docs, empty):
    base = prose(20, 150).split()
    r, rows = random.Random(7), [(i, t) for i, t in enumerate(TEXTS)]
    for i in range(60):
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = f"new{r.randint(0, 999)}"
        rows.append((100 + i, " ".join(w)))
    found = {r["doc_id"]: r for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets, root = {i: shingles(t, 3) for i, t in rows}, {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in found.items()} == {i: (len(sets[i]), top(i), top(i) == i) for i in sets}
    rows = near_dedup.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS) and [r["kept"] for r in rows if r["doc_id"] is None] == [True]
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_duplicates_of_repeated_rows(spark):
    find = lambda x: {tuple(v) for v in near_dedup.near_duplicates(spark.createDataFrame(x, "doc_id long, text string")).collect()}
    x, y = prose(70, 90), prose(71, 90)
    assert {v[2] for v in find([(3, x), (5, x), (5, x), (5, y), (7, y)])} == {3}
    # the last step alone, on a text that is there twice
    nodes = spark.createDataFrame([(1, 1), (2, 2)], "node long, component long")
    a = " ".join(f"w{i}" for i in range(300))
    texts = spark.createDataFrame([(1, a), (1, a), (2, a + " tail")], "node long, text string")
    assert near_dedup.prefix_pairs(nodes, texts, 3, 85).count() == 1


def test_licences(spark, docs, empty):
    import duckdb

    texts = [None, "", "Released under the MIT License.", "MIT LicenKe cc by x", "This work is licensed under a Creative Commons Attribution 4.0 International License", "filler " * 90 + "Licensed under the Apache License, Version 2.0. GNU General Public License; gnu general public license", "cc-by"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    documents = frame.toPandas()  # noqa: F841
    wanted = duckdb.sql(license_scan.scan_sql()).df().sort_values("doc_id").reset_index(drop=True)
    found = license_scan.scan(frame).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert found.astype(object).where(found.notna(), None).values.tolist() == wanted[found.columns].astype(object).where(wanted[found.columns].notna(), None).values.tolist()
    assert license_scan.scan(docs).count() == len(ROWS) and license_scan.scan(empty).count() == 0


def test_licence_labels(spark):
    mit = next(t for label, t in license_scan.TEMPLATES if len(t) > 900)
    words = mit.split()
    texts = {
        "cc-by": "Licensed under CC BY 4.0",
        "": "released under the license, and all minor rights are reserved",
        "cc-by ": "x y z This work is licensed under a Creative Commons Attribution 4.0 International License",
        "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "cc-by,cc-by-sa": "This work is licensed under a Creative Commons Attribution 4.0 International License; that work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "mit": " ".join(["pad"] * 300 + [w for i, w in enumerate(words) if i % 40 != 7] + ["pad"] * 900),
        " ": " ".join(["pad"] * 300 + words[: len(words) // 2]),
        "reserved": "all rights reserved",
    }
    found = license_scan.scan(spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string"))
    assert {r["doc_id"]: r["labels"] for r in found.collect()} == {i: k.strip() for i, k in enumerate(texts)}


def test_nearest(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(600, 16)).astype(np.float32)
    x[50:80] = x[50]
    bad = [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [1.0]), (None, [1.0] * 16)]
    rows = [(i, [float(v) for v in x[i]]) for i in range(600)] + bad
    found = {}
    for row in nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), block_rows=200).collect():
        found.setdefault(row["query_id"], {})[row["rank"]] = (row["vec_id"], row["score"])
    y, hits = x.astype(np.float64), 0
    assert sorted(found) == list(range(0, 600, 20))
    for q, ranked in found.items():
        score = y @ y[q]
        best = [int(i) for i in np.lexsort((np.arange(600), -score)) if i != q][:20]
        assert sorted(ranked) == list(range(1, 21)) and all(abs(score[i] - s) < 1e-9 for i, s in ranked.values())
        hits += len({i for i, _ in ranked.values()} & set(best))
    assert hits >= 0.9 * 20 * len(found)
    assert nearest.search(spark.createDataFrame(bad[:3], "vec_id long, embedding array<float>")).count() == 0


def test_packing(docs, empty, tokenizer):
    pieces, sequences = {}, {}
    for row in packing.pack(docs, BYTE_BPE, group_chars=20_000).collect():
        pieces.setdefault(row["doc_id"], []).append(row)
        sequences.setdefault(row["sequence_id"], []).append(row)
    for i, text in enumerate(TEXTS):
        ids, times = tokenizer.encode(text or "", add_special_tokens=False).ids + [1], 2 if i == 5 else 1
        own = sorted(pieces[i], key=lambda r: r["start"])
        assert sum(r["length"] for r in own) == times * len(ids)
        assert all(r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(le(ids[r["start"] : r["start"] + r["length"]])) for r in own)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 2048 or at & (at - 1) == 0
    assert packing.pack(empty, BYTE_BPE).count() == 0


def test_quality(docs, empty):
    for row in quality_rules.judge(docs, *VOCABULARIES).collect():
        text = (TEXTS[row["doc_id"]] if row["doc_id"] is not None else ROWS[-1][1]) or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams, held = Counter(zip(words, words[1:], words[2:])), set()
        for i in range(len(words) - 2):
            if grams[tuple(words[i : i + 3])] > 1:
                held |= {i, i + 1, i + 2}
        assert (row["n_words"], row["word_chars"], row["n_repeat_words"]) == (len(words), sum(map(len, words)), len(held))
        failed = len(words) < 50 or 100 * len(held) > 50 * len(words)
        assert row["base_failed"] == failed and not (failed and row["kept"])
    assert quality_rules.judge(empty, *VOCABULARIES).count() == 0
    assert quality_rules.keep(docs, *VOCABULARIES).columns == docs.columns


def test_language_model(docs, empty):
    rows = lm_scoring.score(docs, model_words=64, hot_words=20).collect()
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) + ["\n"]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in ROWS if not out(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    assert len(rows) == len(ROWS)
    for row in rows:
        t = tokens(TEXTS[row["doc_id"]] if row["doc_id"] is not None else ROWS[-1][1])
        assert (row["held_out"], row["n_tokens"], row["n_known"], row["train_tokens"]) == (out(row["doc_id"]), len(t), sum(w in c for w in t), n)
        assert row["base_score"] == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in t))
        assert row["score"] < 0
    assert lm_scoring.score(empty).count() == 0


def test_tokens_of_many_texts_are_not_held():
    texts = [" ".join(f"w{(i * 31 + j) % 5000}" for j in range(2000)) for i in range(100)]
    hot = [(f"w{i}", 5000 - i) for i in range(4900)]
    words = lm_scoring.Words(hot, 1 << 12)
    tracemalloc.start()
    rare, ranks, starts, lengths = lm_scoring._documents(words, texts)
    ids = words.ids(ranks)
    turns = sum(1 for _ in gru.windows(ids, starts, lengths, words.first))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    every = [t for x in texts for t in lm_scoring.tokens_of(x)]
    assert len(ranks) == len(every) == 100 * 2001 and turns > 100
    assert [t for x in rare for t in x] == [t for t in every if t not in words.rank] and all(len(x) == sum(t not in words.rank for t in lm_scoring.tokens_of(y)) for x, y in zip(rare, texts))
    assert peak < 40 * len(every)  # bytes a token


def test_gru_gradient_and_probabilities():
    r = np.random.default_rng(0)
    model = gru.Model(40, 0, width=4, per_class=8, counts=r.integers(1, 50, 40))
    ids, lengths = r.integers(0, 40, 30), np.array([12, 18])
    starts = np.cumsum(lengths) - lengths
    total = 0.0
    for w in range(40):  # the probabilities of a word after the same beginning sum to one
        total += np.exp(gru.document_scores(model, np.append(ids[:5], w), np.array([0]), np.array([6]))[0] - gru.document_scores(model, ids[:5], np.array([0]), np.array([5]))[0])
    assert total == pytest.approx(1, abs=1e-4)
    before = gru.document_scores(model, ids, starts, lengths).sum()
    trainer = gru.Trainer(model, rate=4.0)
    for _ in range(30):
        trainer.learn(ids, starts, lengths)
    assert gru.document_scores(model, ids, starts, lengths).sum() > before + 5


def test_gru_gradient_by_finite_differences():
    r = np.random.default_rng(3)
    model = gru.Model(40, 0, width=4, per_class=4, counts=r.integers(1, 50, 40))
    model.flat += r.normal(0, 0.3, model.flat.shape).astype(np.float32)
    word, before = r.integers(0, 40, (6, 5)), r.integers(0, 40, (6, 5))
    kept, h = (r.random((6, 5)) > 0.2).astype(np.float32), r.normal(0, 0.5, (4, 5)).astype(np.float32)

    def loss() -> float:
        states, _ = model.run(before, kept, h, False)
        return -float(model.score(states.transpose(0, 2, 1).reshape(-1, 4), word.reshape(-1)).astype(np.float64).sum())

    grad = np.zeros_like(model.flat)
    model.views(grad, "d_")
    states, saved = model.run(before, kept, h, True)
    _, d = model.score(states.transpose(0, 2, 1).reshape(-1, 4), word.reshape(-1), True, 1.0)
    model.back(before, kept, saved, np.ascontiguousarray(d.reshape(6, 5, 4)).transpose(0, 2, 1))
    for i in r.permutation(len(grad))[:250].tolist():
        was, eps = model.flat[i], np.float32(1e-2)
        model.flat[i] = was + eps
        up = loss()
        model.flat[i] = was - eps
        down = loss()
        model.flat[i] = was
        assert grad[i] == pytest.approx((up - down) / (2 * float(eps)), abs=2e-2, rel=2e-2)


def test_gru_scores_by_definition():
    r = np.random.default_rng(4)
    model = gru.Model(30, 3, width=5, per_class=2, counts=r.integers(1, 50, 30))
    model.flat += r.normal(0, 0.3, model.flat.shape).astype(np.float32)
    lengths = np.array([40, 1, 17, 3])
    ids, starts, w = r.integers(0, 30, lengths.sum()), np.cumsum(lengths) - lengths, 5
    sig = lambda x: 1 / (1 + np.exp(-x))
    for d, (at, n) in enumerate(zip(starts, lengths)):
        h, last, total = np.zeros(w), 3, 0.0
        for t in ids[at : at + n].tolist():
            x, g = model.embed[last] @ model.wx[:w] + model.wx[w], h @ model.wh
            z, u = sig(x[:w] + g[:w]), sig(x[w : 2 * w] + g[w : 2 * w])
            new = np.tanh(x[2 * w :] + u * g[2 * w :])
            h = z * h + (1 - z) * new
            c = int(model.class_of[t])
            outer, inner = np.append(h, 1) @ model.wc, np.append(h, 1) @ model.wo[c]
            total += outer[c] - np.log(np.exp(outer).sum()) + inner[model.place[t]] - np.log(np.exp(inner).sum())
            last = t
        assert gru.document_scores(model, ids, starts, lengths)[d] == pytest.approx(total, abs=1e-3)


def test_windows_of_few_tokens_go_through_the_softmax_together(monkeypatch):
    r = np.random.default_rng(5)
    model = gru.Model(300, 0, width=4, per_class=8, counts=r.integers(1, 50, 300))
    ids, lengths = r.integers(0, 300, 5000), np.array([4000, 900, 100])
    starts, sizes, score = np.cumsum(lengths) - lengths, [], gru.Model.score

    def counted(self, states, target, *rest):
        sizes.append(len(target))
        return score(self, states, target, *rest)

    monkeypatch.setattr(gru.Model, "score", counted)
    gru.document_scores(model, ids, starts, lengths)
    assert len(sizes) == 1 and sum(sizes) == 5000
    sizes.clear()
    trainer = gru.Trainer(model)
    trainer.learn(ids, starts, lengths)
    assert sum(sizes) == 5000 and all(x >= trainer.LEAST for x in sizes[:-1]) and trainer.step == len(sizes) <= 10
    # their gradients are those of each window by itself
    windows, h = [], np.zeros((4, 3), dtype=np.float32)
    for word, before, kept, there, _ in itertools.islice(gru.windows(ids, starts, lengths, 0), 3):
        states, saved = model.run(before, kept, h, True)
        h = states[-1]
        windows.append((word, before, kept, there, states, saved))
    trainer.add(windows)
    together = trainer.grad.copy()
    trainer.grad[:] = 0
    for window in windows:
        trainer.add([window])
    assert np.abs(together).max() > 1 and np.allclose(together, trainer.grad, atol=1e-4)


def test_hot_words(spark):
    r = random.Random(2)
    counts = {f"w{i}": int(1000 * r.random() ** 4) + 1 for i in range(500)}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    for most in (0, 1, 50, 499, 500, 1000):
        hot = lm_scoring.hot_of(frame, most)
        assert len(hot) <= most and hot == sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: len(hot)]
    assert len(lm_scoring.hot_of(frame, 500)) == 500 and lm_scoring.hot_of(frame.limit(0), 10) == []


def test_one_step_of_too_many_words(spark):
    rows = [(f"w{i:03d}", 5) for i in range(50)] + [("x", 1)]
    counts = spark.createDataFrame(rows, "word string, n long")
    assert lm_scoring.hot_of(counts, 8) == [(f"w{i:03d}", 5) for i in range(8)]
    assert len(lm_scoring.hot_of(counts, 60)) == 51 and lm_scoring.hot_of(counts.where("false"), 8) == []


@pytest.mark.parametrize("slots", [1, 3])
def test_copies_are_averaged_by_tokens(spark, slots):
    r = np.random.default_rng(3)
    copies = [(int(r.integers(1, 90)), r.normal(size=5)) for _ in range(10)]
    rows = [(piece, i % slots, n, bytearray((x[:3] if piece == 0 else x[3:]).astype("<f8").tobytes())) for i, (n, x) in enumerate(copies) for piece in (0, 1)]
    found = lm_scoring.averaged(spark.createDataFrame(rows, "piece int, slot int, seen long, x binary").repartition(4), slots)
    want = sum(n * x for n, x in copies) / sum(n for n, _ in copies)
    assert np.allclose(found, want, atol=1e-6)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_language_model_learns_however_its_input_is_dealt(spark):
    """On held-out documents the model beats word frequencies by a tenth of a decade a token, the same from 1 and from 32 partitions."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    gains = []
    for parts in (1, 32):
        told = lm_scoring.score(docs.repartition(parts)).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
        gains.append((told["s"] - told["b"]) / told["n"])
    assert min(gains) >= 0.1 and abs(gains[0] - gains[1]) < 0.01


def test_language_model_width():
    assert gru.Model(64, 0).width == 12


def test_sentencepiece(docs, empty):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for row in sentencepiece_codec.codec_digest(docs, PIECES).collect():
        text = TEXTS[row["doc_id"]] if row["doc_id"] is not None else ROWS[-1][1]
        ids = lib.encode(text or "", add_bos=True, add_eos=True)
        assert (row["n_tokens"], row["ids_sha256"], row["decoded_sha256"]) == (len(ids), hashlib.sha256(le(ids)).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())
    assert sentencepiece_codec.codec_digest(empty, PIECES).count() == 0
    table, r = sentencepiece_codec.ChunkTable(PIECES), random.Random(1)
    texts = ["".join(r.choice([*"ab .,\n\té½Ａ▁\0 中🙂", "  ", " the", "<s>"]) for _ in range(r.randint(0, 20))) for _ in range(2000)]
    assert table.encode(texts) == [le(lib.encode(t)) for t in texts]


def test_passages(spark, docs, empty):
    found = substring_dedup.passages(docs).collect()
    pairs = {(r["doc_id"], r["source_id"]) for r in found}
    assert (13, 12) in pairs and (9, 8) in pairs and not {r["doc_id"] for r in found} & {0, 1, 2, 3, 4, 12, 14}
    own = next(r for r in found if (r["doc_id"], r["source_id"]) == (13, 12))
    assert own["start"] <= 70 and own["stop"] >= 130 and own["identity"] >= 0.8
    assert substring_dedup.passages(empty).count() == 0
    shared = prose(31, 55).split()
    fuzzy = [w if i % 13 else "other" for i, w in enumerate(shared)]
    rows = [(1, prose(40, 100) + " " + " ".join(shared)), (2, prose(41, 90) + " " + " ".join(fuzzy) + " " + prose(42, 30)), (3, prose(43, 200))]
    frame = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    assert {(r["doc_id"], r["source_id"]) for r in substring_dedup.passages(frame).collect()} == {(2, 1)}
    cut = {r["doc_id"]: r for r in substring_dedup.cut_passages(frame).collect()}
    assert cut[1]["text"] == rows[0][1] and cut[3]["text"] == rows[2][1] and len(cut[2]["text"]) == cut[2]["n_chars"] < len(rows[1][1])


def test_passages_beyond_the_partners_of_a_seed(spark):
    stock = [" ".join(f"s{j}w{i}" for i in range(40)) for j in range(8)]
    r = random.Random(11)
    rows = [(1, [0]), (8, [0]), (2, [1]), (9, [1]), (5, [0, 1]), (6, [0, 1])] + [(100 + i, r.choices(range(8), k=r.randint(1, 4))) for i in range(40)]
    texts = {i: [prose(500 + i, 30).replace(" ", f"q{i} ")] + [stock[j] for j in parts] + [prose(900 + i, 30).replace(" ", f"z{i} ")] for i, parts in rows}
    texts[5][1:3], texts[6][1:3] = [stock[0] + " " + stock[1]], [stock[0] + " " + stock[1]]
    texts = {i: " ".join(parts).split() for i, parts in texts.items()}
    found = substring_dedup.passages(spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")).collect()
    seen, wanted, held = {}, set(), set()
    for i in sorted(texts):
        grams = [tuple(texts[i][p : p + 45]) for p in range(len(texts[i]) - 44)]
        wanted |= {(i, w) for p, g in enumerate(grams) if g in seen for w in range(p, p + 45)}
        for g in grams:
            seen.setdefault(g, i)
    for row in found:
        assert row["source_id"] < row["doc_id"] and row["stop"] - row["start"] >= 45
        if row["identity"] == 1.0 and row["stop"] - row["start"] == row["source_stop"] - row["source_start"]:
            assert texts[row["doc_id"]][row["start"] : row["stop"]] == texts[row["source_id"]][row["source_start"] : row["source_stop"]]
        held |= {(row["doc_id"], w) for w in range(row["start"], row["stop"])}
    assert wanted and wanted <= held


def edited(r: random.Random, words: list[str], rate: float) -> list[str]:
    """words with a share of them replaced, left out or followed by another."""
    out = []
    for w in words:
        x = r.random()
        out += [w] if x >= rate else [f"new{r.randint(0, 99)}"] if x < rate / 2 else [] if x < 3 * rate / 4 else [w, f"new{r.randint(0, 99)}"]
    return out


def test_fuzzy_passages_by_alignment(spark):
    r = random.Random(5)
    word = lambda: f"w{int(r.paretovariate(0.3)) % 3000}"
    rows, planted = [], []
    for i in range(60):
        passage = [word() for _ in range(r.randint(70, 140))]
        copy = edited(r, passage, 0.06)
        pad = lambda n: [word() for _ in range(n)]
        one, two = pad(r.randint(0, 80)), pad(r.randint(0, 80))
        rows += [(2 * i, one + passage + pad(20)), (2 * i + 1, two + copy + pad(20))]
        # by brute force: the share of words of the longest common subsequence
        row = [0] * (len(copy) + 1)
        for u in passage:
            last = 0
            for j, v in enumerate(copy, 1):
                last, row[j] = row[j], last + 1 if u == v else max(row[j], row[j - 1])
        if row[-1] >= 0.8 * max(len(passage), len(copy)) and len(copy) >= 45:
            planted.append((2 * i + 1, 2 * i, len(two), len(two) + len(copy)))
    found = substring_dedup.passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()
    held = {}
    for f in found:
        held.setdefault((f["doc_id"], f["source_id"]), set()).update(range(f["start"], f["stop"]))
    caught = sum(len(held.get((d, s), set()) & set(range(a, b))) >= 0.6 * (b - a) for d, s, a, b in planted)
    assert len(planted) >= 55 and caught >= 0.95 * len(planted)
    assert set(held) <= {(d, s) for d, s, _, _ in planted} | {(2 * i + 1, 2 * i) for i in range(60)}


def test_changed_passages_beyond_the_partners_of_a_seed(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "TILE", 2, raising=False)
    pieces = [" ".join(f"p{j}w{i}" for i in range(14)) for j in range(5)]
    pad = lambda i, x: " ".join(f"{x}{i}w{j}" for j in range(40))
    # each piece has other first and last documents; 50 to 54 hold all pieces with another word between them each, and no run of 45
    rows = [(at + j, f"{pad(at + j, 'a')} {piece} {pad(at + j, 'b')}") for at in (10, 20, 80, 90) for j, piece in enumerate(pieces)]
    rows += [(i, f"{pad(i, 'a')} {' '.join(f'{piece} n{i}v{j}' for j, piece in enumerate(pieces))} {pad(i, 'b')}") for i in range(50, 55)]
    found = substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len({tuple(r) for r in found})
    for i in range(51, 55):
        own = [r for r in found if r["doc_id"] == i]
        assert {r["source_id"] for r in own} == set(range(50, i)) and all(r["start"] <= 40 and r["stop"] >= 114 and 0.8 <= r["identity"] < 1 for r in own)
    assert {r["doc_id"] for r in found} == set(range(51, 55))


def test_changed_passages_at_later_places_of_their_seeds(spark):
    pieces = [" ".join(f"p{j}w{i}" for i in range(14)) for j in range(5)]
    pad = lambda i, x, n: " ".join(f"{x}{i}w{j}" for j in range(n))
    rows = [(at + j, f"{pad(at + j, 'a', 40)} {piece} {pad(at + j, 'b', 40)}") for at in (10, 20, 80, 90) for j, piece in enumerate(pieces)]
    # first come any two pieces, too far from each other for a passage, then the passage
    twos = lambda i: " ".join(f"{pieces[x]} {pad(i, f'c{x}{y}v', 12)} {pieces[y]} {pad(i, f'd{x}{y}v', 45)}" for x, y in itertools.combinations(range(5), 2))
    texts = {i: [twos(i), " ".join(f"{piece} n{i}v{j}" for j, piece in enumerate(pieces)), pad(i, "b", 40)] for i in (50, 51)}
    frame = spark.createDataFrame(rows + [(i, " ".join(x)) for i, x in texts.items()], "doc_id long, text string")
    start = len(texts[51][0].split())
    assert [(r["doc_id"], r["source_id"], r["start"], r["stop"]) for r in substring_dedup.passages(frame).collect()] == [(51, 50, start, start + 74)]


def test_one_word_over_and_over_gives_few_rows(spark):
    rows = [(i, f"{prose(60 + i, 20)} {'and ' * n}{prose(80 + i, 20)}") for i, n in enumerate((300, 250, 60))]
    found = substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for i, n in ((1, 250), (2, 60)):
        held = {w for r in found if r["doc_id"] == i for w in range(r["start"], r["stop"])}
        assert set(range(20, 20 + n)) <= held and sum(r["doc_id"] == i for r in found) <= 10


@pytest.mark.parametrize("period", [2, 3, 7])
def test_few_words_over_and_over_give_few_rows(spark, period):
    again = [f"again{j}" for j in range(period)]
    stretch = lambda n: " ".join((again * n)[:n])
    rows = [(i, f"{prose(60 + i, 20)} {stretch(n)} {prose(80 + i, 20)}") for i, n in enumerate((600, 500, 61))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring_dedup.passages(frame).collect()
    for i, n in ((1, 500), (2, 61)):
        held = {w for r in found if r["doc_id"] == i for w in range(r["start"], r["stop"])}
        assert set(range(20, 20 + n)) <= held and sum(r["doc_id"] == i for r in found) <= 20
    seeds = substring_dedup.seeds(frame.withColumnRenamed("doc_id", "doc"), 5, 8, 45)
    assert seeds.where("ends > 0").count() < 60 < seeds.count()


def test_stretches_hold_all_words_and_all_runs():
    r = np.random.default_rng(6)
    for period in range(1, 12):
        words = np.concatenate([r.integers(0, 1 << 40, 30), np.resize(r.integers(0, 3, period), 300), r.integers(0, 1 << 40, 50)]).astype(np.uint64)
        x = near_dedup.rolled(words * np.uint64(0x9E3779B97F4A7C15), 45)
        kept = substring_dedup.stretches(x, 45, 8)
        held = {w for p in np.flatnonzero(kept).tolist() for w in range(p, p + 45)}
        assert held == set(range(len(words))) and set(x[kept].tolist()) == set(x.tolist()) and (period > 8 or kept.sum() < 150)


def test_seeds_are_found_and_shuffled_once(spark):
    frame = spark.createDataFrame([(i, f"{prose(300 + i, 20)} {prose(77, 60)}", i) for i in range(50)], "doc long, text string, text_hash long")
    plans = []

    class Seen:
        def table(self, df, name):
            assert df.count() > 0
            df.write.format("noop").mode("overwrite").save()
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return df

        def drop(self, *_):
            pass

    for sample in (64, 1):  # without and with common seeds
        with pytest.MonkeyPatch.context() as m:
            m.setattr(substring_dedup, "SAMPLE", sample)
            plans.clear()
            substring_dedup.shared_seeds(Seen(), frame, 5, 8, 45)
            assert "ReusedExchange" in plans[0]


def test_workers_keep_tokenizers_only_while_tasks_use_them():
    key = quality_rules.WordTable, *VOCABULARIES
    task = lambda: list(common.slices(iter([])))
    task()
    table = quality_rules.word_table(*VOCABULARIES)
    encoder = token_output.encoder(BYTE_BPE)
    for _ in range(2 * common.UNUSED):
        task()
        assert token_output.encoder(BYTE_BPE) is encoder
    assert key not in common._kept and quality_rules.word_table(*VOCABULARIES) is not table


def test_scratch_tables_leave_no_shuffle_files(spark):
    def files() -> int:
        return sum(x.startswith("shuffle_") for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs() for _, _, names in os.walk(d.getPath()) for x in names)

    spark._jvm.System.gc()
    time.sleep(1)
    before = files()
    path = common.write_scratch(spark.range(1000).repartition(4).groupBy((F.col("id") % 7).alias("k")).count(), "shuffled")
    assert spark.read.parquet(path).count() == 7 and spark.conf.get(common.CLEANUP, "false") == "false"
    for _ in range(20):
        if (after := files()) <= before:
            break
        time.sleep(0.2)
    assert after <= before


def test_stage_cuts_changed_passages_that_share_no_partner(spark):
    import corpus_pipeline

    pieces = [" ".join(f"p{j}w{i}" for i in range(14)) for j in range(4)]
    pad = lambda i, x: " ".join(f"{x}{i}w{j}" for j in range(20))
    rows = [(at + j, f"{pad(at + j, 'a')} {piece} {pad(at + j, 'b')}") for at in (10, 90) for j, piece in enumerate(pieces)]
    rows += [(i, f"{pad(i, 'a')} {' '.join(f'{piece} n{i}v{j}' for j, piece in enumerate(pieces))} {pad(i, 'b')}") for i in (50, 51)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    cut = {r["doc_id"]: r["text"] for r in corpus_pipeline.passages(spark, frame, "").collect()}
    assert all(cut[i] == text for i, text in rows if i != 51) and not re.search(r"p\dw", cut[51]) and cut[51].startswith(pad(51, "a")) and cut[51].endswith(pad(51, "b"))


def test_words_beyond_both_ends_by_definition():
    r = np.random.default_rng(4)
    reach = substring_dedup.REACH
    for need in (1, 6, 15, 30):
        own, others = r.integers(0, 3, (2, reach)), r.integers(0, 3, (2, 400, reach))
        for side, x in zip(own, others):
            x[:] = np.where(r.random(x.shape) < r.random((400, 1)), side, x)
        wanted = [sum(substring_dedup.reach(side == x[i])[0] for side, x in zip(own, others)) >= need for i in range(400)]
        assert substring_dedup.hopeful(*own, *others, need).tolist() == wanted and any(wanted) and not all(wanted)


def test_common_seeds_are_dealt_and_change_nothing(spark, monkeypatch):
    stock = prose(77, 60)
    frame = spark.createDataFrame([(i, f"{prose(300 + i, 20)} {stock} {prose(700 + i, 20)}") for i in range(300)], "doc_id long, text string")
    plain = {tuple(r) for r in substring_dedup.passages(frame).collect()}
    monkeypatch.setattr(substring_dedup, "SAMPLE", 1)
    assert len(substring_dedup.common_seeds(substring_dedup.seeds(frame, 5, 8, 45))) > 3
    assert {tuple(r) for r in substring_dedup.passages(frame).collect()} == plain and {r[0] for r in plain} == set(range(1, 300))


def test_cutting_keeps_to_its_own_row(spark):
    stock = prose(88, 70)
    rows = [(1, stock + " " + prose(89, 20), 0), (2, prose(90, 20) + " " + stock, 1), (2, prose(91, 151), 2), (None, stock, 3), (3, None, 4), (2, prose(90, 20) + " " + stock, 5), (4, "", 6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, cut_id long").withColumn("start", F.lit(1)).withColumn("text_hash", F.lit("x"))
    cut = {r["cut_id"]: r["text"] for r in substring_dedup.cut_passages(frame).collect()}
    assert set(cut) == set(range(7)) and all(cut[i] == rows[i][1] for i in (0, 2, 3, 4, 6))
    assert len(cut[1].split()) <= 25 and cut[1] == cut[5]
    assert substring_dedup.cut_passages(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.cut_passages(frame.withColumn(substring_dedup.CUT[0], F.lit(1)))


def test_near_duplicates_leave_their_result_alone(spark, docs):
    place = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    near_dedup.near_duplicates(docs)
    before = set(os.listdir(place))
    near_dedup.near_duplicates(docs)
    assert [x.split("-")[0] for x in set(os.listdir(place)) - before] == ["near"]


def test_pipeline(spark, tmp_path, docs, tokenizer):
    """Each stage on what the one before kept, against its decisions in Python; the whole run against the stages."""
    import corpus_pipeline

    columns = ("doc_id", "text", "lang", "n_chars")
    docs.select(*columns).write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "substring_dedup", "secret_scan", "packing"]
    frames = [spark.read.parquet(str(tmp_path / "documents.parquet"))]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frames[-1], str(tmp_path)).write.parquet(str(tmp_path / name))
        frames.append(spark.read.parquet(str(tmp_path / name)))
    assert all(f.columns == frames[0].columns for f in frames[:-1])
    rows = [sorted(((r["doc_id"], r["text"]) for r in f.collect()), key=repr) for f in frames[:-1]]

    kept = Counter((r["doc_id"],) for r in quality_rules.judge(frames[0], *VOCABULARIES).where("kept").collect())
    assert Counter((i,) for i, _ in rows[1]) == kept and rows[1]

    sets = {i: shingles(t, 5) for i, t in rows[1] if i is not None}
    low = {i: i for i in sets}
    for _ in sets:
        for i, j in itertools.combinations(sets, 2):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low[i] = low[j] = min(low[i], low[j])
    assert rows[2] == sorted(((i, t) for i, t in rows[1] if i is None or low[i] == i), key=repr)

    found = substring_dedup.passages(frames[2]).collect()
    spans = {}
    for r in found:
        spans.setdefault(r["doc_id"], set()).add((r["start"], r["stop"]))
    cut = {i: t for i, t in rows[3] if i is not None}
    for i, t in rows[2]:
        if i in spans:
            words = list(re.finditer(r"[^\x20\x09-\x0D]+", t))
            gone = {w for a, z in spans[i] for w in range(a, z)}
            assert cut[i].split() == [m[0] for w, m in enumerate(words) if w not in gone]
        elif i is not None:
            assert cut[i] == t

    hidden = {r["doc_id"]: r["spans"] for r in secret_scan.scan_digest(frames[3]).collect() if r["doc_id"] is not None}
    clean = {i: t for i, t in rows[4] if i is not None}
    assert len(rows[4]) == len(rows[3])
    for i, t in cut.items():
        assert (clean[i] == t) == (hidden[i] == "")
    assert all(r["spans"] == "" for r in secret_scan.scan_digest(frames[4]).collect())

    pieces = {}
    for r in frames[5].collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    once = Counter(i for i, _ in rows[4])
    for i, t in clean.items():
        if once[i] > 1:  # repeated rows are packed each on its own
            continue
        n, at = len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1, 0
        for start, length, total in sorted(pieces[i]):
            assert (start, total) == (at, n)
            at += length
        assert at == n

    place = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(place))
    told = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(repr, told.collect())) == sorted(map(repr, frames[5].collect()))
    assert [x for x in set(os.listdir(place)) - before if x.startswith("stage-")] == [told.inputFiles()[0].split("/")[-2]]


assert public_tokenizers
