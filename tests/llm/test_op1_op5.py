import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairlens.llm import _labels, _words, quality, toxicity


def brute_segments(scores):
    """All maximal-scoring segments by definition: the best one, then the same on both sides."""

    def go(low, high):
        best = None
        for a in range(low, high):
            for b in range(a + 1, high + 1):
                s = sum(scores[a:b])
                if s > 1e-12 and (best is None or s > best[2] + 1e-12):
                    best = (a, b, s)
        if best is None:
            return []
        return [*go(low, best[0]), best, *go(best[1], high)]

    return go(0, len(scores))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-9, 9).filter(bool), max_size=12))
def test_segments_are_the_maximal_ones(values):
    scores = [v + i * 1e-4 for i, v in enumerate(values)]
    got = toxicity.maximal_segments(np.array(scores, float))
    want = brute_segments(scores)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert np.allclose([x[2] for x in got], [x[2] for x in want])


def test_segments_take_linear_time():
    import time

    falling = np.tile([1.0, -1.5], 300_000)  # every candidate lies below all earlier ones
    rising = np.tile([1.5, -1.0], 300_000)
    began = time.time()
    assert len(toxicity.maximal_segments(falling)) == 300_000
    assert len(toxicity.maximal_segments(rising)) == 1
    assert time.time() - began < 30


def test_rate_solves_its_equation():
    p, s = np.array([0.2, 0.7, 0.1]), np.array([1.0, -1.0, 2.0])
    assert abs((p * np.exp(toxicity._rate(p, s) * s)).sum() - 1) < 1e-6


def test_logistic_regression():
    x = np.linspace(-80, 80, 400)[:, None]
    for y in (x[:, 0] > 10, x[:, 0] + 30 * np.sin(np.arange(400)) > 10):  # separable and not
        w = toxicity.logistic(np.column_stack([x, np.log1p(np.maximum(x, 0))]), y.astype(float))
        said = np.column_stack([x, np.log1p(np.maximum(x, 0)), np.ones(400)]) @ w > 0
        assert (said == y).mean() > 0.85
    w = toxicity.logistic(x, (x[:, 0] > 10).astype(float))
    assert abs(-w[1] / w[0] - 10) < 2


def corpus(spark):
    r = random.Random(3)
    plain = [f"{a}{b}" for a in "the of and ra mo li ta".split() for b in ("", "n", "st", "er", "ing")]
    docs, labels = [], []
    for i in range(400):
        words = [r.choice(plain) for _ in range(r.randint(5, 60))]
        toxic, bad = i % 8 == 0, i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), "vile" + r.choice(["", "st", "ness", "ly"]))
        text = " ".join(words)
        docs.append((i, " | ".join(words).upper() + "!!" if bad else text))
        labels.append((i, int(not bad), int(toxic)))
    docs += [(1000, None), (1001, ""), (1002, "vilewhatever vile thing vileish " * 3), (1002, "vilewhatever vile thing vileish " * 3), (None, "the and")]
    return spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit(b"x")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_a_small_corpus(spark):
    docs, labels = corpus(spark)
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(rows) == 405 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    wrong = [r.doc_id for r in rows if r.doc_id is not None and r.doc_id < 1000 and r.predicted != (r.doc_id % 8 == 0)]
    assert len(wrong) <= 4
    by = {r.doc_id: r for r in rows}
    assert len({r.score for r in rows if r.doc_id == 1002}) == 1 and by[1002].predicted == 1 and by[1002].passages and not by[1000].predicted and not by[1001].predicted and not by[None].predicted


def test_quality_on_a_small_corpus(spark):
    docs, labels = corpus(spark)
    rows = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(rows) == 405 and all(0 <= r.score <= 1 for r in rows)
    wrong = [r.doc_id for r in rows if r.doc_id is not None and r.doc_id < 1000 and r.predicted != (r.doc_id % 5 != 0)]
    assert len(wrong) <= 4
    assert {r.predicted for r in rows if r.doc_id in (1000, 1001)} == {1}


@pytest.mark.parametrize("module", [toxicity, quality])
def test_empty_tables(spark, module):
    docs, labels = corpus(spark)
    assert module.fit(docs, labels.limit(0)) is None
    assert {r.predicted for r in module.score(docs, None).collect()} == {int(module is quality)}
    model = module.fit(docs, labels)
    assert module.score(docs.limit(0), model).count() == 0
    assert module.fit(docs.limit(0), labels) is None


def brute_counts(text):
    """Byte trigrams and bigrams of the words' recency, by definition."""
    out = np.zeros(quality.WIDTH, np.float32)
    raw = (text or "").encode()
    for i in range(len(raw) - 2):
        h = ((raw[i] * 0x01000193 & 0xFFFFFFFF) ^ raw[i + 1]) * 0x01000193 & 0xFFFFFFFF ^ raw[i + 2]
        out[(h * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - (quality.TRIGRAMS.bit_length() - 1))] += 1
    seen, kinds = {}, []
    for i, word in enumerate(re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), raw))):
        kinds.append(min(quality.CLASSES - 1, 1 + (i - seen[word] - 1).bit_length()) if word in seen else 0)
        seen[word] = i
    for a, b in zip(kinds, kinds[1:]):
        out[quality.TRIGRAMS + a * quality.CLASSES + b] += 1
    return out


@pytest.mark.parametrize("piece", [1 << 21, 8])
def test_terms_equal_brute_force(monkeypatch, piece):
    real = _words.chunks
    monkeypatch.setattr(quality, "PIECE", piece)
    monkeypatch.setattr(_words, "chunks", lambda raw, offsets: real(raw, offsets, piece))
    texts = ["", "Repeat repeat word!! | 12 é", None, "aa aa " * 40, "x", "one two three one two three " * 30, "ab", "東京 " * 9]
    assert np.array_equal(quality.term_counts(pa.array(texts)), np.array([brute_counts(t) for t in texts]))


def test_texts_over_two_megabytes_count_whole():
    long = "of the people and the town " * 90_000 + "the end"
    assert len(long) > _words.CHUNK_BYTES
    assert np.array_equal(quality.term_counts(pa.array(["x", long, "y"]))[1], brute_counts(long))
    rows, found = toxicity._tokens(pa.array(["x", long, "y"]))
    assert np.bincount(rows).tolist() == [1, len(long.split()), 1] and len(set(found["word"].tolist())) == 2 + len(set(long.split()))


def test_tokens_count_once_a_document(spark):
    """A word has one vote a document, also where the document is read in pieces."""
    long = "of the people " * 200_000
    df = spark.createDataFrame([(long, 0, 1), ("the end", 1, 0)], "text string, fold int, label int")
    rows = toxicity.token_counts(df).collect()
    assert sorted((r.c00, r.c01, r.c10, r.c11) for r in rows) == [(0, 0, 1, 0), (0, 1, 0, 0), (0, 1, 0, 0), (0, 1, 1, 0)]


def test_beginnings_are_characters():
    _, found = toxicity._tokens(pa.array(["ñandú", "ñand", "東京東京東京東京", "東京東京東京", "東京東京", "ab"]))
    word, six, four = (found[k].tolist() for k in ("word", "six", "four"))
    assert four[0] == word[1] and six[0] == word[0] and six[2] == word[3] and four[2] == word[4] and word[5] == six[5] == four[5]


def test_nested_log_odds():
    counts = {"four": [(1, 1, [40, 30])], "six": [(2, 1, [40, 10]), (1, 1, [0, 20])], "word": [(1, 1, [0, 20]), (3, 2, [40, 5])]}
    tables = {k: (np.array([x[0] for x in sorted(v)], np.uint64), np.array([x[1] for x in sorted(v)], np.uint64), np.array([x[2] + [0, 0] for x in sorted(v)])) for k, v in counts.items()}
    model = toxicity._learn_tokens(np.array([1000.0, 500.0, 0, 0]), tables, (0,))
    k, base = toxicity.PRIOR, np.log(0.5)

    def posterior(c0, c1, prior):
        share = 1 / (1 + np.exp(-(prior + base)))
        return np.log((c1 + k * share) / (c0 + k * (1 - share))) - base

    four = posterior(40, 30, 0)
    six = posterior(40, 10, four)
    assert np.allclose(model.levels["four"][1], [four]) and np.allclose(model.levels["six"][1], [four, six]) and np.allclose(model.levels["word"][1], [four, posterior(40, 5, six)])
    assert toxicity._learn_tokens(np.array([1000.0, 500.0, 0, 0]), tables, (1,)) is None


def test_equal_neighbours_vote_in_order():
    counts = np.tile(brute_counts("the same words here"), (60, 1))
    model = quality.learn(counts, np.arange(60) >= 30, np.ones(quality.WIDTH, np.float32))
    assert quality.vote(model, counts[:3]).tolist() == [0, 0, 0]


def test_votes_equal_brute_force():
    r = np.random.default_rng(1)
    counts = r.poisson(0.05, (300, quality.WIDTH)).astype(np.float32)
    model = quality.learn(counts[:100], np.arange(100) % 3 > 0, np.ones(counts.shape[1], np.float32))
    got = quality.vote(model, counts)
    for i in range(0, 300, 17):
        v = quality._weighted(counts[i : i + 1], model.idf) @ model.axes
        cos = (model.vectors @ (v / np.linalg.norm(v)).T)[:, 0]
        top = np.argsort(-cos)[: quality.NEIGHBOURS]
        w = np.maximum(cos[top].astype(float), 0) ** quality.POWER
        assert abs(got[i] - (w * model.labels[top]).sum() / w.sum()) < 1e-4


def test_held_out_rows_are_not_learned_from(spark, sf):
    import zlib

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    used = _labels.labelled_sample(labels, "toxic", 1000).collect()
    assert used and all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in used)
    assert len(_labels.labelled_sample(labels, "toxic", 7).collect()) == 7


@pytest.mark.parametrize("query, column", [(toxicity.op1_toxicity, "toxic"), (quality.op5_quality, "quality")])
def test_held_out_accuracy(spark, query, column):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r[column] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = query(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    pairs = [(labels[r.doc_id], r.predicted, r.score) for r in rows if r.held_out and r.doc_id in labels]
    accuracy = sum(a == b for a, b, _ in pairs) / len(pairs)
    recall = [sum(b == k for a, b, _ in pairs if a == k) / max(1, sum(a == k for a, *_ in pairs)) for k in (0, 1)]
    print(column, len(pairs), "accuracy", accuracy, "recall of 0 and 1", recall)
    assert accuracy > 0.97 and min(recall) > 0.85
