import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairlens.llm import runs

SCHEMA = "doc_id long, text string, runs string, words string, collapsed string"


def brute(words, least=24, times=3):
    """By definition: every period, every stretch on which words that far apart are equal."""
    best = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                best.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in best.items())


def numbers(words):
    seen = {}
    return np.array([seen.setdefault(w, i) for i, w in enumerate(words)], np.int64)


def found(docs, least=24, times=3):
    return runs.runs_of(np.concatenate([numbers(w) for w in docs]), [len(w) for w in docs], least, times)


def made(r):
    words, k = [], r.choice([1, 2, 3, 5])
    for _ in range(r.randint(0, 6)):
        kind = r.random()
        if kind < 0.3:
            words += [r.randrange(k) for _ in range(r.randint(0, 30))]
        elif kind < 0.7:
            words += ([r.randrange(k) for _ in range(r.randint(1, 12))] * 60)[: r.randint(1, 60)]
        elif words:
            a = r.randrange(len(words))
            words += words[a : a + r.randint(1, 80)]
    return words


@pytest.mark.parametrize("least, times", [(24, 3), (6, 3), (6, 2), (9, 2), (12, 4)])
def test_equals_brute_force(least, times):
    r = random.Random(least * times)
    seen = 0
    for _ in range(250):
        docs = [made(r) for _ in range(r.randint(1, 6))]
        got = found(docs, least, times)
        assert got == [brute(w, least, times) for w in docs]
        seen += sum(map(len, got))
    assert seen > 500


def test_runs_within_blocks_are_copied():
    inner = [0] * 30 + list(range(1, 8))
    text = inner * 6 + [9] + inner * 2 + list(range(10, 40)) + inner[3:] + [1, 1]
    got = found([text])[0]
    assert got == brute(text) and sum(q == 1 for _, _, q in got) == 9 and any(q == 37 for _, _, q in got)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=90))
def test_any_words(words):
    assert found([words, words[::-1]], 6, 3) == [brute(words, 6), brute(words[::-1], 6)]


def test_suffixes_and_previous_factors():
    r = random.Random(3)
    docs = [made(r)[:80] for _ in range(40)]
    f = runs.Factors(np.concatenate([numbers(w) for w in docs]), [len(w) for w in docs])
    for d, words in enumerate(docs):
        a, n = int(f.bounds[d]), len(words)
        ids = numbers(words).tolist()
        assert (f.order[a : a + n] - a).tolist() == sorted(range(n), key=lambda i: ids[i:])
        longest, place = runs.previous_factors((f.order[a : a + n] - a).tolist(), f.lcp[a : a + n].tolist())
        for i in range(n):
            common = lambda j: next((k for k in range(n - i) if ids[i + k] != ids[j + k]), n - i)
            assert longest[i] == max((common(j) for j in range(i)), default=0)
            assert not longest[i] or place[i] < i and common(place[i]) >= longest[i]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text):
    """A row of the query, by definition."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    all_runs = brute(words)
    gone = {i for s, length, q in all_runs for i in range(s + q, s + length)}
    best = None
    for s, length, q in all_runs:
        if best is None or length * best[2] > best[1] * q:
            best = (s, length, q)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(all_runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest("".join(f"{s},{length},{q}\n" for s, length, q in all_runs)), digest(kept))


def rows():
    r = random.Random(8)
    line = "no such thing as a free lunch "
    texts = [None, "", " \t\n", "one", "a " * 23, "a " * 24, "A a " * 40, line * 3, line * 4 + "and\x0bthen\n" + line * 9, "é x " * 30, "ab " * 3000 + "c d " * 500]
    texts += [" ".join(f"w{r.randrange(40)}" for _ in range(r.randint(1, 400))) for _ in range(60)]
    return [(i, t, "x", "y", "z") for i, t in enumerate(texts)] + [(None, "a " * 30, None, None, None), (3, "b " * 30, None, None, None), (3, "one", None, None, None), (3, "one", None, None, None)]


@pytest.mark.parametrize("chunk", [1 << 18, 50])
def test_query_equals_brute_force(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(runs, "CHUNK", chunk)
    given_rows = rows()
    spark.createDataFrame(given_rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in runs.op11_runs(spark, str(tmp_path)).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted((expected(i, t) for i, t, *_ in given_rows), key=key)
    assert sum(r[1] for r in got) > 10


def test_operator_gives_runs_and_text(spark):
    df = spark.createDataFrame([(1, "x " + "a b c " * 20 + "y", "r")], "doc_id int, text string, runs string")
    got = runs.periodic_runs(df).first()
    assert [tuple(r) for r in got.runs] == [(1, 60, 3)] and got.collapsed == "x a b c y"
    assert runs.periodic_runs(df.limit(0)).count() == 0


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = b" one  two\tthree\x0bfour " * 50 + b"x" * 300 + b" end"
    whole = text.split()
    for size in (1, 7, 64):
        monkeypatch.setattr(runs, "PIECE", size)
        assert [w for part in runs.words_of(text) for w in part] == whole


def test_query_over_the_test_table(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r) for r in runs.op11_runs(spark, sf).collect()}
    short = {i: t for i, t in docs.items() if len((t or "").split()) < 1500}
    assert len(got) == len(docs) and len(short) > 150
    assert all(got[i] == expected(i, t) for i, t in short.items())
    assert sum(r[1] > 0 for r in got.values()) >= len(docs) // 20
