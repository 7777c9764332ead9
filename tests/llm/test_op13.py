import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from pairlens.llm import runs, simhash

SCHEMA = "doc_id long, text string, fp string, component_id string, anchor int"


def brute_fingerprint(text, size=3):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, bits=2):
    """id -> smallest id reachable, by comparing all."""
    ids = sorted(fps)
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in combinations(ids, 2):
        if (fps[a] ^ fps[b]).bit_count() <= bits:
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_the_code_is_perfect():
    syndrome, pattern, excess = simhash.code(2)
    assert len(syndrome) == 1 << 23 and ((excess == 0).sum(axis=1) == 1).all()
    words = np.random.default_rng(1).integers(0, 1 << 23, 500)
    assert (syndrome[words] >= 0).all() and (syndrome[words ^ pattern[syndrome[words], (excess[syndrome[words]] == 0).argmax(axis=1)]] == 0).all()


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_all_within_the_threshold_meet_at_home(bits):
    r = np.random.default_rng(bits)
    x = r.integers(0, 1 << 64, 40, dtype=np.uint64)
    _, home, at_home = simhash.anchors(x, 0)
    assert len(home) == 40 and at_home.all()
    for _ in range(200):
        y = x ^ np.uint64(sum(1 << int(b) for b in r.choice(64, bits, replace=False)))
        row, anchor, _ = simhash.anchors(y, bits)
        assert set(zip(range(40), home.tolist())) <= set(zip(row.tolist(), anchor.tolist()))


@pytest.mark.parametrize("piece, hashes", [(1 << 22, 1 << 16), (1, 1 << 16), (9, 2), (40, 3)])
def test_fingerprints_equal_brute_force(monkeypatch, piece, hashes):
    monkeypatch.setattr(runs, "PIECE", piece)
    monkeypatch.setattr(simhash, "HASHES", hashes)
    r = random.Random(5)
    texts = ["", " \n", "One", "one TWO", "One two  three", "É É é x \x0b y z"] + [" ".join(r.choice(["Ab", "c", "dé", "efgh"]) for _ in range(r.randint(1, 700))) + " " * r.randint(0, 3) for _ in range(30)]
    for t in texts:
        for size in (1, 3):
            assert simhash.fingerprint(t.encode(), size) == brute_fingerprint(t, size)


def test_counting_of_bits():
    h = np.random.default_rng(3).integers(0, 1 << 64, 1000, dtype=np.uint64)
    h[:600] = np.uint64(2**64 - 1)
    for n in (1, 254, 255, 256, 1000):
        assert simhash._set_bits(h[:n]).tolist() == [int((h[:n] >> np.uint64(b) & np.uint64(1)).sum()) for b in range(64)]


@pytest.mark.parametrize("block", [4096, 3])
def test_links_of_fingerprints(spark, monkeypatch, block):
    """Chains, crowds around one point and lonely ones, by brute force."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "CHUNK", 64 if block == 4096 else 5)
    r = random.Random(11)
    fps = [0, (1 << 64) - 1, 1 << 63]
    for _ in range(12):
        x = r.getrandbits(64)
        for _ in range(12):  # a walk: neighbours are linked, the ends are far apart
            x ^= sum(1 << b for b in r.sample(range(64), r.choice([1, 2, 2, 3, 4])))
            fps.append(x)
    centre = r.getrandbits(64)
    fps += [centre ^ (1 << b) for b in range(64)] + [r.getrandbits(64) for _ in range(100)]
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    classes = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3)
    joined = {r.c: r.component for r in simhash.components(simhash.links(classes, 2)).collect()}
    got = {f: joined.get(s, s) for f, s in zip(fps, signed)}
    want = brute_components(dict(enumerate(fps)))
    assert len({(got[f], want[i]) for i, f in enumerate(fps)}) == len(set(want.values())) == len(set(got.values()))


def test_query_of_odd_rows(spark, tmp_path):
    r = random.Random(2)
    base = [f"w{r.randrange(500)}" for _ in range(400)]
    near = [" ".join(base[:i] + ["other"] + base[i + 1 :]) for i in range(0, 400, 20)]
    texts = [" ".join(base), " ".join(base).upper(), "  ".join(base), None, "", " \t", "one", "ONE", "one two", *near, "long " * 50_000, "b a " * 9]
    rows = [(i + 10, t, "x", "y", 1) for i, t in enumerate(texts)] + [(None, "one", None, None, None), (10, "another text of some words", "", "", 0), (11, texts[1], "", "", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(x) for x in simhash.op13_simhash(spark, str(tmp_path)).collect()), key=str)
    keyed = {(i, f): (i, f) for i, f in ((i, brute_fingerprint(t)) for i, t, *_ in rows) if i is not None}
    order = {k: n for n, k in enumerate(sorted(keyed))}
    groups = brute_components({order[k]: k[1] for k in keyed})
    back = sorted(keyed)
    want = sorted(((i, f"{brute_fingerprint(t):016x}", None if i is None else back[groups[order[i, brute_fingerprint(t)]]][0]) for i, t, *_ in rows), key=str)
    assert got == want
    parts = dict((r[0], r[2]) for r in got if r[0] != 10)
    assert parts[12] == 10 and parts[13] == parts[14] == parts[15] and parts[17] == 16


def test_query_without_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert simhash.op13_simhash(spark, str(tmp_path)).count() == 0


def test_query_over_the_test_table(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    fps = {i: brute_fingerprint(t) for i, t in docs.items() if len(t or "") < 20_000}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op13_simhash(spark, sf).collect()}
    assert len(got) == len(docs) and all(got[i][0] == f"{f:016x}" for i, f in fps.items())
    want = brute_components({i: int(f, 16) for i, (f, _) in got.items()})
    assert {i: c for i, (_, c) in got.items()} == want and len(set(want.values())) < len(want)
