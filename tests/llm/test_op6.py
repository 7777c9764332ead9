import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairlens.llm import neardup


def shingles(text, size=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def brute(docs, percent=80, size=4):
    sets = {i: shingles(t, size) for i, t in docs}
    ids = sorted(sets)
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                a_top, b_top = sorted((find(a), find(b)))
                top[b_top] = a_top
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\t\n\x0b\x1c 東", max_size=40)), max_size=8), st.integers(1, 6))
def test_set_sizes(texts, size):
    got = [len(s) for s in neardup.shingle_sets(pa.array(texts, pa.string()), size)]
    assert got == [len(shingles(t, size)) for t in texts]


def test_long_rows_are_cut_without_effect(monkeypatch):
    from pairlens.llm import _words

    texts = ["", "one two three four five " * 50, None, "x" * 300 + " y " + "z" * 500, " ", "a b"]
    whole = [s.tolist() for s in neardup.shingle_sets(pa.array(texts), 4)]
    real = _words.chunks
    monkeypatch.setattr(_words, "chunks", lambda raw, offsets: real(raw, offsets, 16))
    assert [s.tolist() for s in neardup.shingle_sets(pa.array(texts), 4)] == whole
    assert [s.tolist() for s in neardup.shingle_sets(pa.array(["q", *texts]).slice(1), 4)] == whole


def thue_morse(size):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(size))


@pytest.mark.parametrize("size", [16, 1024, 2048, 4096, 8192])
def test_words_of_structure_have_different_hashes(size):
    one = thue_morse(size)
    two = one.translate(str.maketrans("ab", "ba"))
    a, b = neardup.shingle_sets(pa.array([one, two]), 4)
    assert len(a) == len(b) == 1 and a[0] != b[0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=90), min_size=1, max_size=8), st.integers(0, 20))
def test_word_hashes_depend_on_the_bytes_only(spans, before):
    """The same bytes have one hash wherever they stand, others another."""
    from pairlens.llm import _words

    raw = np.frombuffer(b"x" * before + b"".join(spans), np.uint8)
    ends = before + np.cumsum([len(x) for x in spans])
    got = _words.hashes(raw, np.append(before, ends[:-1]), ends)
    alone = [_words.hashes(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))[0] for x in spans]
    assert got.tolist() == [int(x) for x in alone]
    assert len(set(got.tolist())) == len(set(spans))


@pytest.mark.parametrize("block, bits, part", [(1024, 1 << 28, 1 << 20), (3, 1 << 28, 20), (1024, 1, 1 << 20)])
def test_groups_equal_brute_force(spark, monkeypatch, block, bits, part):
    monkeypatch.setattr(neardup, "PART_LINKS", part)
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "CROWD", min(16, block))
    monkeypatch.setattr(neardup, "MAP_BITS", (1 << 16, bits))
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = []
    for base in range(12):
        words = [r.choice(vocabulary) for _ in range(r.randint(1, 120))]
        for _ in range(r.choice([1, 2, 5, 40])):
            copy = list(words)
            for _ in range(r.randint(0, 1 + len(copy) // 16)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            docs.append(" ".join(copy))
    docs += [None, "", " \t", "Same Text", "same  text", "same text", " "]
    r.shuffle(docs)
    rows = list(enumerate(docs, 100))
    df = spark.createDataFrame([(i, t, b"") for i, t in rows], "doc_id long, text string, keys binary")
    out = neardup.near_duplicates(df, size=4).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in out) == brute(rows)


def test_components_of_long_paths(spark, monkeypatch):
    """More links than a partition takes: rounds go on until nothing changes."""
    monkeypatch.setattr(neardup, "PART_LINKS", 32)
    path = [(i, i + 1) for i in range(300)] + [(1000 + i, 1000) for i in range(1, 60)] + [(5, 5)]
    random.Random(1).shuffle(path)
    got = {r.c: r.component for r in neardup.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, **{1000 + i: 1000 for i in range(1, 60)}}


def test_chain_and_edge_cases(spark):
    df = spark.createDataFrame([(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (3, "A b\tc d e"), (9, None)], "doc_id long, text string")
    out = neardup.near_duplicates(df, size=4).collect()
    assert sorted(((x.doc_id or -1, x.n_shingles, x.component_id or -1, x.kept) for x in out)) == [(-1, 2, -1, False), (3, 2, 3, True), (5, 2, 3, False), (5, 2, 3, False), (9, 0, 9, True)]
    assert neardup.near_duplicates(df.limit(0), size=4).count() == 0


def test_rows_that_share_an_id(spark):
    texts = {1: "one two three four five six seven", 2: "eight nine ten eleven twelve thirteen"}
    rows = [(7, texts[1], "x"), (7, texts[2], "y"), (7, texts[1], "x"), (8, texts[2], "z"), (9, "", "e"), (9, None, "e"), (None, texts[1], "n"), (None, texts[1], "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, k string")
    got = sorted((r.doc_id or -1, r.text or "") for r in neardup.deduplicated(df).collect())
    assert got == [(-1, texts[1]), (-1, texts[1]), (7, texts[2]), (7, texts[1]), (9, "")]
    assert neardup.deduplicated(df).columns == df.columns


def exact_links(docs, percent=80):
    """All links, by a prefix filter over shingles in order of rarity; independent of sketches."""
    sets = {i: shingles(t) for i, t in docs}
    number = {}
    for s in sets.values():
        for g in s:
            number[g] = number.get(g, 0) + 1
    index, links = {}, []
    for i, s in sorted(sets.items(), key=lambda x: len(x[1])):
        ranked = sorted(s, key=lambda g: (number[g], g))
        seen = set()
        for g in ranked[: len(s) - -(-len(s) * percent // 100) + 1]:
            if number[g] > 1:
                seen.update(index.get(g, ()))
                index.setdefault(g, []).append(i)
        links += [(i, j) for j in seen if 100 * len(s & sets[j]) >= percent * len(s | sets[j])]
    return links


def test_recall_over_all_true_links(spark):
    """Every true link of the bench tables lies within a group, and no group holds more than links reach."""
    sf = "/root/testdata/sf0.1"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    links = exact_links(docs)
    group = {r.doc_id: r.component_id for r in neardup.op6_neardup(spark, sf).collect()}
    found = sum(group[i] == group[j] for i, j in links)
    print("links", len(links), "recall", found / len(links))
    assert links and found >= 0.9 * len(links)
    top = {i: i for i, _ in docs}

    def find(i):
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for i, j in links:
        a, b = sorted((find(i), find(j)))
        top[b] = a
    assert all(find(i) <= c and find(c) == find(i) for i, c in group.items())


def test_query_on_the_smallest_tables(spark, sf):
    import duckdb

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = neardup.op6_neardup(spark, sf).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in out) == brute(docs)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    assert sorted(con.sql(neardup.ORACLE_SQL["op6_neardup"]).fetchall()) == brute(docs)


@pytest.mark.parametrize("outside, components", [(1, 1), (30, 30), (30, 1), (0, 0)])
def test_members_of_the_largest_component_are_copied_once(spark, monkeypatch, outside, components):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rows = [(0, 7, i, 0, 100) for i in range(800)] + [(0, 7, 1000 + i, 1 + i % max(1, components), 100) for i in range(outside)] + [(1, 7, i, i % 2, 100) for i in range(20)]
    cells = neardup._cells(spark.createDataFrame(rows, "order int, key long, c long, component long, n_shingles long")).collect()
    own = [r for r in cells if r.c < 800]
    blocks = -(-outside // 16)
    assert len(own) <= 800 * max(1, blocks) + 20 * 4 and max(sum(1 for r in cells if r.cell == k) for k in {r.cell for r in cells}) < 16 * 6
    # every pair of different components, but those within the largest one, meets in a cell
    met = set()
    by_cell = {}
    for r in cells:
        by_cell.setdefault(r.cell, []).append(r)
    for held in by_cell.values():
        met |= {frozenset((x.c, y.c)) for x in held for y in held if x.component != y.component and ((x.side == 2 and y.side == 2) or {x.side, y.side} == {0, 1})}
    members = [r[2:4] for r in rows if r[0] == 0]
    assert all(frozenset((a, b)) in met for a, p in members for b, q in members if p != q and a < b)
