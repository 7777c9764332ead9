import math
import random
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pairlens.llm import packing


def optimum(sizes, capacity):
    """Fewest bins by exhaustive search."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= sizes[i] and rooms[j] not in rooms[:j]:
                go(i + 1, [*rooms[:j], rooms[j] - sizes[i], *rooms[j + 1 :]])
        go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 24), min_size=1, max_size=9))
def test_bound_is_below_the_optimum(sizes):
    least = optimum(sizes, 24)
    bins, offsets, free = packing.best_fit(np.array(sizes), 24)
    assert math.ceil(sum(sizes) / 24) <= packing.lower_bound(np.bincount(sizes, minlength=25), 24) <= least <= len(free)
    assert packing.lower_bound(np.bincount([13] * 5, minlength=25), 24) == 5
    for b, room in enumerate(free):
        held = sorted((offsets[i], sizes[i]) for i in range(len(sizes)) if bins[i] == b)
        assert [o for o, _ in held] == list(np.cumsum([0, *(s for _, s in held)]))[:-1] and sum(s for _, s in held) + room == 24


def valid(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_exchange_lowers_the_count(spark):
    r = random.Random(1)
    sizes = [r.choice([1, 2, 3, 5, 7, 9, 11, 13]) for _ in range(600)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "doc_id long, length long")
    once = valid(packing.pack(df, 24, 20, 1).collect(), 24)
    rows = packing.pack(df, 24, 20).collect()
    assert sorted((x.doc_id, x.length) for x in rows) == list(enumerate(sizes))
    assert packing.lower_bound(np.bincount(sizes, minlength=25), 24) <= valid(rows, 24) <= once


def test_pieces_and_odd_rows(spark):
    long = "word and more, it's 12 " * 900
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, long, 5), (3, long, 5), (None, "<|endoftext|>", 5)], "doc_id long, text string, length int")
    tokenizer = Tokenizer.from_file(packing.tokenizer_file())
    tokenizer.encode_special_tokens = True
    rows = packing.pieces(df, ids=True).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for i, text in ((1, ""), (2, ""), (None, "<|endoftext|>")):
        assert np.frombuffer(by[i][0].token_ids, "<u4").tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
    whole = [*tokenizer.encode(long, add_special_tokens=False).ids, 0]
    assert len(by[3]) == 2 * math.ceil(len(whole) / 2048)
    for r in by[3]:
        assert np.frombuffer(r.token_ids, "<u4").tolist() == whole[r.start : r.start + r.length] and r.ids_crc32 == zlib.crc32(r.token_ids)
        assert r.length == 2048 or r.piece == 0
    assert valid(packing.pack(packing.pieces(df)).collect(), 2048) == 7  # six whole ones and one that the rest share
    assert packing.pack(packing.pieces(df.limit(0))).count() == 0


def test_query(spark, sf):
    rows = packing.op10_packing(spark, sf).collect()
    tokenizer = Tokenizer.from_file(packing.tokenizer_file())
    tokenizer.encode_special_tokens = True
    docs = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    seen = defaultdict(list)
    for r in rows:
        ids = np.asarray(docs[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.length == len(ids) and r.ids_crc32 == zlib.crc32(ids.tobytes())
        seen[r.doc_id].append((r.piece, r.start, r.length))
    assert {i: sum(n for *_, n in p) for i, p in seen.items()} == {i: len(ids) for i, ids in docs.items()}
    lengths = np.array([r.length for r in rows])
    assert packing.lower_bound(np.bincount(lengths, minlength=2049)) <= valid(rows, 2048) <= packing.lower_bound(np.bincount(lengths, minlength=2049)) * 1.01 + 1


def test_exchange_goes_on_while_it_gains(spark, monkeypatch):
    from pyspark.sql import functions as F

    numbers = []

    def fake(rows, number, *rest):
        numbers.append(number)
        packed = rows.withColumn("sequence_id", F.col("doc_id") % max(2, 8 - number))
        return packed.select("*", F.lit(0).cast("long").alias("offset"), F.lit(1).cast("long").alias("room"), F.lit(1).cast("long").alias("spare"))

    monkeypatch.setattr(packing, "_packed", fake)
    df = spark.range(100).selectExpr("id as doc_id", "1L as length")
    assert packing.pack(df, 24, 20).select("sequence_id").distinct().count() == 2 and numbers == list(range(8))


def test_every_character_is_encoded_as_by_the_library():
    """The shared pattern and the merges give the library's ids for all characters, alone and between others; with runs of white space apart or not."""
    import json

    from pairlens.llm import bpe

    path = packing.tokenizer_file()
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    assert packing.ids_are_ranks(spec)
    merges = spec["model"]["merges"]
    assert not packing.ids_are_ranks(spec | {"model": spec["model"] | {"merges": [merges[1], merges[0], *merges[2:]]}})
    assert not packing.ids_are_ranks(spec | {"normalizer": {"type": "NFC"}})
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    encode = packing.load_encoder(path)
    own = bpe.load_encoding(bpe.rank_file())
    points = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4096):
        text = "".join(f"a{c}b {c}{c}1{c}'s\n{c} " for c in points[at : at + 4096])
        assert encode(text) == library.encode(text, add_special_tokens=False).ids
        assert bpe.encode_chunk(own, text, 2) == own.encode_ordinary(text)


def test_clashing_names_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (None, None, None)], "doc_id long, text string, piece string")
    assert sorted((r.doc_id or 0, r.length) for r in packing.pack(packing.pieces(df)).collect()) == [(0, 1), (1, 3)]
    assert packing.pack(packing.pieces(df.limit(0))).count() == 0
