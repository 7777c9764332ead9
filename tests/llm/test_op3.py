import hashlib

import numpy as np
from pyspark.sql import functions as F

from pairlens.llm import bpe


def test_chunks_encode_like_the_whole():
    encoding = bpe.load_encoding(bpe.rank_file())
    texts = ["", " ", "a" * 500, "word  two \n\n three's it's\t\tend " * 50, "été 東京 12ab " * 80, " " * 300 + "x", "x\n" * 200, "!?" * 90]
    for text in texts:
        for size in (1, 7, 64):
            chunks = list(bpe.safe_chunks(text, size))
            assert "".join(chunks) == text
            assert bpe.encode_text(encoding, text, size).tolist() == encoding.encode_ordinary(text)


def test_long_matches(spark):
    encoding = bpe.load_encoding(bpe.rank_file())
    for text in ("a" * 3000, " " * 2000 + "x", "\n" * 500, "it's " * 9 + "!?" * 900, "é" * 700 + "  y"):
        for run in (2, 3, 100):
            assert bpe.encode_chunk(encoding, text, run) == encoding.encode_ordinary(text)
    huge = [" " * 1_500_000, "\n" * 1_200_000 + "x", "a" * 1_000_000, "y\u3000\t" + " \u2003" * 800_000 + "z"]
    df = spark.createDataFrame(list(enumerate(huge)), "doc_id long, text string")
    for r in bpe.encode(df, decoded=True).collect():
        assert bytes(r.decoded).decode() == huge[r.doc_id]


def test_query_round_trips(spark, sf):
    rows = bpe.op3_bpe(spark, sf).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    encoding = bpe.load_encoding(bpe.rank_file())
    assert len(rows) == len(texts)
    for r in rows:
        ids = np.asarray(encoding.encode_ordinary(texts[r.doc_id]), dtype="<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_nulls_repeats_extra_columns_and_no_rows(spark):
    df = spark.createDataFrame([(1, None, b"x"), (2, "", None), (3, "same", b""), (3, "same", b""), (None, "<|endoftext|> é\x00", b"")], "doc_id long, text string, token_ids binary")
    out = bpe.encode(df, decoded=True)
    assert sorted((r.doc_id or 0, bytes(r.decoded).decode()) for r in out.collect()) == [(0, "<|endoftext|> é\x00"), (1, ""), (2, ""), (3, "same"), (3, "same")]
    again = bpe.decode(bpe.encode(df)).select(F.length("decoded").alias("n"))
    assert sorted(r.n for r in again.collect()) == [0, 0, 4, 4, 17]
    assert bpe.encode(df.limit(0)).count() == 0
