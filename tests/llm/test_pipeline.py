from collections import defaultdict

import duckdb
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from pairlens.llm import packing, quality, registry, secrets, toxicity
from pairlens.llm._support import staged

from .test_op6 import brute
from .test_op9 import base


def test_stages_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    outs, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        before = now
        now = staged(stage(spark, now, sf), "test")
        outs[name] = now
        rows = {r.doc_id: r for r in before.collect()}
        if name == "packing":
            break
        assert now.columns == columns and [f.dataType for f in now.schema] == [f.dataType for f in docs.schema]
        after = {r.doc_id: r for r in now.collect()}
        assert len(after) == now.count() > 0
        if name in ("toxicity", "quality"):
            module = toxicity if name == "toxicity" else quality
            said = {r.doc_id: r.predicted for r in module.score(before, module.fit(before, labels)).collect()}
            assert after.keys() == {i for i, p in said.items() if p == (module is quality)}
            assert all(after[i] == rows[i] for i in after)
        elif name == "near_duplicates":
            assert after.keys() == {i for i, _, top, _ in brute([(i, r.text) for i, r in rows.items()], size=5) if i == top}
            assert all(after[i] == rows[i] for i in after)
        else:
            assert after.keys() == rows.keys()
            for i, r in after.items():
                assert r.n_chars == len(r.text) and (r.lang, r.source) == (rows[i].lang, rows[i].source)
                if base(rows[i].text):
                    assert not base(r.text) and "[REDACTED]" in r.text
                elif r.text != rows[i].text:
                    assert "[REDACTED]" in r.text
    tokenizer = Tokenizer.from_file(packing.tokenizer_file())
    tokenizer.encode_special_tokens = True
    lengths, sequences = defaultdict(int), defaultdict(int)
    for r in now.collect():
        lengths[r.doc_id] += r.length
        sequences[r.sequence_id] += r.length
    assert lengths == {i: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in rows.items()}
    assert max(sequences.values()) <= 2048
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, whole.select("doc_id", "piece", "start", "length", "ids_crc32").collect())) == sorted(map(tuple, now.select("doc_id", "piece", "start", "length", "ids_crc32").collect()))


@pytest.mark.parametrize("place", range(5))
def test_stages_take_odd_rows(spark, sf, place):
    name, stage = corpus_pipeline.STAGES[place]
    kind = "doc_id long, text string, lang string, source string, n_chars long, score string, component string"
    odd = spark.createDataFrame([(None, None, None, None, None, None, None), (1, "", "en", None, 0, "x", "y"), (2, "the same of a", None, "s", 1, None, None), (2, "the same of a", None, "s", 1, None, None)], kind)
    out = stage(spark, odd, sf)
    assert out.count() == {"near_duplicates": 3}.get(name, 4)
    if name != "packing":
        assert out.columns == odd.columns
    assert stage(spark, odd.limit(0), sf).count() == 0


def test_registry_is_whole():
    names = registry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(registry.oracle_sql()) <= set(names)
    for sql in registry.oracle_sql().values():
        duckdb.extract_statements(sql)
    assert secrets.KINDS[: secrets.BASE] == ("assign", "access", "hex")
