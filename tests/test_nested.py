"""Irregular annotations against a plain walk; samples and places against whole sorts."""

import json
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairlens.functions import nested, parsers
from pairlens.operators import sampling, windows


def walk(value):
    """Texts in order: strings that are JSON are read on, of an object the first present key counts."""
    if value is None:
        return []
    if isinstance(value, str) and value.strip()[:1] in ("[", "{"):
        try:
            return walk(json.loads(value))
        except ValueError:
            return [value]
    if isinstance(value, dict):
        return next((walk(value[k]) for k in nested.REASON_KEYS if k in value), [])
    if isinstance(value, list):
        return [x for item in value for x in walk(item)]
    return [str(value)]


def joined(texts):
    return "\n\n".join(dict.fromkeys(t for t in (" ".join(x.split(" ")).strip() for x in texts) if t))


CASES = [
    '["a","b"]', '[["a","b"],"c"]', '{"reasoning":["p","q"]}', '{"reasoning":{"text":{"content":{"summary":"deep"}}}}', '{"reasoning":"","text":"x"}', '{"reasoning":null,"text":"x"}',
    "plain", "{broken", "[1, 2.5, true]", '[{"other":"x"},{"text":"[\\"in\\", {\\"text\\":\\"side\\"}]"}]', "", None, '["a","a","b"]', "[" * 200 + '"far"' + "]" * 200,
]


def test_reasoning_of_any_nesting(spark):
    rows = spark.createDataFrame(list(enumerate(CASES)), "i int, raw string").select("i", nested.reasoning(F.col("raw")).alias("t")).collect()
    assert {r.i: r.t for r in rows} == {i: joined(walk(x)) for i, x in enumerate(CASES)}
    assert {r.i: r.t for r in rows}[3] == "deep" and {r.i: r.t for r in rows}[4] == ""


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.one_of(st.none(), st.integers(0, 9), st.sampled_from(["a", "b c", "", "[x", '{"text": "in"}'])), lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.sampled_from(["text", "reasoning", "other"]), x, max_size=3)), max_leaves=8))
def test_walk_without_recursion(value):
    def first(entry):
        return next(((entry[k], False) for k in nested.REASON_KEYS if k in entry), None)

    assert nested._walk(json.dumps(value) if isinstance(value, (list, dict)) else value, first, True) == walk(value)


def test_feedback_by_key(spark):
    raw = ['[{"f":"one"},{"f":["lost",{"f":"two"}]},{"g":"x"}]', '{"f":"[\\"kept as it is\\"]"}', "plain", '{"f":3}', None]
    rows = spark.createDataFrame(list(enumerate(raw)), "i int, raw string").select("i", nested.feedback(F.col("raw"), "f").alias("t")).collect()
    assert {r.i: r.t for r in rows} == {0: "one\n\ntwo", 1: '["kept as it is"]', 2: "", 3: "", 4: ""}


def test_long_bullets(spark):
    text = "- " + "x" * 1_000_010 + "\n- short"
    found = spark.createDataFrame([(text,)], "raw string").select(parsers.simple_bullets(F.col("raw")).alias("b")).first().b
    assert [len(x) for x in found] == [1_000_010, 5]


@pytest.mark.parametrize("n", [1, 7, 400])
def test_samples_and_places_of_a_hot_key(spark, n):
    rows = [(i, None if i % 50 == 0 else "hot" if i % 7 else "cold") for i in range(900)]
    df = spark.createDataFrame(rows, "i long, k string")
    got = sampling._smallest(df, ["k"], sampling.hash_key(F.lit(42), "i"), n).collect()
    assert Counter(r.k for r in got) == {k: min(n, c) for k, c in Counter(k for _, k in rows).items()}
    order = {i: h for i, h in ((r.i, r.h) for r in df.select("i", sampling.hash_key(F.lit(42), "i").alias("h")).collect())}
    for k in (None, "hot", "cold"):
        assert {r.i for r in got if r.k == k} == set(sorted((i for i, x in rows if x == k), key=order.get)[:n])
    placed = {r.i: r.place for r in windows.places(df, ["k"], "i", "place").collect()}
    for k in (None, "hot", "cold"):
        assert [placed[i] for i, x in rows if x == k] == list(range(sum(x == k for _, x in rows)))


def test_csv_of_quotes_and_lines(spark, tmp_path):
    from pairlens.sources import tables

    df = spark.createDataFrame([(1, 'a "b", c\nd'), (2, " padded "), (3, None)], "i int, t string")
    tables.write_csv(df, f"{tmp_path}/c")
    assert sorted(map(tuple, tables.read_csv(spark, f"{tmp_path}/c", "i int, t string").collect())) == [(1, 'a "b", c\nd'), (2, " padded "), (3, None)]
