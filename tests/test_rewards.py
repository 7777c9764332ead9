import math
import random
import re

import pytest
from pyspark.sql import functions as F

from pairlens.functions import nested, rewards, text


def stated(s):
    """The rule, in Python."""
    s = s[-500:]
    boxed = re.findall(r"\\boxed\{([^}]+)\}", s)
    after = re.findall(r"####\s*([\-\d,\.\s]+)", s)
    found = boxed[-1] if boxed else after[-1] if after else ""
    return found.replace(",", "").replace(" ", "").strip()


def reward(said, gold):
    a, b = stated(said), stated(gold)
    if not a or not b:
        return 0.0
    try:
        return float(abs(float(a) - float(b)) < 1e-5)
    except ValueError:
        return float(a == b)


def test_numeric_answers_equal_the_rule(spark):
    forms = [r"\boxed{5} then \boxed{x}", "#### 18\n\\boxed{\\$18}", r"\boxed{.5}", r"\boxed{1 000}", "#### 1,000", "#### -3", "none", r"\boxed{}", r"\boxed{,} #### 5", "#### 5\n\n6", r"\boxed{1_000}", r"\boxed{1e3}", r"\boxed{5d}", r"\boxed{inf}", r"\boxed{nan}",
             r"\boxed{x}", r"\boxed{\frac{1}{2}}", "#### 0.5", "#### 0.500001", "#### 0.50001", "####", "#### .", "#### 5.", r"\boxed{ 5 }", "#### 5" + " x" * 300, r"\boxed{+5}", r"\boxed{5.0e}", "#### 18", r"\boxed{$18}", "", r"\boxed{1__0}", r"\boxed{_1}"]
    r = random.Random(3)
    pairs = [(a, b) for a in forms for b in forms] + [(" ".join(r.choices(forms, k=3)), r.choice(forms)) for _ in range(300)]
    df = spark.createDataFrame(pairs, "said string, gold string")
    got = df.select("said", "gold", rewards.numeric_answer(F.col("said"), F.col("gold")).alias("r"), rewards.answer_format(F.col("said")).alias("f")).collect()
    assert len(got) == len(pairs)
    for x in got:
        assert x.r == reward(x.said, x.gold), x
        assert x.f == float(bool(re.search(r"\\boxed\{[^}]+\}", x.said) or re.search(r"####\s*[\-\d,\.]+", x.said))), x


def test_numeric_answer_of_nulls(spark):
    df = spark.createDataFrame([(None, "#### 1"), ("#### 1", None), (None, None)], "said string, gold string")
    assert [tuple(x) for x in df.select(rewards.numeric_answer(F.col("said"), F.col("gold")), rewards.answer_format(F.col("said"))).collect()] == [(0.0, 0.0), (0.0, 1.0), (0.0, 0.0)]


def test_diversity_by_definition(spark):
    r = random.Random(1)
    rows = [(k, [r.gauss(0, 1) for _ in range(4)]) for k in (1, 2) for _ in range(9)] + [(2, [0.0] * 4), (3, [0.0] * 4), (3, [0.0] * 4), (4, [1.0, 0.0, 0.0, 0.0]), (5, None), (6, [1.0, None, 0.0, 0.0]), (7, [1.0] * 4), (7, [2.0] * 4), (1, None)]
    got = dict(map(tuple, rewards.diversity_per_key(spark.createDataFrame(rows, "k int, v array<double>"), "k", "v").collect()))

    def cosine(x, y):
        n = math.sqrt(sum(a * a for a in x) * sum(b * b for b in y))
        return sum(a * b for a, b in zip(x, y)) / n if n else 0.0

    for k in (1, 2, 3, 4, 7):
        v = [x for j, x in rows if j == k and x]
        all_pairs = [cosine(v[i], v[j]) for i in range(len(v)) for j in range(len(v)) if i != j]
        assert got[k] == pytest.approx(min(1, max(0, 1 - (sum(all_pairs) / len(all_pairs) if all_pairs else 0))), abs=1e-9)
    assert set(got) == {1, 2, 3, 4, 7}


def test_questions_of_any_length(spark):
    q = "Does the response " + "é" * 30_000 + "?"
    df = spark.createDataFrame([(q,), ("Is the response",), ("Why?",), (None,)], "q string")
    got = [x[0] for x in df.select(text.comparative(F.col("q"))).collect()]
    assert got == ["Which response better" + q[len("Does the response") :], "Which response is more", "Comparing the two responses: Why?", None]


def test_references_are_swapped_without_a_placeholder(spark):
    df = spark.createDataFrame([("Response A\x00A\x00Response BResponse AResponse A",), ("none",), ("",), (None,)], "t string")
    assert [x[0] for x in df.select(text.swap_references(F.col("t"))).collect()] == ["Response B\x00A\x00Response AResponse BResponse B", "none", "", None]


@pytest.mark.parametrize("cell", ["[" * 100_000, '{"a":' * 100_000, "[" * 100_000 + "1" + "]" * 100_000])
def test_hostile_nesting_is_plain_text(spark, cell):
    df = spark.createDataFrame([(cell,), ('["x", {"reasoning": "y"}]',)], "raw string")
    got = [tuple(x) for x in df.select(nested.reasoning(F.col("raw")), nested.feedback(F.col("raw"), "k")).collect()]
    assert got == [(cell, ""), ("x\n\ny", "")]
