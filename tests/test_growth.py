"""Work that must grow with its input: reading one long output, and the facts of one task."""

import time

import pytest
from pyspark.sql import functions as F

from pairlens.functions import parsers as P
from pairlens.operators import exports as E
from pairlens.operators import selection as W
from pairlens.sources import fixtures as X

N = 20_000


def within(seconds, df):
    began = time.perf_counter()
    got = df.collect()
    assert time.perf_counter() - began < seconds
    return got


def texts(spark, label="A"):
    """One output of N lines, the first number once more at the end."""
    lines = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(N)), lambda i: F.concat(F.lit("Q"), i.cast("string"), F.lit(f": {label}"))), "\n")
    return spark.range(1).repartition(1).select(F.concat(lines, F.lit("\nQ1: B")).alias("raw"), F.lit(N).alias("n"))


def test_softmax_of_a_long_array(spark):
    values = F.transform(F.sequence(F.lit(1), F.lit(5 * N)), lambda i: (i % 7).cast("double"))
    rows = spark.range(1).repartition(1).select(values.alias("x"))
    got = within(8, rows.select(F.aggregate(W.softmax(F.col("x"), 0.5), F.lit(0.0), lambda s, p: s + p).alias("s")))
    assert got[0].s == pytest.approx(1)


def test_comparative_last_of_a_long_output(spark):
    a = within(8, texts(spark).select(P.comparative_answers(F.col("raw")).alias("a")))[0].a
    assert len(a) == N and [tuple(x) for x in a[:2]] == [(1, "B"), (2, "A")]


def test_comparative_first_of_a_long_output(spark):
    a = within(8, texts(spark).select(P.comparative_answers_strict(F.col("raw"), F.col("n")).alias("a")))[0].a
    assert len(a) == N and [tuple(x) for x in a[:2]] == [(1, "A"), (2, "A")]


def test_comparative_winner_of_a_long_output(spark):
    a = P.comparative_answers_strict(F.col("raw"), F.col("n"))
    rows = within(8, texts(spark, "b").select(P.comparative_winner(a, P.trailing_winner(F.col("raw"))).alias("w"), P.comparative_winner(F.array().cast("array<struct<q:int,label:string>>"), F.lit(None)).alias("none"), P.comparative_winner(a, F.lit("A")).alias("stated")))
    assert [tuple(r) for r in rows] == [("B", None, "A")]


def test_a_task_holds_a_bounded_number_of_facts(spark):
    """Pairs are few bytes, which would all meet in one partition; the facts made of them are many."""
    from pairlens.operators.windows import TASK_ROWS

    parts = X.answers(spark, "/root/testdata/sf0.1").groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pair_id").alias("k")).collect()
    assert max(r.n for r in parts) < 1.5 * TASK_ROWS and sum(r.k for r in parts) == 5000


#: queries of many facts, all of which were one task's
ORDERED = (
    "w4_topk_quota",
    "w5_sub_aspect_cap",
    "a14_generic_overuse",
    "w18_representative_cases",
    "a15_mode_cooccurrence",
    "a15_mode_counts",
    "a16_task_statistics",
    "c24_failure_modes",
    "a13_dimension_failures",
    "s16_negative_samples",
    "w8_stable_shuffle",
    "a12_question_frequencies",
    "c21_leaderboard",
    "c22_condition_comparison",
    "x2_strict_lines",
    "p9_label_map",
    "a37_parse_summary",
)


@pytest.mark.parametrize("name", ORDERED)
def test_ordered_facts_are_of_dealt_pairs(spark, sf, name):
    from pairlens.plans import registry

    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [pair_id" in plan


def test_run_records_are_of_dealt_pairs(spark, sf):
    """The frontier stages its rows, so that its own plan doesn't show it."""
    from pairlens.plans import metrics

    assert "RepartitionByExpression [pair_id" in metrics.runs(spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_review_of_many_answers(spark):
    n = N // 2
    side = lambda label: F.map_from_entries(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.struct(i, F.when(i % 2 == 0, "no").otherwise(label))))
    rows = spark.range(1).repartition(1).select(F.lit("stem").alias("domain"), F.lit("A").alias("winner"), F.lit("B").alias("predicted_winner"), side("yes").alias("answers_a"), side("na").alias("answers_b"), F.to_json(F.sequence(F.lit(1), F.lit(n))).alias("selected_qids"))
    d = within(8, E.review(rows).select("differences"))[0].differences
    assert len(d) == n // 2 and tuple(d[1]) == (3, "yes", "na")


def test_differences_of_missing_sides_and_values(spark):
    a = F.map_from_arrays(F.array(*map(F.lit, (3, 1, 2, 5))), F.array(F.lit("yes"), F.lit("no"), F.lit(None), F.lit("na")))
    b = F.map_from_arrays(F.array(*map(F.lit, (2, 3, 4))), F.array(F.lit("no"), F.lit("yes"), F.lit(None).cast("string")))
    r = spark.range(1).select(P.answer_differences(a, b).alias("d"), P.answer_differences(a, F.lit(None).cast("map<int,string>")).alias("none")).first()
    assert [tuple(x) for x in r.d] == [(1, "no", "—"), (2, "—", "no"), (5, "na", "—")] and r.none is None


def test_reaudited_counts_read_each_output_once(spark, sf):
    from pairlens.plans import registry

    plan = registry.queries()["a28_reaudited_counts"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [doc_id") == 2  # documents and labels


def test_pairs_with_vectors_are_dealt(spark, sf):
    from pairlens.plans import registry

    plan = registry.queries()["w7_rank_by_embedding_score"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [pair_id" in plan


def outputs_of(spark):
    """Outputs of odd lines in many orders."""
    forms = ("Q1: yes", "q2:NO ", "Q2: N / A。", "Q4: not applicable", "yes", "na.", "", "　", "Note: yes", "Q9: yes", "Q99999999999999999999: no", "Q١: yes", "Q3: yes.", " Q3: no")
    texts = spark.range(400).repartition(1).select("id", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.element_at(F.array(*map(F.lit, forms)), (F.pmod(F.xxhash64("id", i), F.lit(len(forms))) + 1).cast("int"))), "\r\n").alias("raw"), F.lit(5).alias("n"))
    return texts.unionByName(spark.createDataFrame([(400, None, 5), (401, "", 5)], "id long, raw string, n int"))


def test_answers_meet_the_pattern_once_a_line(spark):
    plan = P.checklist_answers(outputs_of(spark), ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") == 1


def test_parsed_outputs_meet_the_pattern_once_a_line(spark):
    plan = P.parsed_checklist(outputs_of(spark), ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") == 1


def test_strict_lines_are_those_of_the_fates(spark):
    """The short way to the strict reading, and the long one over what becomes of each line."""
    found = {r.id: tuple(r)[1:] for r in P.strict_lines(outputs_of(spark), ["id"]).collect()}
    by_fate = P.parsed_checklist(outputs_of(spark), ["id"], more=P.strict_reading()).select("id", *P.strict_reading())
    assert len(found) == 402 and found == {r.id: tuple(r)[1:] for r in by_fate.collect()}
    assert {r[1:] for r in found.values()} == {(False, False), (True, False), (True, True)} and found[400] == (0, False, False)


def test_strict_lines_sort_nothing(spark):
    plan = P.strict_lines(outputs_of(spark), ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "sort" not in plan.lower()


def test_parsed_outputs_sort_their_matches_once(spark):
    """Numbers and flags of matches are sorted; lines without a match have no state to be put in order."""
    plan = P.parsed_checklist(outputs_of(spark), ["id"]).select("id", "parse_ok", "n_na", "n_duplicates")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array(concat(") == 1 and plan.count("sort_array") == 1


def test_parsed_outputs_are_those_of_the_fates(spark):
    """The short way to the counts, and the long one over what becomes of each line."""
    fate = lambda name: F.count_if(F.col("fate") == name)
    kept = lambda *answers: F.count_if((F.col("fate") == "kept") & F.col("answer").isin(*answers))
    by_line = P.checklist_lines(outputs_of(spark), ["id"]).groupBy("id").agg(kept("yes"), kept("yes", "no"), kept("na"), fate("duplicate"), fate("out_of_range"), F.max(F.when(F.col("fate") == "stop", F.col("lineno"))))
    parsed = P.parsed_checklist(outputs_of(spark), ["id"]).select("id", "n_yes", "n_questions_parsed", "n_na", "n_duplicates", "n_out_of_range", "first_bad_lineno")
    found = {r.id: tuple(r) for r in parsed.collect()}
    assert len(found) == 402 and found == {r.id: tuple(r) for r in by_line.collect()}
    assert all(any(r[i] for r in found.values()) for i in range(1, 7))


def test_outputs_gather_the_facts_of_a_pair_once(spark, sf):
    plan = X.raw_outputs(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 1 and "Aggregate [pair_id#" in plan and "Generate explode" not in plan
