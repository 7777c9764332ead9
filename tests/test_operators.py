"""Hand-computed cases and invariants of the operators."""

import math

import pytest
from pyspark.sql import functions as F

from pairlens import schema
from pairlens.functions import rewards as R
from pairlens.functions import text as T
from pairlens.operators import diagnostics as D
from pairlens.operators import joins as J
from pairlens.operators import metrics as M
from pairlens.operators import packing, questions, rollouts
from pairlens.operators import sampling as G
from pairlens.operators import scoring as S
from pairlens.operators import selection as W
from pairlens.sources import bank as B


def facts(spark, pairs):
    return spark.createDataFrame([(1, q, a, b) for q, (a, b) in enumerate(pairs, 1)], "id int, qid int, ans_a string, ans_b string")


def test_margin_by_hand(spark):
    r = S.margins(facts(spark, [("yes", "no"), ("yes", "na"), ("no", "yes"), ("na", "na")]), ["id"]).withColumn("w", S.winner_from_margin(F.col("margin"))).first()
    assert (r.margin, r.n_aligned, r.w) == (0.125, 2, "A")


def test_margins_of_swapped_sides_are_opposite(spark):
    f = facts(spark, [("yes", "no"), ("yes", "na"), ("no", "no"), ("na", "yes"), ("no", "yes"), ("yes", "yes"), ("yes", "no")])
    back = f.select("id", "qid", F.col("ans_b").alias("ans_a"), F.col("ans_a").alias("ans_b"))
    assert S.margins(f, ["id"]).first().margin == -S.margins(back, ["id"]).first().margin != 0


def test_decisive_question(spark):
    rows = S.leave_one_out(facts(spark, [("yes", "no"), ("no", "no"), ("na", "na")]), ["id"]).orderBy("qid").collect()
    assert [r.u3_decisive for r in rows] == [1.0, 0.0, 0.0]


def test_targets_by_hand(spark):
    row = spark.range(1).select(S.rank_target(F.lit(1), F.lit(0.8), F.lit(1.0)).alias("a"), S.target("human_oracle_fallback", F.lit(1), F.lit(0.2), F.lit(0.0), F.lit(0.0)).alias("b")).first()
    assert row.a == pytest.approx(2.0) and row.b == pytest.approx(0.02)
    with pytest.raises(ValueError):
        S.target("other", F.lit(1), F.lit(1), F.lit(1), F.lit(1))


def test_quota_by_hand(spark):
    dims = "aaabab"
    rows = spark.createDataFrame([(1, i, d, i) for i, d in enumerate(dims, 1)], "id int, qid int, dimension string, rank int")
    picks = W.top_k_with_quota(rows, ["id"], 5).orderBy("pick").collect()
    assert [(r.qid, r.phase) for r in picks] == [(1, 1), (2, 1), (4, 1), (6, 1), (3, 2)]
    assert W.top_k_with_quota(rows, ["id"], 50).count() == 6


def test_human_relevance_by_hand(spark):
    rows = spark.createDataFrame([(1, [1, 2], True), (1, [2, 3], True), (1, [], False), (2, [1], False)], "id int, qids array<int>, ok boolean")
    assert sorted((r.qid, r.h, r.n_annotators) for r in J.human_relevance(rows, ["id"]).collect()) == [(1, 0.5, 2), (2, 1.0, 2), (3, 0.5, 2)]


def test_alignment_by_hand(spark):
    rows = spark.createDataFrame([([1, 4, 7], [1, 4, 7, 2], [1, 2]), ([3], [3], [3]), ([1], [1], [])], "s array<int>, a array<int>, h array<int>")
    selected, asked = W.alignment(F.col("s"), F.col("a"), F.col("h"))
    r = rows.agg(F.avg(selected).alias("s"), F.avg(asked).alias("a"), F.count(selected).alias("n")).first()
    assert tuple(r) == (0.75, 1.0, 2)


def trace(spark, verdicts, winner, n=None, matched=True):
    n = len(verdicts) if n is None else n
    row = [([f"q{i}" for i in range(n)], dict(enumerate(verdicts, 1)), winner, n, len(verdicts), matched, None)]
    return spark.createDataFrame(row, "checklist array<string>, verdicts map<int,string>, winner string, n_questions int, n_verdicts int, matched boolean, parse_error string").select(F.struct("*").alias("t"))


@pytest.mark.parametrize(
    "verdicts, winner, gold, diversity, want",
    [([], None, "A", 0.0, -0.30), (["A"] * 8, "B", "A", 1.0, -0.20), (["A"] * 8, "A", "A", 0.0, 0.85), (["A"] * 8, "A", "A", 1.0, 1.00), (["A"] * 3, "A", "A", 1.0, 0.60), (["Tie"] * 8, "A", "A", 0.2, 0.73)],
)
def test_quality_reward_by_hand(spark, verdicts, winner, gold, diversity, want):
    df = trace(spark, verdicts, winner, matched=bool(verdicts))
    assert df.select(R.quality_reward(F.col("t"), F.lit(gold), F.lit(diversity)).alias("x")).first().x == pytest.approx(want)


def test_pair_reward_dead_zone(spark):
    f = lambda d, p: spark.range(1).select(R.pair_reward(F.lit(d), F.lit(p), F.lit(1.0)).alias("x")).first().x
    assert f(0.04, 2) == 0 and f(0.0, 0) == 1 and f(0.5, 2) == pytest.approx(1.045) and f(0.5, -2) == pytest.approx(-1.045)


def test_diversity_of_unit_vectors(spark):
    df = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0]],), ([[1.0, 0.0], [1.0, 0.0]],), ([[1.0, 0.0]],), ([[1.0, 0.0], [-1.0, 0.0], [0.0, 1.0]],)], "v array<array<double>>")
    assert [r.x for r in df.select(R.diversity(F.col("v")).alias("x")).collect()] == [1.0, 0.0, 1.0, 1.0]


def test_metrics_without_valid_predictions(spark):
    df = spark.createDataFrame([("x", "A", None), ("x", "B", "Tie"), ("y", "A", "A")], "domain string, winner string, predicted_winner string")
    rows = {r.domain: r for r in M.classification(df).collect()}
    assert set(rows) == {None, "y"} and (rows[None].real_accuracy, rows[None].valid_accuracy, rows[None].n_unparseable) == (pytest.approx(1 / 3), 1.0, 1)
    assert rows[None].macro_f1 == 0.5 and rows["y"].macro_f1 == 1.0
    assert M.classification(df.limit(0)).count() <= 1


def test_null_predictions_agree(spark):
    df = spark.createDataFrame([(1, "x", "A", None), (2, "x", "A", "A")], "id int, domain string, winner string, predicted_winner string")
    assert M.robustness(df, df, "id").filter("domain is null").first().invariance == 1.0
    swapped = df.withColumn("predicted_winner", S.flipped(F.col("predicted_winner")))
    assert M.robustness(df, swapped, "id", swapped=True).filter("domain is null").first().invariance == 1.0


def test_spearman_ties(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (2.0, 3.0), (4.0, 4.0)], "x double, y double")
    assert M.spearman(df, "x", "y").first().rho == pytest.approx(0.9486832980505138)
    assert M.spearman(df.limit(1), "x", "y").first().rho is None


def test_samples_keep_their_sizes(spark):
    df = spark.range(200).select(F.col("id"), (F.col("id") % 7).alias("s"), (F.col("id") % 50).alias("g"))
    assert G.stratified(df, ["s"], "id", 40).count() == 40
    assert G.stratified(df, ["s"], "id", 500).count() == 200
    a = G.allocation(df, ["s"], 40).collect()
    assert sum(r.take for r in a) == 40 and all(r.take <= r.size for r in a)
    split = G.group_split(df, "g", 0.1)
    assert split.filter("split = 'dev'").select("g").distinct().count() == 5
    assert split.groupBy("g").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    assert G.fixed_size(df, "id", 13).count() == 13 and G.fixed_size(df, "id", 1000).count() == 200
    assert {r.id for r in G.fixed_size(df.repartition(7), "id", 13).collect()} == {r.id for r in G.fixed_size(df, "id", 13).collect()}


def test_order_statistics_over_buckets(spark):
    from pairlens.operators import windows as V

    xs = [float((i * 37) % 101) for i in range(300)] + [5.0] * 200
    df = spark.createDataFrame([(x,) for x in xs] + [(None,), (float("nan"),)], "x double")
    import numpy as np

    for cuts in (2, 16, 256):
        assert V.exact_quantiles(df, "x", [0.0, 0.1, 0.5, 0.93, 1.0], cuts) == pytest.approx(list(np.quantile(xs, [0.0, 0.1, 0.5, 0.93, 1.0])))
    assert V.exact_quantiles(df.limit(0), "x", [0.5]) == [None]
    h = spark.range(3000).select("id", G.hash_key("id").alias("h"))
    for k in (0, 1, 1234, 3000, 9999):
        want = {r.id for r in h.orderBy("h").limit(k).collect()}
        assert {r.id for r in V.smallest_hashes(h, "h", k, ["id"]).collect()} == want


def test_leaks_and_repeats_raise(spark):
    a, b = spark.range(5), spark.range(4, 9)
    with pytest.raises(ValueError):
        J.require_disjoint(a, b, ["id"], "splits")
    J.require_disjoint(a, spark.range(5, 9), ["id"], "splits")
    with pytest.raises(ValueError):
        J.one_to_one(a.union(a), b, ["id"])
    with pytest.raises(ValueError):
        J.require_complete(a, b, ["id"], "weights")
    with pytest.raises(ValueError):
        J.upserted(a, [b], "id")
    assert J.upserted(a, [b], "id", allow_new=True).count() == 9


def test_domain_fallback(spark):
    bank = spark.createDataFrame([(1, "Clear"), (2, "code")], "qid int, dimension string")
    dims = spark.createDataFrame([("general", "clear")], "domain string, dimension string")
    domains = spark.createDataFrame([("general",), ("odd",)], "domain string")
    assert sorted(map(tuple, questions.active_questions(domains, bank, dims).collect())) == [("general", 1), ("odd", 1), ("odd", 2)]
    assert sorted(map(tuple, questions.expected_count(domains, bank, dims).collect())) == [("general", 1), ("odd", 0)]


def test_drop_rules(spark):
    rows = [(40, 0.99, 0.1, 0.9, 30), (40, 0.5, 0.9, 0.5, 30), (3, 0.99, None, None, None)]
    df = spark.createDataFrame(rows, "n_effective_nonna long, yes_rate_nonna double, na_rate double, agree_rate double, n_effective_corr long")
    assert [(r.drop_reasons, r.drop) for r in D.drop_rules(df).collect()] == [(["saturated_yes"], True), (["low_signal", "rarely_applicable"], True), (["tiny_effective_n"], False)]


def test_bank_of_yaml(spark):
    pytest.importorskip("yaml")
    texts = {"b.yaml": "dimension: beta\nsub_aspects:\n  s1: {filtered_questions: [x, y, x]}\n", "a.yaml": "dimension: alpha\ndefinition: d\nsub_aspects:\n  s1: [p, q]\n  s2: [p]\n"}
    nested = B.read_yaml_bank(spark, texts)
    assert [(r.qid, r.dimension, r.sub_aspect, r.question_text) for r in B.flat_bank(nested).orderBy("qid").collect()] == [(1, "alpha", "s1", "p"), (2, "alpha", "s1", "q"), (3, "alpha", "s2", "p"), (4, "beta", "s1", "x"), (5, "beta", "s1", "y")]
    flat = B.flat_bank(nested)
    assert [r.dimension for r in B.emptied_dimensions(flat, flat.filter("dimension = 'beta'")).collect()] == ["beta"]


def test_text_functions(spark):
    f = lambda e, *v: spark.createDataFrame([v], ", ".join(f"c{i} string" for i in range(len(v)))).select(e.alias("x")).first().x
    c = F.col("c0")
    import json
    from hashlib import sha256

    odd = 'q"\\ \n\r\t\x08\x0c\x01é '
    assert f(T.json_string(c), odd) == json.dumps(odd, ensure_ascii=False)
    assert f(T.sorted_json(b=c, a=F.lit("1")), odd) == json.dumps({"a": "1", "b": odd}, sort_keys=True, ensure_ascii=False)
    assert f(T.prompt_id(c), "é") == sha256("é".encode()).hexdigest()[:16]
    assert f(T.normal_space(c), "  a \t b\r\n\r\n\r\n\r\nc ") == "a b\n\nc"
    assert f(T.standard_references(c), "@response 1 beats RESPONSE b; responses a") == "Response A beats Response B; responses a"
    assert f(T.swap_references(c), "Response A, Response B") == "Response B, Response A"
    assert f(T.int_list(c), " [1, 2]") == [1, 2] and f(T.int_list(c), None) == [] and f(T.int_list(c), "x") == []
    assert f(T.int_list(c), "(3,)") == [3] and f(T.int_list(c), "(1, 2)") == [1, 2] and f(T.int_list(c), "[1.9, -1.9, '4']") == [1, -1, 4] and f(T.int_list(c), "[1, null]") == f(T.int_list(c), "None") == f(T.int_list(c), "[1, 'a']") == []
    assert f(T.lines(c), "a\r\nb c\x85") == ["a", "b", "c"] == "a\r\nb c\x85".splitlines()
    assert f(T.word_count(c), " a  b\n") == 2 and f(T.byte_tokens(c), "") == 1
    assert f(T.with_think_block(c), "plan\n### Final\nWinner: A") == "<think>\nplan\n</think>\n\n### Final\nWinner: A"


def test_shards_and_rollouts(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate([5, 5, 3, 9, 1])] + [(2, 0, 4)], "job int, i int, s int")
    assert sorted((r.job, r.i, r.shard) for r in packing.packed(df, "job", ["i"], {"s": 10}).collect()) == [(1, 0, 0), (1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 2), (2, 0, 0)]
    with pytest.raises(Exception, match="exceeds"):
        packing.packed(df, "job", ["i"], {"s": 8}).collect()


def test_softmax_and_list_mle(spark):
    p = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<double>").select(W.softmax(F.col("v"), 2.0).alias("p")).first().p
    e = [math.exp(x / 2) for x in (1, 2, 3)]
    assert p == pytest.approx([x / sum(e) for x in e])
    with pytest.raises(ValueError):
        W.softmax(F.col("v"), 0)
    rows = spark.createDataFrame([(1, 1, 2.0), (1, 2, 1.0)], "id int, rank int, score double")
    assert W.list_mle(rows, ["id"]).first().loss == pytest.approx(math.log(math.exp(2) + math.exp(1)) - 2)


def test_schema_guards(spark):
    df = spark.createDataFrame([(1, [2])], "dimension int, ranked_qids array<int>")
    assert schema.resolve_aliases(df, ["dim", "selected_qids"]).columns == ["dim", "selected_qids"]
    with pytest.raises(schema.MissingColumns):
        schema.require_columns(df, ["nothing"])
    assert schema.with_defaults(df, {"k": ("int", 3)}).first().k == 3


def test_drop_empty_strips_whole_texts(spark, tmp_path):
    from pairlens.plans import registry

    spark.createDataFrame([(1, "   x"), (2, "\n\n\n\ty "), (3, " \t\n　 "), (4, ""), (5, None), (6, "z")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.doc_id for r in registry.queries()["f18_drop_empty"](spark, str(tmp_path)).collect()) == [1, 2, 6]


def test_review_rows(spark):
    from pairlens.operators import exports as E

    rows = [("x", "A", "A", {1: "yes", 2: "no"}, {1: "no", 2: "no"}, "[1, 2]"), ("x", "A", None, {1: "yes", 2: "no"}, {1: "no", 3: "na"}, "[2]"), ("y", "B", "A", {1: "yes"}, {1: "no"}, None), ("y", "B", "Tie", {}, {4: "yes"}, "unreadable")]
    df = spark.createDataFrame(rows, "domain string, winner string, predicted_winner string, answers_a map<int,string>, answers_b map<int,string>, selected_qids string")
    seen = lambda *a: sorted((r.domain, r.predicted_winner or "", [tuple(d) for d in r.differences]) for r in E.review(df, *a).collect())
    assert seen() == [("x", "", [(2, "no", "—")]), ("x", "A", [(1, "yes", "no")]), ("y", "A", [(1, "yes", "no")]), ("y", "Tie", [])]
    assert [x[:2] for x in seen("Wrong predictions")] == [("x", ""), ("y", "A"), ("y", "Tie")] and [x[:2] for x in seen("Correct predictions", "x")] == [("x", "A")] and seen("All", "z") == []
    with pytest.raises(ValueError):
        E.review(df, "some")
    lists = df.withColumn("selected_qids", F.array(F.lit(1)))
    assert sum(len(r.differences) for r in E.review(lists).collect()) == 3


def test_target_validity_gives_the_first_reason(spark):
    from pairlens.operators.exports import target_validity

    cases = {
        "Q1: yes\nQ2: no": "ok", "\n q1:YES \n\nQ2: No\r\n": "ok", "": "empty_target", " \n": "empty_target", None: "empty_target", "Q1: yes": "line_count_mismatch(1!=2)", "Q2: yes\nQ1: no": "out_of_order(expected Q1 got Q2)",
        "Q1: yes\nQ1: no": "out_of_order(expected Q2 got Q1)", "Q01: yes\nQ2: N/A": "bad_line:'Q2: N/A'", "x" * 70 + "\nQ2: no": "bad_line:'" + "x" * 60 + "'", "Q3: no\nbad": "out_of_order(expected Q1 got Q3)", "Q99999999999999999999: no\nQ2: no": "out_of_order(expected Q1 got Q99999999999999999999)",
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.why for r in df.select("t", target_validity(F.col("t"), F.lit(2)).alias("why")).collect()} == cases
