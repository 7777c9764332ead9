"""Queries of margins, policies, utilities, targets and escalation."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlens.operators import scoring as S
from pairlens.operators import selection as W
from pairlens.sources import fixtures as X

from .registry import query

KEYS = ["pair_id", "domain", "winner", "preference_strength"]


def predictions(spark, sf, delta: float = S.TIE_DELTA):
    """Static full-bank verdicts of every pair."""
    return S.margins(X.answers(spark, sf), KEYS).withColumn("predicted_winner", S.winner_from_margin(F.col("margin"), delta))


def judged(spark, sf):
    """Predictions, some of them unparseable."""
    return predictions(spark, sf).withColumn("predicted_winner", F.when(F.col("pair_id") % 13 != 0, F.col("predicted_winner")))


@query("j10_sample_question_join", "select domain, dimension, count(*) as n, count(distinct pair_id) as n_pairs, count(distinct qid) as n_questions from answers group by all")
def _(spark, sf):
    return X.answers(spark, sf).groupBy("domain", "dimension").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pair_id").alias("n_pairs"), F.count_distinct("qid").cast("long").alias("n_questions"))


@query("c1_contribution_table", "select ans_a, ans_b, c as contribution, count(*) as n from contrib group by all")
def _(spark, sf):
    return X.answers(spark, sf).groupBy("ans_a", "ans_b").agg(F.count(F.lit(1)).alias("n")).withColumn("contribution", S.contribution(F.col("ans_a"), F.col("ans_b")))


@query("c2_pairwise_margin", "select pair_id, margin, n_aligned, n_questions, predicted_winner from preds")
def _(spark, sf):
    return predictions(spark, sf).select("pair_id", "margin", "n_aligned", "n_questions", "predicted_winner")


@query("p29_winner_from_delta", "select pair_id, -margin as delta, case when -margin > 0.05 then 'B' when -margin < -0.05 then 'A' else 'Tie' end as winner from margins")
def _(spark, sf):
    d = predictions(spark, sf).select("pair_id", (-F.col("margin")).alias("delta"))
    return d.withColumn("winner", S.winner_from_delta(F.col("delta")))


@query("p30_error_category", "select pair_id, case when predicted_winner is null then 'parse_failure' when predicted_winner = 'Tie' then 'tie' when predicted_winner = winner then 'correct' else 'wrong_winner' end as error_category from judged")
def _(spark, sf):
    return judged(spark, sf).select("pair_id", S.error_category(F.col("winner"), F.col("predicted_winner")).alias("error_category"))


_COUNTS = """
, sides as (select pair_id, side, count(*) as n, count(*) filter (where x = 'yes') as y, count(*) filter (where x = 'no') as o, count(*) filter (where x = 'na') as na
  from (select pair_id, 'a' as side, ans_a as x from gaps union all select pair_id, 'b', ans_b from gaps) group by all)
"""


@query(
    "c3_na_policies",
    _COUNTS + "select pair_id, side, case when na = 0 and y + o = n then y / n end as strict, y / n as as_no, case when y + o > 0 then y / (y + o) else 0.0::double end as skip, "
    "case when (y + o) / n >= 0.8 then y / (y + o) end as partial from sides",
)
def _(spark, sf):
    facts = X.with_gaps(X.answers(spark, sf))
    counts = S.side_counts(facts, ["pair_id"])
    long = counts.select("pair_id", "expected_n", F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"n_yes_{s}").alias("y"), F.col(f"n_no_{s}").alias("o"), F.col(f"n_na_{s}").alias("na")) for s in "ab"))).alias("s")).select("pair_id", "expected_n", "s.*")
    answered = F.col("y") + F.col("o")
    score = lambda policy: S.na_score(policy, F.col("y"), answered, F.col("na"), F.col("expected_n"), answered == F.col("expected_n"), answered + F.col("na") == F.col("expected_n")).alias(policy)
    return long.select("pair_id", "side", *map(score, ("strict", "as_no", "skip", "partial")))


@query(
    "c4_aggregate_score",
    _COUNTS + ", s as (select pair_id, side, case when y + o > 0 then y / (y + o) end as score from sides) "
    "select a.pair_id, coalesce(a.score - b.score, 0) as margin, case when a.score - b.score > 0.05 then 'A' when a.score - b.score < -0.05 then 'B' else 'Tie' end as predicted_winner from s a join s b on a.pair_id = b.pair_id and a.side = 'a' and b.side = 'b'",
)
def _(spark, sf):
    counts = S.side_counts(X.with_gaps(X.answers(spark, sf)), ["pair_id"])
    share = lambda s: F.try_divide(F.col(f"n_yes_{s}"), F.col(f"n_yes_{s}") + F.col(f"n_no_{s}"))
    margin = F.coalesce(share("a") - share("b"), F.lit(0.0))
    return counts.select("pair_id", margin.alias("margin"), S.winner_from_margin(margin).alias("predicted_winner"))


@query(
    "c5_weighted_margin",
    ", s as (select c.pair_id, sum(w * c) as wc, sum(w) as ws, count(w) as n_weighted from contrib c left join weights using (pair_id, qid) group by all) "
    "select pair_id, case when ws > 0 then wc / ws else 0 end as margin, n_weighted, case when ws > 0 and wc / ws > 0.05 then 'A' when ws > 0 and wc / ws < -0.05 then 'B' else 'Tie' end as predicted_winner from s",
)
def _(spark, sf):
    facts = X.answers(spark, sf)
    return S.weighted_margins(facts, X.weights(facts), ["pair_id"], ["pair_id", "qid"])


@query("c6_weighted_aggregate", "select pair_id, sum(case when ans_a = 'yes' then w else 0 end) / sum(w) as score_a, sum(case when ans_b = 'yes' then w else 0 end) / sum(w) as score_b from contrib join weights using (pair_id, qid) group by all")
def _(spark, sf):
    facts = X.answers(spark, sf)
    return S.weighted_scores(facts, X.weights(facts), ["pair_id"], ["pair_id", "qid"])


_LOO = """
, sums as (select *, sum(c) over (partition by pair_id) as s, count(*) over (partition by pair_id) as n from contrib),
loo as (select *, (s - c) / greatest(n - 1, 1) as margin_without, s / n as m from sums),
dec as (select *, case when margin_without > 0.05 then 'A' when margin_without < -0.05 then 'B' else 'Tie' end <> case when m > 0.05 then 'A' when m < -0.05 then 'B' else 'Tie' end as decisive from loo),
util as (select pair_id, domain, winner, qid, dimension, ans_a, ans_b, pair_id % 13 = 0 as parse_fail, case when pair_id % 13 <> 0 then c end as pair_contrib,
  case when pair_id % 13 <> 0 then cast(not (ans_a = 'na' and ans_b = 'na') as integer) end as u1_answerable, case when pair_id % 13 <> 0 then abs(c) end as u2_abs_contrib,
  case when pair_id % 13 <> 0 then cast(decisive as double) end as u3_decisive from dec)
"""


@query("w3_leave_one_out", _LOO + "select pair_id, qid, c as contrib, margin_without, cast(decisive as double) as u3_decisive from dec")
def _(spark, sf):
    return S.leave_one_out(X.answers(spark, sf), ["pair_id"]).select("pair_id", "qid", "contrib", "margin_without", "u3_decisive")


def oracle_questions(spark, sf):
    return S.utilities(X.answers(spark, sf), ["pair_id"], F.col("pair_id") % 13 == 0)


@query("c7_oracle_utilities", _LOO + "select pair_id, qid, parse_fail, pair_contrib, u1_answerable, u2_abs_contrib, u3_decisive from util")
def _(spark, sf):
    return oracle_questions(spark, sf).select("pair_id", "qid", "parse_fail", "pair_contrib", "u1_answerable", "u2_abs_contrib", "u3_decisive")


@query("c8_rank_target", _LOO + "select pair_id, qid, u2_abs_contrib + u3_decisive + 0.2::double * u1_answerable as target from util where not parse_fail")
def _(spark, sf):
    u = oracle_questions(spark, sf).filter("not parse_fail")
    return u.select("pair_id", "qid", S.rank_target(F.col("u1_answerable"), F.col("u2_abs_contrib"), F.col("u3_decisive")).alias("target"))


_H = ", hr as (select pair_id, qid, ((pair_id + qid) % 4) / 4.0::double as h from contrib where (pair_id + qid) % 4 > 0 and qid % 3 = 0)"


def relevance(facts):
    """Sparse human relevance: absent rows are 0."""
    n = (F.col("pair_id") + F.col("qid")) % 4
    return facts.filter((n > 0) & (F.col("qid") % 3 == 0)).select("pair_id", "qid", (n / 4).alias("h"))


@query(
    "c9_target_modes",
    _LOO + _H + "select pair_id, qid, u2_abs_contrib + u3_decisive + 0.2::double * u1_answerable as oracle_baseline, coalesce(h, 0) as pure_human, case when coalesce(h, 0) > 0 then h else 0.1::double * u2_abs_contrib end as human_oracle_fallback from util left join hr using (pair_id, qid) where not parse_fail",
)
def _(spark, sf):
    u = oracle_questions(spark, sf).filter("not parse_fail")
    rows = u.join(relevance(u), ["pair_id", "qid"], "left").withColumn("h", F.coalesce("h", F.lit(0.0)))
    return rows.select("pair_id", "qid", *(S.target(m, F.col("u1_answerable"), F.col("u2_abs_contrib"), F.col("u3_decisive"), F.col("h")).alias(m) for m in ("oracle_baseline", "pure_human", "human_oracle_fallback")))


@query("c10_gold_aligned", "select pair_id, sum(case when winner = 'A' and c > 0 or winner = 'B' and c < 0 then abs(c) else 0 end) as aligned, sum(abs(c)) as total from contrib group by all")
def _(spark, sf):
    c = S.contribution(F.col("ans_a"), F.col("ans_b"))
    return X.answers(spark, sf).groupBy("pair_id").agg(F.sum(S.gold_aligned(c, F.col("winner"))).alias("aligned"), F.sum(F.abs(c)).alias("total"))


_ESC = """
, r as (select *, row_number() over (partition by pair_id order by (qid * 7) % 11, qid) as rank from contrib),
e as (select pair_id, sum(c) filter (where rank <= 5) / count(*) filter (where rank <= 5) as m1, sum(c) filter (where rank <= 10) / count(*) filter (where rank <= 10) as m2, sum(c) / count(*) as m3,
  count(*) filter (where rank <= 5) as n1, count(*) filter (where rank <= 10) as n2, count(*) as n3,
  count(*) filter (where rank <= 5 and ans_a <> 'na' and ans_b <> 'na') as a1, count(*) filter (where rank <= 10 and ans_a <> 'na' and ans_b <> 'na') as a2, count(*) filter (where ans_a <> 'na' and ans_b <> 'na') as a3 from r group by all),
f as (select *, (abs(m1) < 0.05 or a1 < 4) and n3 > 5 as two from e), g as (select *, two and abs(m2) < 0.03 and n3 > 10 as three from f),
h as (select *, case when three then m3 when two then m2 else m1 end as m from g)
select pair_id, m1 as margin_initial, m as margin_final, case when three then a3 when two then a2 else a1 end as n_aligned_final, n1 as k_selected, case when three then n3 when two then n2 else n1 end as k_after_escalation,
  two as escalated, three as fallback, case when m > 0.05 then 'A' when m < -0.05 then 'B' else 'Tie' end as predicted_winner from h
"""


@query("c11_escalation", _ESC)
def _(spark, sf):
    facts = X.answers(spark, sf)
    ranked = W.ranked(facts.select("pair_id", "qid"), ["pair_id"], [(F.col("qid") * 7) % 11, F.col("qid")])
    return S.escalated(facts, ranked, ["pair_id"], 5, n_min=4)


@query("c12_vote_counts", "select pair_id, count(*) filter (where c > 0) as n_a, count(*) filter (where c < 0) as n_b, coalesce(sum(w) filter (where c > 0), 0) as w_a, coalesce(sum(w) filter (where c < 0), 0) as w_b from contrib left join weights using (pair_id, qid) group by all")
def _(spark, sf):
    facts = X.answers(spark, sf)
    rows = facts.join(X.weights(facts), ["pair_id", "qid"], "left").withColumn("c", S.contribution(F.col("ans_a"), F.col("ans_b")))
    side = lambda cond: (F.count_if(cond), F.coalesce(F.sum(F.when(cond, F.col("w"))), F.lit(0.0)))
    (na, wa), (nb, wb) = side(F.col("c") > 0), side(F.col("c") < 0)
    return rows.groupBy("pair_id").agg(na.alias("n_a"), nb.alias("n_b"), wa.alias("w_a"), wb.alias("w_b"))


@query(
    "c28_judge_pair_summary",
    _COUNTS + "select a.pair_id, a.y / (a.y + a.o) as score_a, b.y / (b.y + b.o) as score_b, (a.y + a.o) / a.n as coverage_a, (b.y + b.o) / b.n as coverage_b, b.y / (b.y + b.o) - a.y / (a.y + a.o) as delta, "
    "case when b.y / (b.y + b.o) - a.y / (a.y + a.o) > 0.05 then 'B' when b.y / (b.y + b.o) - a.y / (a.y + a.o) < -0.05 then 'A' else 'Tie' end as winner from sides a join sides b on a.pair_id = b.pair_id and a.side = 'a' and b.side = 'b'",
)
def _(spark, sf):
    counts = S.side_counts(X.with_gaps(X.answers(spark, sf)), ["pair_id"])
    answered = lambda s: F.col(f"n_yes_{s}") + F.col(f"n_no_{s}")
    share = lambda s: F.try_divide(F.col(f"n_yes_{s}"), answered(s))
    rows = counts.select("pair_id", share("a").alias("score_a"), share("b").alias("score_b"), (answered("a") / F.col("expected_n")).alias("coverage_a"), (answered("b") / F.col("expected_n")).alias("coverage_b"))
    return rows.withColumn("delta", F.col("score_b") - F.col("score_a")).withColumn("winner", S.winner_from_delta(F.col("delta")))
