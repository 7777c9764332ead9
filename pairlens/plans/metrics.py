"""Queries of accuracy, robustness, consistency, sweeps and statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pairlens.operators import metrics as M
from pairlens.operators import scoring as S
from pairlens.sources import fixtures as X

from . import scoring as Q
from .registry import query, rounded

_F1 = "coalesce(2.0 * count(*) filter (where v and winner = '{0}' and predicted_winner = '{0}') / nullif(count(*) filter (where v and winner = '{0}') + count(*) filter (where v and predicted_winner = '{0}'), 0), 0)"
_CLASSES = f"""
, j as (select *, coalesce(predicted_winner in ('A', 'B'), false) as v from judged),
g as (select domain, grouping(domain) as al, count(*) as n_total, count(*) filter (where v) as n_valid, count(*) filter (where predicted_winner = 'Tie') as n_tie, count(*) filter (where predicted_winner is null) as n_unparseable,
  count(*) filter (where v and winner = predicted_winner) as k, count(*) filter (where predicted_winner = 'A') as pa, {_F1.format('A')} as fa, {_F1.format('B')} as fb,
  count(*) filter (where v and winner = 'Tie') > 0 as t, count(*) filter (where v and (winner = 'A' or predicted_winner = 'A')) > 0 as ha, count(*) filter (where v and (winner = 'B' or predicted_winner = 'B')) > 0 as hb from j group by rollup (domain))
select domain, n_total, n_valid, n_tie, n_unparseable, n_valid / n_total as parse_rate, k / n_total as real_accuracy, coalesce(k / nullif(n_valid, 0), 0) as valid_accuracy,
  case when al = 1 then (fa + fb) / 2 else (fa + fb) / greatest(cast(ha as integer) + cast(hb as integer) + cast(t as integer), 1) end as macro_f1, coalesce(pa / nullif(n_valid, 0), 0) as position_bias_a from g where al = 1 or n_valid > 0
"""


def flagship(spark, sf):
    """Pairs, their active questions, contributions, margins, verdicts, and metrics overall and per domain."""
    return M.classification(Q.judged(spark, sf))


query("c13_classification_metrics", _CLASSES)(flagship)


@query(
    "c14_classification_report",
    ", v as (select * from judged where predicted_winner in ('A', 'B')), l as (select unnest(['A', 'B']) as label), c as (select label, count(*) filter (where winner = label and predicted_winner = label) as h, count(*) filter (where predicted_winner = label) as s, count(*) filter (where winner = label) as g from l, v group by label) "
    "select label, coalesce(h / nullif(s, 0), 0) as precision, coalesce(h / nullif(g, 0), 0) as recall, coalesce(2.0 * h / nullif(s + g, 0), 0) as f1, g as support from c",
)
def _(spark, sf):
    return M.report(Q.judged(spark, sf))


@query("a10_score_gaps", Q._COUNTS + ", s as (select pair_id, side, y / (y + o) as score from sides), w as (select a.pair_id, a.score as x, b.score as y, predicted_winner from s a join s b on a.pair_id = b.pair_id and a.side = 'a' and b.side = 'b' join judged j on j.pair_id = a.pair_id) select round(avg(x), 9) as avg_score_a, round(avg(y), 9) as avg_score_b, round(avg(x - y), 9) as avg_score_gap, round(avg(abs(x - y)) filter (where predicted_winner = 'Tie'), 9) as avg_tie_score_gap from w")
def _(spark, sf):
    counts = S.side_counts(X.with_gaps(X.answers(spark, sf)), ["pair_id"])
    score = lambda s: F.try_divide(F.col(f"n_yes_{s}"), F.col(f"n_yes_{s}") + F.col(f"n_no_{s}")).alias(f"score_{s}")
    gaps = M.score_gaps(counts.select("pair_id", score("a"), score("b")).join(Q.judged(spark, sf).select("pair_id", "predicted_winner"), "pair_id"))
    return rounded(gaps, *gaps.columns)


@query("a1_value_counts", "select 'winner' as what, winner as value, count(*) as n from preds group by all union all select 'domain', domain, count(*) from preds group by all union all select 'predicted_winner', predicted_winner, count(*) from preds group by all")
def _(spark, sf):
    p = Q.predictions(spark, sf)
    long = p.select(F.explode(F.array(*(F.struct(F.lit(c).alias("what"), F.col(c).alias("value")) for c in ("winner", "domain", "predicted_winner")))).alias("x")).select("x.*")
    return long.groupBy("what", "value").agg(F.count(F.lit(1)).alias("n"))


#: swapped-order predictions: the flipped verdict, every fifth pair locked to its position, some unparseable, some keys twice
_SWAP = """
, swp as (select pair_id, domain, winner, preference_strength, predicted_winner as original, case when pair_id % 17 = 3 then null when pair_id % 5 = 0 then predicted_winner when predicted_winner = 'A' then 'B' when predicted_winner = 'B' then 'A' else predicted_winner end as swapped from judged),
pert as (select pair_id, case winner when 'A' then 'B' when 'B' then 'A' else winner end as winner, swapped as predicted_winner from swp union all select pair_id, case winner when 'A' then 'B' when 'B' then 'A' else winner end, swapped from swp where pair_id % 17 = 0)
"""


def swaps(spark, sf):
    p = F.col("predicted_winner")
    said = F.when(F.col("pair_id") % 17 == 3, F.lit(None)).when(F.col("pair_id") % 5 == 0, p).otherwise(S.flipped(p))
    return Q.judged(spark, sf).select("pair_id", "domain", "winner", "preference_strength", p.alias("original"), said.alias("swapped"))


def perturbed(spark, sf):
    copies = F.when(F.col("pair_id") % 17 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return swaps(spark, sf).select("pair_id", S.flipped(F.col("winner")).alias("winner"), F.col("swapped").alias("predicted_winner"), F.explode(copies).alias("copy")).drop("copy")


@query(
    "c15_robustness",
    _SWAP + ", b as (select j.domain, coalesce(j.winner = j.predicted_winner, false) as o, coalesce(p.winner = p.predicted_winner, false) as q, (case j.predicted_winner when 'A' then 'B' when 'B' then 'A' else j.predicted_winner end) is not distinct from p.predicted_winner as same from judged j join pert p using (pair_id)), "
    "r as (select domain, count(*) as n, avg(o::double) as acc_original, avg(q::double) as acc_perturbed, avg(same::double) as invariance from b group by rollup (domain)) select *, acc_original - acc_perturbed as acc_drop, 1 - invariance as flip_rate from r",
)
def _(spark, sf):
    return M.robustness(Q.judged(spark, sf), perturbed(spark, sf), "pair_id", swapped=True)


@query("j1_fan_out_join", _SWAP + "select count(*) as n_rows, count(distinct pair_id) as n_keys, coalesce(count(*) filter (where c > 1), 0) as n_repeated from (select pair_id, count(*) over (partition by pair_id) as c from pert)")
def _(spark, sf):
    return M.key_uniqueness(perturbed(spark, sf), "pair_id")


_CATEGORY = _SWAP + ", cat as (select *, case when not coalesce(original in ('A', 'B') and swapped in ('A', 'B'), false) then 'unparseable' when original <> swapped then 'consistent' else 'position_locked' end as c from swp)\n"


@query("c16_swap_categories", _CATEGORY + "select pair_id, c as category from cat")
def _(spark, sf):
    return swaps(spark, sf).select("pair_id", M.swap_category(F.col("original"), F.col("swapped")).alias("category"))


@query(
    "c16_swap_consistency",
    _CATEGORY + "select preference_strength, count(*) as n, count(*) filter (where c = 'consistent') as n_consistent, count(*) filter (where c = 'position_locked') as n_locked, count(*) filter (where c = 'unparseable') as n_unparseable, "
    "count(*) filter (where c = 'consistent') / nullif(count(*) filter (where c <> 'unparseable'), 0) as invariance_score, count(*) filter (where c = 'position_locked' and original = 'A') as locked_first, count(*) filter (where c = 'position_locked' and original = 'B') as locked_second from cat group by rollup (preference_strength)",
)
def _(spark, sf):
    return M.swap_consistency(swaps(spark, sf), "preference_strength")


@query(
    "c17_warmup_swap",
    _CATEGORY + ", x as (select *, c = 'consistent' as agree, c = 'consistent' and original = winner as k from cat) select count(*) as n, avg(agree::double) as agreement, count(*) filter (where k) / nullif(count(*) filter (where agree), 0) as accuracy_consistent, avg(k::double) as strict_accuracy, abs(avg(coalesce(original = 'A', false)::double) + avg(coalesce(swapped = 'A', false)::double) - 1) as position_bias from x",
)
def _(spark, sf):
    return M.warmup_swap(swaps(spark, sf))


_TUNED = ", tuned as (select pair_id, case when pair_id % 4 = 1 then winner else predicted_winner end as p from judged)\n"


def tuned(spark, sf):
    return Q.judged(spark, sf).withColumn("predicted_winner", F.when(F.col("pair_id") % 4 == 1, F.col("winner")).otherwise(F.col("predicted_winner")))


@query(
    "c18_error_migration",
    _TUNED + ", m as (select winner, preference_strength, coalesce(predicted_winner = winner, false) as w, coalesce(p = winner, false) as n from judged join tuned using (pair_id)) "
    "select winner, case when w and n then 'still_correct' when n then 'fixed' when w then 'regressed' else 'still_wrong' end as migration, count(*) as n, avg(preference_strength) as mean_strength from m group by all",
)
def _(spark, sf):
    return M.migration(Q.judged(spark, sf), tuned(spark, sf), "pair_id")


@query("c19_confusion", "select winner, count(*) filter (where predicted_winner = 'A') as pred_a, count(*) filter (where predicted_winner = 'B') as pred_b, count(*) filter (where predicted_winner = 'Tie') as pred_tie, count(*) filter (where predicted_winner is null) as pred_none from judged group by winner")
def _(spark, sf):
    return M.confusion(Q.judged(spark, sf))


DELTAS = [0.0, 0.02, 0.05, 0.1, 0.2]


@query(
    "c20_threshold_sweep",
    f", s as (select winner, d as tie_delta, case when margin > d then 'A' when margin < -d then 'B' else 'Tie' end as p from margins, (select unnest({DELTAS}::double[]) as d)) "
    "select tie_delta, count(*) as n_total, count(*) filter (where p <> 'Tie') as n_valid, count(*) filter (where p = 'Tie') / count(*) as tie_rate, coalesce(count(*) filter (where p <> 'Tie' and p = winner) / nullif(count(*) filter (where p <> 'Tie'), 0), 0) as valid_accuracy, count(*) filter (where p <> 'Tie' and p = winner) / count(*) as effective_accuracy from s group by tie_delta",
)
def _(spark, sf):
    return M.threshold_sweep(S.margins(X.answers(spark, sf), Q.KEYS), DELTAS)


_RUNS = """
, q as (select pair_id, winner, qid, c, row_number() over (partition by pair_id order by (qid * 7) % 11, qid) as rank from contrib), ks as (select unnest([5, 10, 15, 20, 1000]) as k),
m as (select k, pair_id, winner, sum(c) / count(*) as margin, count(*) as n from q, ks where rank <= k group by all),
runs as (select 'k' || k as run, count(*) as n_total, 'split' as split_hash, avg(n) as avg_k, count(*) filter (where margin > 0.05 and winner = 'A' or margin < -0.05 and winner = 'B') / count(*) as real_accuracy from m group by k)
"""


def runs(spark, sf):
    """The same verdicts with the first 5, 10, 15, 20 and all questions of a ranking, as run records."""
    from .selection import ranking

    rows = ranking(spark, sf).select("pair_id", "winner", "c", "rank", F.explode(F.array(*map(F.lit, (5, 10, 15, 20, 1000)))).alias("k")).filter("rank <= k")
    m = rows.groupBy("k", "pair_id", "winner").agg((F.sum("c") / F.count(F.lit(1))).alias("margin"), F.count(F.lit(1)).alias("n"))
    right = F.count_if(S.winner_from_margin(F.col("margin")).isin("A", "B") & (S.winner_from_margin(F.col("margin")) == F.col("winner")))
    return m.groupBy(F.concat(F.lit("k"), F.col("k").cast("string")).alias("run")).agg(F.count(F.lit(1)).alias("n_total"), F.first(F.lit("split")).alias("split_hash"), F.avg("n").alias("avg_k"), M.share(right, F.count(F.lit(1))).alias("real_accuracy"))


@query("w10_pareto_frontier", _RUNS + ", o as (select *, coalesce(max(real_accuracy) over (order by avg_k, real_accuracy desc rows between unbounded preceding and 1 preceding), -1) as best from runs) select run, avg_k, real_accuracy from o where real_accuracy >= best")
def _(spark, sf):
    return M.pareto(runs(spark, sf), "avg_k", "real_accuracy").select("run", "avg_k", "real_accuracy")


@query("c21_leaderboard", _RUNS + "select *, true as comparable, cast(row_number() over (order by coalesce(real_accuracy, 0) desc, run) as integer) as place from runs")
def _(spark, sf):
    return M.guarded_leaderboard(runs(spark, sf))


@query("c22_condition_comparison", _RUNS + ", b as (select max(real_accuracy) as best, max(real_accuracy) filter (where run = 'k1000') as base from runs) select run, real_accuracy, real_accuracy - base as delta_to_full, real_accuracy = best as is_best from runs, b")
def _(spark, sf):
    r = runs(spark, sf)
    whole = Window.partitionBy(F.lit(1))  # a few runs
    best, base = F.max("real_accuracy").over(whole), F.max(F.when(F.col("run") == "k1000", F.col("real_accuracy"))).over(whole)
    return r.select("run", "real_accuracy", (F.col("real_accuracy") - base).alias("delta_to_full"), (F.col("real_accuracy") == best).alias("is_best"))


@query("a9_oracle_agreement", "select count(*) as n_total, count(predicted_winner) as n_valid, avg((predicted_winner = winner)::double) as agreement_valid, count(*) filter (where predicted_winner = winner) / count(*) as agreement_total from judged")
def _(spark, sf):
    right = F.col("predicted_winner") == F.col("winner")
    return Q.judged(spark, sf).agg(F.count(F.lit(1)).alias("n_total"), F.count("predicted_winner").alias("n_valid"), F.avg(right.cast("double")).alias("agreement_valid"), M.share(F.count_if(right), F.count(F.lit(1))).alias("agreement_total"))


@query("a11_comparative_metrics", "select round(count(*) filter (where predicted_winner = winner) / count(*), 4) as accuracy_three_way, round(count(*) filter (where predicted_winner in ('A', 'B') and predicted_winner = winner) / count(*), 4) as effective_accuracy, round(count(*) filter (where predicted_winner = 'Tie') / count(*), 4) as tie_rate from judged")
def _(spark, sf):
    p, n = F.col("predicted_winner"), F.count(F.lit(1))
    rate = lambda c: F.round(M.share(F.count_if(c), n), 4)
    return Q.judged(spark, sf).agg(rate(p == F.col("winner")).alias("accuracy_three_way"), rate(p.isin("A", "B") & (p == F.col("winner"))).alias("effective_accuracy"), rate(p == "Tie").alias("tie_rate"))


@query("a29_teacher_comparison", _TUNED + "select domain, count(*) as n, avg(coalesce(predicted_winner = winner, false)::double) as acc_base, avg(coalesce(p = winner, false)::double) as acc_tuned, avg((predicted_winner = winner)::double) filter (where predicted_winner in ('A', 'B')) as acc_base_no_ties, count(*) filter (where predicted_winner is not distinct from p) / count(*) as same from judged join tuned using (pair_id) group by rollup (domain)")
def _(spark, sf):
    base = Q.judged(spark, sf)
    rows = base.join(tuned(spark, sf).select("pair_id", F.col("predicted_winner").alias("p")), "pair_id")
    said, gold = F.col("predicted_winner"), F.col("winner")
    hit = lambda c: F.avg(F.coalesce(c == gold, F.lit(False)).cast("double"))
    return rows.rollup("domain").agg(F.count(F.lit(1)).alias("n"), hit(said).alias("acc_base"), hit(F.col("p")).alias("acc_tuned"), F.avg(F.when(said.isin("A", "B"), (said == gold).cast("double"))).alias("acc_base_no_ties"), M.share(F.count_if(said.eqNullSafe(F.col("p"))), F.count(F.lit(1))).alias("same"))


@query("w21_latency_quantiles", "select event_type, count(*) as n, round(quantile_cont(value, 0.5), 9) as p50, round(quantile_cont(value, 0.9), 9) as p90 from events group by event_type")
def _(spark, sf):
    return rounded(X.table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.percentile("value", F.lit(0.5)).alias("p50"), F.percentile("value", F.lit(0.9)).alias("p90")), "p50", "p90")


@query("a21_five_numbers", "select round(avg(margin), 9) as mean, round(quantile_cont(margin, 0.5), 9) as median, round(quantile_cont(margin, 0.25), 9) as p25, round(quantile_cont(margin, 0.75), 9) as p75, min(margin) as min, max(margin) as max from margins")
def _(spark, sf):
    return rounded(M.five_numbers(S.margins(X.answers(spark, sf), Q.KEYS), "margin"), "mean", "median", "p25", "p75")


@query("a22_spearman", ", r as (select m.margin, p.ca - p.cb as d from margins m join pairs p using (pair_id)), k as (select rank() over (order by margin) + (count(*) over (partition by margin) - 1) / 2 as x, rank() over (order by d) + (count(*) over (partition by d) - 1) / 2 as y from r) select count(*) as n, round(corr(x, y), 9) as rho from k")
def _(spark, sf):
    rows = S.margins(X.answers(spark, sf), ["pair_id"]).join(X.slim_pairs(spark, sf).select("pair_id", (F.col("ca") - F.col("cb")).alias("d")), "pair_id")
    return M.spearman(rows, "margin", "d").withColumn("rho", F.round("rho", 9))


@query("a23_pearson", "select count(*) as n, round(corr(m.margin, p.ca - p.cb), 9) as r from margins m join pairs p using (pair_id)")
def _(spark, sf):
    rows = S.margins(X.answers(spark, sf), ["pair_id"]).join(X.slim_pairs(spark, sf).select("pair_id", (F.col("ca") - F.col("cb")).alias("d")), "pair_id")
    return M.pearson(rows, "margin", "d").withColumn("r", F.round("r", 9))


@query("a24_summary_line", "select count(margin) as n, round(avg(margin), 9) as mean, round(stddev_samp(margin), 9) as std, min(margin) as min, max(margin) as max from margins")
def _(spark, sf):
    return rounded(M.summary_line(S.margins(X.answers(spark, sf), Q.KEYS), "margin"), "mean", "std")
