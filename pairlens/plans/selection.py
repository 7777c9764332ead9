"""Queries of rankings, quotas, priors, shuffles and ranking metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlens.operators import scoring as S
from pairlens.operators import selection as W
from pairlens.operators.windows import dealt, one_value, small_broadcast
from pairlens.sources import fixtures as X

from . import scoring as Q
from .registry import query

_RANK = ", r as (select pair_id, domain, winner, qid, dimension, sub_aspect, c, row_number() over (partition by pair_id order by (qid * 7) % 11, qid) as rank from contrib)\n"


def ranking(spark, sf):
    facts = X.answers(spark, sf)
    rows = facts.select("pair_id", "domain", "winner", "qid", "dimension", "sub_aspect", S.contribution(F.col("ans_a"), F.col("ans_b")).alias("c"))
    return W.ranked(rows, ["pair_id"], [(F.col("qid") * 7) % 11, F.col("qid")])


@query("w2_local_numbers", "select domain, qid, cast(row_number() over (partition by domain order by qid) as integer) as q from active")
def _(spark, sf):
    return W.local_numbers(X.active_bank(spark, sf)).select("domain", "qid", "q")


@query("w1_global_numbering", "select dimension, sub_aspect, qid, cast(row_number() over (order by dimension, sub_aspect, qid) as integer) as global_qid from bank")
def _(spark, sf):
    from pairlens.sources.bank import number_questions

    return number_questions(X.bank(spark, sf), ["dimension", "sub_aspect", "qid"], "global_qid").select("dimension", "sub_aspect", "qid", "global_qid")


@query("a7_domain_ranking", Q._LOO + ", m as (select a.domain, a.qid, coalesce(avg(u2_abs_contrib), 0) as mean_u2 from active a left join util u on a.domain = u.domain and a.qid = u.qid group by all) select domain, qid, mean_u2, cast(row_number() over (partition by domain order by mean_u2 desc, qid) as integer) as rank from m")
def _(spark, sf):
    return W.domain_ranking(Q.oracle_questions(spark, sf), X.active_bank(spark, sf))


_QUOTA = _RANK + """
, f as (select *, min(rank) over (partition by pair_id, dimension) as first, row_number() over (partition by pair_id, dimension order by rank) as i,
  (select count(distinct dimension) from active a where a.domain = r.domain) as dims, least(12, count(*) over (partition by pair_id)) as k from r),
p as (select *, case when i <= k // dims then 1 else 2 end as phase from f),
o as (select *, row_number() over (partition by pair_id order by phase, case when phase = 1 then first else 0 end, rank) as pick from p)
select pair_id, qid, dimension, cast(phase as integer) as phase, cast(pick as integer) as pick from o where pick <= k
"""


@query("w4_topk_quota", _QUOTA)
def _(spark, sf):
    return W.top_k_with_quota(ranking(spark, sf).select("pair_id", "qid", "dimension", "rank"), ["pair_id"], 12).select("pair_id", "qid", "dimension", "phase", "pick")


@query(
    "w5_sub_aspect_cap",
    _RANK + ", i as (select *, row_number() over (partition by pair_id, sub_aspect order by rank) as i from r), s as (select *, sum(case when i <= 2 then 1 else 0 end) over (partition by pair_id order by rank rows unbounded preceding) as n from i), "
    "t as (select *, i <= 2 and n <= 10 as selected from s) select pair_id, qid, selected, cast(row_number() over (partition by pair_id order by selected desc, rank) as integer) as place from t",
)
def _(spark, sf):
    return W.capped(ranking(spark, sf).select("pair_id", "qid", "sub_aspect", "rank"), ["pair_id"], "sub_aspect", 2, 10).select("pair_id", "qid", "selected", "place")


_PRIOR = _RANK + """
, v as (select qid, count(*) as n, count(*) filter (where c <> 0) as n_nonzero, count(*) filter (where c > 0 and winner = 'A' or c < 0 and winner = 'B') as k from r group by qid),
priors as (select qid, n, n_nonzero, n_nonzero / n as nonzero_rate, case when n_nonzero >= 5 then k / n_nonzero else 0.5::double end as direction_accuracy,
  n_nonzero / n * greatest(case when n_nonzero >= 5 then k / n_nonzero else 0.5::double end - 0.5::double, 0) as prior from v)
"""


@query("a8_question_priors", _PRIOR + "select * from priors")
def _(spark, sf):
    return W.question_priors(ranking(spark, sf))


@query("w6_rerank_by_prior", _PRIOR + ", s as (select pair_id, r.qid, rank, pow(1.0::double / rank, 1.0::double) * pow(0.05::double + prior, 1.0::double) as score from r join priors using (qid)) select pair_id, qid, cast(rank as integer) as rank, round(score, 9) as score, cast(row_number() over (partition by pair_id order by score desc, rank) as integer) as new_rank from s")
def _(spark, sf):
    rows = ranking(spark, sf)
    return W.reranked(rows.select("pair_id", "qid", "rank"), ["pair_id"], W.question_priors(rows)).select("pair_id", "qid", "rank", F.round("score", 9).alias("score"), "new_rank")


@query(
    "a36_rerank_summary",
    _PRIOR + ", s as (select pair_id, r.qid, rank, prior, row_number() over (partition by pair_id order by (1.0::double / rank) * (0.05::double + prior) desc, rank) as new_rank from r join priors using (qid)), "
    "p as (select pair_id, count(*) filter (where rank <= 10 and new_rank <= 10) / 10 as o, avg(prior) filter (where rank <= 10) as b, avg(prior) filter (where new_rank <= 10) as a from s group by all) "
    "select count(*) as n, round(avg(o), 9) as mean_overlap, count(*) filter (where o < 1) as n_changed, round(avg(b), 9) as prior_before, round(avg(a), 9) as prior_after from p",
)
def _(spark, sf):
    rows = ranking(spark, sf)
    new = W.reranked(rows.select("pair_id", "qid", "rank"), ["pair_id"], W.question_priors(rows))
    old10, new10 = F.col("rank") <= 10, F.col("new_rank") <= 10
    per = new.groupBy("pair_id").agg((F.count_if(old10 & new10) / 10).alias("o"), F.avg(F.when(old10, F.col("prior"))).alias("b"), F.avg(F.when(new10, F.col("prior"))).alias("a"))
    return per.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o"), 9).alias("mean_overlap"), F.count_if(F.col("o") < 1).alias("n_changed"), F.round(F.avg("b"), 9).alias("prior_before"), F.round(F.avg("a"), 9).alias("prior_after"))


@query("w8_stable_shuffle", "select pair_id, qid, cast(row_number() over (partition by pair_id order by sha256('42:' || pair_id || ':' || qid), qid) as integer) as rank from contrib")
def _(spark, sf):
    return W.shuffled(X.answers(spark, sf).select("pair_id", "qid"), ["pair_id"], 42)


@query("w9_completed_ranking", ", part as (select pair_id, qid, row_number() over (partition by pair_id order by qid desc) as r from contrib where qid % 3 = 0) select c.pair_id, c.qid, cast(row_number() over (partition by c.pair_id order by r asc nulls last, c.qid) as integer) as rank from contrib c left join part p on c.pair_id = p.pair_id and c.qid = p.qid")
def _(spark, sf):
    active = X.answers(spark, sf).select("pair_id", "qid")
    some = W.ranked(active.filter(F.col("qid") % 3 == 0), ["pair_id"], [F.desc("qid")])
    return W.completed(some, active, ["pair_id"])


@query(
    "w7_rank_by_embedding_score",
    ", v as (select vec_id, embedding::double[] as e, count(*) over () as n from embeddings), s as (select a.pair_id, a.qid, list_inner_product(x.e, y.e) as score from contrib a "
    "join v x on x.vec_id = a.pair_id % x.n join v y on y.vec_id = (100 + a.qid) % y.n) "
    "select pair_id, qid, cast(row_number() over (partition by pair_id order by round(score, 6) desc, qid) as integer) as rank from s",
)
def _(spark, sf):
    """Pairs and questions take their vectors in turn from the embeddings; questions' vectors are broadcast with the bank.

    Pairs are dealt with their vectors, before they grow to facts.
    """
    v = X.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    count = one_value(v.agg(F.count(F.lit(1))))
    questions = X.bank(spark, sf).select("qid", ((100 + F.col("qid")) % count).alias("vec_id")).join(v, "vec_id").select("qid", F.col("e").alias("y"))
    facts = X.slim_pairs(spark, sf).withColumn("vec_id", F.col("pair_id") % count).join(v, "vec_id").select("pair_id", "domain", F.col("e").alias("x"))
    rows = dealt(facts, ["pair_id"], X.most_facts(spark, sf)).join(small_broadcast(X.active_bank(spark, sf).select("domain", "qid")), "domain").join(small_broadcast(questions), "qid")
    score = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p)
    return W.ranked(rows.select("pair_id", "qid", F.round(score, 6).alias("s")), ["pair_id"], [F.desc("s"), F.col("qid")]).select("pair_id", "qid", "rank")


@query("p26_softmax", ", s as (select pair_id, qid, exp((w - max(w) over (partition by pair_id)) / 0.5::double) as e from weights) select pair_id, qid, round(e / sum(e) over (partition by pair_id), 9) as p from s")
def _(spark, sf):
    rows = X.weights(X.answers(spark, sf)).groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("qid", "w"))).alias("x"))
    rows = rows.select("pair_id", F.explode(F.arrays_zip(F.col("x.qid").alias("qid"), W.softmax(F.col("x.w"), 0.5).alias("p"))).alias("z"))
    return rows.select("pair_id", "z.qid", F.round("z.p", 9).alias("p"))


@query("p27_clamped_importance", "select c.pair_id, c.qid, coalesce(greatest(0, least(5, case when c.qid % 6 = 0 then null else (c.pair_id % 10 - 2) * 1.5::double end)), 1.0::double) as importance from contrib c")
def _(spark, sf):
    raw = F.when(F.col("qid") % 6 != 0, (F.col("pair_id") % 10 - 2) * 1.5)
    return X.answers(spark, sf).select("pair_id", "qid", W.clamped(raw, missing=1.0).alias("importance"))


_ALIGN = _RANK + Q._H + """
, s as (select r.pair_id, count(*) filter (where h > 0) as n, count(*) filter (where h > 0 and rank <= 5) as a, count(*) filter (where h > 0 and rank <= 10) as b from r left join hr using (pair_id, qid) group by r.pair_id)
"""


@query("a35_human_alignment", _ALIGN + "select count(*) as n, avg(a / n) as selected_recall, avg(b / n) as asked_recall from s where n > 0")
def _(spark, sf):
    rows = ranking(spark, sf)
    sets = rows.groupBy("pair_id").agg(F.collect_set(F.when(F.col("rank") <= 5, F.col("qid"))).alias("s"), F.collect_set(F.when(F.col("rank") <= 10, F.col("qid"))).alias("a"))
    human = Q.relevance(rows).groupBy("pair_id").agg(F.collect_set("qid").alias("r"))
    selected, asked = W.alignment(F.col("s"), F.col("a"), F.col("r"))
    return sets.join(human, "pair_id").agg(F.count(F.lit(1)).alias("n"), F.avg(selected).alias("selected_recall"), F.avg(asked).alias("asked_recall"))


_GAIN = _RANK + Q._H + ", g as (select r.pair_id, r.qid, rank, winner, c, coalesce(h, 0) as gain from r left join hr using (pair_id, qid)), i as (select *, row_number() over (partition by pair_id order by gain desc, qid) as ideal from g)\n"


def gains(spark, sf):
    rows = ranking(spark, sf)
    return rows.join(Q.relevance(rows), ["pair_id", "qid"], "left").withColumn("gain", F.coalesce("h", F.lit(0.0)))


@query("w14_ndcg", _GAIN + ", d as (select pair_id, sum(case when rank <= 10 then (pow(2, gain) - 1) / log2(rank + 1) else 0 end) as dcg, sum(case when ideal <= 10 then (pow(2, gain) - 1) / log2(ideal + 1) else 0 end) as idcg from i group by pair_id) select pair_id, round(case when idcg > 0 then dcg / idcg else 0 end, 9) as ndcg from d")
def _(spark, sf):
    return W.ndcg(gains(spark, sf), ["pair_id"], 10).withColumn("ndcg", F.round("ndcg", 9))


@query("w15_positive_retrieval", _GAIN + "select pair_id, count(*) filter (where rank <= 10 and gain > 0) / count(*) filter (where gain > 0) as recall, count(*) filter (where rank <= 10 and gain > 0) / 10 as precision from g group by pair_id having count(*) filter (where gain > 0) > 0")
def _(spark, sf):
    return W.retrieval(gains(spark, sf), ["pair_id"], 10)


@query("w16_list_mle", _GAIN + ", t as (select pair_id, ideal, 1.0::double / rank as score from i), l as (select pair_id, ln(sum(exp(score)) over (partition by pair_id order by ideal rows between current row and unbounded following)) - score as l from t) select pair_id, round(sum(l), 6) as loss from l group by pair_id")
def _(spark, sf):
    rows = W.ranked(gains(spark, sf), ["pair_id"], [F.desc("gain"), F.col("qid")], "ideal").select("pair_id", F.col("ideal").alias("rank"), (1 / F.col("rank")).alias("score"))
    return W.list_mle(rows, ["pair_id"]).withColumn("loss", F.round("loss", 6))


@query("w17_contrastive_gate", _GAIN + "select pair_id, count(*) filter (where ideal <= 6 and (winner = 'A' and c > 0 or winner = 'B' and c < 0)) as n_aligned, count(*) filter (where ideal <= 6 and (winner = 'A' and c > 0 or winner = 'B' and c < 0)) < 2 as gated from i group by pair_id")
def _(spark, sf):
    rows = gains(spark, sf).select("pair_id", "qid", F.col("gain").alias("h"), S.gold_aligned(F.col("c"), F.col("winner")).alias("aligned"))
    return W.contrastive_gate(rows, ["pair_id"], 6, 2)
