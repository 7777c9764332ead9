"""Queries of rewards over traces and pairs, and audits of rollouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlens.functions import parsers as P
from pairlens.functions import rewards as R
from pairlens.operators import rollouts as O
from pairlens.sources import fixtures as X

from .parsing import _TRACES, traces
from .registry import query

_T = _TRACES + """
, tr as (select pair_id, winner as gold, case when pair_id % 9 in (4, 6) then null else winner end as said, case pair_id % 9 when 4 then 0 else 10 end as nq, pair_id % 9 not in (4, 5) as matched,
  count(*) filter (where v = 'A' and pair_id % 9 <> 4 and not (pair_id % 9 = 5 and q = 10)) as a, count(*) filter (where v = 'B' and pair_id % 9 <> 4 and not (pair_id % 9 = 5 and q = 10)) as b,
  count(*) filter (where v = 'tie' and pair_id % 9 <> 4 and not (pair_id % 9 = 5 and q = 10)) as t, case pair_id % 9 when 4 then 0 when 5 then 9 else 10 end as n from tq group by pair_id, winner),
ts as (select *, pair_id % 9 not in (4, 5, 6) as ok, 0.25::double + (nq > 0)::integer * 0.25::double + (matched)::integer * 0.25::double + (said is not null)::integer * 0.25::double as fmt, coalesce((a + b) / nullif(n, 0), 0) as disc,
  coalesce(case gold when 'A' then (a - b) / nullif(n, 0) when 'B' then (b - a) / nullif(n, 0) else 2.0::double * t / nullif(n, 0) - 1 end, 0) as im, case when coalesce(greatest(a, b) / nullif(n, 0) > 0.9, false) then -0.1::double else 0 end as dom,
  case when said is null then -0.5::double when gold in ('A', 'B') and said = 'Tie' then -1 when said = gold then 1 else -1 end as win from tr)
"""


def parsed(spark, sf):
    """Traces with their parsed form; a generator between keeps the optimiser from copying its regular expressions into every use."""
    return traces(spark, sf).withColumn("t", F.explode(F.array(P.trace(F.col("raw")))))


@query("r1_parse_ok", _T + "select pair_id, ok as parse_ok, ok and said in ('A', 'B') as parse_ok_ab from ts")
def _(spark, sf):
    return parsed(spark, sf).select("pair_id", R.parse_ok(F.col("t")).alias("parse_ok"), R.parse_ok(F.col("t"), ab_only=True).alias("parse_ok_ab"))


@query("r2_r5_components", _T + "select pair_id, fmt as format_score, disc as discriminative, im as item_margin, dom as dominance, win as winner_score from ts")
def _(spark, sf):
    """R2, R3, R4, R5 and R7."""
    t, gold = F.col("t"), F.col("winner")
    return parsed(spark, sf).select("pair_id", R.format_score(t, F.col("raw")).alias("format_score"), R.discriminative(t).alias("discriminative"), R.item_margin(t, gold).alias("item_margin"), R.dominance(t).alias("dominance"), R.winner_score(t, gold).alias("winner_score"))


#: vectors of documents, some zero, one label with a single vector
_UNIT = "e as (select vec_id, case when vec_id % 97 = 3 then -1 else label end as label, case when vec_id % 7 = 0 then list_transform(embedding::double[], lambda x: 0.0::double) else embedding::double[] end as e from embeddings where vec_id % 97 <> 3 or vec_id = 3), u as (select vec_id, label, sqrt(list_inner_product(e, e)) as norm, case when norm > 0 then list_transform(e, lambda x: x / norm) else e end as v from e)"


@query("r6_diversity", ", " + _UNIT + ", p as (select x.label, count(distinct x.vec_id) as n, coalesce(sum(list_inner_product(x.v, y.v)) filter (where x.vec_id <> y.vec_id), 0) as s from u x join u y on x.label = y.label group by x.label) select label, round(greatest(0, least(1, 1 - coalesce(s / nullif(n * (n - 1), 0), 0))), 6) as diversity from p", prelude=True)
def _(spark, sf):
    """The diversity of the vectors of each label."""
    i = F.col("vec_id")
    e = F.col("embedding").cast("array<double>")
    rows = X.table(spark, sf, "embeddings").filter((i % 97 != 3) | (i == 3)).select(F.when(i % 97 == 3, -1).otherwise(F.col("label")).alias("label"), F.when(i % 7 == 0, F.transform(e, lambda x: F.lit(0.0))).otherwise(e).alias("v"))
    return R.diversity_per_key(rows, "label", "v").withColumn("diversity", F.round("diversity", 6))


@query("r8_combined_rewards", _T + "select pair_id, round(0.85 * (case when said is null then -1 else win end) + 0.15 * fmt, 9) as combined, round(0.10 * ok::integer + 0.60 * win + ok::integer * (0.15 * 0.5 + 0.15 * disc), 9) as quality, round(0.55 * (case when win > 0 then win * fmt else win end) + 0.20 * im * fmt + 0.25 * fmt + dom, 9) as margin from ts")
def _(spark, sf):
    t, raw, gold = F.col("t"), F.col("raw"), F.col("winner")
    return parsed(spark, sf).select("pair_id", F.round(R.combined_reward(t, raw, gold), 9).alias("combined"), F.round(R.quality_reward(t, gold, F.lit(0.5)), 9).alias("quality"), F.round(R.margin_reward(t, raw, gold), 9).alias("margin"))


_PAIR = ", pr as (select pair_id, (ca % 101 - cb % 103) / 100.0::double as d, case winner when 'A' then -preference_strength when 'B' then preference_strength else 0 end as p, 0.7::double + (pair_id % 4) / 10.0::double as cov from pairs)\n"


def deltas(spark, sf):
    w, s = F.col("winner"), F.col("preference_strength")
    return X.slim_pairs(spark, sf).select("pair_id", ((F.col("ca") % 101 - F.col("cb") % 103) / 100).alias("d"), F.when(w == "A", -s).when(w == "B", s).otherwise(0).alias("p"), (0.7 + (F.col("pair_id") % 4) / 10).alias("cov"))


@query(
    "r9_pair_reward",
    _PAIR + ", e as (select *, case when p = 0 or abs(d) - 0.05::double <= 0 then 0 when d * p > 0 then abs(d) - 0.05::double else 0.05::double - abs(d) end as e from pr) "
    "select pair_id, round(case when p = 0 then greatest(0, 1 - abs(d) / 0.05::double) else greatest(-1, least(1, e / 0.3::double)) end + case when p = 0 then 0 else greatest(-0.2::double, least(0.2::double, 0.1::double * e)) end - 0.2::double * (cov < 0.8::double)::integer, 9) as reward from e",
)
def _(spark, sf):
    return deltas(spark, sf).select("pair_id", F.round(R.pair_reward(F.col("d"), F.col("p"), F.col("cov")), 9).alias("reward"))


@query(
    "r10_legacy_reward",
    _PAIR + "select pair_id, round(case when p = 0 then 0.8::double * exp(-(d * d) / 0.05::double) + 0.2::double * cov else greatest(0, least(1, 0.333::double * greatest(0, sign(p) * d) + 0.5::double * exp(-pow(d - p / 3.0::double, 2) / 0.15::double) * (case when d * p < 0 then 0.5::double else 1 end) "
    "+ 0.167::double * cov - 0.2::double * abs(p / 3.0::double) * (1 - abs(d)) * exp(-(d * d) / 0.0144::double))) end, 9) as reward from pr",
)
def _(spark, sf):
    return deltas(spark, sf).select("pair_id", F.round(R.legacy_reward(F.col("d"), F.col("p"), F.col("cov")), 9).alias("reward"))


_VOTES = """
, vo as (select pair_id, winner, case when winner = 'A' then 'B' when winner = 'B' then 'A' else 'Tie' end as back, case when pair_id % 4 = 0 then 'A' else winner end as third from pairs),
vv as (select pair_id, [winner, third, case when pair_id % 3 = 0 then null else winner end] as o, [winner, case when pair_id % 5 = 0 then 'B' else winner end] as s from vo),
vc as (select *, len(list_filter(o, lambda x: x = 'A')) as oa, len(list_filter(o, lambda x: x = 'B')) as ob, len(list_filter(s, lambda x: x = 'A')) as sa, len(list_filter(s, lambda x: x = 'B')) as sb, list_filter(o, lambda x: x in ('A', 'B')) as ov, list_filter(s, lambda x: x in ('A', 'B')) as sv from vv),
vm as (select *, coalesce(greatest(oa + sa, ob + sb) / nullif(oa + ob + sa + sb, 0), 0) as conf, case when oa > ob then 'A' when ob > oa then 'B' else ov[1] end as mo, case when sa > sb then 'A' when sb > sa then 'B' else sv[1] end as ms from vc),
vp as (select *, coalesce(case when mo = ms then 0.5::double * (greatest(oa, ob) / nullif(oa + ob, 0) + greatest(sa, sb) / nullif(sa + sb, 0)) end, 0) as swap from vm)
"""


def votes(spark, sf):
    """Three votes in one order, two in the other, seen swapped."""
    w, p = F.col("winner"), F.col("pair_id")
    flip = lambda c: F.when(c == "A", "B").when(c == "B", "A").otherwise(c)
    original = F.array(w, F.when(p % 4 == 0, "A").otherwise(w), F.when(p % 3 != 0, w))
    back = F.array(flip(w), F.when(p % 5 == 0, "A").otherwise(flip(w)))
    return X.slim_pairs(spark, sf).select("pair_id", "winner", R.pseudo_winner(original, back).alias("v"))


@query("r11_pseudo_winner", _VOTES + "select pair_id, case when oa + ob + sa + sb > 0 and conf >= 0.6 and swap >= 0.5 then case when oa + sa >= ob + sb then 'A' else 'B' end end as pseudo_winner, conf as confidence, swap as swap_consistency from vp")
def _(spark, sf):
    return votes(spark, sf).select("pair_id", "v.*")


@query(
    "r12_trace_score",
    _T + _VOTES + ", ps as (select pair_id, case when oa + ob + sa + sb > 0 and conf >= 0.6 and swap >= 0.5 then case when oa + sa >= ob + sb then 'A' else 'B' end end as pw, conf, swap from vp), "
    "x as (select *, (ok and said in ('A', 'B'))::integer as k from ts join ps using (pair_id)) select pair_id, round(0.10 * k + 0.45 * coalesce(said = pw, false)::integer + 0.15 * k * coalesce(case pw when 'A' then (a - b) / nullif(n, 0) when 'B' then (b - a) / nullif(n, 0) end, 0) + 0.10 * k * 0.5 + 0.10 * disc * k + 0.05 * (nq >= 6)::integer + 0.10 * swap + 0.05 * conf + dom, 9) as score from x",
)
def _(spark, sf):
    rows = parsed(spark, sf).join(votes(spark, sf).select("pair_id", "v"), "pair_id")
    return rows.select("pair_id", F.round(R.trace_score(F.col("t"), F.col("v"), F.lit(0.5)), 9).alias("score"))


#: rollouts: eight completions a group with rewards in sixteenths, two replicates of each, and perturbed variants of the first
_ROLL = """
, ro as (select pair_id // 4 as group_id, pair_id * 2 + k as completion_id, rep as replicate_id, (pair_id * 7 + k * 5 + (case when pair_id % 3 = 0 then rep else 0 end)) % 16 / 16.0::double as reward_total, (pair_id + k) % 3 = 0 as winner_correct, (pair_id % 8) / 8.0::double as abs_delta, 0.5::double + k / 4.0::double as coverage
  from pairs, (select unnest([0, 1]) as k), (select unnest([0, 1]) as rep)),
pri as (select * from ro where replicate_id = 0)
"""


def rollouts(spark, sf):
    p = F.col("pair_id")
    rows = X.slim_pairs(spark, sf).select("pair_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).select("pair_id", "k", F.explode(F.array(F.lit(0), F.lit(1))).alias("replicate_id"))
    reward = (p * 7 + F.col("k") * 5 + F.when(p % 3 == 0, F.col("replicate_id")).otherwise(0)) % 16 / 16
    return rows.select(F.expr("pair_id div 4").alias("group_id"), (p * 2 + F.col("k")).alias("completion_id"), "replicate_id", reward.alias("reward_total"), ((p + F.col("k")) % 3 == 0).alias("winner_correct"), (p % 8 / 8).alias("abs_delta"), (0.5 + F.col("k") / 4).alias("coverage"), F.lit("original").alias("variant_type"))


@query("f13_primary_rollouts", _ROLL + "select group_id, completion_id, reward_total from pri")
def _(spark, sf):
    return O.primary(rollouts(spark, sf)).select("group_id", "completion_id", "reward_total")


@query("a19_group_metrics", _ROLL + "select group_id, count(*) as n, avg(reward_total) as mean, round(stddev_pop(reward_total), 9) as std, max(reward_total) - min(reward_total) as range, max(reward_total) = min(reward_total) as zero_variance, bool_or(winner_correct) as any_correct, arg_max(winner_correct, [reward_total, -completion_id]) as best_correct from pri group by group_id")
def _(spark, sf):
    return O.group_metrics(O.primary(rollouts(spark, sf))).withColumn("std", F.round("std", 9))


@query("a20_stability", _ROLL + "select completion_id, count(*) as n, max(reward_total) - min(reward_total) as span, max(reward_total) = min(reward_total) as exact from ro group by completion_id")
def _(spark, sf):
    return O.stability(rollouts(spark, sf))


@query("a25_ranking_accuracy", _ROLL + ", g as (select x.reward_total as r1, y.reward_total as r2, [x.winner_correct::integer, x.abs_delta, x.coverage] as g1, [y.winner_correct::integer, y.abs_delta, y.coverage] as g2 from pri x join pri y on x.group_id = y.group_id and x.completion_id < y.completion_id) select count(*) as n_pairs, avg((g1 > g2 and r1 > r2 or g1 < g2 and r1 < r2)::double) as accuracy from g where g1 <> g2")
def _(spark, sf):
    """J15 and A25."""
    return O.ranking_accuracy(O.primary(rollouts(spark, sf)))


@query("a26_perturbation_deltas", _ROLL + ", v as (select completion_id, unnest(['format', 'length', 'damage']) as variant_type, unnest([0.0::double, 0.125::double, -0.25::double]) as d from pri) select variant_type, count(*) as n, avg(d) as mean_delta, variant_type = 'length' and avg(d) > 0.05 as warning from v group by variant_type")
def _(spark, sf):
    """J5 and A26."""
    base = O.primary(rollouts(spark, sf)).withColumn("source_completion_id", F.col("completion_id"))
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(d).alias("d")) for k, d in (("original", 0.0), ("format", 0.0), ("length", 0.125), ("damage", -0.25))))).alias("x")
    return O.perturbation_deltas(base.select("*", kinds).withColumn("variant_type", F.col("x.k")).withColumn("reward_total", F.col("reward_total") + F.col("x.d")).drop("x"))


@query("w12_best_per_group", _ROLL + "select group_id, completion_id, reward_total from (select *, row_number() over (partition by group_id order by reward_total desc, abs_delta desc, coverage desc, completion_id) as r from pri where winner_correct) where r = 1")
def _(spark, sf):
    return O.best_per_group(O.primary(rollouts(spark, sf)), "winner_correct").select("group_id", "completion_id", "reward_total")


@query("r13_kept_for_training", _ROLL + ", s as (select group_id, max(group_id % 5 <> 0) as p, max(reward_total) filter (where winner_correct and group_id % 5 <> 0) as best, arg_max(completion_id, [reward_total, -completion_id]) filter (where winner_correct and group_id % 5 <> 0) as id from pri group by group_id), t as (select *, case when not p then 'no_pseudo' when best is null then 'none_parsed' when best < 0.5 then 'low_reward' else 'kept' end as status from s) select group_id, status, case when status = 'kept' then id end as best_id from t")
def _(spark, sf):
    rows = O.primary(rollouts(spark, sf)).withColumn("pseudo_winner", F.when(F.col("group_id") % 5 != 0, "A")).withColumn("pred_winner", F.lit("A")).withColumn("parse_ok", F.col("winner_correct"))
    return O.kept_for_training(rows, 0.5)


#: what stands at the end of completions, in SQL; solutions end in a number, or in a box that holds none
_SAID = (
    r"'\boxed{' || (doc_id + 1) || '} then \boxed{' || doc_id || '}'", r"'#### 3' || chr(10) || '#### ' || doc_id || '.0'", "'#### ' || (doc_id + 1)", "'none'", r"'\boxed{5} then \boxed{x}'",
    r"'#### ' || doc_id || chr(10) || '\boxed{\$' || doc_id || '}'", r"'\boxed{ ' || (doc_id // 10) || ' ' || (doc_id % 10) || ' }'", r"'\boxed{} #### ' || doc_id || ', .'", r"'\boxed{,}'",
    r"'\boxed{' || doc_id || 'e0}'", "'#### -' || doc_id", r"'\boxed{x' || doc_id || '}'", "'#### ' || doc_id || '.000001'", "'so #### then'",
)
_SAID_CASE = f"case doc_id % {len(_SAID)} " + " ".join(f"when {i} then {x}" for i, x in enumerate(_SAID)) + " end"
_ANSWERS = f", c as (select doc_id, text || ' ' || {_SAID_CASE} as said, case when doc_id % {len(_SAID)} in (4, 11) then 'It is \\boxed{{x' || doc_id || '}}' else text || ' #### ' || doc_id end as gold from documents)"
_STATED = r"translate(coalesce(regexp_extract_all(right({0}, 500), '\\boxed\{{([^}}]+)\}}', 1)[-1], regexp_extract_all(right({0}, 500), '####\s*([-0-9,.\s]+)', 1)[-1], ''), ', ' || chr(10) || chr(9) || chr(13), '')"


def answers(spark, sf):
    i, text = F.col("doc_id"), F.col("text")
    said = F.expr(_SAID_CASE.replace("//", "div").replace("\\", "\\\\"))
    gold = F.when((i % len(_SAID)).isin(4, 11), F.concat(F.lit("It is \\boxed{x"), i, F.lit("}"))).otherwise(F.concat(text, F.lit(" #### "), i))
    return X.table(spark, sf, "documents").select("doc_id", F.concat(text, F.lit(" "), said).alias("said"), gold.alias("gold"))


@query(
    "r14_numeric_answer",
    _ANSWERS + f", s as (select *, {_STATED.format('said')} as a, {_STATED.format('gold')} as b from c), n as (select *, try_cast(a as double) as x, try_cast(b as double) as y from s) "
    + r"select doc_id, coalesce(a <> '' and b <> '' and case when x is null or y is null then a = b else abs(x - y) < 1e-5 end, false)::integer::double as reward, (regexp_matches(said, '\\boxed\{[^}]+\}') or regexp_matches(said, '####\s*[-0-9,.]+'))::integer::double as format from n",
)
def _(spark, sf):
    return answers(spark, sf).select("doc_id", R.numeric_answer(F.col("said"), F.col("gold")).alias("reward"), R.answer_format(F.col("said")).alias("format"))


@query("p38_rollout_variants", _TRACES + "select pair_id, length(raw) + 8 as n_format, length(raw) * 2 + 1 as n_length, length(raw) // 2 as n_damage from traces")
def _(spark, sf):
    """Format, length and content variants of a trace."""
    raw = F.col("raw")
    framed, longer, damaged = F.concat(F.lit("```\n"), raw, F.lit("\n```")), F.concat(raw, F.lit("\n"), raw), F.substring(raw, F.lit(1), F.floor(F.length(raw) / 2).cast("int"))
    return traces(spark, sf).select("pair_id", F.length(framed).cast("long").alias("n_format"), F.length(longer).cast("long").alias("n_length"), F.length(damaged).cast("long").alias("n_damage"))
