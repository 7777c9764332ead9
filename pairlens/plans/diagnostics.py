"""Queries of question statistics, drop rules and failure modes."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlens.operators import diagnostics as D
from pairlens.operators import scoring as S
from pairlens.operators import selection as W
from pairlens.operators.windows import small_broadcast
from pairlens.sources import fixtures as X

from . import scoring as Q
from .registry import query, rounded

_LONG = """
, sides as (select domain, winner, dimension, qid, pair_id, ans_a as answer from gaps union all select domain, winner, dimension, qid, pair_id, ans_b from gaps),
qd as (select domain, dimension, qid, count(*) filter (where answer = 'yes') as n_yes, count(*) filter (where answer = 'no') as n_no, count(*) filter (where answer = 'na') as n_na, count(*) as n_total from sides group by all)
"""


def question_rows(spark, sf):
    facts = X.with_gaps(X.answers(spark, sf))
    long = facts.select("domain", "dimension", "qid", F.explode(F.array("ans_a", "ans_b")).alias("answer"))
    return D.question_diagnostics(long, ["domain", "dimension", "qid"])


@query("a2_question_diagnostics", _LONG + "select *, n_yes / n_total as yes_rate, n_no / n_total as no_rate, n_na / n_total as na_rate from qd")
def _(spark, sf):
    return question_rows(spark, sf)


@query(
    "a3_dimension_accuracy",
    ", p as (select pair_id, winner, dimension, count(*) filter (where ans_a = 'yes') as ya, count(*) filter (where ans_b = 'yes') as yb, count(*) filter (where ans_a <> 'na') as na, count(*) filter (where ans_b <> 'na') as nb, count(*) filter (where ans_a = 'na') + count(*) filter (where ans_b = 'na') as nn from gaps group by all), "
    "s as (select *, ya / na as sa, yb / nb as sb from p where na > 0 and nb > 0) select dimension, count(*) as n_samples, round(avg(sa), 9) as avg_score_a, round(avg(sb), 9) as avg_score_b, avg((winner in ('A', 'B') and winner = case when sa > sb then 'A' when sb > sa then 'B' else 'Tie' end)::double) as dimension_accuracy, sum(nn) / sum(na + nb + nn) as avg_na_rate from s group by dimension",
)
def _(spark, sf):
    return rounded(D.dimension_accuracy(X.with_gaps(X.answers(spark, sf)), ["pair_id"]), "avg_score_a", "avg_score_b")


_COLLAPSED = _LONG + """
, cd as (select q.dimension, b.question_text, sum(n_yes)::bigint as n_yes, sum(n_no)::bigint as n_no, sum(n_na)::bigint as n_na, string_agg(distinct domain, ',' order by domain) as domains_seen from qd q join bank b using (qid) group by q.dimension, b.question_text),
ce as (select *, n_yes + n_no as n_effective_nonna, n_yes / nullif(n_yes + n_no, 0) as yes_rate_nonna, n_na / nullif(n_yes + n_no + n_na, 0) as na_rate from cd),
lc as (select c.dimension, b.question_text, avg(((ans_a = 'yes') = (winner = 'A'))::double) as agree_rate, count(*) as n_effective_corr from gaps c join bank b using (qid) where winner in ('A', 'B') and ans_a <> 'na' and ans_b <> 'na' and ans_a <> ans_b group by all),
dr as (select ce.*, agree_rate, n_effective_corr, list_filter([case when n_effective_nonna >= 300 and yes_rate_nonna > 0.6 then 'saturated_yes' end, case when n_effective_nonna >= 300 and yes_rate_nonna < 0.52 then 'saturated_no' end, case when n_effective_nonna < 300 then 'tiny_effective_n' end,
  case when coalesce(n_effective_corr, 0) >= 20 and abs(agree_rate - 0.5) < 0.1 then 'low_signal' end, case when na_rate > 0.15 then 'rarely_applicable' end], lambda x: x is not null) as reasons from ce left join lc using (dimension, question_text)),
dd as (select *, list_has_any(reasons, ['saturated_yes', 'saturated_no', 'low_signal']) as gone from dr)
"""


def collapsed_rows(spark, sf):
    texts = X.bank(spark, sf).select("qid", "question_text")
    return D.collapsed(question_rows(spark, sf).join(small_broadcast(texts), "qid"))


@query("a4_collapsed_diagnostics", _COLLAPSED + "select * from ce")
def _(spark, sf):
    return collapsed_rows(spark, sf)


def correlation_rows(spark, sf):
    texts = X.bank(spark, sf).select("qid", "question_text")
    return D.label_correlation(X.with_gaps(X.answers(spark, sf)).join(small_broadcast(texts), "qid"), ["dimension", "question_text"])


@query("a5_label_correlation", _COLLAPSED + "select * from lc")
def _(spark, sf):
    return correlation_rows(spark, sf)


def dropped_rows(spark, sf):
    """J11 and C23: statistics joined with correlations, then the rules."""
    rows = collapsed_rows(spark, sf).join(correlation_rows(spark, sf), ["dimension", "question_text"], "left")
    return D.drop_rules(rows, yes_high=0.6, yes_low=0.52, signal=0.1, signal_n=20, rare_na=0.15, sat_n=300)


@query("c23_drop_rules", _COLLAPSED + "select dimension, question_text, reasons as drop_reasons, gone as \"drop\" from dd")
def _(spark, sf):
    return dropped_rows(spark, sf).select("dimension", "question_text", "drop_reasons", "drop")


@query("a34_bank_summary", _COLLAPSED + "select dimension, count(*) as n_before, count(*) filter (where not gone) as n_after, round(avg(na_rate), 9) as na_before, round(avg(na_rate) filter (where not gone), 9) as na_after from dd group by dimension")
def _(spark, sf):
    return rounded(D.bank_summary(dropped_rows(spark, sf)), "na_before", "na_after")


@query("io9_bank_writer", _COLLAPSED + "select b.dimension, b.sub_aspect, coalesce(list(b.question_text order by qid) filter (where not coalesce(gone, false)), []) as questions, count(*) as original_count, count(*) filter (where gone) as removed_count from bank b left join dd using (dimension, question_text) group by all")
def _(spark, sf):
    from pairlens.sources.bank import without_dropped

    return without_dropped(X.bank(spark, sf), dropped_rows(spark, sf).filter("drop"))


#: samples: the first twelve questions of a ranking with their weights; a third of the bank is generic; scores of three annotators
_SAMPLES = """
, r0 as (select *, row_number() over (partition by pair_id order by (qid * 7) % 11, qid) as rank from contrib),
sf as (select r.pair_id, r.domain, r.winner, r.qid, r.dimension, r.sub_aspect, r.ans_a, r.ans_b, w, r.qid % 3 = 0 as generic, ans_a in ('yes', 'no') and ans_b in ('yes', 'no') and ans_a <> ans_b as differ, c * w as cw from r0 r left join weights using (pair_id, qid) where rank <= 12),
st as (select pair_id, domain, winner, count(*) as n_selected, count(*) filter (where ans_a = 'yes' and ans_b = 'yes') as n_yes_yes, count(*) filter (where ans_a = 'no' and ans_b = 'no') as n_no_no, count(*) filter (where ans_a = 'na' or ans_b = 'na') as n_any_na, count(*) filter (where differ) as n_diff,
  count(*) filter (where differ and w is not null) as n_nonzero, count(*) filter (where differ and w is not null) / count(*) as nonzero_rate, coalesce(sum(cw) filter (where differ and cw > 0), 0) as support_a, coalesce(sum(-cw) filter (where differ and cw < 0), 0) as support_b,
  count(*) filter (where generic) as n_generic, count(*) filter (where generic and ans_a = 'yes' and ans_b = 'yes') as n_yes_yes_generic, coalesce(max(w) filter (where differ), 0) as max_nonzero_weight,
  arg_max(qid, [abs(cw), -qid]) filter (where differ and w is not null) as max_qid, arg_max(cw, [abs(cw), -qid]) filter (where differ and w is not null) as max_contribution from sf group by pair_id, domain, winner)
"""


def sample_facts(spark, sf):
    """The twelve first-ranked questions of every pair with their weights and the pair's margin over all: one derivation of the answers, two windows over their own partitioning."""
    facts = S.with_margin(X.answers(spark, sf), ["pair_id"])
    top = W.ranked(facts, ["pair_id"], [(F.col("qid") * 7) % 11, F.col("qid")]).filter("rank <= 12").drop("rank")
    return top.withColumn("w", X.weight()).withColumn("generic", F.col("qid") % 3 == 0)


@query("c25_sample_statistics", _SAMPLES + "select * from st")
def _(spark, sf):
    return D.sample_statistics(sample_facts(spark, sf), ["pair_id", "domain", "winner"])


_TAGS = _SAMPLES + """
, sd as (select pair_id, list_distinct(list(dimension)) as dims, list_distinct(list(qid)) as qids from sf group by pair_id),
tx as (select st.*, margin, predicted_winner, dims, case st.pair_id % 5 when 0 then 'creative' when 1 then 'coding' else 'other' end as task, [st.pair_id % 3 - 1, st.pair_id % 2, 1] as scores, st.pair_id % 10 = 7 as weak from st join preds using (pair_id) join sd using (pair_id)),
ty as (select *, case when predicted_winner = 'Tie' then 'tie' when predicted_winner = winner then 'correct' else 'wrong_winner' end as cat, list_filter(scores, lambda s: s <> 0) as nz from tx),
tg as (select pair_id, domain, task, nonzero_rate, list_filter([
  case when n_generic / n_selected >= 0.5 and nonzero_rate < 0.2 or n_generic / n_selected >= 0.6 and n_yes_yes_generic >= 4 then 'FM1_generic_non_discriminative' end,
  case when task = 'creative' and not list_contains(dims, 'clarity_and_communication') or task = 'coding' and not list_contains(dims, 'coding_communication_conditional') then 'FM2_missing_task_specific_criteria' end,
  case when n_any_na >= 5 then 'FM3_na_noise_or_bad_question_fit' end, case when n_diff > 0 and n_nonzero > 0 and max_nonzero_weight < 0.3 then 'FM4_low_weight_on_discriminative_questions' end,
  case when cat = 'wrong_winner' and winner <> 'Tie' and (case when max_contribution > 0 then 'A' when max_contribution < 0 then 'B' end) <> winner then 'FM5_wrong_direction_high_weight' end,
  case when weak then 'FM6_human_reason_mismatch_or_annotation_noise' end, case when (n_yes_yes + n_no_no) / n_selected >= 0.7 and n_diff between 1 and 3 then 'FM7_binary_checklist_insufficient' end,
  case when n_diff <= 2 and nonzero_rate < 0.2 then 'FM8_selector_relevance_vs_contrastiveness_gap' end, case when abs(margin) < 0.05 and cat in ('tie', 'wrong_winner') then 'FM9_aggregation_threshold_or_tie_delta_issue' end,
  case when len(nz) >= 2 and len(list_distinct(list_transform(nz, lambda s: sign(s)))) > 1 then 'FM10_annotator_disagreement' end, case when len(nz) >= 3 and len(list_distinct(list_transform(nz, lambda s: sign(s)))) = 1 then 'FM10_weak_preference_strength' end], lambda x: x is not null) as tags from ty)
"""


def tagged(spark, sf):
    stats = D.sample_statistics(sample_facts(spark, sf), ["pair_id", "domain", "winner"], F.collect_set("dimension").alias("dimensions"), F.max("margin").alias("margin"))
    p = F.col("pair_id")
    rows = stats.withColumn("predicted_winner", S.winner_from_margin(F.col("margin"))).withColumn("task", F.when(p % 5 == 0, "creative").when(p % 5 == 1, "coding").otherwise("other"))
    rows = rows.withColumn("scores", F.array(p % 3 - 1, p % 2, F.lit(1).cast("long"))).withColumn("weak_reason", p % 10 == 7)
    # a generator between keeps the optimiser from copying the conditions into every use of the tags
    return rows.withColumn("tags", F.explode(F.array(D.failure_modes()))).select("pair_id", "domain", "task", "nonzero_rate", "tags")


@query("c24_failure_modes", _TAGS + "select pair_id, tags from tg")
def _(spark, sf):
    return tagged(spark, sf).select("pair_id", "tags")


@query("a15_mode_counts", _TAGS + "select tag, domain, task, count(*) as n from (select domain, task, unnest(tags) as tag from tg) group by all")
def _(spark, sf):
    return tagged(spark, sf).select("domain", "task", F.explode("tags").alias("tag")).groupBy("tag", "domain", "task").agg(F.count(F.lit(1)).alias("n"))


@query("a15_mode_cooccurrence", _TAGS + ", e as (select pair_id, unnest(tags) as tag from tg) select x.tag as a, y.tag as b, count(*) as n from e x join e y on x.pair_id = y.pair_id and x.tag < y.tag group by all")
def _(spark, sf):
    return D.mode_cooccurrence(tagged(spark, sf), "pair_id")


@query("a16_task_statistics", _TAGS + ", e as (select task, tag, count(*) as n from (select task, unnest(tags) as tag from tg) group by all), k as (select *, row_number() over (partition by task order by n desc, tag) as r from e) select task, string_agg(tag || ' (' || n || ')', ', ' order by r) as top_modes from k where r <= 3 group by task")
def _(spark, sf):
    from pairlens.operators.selection import ranked

    counts = tagged(spark, sf).select("task", F.explode("tags").alias("tag")).groupBy("task", "tag").agg(F.count(F.lit(1)).alias("n"))
    top = ranked(counts, ["task"], [F.desc("n"), F.col("tag")], "r").filter("r <= 3")
    return top.groupBy("task").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", F.concat("tag", F.lit(" ("), "n", F.lit(")")).alias("t")))), lambda x: x["t"]), ", ").alias("top_modes"))


@query("w18_representative_cases", _TAGS + ", e as (select pair_id, nonzero_rate, unnest(tags) as tag from tg), k as (select *, cast(row_number() over (partition by tag order by nonzero_rate, pair_id) as integer) as place from e) select pair_id, nonzero_rate, tag, place from k where place <= 5")
def _(spark, sf):
    return D.lowest_per_mode(tagged(spark, sf), "pair_id", "nonzero_rate")


@query("a12_question_frequencies", _SAMPLES + ", g as (select qid, count(*) as n_selected, count(*) filter (where differ) as n_diff, count(*) filter (where differ and w is not null) as n_nonzero, count(*) filter (where differ and ans_a = 'yes') as n_support_a, count(*) filter (where differ and ans_b = 'yes') as n_support_b, count(*) filter (where ans_a = 'na' or ans_b = 'na') as n_na, avg(w) as avg_weight, quantile_cont(w, 0.5) as median_weight, sum(w) as total_weight from sf group by qid) "
    "select b.qid, b.dimension, b.sub_aspect, coalesce(n_selected, 0) as n_selected, coalesce(n_diff, 0) as n_diff, coalesce(n_nonzero, 0) as n_nonzero, coalesce(n_support_a, 0) as n_support_a, coalesce(n_support_b, 0) as n_support_b, coalesce(n_na, 0) as n_na, avg_weight, median_weight, coalesce(total_weight, 0) as total_weight from bank b left join g using (qid)")
def _(spark, sf):
    return D.question_frequencies(sample_facts(spark, sf), X.bank(spark, sf))


@query("a13_dimension_failures", _SAMPLES + ", f as (select s.dimension, count(*) as n, count(*) filter (where differ) as n_diff from sf s join preds p using (pair_id) where p.predicted_winner <> p.winner group by all) select dimension, n, n_diff, n / sum(n) over () as share from f")
def _(spark, sf):
    a, b = F.col("ans_a"), F.col("ans_b")
    rows = sample_facts(spark, sf).filter(S.winner_from_margin(F.col("margin")) != F.col("winner")).groupBy("dimension").agg(F.count(F.lit(1)).alias("n"), F.count_if(a.isin("yes", "no") & b.isin("yes", "no") & (a != b)).alias("n_diff"))
    return D.with_share(rows, "n", "share")


@query("a14_generic_overuse", _SAMPLES + "select s.qid, count(*) as n_present, count(*) filter (where ans_a = 'yes' and ans_b = 'yes') as n_yes_yes from sf s join preds p using (pair_id) where generic and p.predicted_winner <> p.winner group by all")
def _(spark, sf):
    return sample_facts(spark, sf).filter("generic").filter(S.winner_from_margin(F.col("margin")) != F.col("winner")).groupBy("qid").agg(F.count(F.lit(1)).alias("n_present"), F.count_if((F.col("ans_a") == "yes") & (F.col("ans_b") == "yes")).alias("n_yes_yes"))


@query("a17_question_support", "select qid, count(*) filter (where ans_a = 'yes' and ans_b = 'yes') as yes_yes, count(*) filter (where ans_a = 'yes' and ans_b = 'no') as yes_no, count(*) filter (where ans_a = 'no' and ans_b = 'yes') as no_yes, count(*) filter (where ans_a = 'no' and ans_b = 'no') as no_no, count(*) filter (where winner = 'A' and c > 0 or winner = 'B' and c < 0) as gold, count(*) filter (where winner = 'A' and c < 0 or winner = 'B' and c > 0) as wrong, count(*) filter (where winner = 'A' and c > 0 or winner = 'B' and c < 0) / nullif(count(*) filter (where winner = 'A' and c < 0 or winner = 'B' and c > 0), 0) as gold_wrong_ratio from contrib group by qid")
def _(spark, sf):
    """The ratio's denominator is left null where nothing supports the wrong side."""
    a, b, w = F.col("ans_a"), F.col("ans_b"), F.col("winner")
    c = S.contribution(a, b)
    gold, wrong = F.count_if(((w == "A") & (c > 0)) | ((w == "B") & (c < 0))), F.count_if(((w == "A") & (c < 0)) | ((w == "B") & (c > 0)))
    cell = lambda x, y: F.count_if((a == x) & (b == y)).alias(f"{x}_{y}")
    return X.answers(spark, sf).groupBy("qid").agg(cell("yes", "yes"), cell("yes", "no"), cell("no", "yes"), cell("no", "no"), gold.alias("gold"), wrong.alias("wrong"), F.try_divide(gold, wrong).alias("gold_wrong_ratio"))


_NEW = ", v5 as (select pair_id, winner, sum(c) filter (where qid % 4 <> 0) / count(*) filter (where qid % 4 <> 0) as m0, sum(c) / count(*) as m1 from contrib group by all), vp as (select *, case when m0 > 0.05 then 'A' when m0 < -0.05 then 'B' else 'Tie' end as p0, case when m1 > 0.05 then 'A' when m1 < -0.05 then 'B' else 'Tie' end as p1 from v5)\n"


@query("a18_rescue_flags", _NEW + "select pair_id, p0 <> 'Tie' and p0 <> winner and p1 = winner as rescued, p0 = 'Tie' and p1 = winner and winner <> 'Tie' as tie_broken, p0 = winner and p1 <> winner as regressed from vp")
def _(spark, sf):
    """What new questions, every fourth here, change in the verdict of a sample."""
    c = S.contribution(F.col("ans_a"), F.col("ans_b"))
    old = F.col("qid") % 4 != 0
    m = X.answers(spark, sf).groupBy("pair_id", "winner").agg((F.sum(F.when(old, c)) / F.count_if(old)).alias("m0"), (F.sum(c) / F.count(F.lit(1))).alias("m1"))
    p0, p1, w = S.winner_from_margin(F.col("m0")), S.winner_from_margin(F.col("m1")), F.col("winner")
    return m.select("pair_id", ((p0 != "Tie") & (p0 != w) & (p1 == w)).alias("rescued"), ((p0 == "Tie") & (p1 == w) & (w != "Tie")).alias("tie_broken"), ((p0 == w) & (p1 != w)).alias("regressed"))


@query("a27_label_agreement", "select qid, winner, avg((ans_a = case when winner in ('A', 'Tie') then 'yes' else 'no' end)::double) as agree_a, avg((ans_b = case when winner in ('B', 'Tie') then 'yes' else 'no' end)::double) as agree_b from answers group by all")
def _(spark, sf):
    label = lambda s: F.when(F.col("winner").isin(s, "Tie"), "yes").otherwise("no")
    return X.answers(spark, sf).groupBy("qid", "winner").agg(F.avg((F.col("ans_a") == label("A")).cast("double")).alias("agree_a"), F.avg((F.col("ans_b") == label("B")).cast("double")).alias("agree_b"))


@query("a30_training_balance", "select count(*) as n, count(*) filter (where winner = 'A') / count(*) filter (where winner <> 'Tie') as first_ratio, count(distinct domain) as n_domains, avg(ca - cb) filter (where winner = 'A') as a_longer, quantile_cont(case when winner = 'A' then ca else cb end, 0.5) as chosen_median, quantile_cont(case when winner = 'A' then cb else ca end, 0.5) as rejected_median, round(stddev_samp(ca), 6) as ca_std from pairs")
def _(spark, sf):
    w, a, b = F.col("winner"), F.col("ca"), F.col("cb")
    chosen, rejected = F.when(w == "A", a).otherwise(b), F.when(w == "A", b).otherwise(a)
    return X.slim_pairs(spark, sf).agg(
        F.count(F.lit(1)).alias("n"), (F.count_if(w == "A") / F.count_if(w != "Tie")).alias("first_ratio"), F.count_distinct("domain").alias("n_domains"), F.avg(F.when(w == "A", a - b)).alias("a_longer"),
        F.percentile(chosen, F.lit(0.5)).alias("chosen_median"), F.percentile(rejected, F.lit(0.5)).alias("rejected_median"), F.round(F.stddev_samp("ca"), 6).alias("ca_std"),
    )


@query("a31_duplicates", "select sha256(text) as h, count(*) as n, count(distinct lang) > 1 as lang_differs, count(distinct source) > 1 as source_differs from documents group by text having count(*) > 1")
def _(spark, sf):
    from pairlens.operators.joins import duplicates

    return duplicates(X.table(spark, sf, "documents").withColumn("h", F.sha2("text", 256)), ["h"], ["lang", "source"])


@query("a32_first_questions", ", f as (select lang, text, row_number() over (partition by lang, sha256(lower(text)) order by doc_id) as r from documents) select lang, sum(cast('0x' || substr(sha256(text), 1, 8) as bigint))::bigint as h, count(*) as n from f where r = 1 and text is not null group by lang")
def _(spark, sf):
    """The first of texts that are equal but for their case, whole texts compared by hash; their number and the sum of their digests."""
    from pairlens.operators.joins import keep_first

    digest = lambda c: F.sha2(c, 256)
    d = X.table(spark, sf, "documents").filter("text is not null").select("lang", "doc_id", digest(F.lower("text")).alias("k"), digest(F.col("text")).alias("d"))
    value = F.conv(F.substring("d", 1, 8), 16, 10).cast("long")
    return keep_first(d, ["lang", "k"], ["doc_id"]).groupBy("lang").agg(F.sum(value).alias("h"), F.count(F.lit(1)).alias("n"))


@query("a33_annotator_statistics", "select pair_id, [pair_id % 7 - 3, pair_id % 3 - 1, 1] as scores, 3 as n, (pair_id % 7 - 3 + pair_id % 3 - 1 + 1) / 3 as mean, len(list_distinct([sign(pair_id % 7 - 3), sign(pair_id % 3 - 1), 1])) = 1 as unanimous from pairs")
def _(spark, sf):
    p = F.col("pair_id")
    rows = X.slim_pairs(spark, sf).select("pair_id", F.array(p % 7 - 3, p % 3 - 1, F.lit(1).cast("long")).alias("scores"))
    total = F.aggregate("scores", F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select("pair_id", "scores", F.size("scores").alias("n"), (total / F.size("scores")).alias("mean"), (F.size(F.array_distinct(F.transform("scores", lambda x: F.signum(x.cast("double"))))) == 1).alias("unanimous"))


_TARGETS = r"""
, six as (select a.pair_id, n.q::integer as q, ans_a as x from answers a join numbered n on n.domain = a.domain and n.qid = a.qid where n.q <= 6),
tl as (select pair_id, q, case pair_id % 8 when 0 then 'Q' || q || ': ' || x when 1 then ' q' || q || ':' || case x when 'na' then 'NO' else upper(x) end || ' ' when 5 then 'Q0' || q || ': yes' when 6 then case when q = 3 then 'Q3: yes, no' else 'Q' || q || ': yes' end
  else 'Q' || q || ': ' || case x when 'na' then 'no' else x end end as line from six),
ta as (select pair_id, case pair_id % 8 when 2 then string_agg(line, chr(10) order by q) filter (where q > 1) when 3 then string_agg(line, chr(10) order by -q) when 4 then chr(10) || string_agg(line, chr(10) || ' ' || chr(10) order by q) || chr(10) when 7 then '  ' else string_agg(line, chr(10) order by q) end as t from tl group by pair_id),
tb as (select pair_id, t, list_filter(string_split(t, chr(10)), lambda l: trim(l) <> '') as ls from ta),
tc as (select pair_id, generate_subscripts(ls, 1) as i, unnest(ls) as l from tb where len(ls) > 0),
te as (select pair_id, i, case when not regexp_full_match(l, '\s*[Qq]\d+:\s*([Yy][Ee][Ss]|[Nn][Oo])\s*') then 'bad_line:' || chr(39) || substr(l, 1, 60) || chr(39) when regexp_extract(l, '[Qq](\d+):', 1)::integer <> i then 'out_of_order(expected Q' || i || ' got Q' || regexp_extract(l, '[Qq](\d+):', 1)::integer || ')' end as wrong from tc),
td as (select pair_id, arg_min(wrong, i) as wrong from te where wrong is not null group by pair_id)
"""


def sft_targets(spark, sf):
    """Targets of the first six questions: as answered, in odd forms, without a line, backwards, with blank lines, with wrong lines, blank."""
    from pairlens.operators.selection import local_numbers

    numbers = local_numbers(X.active_bank(spark, sf)).select("domain", "qid", "q").filter("q <= 6")
    rows = X.answers(spark, sf).join(small_broadcast(numbers), ["domain", "qid"])
    p, q, x = F.col("pair_id") % 8, F.col("q").cast("string"), F.col("ans_a")
    plain = F.when(x == "na", "no").otherwise(x)
    line = F.when(p == 0, F.concat(F.lit("Q"), q, F.lit(": "), x)).when(p == 1, F.concat(F.lit(" q"), q, F.lit(":"), F.upper(plain), F.lit(" "))).when(p == 5, F.concat(F.lit("Q0"), q, F.lit(": yes")))
    line = line.when(p == 6, F.when(F.col("q") == 3, "Q3: yes, no").otherwise(F.concat(F.lit("Q"), q, F.lit(": yes")))).otherwise(F.concat(F.lit("Q"), q, F.lit(": "), plain))
    listed = rows.groupBy("pair_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("q", line.alias("l")))), lambda s: s["l"]).alias("ls"))
    joined = lambda ls, by="\n": F.array_join(ls, by)
    text = F.when(p == 2, joined(F.slice("ls", 2, 9))).when(p == 3, joined(F.reverse("ls"))).when(p == 4, F.concat(F.lit("\n"), joined(F.col("ls"), "\n \n"), F.lit("\n"))).when(p == 7, "  ").otherwise(joined(F.col("ls")))
    return listed.select("pair_id", text.alias("t"))


@query("f8_sft_validity", _TARGETS + "select b.pair_id, case when trim(b.t) = '' then 'empty_target' when len(b.ls) <> 6 then 'line_count_mismatch(' || len(b.ls) || '!=6)' else coalesce(w.wrong, 'ok') end as reason from tb b left join td w using (pair_id)")
def _(spark, sf):
    from pairlens.operators.exports import target_validity

    return sft_targets(spark, sf).select("pair_id", target_validity(F.col("t"), F.lit(6)).alias("reason"))
