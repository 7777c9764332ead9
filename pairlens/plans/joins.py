"""Queries of filters, joins, set operations and merges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pairlens.functions import parsers as P
from pairlens.functions import text as T
from pairlens.operators import exports as E
from pairlens.operators import joins as J
from pairlens.operators import scoring as S
from pairlens.operators.windows import small_broadcast
from pairlens.sources import fixtures as X

from . import scoring as Q
from .registry import query


@query("f1_keep_domains_and_strengths", "select pair_id, domain, preference_strength from pairs where domain in ('general', 'code') and preference_strength in (-3, -2, 2, 3)")
def _(spark, sf):
    return X.slim_pairs(spark, sf).filter(F.col("domain").isin("general", "code") & F.col("preference_strength").isin(-3, -2, 2, 3)).select("pair_id", "domain", "preference_strength")


@query("f2_drop_ties", "select pair_id, winner from pairs where winner in ('A', 'B')")
def _(spark, sf):
    return X.slim_pairs(spark, sf).filter(F.col("winner").isin("A", "B")).select("pair_id", "winner")


@query("f4_active_questions", "select domain, qid from active")
def _(spark, sf):
    return X.active_bank(spark, sf).select("domain", "qid")


@query("f4_active_with_fallback", "select 'other' as domain, qid from bank union all select domain, qid from active")
def _(spark, sf):
    from pairlens.operators.questions import active_questions

    domains = spark.createDataFrame([(d,) for d in (*X.DOMAINS, "other")], "domain string")
    return active_questions(domains, X.bank(spark, sf), X.domain_dimensions(spark))


@query("f5_qid_subset", "select pair_id, qid from answers where qid in (select qid from bank where sub_aspect in ('aspect_1', 'aspect_2'))")
def _(spark, sf):
    """F5 and J12."""
    some = X.bank(spark, sf).filter(F.col("sub_aspect").isin("aspect_1", "aspect_2")).select("qid")
    return X.answers(spark, sf).select("pair_id", "qid").join(small_broadcast(some), "qid", "left_semi").select("pair_id", "qid")


@query("f6_exclude_used", "select pair_id from pairs where pair_id not in (select doc_id from labels where toxic = 1)")
def _(spark, sf):
    """F6 and J13."""
    used = X.table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("pair_id"))
    return X.slim_pairs(spark, sf).select("pair_id").join(used, "pair_id", "left_anti")


@query("f7_verified_rewrites", "select pair_id from pairs where winner <> 'Tie' and pair_id % 4 = 0")
def _(spark, sf):
    raw = F.when(F.col("pair_id") % 4 == 0, "No.").when(F.col("pair_id") % 4 == 1, "yes").otherwise("unsure")
    return X.slim_pairs(spark, sf).filter(F.col("winner").isin("A", "B") & (P.verifier(raw) == "no")).select("pair_id")


@query("f11_disagreement_set", "select pair_id from judged where not coalesce(predicted_winner = winner, false)")
def _(spark, sf):
    agrees = F.col("predicted_winner") == F.col("winner")
    return Q.judged(spark, sf).filter(~F.coalesce(agrees, F.lit(False))).select("pair_id")


@query("f12_review_set", ", y as (select pair_id, winner, count(*) filter (where ans_a = 'yes') as ya, count(*) filter (where ans_b = 'yes') as yb, count(*) as n from gaps group by all) select pair_id from y where winner <> 'Tie' and (case winner when 'A' then ya else yb end) * 2 < n")
def _(spark, sf):
    """Pairs whose gold side has few yes answers; no answer at all, the usual rule, never occurs in these views."""
    counts = S.side_counts(X.with_gaps(X.answers(spark, sf)), ["pair_id", "winner"])
    gold = F.when(F.col("winner") == "A", F.col("n_yes_a")).otherwise(F.col("n_yes_b"))
    return counts.filter(F.col("winner").isin("A", "B") & (gold * 2 < F.col("expected_n"))).select("pair_id")


@query("f14_leaking_questions", "select qid from bank where not regexp_matches(question_text || case when qid % 5 = 0 then ' as response B' else '' end, '(?i)\\bresponse\\s*[ab12]\\b')")
def _(spark, sf):
    text = F.concat("question_text", F.when(F.col("qid") % 5 == 0, " as response B").otherwise(""))
    return X.bank(spark, sf).filter(~text.rlike(r"(?i)\bresponse\s*[ab12]\b")).select("qid")


@query("f15_leak_guard", "select a.pair_id from pairs a join (select doc_id as pair_id from labels where quality = 0) b using (pair_id)")
def _(spark, sf):
    held = X.table(spark, sf, "labels").filter("quality = 0").select(F.col("doc_id").alias("pair_id")).distinct()
    return X.slim_pairs(spark, sf).select("pair_id").join(held, "pair_id", "left_semi")


@query("f16_both_valid", "select j.pair_id from judged j join preds p using (pair_id) where j.predicted_winner in ('A', 'B') and p.predicted_winner in ('A', 'B')")
def _(spark, sf):
    left = Q.judged(spark, sf).select("pair_id", "predicted_winner")
    right = Q.predictions(spark, sf).select("pair_id", F.col("predicted_winner").alias("p"))
    return left.join(right, "pair_id").filter(F.col("predicted_winner").isin("A", "B") & F.col("p").isin("A", "B")).select("pair_id")


@query("f17_ablation", "select qid from bank where dimension <> 'helpfulness_and_usefulness' union all select -qid from (select *, row_number() over (partition by dimension, sub_aspect order by sha256('42:' || qid)) as r, count(*) over (partition by dimension, sub_aspect) as n from bank) where r <= greatest(1, floor(n * 0.5))")
def _(spark, sf):
    from pairlens.operators.sampling import ablated

    bank = X.bank(spark, sf).select("qid", "dimension", "sub_aspect")
    return ablated(bank, "helpfulness_and_usefulness").select("qid").union(ablated(bank, fraction=0.5).select((-F.col("qid")).alias("qid")))


@query("f18_drop_empty", "select doc_id from documents where trim(substr(text, 1, 3)) <> ''")
def _(spark, sf):
    return X.table(spark, sf, "documents").filter(T.strip(F.col("text")) != "").select("doc_id")


@query("j2_reasoning_lookup", "select p.pair_id, coalesce(l.quality, -1) as quality from pairs p left join (select doc_id, max(quality) as quality from labels group by doc_id) l on l.doc_id = p.pair_id")
def _(spark, sf):
    labels = X.table(spark, sf, "labels").select(F.col("doc_id").alias("pair_id"), "quality")
    return J.one_to_one(X.slim_pairs(spark, sf).select("pair_id"), labels, ["pair_id"]).fillna({"quality": -1})


@query("j3_lookup_keep_first", ", f as (select user_id, event_type, row_number() over (partition by user_id order by ts, event_id) as r from events) select p.pair_id, coalesce(f.event_type, '') as first_event from pairs p left join f on f.user_id = p.pair_id and r = 1")
def _(spark, sf):
    """J3, J8 and J17: a keyed lookup in a table whose key repeats."""
    e = X.table(spark, sf, "events").select(F.col("user_id").alias("pair_id"), F.col("event_type").alias("first_event"), "ts", "event_id")
    return J.lookup(X.slim_pairs(spark, sf).select("pair_id"), e, ["pair_id"], ["ts", "event_id"], {"first_event": ""}).select("pair_id", "first_event")


@query("j8_last_wins", "select user_id, arg_max(event_type, event_id) as last_event from events group by user_id")
def _(spark, sf):
    return J.keep_last(X.table(spark, sf, "events"), ["user_id"], ["event_id"]).select("user_id", F.col("event_type").alias("last_event"))


@query("j4_base_and_tuned", "select j.pair_id, j.predicted_winner as base, p.predicted_winner as tuned, q.preference_strength from judged j join preds p using (pair_id) left join pairs q using (pair_id)")
def _(spark, sf):
    base = Q.judged(spark, sf).select("pair_id", F.col("predicted_winner").alias("base"))
    tuned = Q.predictions(spark, sf).select("pair_id", F.col("predicted_winner").alias("tuned"))
    return base.join(tuned, "pair_id").join(X.slim_pairs(spark, sf).select("pair_id", "preference_strength"), "pair_id", "left")


@query("j6_inner_after_dedupe", ", d as (select doc_id, min(quality) as quality from labels group by doc_id) select quality, count(*) as n_matched, (select count(*) from pairs) - (select count(*) from pairs p join d on d.doc_id = p.pair_id) as n_lost from pairs p join d on d.doc_id = p.pair_id group by quality")
def _(spark, sf):
    pairs = X.slim_pairs(spark, sf).select("pair_id")
    labels = J.keep_first(X.table(spark, sf, "labels").select(F.col("doc_id").alias("pair_id"), "quality"), ["pair_id"], ["quality"])
    counts = pairs.join(labels, "pair_id", "left").groupBy("quality").agg(F.count(F.lit(1)).alias("n_matched"))
    lost = F.coalesce(F.max(F.when(F.col("quality").isNull(), F.col("n_matched"))).over(Window.partitionBy(F.lit(1))), F.lit(0))  # a row per label
    return counts.withColumn("n_lost", lost).filter("quality is not null")


@query("j9_three_key_join", "select p.pair_id from pairs p join (select pair_id, response_a, response_b from pairs where winner = 'A') q on p.pair_id = q.pair_id and p.response_a = q.response_a and p.response_b = q.response_b")
def _(spark, sf):
    h = lambda c: F.xxhash64(c).alias(c)
    p = X.pairs(spark, sf)
    keys = ["pair_id", "response_a", "response_b"]
    return p.select("pair_id", h("response_a"), h("response_b")).join(p.filter("winner = 'A'").select("pair_id", h("response_a"), h("response_b")), keys).select("pair_id")


@query("j7_j11_statistics_join", "select b.qid, coalesce(q.n, 0) as n, coalesce(b.dimension, '?UNKNOWN') as dimension from bank b left join (select qid, count(*) as n from contrib where c <> 0 group by qid) q using (qid)")
def _(spark, sf):
    c = S.contribution(F.col("ans_a"), F.col("ans_b"))
    counts = X.answers(spark, sf).filter(c != 0).groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    return X.bank(spark, sf).join(counts, "qid", "left").select("qid", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("dimension", F.lit("?UNKNOWN")).alias("dimension"))


@query("j14_layered_upsert", ", u as (select pair_id, case when pair_id % 6 = 0 then 'A' when pair_id % 3 = 0 then 'B' else predicted_winner end as v, case when pair_id % 6 = 0 then 2 when pair_id % 3 = 0 then 1 else 0 end as layer from judged) select pair_id, v as predicted_winner from u")
def _(spark, sf):
    base = Q.judged(spark, sf).select("pair_id", "predicted_winner")
    one = base.filter("pair_id % 3 = 0").withColumn("predicted_winner", F.lit("B"))
    two = base.filter("pair_id % 6 = 0").withColumn("predicted_winner", F.lit("A"))
    return J.upserted(base, [one, two], "pair_id", allow_new=True)


@query("j14_layer_agreement", "select layer, avg((case layer when 0 then predicted_winner when 1 then case when pair_id % 3 = 0 then 'B' else predicted_winner end else case when pair_id % 6 = 0 then 'A' when pair_id % 3 = 0 then 'B' else predicted_winner end end = winner)::double) as agreement from judged, (select unnest([0, 1, 2]) as layer) group by layer")
def _(spark, sf):
    base = Q.judged(spark, sf).select("pair_id", "winner", "predicted_winner")
    p = F.col("pair_id")
    after = F.array(F.col("predicted_winner"), F.when(p % 3 == 0, "B").otherwise(F.col("predicted_winner")), F.when(p % 6 == 0, "A").when(p % 3 == 0, "B").otherwise(F.col("predicted_winner")))
    rows = base.select("winner", F.posexplode(after).alias("layer", "said"))
    return rows.groupBy("layer").agg(F.avg((F.col("said") == F.col("winner")).cast("double")).alias("agreement"))


@query("j16_completeness", "select pair_id from pairs where pair_id not in (select doc_id from labels)")
def _(spark, sf):
    have = X.table(spark, sf, "labels").select(F.col("doc_id").alias("pair_id"))
    return J.missing_keys(X.slim_pairs(spark, sf).select("pair_id"), have, ["pair_id"])


@query("s1_union_all", "select 'document' as kind, doc_id as id from documents union all select 'page', page_id from pages union all select 'turn', conv_id * 1000 + turn from conversations")
def _(spark, sf):
    part = lambda name, kind, c: X.table(spark, sf, name).select(F.lit(kind).alias("kind"), c.alias("id"))
    return part("documents", "document", F.col("doc_id")).unionByName(part("pages", "page", F.col("page_id"))).unionByName(part("conversations", "turn", F.col("conv_id") * 1000 + F.col("turn")))


@query("s3_s4_set_operations", ", l as (select pair_id, list(qid order by qid) filter (where qid % 2 = 0) as a, list(qid order by qid) filter (where qid % 3 = 0) as b from answers group by pair_id) select pair_id, list_sort(list_intersect(a, b)) as common, list_filter(a, lambda x: not list_contains(b, x)) as remaining from l")
def _(spark, sf):
    q = F.col("qid")
    rows = X.answers(spark, sf).groupBy("pair_id").agg(F.sort_array(F.collect_list(F.when(q % 2 == 0, q))).alias("a"), F.sort_array(F.collect_list(F.when(q % 3 == 0, q))).alias("b"))
    return rows.select("pair_id", F.array_intersect("a", "b").alias("common"), F.array_except("a", "b").alias("remaining"))


@query("s17_new_questions", "select qid from bank where trim(question_text) not in (select trim(text) from benchmark where item_id % 4 <> 0)")
def _(spark, sf):
    old = X.bank(spark, sf).filter((F.col("qid") - 1) % 4 != 0).select(F.trim("question_text").alias("t"))
    return X.bank(spark, sf).withColumn("t", F.trim("question_text")).join(old, "t", "left_anti").select("qid")


@query("w13_dedupe_keep_first", "select min(doc_id) as doc_id from documents group by text")
def _(spark, sf):
    d = X.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return d.groupBy("h").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("f10_trace_status", ", z as (select pair_id, case pair_id % 9 when 4 then 'parse_error' when 5 then 'unmatched' else 'kept' end as s from pairs) select s as status, count(*) as n from z group by s")
def _(spark, sf):
    from .parsing import traces

    rows = traces(spark, sf).withColumn("t", P.trace(F.col("raw"))).withColumn("t", F.col("t").withField("winner", F.coalesce("t.winner", "winner")))
    return rows.groupBy(E.trace_status(F.col("t"), F.col("winner")).alias("status")).agg(F.count(F.lit(1)).alias("n"))
