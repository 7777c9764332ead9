"""Queries of training-set exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlens.functions import parsers as P
from pairlens.functions import text as T
from pairlens.operators import exports as E
from pairlens.operators.windows import small_broadcast
from pairlens.sources import fixtures as X

from . import scoring as Q
from .registry import query, rounded


def _contexts(spark, sf):
    return X.with_context(spark, sf, X.pairs(spark, sf)).withColumn("context", T.context_text(F.col("context_turns")))


@query("d1_preference_triples", "select pair_id, sha256(context) as prompt, sha256(case winner when 'A' then response_a else response_b end) as chosen, sha256(case winner when 'A' then response_b else response_a end) as rejected from paired where winner <> 'Tie'")
def _(spark, sf):
    rows = E.preference_triples(_contexts(spark, sf), "pair_id", F.col("context"))
    return rows.select("pair_id", *(F.sha2(c, 256).alias(c) for c in ("prompt", "chosen", "rejected")))


@query("d2_final_only", "select pair_id, length(context) as n, 'Winner: ' || winner as answer from paired where winner <> 'Tie'")
def _(spark, sf):
    rows = E.final_only(_contexts(spark, sf), "pair_id", F.col("context"))
    return rows.select("pair_id", F.length(F.col("messages")[0]["content"]).cast("long").alias("n"), F.col("messages")[1]["content"].alias("answer"))


@query("d3_rows_per_side", "select pair_id, 'A' as side, sha256(response_a) as h from pairs union all select pair_id, 'B', sha256(response_b) from pairs")
def _(spark, sf):
    """D3 and D4."""
    return E.per_side(X.pairs(spark, sf), ["pair_id"]).select("pair_id", "side", F.sha2("response", 256).alias("h"))


@query("d5_generator_rows", ", s as (select domain, dimension, '### ' || dimension || chr(10) || string_agg('- ' || question_text, chr(10) order by qid) as t from active group by domain, dimension), g as (select domain, string_agg(t, chr(10) || chr(10) order by dimension) as t from s group by domain) select pair_id, sha256(context || chr(10) || t) as h from paired join g using (domain)")
def _(spark, sf):
    dims = X.active_bank(spark, sf).groupBy("domain", "dimension").agg(F.transform(F.sort_array(F.collect_list(F.struct("qid", "question_text"))), lambda x: x["question_text"]).alias("q"))
    targets = dims.groupBy("domain").agg(F.map_from_entries(F.collect_list(F.struct("dimension", "q"))).alias("m")).select("domain", T.checklist_text(F.col("m"), X.DIMENSIONS).alias("target"))
    return _contexts(spark, sf).join(small_broadcast(targets), "domain").select("pair_id", F.sha2(F.concat_ws("\n", "context", "target"), 256).alias("h"))


@query("d6_self_checklist_rows", "select pair_id, pair_id % 9 = 6 as no_final from pairs where pair_id % 9 not in (4, 5, 6)")
def _(spark, sf):
    from .parsing import traces

    rows = E.trace_rows(traces(spark, sf), "pair_id", P.trace(F.col("raw")))
    return rows.select("pair_id", (~F.col("target").contains("### Final")).alias("no_final"))


@query("d7_grpo_lines", "select pair_id, '{\"pair_id\":' || pair_id || ',\"winner\":\"' || winner || '\",\"strength\":' || preference_strength || '}' as line from pairs where winner <> 'Tie'")
def _(spark, sf):
    rows = X.slim_pairs(spark, sf).filter(F.col("winner").isin("A", "B")).select("pair_id", "winner", F.col("preference_strength").alias("strength"))
    return rows.select("pair_id", F.to_json(F.struct("pair_id", "winner", "strength")).alias("line"))


@query("d8_na_table", "select pair_id, 'A' as side, qid from answers where ans_a = 'na' union all select pair_id, 'B', qid from answers where ans_b = 'na'")
def _(spark, sf):
    rows = X.answers(spark, sf).select("pair_id", "qid", F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(c).alias("x")) for s, c in (("A", "ans_a"), ("B", "ans_b"))))).alias("s"))
    return rows.filter("s.x = 'na'").select("pair_id", "s.side", "qid")


@query("d9_review_rows", "select p.pair_id, length(p.response_a) as na, j.predicted_winner, case when j.predicted_winner is null then 'parse_failure' when j.predicted_winner = 'Tie' then 'tie' when j.predicted_winner = j.winner then 'correct' else 'wrong_winner' end as category, c.turns from pairs p join judged j using (pair_id) join (select conv_id, count(*) as turns from conversations group by conv_id) c on c.conv_id = p.pair_id % (select max(conv_id) + 1 from conversations)")
def _(spark, sf):
    from pairlens.operators.scoring import error_category

    rows = X.with_context(spark, sf, X.pairs(spark, sf)).select("pair_id", F.length("response_a").cast("long").alias("na"), F.size("context_turns").cast("long").alias("turns"))
    said = Q.judged(spark, sf).select("pair_id", "predicted_winner", error_category(F.col("winner"), F.col("predicted_winner")).alias("category"))
    return rows.join(said, "pair_id")


@query("d10_tie_subset", "select p.pair_id, domain from preds p where predicted_winner = 'Tie' and winner <> 'Tie'")
def _(spark, sf):
    ties = Q.predictions(spark, sf).filter("predicted_winner = 'Tie' and winner <> 'Tie'").select("pair_id")
    return X.slim_pairs(spark, sf).join(ties, "pair_id", "left_semi").select("pair_id", "domain")


@query("io11_wide_scalars", "select user_id, round(avg(value) filter (where event_type = 'click'), 9) as click, round(avg(value) filter (where event_type = 'view'), 9) as \"view\", round(avg(value) filter (where event_type = 'error'), 9) as error from events group by user_id")
def _(spark, sf):
    return rounded(E.wide(X.table(spark, sf, "events"), ["user_id"], "event_type", "value", ["click", "view", "error"]), "click", "view", "error")


@query(
    "io11_event_files",
    "select event_id as step, epoch_us(ts) / 1e6 as wall_time, " + ", ".join(f"case when event_type = '{t}' then value::float end as {t}" for t in ("click", "error", "purchase", "signup")) + ", case when event_type = 'view' then value::float end as \"view\" from events",
    prelude=False,
)
def _(spark, sf):
    """Events as scalars in event files, read back and spread by tag: the latest of a step and tag."""
    from pairlens.sources.eventfiles import EventFiles
    from pairlens.sources.tables import scratch

    spark.dataSource.register(EventFiles)
    path = scratch(spark, "event-files")
    rows = X.table(spark, sf, "events").select(F.col("event_type").alias("tag"), F.col("event_id").alias("step"), "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("wall_time"))
    rows.repartition(4, "step").write.format("event_files").mode("append").save(path)
    found = spark.read.format("event_files").load(path).filter("broken is null")
    return E.latest_wide(found, ["click", "error", "purchase", "signup", "view"])


@query("io13_review", "select a.pair_id, a.winner, p.predicted_winner, a.qid as q, ans_a as a, ans_b as b from answers a join judged p using (pair_id) where a.domain = 'stem' and p.predicted_winner is distinct from a.winner and ans_a <> ans_b and (a.pair_id % 4 = 0 or a.qid % 3 = a.pair_id % 3)")
def _(spark, sf):
    """What a reviewer sees of one domain's wrong predictions: the selected questions on which the two sides differ."""
    entries = F.sort_array(F.collect_list(F.struct("qid", "ans_a", "ans_b")))
    side = lambda c: F.map_from_entries(F.transform(F.col("e"), lambda x: F.struct(x["qid"], x[c])))
    chosen = F.to_json(F.filter(F.transform("e", lambda x: x["qid"]), lambda q: q % 3 == F.col("pair_id") % 3))
    rows = X.answers(spark, sf).filter("domain = 'stem'").groupBy("pair_id").agg(entries.alias("e")).select("pair_id", side("ans_a").alias("answers_a"), side("ans_b").alias("answers_b"), F.when(F.col("pair_id") % 4 != 0, chosen).alias("selected_qids"))
    results = Q.judged(spark, sf).select("pair_id", "domain", "winner", "predicted_winner").join(rows, "pair_id")
    seen = E.review(results, "Wrong predictions", "stem")
    return seen.select("pair_id", "winner", "predicted_winner", F.explode("differences").alias("d")).select("pair_id", "winner", "predicted_winner", "d.*")


@query("io14_resume_cache", ", r as (select event_id % 50 as k, substr(sha256(props), 1, 8) as h, event_id from events), c as (select distinct k, h from r where event_id % 3 = 0) select k, h, min(event_id) as first_id from r where not exists (select 1 from c where c.k = r.k and c.h = r.h) group by all")
def _(spark, sf):
    """Requests that the cache doesn't answer, once each."""
    from pairlens.sources.connector import pending

    r = X.table(spark, sf, "events").select((F.col("event_id") % 50).alias("k"), F.substring(F.sha2("props", 256), 1, 8).alias("h"), "event_id")
    return pending(r, r.filter("event_id % 3 = 0"), ["k", "h"]).groupBy("k", "h").agg(F.min("event_id").alias("first_id"))


@query("io14_streamed_requests", "select cast(event_id % 50 as varchar) as request_key, sha256(props) as prompt_sha256, 'said ' || props as response, 1 as n_answers from events group by all", prelude=False)
def _(spark, sf):
    """Requests that come in two parts, each worked off in batches; the second run starts from the first one's state. How often each was answered, and the answer."""
    from pairlens.sources.tables import scratch
    from pairlens.streaming import requests as Q14

    path, out, state = (scratch(spark, f"streamed-{x}") for x in ("in", "out", "state"))
    rows = X.table(spark, sf, "events").select((F.col("event_id") % 50).cast("string").alias("request_key"), F.lit("s").alias("signature"), F.col("props").alias("prompt"), "event_id")
    for part in (0, 1):
        rows.filter(F.col("event_id") % 2 == part).drop("event_id").repartition(3).write.mode("append").parquet(path)
        Q14.run_available(Q14.answered(Q14.read_requests(spark, path, 2), lambda prompt: f"said {prompt}"), out, state)
    found = spark.read.parquet(out)
    return found.groupBy("request_key", "prompt_sha256").agg(F.max("response").alias("response"), F.count(F.lit(1)).alias("n_answers"))


@query("io18_provenance_hash", "select doc_id, sha256(text) as h from documents")
def _(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
