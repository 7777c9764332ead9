"""Queries of nested annotations, re-audits, totals and orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pairlens.functions import nested as N
from pairlens.functions import parsers as P
from pairlens.operators import metrics as M
from pairlens.operators import scoring as S
from pairlens.sources import fixtures as X

from . import scoring as Q
from .metrics import DELTAS
from .parsing import _LINES, KEYS
from .registry import query

_KEYS = ("reasoning", "rationale", "explanation", "summary")


def _annotated(spark, sf):
    """pair_id, raw: three annotators with different keys, two of whom agree; some rows a plain text, an object, JSON in a value, or null."""
    p = F.col("pair_id")
    key = F.element_at(F.array(*map(F.lit, _KEYS)), (p % 4 + 1).cast("int"))
    entry = lambda text: F.concat(F.lit('{"'), key, F.lit('": "'), text, F.lit('", "feedback1": "f'), (p % 3).cast("string"), F.lit('", "score": 1}'))
    listed = F.concat(F.lit("["), entry(F.concat(F.lit("one "), p.cast("string"))), F.lit(", "), entry(F.lit("two")), F.lit(", "), entry(F.lit("two")), F.lit("]"))
    inner = F.concat(F.lit('{"reasoning": "{\\"text\\": \\"deep '), p.cast("string"), F.lit('\\"}"}'))
    raw = F.when(p % 7 == 0, F.lit(None)).when(p % 7 == 1, F.concat(F.lit(" plain "), p.cast("string"))).when(p % 7 == 2, entry(F.lit("single"))).when(p % 7 == 3, inner).otherwise(listed)
    return X.slim_pairs(spark, sf).select("pair_id", raw.alias("raw"))


@query("p13_nested_reasoning", "select pair_id, case pair_id % 7 when 0 then '' when 1 then 'plain ' || pair_id when 2 then 'single' when 3 then 'deep ' || pair_id else 'one ' || pair_id || chr(10) || chr(10) || 'two' end as reasoning from pairs")
def _(spark, sf):
    return _annotated(spark, sf).select("pair_id", N.reasoning(F.col("raw")).alias("reasoning"))


@query("p14_nested_feedback", "select pair_id, case when pair_id % 7 in (0, 1, 3) then '' else 'f' || pair_id % 3 end as feedback from pairs")
def _(spark, sf):
    return _annotated(spark, sf).select("pair_id", N.feedback(F.col("raw"), "feedback1").alias("feedback"))


@query("p41_retemplated_prompts", "select pair_id, case when pair_id % 5 = 0 then 'kept ' || pair_id else sha256('Question:' || chr(10) || context || chr(10) || 'A:' || chr(10) || response_a || chr(10) || 'B:' || chr(10) || response_b) end as prompt from paired")
def _(spark, sf):
    """A new template over the raw fields; rows that lack one keep their old prompt."""
    from .text import contexts

    rows = contexts(spark, sf).withColumn("context", F.when(F.col("pair_id") % 5 != 0, F.col("context"))).withColumn("prompt", F.concat(F.lit("kept "), F.col("pair_id").cast("string")))
    new = F.sha2(F.concat(F.lit("Question:\n"), "context", F.lit("\nA:\n"), "response_a", F.lit("\nB:\n"), "response_b"), 256)
    return rows.select("pair_id", F.coalesce(new, "prompt").alias("prompt"))


@query(
    "a28_reaudited_counts",
    _LINES + ", s as (select pair_id, side, n_yes, n_yes + n_no + n_na as n_kept, n_duplicates, n_out_of_range, first_bad_lineno is not null as stopped from parsed) "
    "select case pair_id % 3 when 0 then 'general' when 1 then 'stem' else 'code' end as domain, count(*) as n, count(*) filter (where n_duplicates > 0) as n_repeated, count(*) filter (where stopped) as n_with_rationale, avg((n_kept = 0)::integer) as failed_rate from s group by rollup (domain)",
)
def _(spark, sf):
    """Stored counts against a strict reading of the same outputs, overall and by domain."""
    both = P.parsed_checklist(X.raw_outputs(spark, sf), KEYS, more=P.strict_reading()).withColumn("kept", F.col("n_questions_parsed") + F.col("n_na"))
    both = both.withColumn("domain", F.element_at(F.array(*map(F.lit, X.DOMAINS)), (F.col("pair_id") % 3 + 1).cast("int")))
    repeated = F.col("n_matches") > F.col("kept") + F.col("n_out_of_range")
    return both.rollup("domain").agg(F.count(F.lit(1)).alias("n"), F.count_if(repeated).alias("n_repeated"), F.count_if("rationale_after").alias("n_with_rationale"), F.avg((F.col("kept") == 0).cast("int")).alias("failed_rate"))


#: what a judge says of a dimension, by what the answer to a question is: a score, none, or one that doesn't count
_SAYS = "case when x = 'yes' then 'Reason: 3 of 9. Score: ' || (qid % 5 + 1) when x = 'no' then (['score:' || (qid % 7), 'Score: N/A', 'Score: 45', 'I give 4', 'SCORE: na, Score: 3'])[(pair_id + qid) % 5 + 1] else 'Score:  ' || (qid % 3) end"


@query(
    "c26_geval_totals",
    r", g as (select pair_id, side, dimension, max_by(x, qid) as x, max(qid) as qid from (select pair_id, qid, dimension, 'a' as side, ans_a as x from answers union all select pair_id, qid, dimension, 'b', ans_b from answers) group by all), s as (select pair_id, side, regexp_extract({0}, 'score:\s*(n/?a|[0-9])', 1, 'i') as d from g), ".replace("{0}", _SAYS)
    + "t as (select pair_id, coalesce(sum(try_cast(d as bigint)) filter (where side = 'a' and d in ('1', '2', '3', '4', '5')), 0)::bigint as total_a, coalesce(sum(try_cast(d as bigint)) filter (where side = 'b' and d in ('1', '2', '3', '4', '5')), 0)::bigint as total_b from s group by pair_id) "
    "select pair_id, total_a, total_b, case when total_a > total_b then 'A' when total_a < total_b then 'B' else 'Tie' end as winner from t",
)
def _(spark, sf):
    """Scores of a side's dimensions as a judge writes them, one for the last question of each."""
    long = X.answers(spark, sf).select("pair_id", "qid", "dimension", F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"ans_{s}").alias("x")) for s in "ab"))).alias("e")).select("pair_id", "qid", "dimension", "e.*")
    last = long.groupBy("pair_id", "side", "dimension").agg(F.max_by("x", "qid").alias("x"), F.max("qid").alias("qid"))
    said = F.expr(_SAYS.replace("(['", "element_at(array('").replace("'])[(pair_id + qid) % 5 + 1]", "'), cast((pair_id + qid) % 5 + 1 as int))"))
    maps = last.withColumn("score", P.likert(said)).groupBy("pair_id").agg(*(N.geval_total(F.map_from_entries(F.collect_list(F.when(F.col("side") == s, F.struct("dimension", "score"))))).cast("long").alias(f"total_{s}") for s in "ab"))
    return maps.withColumn("winner", F.when(F.col("total_a") > F.col("total_b"), "A").when(F.col("total_a") < F.col("total_b"), "B").otherwise("Tie"))


@query(
    "w11_sweep_order",
    f", s as (select winner, d as tie_delta, case when margin > d then 'A' when margin < -d then 'B' else 'Tie' end as p from margins, (select unnest({DELTAS}::double[]) as d)), "
    "g as (select tie_delta, count(*) filter (where p = winner and p <> 'Tie') / count(*) as eff, coalesce(count(*) filter (where p = winner and p <> 'Tie') / nullif(count(*) filter (where p <> 'Tie'), 0), 0) as val, count(*) filter (where p = 'Tie') / count(*) as ties from s group by tie_delta) "
    "select tie_delta, cast(row_number() over (order by eff desc, val desc, ties, tie_delta) as integer) as place from g",
)
def _(spark, sf):
    """The thresholds of a sweep, best first; a few rows."""
    sweep = M.threshold_sweep(S.margins(X.answers(spark, sf), Q.KEYS), DELTAS)
    order = Window.orderBy(F.desc("effective_accuracy"), F.desc("valid_accuracy"), "tie_rate", "tie_delta")
    return sweep.select("tie_delta", F.row_number().over(order).alias("place"))


@query("w19_prompt_chunks", ", c as (select domain, (row_number() over (partition by domain order by pair_id) - 1) // 64 as chunk from pairs) select domain, chunk, count(*) as n from c group by all")
def _(spark, sf):
    """Requests of a domain in chunks of 64."""
    from pairlens.operators.windows import places

    rows = places(X.slim_pairs(spark, sf).select("domain", "pair_id"), ["domain"], "pair_id", "place")
    return rows.select("domain", F.floor(F.col("place") / 64).alias("chunk")).groupBy("domain", "chunk").agg(F.count(F.lit(1)).alias("n"))


@query("io2_projected_scan", "select doc_id, n_chars from documents where n_chars > 1000")
def _(spark, sf):
    """Column pruning and a pushed-down filter at the scan."""
    return X.table(spark, sf, "documents").filter("n_chars > 1000").select("doc_id", "n_chars")


@query("io5_json_lines", "select event_id, cast(json_extract(props, '$.k') as integer) as k from events where event_id % 10 <> 0")
def _(spark, sf):
    """Lines of which every tenth is malformed: those are skipped."""
    line = F.when(F.col("event_id") % 10 == 0, F.lit("{broken")).otherwise(F.col("props"))
    rows = X.table(spark, sf, "events").select("event_id", F.from_json(line, "k int, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return rows.filter("r is not null and r._bad is null").select("event_id", "r.k")
