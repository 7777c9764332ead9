"""Queries of the parsers, over judge texts derived from the answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlens.functions import parsers as P
from pairlens.operators.windows import small_broadcast
from pairlens.sources import fixtures as X

from .registry import query

KEYS = ["pair_id", "side"]

#: the line machine, in SQL, for texts whose lines end in \n or \r\n
_LINES = """
, l0 as (select pair_id, side, n, unnest(string_split(replace(raw, chr(13), ''), chr(10))) as line, generate_subscripts(string_split(replace(raw, chr(13), ''), chr(10)), 1) as lineno from outputs),
l1 as (select *, case when line = '' then 'blank' when regexp_matches(line, '(?i)^q[0-9]+:\\s*(yes|no)$') then 'answer' when regexp_matches(line, '(?i)^q[0-9]+:\\s*(n/a|na|not applicable)\\.?$') then 'na'
  when regexp_matches(line, '(?i)^(yes|no)$') then 'bare' when regexp_matches(line, '(?i)^(n/a|na|not applicable)\\.?$') then 'bare_na' else 'other' end as kind from l0),
l2 as (select *, max(kind in ('answer', 'na', 'bare', 'bare_na')) over w as started, count(*) filter (where kind in ('bare', 'bare_na')) over w as counter from l1 window w as (partition by pair_id, side order by lineno rows unbounded preceding)),
l3 as (select *, count(*) filter (where kind = 'other' and started) over (partition by pair_id, side order by lineno rows unbounded preceding) as stops from l2),
l4 as (select *, kind in ('answer', 'na', 'bare', 'bare_na') and stops = 0 as live, case when kind in ('answer', 'na') then cast(regexp_extract(line, '(?i)^q([0-9]+)', 1) as bigint) else counter end as q0 from l3),
l5 as (select *, live and q0 between 1 and n as ok, row_number() over (partition by pair_id, side, live and q0 between 1 and n, q0 order by lineno) as r from l4),
l6 as (select *, case when kind = 'other' and started and stops = 1 then 'stop' when not live then 'ignored' when not ok then 'out_of_range' when r > 1 then 'duplicate' else 'kept' end as fate,
  case when kind in ('na', 'bare_na') then 'na' else lower(regexp_extract(line, '(?i)(yes|no)$', 1)) end as a from l5),
parsed as (select pair_id, side, any_value(n) as n, count(*) filter (where fate = 'kept' and a = 'yes') as n_yes, count(*) filter (where fate = 'kept' and a = 'no') as n_no, count(*) filter (where fate = 'kept' and a = 'na') as n_na,
  count(*) filter (where fate = 'duplicate') as n_duplicates, count(*) filter (where fate = 'out_of_range') as n_out_of_range, max(case when fate = 'stop' then lineno end) as first_bad_lineno, max(case when fate = 'stop' then line end) as first_bad_line,
  coalesce(bool_or(kind in ('na', 'bare_na') and fate <> 'ignored'), false) as hit from l6 group by pair_id, side)
"""


@query("x1_checklist_lines", _LINES + "select pair_id, cast(side as integer) as side, cast(lineno as integer) as lineno, kind, case when live then q0 end as q, case when fate = 'kept' then a end as answer, fate from l6")
def _(spark, sf):
    return P.checklist_lines(X.raw_outputs(spark, sf), KEYS).select("pair_id", "side", "lineno", "kind", "q", "answer", "fate")


@query(
    "x1_parsed_checklist",
    _LINES + "select pair_id, cast(side as integer) as side, n_yes + n_no > 0 as parse_ok, n_yes + n_no as n_questions_parsed, n_yes, case when n_yes + n_no > 0 then n_no end as n_no, n_na, case when n_yes + n_no > 0 then n_yes / (n_yes + n_no) else 0 end as score, "
    "n_yes + n_no = n as complete, n_yes + n_no > 0 and n_yes + n_no + n_na = n as complete_with_na, case when first_bad_lineno is not null then 'unrecognized_line_after_started' when n_yes + n_no = 0 and n_na > 0 and n_out_of_range > 0 then 'out_of_range_only' when n_yes + n_no = 0 then 'empty_output' when hit then 'hit_na_but_continued' else 'completed' end as stop_reason, "
    "first_bad_line, cast(first_bad_lineno as integer) as first_bad_lineno, n_duplicates, n_out_of_range from parsed",
)
def _(spark, sf):
    return P.parsed_checklist(X.raw_outputs(spark, sf), KEYS).drop("answers", "na_qnums")


@query("x2_strict_lines", _LINES + ", f as (select *, min(case when fate = 'stop' then lineno end) over (partition by pair_id, side) as s, kind in ('answer', 'na', 'bare', 'bare_na') as m from l6) select pair_id, cast(side as integer) as side, count(*) filter (where m and (s is null or lineno < s)) as n_matches, bool_or(s is not null) as rationale_after, coalesce(bool_or(m and lineno > s), false) as more_after from f group by pair_id, side")
def _(spark, sf):
    return P.strict_lines(X.raw_outputs(spark, sf), KEYS)


@query("p9_label_map", _LINES + ", k as (select *, bool_or(fate = 'kept' and a in ('yes', 'no')) over (partition by pair_id, side) as good from l6) select pair_id, cast(side as integer) as side, cast(q0 as integer) as q, a as answer from k where fate = 'kept' and good")
def _(spark, sf):
    return P.checklist_answers(X.raw_outputs(spark, sf), KEYS)


@query("a37_parse_summary", _LINES + "select side % 2 = 0 as is_a, count(*) as n, count(*) filter (where n_yes + n_no = 0) as n_failed, sum(n_na)::bigint as n_na, sum(n_duplicates)::bigint as n_duplicates, count(*) filter (where n_na > 0) as n_with_na from parsed group by all")
def _(spark, sf):
    p = P.parsed_checklist(X.raw_outputs(spark, sf), KEYS)
    return p.groupBy((F.col("side") == 0).alias("is_a")).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("parse_ok")).alias("n_failed"), F.sum("n_na").alias("n_na"), F.sum("n_duplicates").alias("n_duplicates"), F.count_if(F.col("n_na") > 0).alias("n_with_na"))


@query("f9_rows_with_na", "select pair_id, cast(side as integer) as side, len(regexp_extract_all(raw, '(?im)^\\s*q([0-9]+):\\s*n\\s*/?\\s*a\\b')) as n_na from outputs where regexp_matches(raw, '(?im)^\\s*q([0-9]+):\\s*n\\s*/?\\s*a\\b')")
def _(spark, sf):
    """F9 and X16."""
    rows = X.raw_outputs(spark, sf).withColumn("na", P.na_numbers(F.col("raw")))
    return rows.filter(F.size("na") > 0).select("pair_id", "side", F.size("na").cast("long").alias("n_na"))


#: comparative outputs: a label per question by the contribution, the first question answered twice, a lower-case label now and then
_COMPARATIVE = """
, ab as (select pair_id, domain, winner, q, case when c > 0 then (case when (pair_id + q) % 7 = 0 then 'a' else 'A' end) when c < 0 then 'B' else 'Tie' end as l from contrib join numbered using (domain, qid)),
cmp as (select pair_id, winner, count(*) as n, 'Q1: Tie' || chr(10) || string_agg('Q' || q || ': ' || l, chr(10) order by q) || case when pair_id % 5 = 0 then '' else chr(10) || 'Winner: ' || winner end as raw from ab group by pair_id, winner)
"""


def comparative(spark, sf):
    from pairlens.operators.scoring import contribution
    from pairlens.operators.selection import local_numbers

    numbers = local_numbers(X.active_bank(spark, sf)).select("domain", "qid", "q")
    c = contribution(F.col("ans_a"), F.col("ans_b"))
    label = F.when(c > 0, F.when((F.col("pair_id") + F.col("q")) % 7 == 0, "a").otherwise("A")).when(c < 0, "B").otherwise("Tie")
    rows = X.answers(spark, sf).join(small_broadcast(numbers), ["domain", "qid"]).select("pair_id", "winner", "q", F.concat(F.lit("Q"), F.col("q").cast("string"), F.lit(": "), label).alias("l"))
    text = rows.groupBy("pair_id", "winner").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("q", "l"))), lambda x: x["l"]), "\n").alias("t"))
    return text.select("pair_id", "winner", "n", F.concat(F.lit("Q1: Tie\n"), "t", F.when(F.col("pair_id") % 5 == 0, "").otherwise(F.concat(F.lit("\nWinner: "), "winner"))).alias("raw"))


@query("x3_comparative_last", _COMPARATIVE + "select pair_id, cast(q as integer) as q, l as label, true as ok from ab")
def _(spark, sf):
    rows = comparative(spark, sf).select("pair_id", "n", P.comparative_answers(F.col("raw")).alias("a"))
    rows = rows.select("pair_id", P.comparative_ok(F.col("a"), F.col("n")).alias("ok"), "a")
    return rows.select("pair_id", "ok", F.explode("a").alias("x")).select("pair_id", "x.q", "x.label", "ok")


@query("x4_comparative_first", _COMPARATIVE + "select pair_id, cast(q as integer) as q, case when q = 1 then 'Tie' when l = 'a' then 'A' else l end as label from ab")
def _(spark, sf):
    rows = comparative(spark, sf).select("pair_id", F.explode(P.comparative_answers_strict(F.col("raw"), F.col("n"))).alias("x"))
    return rows.select("pair_id", "x.q", "x.label")


@query(
    "x5_comparative_winner",
    _COMPARATIVE + ", s as (select pair_id, winner, (count(*) filter (where q > 1 and upper(l) = 'A') - count(*) filter (where q > 1 and l = 'B')) / count(*) as m from ab group by all) "
    "select pair_id, case when pair_id % 5 <> 0 and winner in ('A', 'B') then winner when m > 0.05 then 'A' when m < -0.05 then 'B' else 'Tie' end as winner, case when pair_id % 5 <> 0 then winner end as stated from s",
)
def _(spark, sf):
    """X5 and X8."""
    stated = P.trailing_winner(F.col("raw"))
    return comparative(spark, sf).select("pair_id", P.comparative_winner(P.comparative_answers_strict(F.col("raw"), F.col("n")), stated).alias("winner"), stated.alias("stated"))


_VANILLA = ("{{\"winner\": \"{0}\"}}", "Sure. {{\"winner\": \"{0}\", \"why\": 1}} done", "{0}", "Response {0} is the better one", "I think that {0}", "none of them")


@query("x6_vanilla_winner", "select pair_id, case when pair_id % 6 = 5 or winner = 'Tie' then null else winner end as winner from pairs")
def _(spark, sf):
    forms = F.element_at(F.array(*(F.format_string(f.replace("{{", "{").replace("}}", "}").replace("{0}", "%1$s"), F.when(F.col("winner") == "Tie", "x").otherwise(F.col("winner"))) for f in _VANILLA)), (F.col("pair_id") % 6 + 1).cast("int"))
    return X.slim_pairs(spark, sf).select("pair_id", P.vanilla_winner(forms).alias("winner"))


#: traces: questions and verdicts of a pair's first ten questions, with a rehearsal in <think>, an odd one without verdicts, one without a final section
_TRACES = """
, tq as (select pair_id, winner, q, case when c > 0 then 'A' when c < 0 then 'B' else 'tie' end as v from contrib join numbered using (domain, qid) where q <= 10),
traces as (select pair_id, winner, '<think>' || chr(10) || '### Checklist' || chr(10) || 'Q1: rehearsal' || chr(10) || '</think>' || chr(10) || '### Checklist' || chr(10) || string_agg('Q' || q || ': question ' || q, chr(10) order by q) ||
  case when pair_id % 9 = 4 then '' else chr(10) || '### Item Verdicts' || chr(10) || string_agg(case when pair_id % 9 = 5 and q = 10 then '' else 'Q' || q || ': ' || v || ' (because)' end, chr(10) order by q) end ||
  case when pair_id % 9 = 6 then '' else chr(10) || '### Final' || chr(10) || 'Winner: ' || winner end as raw from tq group by pair_id, winner)
"""


def traces(spark, sf):
    from pairlens.operators.scoring import contribution
    from pairlens.operators.selection import local_numbers

    numbers = local_numbers(X.active_bank(spark, sf)).filter("q <= 10").select("domain", "qid", "q")
    c = contribution(F.col("ans_a"), F.col("ans_b"))
    q = F.concat(F.lit("Q"), F.col("q").cast("string"), F.lit(": "))
    rows = X.answers(spark, sf).join(small_broadcast(numbers), ["domain", "qid"])
    verdict = F.when((F.col("pair_id") % 9 == 5) & (F.col("q") == 10), "").otherwise(F.concat(q, F.when(c > 0, "A").when(c < 0, "B").otherwise("tie"), F.lit(" (because)")))
    g = rows.select("pair_id", "winner", "q", F.concat(q, F.lit("question "), F.col("q").cast("string")).alias("t"), verdict.alias("v")).groupBy("pair_id", "winner").agg(F.sort_array(F.collect_list(F.struct("q", "t", "v"))).alias("x"))
    kind = F.col("pair_id") % 9
    raw = F.concat(
        F.lit("<think>\n### Checklist\nQ1: rehearsal\n</think>\n### Checklist\n"), F.array_join(F.col("x.t"), "\n"), F.when(kind == 4, "").otherwise(F.concat(F.lit("\n### Item Verdicts\n"), F.array_join(F.col("x.v"), "\n"))),
        F.when(kind == 6, "").otherwise(F.concat(F.lit("\n### Final\nWinner: "), "winner")),
    )
    return g.select("pair_id", "winner", raw.alias("raw"))


@query(
    "x7_trace",
    _TRACES + "select pair_id, case when pair_id % 9 in (4, 6) then null else winner end as winner, case when pair_id % 9 = 4 then 0 else 10 end as n_questions, case pair_id % 9 when 4 then 0 when 5 then 9 else 10 end as n_verdicts, pair_id % 9 not in (4, 5) as matched, "
    "case when pair_id % 9 = 4 then 'missing ### Item Verdicts section' end as parse_error, 10 as n_listed from traces",
)
def _(spark, sf):
    t = traces(spark, sf).select("pair_id", P.trace(F.col("raw")).alias("t"))
    return t.select("pair_id", "t.winner", "t.n_questions", "t.n_verdicts", "t.matched", "t.parse_error", F.size("t.checklist").alias("n_listed"))


@query("c27_trace_diagnostics", _TRACES + "select pair_id, case when pair_id % 9 = 4 then null else 10 end as n_questions, case when pair_id % 9 = 4 then null else count(*) filter (where v = 'tie' and not (pair_id % 9 = 5 and q = 10)) / (case when pair_id % 9 = 5 then 9 else 10 end) end as item_tie_rate from tq group by pair_id")
def _(spark, sf):
    t = traces(spark, sf).select("pair_id", P.trace(F.col("raw")).alias("t"))
    ties = F.size(F.filter(F.map_values("t.verdicts"), lambda v: v == "Tie"))
    return t.select("pair_id", F.nullif(F.col("t.n_questions"), F.lit(0)).alias("n_questions"), F.try_divide(ties, F.col("t.n_verdicts")).alias("item_tie_rate"))


@query("x9_generated_checklist", ", s as (select domain, dimension, qid, trim(replace(question_text, chr(10), ' ')) as question from active), o as (select domain, dimension, question, min(qid) as qid from s group by domain, dimension, question) select domain, dimension, lower(question) as question from (select *, row_number() over (partition by domain, dimension, lower(question) order by qid) as r from o) where r = 1 and dimension <> 'relevance_instruction_following'")
def _(spark, sf):
    """Sections of the bank as one text a domain, each bullet twice in different case; the last dimension isn't known."""
    rows = X.active_bank(spark, sf).groupBy("domain", "dimension").agg(F.sort_array(F.collect_list(F.struct("qid", "question_text"))).alias("q"))
    section = F.concat(F.lit("### "), "dimension", F.lit("\n"), F.array_join(F.transform("q", lambda x: F.concat(F.lit("- "), F.translate(x["question_text"], "\n", " "), F.lit("\n* "), F.lower(F.translate(x["question_text"], "\n", " ")))), "\n"))
    text = rows.groupBy("domain").agg(F.array_join(F.sort_array(F.collect_list(section)), "\n\n").alias("raw"))
    return P.checklist_questions(text, ["domain"], "raw", X.DIMENSIONS[:4]).select("domain", "dimension", F.lower("question").alias("question"))


@query("x10_simple_bullets", "select qid, ['first ' || qid, 'last'] as bullets from bank")
def _(spark, sf):
    raw = F.concat(F.lit("intro\n- first "), F.col("qid"), F.lit("\n- N/A\n-no\n  - last \nend"))
    return X.bank(spark, sf).select("qid", P.simple_bullets(raw).alias("bullets"))


@query("x11_extracted_questions", "select qid, dimension, 'Is it good ' || qid || '?' as question from bank")
def _(spark, sf):
    item = lambda d, q: F.concat(F.lit('{"dimension": "'), d, F.lit('", "question": "'), q, F.lit('"}'))
    inner = F.concat(F.lit("["), item(F.col("dimension"), F.concat(F.lit("Is it good "), F.col("qid"), F.lit("?"))), F.lit(", "), item(F.lit("other"), F.lit("x")), F.lit(", "), item(F.col("dimension"), F.lit("Is Response A good?")), F.lit("]"))
    raw = F.when(F.col("qid") % 3 == 0, inner).when(F.col("qid") % 3 == 1, F.concat(F.lit("```json\n"), inner, F.lit("\n```"))).otherwise(F.concat(F.lit("Here: "), inner, F.lit(" ok")))
    rows = X.bank(spark, sf).select("qid", F.explode(P.extracted_questions(raw, X.DIMENSIONS)).alias("x"))
    return rows.select("qid", "x.dimension", "x.question")


#: three annotators a pair: strict JSON, JSON in prose, loose mentions
_MENTIONS = """
, an as (select pair_id, unnest([0, 1, 2]) as annotator from pairs),
men as (select pair_id, annotator, list_distinct([pair_id % 40 + 1, (pair_id + annotator) % 40 + 1]) as ids from an),
mq as (select pair_id, annotator, cast(unnest(ids) as integer) as qid from men)
"""


def mentions(spark, sf):
    """pair_id, annotator, raw."""
    p = X.slim_pairs(spark, sf).select("pair_id", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("annotator"))
    x, y = F.col("pair_id") % 40 + 1, (F.col("pair_id") + F.col("annotator")) % 40 + 1
    listed = F.concat(F.lit('{"mentioned_qids": ['), x, F.lit(", "), y, F.lit(", 99]}"))
    raw = F.when(F.col("annotator") == 0, listed).when(F.col("annotator") == 1, F.concat(F.lit("I found "), listed, F.lit("."))).otherwise(F.concat(F.lit("Q"), x, F.lit(" and q"), y, F.lit(" apply")))
    return p.select("pair_id", "annotator", raw.alias("raw"))


@query("x12_mentioned_numbers", _MENTIONS + "select pair_id, cast(annotator as integer) as annotator, qid, annotator = 2 as fallback from mq")
def _(spark, sf):
    m = mentions(spark, sf).withColumn("m", P.mentioned_numbers(F.col("raw"), 1, 40))
    return m.select("pair_id", "annotator", F.explode("m.qids").alias("qid"), F.col("m.fallback").alias("fallback"))


@query("a6_human_relevance", _MENTIONS + "select pair_id, qid, count(*) / 3 as h, 3::bigint as n_annotators from mq group by all")
def _(spark, sf):
    from pairlens.operators.joins import human_relevance

    m = mentions(spark, sf).select("pair_id", P.mentioned_numbers(F.col("raw"), 1, 40)["qids"].alias("qids"), F.lit(True).alias("ok"))
    return human_relevance(m, ["pair_id"])


@query("a38_parse_rates", "select count(*) as n, 1 / 3::double as fallback_rate, 0.0::double as empty_rate from pairs, (select unnest([0, 1, 2]))")
def _(spark, sf):
    m = mentions(spark, sf).select(P.mentioned_numbers(F.col("raw"), 1, 40).alias("m"))
    return m.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("m.fallback").cast("double")).alias("fallback_rate"), F.avg((F.size("m.qids") == 0).cast("double")).alias("empty_rate"))


@query("x13_importance_weights", "select pair_id, 1 as qid, 5.0::double as importance from pairs union all select pair_id, 2, (pair_id % 5)::double from pairs")
def _(spark, sf):
    raw = F.concat(F.lit('Weights: {"weights": [{"qid": 2, "importance": 9}, {"qid": 1, "importance": 7.5}, {"qid": 2, "importance": '), F.col("pair_id") % 5, F.lit("}]} end"))
    rows = X.slim_pairs(spark, sf).select("pair_id", F.explode(P.importance(raw)).alias("x"))
    return rows.select("pair_id", "x.qid", "x.importance")


@query("x14_likert", "select pair_id, case pair_id % 6 when 0 then 4 when 1 then pair_id % 5 + 1 when 5 then case when pair_id % 10 between 1 and 5 then pair_id % 10 end end::integer as score from pairs")
def _(spark, sf):
    """The first score counts, by one digit; N/A, other digits and numbers without the word are none."""
    p = F.col("pair_id")
    forms = F.array(F.lit("Score: 45, Score: 2"), F.concat(F.lit("2 of 9 hold. SCORE:\n"), p % 5 + 1, F.lit(" of 9")), F.lit("Score: N/A because Score: 4"), F.lit("I give 4"), F.lit("score:na"), F.concat(F.lit("Score:"), p % 10))
    return X.slim_pairs(spark, sf).select("pair_id", P.likert(F.element_at(forms, (p % 6 + 1).cast("int"))).alias("score"))


@query("x15_verifier", "select pair_id, (['no', 'yes', 'yes', 'yes'])[pair_id % 4 + 1] as verdict from pairs")
def _(spark, sf):
    raw = F.element_at(F.array(*map(F.lit, ("No, it adds nothing", " YES", "maybe", "  "))), (F.col("pair_id") % 4 + 1).cast("int"))
    return X.slim_pairs(spark, sf).select("pair_id", P.verifier(raw).alias("verdict"))


@query("x17_prompt_questions", "select domain, cast(row_number() over (partition by domain order by qid) as integer) as q, trim(replace(question_text, chr(10), ' ')) as text from active")
def _(spark, sf):
    from pairlens.functions.text import question_block

    rows = X.active_bank(spark, sf).groupBy("domain").agg(F.transform(F.sort_array(F.collect_list(F.struct("qid", "dimension", F.col("question_text").alias("question")))), lambda x: F.struct(x["dimension"].alias("dimension"), F.translate(x["question"], "\n", " ").alias("question"))).alias("q"))
    found = rows.select("domain", F.explode(P.prompt_questions(question_block(F.col("q")))).alias("x"))
    return found.select("domain", "x.q", "x.text")


@query("x18_answer_differences", "select c.pair_id, n.q::integer as q, case when n.q % 9 = 0 then '—' else ans_a end as a, ans_b as b from answers c join numbered n on n.domain = c.domain and n.qid = c.qid where n.q % 9 = 0 or ans_a <> ans_b")
def _(spark, sf):
    from pairlens.operators.selection import local_numbers

    numbers = local_numbers(X.active_bank(spark, sf)).select("domain", "qid", "q")
    rows = X.answers(spark, sf).join(small_broadcast(numbers), ["domain", "qid"])
    maps = rows.groupBy("pair_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("q") % 9 != 0, F.struct("q", "ans_a")))).alias("a"), F.map_from_entries(F.collect_list(F.struct("q", "ans_b"))).alias("b"))
    return maps.select("pair_id", F.explode(P.answer_differences(F.col("a"), F.col("b"))).alias("x")).select("pair_id", "x.q", "x.a", "x.b")


@query("x19_answer_map", "select c.pair_id, qid as q, ans_a as answer from answers c where ans_a <> 'na'")
def _(spark, sf):
    rows = X.answers(spark, sf).groupBy("pair_id").agg(F.to_json(F.struct(F.collect_list(F.when(F.col("ans_a") != "na", F.struct(F.col("qid").alias("q"), F.col("ans_a").alias("answer")))).alias("answers"), F.collect_list(F.when(F.col("ans_a") == "na", F.struct(F.col("qid").alias("q")))).alias("na_answers"))).alias("json"))
    return rows.select("pair_id", F.explode(P.answer_map(F.col("json"))).alias("q", "answer"))


@query("x20_completion_text", "select conv_id, sha256(string_agg(text, chr(10) order by turn)) as h from conversations group by conv_id")
def _(spark, sf):
    return X.turns(spark, sf).select("conv_id", F.sha2(P.completion_text(F.lit(None).cast("string"), F.col("context_turns")), 256).alias("h"))


@query("x21_stage_numbers", ", r as (select pair_id, qid, row_number() over (partition by pair_id order by (qid * 7) % 11, qid) as rank from contrib) select pair_id, list(qid order by rank) as qids from r where rank in (1, 3, 5) group by pair_id")
def _(spark, sf):
    from .selection import ranking

    asked = ranking(spark, sf).filter("rank <= 6").groupBy("pair_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "qid"))), lambda x: x["qid"]).alias("asked"))
    return asked.select("pair_id", P.stage_numbers(F.array(*map(F.lit, (1, 3, 5, 9, 0))), F.col("asked")).alias("qids"))


@query("c3_policies_of_outputs", _LINES + "select pair_id, cast(side as integer) as side, case when n_na = 0 and n_yes + n_no = n then n_yes / n end as strict, case when n_yes + n_no > 0 and n_yes + n_no + n_na = n then n_yes / (n_yes + n_no) end as skip from parsed")
def _(spark, sf):
    from pairlens.operators.scoring import na_score

    p = P.parsed_checklist(X.raw_outputs(spark, sf), KEYS)
    c = F.col
    score = lambda policy: F.when(c("parse_ok"), na_score(policy, c("n_yes"), c("n_questions_parsed"), c("n_na"), c("n_questions_parsed"), c("complete"), c("complete_with_na"))).alias(policy)
    return p.select("pair_id", "side", score("strict"), score("skip"))

