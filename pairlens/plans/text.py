"""Queries of the scalar text functions over documents, contexts and pairs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pairlens.functions import text as T
from pairlens.operators.windows import small_broadcast
from pairlens.sources import fixtures as X

from .registry import query


def contexts(spark, sf):
    return X.with_context(spark, sf, X.pairs(spark, sf)).withColumn("context", T.context_text(F.col("context_turns"))).drop("context_turns", "conv_id")


@query("p1_context_to_text", "select conv_id, sha256(context) as context_hash, length(context) as n_chars from contexts")
def _(spark, sf):
    c = X.turns(spark, sf).withColumn("context", T.context_text(F.col("context_turns")))
    return c.select("conv_id", F.sha2("context", 256).alias("context_hash"), F.length("context").cast("long").alias("n_chars"))


@query("p2_prompt_id", "select pair_id, substr(sha256(context), 1, 16) as prompt_id from paired")
def _(spark, sf):
    return contexts(spark, sf).select("pair_id", T.prompt_id(F.col("context")).alias("prompt_id"))


_ESCAPE = "'\"' || replace(replace(replace(replace(replace({0}, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't') || '\"'"


@query(
    "p3_sample_id",
    "select pair_id, substr(sha256(context), 1, 16) || '_' || substr(sha256('{\"domain\": ' || " + _ESCAPE.format("domain") + " || ', \"response_a\": ' || " + _ESCAPE.format("response_a") + " || ', \"response_b\": ' || " + _ESCAPE.format("response_b") + " || ', \"winner\": ' || " + _ESCAPE.format("winner") + " || '}'), 1, 16) as sample_id from paired",
)
def _(spark, sf):
    c = F.col
    return contexts(spark, sf).select("pair_id", T.sample_id(T.prompt_id(c("context")), domain=c("domain"), response_a=c("response_a"), response_b=c("response_b"), winner=c("winner")).alias("sample_id"))


@query(
    "p4_preferences",
    "select pair_id, case winner when 'A' then -preference_strength when 'B' then preference_strength else 0 end as preference, winner, abs(case winner when 'A' then -preference_strength when 'B' then preference_strength else 0 end) as strength from pairs",
)
def _(spark, sf):
    """P4, P5 and P6: signed preference, winner and strength from it."""
    p = X.slim_pairs(spark, sf).select("pair_id", T.signed_preference(F.col("winner"), F.col("preference_strength")).alias("preference"))
    return p.select("pair_id", "preference", T.winner_of_preference(F.col("preference")).alias("winner"), F.abs("preference").alias("strength"))


@query("p7_normal_domain", "select source, lower(trim('  ' || upper(source) || ' ')) as domain, count(*) as n from documents group by all")
def _(spark, sf):
    d = X.table(spark, sf, "documents")
    return d.groupBy("source", T.normal_domain(F.concat(F.lit("  "), F.upper("source"), F.lit(" "))).alias("domain")).agg(F.count(F.lit(1)).alias("n"))


@query("p8_swap_pair", "select pair_id, sha256(response_b) as a_hash, sha256(response_a) as b_hash, case winner when 'A' then 'B' when 'B' then 'A' else winner end as winner from pairs")
def _(spark, sf):
    from pairlens.operators.sampling import swapped

    s = swapped(X.pairs(spark, sf))
    return s.select("pair_id", F.sha2("response_a", 256).alias("a_hash"), F.sha2("response_b", 256).alias("b_hash"), "winner")


_REF = "'I prefer @Response A over response b; response 2 and RESPONSE 1, not responses. ' || text"


@query("p10_p11_references", f"select doc_id, replace(replace(replace(t, 'Response A', chr(1)), 'Response B', 'Response A'), chr(1), 'Response B') as swapped, regexp_replace(regexp_replace(t, '@?\\bresponse\\s*[1a]\\b', 'Response A', 'gi'), '@?\\bresponse\\s*[2b]\\b', 'Response B', 'gi') as standard from (select doc_id, {_REF} as t from documents)")
def _(spark, sf):
    t = F.concat(F.lit("I prefer @Response A over response b; response 2 and RESPONSE 1, not responses. "), F.col("text"))
    d = X.table(spark, sf, "documents").select("doc_id", t.alias("t"))
    return d.select("doc_id", T.swap_references(F.col("t")).alias("swapped"), T.standard_references(F.col("t")).alias("standard"))


@query("p12_normal_space", "select doc_id, sha256(trim(regexp_replace(regexp_replace(replace(replace(text, ' ', '  '), chr(10), chr(13) || chr(10) || chr(10) || chr(10)), chr(13) || chr(10) || '?', chr(10), 'g').regexp_replace('[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))) as h from documents")
def _(spark, sf):
    loose = F.replace(F.replace(F.col("text"), F.lit(" "), F.lit("  ")), F.lit("\n"), F.lit("\r\n\n\n"))
    return X.table(spark, sf, "documents").select("doc_id", F.sha2(T.normal_space(loose), 256).alias("h"))


@query("p15_joined_fragments", "select conv_id, sha256(string_agg(t, chr(10) order by turn)) as h from (select conv_id, trim(role) as t, min(turn) as turn from conversations group by all) group by conv_id")
def _(spark, sf):
    c = X.turns(spark, sf)
    return c.select("conv_id", F.sha2(T.joined_fragments(F.transform("context_turns", lambda t: F.concat(F.lit(" "), t["role"])), "\n"), 256).alias("h"))


@query("p16_token_lengths", "select doc_id, cast(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) as integer) as words, cast(greatest(1, ceil(strlen(text) / 4)) as integer) + 256 as tokens from documents")
def _(spark, sf):
    """P16, P17 and P18."""
    return X.table(spark, sf, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"), T.byte_tokens(F.col("text"), 256).alias("tokens"))


@query("p19_shortened", "select doc_id, case when length(text) > 50 then substr(text, 1, 50) || '…' else text end as head from documents")
def _(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", T.shortened(F.col("text"), 50).alias("head"))


#: cells that hold a pair's question numbers in some form, or none
_CELLS = ("' [' || ids || ']'", "'(' || ids || ')'", "'(' || pair_id || ',)'", "'[]'", "''", "'None'", "'[' || replace(ids, ', ', ',') || ',]'", "'[' || pair_id || '.9, -' || pair_id || '.9]'", "'questions ' || ids", "null", "'[' || pair_id || ', \"' || pair_id || '\"]'")
_CELL = f"case pair_id % {len(_CELLS)} " + " ".join(f"when {i} then {x}" for i, x in enumerate(_CELLS)) + " end"


@query("p20_int_lists", f", i as (select pair_id, list(qid order by qid) as q from answers where ans_a <> ans_b group by pair_id) select pair_id, case when pair_id % {len(_CELLS)} in (0, 1, 6) then q when pair_id % {len(_CELLS)} = 2 then [pair_id::integer] when pair_id % {len(_CELLS)} = 7 then [pair_id::integer, -pair_id::integer] when pair_id % {len(_CELLS)} = 10 then [pair_id::integer, pair_id::integer] else []::integer[] end as qids from i")
def _(spark, sf):
    rows = X.answers(spark, sf).filter("ans_a <> ans_b").groupBy("pair_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("qid")), lambda q: q.cast("string")), ", ").alias("ids"))
    return rows.select("pair_id", T.int_list(F.expr(_CELL)).alias("qids"))


@query("p21_comparative_question", "select qid, case when question_text like 'Does the response%' then 'Which response better' || substr(question_text, 18) when question_text like 'Is the response%' then 'Which response is more' || substr(question_text, 16) when question_text like 'Are %' then 'In which response are there better ' || substr(question_text, 5) else 'Comparing the two responses: ' || question_text end as question from (select qid, (['Does the response ', 'Is the response ', 'Are ', ''])[qid % 4 + 1] || question_text as question_text from bank)")
def _(spark, sf):
    b = X.bank(spark, sf).withColumn("question_text", F.concat(F.element_at(F.array(*map(F.lit, ("Does the response ", "Is the response ", "Are ", ""))), F.col("qid") % 4 + 1), "question_text"))
    return b.select("qid", T.comparative(F.col("question_text")).alias("question"))


#: Words of the test texts in the place of task keywords.
_GROUPS = {"licence": ("licensed", "rights reserved"), "stop": (" the ", " of "), "german": (" der ", " die "), "french": (" les ", " des ")}
_CASES = " ".join(f"when {' or '.join(f'contains(lower(text), {chr(39)}{w}{chr(39)})' for w in ws)} then '{n}'" for n, ws in _GROUPS.items())


@query("p22_task_type", f"select doc_id, case {_CASES} else 'general_explanation' end as task from documents")
def _(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", T.first_keyword(F.col("text"), _GROUPS, "general_explanation").alias("task"))


@query("p23_generic_question", "select qid, sub_aspect = 'aspect_0' or contains(lower(question_text), 'the') as generic from bank")
def _(spark, sf):
    from pairlens.operators.diagnostics import generic_question

    return X.bank(spark, sf).select("qid", generic_question(F.col("sub_aspect"), F.col("question_text"), ("aspect_0",), ("the",)).alias("generic"))


_BLOCK = """
, n as (select domain, dimension, question_text, qid, row_number() over (partition by domain order by qid) as q, min(qid) over (partition by domain, dimension) as first from active),
s as (select domain, dimension, any_value(first) as first, '## ' || dimension || chr(10) || string_agg('Q' || q || ': ' || question_text, chr(10) order by q) as t from n group by domain, dimension)
select domain, sha256(string_agg(t, chr(10) || chr(10) order by first)) as block_hash, cast(length(string_agg(t, chr(10) || chr(10) order by first)) as integer) as n_chars from s group by domain
"""


@query("p24_question_block", _BLOCK)
def _(spark, sf):
    rows = X.active_bank(spark, sf).groupBy("domain").agg(F.transform(F.sort_array(F.collect_list(F.struct("qid", "dimension", F.col("question_text").alias("question")))), lambda x: F.struct(x["dimension"].alias("dimension"), x["question"].alias("question"))).alias("questions"))
    block = T.question_block(F.col("questions"))
    return rows.select("domain", F.sha2(block, 256).alias("block_hash"), F.length(block).alias("n_chars"))


@query("p25_prompt_hash", "select pair_id, sha256('v1' || chr(10) || context || chr(10) || response_a || chr(10) || response_b) as prompt_sha256 from paired")
def _(spark, sf):
    return contexts(spark, sf).select("pair_id", F.sha2(F.concat_ws("\n", F.lit("v1"), "context", "response_a", "response_b"), 256).alias("prompt_sha256"))


@query("p31_latency_shares", "select event_type, event_id % 50 as stage, round(avg(value) / count(*), 9) as latency from events group by all")
def _(spark, sf):
    e = X.table(spark, sf, "events")
    return e.groupBy("event_type", (F.col("event_id") % 50).alias("stage")).agg(F.round(F.avg("value") / F.count(F.lit(1)), 9).alias("latency"))


@query(
    "p32_p33_run_names",
    ", n as (select source, lang || '/' || (['dev_600', 'test', 'train', 'dev', 'x'])[doc_id % 5 + 1] || '_' || source || '!metrics.json' as name from documents) "
    "select name, regexp_replace(name, '[^A-Za-z0-9_.-]+', '_', 'g') as safe, case when contains(name, 'dev_600') then 'dev_600' when regexp_matches(name, '(^|[_/.-])test([_/.-]|$)') then 'test' when contains(name, 'train') then 'train' when regexp_matches(name, '(^|[_/.-])dev([_/.-]|$)') then 'dev' else 'unknown' end as split, count(*) as n from n group by all",
)
def _(spark, sf):
    """P32, P33 and P34."""
    name = F.concat(F.col("lang"), F.lit("/"), F.element_at(F.array(*map(F.lit, ("dev_600", "test", "train", "dev", "x"))), (F.col("doc_id") % 5 + 1).cast("int")), F.lit("_"), F.col("source"), F.lit("!metrics.json"))
    rows = X.table(spark, sf, "documents").select(name.alias("name"))
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("n")).select("name", T.safe_name(F.col("name")).alias("safe"), T.split_of_name(F.col("name")).alias("split"), "n")


@query("p35_checklist_text", ", s as (select domain, dimension, '### ' || dimension || chr(10) || string_agg('- ' || question_text, chr(10) order by qid) as t from active group by domain, dimension) select domain, sha256(string_agg(t, chr(10) || chr(10) order by dimension)) as h from s group by domain")
def _(spark, sf):
    dims = X.active_bank(spark, sf).groupBy("domain", "dimension").agg(F.transform(F.sort_array(F.collect_list(F.struct("qid", "question_text"))), lambda x: x["question_text"]).alias("q"))
    return dims.groupBy("domain").agg(F.map_from_entries(F.collect_list(F.struct("dimension", "q"))).alias("m")).select("domain", F.sha2(T.checklist_text(F.col("m"), X.DIMENSIONS), 256).alias("h"))


@query(
    "p36_binary_target",
    ", l as (select c.pair_id, n.q, c.ans_a, count(*) over (partition by c.pair_id) as k, (select count(*) from active a where a.domain = c.domain) as n from gaps c join numbered n on n.domain = c.domain and n.qid = c.qid) "
    "select pair_id, case when any_value(k) = any_value(n) then sha256(string_agg('Q' || q || ': ' || case ans_a when 'yes' then 'yes' else 'no' end, chr(10) order by q)) end as h from l group by pair_id",
)
def _(spark, sf):
    from pairlens.operators.selection import local_numbers

    numbers = local_numbers(X.active_bank(spark, sf)).select("domain", "qid", "q", F.count(F.lit(1)).over(Window.partitionBy("domain")).cast("int").alias("n"))
    rows = X.with_gaps(X.answers(spark, sf)).join(small_broadcast(numbers), ["domain", "qid"])
    return rows.groupBy("pair_id").agg(F.map_from_entries(F.collect_list(F.struct("q", "ans_a"))).alias("m"), F.max("n").alias("n")).select("pair_id", F.sha2(T.binary_target(F.col("m"), F.col("n")), 256).alias("h"))


@query("p37_think_block", "select doc_id, '<think>' || chr(10) || 'notes ### Final ' || doc_id || chr(10) || '</think>' || chr(10) || chr(10) || '### Final' || chr(10) || 'Winner: A' as trace from documents")
def _(spark, sf):
    raw = F.concat(F.lit(" notes ### Final "), F.col("doc_id"), F.lit("\n### Final\nWinner: A"))
    return X.table(spark, sf, "documents").select("doc_id", T.with_think_block(raw).alias("trace"))


@query("p39_synthetic_answers", "select pair_id, qid, cast('0x' || substr(sha256(pair_id || ':' || qid || ':a'), 1, 7) as bigint) < 268435456 * (case when winner = 'A' then 0.65 + 0.05 * preference_strength else 0.35 - 0.05 * preference_strength end) as yes_a from answers")
def _(spark, sf):
    """A hash in the place of a random stream: the same share of yes, reproducible anywhere."""
    from pairlens.operators.sampling import hash_share

    p = F.when(F.col("winner") == "A", 0.65 + 0.05 * F.col("preference_strength")).otherwise(0.35 - 0.05 * F.col("preference_strength"))
    return X.answers(spark, sf).select("pair_id", "qid", (hash_share("pair_id", "qid", F.lit("a")) < p).alias("yes_a"))


@query("p40_side_label", "select pair_id, case when winner in ('A', 'Tie') then 'yes' else 'no' end as label_a, case when winner in ('B', 'Tie') then 'yes' else 'no' end as label_b from pairs")
def _(spark, sf):
    label = lambda s: F.when(F.col("winner").isin(s, "Tie"), "yes").otherwise("no")
    return X.slim_pairs(spark, sf).select("pair_id", label("A").alias("label_a"), label("B").alias("label_b"))
