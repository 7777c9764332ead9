"""Preference-evaluation tables derived from the generic test tables by arithmetic.

Each table has a SQL twin in PRELUDE, a list of common table expressions over the
same Parquet tables; queries state their expected results on top of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.operators.windows import dealt, one_value, small_broadcast

#: The dimensions of the question bank; the second is asked in the code domain only.
DIMENSIONS = (
    "clarity_and_communication",
    "coding_communication_conditional",
    "correctness_and_completeness",
    "helpfulness_and_usefulness",
    "relevance_instruction_following",
)
DOMAINS = ("general", "stem", "code")
#: (domain, dimension) pairs that are active
ACTIVE = tuple((d, x) for d in DOMAINS for x in DIMENSIONS if d == "code" or x != DIMENSIONS[1])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(index: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, domain, response_a, response_b, ca, cb, winner, preference_strength: one shuffle on the pair."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars").join(labels, "doc_id", "left")
    score = F.coalesce("quality", F.lit(-1)) * 2 + F.col("n_chars") % 5
    even = F.col("doc_id") % 2 == 0
    side = lambda cond, c: F.max(F.when(cond, c))
    both = docs.groupBy(F.expr("doc_id div 2").alias("pair_id")).agg(
        side(even, F.col("text")).alias("response_a"), side(~even, F.col("text")).alias("response_b"),
        side(even, F.col("n_chars")).alias("ca"), side(~even, F.col("n_chars")).alias("cb"),
        side(even, score).alias("sa"), side(~even, score).alias("sb"),
    )
    winner = F.when(F.col("sa") > F.col("sb"), "A").when(F.col("sa") < F.col("sb"), "B").otherwise("Tie")
    return both.filter("sa is not null and sb is not null").select(
        "pair_id", _pick(F.col("pair_id") % 3, DOMAINS).alias("domain"), "response_a", "response_b", "ca", "cb", winner.alias("winner"), (2 + F.col("pair_id") % 2).cast("int").alias("preference_strength")
    )


def slim_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs without texts."""
    return pairs(spark, sf_dir).drop("response_a", "response_b")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, context_turns: array<struct<role, content>> in order of turn."""
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("context_turns"))


def with_context(spark: SparkSession, sf_dir: str, df: DataFrame) -> DataFrame:
    """Add context_turns: conversation pair_id modulo the number of conversations."""
    count = one_value(table(spark, sf_dir, "conversations").agg(F.max("conv_id") + 1))
    return df.withColumn("conv_id", F.col("pair_id") % count).join(turns(spark, sf_dir), "conv_id")


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, dimension, sub_aspect, question_text: one question per benchmark item."""
    items = table(spark, sf_dir, "benchmark")
    return items.select(
        (F.col("item_id") + 1).cast("int").alias("qid"),
        _pick(F.col("item_id") % 5, DIMENSIONS).alias("dimension"),
        F.concat(F.lit("aspect_"), (F.col("item_id") % 7).cast("string")).alias("sub_aspect"),
        F.col("text").alias("question_text"),
    )


def domain_dimensions(spark: SparkSession) -> DataFrame:
    return spark.sql("select * from values " + ", ".join(map(str, ACTIVE)) + " as t (domain, dimension)")


def active_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bank once per domain in which a question is asked; a join on (domain, dimension)."""
    return bank(spark, sf_dir).join(F.broadcast(domain_dimensions(spark)), "dimension")


def _label(x: Column) -> Column:
    return F.when(x < 55, "yes").when(x < 88, "no").otherwise("na")


def most_facts(spark: SparkSession, sf_dir: str) -> int:
    """Pairs by questions, active or not: a bound on the facts, by which pairs are dealt."""
    return table(spark, sf_dir, "documents").count() // 2 * table(spark, sf_dir, "benchmark").count()


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, domain, winner, preference_strength, qid, dimension, sub_aspect, ans_a, ans_b: pairs by their active questions.

    The bank is a few hundred rows, whatever the number of pairs: the join
    broadcasts it and keeps the partitioning of the pairs, which are dealt so that
    the facts of a task, not its pairs, have a bound.
    """
    facts = dealt(slim_pairs(spark, sf_dir), ["pair_id"], most_facts(spark, sf_dir)).join(small_broadcast(active_bank(spark, sf_dir).select("domain", "qid", "dimension", "sub_aspect")), "domain")
    q = F.col("qid").cast("long")
    side = lambda c, square, step, other: (F.col(c) * q + q * q * square + F.col("pair_id") * step) % 97 + F.when(F.col("winner") == other, 12).otherwise(0)
    return facts.select("pair_id", "domain", "winner", "preference_strength", "qid", "dimension", "sub_aspect", _label(side("ca", 13, 7, "B")).alias("ans_a"), _label(side("cb", 17, 11, "A")).alias("ans_b"))


def weight() -> Column:
    """The weight of a fact: exact binary fractions; every sixth question has none."""
    return F.when(F.col("qid") % 6 != 0, (1 + (F.col("pair_id") + F.col("qid")) % 5) / 8)


def weights(facts: DataFrame) -> DataFrame:
    """pair_id, qid, w of facts that have a weight."""
    return facts.select("pair_id", "qid", weight().alias("w")).filter("w is not null")


def with_gaps(facts: DataFrame) -> DataFrame:
    """Facts of judges that leave some questions unanswered."""
    return facts.filter(F.col("qid") % 11 != F.col("pair_id") % 3)


def raw_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, domain, side (0, 1), n, raw: answers as a judge's text in local question order, with eleven kinds of defects.

    A pair's facts are gathered and put in order once for both of its sides.
    """
    from pairlens.operators.selection import local_numbers

    numbers = local_numbers(active_bank(spark, sf_dir)).select("domain", "qid", "q")
    rows = answers(spark, sf_dir).join(small_broadcast(numbers), ["domain", "qid"])
    kind_of = lambda side: ((F.col("pair_id") + side) % 11).cast("int")
    no = F.concat(F.lit("Q"), F.col("q").cast("string"), F.lit(": "))

    def line(x: Column, kind: Column) -> Column:
        plain = F.concat(no, F.when(x == "na", "N/A").otherwise(x))
        return (
            F.when(kind == 4, F.when(x == "na", "N/A").otherwise(x))
            .when(kind == 5, F.concat(no, F.when(x == "na", "not applicable.").otherwise(x)))
            .when((kind == 7) & (F.col("q") == 4), "Let me explain this one.")
            .when(kind == 9, F.concat(no, F.lit("NA")))
            .when(kind == 10, F.concat(F.lit("q"), F.col("q").cast("string"), F.lit(":"), F.upper(x)))
            .otherwise(plain)
        )

    def output(side: int, lines: Column) -> Column:
        kind = kind_of(side)
        head = F.when(kind == 2, "Q1: no\n").when(kind == 3, "Q999: yes\n").when(kind == 6, "Here are my answers\n").otherwise("")
        body = F.when(kind == 1, F.array_join(lines, "\n\n")).when(kind == 10, F.array_join(lines, "\r\n")).otherwise(F.array_join(lines, "\n"))
        return F.struct(F.lit(side).alias("side"), F.size(lines).alias("n"), F.when(kind == 8, "").otherwise(F.concat(head, body)).alias("raw"))

    sides = [line(F.col(f"ans_{s}"), kind_of(i)).alias(s) for i, s in enumerate("ab")]
    lines = rows.select("pair_id", "domain", F.struct("q", *sides).alias("line")).groupBy("pair_id", "domain").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    return lines.select("pair_id", "domain", F.inline(F.array(*(output(i, F.col("lines")[s]) for i, s in enumerate("ab")))))


PRELUDE = f"""
lab as (select doc_id, max(quality) as quality from labels group by doc_id),
pd as (select d.doc_id, d.text, d.n_chars, coalesce(l.quality, -1) * 2 + d.n_chars % 5 as s from documents d left join lab l using (doc_id)),
pairs as (select a.doc_id // 2 as pair_id, (['general', 'stem', 'code'])[(a.doc_id // 2) % 3 + 1] as domain, a.text as response_a, b.text as response_b, a.n_chars as ca, b.n_chars as cb,
  case when a.s > b.s then 'A' when a.s < b.s then 'B' else 'Tie' end as winner, cast(2 + (a.doc_id // 2) % 2 as integer) as preference_strength
  from pd a join pd b on a.doc_id % 2 = 0 and b.doc_id = a.doc_id + 1),
contexts as (select conv_id, string_agg('[' || role || ']' || chr(10) || text, chr(10) || chr(10) order by turn) as context from conversations group by conv_id),
paired as (select p.*, c.context from pairs p join contexts c on c.conv_id = p.pair_id % (select max(conv_id) + 1 from conversations)),
bank as (select cast(item_id + 1 as integer) as qid, ({list(DIMENSIONS)})[item_id % 5 + 1] as dimension, 'aspect_' || (item_id % 7) as sub_aspect, text as question_text from benchmark),
domains as (select unnest(['general', 'stem', 'code']) as domain),
active as (select d.domain, b.* from bank b join domains d on b.dimension <> '{DIMENSIONS[1]}' or d.domain = 'code'),
xs as (select p.pair_id, p.domain, p.winner, p.preference_strength, a.qid, a.dimension, a.sub_aspect,
  (p.ca * a.qid + a.qid * a.qid * 13 + p.pair_id * 7) % 97 + (case when p.winner = 'B' then 12 else 0 end) as xa,
  (p.cb * a.qid + a.qid * a.qid * 17 + p.pair_id * 11) % 97 + (case when p.winner = 'A' then 12 else 0 end) as xb
  from pairs p join active a using (domain)),
answers as (select pair_id, domain, winner, preference_strength, qid, dimension, sub_aspect,
  case when xa < 55 then 'yes' when xa < 88 then 'no' else 'na' end as ans_a, case when xb < 55 then 'yes' when xb < 88 then 'no' else 'na' end as ans_b from xs),
contrib as (select *, case when ans_a = 'yes' and ans_b = 'no' then 1.0::double when ans_a = 'no' and ans_b = 'yes' then -1.0::double when ans_a = 'yes' and ans_b = 'na' then 0.5::double
  when ans_a = 'na' and ans_b = 'yes' then -0.5::double else 0.0::double end as c from answers),
weights as (select pair_id, qid, (1 + (pair_id + qid) % 5) / 8.0::double as w from contrib where qid % 6 <> 0),
margins as (select pair_id, domain, winner, preference_strength, sum(c) / count(*) as margin, count(*) filter (where ans_a <> 'na' and ans_b <> 'na') as n_aligned, count(*) as n_questions from contrib group by all),
preds as (select *, case when margin > 0.05 then 'A' when margin < -0.05 then 'B' else 'Tie' end as predicted_winner from margins),
gaps as (select * from contrib where qid % 11 <> pair_id % 3),
numbered as (select domain, qid, row_number() over (partition by domain order by qid) as q from active),
long as (select pair_id, domain, 0 as side, qid, ans_a as x from answers union all select pair_id, domain, 1, qid, ans_b from answers),
lines as (select l.pair_id, l.domain, l.side, n.q, (l.pair_id + l.side) % 11 as kind, x, 'Q' || n.q || ': ' as no from long l join numbered n on l.domain = n.domain and l.qid = n.qid),
outputs as (select pair_id, domain, side, cast(count(*) as integer) as n, case any_value(kind) when 8 then '' else (case any_value(kind) when 2 then 'Q1: no' || chr(10) when 3 then 'Q999: yes' || chr(10) when 6 then 'Here are my answers' || chr(10) else '' end) ||
  replace(string_agg(case when kind = 4 then case x when 'na' then 'N/A' else x end when kind = 5 then no || case x when 'na' then 'not applicable.' else x end when kind = 7 and q = 4 then 'Let me explain this one.'
    when kind = 9 then no || 'NA' when kind = 10 then 'q' || q || ':' || upper(x) else no || case x when 'na' then 'N/A' else x end end,
    chr(1) order by q), chr(1), case kind when 1 then chr(10) || chr(10) when 10 then chr(13) || chr(10) else chr(10) end) end as raw from lines group by pair_id, domain, side, kind),
judged as (select * replace (case when pair_id % 13 = 0 then null else predicted_winner end as predicted_winner) from preds)
"""
