"""Queries of splits, samples and perturbations."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlens.operators import sampling as G
from pairlens.sources import fixtures as X

from . import scoring as Q
from .registry import query


@query("s2_doubled", "select pair_id, winner, false as swap_flag from pairs union all select pair_id, case winner when 'A' then 'B' when 'B' then 'A' else winner end, true from pairs")
def _(spark, sf):
    return G.doubled(X.slim_pairs(spark, sf).withColumn("response_a", F.lit("")).withColumn("response_b", F.lit(""))).select("pair_id", "winner", "swap_flag")


@query("f3_unswapped", "select pair_id from pairs")
def _(spark, sf):
    return G.doubled(X.slim_pairs(spark, sf).withColumn("response_a", F.lit("")).withColumn("response_b", F.lit(""))).filter("not swap_flag").select("pair_id")


@query("s5_group_split", ", g as (select doc_id // 4 as g from documents group by 1), k as (select g, row_number() over (order by sha256('42:' || g), g) as r, count(*) over () as n from g) select d.doc_id, case when r <= floor(n * 0.1) then 'dev' else 'train' end as split from documents d join k on k.g = d.doc_id // 4")
def _(spark, sf):
    d = X.table(spark, sf, "documents").select("doc_id", F.expr("doc_id div 4").alias("g"))
    return G.group_split(d, "g", 0.1).select("doc_id", "split")


@query("s6_fixed_size", "select pair_id from pairs order by sha256('42:' || pair_id), pair_id limit 100")
def _(spark, sf):
    return G.fixed_size(X.slim_pairs(spark, sf), "pair_id", 100).select("pair_id")


_ALLOC = """
, st as (select domain, winner, count(*) as size from pairs group by all), q as (select *, size * 60 / sum(size) over () as q from st), f as (select *, floor(q) as take from q),
p as (select *, row_number() over (order by q - floor(q) desc, domain, winner) as i, 60 - sum(take) over () as missing from f),
al as (select domain, winner, size, cast(least(size, take + case when i <= missing then 1 else 0 end) as bigint) as take from p)
"""


@query("s7_allocation", _ALLOC + "select domain, winner, size, take from al")
def _(spark, sf):
    return G.allocation(X.slim_pairs(spark, sf), ["domain", "winner"], 60)


@query("s7_stratified_sample", _ALLOC + ", r as (select pair_id, take, row_number() over (partition by p.domain, p.winner order by sha256('42:' || pair_id)) as r from pairs p join al using (domain, winner)) select pair_id from r where r <= take")
def _(spark, sf):
    """S7, S8 and S9."""
    return G.stratified(X.slim_pairs(spark, sf), ["domain", "winner"], "pair_id", 60).select("pair_id")


@query("s10_review_sample", ", c as (select pair_id, case when predicted_winner is null then 'parse_failure' when predicted_winner = 'Tie' then 'tie' when predicted_winner = winner then 'correct' else 'wrong_winner' end as cat from judged), r as (select *, row_number() over (partition by cat order by sha256('42:' || pair_id)) as r from c) select pair_id, cat from r where cat = 'wrong_winner' and r <= 20 or cat = 'tie' and r <= 10 or cat = 'correct' and r <= 5")
def _(spark, sf):
    from pairlens.operators.scoring import error_category

    rows = Q.judged(spark, sf).select("pair_id", error_category(F.col("winner"), F.col("predicted_winner")).alias("cat"))
    return G.per_stratum(rows, "cat", {"wrong_winner": 20, "tie": 10, "correct": 5}, "pair_id").select("pair_id", "cat")


@query("s11_audit_sample", ", r as (select qid, row_number() over (partition by dimension order by sha256('42:' || qid)) as r, sha256('42:' || qid) as h from bank), p as (select *, row_number() over (order by (r > 2)::integer, h) as p from r) select qid, r > 2 as filled from p where p <= 15")
def _(spark, sf):
    return G.per_group_with_fill(X.bank(spark, sf), "dimension", "qid", 2, 15).select("qid", "filled")


@query("s12_swap_perturbation", "select pair_id, length(response_b) as na, length(response_a) as nb, case winner when 'A' then 'B' when 'B' then 'A' else winner end as winner from pairs")
def _(spark, sf):
    return G.swapped(X.pairs(spark, sf)).select("pair_id", F.length("response_a").cast("long").alias("na"), F.length("response_b").cast("long").alias("nb"), "winner")


@query("s13_verbose_perturbation", "select pair_id, winner, length(case when winner = 'B' then response_a || ' ' || response_a else response_a end) as na, length(case when winner = 'A' then response_b || ' ' || response_b else response_b end) as nb from pairs where winner <> 'Tie' and pair_id % 3 <> 0")
def _(spark, sf):
    loser = F.when(F.col("winner") == "A", F.col("response_b")).otherwise(F.col("response_a"))
    v = G.verbose(X.pairs(spark, sf), F.concat(loser, F.lit(" "), loser), F.when(F.col("pair_id") % 3 == 0, "yes").otherwise("no"))
    return v.select("pair_id", "winner", F.length("response_a").cast("long").alias("na"), F.length("response_b").cast("long").alias("nb"))


@query("s14_format_perturbation", ", t as (select *, floor(cast('0x' || substr(sha256('42:' || pair_id), 1, 7) as bigint) / 268435456.0::double * 4)::integer as template from pairs) select pair_id, template, length(response_a) + ([0, 9, 3, 8])[template + 1] as na from t")
def _(spark, sf):
    return G.reformatted(X.pairs(spark, sf), "pair_id").select("pair_id", "template", F.length("response_a").cast("long").alias("na"))


@query("s16_negative_samples", ", p as (select pair_id, qid, c <> 0 as pos, row_number() over (partition by pair_id, c <> 0 order by sha256('42:' || pair_id || ':' || qid)) as r, greatest(3, ceil(count(*) filter (where c <> 0) over (partition by pair_id) * 0.5)) as n from contrib) select pair_id, qid, pos from p where pos or r <= n")
def _(spark, sf):
    """S15 is s5_group_split with single rows as groups."""
    from pairlens.operators.scoring import contribution

    rows = X.answers(spark, sf).select("pair_id", "qid", (contribution(F.col("ans_a"), F.col("ans_b")) != 0).alias("pos"))
    return G.negatives(rows, ["pair_id"], "qid", F.col("pos"), 0.5, 3)
