"""Queries of batch jobs: requests packed into shards, and their states over several rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlens.operators import packing, shardjobs
from pairlens.sources import fixtures as X
from pairlens.sources.tables import scratch
from pairlens.sources.versions import Versions

from .registry import query


def _fold(name: str, rows: str, max_bytes: int, max_tokens: int) -> str:
    """SQL of the rule over rows (job, id, b, t): one request after the other."""
    full = f"f.b + n.b > {max_bytes} or f.t + n.t > {max_tokens}"
    return f"""
{name}_i as materialized (select *, row_number() over (partition by job order by id) as i from ({rows})),
{name} as (select job, id, i, b, t, 0 as shard from {name}_i where i = 1 union all
  select n.job, n.id, n.i, case when {full} then n.b else f.b + n.b end, case when {full} then n.t else f.t + n.t end, case when {full} then f.shard + 1 else f.shard end from {name} f join {name}_i n on n.job = f.job and n.i = f.i + 1)"""


@query("w20_shard_packing", "," + _fold("fold", "select domain as job, pair_id as id, ca + cb as b, ca // 4 + cb // 4 + 1024 + pair_id % 512 as t from pairs", 400_000, 130_000) + " select job as domain, id as pair_id, cast(shard as bigint) as shard from fold")
def _(spark, sf):
    """Requests of both responses, packed by bytes and by tokens with the output's allowance."""
    ca, cb = F.col("ca"), F.col("cb")
    rows = X.slim_pairs(spark, sf).select("domain", "pair_id", (ca + cb).alias("bytes"), (F.floor(ca / 4) + F.floor(cb / 4) + 1024 + F.col("pair_id") % 512).alias("tokens"))
    return packing.packed(rows, "domain", ["pair_id"], {"bytes": 400_000, "tokens": 130_000}).select("domain", "pair_id", "shard")


#: A job for each type of event; the budget of tokens shrinks from round to round.
MAX_BYTES, BUDGETS = 30_000, (20_000, 12_000, 7_000)


def requests(spark, sf):
    e, i = X.table(spark, sf, "events"), F.col("event_id")
    size = F.length("props") + 100 + F.col("user_id") % 50
    return e.select(F.col("event_type").alias("job"), i.alias("request_id"), size.cast("long").alias("bytes"), (F.ceil(size / 4) + 64 + i % 13 * 10).cast("long").alias("tokens"))


def reported(shards, turn: int):
    """What the receiver says in a round: most batches are completed, some fail, one job's later ones go on."""
    n = F.col("shard") * 7 + turn * 3
    status = F.when((turn == 1) & (F.col("job") == "view") & (F.col("shard") % 5 == 4), "in_progress").when(n % 11 == 5, "expired").when(n % 11 == 8, "failed").otherwise("completed")
    return shards.filter("status <> 'completed'").select("batch_id", status.alias("status"), F.lit(turn).alias("at"))


def _status(turn: int, before: str) -> str:
    going = "when job = 'view' and shard % 5 = 4 then 'in_progress'" if turn == 1 else ""
    return f"case when {before} = 'completed' then 'completed' {going} when (shard * 7 + {turn * 3}) % 11 = 5 then 'expired' when (shard * 7 + {turn * 3}) % 11 = 8 then 'failed' else 'completed' end"


def _rounds() -> str:
    out = ["with recursive ev as materialized (select event_type as job, event_id as id, cast(length(props) + 100 + user_id % 50 as bigint) as b, cast(ceil((length(props) + 100 + user_id % 50) / 4.0) + 64 + event_id % 13 * 10 as bigint) as t, props from events)"]
    out.append(_fold("f1", "select job, id, b, t from ev", MAX_BYTES, BUDGETS[0]))
    out.append(f"q1 as materialized (select job, id, cast(shard as bigint) as shard, 'prepared' as status, {BUDGETS[0]} as target from f1)")
    for turn in (1, 2, 3):
        out.append(f"p{turn} as materialized (select job, id, shard, {_status(turn, 'status')} as status, target from q{turn})")
        if turn == 3:
            break
        budget = BUDGETS[turn]
        out.append(f"d{turn} as materialized (select job, coalesce(min(shard) filter (where status <> 'completed'), max(shard) + 1) as done from p{turn} group by job)")
        out.append(f"j{turn} as materialized (select job, done from p{turn} join d{turn} using (job) where shard >= done group by job, done having not bool_or(status in ('validating', 'in_progress', 'finalizing', 'cancelling')) and max(target) > {budget})")
        out.append(_fold(f"f{turn + 1}", f"select ev.job, ev.id, b, t from ev join p{turn} p using (id) join j{turn} j on j.job = ev.job where p.shard >= j.done", MAX_BYTES, budget))
        out.append(
            f"q{turn + 1} as materialized (select p.job, id, shard, status, target from p{turn} p left join j{turn} j using (job) where j.done is null or shard < j.done "
            f"union all select f.job, id, f.shard + j.done, 'prepared', {budget} from f{turn + 1} f join j{turn} j using (job))"
        )
    out.append("z as (select 1)")
    return ",\n".join(out) + "\nselect p.job, p.id as request_id, p.shard, p.status, cast(p.target as bigint) as target_tokens, case when p.id % 17 = 0 then '' else ev.props end as text, p.id % 17 = 0 as missing from p3 p join ev using (id)"


def three_rounds(spark, sf, state: Versions):
    """Prepared, and then three times submitted, polled and resharded under the next budget."""
    shardjobs.prepare(state, requests(spark, sf), MAX_BYTES, BUDGETS[0])
    for turn in (1, 2, 3):
        shardjobs.submit(state, lambda job, shard, batch: "validating")
        shardjobs.poll(state, reported(state.read("shards"), turn))
        if turn < 3:
            shardjobs.reshard(state, MAX_BYTES, BUDGETS[turn])


@query("io16_shard_jobs", _rounds(), prelude=False)
def _(spark, sf):
    """Every request's shard, that shard's state after three rounds, and the output once the last batches are done."""
    state = Versions(spark, scratch(spark, "shard-jobs"))
    three_rounds(spark, sf, state)
    after = state.read("shards")
    shardjobs.poll(state, after.filter("status <> 'completed'").select("batch_id", F.lit("completed").alias("status"), F.lit(4).alias("at")))
    outputs = X.table(spark, sf, "events").filter("event_id % 17 <> 0").select(F.col("event_type").alias("job"), F.col("event_id").alias("request_id"), F.col("props").alias("text"))
    done = shardjobs.finalize(state, outputs)
    return done.join(after.select("job", "shard", "status", "target_tokens"), ["job", "shard"]).select("job", "request_id", "shard", "status", "target_tokens", "text", "missing")
