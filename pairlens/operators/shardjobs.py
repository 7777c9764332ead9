"""Batch jobs over shards of requests: prepared, submitted, polled, resharded behind what is done, finalized.

Two tables change together (``Versions``): ``requests`` with the shard of each
request, and ``shards`` with its status, batch and totals. Every step reads the
last version and commits the next one, so that a step that stops anywhere leaves
the version before and can be run again.

A shard's batch id comes from what it holds. A submission that is repeated after a
stop sends the same id, by which the receiver knows it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.sources.tables import staged
from pairlens.sources.versions import Versions

from .packing import packed

#: The states of a batch.
PREPARED, COMPLETED = "prepared", "completed"
ACTIVE = ("validating", "in_progress", "finalizing", "cancelling")
FAILED = ("failed", "expired", "cancelled")


class NotCompleted(RuntimeError):
    """A result was asked for while shards are pending or have failed."""


def _shards(requests: DataFrame, target: int) -> DataFrame:
    g = requests.groupBy("job", "shard").agg(F.count(F.lit(1)).alias("n_requests"), F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.min("request_id").alias("first_id"), F.max("request_id").alias("last_id"))
    return g.select("job", "shard", F.lit(PREPARED).alias("status"), F.lit(None).cast("string").alias("batch_id"), "n_requests", "bytes", "tokens", "first_id", "last_id", F.lit(target).cast("long").alias("target_tokens"))


def _dealt(requests: DataFrame, max_bytes: int, max_tokens: int) -> DataFrame:
    return packed(requests, "job", ["request_id"], {"bytes": max_bytes, "tokens": max_tokens}).select("job", "request_id", "bytes", "tokens", "shard")


def prepare(state: Versions, requests: DataFrame, max_bytes: int, max_tokens: int) -> int:
    """Pack (job, request_id, bytes, tokens) in order of request_id into shards; a state that exists stays. Gives the version."""
    now = state.version()
    if now is not None:
        return now
    dealt = staged(_dealt(requests, max_bytes, max_tokens), "dealt")
    return state.commit({"requests": dealt, "shards": _shards(dealt, max_tokens)}, None)


def submit(state: Versions, send: Callable[[str, int, str], str]) -> int:
    """Send each shard that has no batch yet: ``send(job, shard, batch_id)`` gives its status. Calls run in tasks, one a shard."""
    now = state.version()
    shards = state.read("shards", now)
    key = F.sha2(F.concat_ws("|", "job", "shard", "first_id", "last_id", "n_requests", "target_tokens"), 256)
    todo = shards.filter("batch_id is null").withColumn("batch_id", F.substring(key, 1, 24))

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(status=[send(*x) for x in zip(frame["job"], frame["shard"].tolist(), frame["batch_id"], strict=True)])

    sent = todo.mapInPandas(call, todo.schema)
    return state.commit({"shards": shards.filter("batch_id is not null").unionByName(sent)}, now)


def poll(state: Versions, statuses: DataFrame) -> int:
    """Take the reported (batch_id, status, at), the last report of each; batches that aren't reported, and reports of unknown ones, change nothing."""
    now = state.version()
    known = statuses.groupBy("batch_id").agg(F.max_by("status", "at").alias("_status"))
    shards = state.read("shards", now).join(known, "batch_id", "left")
    kept = shards.withColumn("status", F.coalesce("_status", "status")).drop("_status")
    return state.commit({"shards": kept.select(*state.read("shards", now).columns)}, now)


def completed_prefix(shards: DataFrame) -> DataFrame:
    """job, done: how many shards from the first on are completed."""
    open_at = F.min(F.when(F.col("status") != COMPLETED, F.col("shard")))
    return shards.groupBy("job").agg(F.coalesce(open_at, F.max("shard") + 1).alias("done"))


def reshard(state: Versions, max_bytes: int, max_tokens: int) -> int:
    """Pack what lies behind each job's completed prefix anew under a smaller budget of tokens.

    Jobs with an active shard behind the prefix wait, as do those whose shards
    already keep to the budget. Shards of the prefix keep their numbers and requests.
    """
    now = state.version()
    requests, shards = state.read("requests", now), state.read("shards", now)
    prefix = completed_prefix(shards)
    behind = shards.join(prefix, "job").filter("shard >= done")
    waits = behind.groupBy("job").agg(F.max(F.col("status").isin(*ACTIVE)).alias("active"), F.max("target_tokens").alias("target"))
    jobs = waits.filter(~F.col("active") & (F.col("target") > max_tokens)).join(prefix, "job").select("job", "done")
    todo = requests.join(jobs, "job").filter("shard >= done")
    again = _dealt(todo, max_bytes, max_tokens).join(jobs, "job").withColumn("shard", F.col("shard") + F.col("done"))
    again = staged(again.select(*requests.columns), "again")
    marked = requests.join(jobs, "job", "left")
    stay = marked.filter("done is null or shard < done").select(*requests.columns)
    kept = shards.join(jobs, "job", "left").filter("done is null or shard < done").select(*shards.columns)
    return state.commit({"requests": stay.unionByName(again), "shards": kept.unionByName(_shards(again, max_tokens))}, now)


def summary(state: Versions) -> DataFrame:
    """Per job: shards, completed prefix, shards by kind of status, requests, and the last budget."""
    shards = state.read("shards")
    counts = shards.groupBy("job").agg(
        F.count(F.lit(1)).alias("n_shards"), F.count_if(F.col("status") == COMPLETED).alias("n_completed"), F.count_if(F.col("status").isin(*FAILED)).alias("n_failed"), F.count_if(F.col("status").isin(*ACTIVE)).alias("n_active"),
        F.sum("n_requests").alias("n_requests"), F.min("target_tokens").alias("target_tokens"),
    )
    return counts.join(completed_prefix(shards).select("job", "done"), "job")


def finalize(state: Versions, outputs: DataFrame) -> DataFrame:
    """job, request_id, shard, text, missing: the output of every request, empty where there is none.

    Raises NotCompleted unless all shards are completed, ValueError where a request
    has two outputs. Outputs of unknown requests are left out.
    """
    left = state.read("shards").filter(F.col("status") != COMPLETED).limit(1).collect()
    if left:
        raise NotCompleted(f"shard {left[0].shard} of {left[0].job} is {left[0].status}")
    twice = outputs.groupBy("job", "request_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"request {twice[0].request_id} of {twice[0].job} has {twice[0].n} outputs")
    joined = state.read("requests").join(outputs.select("job", "request_id", "text", F.lit(True).alias("_here")), ["job", "request_id"], "left")
    return joined.select("job", "request_id", "shard", F.trim(F.coalesce("text", F.lit(""))).alias("text"), F.col("_here").isNull().alias("missing"))
