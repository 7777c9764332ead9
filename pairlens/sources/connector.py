"""Calling a judge from Spark with a cache that lets a run resume."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CACHE = "request_key string, prompt_sha256 string, signature string, response string"


def prompt_hash(prompt: Column) -> Column:
    return F.sha2(prompt, 256)


def signature(**settings: object) -> str:
    """A digest of what, beside the prompt, decides a response; keys in order."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(settings, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def pending(requests: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Requests without a cached response."""
    return requests.join(cache.select(*keys).distinct(), keys, "left_anti")


def _delays(retries: int) -> Iterator[float]:
    return (min(30.0, 2.0 * 2**i) for i in range(retries))


class Slots:
    """Times at which calls of ``count`` tasks may start: every ``interval`` seconds one task's turn comes, in rounds.

    The tasks agree on the first time, so that no two calls are closer together than
    the interval, whichever tasks they belong to, as far as the machines' clocks agree.
    """

    def __init__(self, start: float, index: int, count: int, interval: float, sleep: Callable[[float], None] = time.sleep, now: Callable[[], float] = time.time):
        self.start, self.index, self.count, self.interval, self.sleep, self.now = start, index, count, interval, sleep, now
        self.turn = 0

    def wait(self) -> None:
        at = lambda: self.start + (self.turn * self.count + self.index) * self.interval
        if at() < self.now():  # turns that are over aren't made up for
            self.turn += int((self.now() - at()) / (self.count * self.interval)) + 1
        while (left := at() - self.now()) > 0:
            self.sleep(left)
        self.turn += 1


def called(requests: DataFrame, judge: Callable[[str], str], min_interval: float = 0.0, retries: int = 5, sleep: Callable[[float], None] = time.sleep, tasks: int | None = None) -> DataFrame:
    """request_key, prompt_sha256, signature, response of each request's prompt; null after the last retry.

    Calls are made on the executors, one at a time per task. With ``min_interval``,
    calls of all tasks together, retries too, are no closer together than that: the
    requests are dealt to ``tasks`` tasks that start together (barrier execution) and
    take turns. The cluster needs that many free cores.
    """

    def answers(prompts: Iterator[str | None], wait: Callable[[], None]) -> Iterator[str | None]:
        for prompt in prompts:
            answer = None
            for delay in [*_delays(retries), None] if prompt is not None else ():
                wait()
                try:
                    answer = judge(prompt)
                    break
                except Exception:
                    if delay is not None:
                        sleep(delay)
            yield answer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait = lambda: None
        if min_interval:
            from pyspark import BarrierTaskContext

            context = BarrierTaskContext.get()
            start = max(map(float, context.allGather(repr(time.time()))))
            wait = Slots(start, context.partitionId(), len(context.getTaskInfos()), min_interval).wait
        for batch in batches:
            out = list(answers(iter(batch.column(3).to_pylist()), wait))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.string())], names=["request_key", "prompt_sha256", "signature", "response"])

    rows = requests.select("request_key", prompt_hash(F.col("prompt")).alias("prompt_sha256"), "signature", "prompt")
    if not min_interval:
        return rows.mapInArrow(run, CACHE)
    return rows.repartition(tasks or 2).mapInArrow(run, CACHE, barrier=True)


def resumed(requests: DataFrame, cache: DataFrame, judge: Callable[[str], str], **options) -> tuple[DataFrame, DataFrame]:
    """(cached responses that apply, responses of the calls still to make); append the second to the cache and run again after a stop."""
    keyed = requests.withColumn("prompt_sha256", prompt_hash(F.col("prompt")))
    keys = ["request_key", "prompt_sha256", "signature"]
    once = cache.dropDuplicates(keys)
    return keyed.select(*keys).distinct().join(once, keys), called(pending(keyed, once, keys).dropDuplicates(keys), judge, **options)
