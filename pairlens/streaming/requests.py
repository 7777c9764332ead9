"""Requests as they arrive: each is asked once, over restarts.

The state store holds which requests have been asked, the checkpoint which input
has been read, and the file sink lists the batches that are done, so that a run that
stops goes on where it was. A batch that stops between its calls and its commit is
asked again as a whole: what it had answered isn't in the sink.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pairlens.sources.connector import called

REQUESTS = "request_key string, signature string, prompt string"


def read_requests(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def answered(requests: DataFrame, judge: Callable[[str], str], **options) -> DataFrame:
    """request_key, prompt_sha256, signature, response of each request that no earlier batch and no other row of its own has asked."""
    return called(requests.dropDuplicates(["request_key", "signature", "prompt"]), judge, **options)


def run_available(rows: DataFrame, path: str, checkpoint: str) -> int:
    """Work off what is there, in batches, into Parquet files at ``path``; gives the number of batches of this run. Run again after a stop or when more has come."""
    query = rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return len([p for p in query.recentProgress if p["numInputRows"]])
