"""Judge outputs as they arrive: scored without state, with repeated requests dropped within a watermark.

An extension of the batch plans. A stream's micro-batches run the
same expressions, so that each output is parsed and scored once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.functions import parsers as P
from pairlens.functions import rewards as R

OUTPUTS = "request_key string, prompt_sha256 string, winner string, raw string, arrived timestamp"


def read_outputs(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(OUTPUTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def scored(outputs: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """request_key, prompt_sha256, winner, predicted_winner, parse_ok, format_score of each new output; a request counts once within the lateness."""
    once = outputs.withWatermark("arrived", lateness).dropDuplicatesWithinWatermark(["request_key", "prompt_sha256"])
    parsed = once.withColumn("t", P.trace(F.col("raw")))
    return parsed.select("request_key", "prompt_sha256", "winner", "arrived", F.coalesce("t.winner", P.vanilla_winner(F.coalesce("raw", F.lit("")))).alias("predicted_winner"), R.parse_ok(F.col("t")).alias("parse_ok"), R.format_score(F.col("t"), F.coalesce("raw", F.lit(""))).alias("format_score"))


def rates(scores: DataFrame, window: str = "10 minutes") -> DataFrame:
    """Outputs, parse rate and accuracy per window of arrival."""
    return scores.groupBy(F.window("arrived", window)).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("parse_ok").cast("double")).alias("parse_rate"), F.avg(F.coalesce(F.col("predicted_winner") == F.col("winner"), F.lit(False)).cast("double")).alias("accuracy"))
