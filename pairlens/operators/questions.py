"""Which questions a domain asks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import one_value


def active_questions(domains: DataFrame, bank: DataFrame, dimensions: DataFrame) -> DataFrame:
    """domain, qid: the questions of a domain's dimensions; the whole bank for a domain without any.

    ``dimensions`` has (domain, dimension) pairs; names match in any case. All three
    tables are configuration: a few domains, a few hundred questions.
    """
    named = dimensions.select("domain", F.lower("dimension").alias("d"))
    questions = bank.select("qid", F.lower("dimension").alias("d"))
    found = domains.select("domain").distinct().join(named, "domain").join(questions, "d").select("domain", "qid")
    rest = domains.select("domain").distinct().join(found.select("domain").distinct(), "domain", "left_anti")
    whole = one_value(bank.agg(F.sort_array(F.collect_list("qid"))))
    return found.unionByName(rest.select("domain", F.explode(whole).alias("qid")))


def expected_count(domains: DataFrame, bank: DataFrame, dimensions: DataFrame) -> DataFrame:
    """domain, n: as many questions as are active, without the fallback to the whole bank."""
    named = dimensions.select("domain", F.lower("dimension").alias("d"))
    counts = named.join(bank.select(F.lower("dimension").alias("d")), "d").groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    return domains.select("domain").distinct().join(counts, "domain", "left").select("domain", F.coalesce("n", F.lit(0)).alias("n"))
