"""Training sets from pairs, answers and traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.functions.parsers import answer_differences
from pairlens.functions.text import int_list, let, lines, strip, with_think_block


def target_validity(target: Column, n: Column) -> Column:
    """ok, or why a target's lines, blank ones aside, aren't exactly Q1..Qn in order with yes or no: the first reason that holds."""
    held = F.filter(lines(target), lambda x: strip(x) != "")
    number = lambda x: F.regexp_extract(x, r"(?i)^\s*Q([0-9]+):", 1)

    def wrong(x: Column, i: Column) -> Column:
        given = F.coalesce(number(x).try_cast("long").cast("string"), number(x))
        bad = ~x.rlike(r"(?i)^\s*Q[0-9]+:\s*(yes|no)\s*$")
        return F.when(bad, F.concat(F.lit("bad_line:'"), F.substring(x, 1, 60), F.lit("'"))).when(given != (i + 1).cast("string"), F.concat(F.lit("out_of_order(expected Q"), i + 1, F.lit(" got Q"), given, F.lit(")")))

    first = F.get(F.filter(F.transform(held, wrong), lambda x: x.isNotNull()), F.lit(0))
    count = F.concat(F.lit("line_count_mismatch("), F.size(held), F.lit("!="), n, F.lit(")"))
    return F.when(F.coalesce(strip(target), F.lit("")) == "", "empty_target").when(F.size(held) != n, count).otherwise(F.coalesce(first, F.lit("ok")))


def preference_triples(pairs: DataFrame, key: str, prompt: Column) -> DataFrame:
    """key, prompt, chosen, rejected; ties go."""
    a = F.col("winner") == "A"
    rows = pairs.filter(F.col("winner").isin("A", "B"))
    return rows.select(key, prompt.alias("prompt"), F.when(a, F.col("response_a")).otherwise(F.col("response_b")).alias("chosen"), F.when(a, F.col("response_b")).otherwise(F.col("response_a")).alias("rejected"))


def messages(prompt: Column, answer: Column) -> Column:
    """A chat of one question and its answer."""
    return F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content")), F.struct(F.lit("assistant").alias("role"), answer.alias("content")))


def final_only(pairs: DataFrame, key: str, prompt: Column) -> DataFrame:
    """key, messages whose answer is the winner alone; ties go."""
    rows = pairs.filter(F.col("winner").isin("A", "B"))
    return rows.select(key, messages(prompt, F.concat(F.lit("Winner: "), "winner")).alias("messages"))


def per_side(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """Two rows a pair: side and response."""
    sides = F.explode(F.array(F.struct(F.lit("A").alias("side"), F.col("response_a").alias("response")), F.struct(F.lit("B").alias("side"), F.col("response_b").alias("response"))))
    return pairs.select(*columns, sides.alias("s")).select(*columns, "s.side", "s.response")


def trace_status(parsed: Column, gold: Column) -> Column:
    """Why a trace is kept or not: parse_error, unmatched, no_winner, mismatch, kept."""
    return (
        F.when(parsed["parse_error"].isNotNull(), "parse_error").when(~parsed["matched"], "unmatched").when(parsed["winner"].isNull(), "no_winner").when(parsed["winner"] != gold, "mismatch").otherwise("kept")
    )


def trace_rows(traces: DataFrame, key: str, parsed: Column) -> DataFrame:
    """key, target of the traces that are kept, with their reasoning in a think block."""
    rows = traces.withColumn("_status", trace_status(parsed, F.col("winner")))
    return rows.filter("_status = 'kept'").select(key, with_think_block(F.col("raw")).alias("target"))


def wide(df: DataFrame, index: list[str], tag: str, value: str, tags: list[str]) -> DataFrame:
    """Long scalars as one column per tag; the tags are given, so that no pass looks for them."""
    return df.groupBy(*index).pivot(tag, tags).agg(F.avg(value))


#: What a reviewer can choose to see.
SHOWN = ("All", "Wrong predictions", "Correct predictions")


def review(results: DataFrame, show: str = "All", domain: str | None = None) -> DataFrame:
    """The rows of a results table that a reviewer asks for, with ``differences``: array<struct<q, a, b>> of the selected questions that the two sides answer differently.

    results: domain, winner, predicted_winner, answers_a and answers_b (maps from
    question to label), selected_qids (an array, or its text in a cell; all questions
    where it is null). A prediction that is null is a wrong one.
    """
    if show not in SHOWN:
        raise ValueError(f"{show} is none of {', '.join(SHOWN)}")
    right = F.coalesce(F.col("winner") == F.col("predicted_winner"), F.lit(False))
    rows = results if domain is None else results.filter(F.col("domain") == domain)
    rows = rows if show == "All" else rows.filter(right if show == "Correct predictions" else ~right)
    cell = F.col("selected_qids")
    chosen = int_list(cell) if rows.schema["selected_qids"].dataType.typeName() == "string" else cell
    found = answer_differences(F.col("answers_a"), F.col("answers_b"))
    kept = let(chosen, lambda ids: F.filter(found, lambda d: cell.isNull() | F.array_contains(ids, d["q"])))
    return rows.withColumn("differences", kept)


def latest_wide(df: DataFrame, tags: list[str]) -> DataFrame:
    """step, wall_time (its latest), and for each tag the value that was written last in the step, of equally late ones the first in its file; one pass."""
    late = F.struct(-F.col("wall_time"), F.col("file"), F.col("record"))
    of = lambda t: F.min_by("value", F.when(F.col("tag") == t, late)).alias(t)
    return df.groupBy("step").agg(F.max("wall_time").alias("wall_time"), *map(of, tags))


def json_lines(df: DataFrame, column: str = "line") -> DataFrame:
    """Each row as a JSON object."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(column))
