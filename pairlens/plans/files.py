"""Queries that write files and read them again."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlens.sources import bank as B
from pairlens.sources import connector as C
from pairlens.sources import fixtures as X
from pairlens.sources import tables as T

from .registry import query


@query("io1_split_scan", "select pair_id, winner from pairs where domain = 'stem'")
def _(spark, sf):
    """A split by name with its columns pruned and its filter pushed down."""
    root = T.scratch(spark, "splits")
    T.write_table(X.pairs(spark, sf), f"{root}/dev.parquet")
    return T.read_split(spark, root, "dev", columns=["pair_id", "winner", "domain"]).filter("domain = 'stem'").select("pair_id", "winner")


@query("io3_table_sink", "select domain, count(*) as n, sum(length(response_a))::bigint as chars from pairs group by domain")
def _(spark, sf):
    """A table written twice, partitioned: the second replaces the first."""
    path = T.scratch(spark, "predictions")
    pairs = X.pairs(spark, sf)
    for rows in (pairs.limit(3), pairs):
        T.write_table(rows.select("pair_id", "domain", "response_a"), path, ["domain"])
    return spark.read.parquet(path).groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("response_a")).alias("chars"))


@query("io4_metric_files", "select count(*) as n_total, count(*) filter (where winner = 'A') as n_a, 'é' as note from pairs")
def _(spark, sf):
    """A nested metric file over several lines."""
    path = T.scratch(spark, "metrics")
    pairs = X.slim_pairs(spark, sf).agg(F.count(F.lit(1)).alias("n_total"), F.count_if(F.col("winner") == "A").alias("n_a"))
    nested = F.struct("n_total", F.struct("n_a", F.lit("é").alias("note")).alias("per_winner"))
    pairs.select(F.to_json(nested, {"pretty": "true"})).coalesce(1).write.text(path)
    return T.read_metrics(spark, path).select("n_total", "per_winner.n_a", "per_winner.note")


@query("io6_csv_tables", "select qid, dimension, question_text || ', \"quoted\"' as question_text from bank")
def _(spark, sf):
    path = T.scratch(spark, "diagnostics")
    T.write_csv(X.bank(spark, sf).select("qid", "dimension", F.concat("question_text", F.lit(', "quoted"')).alias("question_text")), path)
    return T.read_csv(spark, path, "qid int, dimension string, question_text string")


def _nested(spark, sf):
    """file, dimension, definition, sub_aspects of the bank: a file per dimension, every question twice."""
    subs = X.bank(spark, sf).groupBy("dimension", "sub_aspect").agg(F.transform(F.sort_array(F.collect_list(F.struct("qid", "question_text"))), lambda x: x["question_text"]).alias("q"))
    subs = subs.select("dimension", F.struct(F.col("sub_aspect").alias("name"), F.concat("q", "q").alias("questions")).alias("sub"))
    return subs.groupBy(F.concat("dimension", F.lit(".yaml")).alias("file"), "dimension").agg(F.concat(F.lit("about "), "dimension").alias("definition"), F.sort_array(F.collect_list("sub")).alias("sub_aspects"))


@query("io7_flat_bank", ", q as (select dimension, sub_aspect, trim(question_text) as question_text, min(qid) as first from bank group by all) select cast(row_number() over (order by dimension || '.yaml', sub_aspect, first) as integer) as qid, dimension, sub_aspect, question_text, 'about ' || dimension as definition, dimension || '.yaml' as source_yaml from q where question_text <> ''")
def _(spark, sf):
    """A bank's files flattened: in order of files, sub-aspects and places, each text once in its sub-aspect."""
    return B.flat_bank(_nested(spark, sf))


@query("io8_structured_bank", "select dimension, sub_aspect, list(question_text order by qid) as questions, count(*) as original_count from bank group by dimension, sub_aspect")
def _(spark, sf):
    """A bank's files with their sub-aspects kept, written as documents and read by schema."""
    path = T.scratch(spark, "bank")
    rows = _nested(spark, sf).select("dimension", "definition", F.map_from_entries(F.transform("sub_aspects", lambda s: F.struct(s["name"], F.struct(F.slice(s["questions"], F.lit(1), (F.size(s["questions"]) / 2).cast("int")).alias("filtered_questions"), (F.size(s["questions"]) / 2).cast("int").alias("original_count"))))).alias("sub_aspects"))
    T.write_json_lines(rows, path)
    found = T.read_json_lines(spark, path, B.NESTED).select("dimension", F.explode("sub_aspects").alias("sub_aspect", "s"))
    return found.select("dimension", "sub_aspect", F.col("s.filtered_questions").alias("questions"), F.col("s.original_count").cast("long").alias("original_count"))


@query("io12_markdown_report", ", c as (select domain, count(*) as n from pairs group by domain), l as (select row_number() over (order by domain) as i, '| ' || domain || ' | ' || n || ' |' as line from c) select 0 as i, '## Pairs' as line union all select 2, '| domain | n |' union all select 3, '|---|---|' union all select 3 + i, line from l union all select 1, ''")
def _(spark, sf):
    counts = X.slim_pairs(spark, sf).groupBy("domain").agg(F.count(F.lit(1)).alias("n")).orderBy("domain")
    lines = T.markdown(counts, "Pairs").rstrip("\n").split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "i long, line string")


@query("io15_judge_calls", "select 'k' || pair_id as request_key, sha256('ask ' || pair_id) as prompt_sha256, case when pair_id % 7 = 0 then null else 'said ask ' || pair_id end as response from pairs")
def _(spark, sf):
    """A judge that fails on every seventh request: its response is null after the retries."""
    p = F.col("pair_id")
    requests = X.slim_pairs(spark, sf).select(F.concat(F.lit("k"), p.cast("string")).alias("request_key"), F.lit("s").alias("signature"), F.concat(F.lit("ask "), p.cast("string")).alias("prompt"))

    def judge(prompt: str) -> str:
        if int(prompt.split()[1]) % 7 == 0:
            raise TimeoutError(prompt)
        return f"said {prompt}"

    return C.called(requests, judge, retries=2, sleep=lambda seconds: None).select("request_key", "prompt_sha256", "response")


@query("io17_peek", "select '{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\"}' as row from documents order by doc_id limit 5")
def _(spark, sf):
    return spark.createDataFrame([(x,) for x in T.peek(X.table(spark, sf, "documents").select("doc_id", "lang").orderBy("doc_id"))], "row string")


@query("io10_hub_splits", "select doc_id, text, lang, case when doc_id % 5 = 0 then 'validation' else 'train' end as split from documents where doc_id % 5 <> 1 and lang <> 'xx'", prelude=False)
def _(spark, sf):
    """Two of three splits of a dataset in a hub's cache: the files of the third stay unread."""
    from pairlens.sources.hubcache import HubCache

    spark.dataSource.register(HubCache)
    path = T.scratch(spark, "hub-cache")
    docs = X.table(spark, sf, "documents").select("doc_id", "text", "lang")
    for split, rest in (("train", F.col("doc_id") % 5 > 1), ("validation", F.col("doc_id") % 5 == 0), ("test", F.col("doc_id") % 5 == 1)):
        docs.filter(rest).repartition(3, "doc_id").write.format("hub_cache").options(split=split, name="documents").mode("append").save(path)
    return spark.read.format("hub_cache").option("splits", "train,validation").load(path).filter("lang <> 'xx'")
