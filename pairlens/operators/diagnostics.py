"""Question and dimension statistics, drop rules and failure modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scoring import contribution


def generic_question(sub_aspect: Column, text: Column, aspects: tuple[str, ...], phrases: tuple[str, ...]) -> Column:
    return sub_aspect.isin(*aspects) | F.greatest(F.lit(0), *(F.lower(text).contains(p).cast("int") for p in phrases), F.lit(0)).cast("boolean")


def question_diagnostics(answers: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and rates of yes, no and na per key over both sides' answers; rows: keys, answer."""
    n = F.count(F.lit(1))
    count = lambda x: F.count_if(F.col("answer") == x)
    return answers.groupBy(*keys).agg(*(count(x).alias(f"n_{x}") for x in ("yes", "no", "na")), n.alias("n_total"), *((count(x) / n).alias(f"{x}_rate") for x in ("yes", "no", "na")))


def dimension_accuracy(facts: DataFrame, sample: list[str]) -> DataFrame:
    """Does a dimension alone predict the winner? Samples where a side answered none of its questions are skipped.

    facts: sample, winner, dimension, ans_a, ans_b; missing answers are null.
    """
    c = lambda cond: F.count_if(cond)
    a, b = F.col("ans_a"), F.col("ans_b")
    per = facts.groupBy(*sample, "winner", "dimension").agg(
        c(a == "yes").alias("ya"), c(b == "yes").alias("yb"), c(a.isin("yes", "no")).alias("na"), c(b.isin("yes", "no")).alias("nb"), (c(a == "na") + c(b == "na")).alias("nn")
    ).filter("na > 0 and nb > 0")
    sa, sb = F.col("ya") / F.col("na"), F.col("yb") / F.col("nb")
    said = F.when(sa > sb, "A").when(sb > sa, "B").otherwise("Tie")
    right = F.col("winner").isin("A", "B") & (said == F.col("winner"))
    return per.groupBy("dimension").agg(F.count(F.lit(1)).alias("n_samples"), F.avg(sa).alias("avg_score_a"), F.avg(sb).alias("avg_score_b"), F.avg(right.cast("double")).alias("dimension_accuracy"), (F.sum("nn") / F.sum(F.col("na") + F.col("nb") + F.col("nn"))).alias("avg_na_rate"))


def collapsed(diagnostics: DataFrame) -> DataFrame:
    """Per (dimension, question_text): sums over domains, the domains seen, rates; null rates where nothing was counted."""
    s = {x: F.sum(f"n_{x}") for x in ("yes", "no", "na")}
    g = diagnostics.groupBy("dimension", "question_text").agg(*(v.alias(f"n_{x}") for x, v in s.items()), F.array_join(F.sort_array(F.collect_set("domain")), ",").alias("domains_seen"))
    answered = F.col("n_yes") + F.col("n_no")
    return g.withColumn("n_effective_nonna", answered).withColumn("yes_rate_nonna", F.try_divide(F.col("n_yes"), answered)).withColumn("na_rate", F.try_divide(F.col("n_na"), answered + F.col("n_na")))


def label_correlation(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: of the items that both sides answered differently, how many vote for the gold winner."""
    a, b, w = F.col("ans_a"), F.col("ans_b"), F.col("winner")
    rows = facts.filter(w.isin("A", "B") & a.isin("yes", "no") & b.isin("yes", "no") & (a != b))
    right = F.when(a == "yes", "A").otherwise("B") == w
    return rows.groupBy(*keys).agg(F.avg(right.cast("double")).alias("agree_rate"), F.count(F.lit(1)).alias("n_effective_corr"))


DROPS = ("saturated_yes", "saturated_no", "low_signal")


def drop_rules(df: DataFrame, yes_high: float = 0.95, yes_low: float = 0.05, signal: float = 0.05, signal_n: int = 20, rare_na: float = 0.8, sat_n: int = 30) -> DataFrame:
    """Adds drop_reasons and drop. Too few answers and being rarely applicable are told but never drop a question."""
    enough = F.coalesce(F.col("n_effective_nonna"), F.lit(0)) >= sat_n
    rate, na = F.col("yes_rate_nonna"), F.col("na_rate")
    weak = (F.coalesce(F.col("n_effective_corr"), F.lit(0)) >= signal_n) & (F.abs(F.col("agree_rate") - 0.5) < signal)
    reasons = F.array_compact(F.array(
        F.when(enough & (rate > yes_high), "saturated_yes"), F.when(enough & (rate < yes_low), "saturated_no"), F.when(~enough, "tiny_effective_n"), F.when(weak, "low_signal"), F.when(na > rare_na, "rarely_applicable"),
    ))
    return df.withColumn("drop_reasons", reasons).withColumn("drop", F.arrays_overlap("drop_reasons", F.array(*map(F.lit, DROPS))))


def bank_summary(df: DataFrame) -> DataFrame:
    """Per dimension: questions before and after dropping, mean na rate before and after."""
    return df.groupBy("dimension").agg(F.count(F.lit(1)).alias("n_before"), F.count_if(~F.col("drop")).alias("n_after"), F.avg("na_rate").alias("na_before"), F.avg(F.when(~F.col("drop"), F.col("na_rate"))).alias("na_after"))


def sample_statistics(facts: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """Per sample: how its questions were answered and what they contributed.

    facts: keys, qid, ans_a, ans_b, w (null where a question has no weight), generic. A
    question is nonzero if one side says yes, the other no, and it has a weight. ``more``
    aggregates come from the same pass.
    """
    a, b, w = F.col("ans_a"), F.col("ans_b"), F.col("w")
    differ = a.isin("yes", "no") & b.isin("yes", "no") & (a != b)
    nonzero = differ & w.isNotNull()
    c = F.when(nonzero, contribution(a, b) * w)
    biggest = F.max(F.when(nonzero, F.struct(F.abs(c).alias("size"), (-F.col("qid")).alias("first"), c.alias("c"))))
    n = F.count(F.lit(1))
    out = facts.groupBy(*keys).agg(
        n.alias("n_selected"), F.count_if((a == "yes") & (b == "yes")).alias("n_yes_yes"), F.count_if((a == "no") & (b == "no")).alias("n_no_no"), F.count_if((a == "na") | (b == "na")).alias("n_any_na"), F.count_if(differ).alias("n_diff"),
        F.count_if(nonzero).alias("n_nonzero"), (F.count_if(nonzero) / n).alias("nonzero_rate"), F.coalesce(F.sum(F.when(c > 0, c)), F.lit(0.0)).alias("support_a"), F.coalesce(F.sum(F.when(c < 0, -c)), F.lit(0.0)).alias("support_b"),
        F.count_if("generic").alias("n_generic"), F.count_if(F.col("generic") & (a == "yes") & (b == "yes")).alias("n_yes_yes_generic"), F.coalesce(F.max(F.when(nonzero, w)), F.lit(0.0)).alias("max_nonzero_weight"), biggest.alias("_b"), *more,
    )
    return out.withColumn("max_qid", (-F.col("_b.first")).cast("int")).withColumn("max_contribution", F.col("_b.c")).drop("_b")


def failure_modes(low_nonzero: float = 0.2, low_weight: float = 0.3, small_margin: float = 0.05) -> Column:
    """Tags of a sample: see the conditions. Needs sample_statistics, margin, winner, predicted_winner, task, dimensions, scores, weak_reason."""
    c = F.col
    n = F.greatest(c("n_selected"), F.lit(1))
    generic = c("n_generic") / n
    category = F.when(c("predicted_winner") == "Tie", "tie").when(c("predicted_winner") == c("winner"), "correct").otherwise("wrong_winner")
    needed = F.when(c("task") == "creative", "clarity_and_communication").when(c("task") == "coding", "coding_communication_conditional")
    supported = F.when(c("max_contribution") > 0, "A").when(c("max_contribution") < 0, "B")
    nonzero_scores = F.filter(c("scores"), lambda s: s != 0)
    signs = F.array_distinct(F.transform(nonzero_scores, lambda s: F.signum(s.cast("double"))))
    tag = lambda cond, name: F.when(F.coalesce(cond, F.lit(False)), name)
    return F.array_compact(F.array(
        tag(((generic >= 0.5) & (c("nonzero_rate") < low_nonzero)) | ((generic >= 0.6) & (c("n_yes_yes_generic") >= 4)), "FM1_generic_non_discriminative"),
        tag(needed.isNotNull() & ~F.array_contains("dimensions", needed), "FM2_missing_task_specific_criteria"),
        tag(c("n_any_na") >= 5, "FM3_na_noise_or_bad_question_fit"),
        tag((c("n_diff") > 0) & (c("n_nonzero") > 0) & (c("max_nonzero_weight") < low_weight), "FM4_low_weight_on_discriminative_questions"),
        tag((category == "wrong_winner") & c("winner").isin("A", "B") & (supported != c("winner")), "FM5_wrong_direction_high_weight"),
        tag(c("weak_reason"), "FM6_human_reason_mismatch_or_annotation_noise"),
        tag(((c("n_yes_yes") + c("n_no_no")) / n >= 0.7) & c("n_diff").between(1, 3), "FM7_binary_checklist_insufficient"),
        tag((c("n_selected") > 0) & (c("n_diff") <= 2) & (c("nonzero_rate") < 0.2), "FM8_selector_relevance_vs_contrastiveness_gap"),
        tag((F.abs(c("margin")) < small_margin) & category.isin("tie", "wrong_winner"), "FM9_aggregation_threshold_or_tie_delta_issue"),
        tag((F.size(c("scores")) >= 2) & (F.size(nonzero_scores) >= 2) & (F.size(signs) > 1), "FM10_annotator_disagreement"),
        tag((F.size(nonzero_scores) >= 3) & (F.size(signs) == 1) & (F.array_max(F.transform(nonzero_scores, lambda s: F.abs(s))) <= 1), "FM10_weak_preference_strength"),
    ))


def mode_cooccurrence(tagged: DataFrame, key: str) -> DataFrame:
    """How often two tags meet in a sample, each pair once, by exploding a sample's own tags."""
    rows = tagged.select(key, F.explode("tags").alias("a"), "tags").select("a", F.explode("tags").alias("b"))
    return rows.filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def lowest_per_mode(tagged: DataFrame, key: str, by: str, n: int = 5) -> DataFrame:
    """The n samples of each tag with the lowest values."""
    rows = tagged.select(key, by, F.explode("tags").alias("tag"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("tag").orderBy(by, key))).filter(F.col("place") <= n)


def question_frequencies(facts: DataFrame, bank: DataFrame) -> DataFrame:
    """Per bank question: how often selected, different, nonzero, supporting a side, na; its weights. Questions never selected have zeros."""
    a, b, w = F.col("ans_a"), F.col("ans_b"), F.col("w")
    differ = a.isin("yes", "no") & b.isin("yes", "no") & (a != b)
    g = facts.groupBy("qid").agg(
        F.count(F.lit(1)).alias("n_selected"), F.count_if(differ).alias("n_diff"), F.count_if(differ & w.isNotNull()).alias("n_nonzero"), F.count_if(differ & (a == "yes")).alias("n_support_a"), F.count_if(differ & (b == "yes")).alias("n_support_b"),
        F.count_if((a == "na") | (b == "na")).alias("n_na"), F.avg("w").alias("avg_weight"), F.percentile("w", F.lit(0.5)).alias("median_weight"), F.sum("w").alias("total_weight"),
    )
    counts = [c for c in g.columns if c.startswith("n_")]
    return bank.select("qid", "dimension", "sub_aspect").join(g, "qid", "left").select("qid", "dimension", "sub_aspect", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), "avg_weight", "median_weight", F.coalesce("total_weight", F.lit(0.0)).alias("total_weight"))


def with_share(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds a column's share of its total, for small summaries."""
    return df.withColumn(name, F.try_divide(F.col(column), F.sum(column).over(Window.partitionBy(F.lit(1)))))
