"""From answers to margins and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TIE_DELTA = 0.05
TAU_ESCALATE = 0.05
TAU_HARD = 0.03
N_MIN = 8


def contribution(a: Column, b: Column) -> Column:
    """What a question adds to the margin of A over B: 1 for yes against no, half for yes against na."""
    points = lambda x, y: F.when((x == "yes") & (y == "no"), 1.0).when((x == "yes") & (y == "na"), 0.5).otherwise(0.0)
    return points(a, b) - points(b, a)


def aligned(a: Column, b: Column) -> Column:
    """Both sides have an answer that isn't na."""
    return a.isin("yes", "no") & b.isin("yes", "no")


def winner_from_margin(margin: Column, delta: float | Column = TIE_DELTA) -> Column:
    """A-positive margins; strictly beyond the tie threshold. Null margins are ties."""
    return F.when(margin > delta, "A").when(margin < -F.lit(delta), "B").otherwise("Tie")


def winner_from_delta(delta: Column, tie: float | Column = TIE_DELTA) -> Column:
    """B-positive differences: score_b - score_a."""
    return F.when(delta > tie, "B").when(delta < -F.lit(tie), "A").otherwise("Tie")


def flipped(winner: Column) -> Column:
    """The winner seen with the responses exchanged; ties and nulls stay."""
    return F.when(winner == "A", "B").when(winner == "B", "A").otherwise(winner)


def error_category(gold: Column, predicted: Column) -> Column:
    return F.when(predicted.isNull(), "parse_failure").when(predicted == "Tie", "tie").when(predicted == gold, "correct").otherwise("wrong_winner")


def margins(facts: DataFrame, keys: list[str], expected: Column | None = None) -> DataFrame:
    """margin, n_aligned, n_questions per key: the mean contribution over all expected questions, missing ones as na.

    A margin over no expected questions is null.
    """
    a, b = F.col("ans_a"), F.col("ans_b")
    n = F.count(F.lit(1)) if expected is None else F.max(expected)
    return facts.groupBy(*keys).agg((F.sum(contribution(a, b)) / F.nullif(n, F.lit(0))).alias("margin"), F.count_if(aligned(a, b)).alias("n_aligned"), n.alias("n_questions"))


def with_margin(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Adds each key's margin to its facts; over facts that are partitioned by the keys, no shuffle."""
    whole = Window.partitionBy(*keys)
    return facts.withColumn("margin", F.sum(contribution(F.col("ans_a"), F.col("ans_b"))).over(whole) / F.count(F.lit(1)).over(whole))


def weighted_margins(facts: DataFrame, weights: DataFrame, keys: list[str], on: list[str], delta: float = TIE_DELTA) -> DataFrame:
    """sum(w c) / sum(w) over questions that have a weight; a tie where there is none or the sum isn't positive."""
    rows = facts.withColumn("c", contribution(F.col("ans_a"), F.col("ans_b"))).join(weights, on, "left")
    sums = rows.groupBy(*keys).agg(F.sum(F.col("w") * F.col("c")).alias("wc"), F.sum("w").alias("ws"), F.count("w").alias("n_weighted"))
    margin = F.when(F.col("ws") > 0, F.col("wc") / F.col("ws")).otherwise(0.0)
    return sums.select(*keys, margin.alias("margin"), "n_weighted", F.when(F.col("ws") > 0, winner_from_margin(margin, delta)).otherwise("Tie").alias("predicted_winner"))


def weighted_scores(facts: DataFrame, weights: DataFrame, keys: list[str], on: list[str]) -> DataFrame:
    """Weighted share of yes per side over one denominator."""
    rows = facts.join(weights, on)
    share = lambda c: F.sum(F.when(F.col(c) == "yes", F.col("w")).otherwise(0.0)) / F.sum("w")
    return rows.groupBy(*keys).agg(share("ans_a").alias("score_a"), share("ans_b").alias("score_b"))


def side_counts(facts: DataFrame, keys: list[str]) -> DataFrame:
    """n_yes, n_no, n_na of each side per key."""
    count = lambda side, label: F.count_if(F.col(f"ans_{side}") == label).alias(f"n_{label}_{side}")
    return facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("expected_n"), *(count(s, x) for s in "ab" for x in ("yes", "no", "na")))


def na_score(policy: str, n_yes: Column, n_answered: Column, n_na: Column, expected: Column, complete: Column, complete_with_na: Column, threshold: float = 0.8) -> Column:
    """A side's score under an na policy; null where the policy refuses it.

    strict: complete and without na; as_no: na counts as no; skip: na left out;
    partial: like skip, if enough of the expected questions are answered, or all
    are accounted for where the expected number is unknown.
    """
    share = F.when(n_answered > 0, n_yes / n_answered).otherwise(0.0)
    whole = complete | complete_with_na
    coverage = F.when(expected > 0, n_answered / expected)
    if policy == "strict":
        return F.when((n_na == 0) & complete, share)
    if policy == "as_no":
        return F.when(whole, F.when(n_answered + n_na > 0, n_yes / (n_answered + n_na)).otherwise(0.0))
    if policy == "skip":
        return F.when(whole, share)
    if policy == "partial":
        return F.when(F.coalesce(coverage >= threshold, whole), share)
    raise ValueError(f"no such na policy: {policy}")


def leave_one_out(facts: DataFrame, keys: list[str], delta: float = TIE_DELTA) -> DataFrame:
    """Adds contrib, margin_without, u3_decisive: does the verdict change without a question?"""
    whole = Window.partitionBy(*keys)
    rows = facts.withColumn("contrib", contribution(F.col("ans_a"), F.col("ans_b"))).withColumn("_sum", F.sum("contrib").over(whole)).withColumn("_n", F.count(F.lit(1)).over(whole))
    without = (F.col("_sum") - F.col("contrib")) / F.greatest(F.col("_n") - 1, F.lit(1))
    rows = rows.withColumn("margin_without", without)
    decisive = winner_from_margin(F.col("margin_without"), delta) != winner_from_margin(F.col("_sum") / F.col("_n"), delta)
    return rows.withColumn("u3_decisive", decisive.cast("double")).drop("_sum", "_n")


def utilities(facts: DataFrame, keys: list[str], parse_fail: Column | None = None, delta: float = TIE_DELTA) -> DataFrame:
    """u1 answerable on a side, u2 size of the contribution, u3 decisive; all null where a side failed to parse."""
    failed = F.lit(False) if parse_fail is None else parse_fail
    rows = leave_one_out(facts, keys, delta)
    a, b = F.col("ans_a"), F.col("ans_b")
    return rows.select(
        *facts.columns,
        failed.alias("parse_fail"),
        F.when(~failed, F.col("contrib")).alias("pair_contrib"),
        F.when(~failed, (a.isin("yes", "no") | b.isin("yes", "no")).cast("int")).alias("u1_answerable"),
        F.when(~failed, F.abs("contrib")).alias("u2_abs_contrib"),
        F.when(~failed, F.col("u3_decisive")).alias("u3_decisive"),
    )


def rank_target(u1: Column, u2: Column, u3: Column, alpha: float = 1.0, beta: float = 1.0, gamma: float = 0.2) -> Column:
    return alpha * u2 + beta * u3 + gamma * u1


def target(mode: str, u1: Column, u2: Column, u3: Column, h: Column, eps: float = 0.1) -> Column:
    """What a selector learns: oracle_baseline, pure_human or human_oracle_fallback. ``h`` is 0 where no one mentioned a question."""
    if mode == "oracle_baseline":
        return rank_target(u1, u2, u3)
    if mode == "pure_human":
        return h
    if mode == "human_oracle_fallback":
        return F.when(h > 0, h).otherwise(eps * u2)
    raise ValueError(f"no such target mode: {mode}")


def gold_aligned(contrib: Column, gold: Column) -> Column:
    """The size of a contribution that points to the gold winner, else 0."""
    return F.when(((gold == "A") & (contrib > 0)) | ((gold == "B") & (contrib < 0)), F.abs(contrib)).otherwise(0.0)


def escalated(facts: DataFrame, ranked: DataFrame, keys: list[str], k: int, policy: str = "learned_topk_escalate_fallback", delta: float = TIE_DELTA, tau: float = TAU_ESCALATE, tau_hard: float = TAU_HARD, n_min: int = N_MIN) -> DataFrame:
    """Up to three stages of questions per key; one row per key with the verdict of the union asked.

    ``ranked`` has keys, qid, rank (from 1). Stage 1 asks the first k. Where the
    margin is small or few questions are aligned, stage 2 asks the next k; with the
    fallback policy, where the margin is then still small, stage 3 asks all others.
    All stages are sums over one pass of the facts, so that nothing is asked twice
    and no loop runs over samples.
    """
    if policy not in ("learned_topk", "learned_topk_escalate", "learned_topk_escalate_fallback"):
        raise ValueError(f"no such policy: {policy}")
    rows = facts.join(ranked, [*keys, "qid"]).withColumn("c", contribution(F.col("ans_a"), F.col("ans_b")))
    ok = aligned(F.col("ans_a"), F.col("ans_b"))
    upto = lambda n: [F.sum(F.when(F.col("rank") <= n, F.col("c"))).alias(f"s{n}"), F.count_if(F.col("rank") <= n).alias(f"n{n}"), F.count_if((F.col("rank") <= n) & ok).alias(f"a{n}")]
    sums = rows.groupBy(*keys).agg(*upto(k), *upto(2 * k), F.sum("c").alias("s_all"), F.count(F.lit(1)).alias("n_all"), F.count_if(ok).alias("a_all"))
    m1, m2, m3 = F.col(f"s{k}") / F.col(f"n{k}"), F.col(f"s{2 * k}") / F.col(f"n{2 * k}"), F.col("s_all") / F.col("n_all")
    may, must = F.lit(policy != "learned_topk"), F.lit(policy.endswith("_fallback"))
    two = may & ((F.abs(m1) < tau) | (F.col(f"a{k}") < n_min)) & (F.col("n_all") > k)
    three = two & must & (F.abs(m2) < tau_hard) & (F.col("n_all") > 2 * k)
    final = F.when(three, m3).when(two, m2).otherwise(m1)
    return sums.select(
        *keys,
        m1.alias("margin_initial"),
        final.alias("margin_final"),
        F.when(three, F.col("a_all")).when(two, F.col(f"a{2 * k}")).otherwise(F.col(f"a{k}")).alias("n_aligned_final"),
        F.col(f"n{k}").alias("k_selected"),
        F.when(three, F.col("n_all")).when(two, F.col(f"n{2 * k}")).otherwise(F.col(f"n{k}")).alias("k_after_escalation"),
        two.alias("escalated"),
        three.alias("fallback"),
        winner_from_margin(final, delta).alias("predicted_winner"),
    )
