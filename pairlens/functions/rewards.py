"""Rewards of parsed traces and judged pairs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip

MIN_Q, MAX_Q, SOFT_MAX_Q = 6, 25, 20

#: Fixed values, here and below: the weights, bounds and scores in the formulas of rewards, which results depend on.


def _values(parsed: Column) -> Column:
    return F.map_values(parsed["verdicts"])


def _count(parsed: Column, label: str) -> Column:
    return F.size(F.filter(_values(parsed), lambda v: v == label))


def _total(parsed: Column) -> Column:
    return F.size(parsed["verdicts"])


def parse_ok(parsed: Column, ab_only: bool = False) -> Column:
    """A whole trace: enough questions and not too many, a verdict for each of 1..n, a winner (A or B where ``ab_only``)."""
    n = parsed["n_questions"]
    whole = F.sort_array(F.map_keys(parsed["verdicts"])) == F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    winner = parsed["winner"].isin("A", "B") if ab_only else parsed["winner"].isNotNull()
    return F.coalesce((F.size(parsed["checklist"]) > 0) & (_total(parsed) > 0) & winner & parsed["matched"] & n.between(MIN_Q, MAX_Q) & whole, F.lit(False))


def format_score(parsed: Column, raw: Column) -> Column:
    """Four quarters: a closed <think> (or none), questions, matched counts in range, a winner."""
    quarter = lambda c: F.when(c, 0.25).otherwise(0.0)
    think = ~raw.contains("<think>") | raw.contains("</think>")
    return quarter(think) + quarter(parsed["n_questions"] > 0) + quarter(parsed["matched"] & parsed["n_questions"].between(MIN_Q, MAX_Q)) + quarter(parsed["winner"].isNotNull())


def strict_format(parsed: Column, raw: Column) -> Column:
    """As format_score, but the first quarter needs a closing </think>."""
    return format_score(parsed, raw) - F.when(~raw.contains("</think>") & ~raw.contains("<think>"), 0.25).otherwise(0.0)


def discriminative(parsed: Column) -> Column:
    """The share of verdicts that aren't ties; 0 without verdicts."""
    return F.coalesce(F.try_divide(_count(parsed, "A") + _count(parsed, "B"), _total(parsed)), F.lit(0.0))


def item_margin(parsed: Column, gold: Column) -> Column:
    """How far the verdicts point to the gold winner, -1 to 1; for a gold tie twice the share of ties less 1."""
    a, b, t, n = _count(parsed, "A"), _count(parsed, "B"), _count(parsed, "Tie"), _total(parsed)
    value = F.when(gold == "A", F.try_divide(a - b, n)).when(gold == "B", F.try_divide(b - a, n)).when(gold == "Tie", F.try_divide(2 * t, n) - 1)
    return F.coalesce(value, F.lit(0.0))


def dominance(parsed: Column, threshold: float = 0.90, penalty: float = -0.10) -> Column:
    """The penalty where nearly all verdicts are on one side."""
    return F.when(F.coalesce(F.try_divide(F.greatest(_count(parsed, "A"), _count(parsed, "B")), _total(parsed)) > threshold, F.lit(False)), penalty).otherwise(0.0)


def diversity(vectors: Column, alone: float = 1.0) -> Column:
    """1 less the mean cosine of different questions, within 0 and 1, of unit vectors: from the square of their sum."""
    n = F.size(vectors)
    total = F.aggregate(F.slice(vectors, F.lit(2), F.greatest(n - 1, F.lit(0))), vectors[0], lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    square = F.aggregate(total, F.lit(0.0), lambda s, x: s + x * x)
    mean = (square - n) / (n * (n - 1))
    return F.when(n <= 1, F.lit(alone)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - mean)))


def winner_score(parsed: Column, gold: Column, correct: float = 1.0, wrong: float = -1.0, parse_fail: float = -0.5, tie_on_ab: float = -1.0) -> Column:
    said = parsed["winner"]
    return F.when(said.isNull(), parse_fail).when(gold.isin("A", "B") & (said == "Tie"), tie_on_ab).when(said == gold, correct).otherwise(wrong)


def combined_reward(parsed: Column, raw: Column, gold: Column) -> Column:
    return 0.85 * winner_score(parsed, gold, parse_fail=-1.0) + 0.15 * strict_format(parsed, raw)


def quality_reward(parsed: Column, gold: Column, diversity_score: Column) -> Column:
    """Parsing .10, winner .60, and for whole traces diversity .15 and discrimination .15."""
    ok = parse_ok(parsed).cast("double")
    return 0.10 * ok + 0.60 * winner_score(parsed, gold) + ok * (0.15 * diversity_score + 0.15 * discriminative(parsed))


def margin_reward(parsed: Column, raw: Column, gold: Column) -> Column:
    """Winner .55, where positive only as far as the format is right, item margin .20 by format, format .25, dominance."""
    win, form = winner_score(parsed, gold), format_score(parsed, raw)
    return 0.55 * F.when(win > 0, win * form).otherwise(win) + 0.20 * item_margin(parsed, gold) * form + 0.25 * form + dominance(parsed)


def _effective(delta: Column, p: Column, tie: float) -> Column:
    """The difference beyond the dead zone, signed by whether it points where p does."""
    size = F.abs(delta) - max(tie, 0.0)
    return F.when((p == 0) | (size <= 0), 0.0).when(delta * p > 0, size).otherwise(-size)


def pair_reward(delta: Column, p: Column, coverage: Column, tie: float = 0.05, scale: float = 0.3, weight: float = 0.1, cap: float = 0.2, threshold: float = 0.8, penalty: float = 0.2) -> Column:
    """Direction with a dead zone, clipped; margin shaping, capped; a penalty for low coverage. delta is score_b - score_a, p the signed preference."""
    clip = lambda x, size: F.greatest(F.lit(-size), F.least(F.lit(size), x))
    tied = F.greatest(F.lit(0.0), 1 - F.abs(delta) / tie) if tie > 0 else (F.abs(delta) <= 1e-12).cast("double")
    e = _effective(delta, p, tie)
    direction = F.when(p == 0, tied).otherwise(clip(e / max(scale, 1e-12), 1.0))
    shaping = F.when(p == 0, 0.0).otherwise(clip(weight * e, max(cap, 0.0)))
    return direction + shaping - penalty * (coverage < threshold).cast("double")


def legacy_reward(delta: Column, p: Column, coverage: Column) -> Column:
    """The continuous reward: direction, a Gaussian of the distance to p / 3, coverage, less a term for ties; within 0 and 1."""
    target = p / 3.0
    tie = 0.80 * F.exp(-(delta * delta) / 0.05) + 0.20 * coverage
    size = 0.500 * F.exp(-F.pow(delta - target, F.lit(2.0)) / 0.15) * F.when(delta * target < 0, 0.5).otherwise(1.0)
    direction = 0.333 * F.greatest(F.lit(0.0), F.signum(target) * delta)
    both_tie = 0.20 * F.abs(target) * (1 - F.abs(delta)) * F.exp(-(delta * delta) / 0.12**2)
    return F.when(p == 0, tie).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), direction + size + 0.167 * coverage - both_tie)))


def length_band(n: Column, soft: int = MAX_Q, hard: int = SOFT_MAX_Q) -> Column:
    """1 up to a soft length, falling to 0 at the hard one; 0 below the least. The defaults are those that the scorer is called with."""
    fall = F.greatest(F.lit(0.0), 1 - (n - soft) / max(1, hard - soft))
    return F.when(n < MIN_Q, 0.0).when(n <= soft, 1.0).when(n >= hard, 0.0).otherwise(fall)


def pseudo_winner(original: Column, swapped: Column, confidence: float = 0.6, consistency: float = 0.5) -> Column:
    """struct<pseudo_winner, confidence, swap_consistency> of votes in both orders, arrays of A, B, Tie or null.

    Ties between A and B go to A; the majority of an order, where its counts are
    equal, is its first vote for A or B.
    """
    back = F.transform(swapped, lambda w: F.when(w == "A", "B").when(w == "B", "A").otherwise(w))
    n = lambda votes, x: F.size(F.filter(votes, lambda w: w == x))
    a, b = n(original, "A") + n(back, "A"), n(original, "B") + n(back, "B")
    conf = F.coalesce(F.try_divide(F.greatest(a, b), a + b), F.lit(0.0))

    def majority(votes: Column) -> Column:
        valid = F.filter(votes, lambda w: w.isin("A", "B"))
        return F.when(n(votes, "A") > n(votes, "B"), "A").when(n(votes, "B") > n(votes, "A"), "B").when(F.size(valid) > 0, F.get(valid, F.lit(0)))

    agree = lambda votes: F.try_divide(F.greatest(n(votes, "A"), n(votes, "B")), n(votes, "A") + n(votes, "B"))
    swap = F.coalesce(F.when(majority(original) == majority(back), 0.5 * (agree(original) + agree(back))), F.lit(0.0))
    winner = F.when((a + b > 0) & (conf >= confidence) & (swap >= consistency), F.when(a >= b, "A").otherwise("B"))
    return F.struct(winner.alias("pseudo_winner"), conf.alias("confidence"), swap.alias("swap_consistency"))


def trace_score(parsed: Column, pseudo: Column, diversity_score: Column) -> Column:
    """The weighted score of a trace against struct<pseudo_winner, confidence, swap_consistency>."""
    ok = parse_ok(parsed, ab_only=True).cast("double")
    gold = pseudo["pseudo_winner"]
    final = F.coalesce((parsed["winner"] == gold) & gold.isin("A", "B"), F.lit(False)).cast("double")
    margin = F.when(gold.isNull(), 0.0).otherwise(item_margin(parsed, gold))
    return (
        0.10 * ok + 0.45 * final + 0.15 * margin * ok + 0.10 * F.when(ok > 0, diversity_score).otherwise(0.0) + 0.10 * discriminative(parsed) * ok + 0.05 * length_band(parsed["n_questions"])
        + 0.10 * pseudo["swap_consistency"] + 0.05 * pseudo["confidence"] + dominance(parsed)
    )


#: The forms of an answer, the digits that only count where there is no box, and how a number is written.
BOXED, HASHED, HASHED_FORM = r"\\boxed\{([^}]+)\}", r"####\s*([-\d,.\s]+)", r"####\s*[-\d,.]+"
NUMBER = r"^[-+]?(?:(?:[0-9](?:_?[0-9])*)(?:\.(?:[0-9](?:_?[0-9])*)?)?|\.[0-9](?:_?[0-9])*)(?:[eE][-+]?[0-9](?:_?[0-9])*)?$|^(?i:[-+]?(?:inf|infinity|nan))$"


def stated_answer(text: Column) -> Column:
    """What the last box of the final 500 characters holds, whatever it is, else what follows the last ####, without commas and spaces; empty if there is neither."""
    tail = F.substring(text, -500, 500)
    last = lambda pattern: F.try_element_at(F.regexp_extract_all(tail, F.lit(pattern), F.lit(1)), F.lit(-1))
    return F.coalesce(strip(F.translate(F.coalesce(last(BOXED), last(HASHED)), ", ", "")), F.lit(""))


def numeric_answer(text: Column, solution: Column) -> Column:
    """1 if both state an answer and these are numbers within 1e-5 of each other, or, where one isn't a number, equal strings; else 0."""
    said, gold = stated_answer(text), stated_answer(solution)
    number = lambda c: F.when(c.rlike(NUMBER), F.translate(c, "_", "").cast("double"))
    apart = F.abs(number(said) - number(gold))
    same = F.when(apart.isNull(), said == gold).otherwise((apart < 1e-5) & ~F.isnan(apart))
    return ((said != "") & (gold != "") & same).cast("double")


def answer_format(text: Column) -> Column:
    """1 if an answer is boxed or follows ####, else 0."""
    return F.coalesce((text.rlike(BOXED) | text.rlike(HASHED_FORM)).cast("double"), F.lit(0.0))


def diversity_per_key(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Per key: 1 - the mean cosine of two different vectors, within 0 and 1; 1 for a single vector.

    A zero vector has no direction: its cosine with any other counts as 0. Null
    vectors and vectors with null components don't count. The sum of the unit
    vectors is enough, gathered component by component: no pairs are made.
    """
    e = F.col(vector).cast("array<double>")
    norm = F.sqrt(F.aggregate(e, F.lit(0.0), lambda s, x: s + x * x))
    rows = df.select(F.col(key).alias("k"), F.coalesce(F.transform(e, lambda x: F.try_divide(x, norm)), F.lit(None)).alias("v"), norm.alias("norm")).filter("norm is not null")
    unit = rows.select("k", "norm", F.posexplode_outer(F.when(F.col("norm") > 0, F.col("v")).otherwise(F.array(F.lit(0.0)))).alias("i", "x"))
    parts = unit.groupBy("k", "i").agg(F.sum("x").alias("s"), F.count_if(F.col("i") == 0).alias("n"), F.count_if((F.col("i") == 0) & (F.col("norm") > 0)).alias("m"))
    total = parts.groupBy("k").agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.sum("n").alias("n"), F.sum("m").alias("m"))
    mean = F.try_divide(F.col("q") - F.col("m"), F.col("n") * (F.col("n") - 1))
    return total.select(F.col("k").alias(key), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.coalesce(mean, F.lit(0.0)))).alias("diversity"))
