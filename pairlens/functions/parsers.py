"""Parsers of judges' free text as column expressions and windows; no Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import LINE_END, SPACE, let, strip

#: The line forms of a checklist answer.
_NA_WORD = rf"(?:N{SPACE}*/{SPACE}*A|NA|not{SPACE}*applicable){SPACE}*[.。]?"
#: the second group: the answer; no match where a line has another form
_LINE = rf"(?i)^(?:Q([0-9]+):{SPACE}*)?(yes|no|{_NA_WORD})$"


def _read_lines(raw: Column) -> Column:
    """array<struct<lineno, line, said>> of an output: its lines without white space at their ends; said: the answer of a match in lower case, else empty."""
    lines = F.transform(F.split(F.coalesce(raw, F.lit("")), LINE_END, -1), strip)
    return F.transform(lines, lambda x, i: F.struct((i + 1).alias("lineno"), x.alias("line"), F.lower(F.regexp_extract(x, _LINE, 2)).alias("said")))


def _is_match(x: Column) -> Column:
    return x["said"] != ""


def _has_number(match: Column) -> Column:
    """Of the forms of a match, only those with a number have a colon."""
    return match["line"].contains(":")


def _kind(x: Column) -> Column:
    yes_no = x["said"].isin("yes", "no")
    named, bare = F.when(yes_no, "answer").otherwise("na"), F.when(yes_no, "bare").otherwise("bare_na")
    return F.when(x["line"] == "", "blank").when(~_is_match(x), "other").when(_has_number(x), named).otherwise(bare)


def _stopped(rows: Column) -> Column:
    """The number of the line that stops an output: the first other line after a match; null where there is none."""
    first = lambda cond: F.get(F.filter(rows, cond), F.lit(0))["lineno"]
    return let(first(_is_match), lambda began: first(lambda x: ~_is_match(x) & (x["line"] != "") & (x["lineno"] > began)))


def _found(rows: Column, stop: Column) -> Column:
    """array<struct<q, lineno, yes>> of the matches before the stop, by number and line; yes: false for a no, null for na."""
    live = lambda x: _is_match(x) & (stop.isNull() | (x["lineno"] < stop))
    number = lambda x: F.substring(F.substring_index(x["line"], ":", 1), 2, (1 << 31) - 1)
    yes = lambda x: F.when(x["said"].isin("yes", "no"), x["said"] == "yes")
    place = lambda x, q: F.struct(q.cast("bigint").alias("q"), x["lineno"].alias("lineno"), yes(x).alias("yes"))
    named = F.transform(F.filter(rows, lambda x: live(x) & _has_number(x)), lambda x: place(x, F.coalesce(number(x).try_cast("bigint"), F.lit(0))))
    bare = F.transform(F.filter(rows, lambda x: live(x) & ~_has_number(x)), lambda x, i: place(x, i + 1))
    return F.sort_array(F.concat(named, bare))


def _inside(x: Column, n: Column) -> Column:
    return (x["q"] >= 1) & (n.isNull() | (x["q"] <= n))


def _repeats(x: Column, i: Column, found: Column) -> Column:
    return F.coalesce(F.get(found, i - 1)["q"] == x["q"], F.lit(False))


def _answer(x: Column) -> Column:
    return F.when(x["yes"], "yes").when(~x["yes"], "no").otherwise("na")


def checklist_states(raw: Column, n: Column) -> Column:
    """array<struct<lineno, line, kind, q, answer, fate>>: what becomes of each line of one output.

    kind: answer, na (with a number), bare, bare_na (the next number of a counter
    that only bare lines move), blank, other. The first other line after a match
    stops the output. fate: kept, duplicate, out_of_range, stop, or ignored.

    An output is read within its row: nothing is shuffled, each step is one pass over
    its lines or one sort of them, and each line meets the pattern once.
    """

    def state(x: Column, q: Column, answer: Column, fate: Column) -> Column:
        return F.struct(x["lineno"].alias("lineno"), x["line"].alias("line"), _kind(x).alias("kind"), q.cast("bigint").alias("q"), answer.cast("string").alias("answer"), fate.alias("fate"))

    def fates(rows: Column, stop: Column) -> Column:
        rest = F.filter(rows, lambda x: ~_is_match(x) | F.coalesce(x["lineno"] >= stop, F.lit(False)))
        rest = F.transform(rest, lambda x: state(x, F.lit(None), F.lit(None), F.when(x["lineno"] == stop, "stop").otherwise("ignored")))

        def judged(found: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                inside, repeats = _inside(m, n), _repeats(m, i, found)
                fate = F.when(~inside, "out_of_range").when(repeats, "duplicate").otherwise("kept")
                return let(F.get(rows, m["lineno"] - 1), lambda x: state(x, m["q"], F.when(inside & ~repeats, _answer(m)), fate))

            return F.transform(found, one)

        return F.sort_array(F.concat(rest, let(_found(rows, stop), judged)))

    return let(_read_lines(raw), lambda rows: let(_stopped(rows), lambda stop: fates(rows, stop)))


def _readings(outputs: DataFrame, keys: list[str], raw: str, n: str) -> DataFrame:
    """A row per output: keys, n, kept (array<struct<q, lineno, yes>>, by number), n_matches, n_out_of_range, hit_na, first_bad_line, first_bad_lineno, more_after.

    Lines have no states here, which is most of what ``checklist_states`` takes: the
    values of a lambda are copied, so that a match is two numbers and a flag, without
    texts. The generator keeps the optimiser from copying the reading into every use.
    """

    def reading(rows: Column, stop: Column, found: Column) -> Column:
        kept = F.filter(found, lambda x, i: _inside(x, F.col("n")) & ~_repeats(x, i, found))
        outside = F.size(F.filter(found, lambda x: ~_inside(x, F.col("n"))))
        after = F.coalesce(F.when(stop.isNotNull(), F.exists(rows, lambda x: _is_match(x) & (x["lineno"] > stop))), F.lit(False))
        return F.struct(
            kept.alias("kept"), F.size(found).cast("bigint").alias("n_matches"), outside.cast("bigint").alias("n_out_of_range"), F.exists(found, lambda x: x["yes"].isNull()).alias("hit_na"),
            F.get(rows, stop - 1)["line"].alias("first_bad_line"), stop.alias("first_bad_lineno"), after.alias("more_after"),
        )

    read = let(_read_lines(F.col("raw")), lambda rows: let(_stopped(rows), lambda stop: let(_found(rows, stop), lambda found: reading(rows, stop, found))))
    return outputs.select(*keys, F.col(n).alias("n"), F.col(raw).alias("raw")).select(*keys, "n", F.inline(F.array(read)))


def checklist_lines(outputs: DataFrame, keys: list[str], raw: str = "raw", n: str = "n") -> DataFrame:
    """A row per line of each output: keys, n and the fields of ``checklist_states``."""
    rows = outputs.select(*keys, F.col(n).alias("n"), F.col(raw).alias("raw"))
    return rows.select(*keys, "n", F.inline(checklist_states(F.col("raw"), F.col("n"))))


def checklist_answers(outputs: DataFrame, keys: list[str], raw: str = "raw", n: str = "n") -> DataFrame:
    """keys, q, answer of the outputs with at least one yes or no; others are fallbacks and give nothing."""
    rows = _readings(outputs, keys, raw, n).filter(F.exists("kept", lambda x: x["yes"].isNotNull()))
    return rows.select(*keys, F.inline("kept")).select(*keys, F.col("q").cast("int").alias("q"), F.when(F.col("yes"), "yes").when(~F.col("yes"), "no").otherwise("na").alias("answer"))


def parsed_checklist(outputs: DataFrame, keys: list[str], raw: str = "raw", n: str = "n", more: dict[str, Column] | None = None) -> DataFrame:
    """The parsed form of each output, one row each: counts, score, completeness, why it stopped.

    parse_ok is false for a fallback: no yes or no answer. Its score is 0 and its
    flags are false; numbers of its na answers are kept. ``more`` columns come from
    the same reading (``_readings``).
    """
    more = more or {}
    where = lambda cond: F.filter("kept", cond)
    count = lambda of: F.size(of).cast("bigint")
    g = _readings(outputs, keys, raw, n).select(
        *keys, "n",
        F.transform(where(lambda x: x["yes"].isNotNull()), lambda x: F.struct(x["q"].cast("int").alias("q"), _answer(x).alias("answer"))).alias("answers"),
        F.transform(where(lambda x: x["yes"].isNull()), lambda x: x["q"].cast("int")).alias("na_qnums"),
        count("kept").alias("n_kept"), count(where(lambda x: x["yes"])).alias("n_yes"), count(where(lambda x: x["yes"].isNull())).alias("n_na"),
        (F.col("n_matches") - F.col("n_out_of_range") - F.size("kept")).alias("n_duplicates"), "n_out_of_range", "first_bad_line", "first_bad_lineno", "hit_na", *(c.alias(name) for name, c in more.items()),
    )
    parsed = F.col("n_kept") - F.col("n_na")
    ok = parsed > 0
    stop = (
        F.when(F.col("first_bad_lineno").isNotNull(), "unrecognized_line_after_started")
        .when(~ok, F.when((F.col("n_na") > 0) & (F.col("n_out_of_range") > 0), "out_of_range_only").otherwise("empty_output"))
        .when(F.col("hit_na"), "hit_na_but_continued")
        .otherwise("completed")
    )
    return g.select(
        *keys, ok.alias("parse_ok"), F.when(ok, F.col("answers")).alias("answers"), "na_qnums", parsed.alias("n_questions_parsed"), "n_yes", F.when(ok, parsed - F.col("n_yes")).alias("n_no"), "n_na",
        F.coalesce(F.try_divide(F.col("n_yes"), parsed), F.lit(0.0)).alias("score"), F.coalesce(ok & (parsed == F.col("n")), F.lit(False)).alias("complete"), F.coalesce(ok & (parsed + F.col("n_na") == F.col("n")), F.lit(False)).alias("complete_with_na"),
        stop.alias("stop_reason"), "first_bad_line", "first_bad_lineno", "n_duplicates", "n_out_of_range", *more,
    )


def strict_reading() -> dict[str, Column]:
    """A stricter look at the same reading: every match counts, repeated or not; flags what follows the block.

    rationale_after: another line after the first match; more_after: a match after that line.
    """
    return {"n_matches": F.col("n_matches"), "rationale_after": F.col("first_bad_lineno").isNotNull(), "more_after": F.col("more_after")}


def strict_lines(outputs: DataFrame, keys: list[str], raw: str = "raw", n: str = "n") -> DataFrame:
    """The strict reading of each output, one row each. It asks for no fate, so that its lines are neither numbered nor sorted; ``n`` plays no part."""

    def read(rows: Column, stop: Column) -> Column:
        before = F.size(F.filter(rows, lambda x: _is_match(x) & (stop.isNull() | (x["lineno"] < stop)))).cast("bigint")
        after = F.coalesce(F.exists(rows, lambda x: _is_match(x) & (x["lineno"] > stop)), F.lit(False))
        return F.struct(before.alias("n_matches"), stop.isNotNull().alias("rationale_after"), after.alias("more_after"))

    said = let(_read_lines(F.col(raw)), lambda rows: let(_stopped(rows), lambda stop: read(rows, stop)))
    return outputs.select(*keys, F.inline(F.array(said)))


def _numbered(raw: Column, pattern: str) -> Column:
    """array<struct<q, label>> of the matches of a pattern with a number and a label."""
    numbers, labels = (F.regexp_extract_all(raw, F.lit(pattern), F.lit(i)) for i in (1, 2))
    return F.transform(F.arrays_zip(numbers.alias("n"), labels.alias("l")), lambda z: F.struct(z["n"].cast("int").alias("q"), z["l"].alias("label")))


def _by_number(found: Column, last: bool) -> Column:
    """One label per number: the first or the last."""
    placed = F.transform(found, lambda x, i: F.struct(x["q"].alias("q"), (-i if last else i).alias("place"), x["label"].alias("label")))
    once = let(F.sort_array(placed), lambda rows: F.filter(rows, lambda x, i: F.coalesce(F.get(rows, i - 1)["q"] != x["q"], F.lit(True))))
    return F.transform(once, lambda x: F.struct(x["q"].alias("q"), x["label"].alias("label")))


def comparative_answers(raw: Column) -> Column:
    """The permissive reading: labels anywhere, the last of a number counts, only Tie is normalised."""
    found = _numbered(raw, r"(?i)Q([0-9]+):\s*(A|B|Tie)")
    return _by_number(F.transform(found, lambda x: F.struct(x["q"].alias("q"), F.when(F.upper(x["label"]) == "TIE", "Tie").otherwise(x["label"]).alias("label"))), last=True)


def comparative_ok(answers: Column, expected: Column) -> Column:
    """At least four fifths of the expected questions have a label."""
    return F.when(expected > 0, F.size(answers) / expected >= 0.8).otherwise(False)


def comparative_answers_strict(raw: Column, expected: Column) -> Column:
    """The strict reading: a line each, numbers in range, the first of a number counts, labels upper-cased."""
    found = _numbered(raw, r"(?im)^\s*Q([0-9]+):\s*(A|B|Tie)\b")
    found = F.filter(found, lambda x: (x["q"] >= 1) & (x["q"] <= expected))
    return _by_number(F.transform(found, lambda x: F.struct(x["q"].alias("q"), F.when(F.upper(x["label"]) == "TIE", "Tie").otherwise(F.upper(x["label"])).alias("label"))), last=False)


def label_name(c: Column) -> Column:
    """A, B or Tie in any case, else null."""
    return F.when(F.upper(c).isin("A", "B"), F.upper(c)).when(F.upper(c) == "TIE", "Tie")


def trailing_winner(raw: Column) -> Column:
    """The first line that ends with "Winner: A", B or Tie."""
    return let(F.regexp_extract(raw, r"(?im)Winner:\s*(A|B|Tie)\s*$", 1), label_name)


def comparative_winner(answers: Column, final: Column, delta: float = 0.05) -> Column:
    """A final A or B, else the margin of the labels, else null."""

    def by_margin(labels: Column) -> Column:
        count = lambda x: F.size(F.filter(labels, lambda a: a["label"] == x))
        margin = F.try_divide(count("A") - count("B"), F.size(labels))
        return let(margin, lambda m: F.when(F.size(labels) == 0, F.lit(None)).when(m > delta, "A").when(m < -delta, "B").otherwise("Tie"))

    return let(final, lambda stated: F.when(stated.isin("A", "B"), stated).otherwise(let(answers, by_margin)))


def vanilla_winner(raw: Column) -> Column:
    """A or B by the first that applies: JSON, JSON inside text, the bare letter, a leading letter, the last lone letter."""
    text = strip(raw)
    upper = F.upper(text)
    one = lambda c: F.when(c.isin("A", "B"), c)
    lone = F.regexp_extract_all(upper, F.lit(r"\b([AB])\b"), F.lit(1))
    return F.coalesce(
        one(F.upper(strip(F.get_json_object(text, "$.winner")))),
        one(F.upper(F.regexp_extract(text, r"""(?i)\{[^{}]*"winner"\s*:\s*"([AB])"[^{}]*\}""", 1))),
        one(upper),
        one(F.regexp_extract(upper, r"^(?:RESPONSE\s+)?([AB])\b", 1)),
        F.when(F.size(lone) > 0, F.element_at(lone, -1)),
    )


def trace(raw: Column) -> Column:
    """A self-checklist trace: struct<checklist, verdicts (number to label), winner, n_questions, n_verdicts, matched, parse_error>.

    Only what follows the last </think> is read, but for a winner that is looked for
    in the whole text when the final section has none. A trace without one of its
    two sections stops there: its counts are 0.
    """
    text = F.coalesce(raw, F.lit(""))
    body = F.substring_index(text, "</think>", -1)
    section = lambda name, until: F.regexp_extract(body, rf"(?is)###\s*{name}\s*\n(.*?)(?={until}\z)", 1)
    has = lambda name: body.rlike(rf"(?i)###\s*{name}\s*\n")
    listed = section("Checklist", r"###\s*Item\s*Verdicts|###\s*Final|")
    questions = F.transform(F.regexp_extract_all(listed, F.lit(r"(?m)^Q[0-9]+:[^\S\n]*(.*\S.*)$"), F.lit(1)), strip)
    found = _by_number(_numbered(section(r"Item\s*Verdicts", r"###\s*Final|"), r"(?im)^Q([0-9]+):\s*(A|B|Tie)\b"), last=True)
    verdicts = F.map_from_entries(F.transform(found, lambda x: F.struct(x["q"], label_name(x["label"]))))
    winner = F.coalesce(trailing_winner(section("Final", "")), trailing_winner(text))
    error = (
        F.when(strip(text) == "", "empty output")
        .when(~has("Checklist"), "missing ### Checklist section")
        .when(~has(r"Item\s*Verdicts"), "missing ### Item Verdicts section")
    )
    none = F.array().cast("array<string>")
    no_map = F.map_from_entries(F.array().cast("array<struct<q:int,label:string>>"))
    early = error.isNotNull()
    seen = F.when(F.coalesce(error == "missing ### Item Verdicts section", F.lit(False)) | ~early, questions).otherwise(none)
    n, v = F.size(questions), F.size(found)
    return F.struct(
        seen.alias("checklist"), F.when(early, no_map).otherwise(verdicts).alias("verdicts"), F.when(~early, winner).alias("winner"), F.when(early, 0).otherwise(n).alias("n_questions"), F.when(early, 0).otherwise(v).alias("n_verdicts"),
        (~early & (n > 0) & (n == v)).alias("matched"), F.when(early, error).when(n == 0, "no checklist questions found").alias("parse_error"),
    )


def mentioned_numbers(raw: Column, low: Column | int, high: Column | int) -> Column:
    """struct<qids, fallback>: question numbers of a JSON answer, JSON within text, or loose mentions; in range, once each."""
    text = strip(F.coalesce(raw, F.lit("")))
    shape = "struct<mentioned_qids:array<int>>"
    strict = F.from_json(text, shape)["mentioned_qids"]
    inner = F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), shape)["mentioned_qids"]
    loose = F.transform(F.regexp_extract_all(text, F.lit(r"\b[Qq]?([0-9]{1,2})\b"), F.lit(1)), lambda x: x.cast("int"))
    keep = lambda c: F.array_distinct(F.filter(c, lambda x: (x >= low) & (x <= high)))
    return F.struct(keep(F.coalesce(strict, inner, loose)).alias("qids"), (strict.isNull() & inner.isNull()).alias("fallback"))


def importance(raw: Column) -> Column:
    """array<struct<qid, importance>> of the first JSON block's weights, clamped to 0..5; the last of a question counts."""
    got = F.from_json(F.regexp_extract(raw, r"(?s)(\{.*\})", 1), "struct<weights:array<struct<qid:int,importance:double>>>")["weights"]
    got = F.reverse(F.filter(F.coalesce(got, F.array().cast("array<struct<qid:int,importance:double>>")), lambda x: x["qid"].isNotNull() & x["importance"].isNotNull()))
    ids = F.sort_array(F.array_distinct(F.transform(got, lambda x: x["qid"])))
    return F.transform(ids, lambda q: F.struct(q.alias("qid"), F.greatest(F.lit(0.0), F.least(F.lit(5.0), F.filter(got, lambda x: x["qid"] == q)[0]["importance"])).alias("importance")))


def likert(raw: Column) -> Column:
    """The digit after the first "Score:", if it is 1 to 5; null for N/A, another digit or no score."""
    digit = F.regexp_extract(raw, r"(?i)Score:\s*(N/?A|[0-9])", 1).try_cast("int")
    return F.when(digit.between(1, 5), digit)


def verifier(raw: Column, default: str = "yes") -> Column:
    """The first word if it is yes or no; anything else fails closed."""
    word = F.regexp_extract(F.lower(F.coalesce(raw, F.lit(""))), "([a-z]+)", 1)
    return F.when(word.isin("yes", "no"), word).otherwise(default)


def na_numbers(raw: Column) -> Column:
    """Numbers of lines "Qn: N/A"."""
    return F.transform(F.regexp_extract_all(raw, F.lit(r"(?im)^\s*Q([0-9]+):\s*N\s*/?\s*A\b"), F.lit(1)), lambda x: x.cast("int"))


def prompt_questions(prompt: Column) -> Column:
    """array<struct<q, text>> of the lines "Qn: text" of a prompt."""
    found = _numbered(prompt, r"(?m)^Q([0-9]+):[^\S\n]*(\S.*)$")
    return F.transform(found, lambda x: F.struct(x["q"].alias("q"), strip(x["label"]).alias("text")))


def answer_differences(a: Column, b: Column, missing: str = "—") -> Column:
    """array<struct<q, a, b>> where two maps of labels differ, a missing side shown as a dash."""
    side = lambda m, i: F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("q"), F.lit(i).alias("side"), F.coalesce(e["value"], F.lit(missing)).alias("label")))
    label = lambda cond, x: F.when(cond, x["label"]).otherwise(missing)

    def met(rows: Column) -> Column:
        """A number's labels stand side by side; its first row holds both."""

        def one(x: Column, i: Column) -> Column:
            before, after = F.get(rows, i - 1), F.get(rows, i + 1)
            first, both = F.coalesce(before["q"] != x["q"], F.lit(True)), F.coalesce(after["q"] == x["q"], F.lit(False))
            return F.when(first, F.struct(x["q"].alias("q"), label(x["side"] == 0, x).alias("a"), F.when(both, after["label"]).otherwise(label(x["side"] == 1, x)).alias("b")))

        return F.transform(rows, one)

    return F.filter(let(F.sort_array(F.concat(side(a, 0), side(b, 1))), met), lambda x: x["a"] != x["b"])


def answer_map(json: Column) -> Column:
    """number to answer of a parsed output's JSON; its na_answers are ignored, so that na looks like missing."""
    rows = F.coalesce(F.from_json(json, "struct<answers:array<struct<q:int,answer:string>>>")["answers"], F.array().cast("array<struct<q:int,answer:string>>"))
    return F.map_from_entries(F.array_distinct(F.filter(rows, lambda x: x["q"].isNotNull())))


def completion_text(text: Column, messages: Column | None = None) -> Column:
    """A completion as text: a string as it is, else the contents of chat messages."""
    return text if messages is None else F.coalesce(text, F.array_join(F.transform(messages, lambda m: F.coalesce(m["content"], F.lit(""))), "\n"))


def stage_numbers(local: Column, asked: Column) -> Column:
    """Local numbers of a stage as global ids of the questions asked; those out of range are dropped."""
    return F.filter(F.transform(local, lambda q: F.when((q >= 1) & (q <= F.size(asked)), F.try_element_at(asked, q))), lambda x: x.isNotNull())


def checklist_questions(df: DataFrame, keys: list[str], raw: str, dimensions: tuple[str, ...]) -> DataFrame:
    """keys, dimension, place, question of a generated checklist: bullets under "### dimension" sections, once each per dimension in any case."""
    rows = df.select(*keys, F.posexplode(F.split(F.coalesce(F.col(raw), F.lit("")), LINE_END, -1)).alias("place", "line")).withColumn("line", strip(F.col("line")))
    head = F.when(F.col("line").startswith("###"), F.lower(strip(F.regexp_replace("line", "^#+", ""))))
    current = F.last(head, ignorenulls=True).over(Window.partitionBy(*keys).orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    bullet = strip(F.regexp_extract("line", r"^[-*•]\s*(.+)$", 1))
    rows = rows.withColumn("dimension", current).withColumn("question", bullet).filter("question <> ''").filter(F.col("dimension").isin(*dimensions))
    once = F.row_number().over(Window.partitionBy(*keys, "dimension", F.lower("question")).orderBy("place"))
    return rows.withColumn("_n", once).filter("_n = 1").select(*keys, "dimension", "place", "question")


def simple_bullets(raw: Column) -> Column:
    """Lines that begin with "- ", without N/A ones."""
    bullets = F.filter(F.transform(F.split(raw, LINE_END, -1), strip), lambda x: x.startswith("- "))
    return F.filter(F.transform(bullets, lambda x: strip(F.substr(x, F.lit(3)))), lambda x: ~F.upper(x).isin("NA", "N/A", ""))


def extracted_questions(raw: Column, dimensions: tuple[str, ...]) -> Column:
    """array<struct<dimension, question>> of a JSON list, fenced or within text; unknown dimensions and questions that name a response are dropped."""
    text = F.regexp_replace(strip(F.coalesce(raw, F.lit(""))), r"(?s)^```[a-z]*\s*|\s*```$", "")
    shape = "array<struct<dimension:string,question:string>>"
    rows = F.coalesce(F.from_json(F.when(text.startswith("["), text), shape), F.from_json(F.regexp_extract(text, r"(?s)(\[.*\])", 1), shape), F.array().cast(shape))
    return F.filter(rows, lambda x: x["dimension"].isin(*dimensions) & (F.coalesce(x["question"], F.lit("")) != "") & ~x["question"].rlike(r"(?i)\bresponse\s*[ab12]\b"))
