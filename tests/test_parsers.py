"""Parsers against a plain restatement of their rules, and hand-computed cases."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairlens.functions import parsers as P

ANSWER = re.compile(r"q(\d+):\s*(yes|no)", re.I)
NA = re.compile(r"q(\d+):\s*(n\s*/\s*a|na|not\s*applicable)\s*[.。]?", re.I)
BARE = re.compile(r"yes|no", re.I)
BARE_NA = re.compile(r"(n\s*/\s*a|na|not\s*applicable)\s*[.。]?", re.I)


def restated(raw, n):
    """answers, nas, why it stopped, bad line number, duplicates, out of range."""
    yes_no, nas, seen, bare, started, hit, dup, out, bad = {}, [], set(), 0, False, False, 0, 0, None
    for number, line in enumerate((raw or "").splitlines(), 1):
        line = line.strip()
        if not line:
            continue
        m, a = ANSWER.fullmatch(line), NA.fullmatch(line)
        if not (m or a or BARE.fullmatch(line) or BARE_NA.fullmatch(line)):
            if started:
                bad = number
                break
            continue
        started = True
        is_na = bool(a) or bool(BARE_NA.fullmatch(line)) and not m
        hit |= is_na
        if m or a:
            q = int((m or a)[1])
        else:
            bare += 1
            q = bare
        if not 1 <= q <= n:
            out += 1
        elif q in seen:
            dup += 1
        else:
            seen.add(q)
            if is_na:
                nas.append(q)
            else:
                yes_no[q] = (m[2] if m else line).lower()
    if bad:
        why = "unrecognized_line_after_started"
    elif not yes_no:
        why = "out_of_range_only" if nas and out else "empty_output"
    else:
        why = "hit_na_but_continued" if hit else "completed"
    return yes_no, sorted(nas), why, bad, dup, out


LINES = st.sampled_from(["Q1: yes", "Q2: no", "q3:YES", "Q2: N/A", "Q1: NA.", "Q4: not applicable", "yes", "No", "N / A", "na。", "", "  ", "Note", "Q9: yes", "Q0: no", "Q1: yes.", "Q1 yes", "Q2: maybe", " Q3: no "])
ENDS = st.sampled_from(["\n", "\r\n", "\r", " ", "\x0b", "\x85"])


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.lists(st.tuples(LINES, ENDS), max_size=9).map(lambda x: "".join(a + b for a, b in x)), st.integers(1, 5)), min_size=10, max_size=30))
def test_checklist_state_machine(spark, cases):
    df = spark.createDataFrame([(i, raw, n) for i, (raw, n) in enumerate(cases)], "id long, raw string, n int")
    out = {r.id: r for r in P.parsed_checklist(df, ["id"]).collect()}
    assert len(out) == len(cases)
    for i, (raw, n) in enumerate(cases):
        yes_no, nas, why, bad, dup, oor = restated(raw, n)
        r = out[i]
        assert r.parse_ok == bool(yes_no), raw
        assert {a.q: a.answer for a in r.answers or []} == yes_no and r.na_qnums == nas, raw
        assert (r.stop_reason, r.n_duplicates, r.n_out_of_range) == (why, dup, oor), raw
        assert (r.first_bad_lineno or None) == bad, raw
        assert r.score == (sum(v == "yes" for v in yes_no.values()) / len(yes_no) if yes_no else 0)
        assert r.complete == (bool(yes_no) and len(yes_no) == n) and r.complete_with_na == (bool(yes_no) and len(yes_no) + len(nas) == n)


def test_stop_after_a_note(spark):
    df = spark.createDataFrame([(1, "Q1: yes\nQ2: N/A\nNote\nQ3: no", 3), (2, None, 3)], "id long, raw string, n int")
    r, none = P.parsed_checklist(df, ["id"]).orderBy("id").collect()
    assert [(a.q, a.answer) for a in r.answers] == [(1, "yes")] and r.na_qnums == [2]
    assert (r.stop_reason, r.complete, r.complete_with_na, r.first_bad_line) == ("unrecognized_line_after_started", False, False, "Note")
    assert (none.parse_ok, none.stop_reason, none.score) == (False, "empty_output", 0.0)


def one(spark, expr_of, text):
    return spark.createDataFrame([(text,)], "raw string").select(expr_of(F.col("raw")).alias("x")).first().x


def test_mentioned_numbers(spark):
    f = lambda c: P.mentioned_numbers(c, 1, 61)
    assert list(one(spark, f, '{"mentioned_qids": [1, 7, 12]}')) == [[1, 7, 12], False]
    assert list(one(spark, f, 'Well: {"mentioned_qids": [3, 4]} so')) == [[3, 4], False]
    got = one(spark, f, "Q5 and Q19 apply, plus q42.")
    assert set(got.qids) == {5, 19, 42} and got.fallback
    assert one(spark, f, '{"mentioned_qids": [1, 99, 200]}').qids == [1]
    assert list(one(spark, f, None)) == [[], True]


def test_vanilla_winner(spark):
    cases = {'{"winner": "b"}': "B", 'x {"why": 1, "winner": "A"} y': "A", "a": "A", "Response B because A": "B", "I say A, no, B": "B", "Neither": None, "": None, '{"winner": "Tie"}': None, "Apple": None}
    for text, want in cases.items():
        assert one(spark, P.vanilla_winner, text) == want, text


TRACE = """<think>
### Checklist
Q1: rehearsal
</think>
### Checklist
Q1: Is it right?
Q2: Is it clear?
### Item Verdicts
Q1: A (because)
Q2: tie
Q2: B
### Final
Winner: a
"""


def test_trace(spark):
    t = one(spark, P.trace, TRACE)
    assert t.checklist == ["Is it right?", "Is it clear?"] and t.verdicts == {1: "A", 2: "B"}
    assert (t.winner, t.n_questions, t.n_verdicts, t.matched, t.parse_error) == ("A", 2, 2, True, None)
    assert one(spark, P.trace, "").parse_error == "empty output"
    assert one(spark, P.trace, None).parse_error == "empty output"
    assert one(spark, P.trace, "Winner: A").parse_error == "missing ### Checklist section"
    t = one(spark, P.trace, "### Checklist\nQ1: x\nWinner: B")
    assert (t.parse_error, t.n_questions, t.checklist) == ("missing ### Item Verdicts section", 0, ["x"])
    t = one(spark, P.trace, "Winner: Tie\n### Checklist\nnothing\n### Item Verdicts\n")
    assert (t.parse_error, t.winner, t.matched) == ("no checklist questions found", "Tie", False)


def test_small_parsers(spark):
    assert one(spark, P.likert, "I give 4") is None and one(spark, P.likert, "Score: N/A, Score: 4") is None and one(spark, P.likert, "score:9") is None and one(spark, P.likert, "so Score:\n45") == 4
    assert one(spark, P.verifier, " No, same") == "no" and one(spark, P.verifier, "hmm") == "yes"
    assert one(spark, P.na_numbers, "Q1: yes\n Q2: N/A\nq3: na") == [2, 3]
    assert [(x.q, x.label) for x in one(spark, P.comparative_answers, "Q1: A Q2: tie\nQ1: b")] == [(1, "b"), (2, "Tie")]
    strict = one(spark, lambda c: P.comparative_answers_strict(c, F.lit(2)), "Q1: a\nQ3: B\nQ1: B\nQ2: TIE")
    assert [(x.q, x.label) for x in strict] == [(1, "A"), (2, "Tie")]
    assert [(x.qid, x.importance) for x in one(spark, P.importance, 'x {"weights": [{"qid": 2, "importance": 9}, {"qid": 1, "importance": -1}]}')] == [(1, 0.0), (2, 5.0)]
    assert one(spark, P.importance, "none") == []
    d = one(spark, lambda c: P.answer_differences(F.create_map(F.lit(1), F.lit("yes"), F.lit(2), F.lit("no")), F.create_map(F.lit(1), F.lit("yes"), F.lit(3), F.lit("na"))), "")
    assert [(x.q, x.a, x.b) for x in d] == [(2, "no", "—"), (3, "—", "na")]
