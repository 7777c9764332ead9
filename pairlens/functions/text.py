"""Scalar text functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What ends a line, and white space, in Unicode text.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
_WHITE = "".join(chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once."""
    return F.transform(F.array(value), use)[0]


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(c, F.lit(_WHITE))


def lines(c: Column) -> Column:
    """The lines of a text; a line end at the very end begins no further line."""
    parts = F.split(c, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def context_text(turns: Column) -> Column:
    """Turns as "[role]" and content, parted by blank lines."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("["), t["role"], F.lit("]\n"), t["content"])), "\n\n")


def prompt_id(context: Column) -> Column:
    """The first 16 hex digits of SHA-256."""
    return F.substring(F.sha2(context.cast("binary"), 256), 1, 16)


def json_string(c: Column) -> Column:
    """A JSON string with only the necessary escapes: quotes, backslashes and control characters."""
    out = F.regexp_replace(c, r"([\\\"])", r"\\$1")
    named = {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
    for char, escape in named.items():
        out = F.replace(out, F.lit(char), F.lit(escape))
    # the other control characters are rare: rewrite only texts that hold one
    rest = out
    for code in range(32):
        if chr(code) not in named:
            rest = F.replace(rest, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.concat(F.lit('"'), F.when(out.rlike(r"[\x00-\x1f]"), rest).otherwise(out), F.lit('"'))


def sorted_json(**values: Column) -> Column:
    """A flat JSON object with sorted keys, ", " and ": " between its parts."""
    parts = []
    for i, key in enumerate(sorted(values)):
        parts += [F.lit(("{" if i == 0 else ", ") + f'"{key}": '), F.coalesce(json_string(values[key]), F.lit("null"))]
    return F.concat(*parts, F.lit("}"))


def sample_id(prompt: Column, **values: Column) -> Column:
    return F.concat(prompt, F.lit("_"), prompt_id(sorted_json(**values)))


def winner_of_preference(p: Column) -> Column:
    return F.when(p < 0, "A").when(p > 0, "B").when(p == 0, "Tie")


def signed_preference(winner: Column, strength: Column) -> Column:
    return F.when(winner == "A", -strength).when(winner == "B", strength).otherwise(0)


def normal_domain(c: Column) -> Column:
    return F.lower(strip(c))


def swap_references(c: Column) -> Column:
    """Response A and Response B exchanged."""
    parts = F.transform(F.split(c, "Response A", -1), lambda x: F.replace(x, F.lit("Response B"), F.lit("Response A")))
    return F.array_join(parts, "Response B")


def standard_references(c: Column) -> Column:
    """Mentions of a response by number or letter, with or without @, as "Response A" or "Response B"."""
    to = lambda x, which, name: F.regexp_replace(x, rf"(?i)@?\bresponse\s*[{which}]\b", f"Response {name}")
    return to(to(c, "1a", "A"), "2b", "B")


def normal_space(c: Column) -> Column:
    """Line ends as \\n, runs of spaces and tabs as one space, at most one blank line, stripped."""
    c = F.regexp_replace(c, "\r\n?", "\n")
    return strip(F.regexp_replace(F.regexp_replace(c, "[ \t]+", " "), "\n{3,}", "\n\n"))


def joined_fragments(parts: Column, separator: str = "\n\n") -> Column:
    """Non-empty fragments once each, in order."""
    return F.array_join(F.array_distinct(F.filter(F.transform(parts, strip), lambda x: x != "")), separator)


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def byte_tokens(c: Column, output: int = 0) -> Column:
    """max(1, bytes / 4, rounded up) plus the output's allowance."""
    return F.greatest(F.lit(1), F.ceil(F.octet_length(c) / 4)).cast("int") + output


def shortened(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def int_list(c: Column) -> Column:
    """A stringified list or tuple of integers as an array, numbers cut to integers; null, empty, None and unreadable cells as an empty one."""
    literal = F.regexp_replace(F.regexp_replace(strip(c), r"^\((.*)\)$", "[$1]"), r",\s*\]$", "]")
    cells = F.transform(F.from_json(literal, "array<string>"), lambda x: x.try_cast("double").try_cast("int"))
    return F.coalesce(F.when(~F.exists(cells, lambda x: x.isNull()), cells), F.array().cast("array<int>"))


#: Beginnings of a question and what its comparative form begins with, in order of precedence.
COMPARATIVE = (
    ("Does the response", "Which response better"),
    ("Is the response", "Which response is more"),
    ("Are ", "In which response are there better "),
)


def comparative(question: Column, known: Column | None = None) -> Column:
    """A question about one response asked about two; a known rewrite goes first."""
    rewritten = F.concat(F.lit("Comparing the two responses: "), question)
    for begin, other in reversed(COMPARATIVE):
        rewritten = F.when(question.startswith(begin), F.concat(F.lit(other), F.substr(question, F.lit(len(begin) + 1)))).otherwise(rewritten)
    return rewritten if known is None else F.coalesce(known, rewritten)


def first_keyword(c: Column, groups: dict[str, tuple[str, ...]], default: str) -> Column:
    """The name of the first group that has a keyword in the lower-cased text."""
    text = F.lower(c)
    out = F.lit(default)
    for name, words in reversed(groups.items()):
        out = F.when(F.greatest(*(text.contains(w).cast("int") for w in words), F.lit(0)) == 1, name).otherwise(out)
    return out


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9_.-]+", "_")


def split_of_name(c: Column) -> Column:
    name = F.lower(c)
    return F.when(name.contains("dev_600"), "dev_600").when(name.rlike(r"(^|[_/.-])test([_/.-]|$)"), "test").when(name.contains("train"), "train").when(name.rlike(r"(^|[_/.-])dev([_/.-]|$)"), "dev").otherwise("unknown")


def checklist_text(questions: Column, order: tuple[str, ...]) -> Column:
    """map<dimension, array<question>> as sections of bullets in the given order; empty dimensions are left out."""
    section = lambda d: F.when(F.size(F.coalesce(questions[d], F.array().cast("array<string>"))) > 0, F.concat(F.lit(f"### {d}\n"), F.array_join(F.transform(questions[d], lambda q: F.concat(F.lit("- "), q)), "\n")))
    return F.array_join(F.array_compact(F.array(*map(section, order))), "\n\n")


def question_block(questions: Column) -> Column:
    """array<struct<dimension, question>> as a prompt's questions, numbered from 1, under their dimensions in order of first appearance."""
    numbered = F.transform(questions, lambda x, i: F.struct(x["dimension"].alias("d"), F.concat(F.lit("Q"), (i + 1).cast("string"), F.lit(": "), x["question"]).alias("l")))
    section = lambda d: F.concat(F.lit("## "), d, F.lit("\n"), F.array_join(F.transform(F.filter(numbered, lambda x: x["d"] == d), lambda x: x["l"]), "\n"))
    return F.array_join(F.transform(F.array_distinct(F.transform(questions, lambda x: x["dimension"])), section), "\n\n")


def binary_target(labels: Column, n: Column) -> Column:
    """"Qi: yes|no" for 1..n of a map of labels, na as no; null if one is missing."""
    out = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("Q"), i.cast("string"), F.lit(": "), F.when(F.element_at(labels, i) == "yes", "yes").when(F.element_at(labels, i).isin("no", "na"), "no")))
    return F.when(n > 0, F.when(~F.exists(out, lambda x: x.isNull()), F.array_join(out, "\n")))


def with_think_block(raw: Column) -> Column:
    """A trace whose part before the last "### Final" is inside <think> tags; traces that have the tags stay."""
    at = F.length(raw) - F.length(F.substring_index(raw, "### Final", -1)) - len("### Final")
    wrapped = F.concat(F.lit("<think>\n"), strip(F.substring(raw, F.lit(1), at)), F.lit("\n</think>\n\n"), F.substring(raw, at + 1, F.lit(2147483647)))
    return F.when(raw.contains("<think>") | ~raw.contains("### Final"), raw).otherwise(wrapped)
