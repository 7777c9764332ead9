"""Texts out of irregular annotations."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import joined_fragments, normal_space

#: Keys that may hold an annotator's reasoning, the first present one counts.
REASON_KEYS = ("reasoning", "rationale", "explanation", "summary", "text", "content")


def _walk(raw: str | None, step: Callable[[dict], tuple[object, bool] | None], plain: bool) -> list[str]:
    """Texts of JSON of any nesting, in order; an explicit stack, so that the depth of what is read doesn't matter.

    A cell that nests deeper than the JSON library reads is a plain string.

    ``step`` tells what of an object is looked at, and whether a string there is a
    text as it stands. With ``plain``, other strings and scalars are texts too.
    """
    found: list[str] = []
    todo: list[tuple[object, bool]] = [(raw, False)]
    while todo:
        value, whole = todo.pop()
        if isinstance(value, dict):
            inner = step(value)
            if inner is not None:
                todo.append(inner)
        elif isinstance(value, list):
            todo.extend((item, False) for item in reversed(value))
        elif isinstance(value, str) and not whole and value.strip()[:1] in ("[", "{"):
            try:
                todo.append((json.loads(value.strip()), False))
            except (ValueError, RecursionError):
                if plain:
                    found.append(value)
        elif value is not None and (whole or plain):
            found.append(str(value))
    return found


def _texts(raw: Column, step: Callable[[dict], tuple[object, bool] | None], plain: bool) -> Column:
    """Irregular nesting is beyond typed JSON functions: one Arrow-batched pass over the annotation column only."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def walked(column: pd.Series) -> pd.Series:
        return column.map(lambda x: _walk(x, step, plain))

    return F.transform(walked(raw), normal_space)


def reasoning(raw: Column, keys: tuple[str, ...] = REASON_KEYS) -> Column:
    """The annotators' reasoning, each different text once, joined by blank lines.

    Strings, JSON in strings, lists and objects nest to any depth; of an object the
    first present key counts, also where it is empty.
    """

    def first(entry: dict) -> tuple[object, bool] | None:
        return next(((entry[key], False) for key in keys if key in entry), None)

    return joined_fragments(_texts(raw, first, True))


def feedback(raw: Column, key: str) -> Column:
    """The annotators' feedback under a key, each different text once, joined by blank lines; nested like ``reasoning``, but only strings under the key are texts."""

    def under(entry: dict) -> tuple[object, bool] | None:
        return (entry[key], isinstance(entry[key], str)) if key in entry else None

    return joined_fragments(_texts(raw, under, False))


def geval_total(scores: Column) -> Column:
    """The sum of a map of dimension scores; nulls count as 0, also where there is nothing else."""
    return F.aggregate(F.map_values(scores), F.lit(0).cast("int"), lambda s, v: s + F.coalesce(v, F.lit(0)).cast("int"))
