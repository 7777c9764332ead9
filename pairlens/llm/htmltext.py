"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level elements. The first pass decides a
block on its own: text inside menus, headers, footers, sidebars, forms, adverts,
notices and reader comments, and text that is mostly links, is boilerplate; long
text with enough stop words is main text; the rest is ambiguous. In the second
pass an ambiguous block inherits the label of the nearest decided block of its
container, ties going to main text; where its container has no decided block,
blocks of an article or main element are main text, and others take the label
of the nearest decided block of the page.

Class names and ids count as whole names, or by their first or last part where the
parts don't tell a state of the page: "sidebar", "sidebar-left" and "site-sidebar" are
boilerplate, "has-sidebar", "no-comments", "social-enabled", "content-sidebar-wrap" and
"elementor-widget" aren't. A name alone never makes all of a page boilerplate: where a
container that is boilerplate by its name holds a main element, or more than half of the
text outside menus, forms, comments and the like with no other article beside it, the name
is taken for that of a layout. Names of comments are exempt from this, since comments can
be longer than articles.

Inside an article or main element a header is the article's own head, and only
names that mark boilerplate anywhere count; an article element itself is
boilerplate only where its class says that it is a comment or an advert.

Null or empty html gives an empty text. Rows with the same html get the same
text. Tags, attributes and texts of any length are read whole, in linear time;
an empty table gives no rows. Only the named columns are read, so that others may
have any names, also text and n_chars.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._html import BLOCK, VOID, attributes, scan
from ._support import sliced

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "a an and are as at be by for from has have he in is it its of on or that the this to was were which with "
    "das dem den der des die ein eine einer es für im ist mit nicht sich sie und von zu auf auch an als bei "
    "au aux ce dans de des du elle en est et il la le les ne par pas pour que qui se sur un une "
    "al con del el es la las lo los más no para pero por que se su sus un una y".split()
)
LONG_CHARS = 200
SHORT_CHARS = 70
LINK_SHARE = 0.5
STOP_SHARE = 0.15

BOILERPLATE_TAGS = frozenset("nav header footer aside form menu dialog button fieldset search".split())
CONTAINERS = frozenset("html body article main section div aside nav header footer form menu dialog fieldset table ul ol dl figure details button search blockquote".split())
#: Words of class names and ids that mark boilerplate as the whole name or its first part; as its last part; those of comments; those that mark it outside articles only, where an article's own head may bear them; parts that tell a state; words that mark an article as none.
_FIRST = frozenset(
    "ad ads advert adverts advertisement advertising breadcrumb breadcrumbs consent cookie cookies disclaimer footer gdpr login menu modal nav navbar navigation newsletter notice notices pager pagination "
    "popup promo promos promotion recommended related share sharing sidebar signup social sponsor sponsored sponsors subscribe subscription toolbar widget widgets".split()
)
_LAST = frozenset("ad ads advert advertisement breadcrumb breadcrumbs disclaimer footer menu modal nav navbar navigation newsletter notice pager pagination popup promo sharing sidebar signup subscribe toolbar".split())
_COMMENT = frozenset("comment comments commentlist disqus reply replies respond".split())
_WEAK = frozenset("banner banners header masthead search".split())
_STATE = frozenset("has no not with without is hide show enabled disabled open closed active inactive status free".split())
_NO_ARTICLE = frozenset("ad advert advertisement comment comments promo reply sponsored".split())
_BOILERPLATE_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
_HARD, _SOFT = 2, 1


def _boilerplate(name: str, rest: str, article: bool) -> int:
    """Whether a container is boilerplate by its own tag, role or a comment's name (_HARD), by its class or id (_SOFT), or not (0); ``article``: it stands in an article or main element."""
    if name in BOILERPLATE_TAGS:
        return 0 if article and name == "header" else _HARD
    if not rest or name in ("html", "body", "main"):
        return 0
    has = attributes(rest)
    called = has.get("class", "").lower().split()
    kind = 0
    if name != "article":
        if has.get("role", "").strip().lower() in _BOILERPLATE_ROLE:
            return _HARD
        called += has.get("id", "").lower().split()
    for token in called:
        parts = token.replace("_", "-").strip("-").split("-")
        first, last = parts[0], parts[-1]
        if not _STATE.isdisjoint(parts):
            continue
        if name == "article":
            if first in _NO_ARTICLE:
                return _HARD
        elif first in _COMMENT or last in _COMMENT:
            return _HARD
        elif first in _FIRST or last in _LAST or not article and (first in _WEAK or last in _WEAK):
            kind = _SOFT
    return kind


def blocks(html: str) -> list[tuple[str, int, int, bool, bool]]:
    """(text, characters in links, container, boilerplate by structure, inside an article) of each block with text."""
    found: list[tuple[str, int, int, bool, bool, int]] = []
    stack: list[tuple[str, int, bool, bool, int]] = [("", 0, False, False, 0)]  # name, container, boilerplate, article, named container
    parts: list[str] = []
    linked, containers, in_link, in_head = 0, 0, 0, False
    nested: Counter[str] = Counter()
    parents, layouts, articles, around = [0], [True], [0], [0]  # of containers that are boilerplate by their name
    open_articles = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                _, container, boilerplate, article, named = stack[-1]
                found.append((text, linked, container, boilerplate, article, named))
            parts.clear()
        linked = 0

    for kind, name, rest in scan(html):
        if kind == "text":
            if not in_head:
                text = unescape(rest)
                parts.append(text)
                if in_link:
                    linked += len("".join(text.split()))
            continue
        if name == "a":
            in_link = 1 if kind == "open" else 0
        elif name == "br":
            parts.append("\n")
        elif name == "head":
            flush()
            in_head = kind == "open"
        elif name in BLOCK or name in CONTAINERS:
            flush()
            in_link = 0
            if name == "body":
                in_head = False
            if name not in CONTAINERS or name in VOID:
                continue
            if kind == "open":
                _, container, boilerplate, article, named = stack[-1]
                by = 0 if boilerplate else _boilerplate(name, rest, article)
                boilerplate = boilerplate or by == _HARD
                if by == _SOFT:
                    parents.append(named)
                    layouts.append(False)
                    articles.append(0)
                    around.append(open_articles)
                    named = len(parents) - 1
                if name in ("article", "main"):
                    article = True
                if name in ("article", "main") and not boilerplate:
                    articles[named] += 1
                    open_articles += 1
                    layouts[named] |= name == "main"
                if boilerplate or by or name in ("article", "main", "section", "body"):
                    containers += 1
                    container = containers
                stack.append((name, container, boilerplate, article, named))
                nested[name] += 1
            elif nested[name]:
                while True:
                    closed, _, boilerplate, _, _ = stack.pop()
                    nested[closed] -= 1
                    open_articles -= closed in ("article", "main") and not boilerplate
                    if closed == name:
                        break
    flush()
    # names of containers that hold most of the page are those of a layout; inner ones come after outer ones
    held = [0] * len(parents)
    for text, _, _, boilerplate, _, named in found:
        held[named] += 0 if boilerplate else len(text)
    for i in range(len(parents) - 1, 0, -1):
        held[parents[i]] += held[i]
        layouts[parents[i]] |= layouts[i]
        articles[parents[i]] += articles[i]
    out = [False] * len(parents)
    for i in range(1, len(parents)):
        out[i] = out[parents[i]] or not (layouts[i] or articles[i] + around[i] == articles[0] and 2 * held[i] > held[0])
    return [(text, linked, container, boilerplate or out[named], article) for text, linked, container, boilerplate, article, named in found]


def _first_pass(block: tuple[str, int, int, bool, bool]) -> bool | None:
    """True for main text, False for boilerplate, None for undecided."""
    text, linked, _, boilerplate, _ = block
    if boilerplate:
        return False
    if linked > LINK_SHARE * len("".join(text.split())):
        return False
    if len(text) < SHORT_CHARS:
        return None
    words = text.lower().split()
    share = sum(word.strip(".,;:!?()\"'") in STOP_WORDS for word in words) / len(words)
    if share >= STOP_SHARE:
        return True if len(text) >= LONG_CHARS or share >= 2 * STOP_SHARE else None
    return None


def _nearest(labels: list[bool | None], groups: list[int]) -> list[bool | None]:
    """The label of the nearest decided block of the same group, ties to True; None where the group has none."""
    size = len(labels)
    out: list[bool | None] = [None] * size
    gap = [0] * size
    for order in (range(size), range(size - 1, -1, -1)):
        last: dict[int, tuple[int, bool]] = {}
        for i in order:
            if labels[i] is not None:
                last[groups[i]] = (i, labels[i])
            elif groups[i] in last:
                j, label = last[groups[i]]
                if out[i] is None or abs(i - j) < gap[i] or abs(i - j) == gap[i] and label:
                    out[i], gap[i] = label, abs(i - j)
    return out


def main_text(html: str | None) -> str:
    """The main-text blocks of a page in order, joined by a newline."""
    if not html:
        return ""
    found = blocks(html)
    labels = [_first_pass(block) for block in found]
    inner = _nearest(labels, [block[2] for block in found])
    outer = _nearest(labels, [0] * len(found))
    kept = []
    for block, label, near, far in zip(found, labels, inner, outer, strict=True):
        if label is None:
            label = near if near is not None else True if block[4] else far
        if label:
            kept.append(block[0])
    return "\n".join(kept)


def extract(df: DataFrame, html_col: str = "html", id_col: str = "page_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """The id column, the columns of ``keep``, and ``text``: the main text of each row's html. No shuffle."""
    names = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [main_text(html) for html in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(texts, pa.string())], names=[*names, "text"])

    schema = T.StructType([*(T.StructField(n, df.schema[n].dataType) for n in names), T.StructField("text", T.StringType(), False)])
    return df.select(*(F.col(n) for n in names), F.col(html_col).cast("string").alias("__html")).mapInArrow(run, schema)


def op8_html(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    from ._support import table

    return extract(table(spark, sf_dir, "pages"), keep=("url",)).withColumn("n_chars", F.length("text").cast("long"))
