"""A linear scan of HTML into tags and text; shared by main-text extraction and interleaved sequences."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Elements whose content is never read as markup or text.
_RAW = "script|style|noscript|template|iframe|svg|canvas|object|textarea|select|title"
#: Attributes whose quoted values hold neither < nor >: no alternative runs over the next tag's start, so the scan stays linear.
_PLAIN = r"(?:[^<>\"']++|\"[^\"<>]*+\"|'[^'<>]*+')*+"
_NAME_ENDS = r"(?=[\s/>])"
_TOKEN = re.compile(
    # comments, empty ones too; a drawing that ends at once; elements that aren't read
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<svg{_NAME_ENDS}{_PLAIN}(?<=/)>|<({_RAW}){_NAME_ENDS}{_PLAIN}>.*?(?:</\1{_NAME_ENDS}[^>]*+>|\Z)"
    # the last: the start of a tag whose end is looked for by _tag_end
    rf"|<(/?)([a-zA-Z][^\s/<>]*+)({_PLAIN})>|<[!?][^<>]*+>|</(?![a-zA-Z])[^<>]*+>|<(/?)([a-zA-Z][^\s/<>]*+)",
    re.DOTALL | re.IGNORECASE,
)
_SPECIAL = re.compile(r"[<>\"']")
_NAMELESS = re.compile(r"<[^<>]*+>")
_RAW_ENDS = {name: re.compile(rf"</{name}{_NAME_ENDS}[^>]*+>", re.IGNORECASE) for name in _RAW.split("|")}
# a name begins where none is under way: long runs without "=" are read once
_ATTRIBUTE = re.compile(r"(?<![^\s=/\"'<>])([^\s=/\"'<>]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that begin and end a block.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)


def _tag_end(html: str, at: int, ends: dict[int, int]) -> int:
    """Where the > is that ends a tag, from a position outside quotes; -1 if a < outside quotes or the end of the page comes first.

    ``ends`` keeps the answer for each position passed, so that no stretch is read again for a later tag.
    """
    passed = []
    while (end := ends.get(at)) is None:
        passed.append(at)
        found = _SPECIAL.search(html, at)
        if not found or found[0] == "<":
            end = -1
            break
        if found[0] == ">":
            end = found.start()
            break
        closing = html.find(found[0], found.end())
        if closing < 0:
            end = -1
            break
        at = closing + 1
    for position in passed:
        ends[position] = end
    return end


def scan(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest) with kind "text" (rest: raw text), "open" (rest: attributes) or "close"."""
    at = look = 0  # at: the end of the last token
    ends: dict[int, int] = {}
    while found := _TOKEN.search(html, look):
        begin, look = found.span()
        closing, name, rest = found[2], found[3], found[4]
        if found[6]:
            closing, name = found[5], found[6]
            raw = None if closing else _RAW_ENDS.get(name.lower())
            end = _tag_end(html, look, ends)
            if end >= 0:
                rest, look = html[look:end], end + 1
                if raw and name.lower() == "svg" and rest.endswith("/"):
                    raw = name = None
            elif nameless := _NAMELESS.match(html, begin):
                name, look = None, nameless.end()
            else:
                continue
            if raw:
                name, last = None, raw.search(html, look)
                look = last.end() if last else len(html)
        if begin > at:
            yield "text", "", html[at:begin]
        at = look
        if name:
            yield ("close" if closing else "open"), name.lower(), rest or ""
    if at < len(html):
        yield "text", "", html[at:]


def attributes(rest: str) -> dict[str, str]:
    from html import unescape

    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(rest):  # of attributes with one name the first counts
        found.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return found
