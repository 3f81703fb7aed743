"""Specifications in a JSON text, found in one pass over its events: no value is built.

The scanner keeps one entry for each open object or list, so its memory grows with the depth of
a text and not with its size. Members and items that are scalars are passed over in runs."""

from __future__ import annotations

import json
import re

#: The members that make a specification, and what each begins with.
MEMBERS = {"openapi": '"', "info": "{", "paths": "{"}

_SPACE = r"[ \t\n\r]*+"
_PLAIN = r'[^"\\\x00-\x1f]*+'
_STRING = rf'"{_PLAIN}(?:\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{{4}}){_PLAIN})*+"'
_SCALAR = rf"(?:{_STRING}|-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][-+]?[0-9]++)?|true|false|null|NaN|-?Infinity)"
_OTHER_KEY = rf'"(?!(?:{"|".join(MEMBERS)})"){_PLAIN}"'
#: So many members or items are passed over at once, which bounds what the matcher holds.
_RUN = 1000

_blank = re.compile(_SPACE)
_scalar = re.compile(_SCALAR)
_key = re.compile(rf"({_STRING}){_SPACE}:{_SPACE}")
_members = re.compile(rf"(?:{_OTHER_KEY}{_SPACE}:{_SPACE}{_SCALAR}{_SPACE},{_SPACE}){{0,{_RUN}}}+")
_items = re.compile(rf"(?:{_SCALAR}{_SPACE},{_SPACE}){{0,{_RUN}}}+")


def _past(run: re.Pattern, text: str, at: int) -> int:
    while (end := run.match(text, at).end()) > at:
        at = end
    return at


def candidates(text: str) -> tuple[int, tuple[int, int] | None] | None:
    """How many specifications the JSON value at the start of ``text`` holds, nested ones too,
    and where the first that ends stands. None if no JSON value stands there; what follows it
    is ignored. Of members of one name the last counts."""
    # open objects and lists: where it begins, its closing mark, name of the member being read, which members fit
    opened: list[list] = []
    n, first, at = 0, None, 0
    while True:
        mark = text[at : at + 1]
        if mark == "{" or mark == "[":
            opened.append([at, "}" if mark == "{" else "]", None, {}])
            at = _blank.match(text, at + 1).end()
            ended = text[at : at + 1] == opened[-1][1]
        else:
            m = _scalar.match(text, at)
            if not m:
                return None
            ended, at = True, m.end()
            if not opened:
                return n, first
            _note(opened[-1], mark)
            at = _blank.match(text, at).end()
            ended = text[at : at + 1] != ","
            if not ended:
                at = _blank.match(text, at + 1).end()
        while ended:
            begin, close, _, fits = opened[-1]
            if text[at : at + 1] != close:
                return None
            opened.pop()
            at += 1
            if close == "}" and all(fits.get(k) for k in MEMBERS):
                n += 1
                first = first or (begin, at)
            if not opened:
                return n, first
            _note(opened[-1], text[begin])
            at = _blank.match(text, at).end()
            ended = text[at : at + 1] != ","
            if not ended:
                at = _blank.match(text, at + 1).end()
        if opened[-1][1] == "]":
            at = _past(_items, text, at)
            continue
        at = _past(_members, text, at)
        m = _key.match(text, at)
        if not m:
            return None
        name = json.loads(m[1]) if "\\" in m[1] else m[1][1:-1]
        opened[-1][2] = name if name in MEMBERS else None
        at = m.end()


def _note(holder: list, mark: str) -> None:
    """A value that begins with ``mark`` has been read in ``holder``."""
    if holder[2] is not None:
        holder[3][holder[2]] = mark == MEMBERS[holder[2]]
