"""Splits texts by a token pattern, quickly where the characters allow it."""

from __future__ import annotations

import re

import regex

#: characters below this have classes that all Unicode versions in use agree on
_LIMIT = 0x250
_BEYOND = re.compile(f"[^\x00-{chr(_LIMIT - 1)}]").search
_CLASS = regex.compile(r"\\(p\{L\}|p\{N\}|s|S)|\\.|\[\^?|\]", regex.S)


def is_plain(text: str) -> bool:
    return _BEYOND(text) is None


def _members(name: str) -> str:
    matches = regex.compile("\\" + name).match
    return "".join(re.escape(chr(c)) for c in range(_LIMIT) if matches(chr(c)))


def plain_pattern(pattern: str) -> str | None:
    """``pattern`` for the standard module on plain texts; None if it says more than that module knows."""
    out, at, inside = [], 0, False
    for found in _CLASS.finditer(pattern):
        out.append(pattern[at : found.start()])
        at, token, name = found.end(), found[0], found[1]
        if token[0] == "[":
            inside = True
        elif token == "]":
            inside = False
        elif name == "S":
            if inside:
                return None
            token = f"[^{_members('s')}]"
        elif name:
            token = _members(name) if inside else f"[{_members(name)}]"
        elif token[1].isalnum():
            return None
        out.append(token)
    return "".join([*out, pattern[at:]])


class Splitter:
    """All matches of a pattern in a text, in order."""

    def __init__(self, pattern: str):
        self._any = regex.compile(pattern).findall
        plain = plain_pattern(pattern)
        self._plain = re.compile(plain).findall if plain else self._any

    def __call__(self, text: str) -> list[str]:
        return self._plain(text) if is_plain(text) else self._any(text)
