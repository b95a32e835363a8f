"""Tokens of a dialect's surface."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from ..config import SurfaceSpec
from ..errors import ParseError

_COMMENTS = {"--": r"--[^\n]*", "#": r"\#[^\n]*", "//": r"//[^\n]*", "/**/": r"/\*(?:[^*]|\*(?!/))*\*/"}
_STRINGS = {"single": ("'", r"'(?:[^']|'')*'"), "double": ('"', r'"(?:[^"]|"")*"'), "backtick": ("`", r"`(?:[^`]|``)*`")}
_QUOTED = {"double": r'"[^"]+"', "backtick": r"`[^`]+`", "bracket": r"\[[^\]]+\]"}


@dataclass(frozen=True)
class Token:
    kind: str  # word, quoted, string, number, op, end
    text: str
    at: int

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "word" else ""


class _Key:
    """A surface as a cache key; surfaces hold dicts and are compared by identity of their content's text."""

    def __init__(self, surface: SurfaceSpec):
        self.surface, self.text = surface, repr(surface)

    def __hash__(self) -> int:
        return hash(self.text)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Key) and self.text == other.text


@lru_cache(maxsize=256)
def _pattern(key: _Key) -> re.Pattern:
    s = key.surface
    ops = {"(", ")", ",", ".", s.wildcard}
    for role in ("eq", "neq", "lt", "lte", "gt", "gte", "add", "sub", "mul", "div", "mod", "concat", "null_safe_eq"):
        ops |= {o for o in s.spellings(role) if not re.match(r"\w", o)}
    if s.cast_syntax == "double_colon":
        ops.add("::")
    if s.limit_syntax == "head_n":
        ops.add("|")
    if s.terminator:
        ops.add(s.terminator)
    comments = [_COMMENTS[c] for c in s.comments if c not in ops]
    parts = [r"(?P<space>\s+)"]
    if comments:
        parts.append(f"(?P<comment>{'|'.join(comments)})")
    parts.append(f"(?P<string>{_STRINGS[s.string_quote][1]})")
    if s.identifier_quote != s.string_quote:
        parts.append(f"(?P<quoted>{_QUOTED[s.identifier_quote]})")
    parts.append(r"(?P<number>\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)")
    parts.append(r"(?P<word>[A-Za-z_]\w*)")
    parts.append("(?P<op>" + "|".join(re.escape(o) for o in sorted(ops, key=len, reverse=True)) + ")")
    return re.compile("|".join(parts))


def tokens(sql: str, surface: SurfaceSpec) -> list[Token]:
    pattern, out, at = _pattern(_Key(surface)), [], 0
    quote = _STRINGS[surface.string_quote][0]
    while at < len(sql):
        m = pattern.match(sql, at)
        if not m:
            raise ParseError(f"unexpected {sql[at]!r} at character {at + 1}")
        kind, text = m.lastgroup, m.group()
        if kind == "string":
            out.append(Token("string", text[1:-1].replace(quote * 2, quote), at))
        elif kind == "quoted":
            out.append(Token("quoted", text[1:-1], at))
        elif kind not in ("space", "comment"):
            out.append(Token(kind, text, at))
        at = m.end()
    out.append(Token("end", "", len(sql)))
    return out
