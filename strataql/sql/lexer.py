"""Tokens of the dialect, and the division of scripts into statements."""

from __future__ import annotations

import re
from dataclasses import dataclass

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?(?:\*/|\Z))
      | (?P<blob>[xX]'(?:[0-9a-fA-F]{2})*')
      | (?P<text>'(?:[^']|'')*')
      | (?P<name>"(?:[^"]|"")*"|`(?:[^`]|``)*`|\[[^\]]*\]|[^\W\d][\w$]*)
      | (?P<real>(?:\d[\d_]*\.\d*|\.\d+)(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+)
      | (?P<int>0[xX][0-9a-fA-F]+|\d[\d_]*)
      | (?P<param>\?\d*|[:@$][\w]+)
      | (?P<op><->|->>|->|\|\||<<|>>|<=|>=|<>|!=|==|@@|[-+*/%&|~<>=(),.;])""",
    re.X | re.S,
)


class SqlError(ValueError):
    """A statement that the dialect doesn't have."""


@dataclass
class Token:
    kind: str  # name, quoted, text, blob, int, real, param, op, end
    value: str
    at: int

    @property
    def word(self) -> str:
        return self.value.upper() if self.kind == "name" else ""


def tokens(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise SqlError(f"unrecognized token at {sql[at : at + 20]!r}")
        kind, value = m.lastgroup, m[0]
        if kind == "name" and value[0] in '"`[':
            close = "]" if value[0] == "[" else value[0]
            kind, value = "quoted", value[1:-1].replace(close * 2, close)
        elif kind == "text":
            value = value[1:-1].replace("''", "'")
        elif kind == "blob":
            value = value[2:-1]
        if kind != "space":
            out.append(Token(kind, value, at))
        at = m.end()
    return [*out, Token("end", "", at)]


def statements(script: str) -> list[str]:
    """The statements of a script, without their semicolons."""
    out, start = [], 0
    for t in tokens(script):
        if t.kind == "end" or (t.kind == "op" and t.value == ";"):
            if part := script[start : t.at].strip():
                out.append(part)
            start = t.at + 1
    return out
