"""Tokens: (kind, value, place); kinds: name, text, number, param, op, end."""

from __future__ import annotations

import re

from .errors import QueryError

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*)
  | (?P<number>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?(?![\w/]))
  | (?P<text>'(?:[^']|'')*'|"(?:[^"]|"")*")
  | (?P<param>\$\d*)
  | (?P<name>[A-Za-z_0-9][\w/]*)
  | (?P<op>->>|<=>|<->|<\#>|<\+>|->|<-|<=|>=|<>|!=|\.\.|@>|[-+*/()\[\]{},.:;=<>])""",
    re.X,
)


def tokenize(sql: str) -> list[tuple[str, object, int]]:
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise QueryError(f"unexpected character {sql[at]!r} at {at}")
        kind, s = m.lastgroup, m[0]
        # 1..3 is two numbers and dots, not 1. and .3
        if kind == "number" and s.endswith(".") and sql[m.end() : m.end() + 1] == ".":
            s = s[:-1]
        at += len(s)
        if kind == "space":
            continue
        if kind == "number":
            value = float(s) if re.search("[.eE]", s) else int(s)
        elif kind == "text":
            value = s[1:-1].replace(s[0] * 2, s[0])
        elif kind == "param":
            if s in ("$", "$0"):
                raise QueryError("parameters are numbered from $1")
            value = int(s[1:])
        else:
            value = s
        out.append((kind, value, at - len(s)))
    out.append(("end", None, len(sql)))
    return out
