"""License scans: an Aho-Corasick automaton and a parser of licence expressions.

A text's words (A-Z lower-cased; runs of ASCII letters, digits and non-ASCII
characters) are joined by single blanks, so a phrase is an occurrence of
``" w1 w2 "``. One automaton finds all phrases and the identifier tag
``spdx license identifier`` in a single pass. Where the tag occurs, the
expression after it is taken from the original text and evaluated by a
shunting-yard parser: ``AND`` requires all operands, ``OR`` any, ``WITH`` adds an
exception to one licence and binds tightest; parentheses group.

Null and empty texts have no words, no labels and score 0. Repeated rows give equal rows, an
empty table none. Time is linear in a text's length.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import to_text, tune

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notice phrases of the method, with how sure each makes us of a licence statement.
NOTICES = {
    "released under the mit license": ("mit", 0.95),
    "mit license": ("mit", 0.8),
    "permission is hereby granted free of charge": ("mit", 0.9),
    "apache license": ("apache", 0.85),
    "licensed under the apache license version 2 0": ("apache-2.0", 0.95),
    "gnu general public license version 2": ("gpl-2.0", 0.95),
    "gnu general public license version 3": ("gpl-3.0", 0.95),
    "gnu lesser general public license": ("lgpl", 0.95),
    "gnu affero general public license": ("agpl", 0.95),
    "mozilla public license": ("mpl", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "bsd 3 clause": ("bsd-3-clause", 0.85),
    "bsd 2 clause": ("bsd-2-clause", 0.85),
    "eclipse public license": ("epl", 0.9),
    "boost software license": ("bsl-1.0", 0.9),
    "creative commons attribution": ("cc-by", 0.9),
    "cc by sa": ("cc-by-sa", 0.8),
    "cc by nc": ("cc-by-nc", 0.8),
    "cc by nd": ("cc-by-nd", 0.8),
    "cc by nc sa": ("cc-by-nc-sa", 0.85),
    "cc0 1 0": ("cc0", 0.9),
    "public domain dedication": ("public-domain", 0.8),
    "the unlicense": ("unlicense", 0.7),
}
_SURE = {"cc by": 0.7, "general public license": 0.8, "all rights reserved": 0.6}
_TAG = "spdx license identifier"
_TAG_RE = re.compile(r"spdx-license-identifier:[\x20\t]*([^\r\n]*)", re.I | re.A)
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+_:-]+|[^\x20\t]")
_IDENT = re.compile(r"[A-Za-z0-9][A-Za-z0-9.+_:-]*")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}


@dataclass(eq=False)
class Node:
    """A licence, or an operator (``and``, ``or``) over nodes."""

    name: str
    kids: list = field(default_factory=list)

    def leaves(self) -> list[Node]:
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            todo += reversed(n.kids)
            if not n.kids:
                out.append(n)
        return out

    def __iter__(self):
        """The alternatives, one by one, as sets that hold together; their number may be exponential."""
        if not self.kids:
            yield frozenset([self.name])
        elif self.name == "or":
            for k in self.kids:
                yield from k
        else:
            for some in product(*self.kids):
                yield frozenset().union(*some)

    def __str__(self) -> str:
        """Every operand once, in the order of the text; an ``or`` within an ``and`` in parentheses."""
        done: dict[int, str] = {}
        todo = [self]
        while todo:
            n = todo[-1]
            missing = [k for k in n.kids if id(k) not in done]
            if missing:
                todo += missing
                continue
            todo.pop()
            parts = dict.fromkeys(f"({done[id(k)]})" if n.name == "and" and k.name == "or" and k.kids and " or " in done[id(k)] else done[id(k)] for k in n.kids)
            done[id(n)] = f" {n.name} ".join(parts) if n.kids else n.name
        return done[id(self)]


def _join(op: str, a: Node, b: Node) -> Node:
    if op == "with":
        exception = str(b)
        for n in a.leaves():
            n.name += f" with {exception}"
        return a
    if a.name == op and a.kids:
        a.kids += b.kids if b.name == op and b.kids else [b]
        return a
    return Node(op, [a, *(b.kids if b.name == op and b.kids else [b])])


def evaluate(expression: str) -> tuple[frozenset[str], Node] | None:
    """Shunting-yard evaluation: all licences, and the tree that says which hold together.

    The longest valid prefix is taken, so a comment's end or prose after the
    expression does no harm. None if no identifier begins the expression. ``WITH`` after a
    bracket adds its exception to each licence inside.
    """
    taken: list[str] = []
    depth, whole, need = 0, 0, True
    for m in _TOKEN.finditer(expression):
        t = m[0]
        low = t.lower()
        if need and t == "(":
            depth += 1
        elif need and low not in _PRECEDENCE and _IDENT.fullmatch(t):
            need = False
        elif not need and low in _PRECEDENCE:
            need = True
        elif not need and t == ")" and depth:
            depth -= 1
        else:
            break
        taken.append(low)
        if not need and not depth:
            whole = len(taken)
    if not whole:
        return None
    output: list[Node] = []
    stack: list[str] = []

    def apply() -> None:
        b, a = output.pop(), output.pop()
        output.append(_join(stack.pop(), a, b))

    for t in taken[:whole]:
        if t == "(":
            stack.append(t)
        elif t == ")":
            while stack[-1] != "(":
                apply()
            stack.pop()
        elif t in _PRECEDENCE:
            while stack and stack[-1] != "(" and _PRECEDENCE[stack[-1]] >= _PRECEDENCE[t]:
                apply()
            stack.append(t)
        else:
            output.append(Node(t.rstrip(".:")))
    while stack:
        apply()
    return frozenset([n.name for n in output[0].leaves()]), output[0]


_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def _automaton():
    a = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, _TAG}:
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


_AUTOMATON = None


def scan_text(text: str, automaton=None) -> dict:
    global _AUTOMATON
    automaton = automaton or _AUTOMATON
    if automaton is None:
        automaton = _AUTOMATON = _automaton()
    words = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split(b" ")
    words = [w for w in words if w]
    joined = " " + b" ".join(words).decode("utf-8", "surrogatepass") + " "
    n_base, first, last, base, labels, unsure, tag = 0, None, None, set(), set(), 1.0, False
    blanks = until = 0  # of the joined words before where the last hit ended
    for end, phrase in automaton.iter(joined):
        if phrase in BASE:
            blanks, until = blanks + joined.count(" ", until, end), end
            at = blanks - phrase.count(" ") - 1  # the phrase's place, counted in words
            n_base += 1
            first = at if first is None else min(first, at)
            last = at if last is None else max(last, at)
            base.add(BASE[phrase])
            labels.add(BASE[phrase])
            unsure = min(unsure, 1 - _SURE[phrase])
        elif phrase == _TAG:
            tag = True
        else:
            label, sure = NOTICES[phrase]
            labels.add(label)
            unsure = min(unsure, 1 - sure)
    found: list[str] = []
    if tag:
        for m in _TAG_RE.finditer(text):
            got = evaluate(m[1])
            if got:
                labels |= got[0]
                unsure = 0.0
                found.append(str(got[1]))
    expression = "; ".join(found) if found else None
    return {"n_words": len(words), "n_base": n_base, "first_word": first, "last_word": last, "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": 1 - unsure if labels else 0.0, "expression": expression}


SCHEMA = pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("expression", pa.string())])


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each input row: words, base phrases, labels, score, evaluated tag expressions."""

    @F.arrow_udf("struct<n_words:long,n_base:long,first_word:long,last_word:long,base_labels:string,labels:string,score:double,expression:string>")
    def scan(t: pa.Array) -> pa.Array:
        a = _automaton()
        return pa.array([scan_text(x.as_py(), a) for x in t], SCHEMA)

    tune(docs.sparkSession)
    return docs.select(F.col(doc_id).alias("doc_id"), scan(to_text(text)).alias("r")).select("doc_id", "r.*")
