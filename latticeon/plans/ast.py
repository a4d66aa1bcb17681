"""Syntax tree."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Lit:
    value: object


@dataclass(frozen=True)
class Name:
    """A field, or variable and field."""

    parts: tuple[str, ...]


@dataclass(frozen=True)
class Star:
    pass


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple = ()
    distinct: bool = False


@dataclass(frozen=True)
class Bin:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Not:
    x: object


@dataclass(frozen=True)
class Neg:
    x: object


@dataclass(frozen=True)
class Case:
    whens: tuple
    other: object


@dataclass(frozen=True)
class JsonPath:
    base: object
    keys: tuple
    text: bool


@dataclass(frozen=True)
class ListLit:
    items: tuple


@dataclass(frozen=True)
class In:
    x: object
    items: tuple
    negated: bool = False


@dataclass(frozen=True)
class Between:
    x: object
    low: object
    high: object


@dataclass(frozen=True)
class Like:
    x: object
    pattern: str
    ignore_case: bool
    negated: bool = False


@dataclass(frozen=True)
class IsNull:
    x: object
    negated: bool


@dataclass(frozen=True)
class PathPredicate:
    kind: str
    var: str
    path: str
    cond: object


@dataclass
class NodePattern:
    var: str | None = None
    label: str | None = None
    slug: str | None = None
    props: dict = field(default_factory=dict)
    where: object = None


@dataclass
class EdgePattern:
    var: str | None = None
    type: str | None = None
    low: int = 1
    high: int = 1
    backward: bool = False


@dataclass
class Chain:
    nodes: list
    edges: list
    shortest: bool = False


@dataclass
class Table:
    name: str
    alias: str | None = None


@dataclass
class Select:
    items: list  # (expression, alias)
    sources: list  # Table or Chain
    distinct: bool = False
    where: object = None
    stages: list = field(default_factory=list)  # (items, Chain, where)
    group: list = field(default_factory=list)
    having: object = None
    order: list = field(default_factory=list)  # (expression, ascending or None)
    limit: int | None = None
    offset: int | None = None
    match_return: bool = False
    union: list = field(default_factory=list)
