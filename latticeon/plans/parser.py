"""Recursive-descent parser: one expression grammar for SELECT lists, WHERE, HAVING and ORDER BY."""

from __future__ import annotations

from .ast import *  # noqa: F403
from .ast import Between, Bin, Call, Case, Chain, EdgePattern, In, IsNull, JsonPath, Like, ListLit, Lit, Name, Neg, NodePattern, Not, PathPredicate, Select, Star, Table
from .errors import ParamOutOfRange, ParamTypeMismatch, QueryError
from .lexer import tokenize

_RESERVED = {"FROM", "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET", "AND", "OR", "AS", "ASC", "DESC", "UNION", "MATCH", "RETURN", "WITH", "THEN", "WHEN", "ELSE", "END", "BETWEEN", "IN", "LIKE", "ILIKE", "IS", "NOT", "BY", "ON", "USING"}
_COMPARE = {"=", "!=", "<>", "<", "<=", ">", ">="}
_VECTOR = {"<=>", "<->", "<#>", "<+>"}


class Parser:
    def __init__(self, sql: str, params=None):
        self.toks, self.i, self.params = tokenize(sql), 0, params

    # ── tokens ──
    def peek(self, k: int = 0):
        return self.toks[min(self.i + k, len(self.toks) - 1)]

    def take(self):
        t = self.toks[self.i]
        self.i += 1
        return t

    def fail(self, wanted: str):
        kind, v, at = self.peek()
        raise QueryError(f"expected {wanted}, found {'the end' if kind == 'end' else repr(v)} at {at}")

    def is_word(self, *words: str, k: int = 0) -> bool:
        kind, v, _ = self.peek(k)
        return kind == "name" and v.upper() in words

    def word(self, *words: str) -> bool:
        if self.is_word(*words):
            self.i += 1
            return True
        return False

    def need(self, *words: str):
        for w in words:
            if not self.word(w):
                self.fail(w)

    def is_op(self, *ops: str, k: int = 0) -> bool:
        kind, v, _ = self.peek(k)
        return kind == "op" and v in ops

    def op(self, *ops: str) -> bool:
        if self.is_op(*ops):
            self.i += 1
            return True
        return False

    def need_op(self, o: str):
        if not self.op(o):
            self.fail(repr(o))

    def name(self) -> str:
        kind, v, _ = self.peek()
        if kind != "name":
            self.fail("a name")
        self.i += 1
        return v

    def end(self):
        self.op(";")
        if self.peek()[0] != "end":
            self.fail("the end of the statement")

    def param(self, n: int):
        if self.params is None or n > len(self.params):
            raise ParamOutOfRange(f"${n} has no value")
        return self.params[n - 1]

    def integer(self) -> int:
        kind, v, _ = self.take()
        if kind == "param":
            v = self.param(v)
            if isinstance(v, bool) or not isinstance(v, (int, float)) or v != int(v):
                raise ParamTypeMismatch("a whole number is needed")
            return int(v)
        if kind != "number" or v != int(v):
            self.i -= 1
            self.fail("a whole number")
        return int(v)

    def text(self) -> str:
        kind, v, _ = self.take()
        if kind == "param":
            v = self.param(v)
            if not isinstance(v, str):
                raise ParamTypeMismatch("a text is needed")
            return v
        if kind != "text":
            self.i -= 1
            self.fail("a text")
        return v

    def value(self):
        """A literal, for statements that change data."""
        e = self.unary()

        def plain(x):
            if isinstance(x, Lit):
                return x.value
            if isinstance(x, ListLit):
                return [plain(y) for y in x.items]
            if isinstance(x, Neg):
                return -plain(x.x)
            if isinstance(x, Call):
                return x
            raise QueryError("a literal is needed")

        return plain(e)

    # ── expressions ──
    def expression(self):
        e = self.conjunction()
        while self.word("OR"):
            e = Bin("OR", e, self.conjunction())
        return e

    def conjunction(self):
        e = self.negation()
        while self.word("AND"):
            e = Bin("AND", e, self.negation())
        return e

    def negation(self):
        return Not(self.negation()) if self.word("NOT") else self.comparison()

    def comparison(self):
        e = self.sum()
        if self.peek()[0] == "op" and self.peek()[1] in _COMPARE:
            o = self.take()[1]
            if o == "=" and self.is_word("ANY") and self.is_op("(", k=1):
                self.i += 2
                if self.peek()[0] == "param":
                    v = self.param(self.take()[1])
                else:
                    v = [x.value for x in self.unary().items]
                self.need_op(")")
                return In(e, tuple(v)) if isinstance(v, (list, tuple)) else Bin("=", e, Lit(v))
            return Bin("!=" if o == "<>" else o, e, self.sum())
        if self.op("@>"):
            right = self.unary()
            items = right.items if isinstance(right, ListLit) else right.value
            return Call("ARRAY_CONTAINS_ALL", (e, ListLit(tuple(x if isinstance(x, Lit) else Lit(x) for x in items))))
        negated = self.word("NOT")
        if self.word("BETWEEN"):
            low = self.sum()
            self.need("AND")
            got = Between(e, low, self.sum())
            return Not(got) if negated else got
        if self.word("IN"):
            self.need_op("(")
            items = [self.value()]
            while self.op(","):
                items.append(self.value())
            self.need_op(")")
            return In(e, tuple(y for x in items for y in (x if isinstance(x, list) else [x])), negated)
        if self.is_word("LIKE", "ILIKE"):
            ci = self.take()[1].upper() == "ILIKE"
            return Like(e, self.text(), ci, negated)
        if self.word("IS"):
            no = self.word("NOT")
            self.need("NULL")
            return IsNull(e, no)
        if negated:
            self.fail("BETWEEN, IN or LIKE")
        return e

    def sum(self):
        e = self.product()
        while self.is_op("+", "-") or (self.is_op(*_VECTOR)):
            o = self.take()[1]
            e = Call("VECTOR" + o, (e, self.product())) if o in _VECTOR else Bin(o, e, self.product())
        return e

    def product(self):
        e = self.unary()
        while self.is_op("*", "/"):
            e = Bin(self.take()[1], e, self.unary())
        return e

    def unary(self):
        if self.op("-"):
            x = self.unary()
            return Lit(-x.value) if isinstance(x, Lit) and isinstance(x.value, (int, float)) else Neg(x)
        return self.postfix()

    def postfix(self):
        e = self.primary()
        keys, text = [], False
        while self.is_op("->", "->>") and self.peek(1)[0] in ("text", "number"):
            text = self.take()[1] == "->>"
            keys.append(self.take()[1])
            if text:
                break
        return JsonPath(e, tuple(keys), text) if keys else e

    def primary(self):
        kind, v, _ = self.peek()
        if kind in ("number", "text"):
            self.i += 1
            return Lit(v)
        if kind == "param":
            self.i += 1
            got = self.param(v)
            return ListLit(tuple(Lit(x) for x in got)) if isinstance(got, (list, tuple)) else Lit(got)
        if self.op("("):
            e = self.expression()
            self.need_op(")")
            return e
        if self.op("["):
            items = []
            while not self.op("]"):
                items.append(self.unary())
                self.op(",")
            return ListLit(tuple(items))
        if self.op("*"):
            return Star()
        if kind != "name":
            self.fail("an expression")
        up = v.upper()
        if up in ("TRUE", "FALSE", "NULL"):
            self.i += 1
            return Lit({"TRUE": True, "FALSE": False, "NULL": None}[up])
        if up == "CASE":
            return self.case()
        if self.is_op("(", k=1):
            self.i += 2
            if up == "POINT":
                lon, lat = self.unary().value, self.unary().value
                self.need_op(")")
                return Call("POINT", (float(lon), float(lat)))
            if up == "POLYGON":
                self.need_op("(")
                ring = []
                while not self.op(")"):
                    ring.append((float(self.unary().value), float(self.unary().value)))
                    self.op(",")
                self.need_op(")")
                return Call("POLYGON", tuple(ring))
            if up in ("ANY", "ALL", "NONE", "SINGLE") and self.is_word("IN", k=1):
                var = self.name()
                self.need("IN")
                if self.name().lower() != "nodes":
                    self.fail("nodes(...)")
                self.need_op("(")
                path = self.name()
                self.need_op(")")
                self.need("WHERE")
                cond = self.expression()
                self.need_op(")")
                return PathPredicate(up, var, path, cond)
            distinct = self.word("DISTINCT")
            args = []
            while not self.op(")"):
                args.append(self.expression())
                self.op(",")
            return Call(up, tuple(args), distinct)
        if up in _RESERVED:
            self.fail("an expression")
        self.i += 1
        parts = [v]
        while self.is_op(".") and self.peek(1)[0] == "name":
            self.i += 1
            parts.append(self.name())
        if self.is_op(".") and self.is_op("*", k=1):
            self.i += 2
            parts.append("*")
        return Name(tuple(parts))

    def case(self):
        self.need("CASE")
        whens, other = [], Lit(None)
        while self.word("WHEN"):
            c = self.expression()
            self.need("THEN")
            whens.append((c, self.sum()))
        if self.word("ELSE"):
            other = self.sum()
        self.need("END")
        return Case(tuple(whens), other)

    # ── patterns ──
    def node(self) -> NodePattern:
        self.need_op("(")
        n = NodePattern()
        if self.peek()[0] in ("text", "param"):
            n.slug = self.text()
        else:
            if self.peek()[0] == "name" and not self.is_word("WHERE"):
                n.var = self.name()
            if self.op(":"):
                n.label = self.name()
            if self.op("{"):
                while not self.op("}"):
                    key = self.name()
                    self.need_op(":")
                    n.props[key] = self.value()
                    self.op(",")
            if self.word("WHERE"):
                n.where = self.expression()
        self.need_op(")")
        return n

    def edge(self) -> EdgePattern:
        e = EdgePattern(backward=self.op("<-"))
        if not e.backward:
            self.need_op("-")
        if self.op("["):
            if self.peek()[0] == "name":
                e.var = self.name()
            if self.op(":"):
                e.type = self.name()
            if self.op("*"):
                if self.peek()[0] in ("number", "param"):
                    e.low = e.high = self.integer()
                    if self.op(".."):
                        e.high = self.integer()
            self.props = {}
            if self.op("{"):
                while not self.op("}"):
                    key = self.name()
                    self.need_op(":")
                    self.props[key] = self.value()
                    self.op(",")
            self.need_op("]")
        self.need_op("-") if e.backward else self.need_op("->")
        return e

    def chain(self) -> Chain:
        c = Chain([], [], self.word("SHORTEST"))
        c.nodes.append(self.node())
        while self.is_op("-", "<-"):
            c.edges.append(self.edge())
            c.nodes.append(self.node())
        return c

    # ── queries ──
    def items(self) -> list:
        out = []
        while True:
            e = self.expression()
            alias = self.name() if self.word("AS") else None
            out.append((e, alias))
            if not self.op(","):
                return out

    def source(self):
        if self.word("MATCH"):
            return self.chain()
        t = Table(self.name())
        if self.word("AS"):
            t.alias = self.name()
        return t

    def query(self) -> Select:
        if self.word("MATCH"):
            return self.match_query()
        self.need("SELECT")
        distinct = self.word("DISTINCT")
        items = self.items()
        self.need("FROM")
        q = Select(items, [self.source()], distinct)
        while self.op(","):
            q.sources.append(self.source())
        if self.word("WHERE"):
            q.where = self.expression()
        self.stages(q)
        self.tail(q)
        return q

    def stages(self, q: Select):
        while self.word("WITH"):
            items = self.items()
            self.need("MATCH")
            chain = self.chain()
            q.stages.append((items, chain, self.expression() if self.word("WHERE") else None))

    def match_query(self) -> Select:
        q = Select([], [self.chain()], match_return=True)
        if self.word("WHERE"):
            q.where = self.expression()
        self.stages(q)
        if self.word("UNION"):
            self.need("MATCH")
            q.union.append(self.match_query())
            q.items = q.union[-1].items
            return q
        self.need("RETURN")
        q.items = self.items()
        if self.word("UNION"):
            self.need("MATCH")
            q.union.append(self.match_query())
            return q
        self.tail(q)
        return q

    def tail(self, q: Select):
        if self.word("GROUP"):
            self.need("BY")
            q.group.append(self.postfix())
            while self.op(","):
                q.group.append(self.postfix())
        if self.word("HAVING"):
            q.having = self.expression()
        if self.word("ORDER"):
            self.need("BY")
            while True:
                e = self.sum()
                asc = True if self.word("ASC") else False if self.word("DESC") else None
                q.order.append((e, asc))
                if not self.op(","):
                    break
        while self.is_word("LIMIT", "OFFSET"):
            if self.word("LIMIT"):
                q.limit = self.integer()
            else:
                self.need("OFFSET")
                q.offset = self.integer()


def parse_query(sql: str, params=None) -> Select:
    p = Parser(sql, params)
    q = p.query()
    p.end()
    return q
