"""Statements that change or describe data: parsed to (kind, fields)."""

from __future__ import annotations

from .errors import QueryError
from .parser import Parser

INDEX_KINDS = {"btree", "hash", "gin", "gist", "bm25", "spatial", "hnsw", "search"}


class StatementParser(Parser):
    def statement(self):
        out = self._statement()
        self.end()
        return out

    def _statement(self):
        for w in ("BEGIN", "COMMIT", "ROLLBACK"):
            if self.word(w):
                return w.lower(), {}
        if self.word("INSERT"):
            return self._insert()
        if self.word("UPDATE"):
            name = self.name()
            self.need("SET")
            values = {}
            while True:
                field = self.name()
                self.need_op("=")
                values[field] = self.value()
                if not self.op(","):
                    break
            return "update", {"name": name, "values": values, "where": self.expression() if self.word("WHERE") else None}
        if self.word("DELETE"):
            if self.word("FROM"):
                return "delete", {"name": self.name(), "where": self.expression() if self.word("WHERE") else None}
            return "unlink", {"edges": self._edges()}
        if self.word("MATCH"):
            node = self.node()
            where = self.expression() if self.word("WHERE") else None
            self.need("INSERT")
            self.node()
            e = self.edge()
            props = dict(self.props)
            self.need_op("(")
            target = self.text() if self.peek()[0] in ("text", "param") else self.name()
            self.need_op(")")
            return "link_all", {"node": node, "where": where, "type": e.type, "props": props, "target": target}
        if self.word("CREATE"):
            return self._create_index() if self.word("INDEX") else self._create_table()
        if self.word("REINDEX"):
            self.need("ON")
            name = self.name()
            return "reindex", {"name": name, "using": self._using()}
        if self.word("DROP"):
            what = "index" if self.word("INDEX") else "table"
            if what == "table":
                self.need("TABLE")
            maybe = self.word("IF")
            if maybe:
                self.need("EXISTS")
            if what == "table":
                return "drop_table", {"name": self.name(), "if_exists": maybe}
            self.need("ON")
            return "drop_index", {"name": self.name(), "using": self._using(), "if_exists": maybe}
        if self.word("ALTER"):
            return self._alter()
        raise QueryError("unknown statement")

    def _edges(self):
        out = []
        while True:
            a = self.node()
            e = self.edge()
            props = dict(getattr(self, "props", {}))
            b = self.node()
            out.append((a.slug, b.slug, e.type, props))
            if not self.op(","):
                return out

    def _insert(self):
        if not self.word("INTO"):
            return "link", {"edges": self._edges()}
        name = self.name()
        self.need_op("(")
        fields = [self.name()]
        while self.op(","):
            fields.append(self.name())
        self.need_op(")")
        self.need("VALUES")
        rows = []
        while True:
            self.need_op("(")
            values = [self.value()]
            while self.op(","):
                values.append(self.value())
            self.need_op(")")
            if len(values) != len(fields):
                raise QueryError(f"{len(fields)} fields but {len(values)} values")
            rows.append(dict(zip(fields, values)))
            if not self.op(","):
                return "insert", {"name": name, "rows": rows}

    def _using(self):
        self.need("USING")
        kind = self.name().lower()
        if kind not in INDEX_KINDS:
            raise QueryError(f"unknown index kind {kind}")
        self.need_op("(")
        fields = [self.name()]
        while self.op(","):
            fields.append(self.name())
        self.need_op(")")
        return kind, fields

    def _create_index(self):
        if not self.word("ON"):
            self.name()
            self.need("ON")
        name = self.name()
        return "create_index", {"name": name, "using": self._using()}

    def _create_table(self):
        self.need("TABLE")
        if self.word("IF"):
            self.need("NOT", "EXISTS")
        name = self.name()
        self.need_op("(")
        fields = []
        while not self.op(")"):
            f = {"name": self.name(), "type": self.name().upper()}
            if f["type"] not in ("TEXT", "INTEGER", "REAL", "TIMESTAMPTZ", "GEO", "VECTOR", "JSON"):
                raise QueryError(f"unknown type {f['type']}")
            while not self.is_op(",", ")"):
                if self.word("PRIMARY"):
                    self.need("KEY")
                    f["primary"] = True
                elif self.word("NOT"):
                    self.need("NULL")
                    f["not_null"] = True
                elif self.word("DEFAULT"):
                    v = self.value()
                    f["default"] = (v.name, [a.value for a in v.args]) if hasattr(v, "args") else ("LIT", [v])
                else:
                    self.fail("a column option")
            fields.append(f)
            self.op(",")
        options = {}
        if self.word("WITH"):
            self.need_op("(")
            while not self.op(")"):
                key = self.name()
                self.need_op(":")
                options[key] = self.value()
                self.op(",")
        return "create_table", {"name": name, "fields": fields, "options": options}

    def _alter(self):
        self.need("TABLE")
        name = self.name()
        if self.word("ADD"):
            self.word("COLUMN")
            field, kind = self.name(), self.name().upper()
            while self.word("PRIMARY", "KEY", "NOT", "NULL"):
                pass
            return "add_column", {"name": name, "field": field, "type": kind}
        if self.word("DROP"):
            self.word("COLUMN")
            maybe = self.word("IF")
            if maybe:
                self.need("EXISTS")
            return "drop_column", {"name": name, "field": self.name(), "if_exists": maybe}
        if self.word("RENAME"):
            if self.word("TO"):
                return "rename_table", {"name": name, "to": self.name()}
            self.need("COLUMN")
            old = self.name()
            self.need("TO")
            return "rename_column", {"name": name, "field": old, "to": self.name()}
        self.need("ALTER")
        self.word("COLUMN")
        field = self.name()
        self.need("TYPE")
        return "retype", {"name": name, "field": field, "type": self.name().upper()}


class ShowParser(Parser):
    def show(self):
        self.need("SHOW")
        if self.word("TABLES"):
            out = ("tables", None, None)
        elif self.word("EDGES"):
            out = ("edges", self.name() if self.word("FROM") else None, self.name() if self.word("TO") else None)
        elif self.word("CREATE"):
            self.need("TABLE")
            out = ("create", self.name(), None)
        else:
            out = ("collection", self.name(), None)
        self.end()
        return out
