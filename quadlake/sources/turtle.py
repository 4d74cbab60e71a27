"""Turtle and TriG, with triple terms, reifiers and annotations; also the generalised form that allows any term anywhere."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import iri as iris
from ..terms import BNODE, IRI, RDF, TERM_DDL, TRIPLE, VARIABLE, XSD, Term, bnode, iri, literal, triple_term, unescape, variable
from .nquads import ParseError

_LOCAL = r"(?:[\w:\-·]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?#@%]|\.(?=[\w:\-.%\\]))*"
_TOKENS = re.compile(
    rf"""(?P<skip>\s+|\#[^\n]*)
  |(?P<iri><(?:[^<>"{{}}|^`\\\x00-\x20]|\\u[0-9A-Fa-f]{{4}}|\\U[0-9A-Fa-f]{{8}})*>)
  |(?P<long>\"\"\"(?:(?:"|"")?(?:[^"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*''')
  |(?P<str>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
  |(?P<keyword>@prefix\b|@base\b|@version\b)
  |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*(?:--(?:ltr|rtl))?)
  |(?P<bnode>_:\w(?:[\w\-.·]*[\w\-·])?)
  |(?P<var>[?$]\w+)
  |(?P<num>[+-]?(?:(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+|\d*\.\d+|\d+))
  |(?P<pname>(?:[^\W\d_](?:[\w\-.·]*[\w\-·])?)?:{_LOCAL})
  |(?P<word>[A-Za-z]+)
  |(?P<op><<\(|\)>>|<<|>>|\{{\||\|\}}|\^\^|[{{}}()\[\].,;~])""",
    re.X | re.S,
)


class TurtleParser:
    """Pulls quads (g, s, p, o) out of one document. trig: graphs in braces; generalized: any kind of term in any place."""

    def __init__(self, text: str, base: str | None = None, trig: bool = False, generalized: bool = False, prefixes: dict[str, str] | None = None, bnode_scope: str = ""):
        self.text, self.base, self.trig, self.loose, self.scope = text, base, trig, generalized, bnode_scope
        self.prefixes: dict[str, str] = dict(prefixes or {})
        self.at, self.fresh, self.graph, self.out = 0, 0, None, []
        self.token: tuple[str, str, int] = ("start", "", 0)
        self.next()

    def error(self, wanted: str) -> ParseError:
        at = self.token[2]
        line = self.text.count("\n", 0, at)
        return ParseError(f"expected {wanted}, found {self.token[1]!r}", line, at - (self.text.rfind("\n", 0, at) + 1))

    def next(self) -> str:
        before = self.token[1]
        while True:
            if self.at >= len(self.text):
                self.token = ("end", "", self.at)
                return before
            m = _TOKENS.match(self.text, self.at)
            if not m:
                self.token = ("bad", self.text[self.at : self.at + 10], self.at)
                raise self.error("a token")
            self.at = m.end()
            if m.lastgroup != "skip":
                self.token = (m.lastgroup, m.group(), m.start())
                return before

    def take(self, text: str) -> bool:
        if self.token[1] == text and self.token[0] == "op":
            self.next()
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            raise self.error(repr(text))

    def new_bnode(self) -> Term:
        self.fresh += 1
        return bnode(f"b{self.fresh}{self.scope}x")

    def add(self, s: Term, p: Term, o: Term) -> None:
        self.out.append((self.graph, s, p, o))

    def quads(self) -> Iterator[tuple]:
        while self.token[0] != "end":
            self.statement()
            yield from self.out
            self.out = []

    def statement(self) -> None:
        kind, text, _ = self.token
        if kind == "keyword" or (kind == "word" and text.lower() in ("prefix", "base", "version")):
            self.next()
            word = text.lstrip("@").lower()
            if word == "prefix":
                if self.token[0] != "pname" or not self.token[1].endswith(":"):
                    raise self.error("a prefix")
                name = self.next()[:-1]
                self.prefixes[name] = self.iri_ref()
            elif word == "base":
                self.base = self.iri_ref()
            elif self.token[0] not in ("str", "long"):
                raise self.error("a version")
            else:
                self.next()
            if kind == "keyword":
                self.need(".")
            return
        if self.trig and (text == "{" or (kind == "word" and text.lower() == "graph")):
            if kind == "word":
                self.next()
                self.block(self.graph_name())
            else:
                self.block(None)
            return
        if self.trig and (kind in ("iri", "pname", "bnode") or (self.loose and kind != "op") or text == "["):
            held = (self.at, self.token, self.fresh)
            try:
                name = self.graph_name()
            except ParseError:
                name = None
            if name is not None and self.token[1] == "{" and self.token[0] == "op":
                self.block(name)
                return
            self.at, self.token, self.fresh = held
        self.triples()
        self.need(".")

    def graph_name(self) -> Term:
        t = self.term()
        if not self.loose and t.kind not in (IRI, BNODE):
            raise self.error("a graph name")
        return t

    def block(self, name: Term | None) -> None:
        self.need("{")
        self.graph = name
        while not self.take("}"):
            self.triples()
            if not self.take("."):
                self.need("}")
                break
        self.graph = None

    def triples(self) -> None:
        compound = self.token[1] in ("[", "<<")
        blank = self.token[1] == "[" and self.text[self.at :].lstrip()[:1] == "]"
        s = self.node()
        if not self.loose and s.kind not in (IRI, BNODE):
            raise self.error("a subject that is an IRI or blank node")
        if compound and not blank and self.token[1] in (".", "}"):
            return
        self.properties(s)

    def properties(self, s: Term) -> None:
        while True:
            if self.token[:2] == ("word", "a"):
                self.next()
                p = iri(RDF + "type")
            else:
                p = self.term()
                if p.kind != IRI and not self.loose:
                    raise self.error("a predicate")
            while True:
                o = self.node()
                if o.kind == VARIABLE and not self.loose:
                    raise self.error("an object")
                self.add(s, p, o)
                me = None
                while self.token[1] in ("~", "{|") and self.token[0] == "op":
                    if self.take("~"):
                        me = self.reifier()
                        self.add(me, iri(RDF + "reifies"), triple_term(s, p, o))
                    else:
                        self.need("{|")
                        if me is None:
                            me = self.new_bnode()
                            self.add(me, iri(RDF + "reifies"), triple_term(s, p, o))
                        self.properties(me)
                        self.need("|}")
                        me = None
                if not self.take(","):
                    break
            again = False
            while self.take(";"):
                again = True
            if not again or self.token[1] in (".", "]", "}", "|}") or self.token[0] == "end":
                return

    def reifier(self) -> Term:
        return self.term() if self.token[0] in ("iri", "pname", "bnode", "var") else self.new_bnode()

    def node(self) -> Term:
        if self.take("("):
            items = []
            while not self.take(")"):
                items.append(self.node())
            rest = iri(RDF + "nil")
            cells = [self.new_bnode() for _ in items]
            for k, x in enumerate(items):
                self.add(cells[k], iri(RDF + "first"), x)
                self.add(cells[k], iri(RDF + "rest"), cells[k + 1] if k + 1 < len(items) else rest)
            return cells[0] if cells else rest
        if self.take("["):
            me = self.new_bnode()
            if not self.take("]"):
                self.properties(me)
                self.need("]")
            return me
        if self.take("<<"):
            s, p, o = self.node(), self.verb(), self.node()
            me = self.reifier() if self.take("~") else self.new_bnode()
            self.need(">>")
            self.add(me, iri(RDF + "reifies"), triple_term(s, p, o))
            return me
        return self.term()

    def verb(self) -> Term:
        if self.token[:2] == ("word", "a"):
            self.next()
            return iri(RDF + "type")
        p = self.term()
        if p.kind != IRI and not self.loose:
            raise self.error("a predicate")
        return p

    def iri_ref(self) -> str:
        if self.token[0] != "iri":
            raise self.error("an IRI")
        raw = unescape(self.token[1][1:-1])
        if not iris.is_absolute(raw):
            if self.base is not None:
                raw = iris.resolve(self.base, raw)
            if not iris.is_absolute(raw) and not (self.loose and iris.is_relative(raw)):
                raise self.error("an absolute IRI")
        self.next()
        return raw

    def term(self) -> Term:
        kind, text, _ = self.token
        if kind == "iri":
            return iri(self.iri_ref())
        if kind == "pname":
            prefix, local = text.split(":", 1)
            if prefix not in self.prefixes:
                raise self.error("a known prefix")
            self.next()
            return iri(self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local))
        if kind == "bnode":
            self.next()
            return bnode(text[2:] + self.scope)
        if kind == "var" and self.loose:
            self.next()
            return variable(text[1:])
        if self.take("["):
            self.need("]")
            return self.new_bnode()
        if self.take("<<("):
            s, p, o = self.term(), self.verb(), self.term()
            if not self.loose and (s.kind not in (IRI, BNODE) or o.kind == VARIABLE):
                raise self.error("a triple term")
            self.need(")>>")
            return triple_term(s, p, o)
        if kind in ("str", "long"):
            try:
                value = unescape(text[3:-3] if kind == "long" else text[1:-1])
            except (KeyError, ValueError):
                raise self.error("a string") from None
            self.next()
            if self.token[0] == "lang":
                tag, _, direction = self.next()[1:].partition("--")
                return literal(value, lang=tag, direction=direction or None)
            if self.take("^^"):
                return literal(value, self.term().value)
            return literal(value)
        if kind == "num":
            self.next()
            return literal(text, XSD + ("double" if "e" in text.lower() else "decimal" if "." in text else "integer"))
        if kind == "word" and text in ("true", "false"):
            self.next()
            return literal(text, XSD + "boolean")
        raise self.error("a term")


def parse_turtle(text: str, base: str | None = None, **options) -> list[tuple]:
    return list(TurtleParser(text, base, **options).quads())


def parse_trig(text: str, base: str | None = None, **options) -> list[tuple]:
    return list(TurtleParser(text, base, trig=True, **options).quads())


def read_documents(spark: SparkSession, path: str, parse) -> DataFrame:
    """Quads of files that only make sense whole: one file a row, files in parallel. `parse(text, path)` gives quads of terms, or of their rows."""
    # a compressed file of nothing counts as Spark counts an empty one: not at all
    files = spark.read.text(path, wholetext=True).where("value <> ''").select("value", F.col("_metadata.file_path").alias("path"))

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int8(), *[pa.string()] * 4]

        def column(terms: list) -> pa.Array:
            rows = [(None,) * 5 if t is None else t if type(t) is tuple else t.row() for t in terms]
            fields = [pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)]
            return pa.StructArray.from_arrays(fields, names=list("kvdlr"), mask=pa.array([t is None for t in terms]))

        batch = lambda rows: pa.RecordBatch.from_arrays([column(x) for x in zip(*rows)], names=list("gspo"))
        for b in batches:
            for text, name in zip(b.column(0), b.column(1)):
                rows = []
                for q in parse(text.as_py(), name.as_py()):
                    rows.append(q)
                    if len(rows) == 10_000:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    return files.mapInArrow(run, ", ".join(f"{c} {TERM_DDL}" for c in "gspo"))


def new_scopes(preserve_bnodes: bool):
    """A function of a file's path to the suffix of its blank nodes: 96 bits, another one in each call, so that no two reads share a node; none to preserve labels."""
    import hashlib
    import uuid

    call = uuid.uuid4().hex
    return lambda path: "" if preserve_bnodes else f"f{hashlib.sha256(f'{path} {call}'.encode()).hexdigest()[:24]}"


def read_turtle(spark: SparkSession, path: str, base: str | None = None, preserve_bnodes: bool = False, generalized: bool = False, trig: bool = False) -> DataFrame:
    """Quads of Turtle (or TriG) files; relative IRIs are resolved against base, or else against the file's own place."""
    scope = new_scopes(preserve_bnodes)
    return read_documents(spark, path, lambda text, name: TurtleParser(text, base or name, trig, generalized, None, scope(name)).quads())


def read_trig(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_turtle(spark, path, trig=True, **options)


__all__ = ["TRIPLE", "TurtleParser", "parse_trig", "parse_turtle", "read_documents", "read_trig", "read_turtle", "new_scopes"]
