"""SPARQL 1.2 query text to algebra: a tokenizer and a recursive-descent parser after the W3C grammar."""

from __future__ import annotations

import re
from collections.abc import Iterable

from .. import iri as iris
from ..terms import RDF, XSD, Term, bnode, iri, literal, triple_term, unescape, variable
from .algebra import Aggregate, Bgp, Call, Distinct, Exists, Extend, Filter, Graph, Group, Join, LeftJoin, Minus, OrderBy, Path, PathOp, Project, Query, Reduced, Service, Slice, Union, Values, variables

_LOCAL = r"(?:[\w:\-·]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?#@%]|\.(?=[\w:\-.%\\]))*"
_TOKENS = re.compile(
    rf"""(?P<skip>\s+|\#[^\n]*)
  |(?P<iri><[^<>"{{}}|^`\\\x00-\x20]*(?:\\u[0-9A-Fa-f]{{4}}[^<>"{{}}|^`\\\x00-\x20]*)*>)
  |(?P<long>\"\"\"(?:(?:"|"")?(?:[^"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*''')
  |(?P<str>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
  |(?P<var>[?$]\w+)
  |(?P<bnode>_:\w(?:[\w\-.·]*[\w\-·])?)
  |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*(?:--(?:ltr|rtl))?)
  |(?P<num>(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+|\d*\.\d+|\d+)
  |(?P<pname>(?:[^\W\d_](?:[\w\-.·]*[\w\-·])?)?:{_LOCAL})
  |(?P<word>[A-Za-z_]\w*)
  |(?P<op><<\(|\)>>|<<|>>|\{{\||\|\}}|\^\^|&&|\|\||!=|<=|>=|[{{}}()\[\].,;=<>!+\-*/|^?~])""",
    re.X | re.S,
)

# Built-in functions with the number of arguments they take.
FUNCTIONS = {
    "str": (1, 1), "lang": (1, 1), "langdir": (1, 1), "haslang": (1, 1), "haslangdir": (1, 1), "langmatches": (2, 2), "datatype": (1, 1), "bound": (1, 1), "iri": (1, 1), "uri": (1, 1),
    "bnode": (0, 1), "rand": (0, 0), "abs": (1, 1), "ceil": (1, 1), "floor": (1, 1), "round": (1, 1), "concat": (0, 999), "strlen": (1, 1), "ucase": (1, 1), "lcase": (1, 1),
    "encode_for_uri": (1, 1), "contains": (2, 2), "strstarts": (2, 2), "strends": (2, 2), "strbefore": (2, 2), "strafter": (2, 2), "year": (1, 1), "month": (1, 1), "day": (1, 1),
    "hours": (1, 1), "minutes": (1, 1), "seconds": (1, 1), "timezone": (1, 1), "tz": (1, 1), "now": (0, 0), "uuid": (0, 0), "struuid": (0, 0), "md5": (1, 1), "sha1": (1, 1), "sha256": (1, 1),
    "sha384": (1, 1), "sha512": (1, 1), "coalesce": (0, 999), "if": (3, 3), "strlang": (2, 2), "strlangdir": (3, 3), "strdt": (2, 2), "sameterm": (2, 2), "isiri": (1, 1), "isuri": (1, 1),
    "isblank": (1, 1), "isliteral": (1, 1), "isnumeric": (1, 1), "regex": (2, 3), "substr": (2, 3), "replace": (3, 4), "triple": (3, 3), "subject": (1, 1), "predicate": (1, 1), "object": (1, 1), "istriple": (1, 1),
}
AGGREGATES = ("count", "sum", "avg", "min", "max", "sample", "group_concat")


class SparqlError(ValueError):
    """A query that is not well-formed, or asks for what is not there."""


class _Parser:
    def __init__(self, text: str, base: str | None, prefixes: dict[str, str] | None, aggregates: Iterable[str] = ()):
        self.tokens: list[tuple[str, str, int]] = []
        at = 0
        while at < len(text):
            m = _TOKENS.match(text, at)
            if not m:
                raise SparqlError(f"unexpected {text[at : at + 20]!r} at {at}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m.group(), at))
            at = m.end()
        self.tokens.append(("end", "", at))
        self.i, self.base, self.prefixes, self.fresh = 0, base, dict(prefixes or {}), 0
        self.aggregates: list[tuple[str, Aggregate]] | None = None
        self.custom = frozenset(aggregates)

    # tokens

    @property
    def kind(self) -> str:
        return self.tokens[self.i][0]

    @property
    def text(self) -> str:
        return self.tokens[self.i][1]

    def fail(self, wanted: str) -> SparqlError:
        return SparqlError(f"expected {wanted}, found {self.text!r} at {self.tokens[self.i][2]}")

    def next(self) -> str:
        self.i += 1
        return self.tokens[self.i - 1][1]

    def word(self, *names: str) -> bool:
        return self.kind == "word" and self.text.lower() in names

    def take(self, *names: str) -> str | None:
        if (self.kind == "op" and self.text in names) or (self.kind == "word" and self.text.lower() in names):
            return self.next().lower()
        return None

    def need(self, name: str) -> None:
        if not self.take(name):
            raise self.fail(repr(name))

    def new_bnode(self) -> Term:
        self.fresh += 1
        return bnode(f".{self.fresh}")

    # terms

    def iri_of(self, text: str) -> Term:
        raw = unescape(text)
        if self.base is not None and not iris.is_absolute(raw):
            raw = iris.resolve(self.base, raw)
        return iri(raw)

    def iri(self) -> Term:
        if self.kind == "iri":
            return self.iri_of(self.next()[1:-1])
        if self.kind == "pname":
            prefix, local = self.next().split(":", 1)
            if prefix not in self.prefixes:
                raise SparqlError(f"unknown prefix {prefix!r}")
            return iri(self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local))
        raise self.fail("an IRI")

    def at_iri(self) -> bool:
        return self.kind in ("iri", "pname")

    def number(self, sign: str = "") -> Term:
        text = sign + self.next()
        return literal(text, XSD + ("double" if "e" in text.lower() else "decimal" if "." in text else "integer"))

    def literal(self) -> Term | None:
        if self.kind in ("str", "long"):
            text = self.next()
            text = unescape(text[3:-3] if text[:3] in ('"""', "'''") else text[1:-1])
            if self.kind == "lang":
                tag, _, direction = self.next()[1:].partition("--")
                return literal(text, lang=tag, direction=direction or None)
            return literal(text, self.iri().value) if self.take("^^") else literal(text)
        if self.kind == "num":
            return self.number()
        if self.kind == "op" and self.text in "+-" and self.tokens[self.i + 1][0] == "num":
            return self.number(self.next())
        if self.word("true", "false"):
            return literal(self.next().lower(), XSD + "boolean")
        return None

    def var_or_term(self) -> Term:
        if self.kind == "var":
            return variable(self.next()[1:])
        if self.at_iri():
            return self.iri()
        if self.kind == "bnode":
            return bnode(self.next()[2:])
        if self.kind == "op" and self.text == "[" and self.tokens[self.i + 1][1] == "]":
            self.i += 2
            return self.new_bnode()
        if self.take("<<("):
            s, p, o = self.var_or_term(), self.verb_term(), self.var_or_term()
            self.need(")>>")
            return triple_term(s, p, o)
        t = self.literal()
        if t is None:
            raise self.fail("a term")
        return t

    def verb_term(self) -> Term:
        if self.word("a"):
            self.next()
            return iri(RDF + "type")
        return variable(self.next()[1:]) if self.kind == "var" else self.iri()

    # queries

    def query(self) -> Query:
        self.prologue()
        form = self.take("select", "ask", "construct", "describe")
        if not form:
            raise self.fail("a query form")
        if form == "select":
            out = Query("select", None)
            self.select(out)
        elif form == "ask":
            out = Query("ask", None)
            self.datasets(out)
            self.take("where")
            out.pattern = self.modifiers(self.group(), None)
        elif form == "construct":
            out = Query("construct", None)
            if self.kind == "op" and self.text == "{":
                out.template = self.template()
                self.datasets(out)
                self.take("where")
                pattern = self.group()
            else:
                self.datasets(out)
                self.need("where")
                at = self.i
                out.template = self.template()
                self.i = at
                pattern = self.group()
            out.pattern = self.modifiers(pattern, None)
        else:
            out = Query("describe", None)
            if not self.take("*"):
                while self.kind == "var" or self.at_iri():
                    out.terms.append(self.var_or_term())
            self.datasets(out)
            pattern = Bgp([])
            if self.take("where") or self.text == "{":
                pattern = self.group()
            out.terms = out.terms or [variable(v) for v in variables(pattern)]
            out.pattern = self.modifiers(pattern, None)
        if self.word("values"):
            self.next()
            out.pattern = Join(out.pattern, self.values())
        if self.kind != "end":
            raise self.fail("the end")
        out.base = self.base
        return out

    def prologue(self) -> None:
        while True:
            if self.take("base"):
                self.base = self.iri_of(self.next()[1:-1]).value
            elif self.take("prefix"):
                name = self.next()
                self.prefixes[name[:-1]] = self.iri_of(self.next()[1:-1]).value
            elif self.take("version"):
                self.next()
            else:
                return

    def datasets(self, out: Query) -> None:
        while self.take("from"):
            out.from_default, out.from_named = out.from_default or [], out.from_named or []
            (out.from_named if self.take("named") else out.from_default).append(self.iri().value)

    def select(self, out: Query | None):
        mode = self.take("distinct", "reduced")
        items: list | None = None
        outer, self.aggregates = self.aggregates, []
        if not self.take("*"):
            items = []
            while self.kind == "var" or self.text == "(":
                if self.kind == "var":
                    items.append((self.next()[1:], None))
                else:
                    self.need("(")
                    e = self.expression()
                    self.need("as")
                    items.append((self.next()[1:], e))
                    self.need(")")
            if not items:
                raise self.fail("a variable")
        found, self.aggregates = self.aggregates, None
        if out is not None:
            self.datasets(out)
        self.take("where")
        pattern = self.group()
        self.aggregates = found
        pattern = self.modifiers(pattern, items, mode)
        self.aggregates = outer
        if out is not None:
            out.pattern = pattern
        return pattern

    def modifiers(self, pattern, items: list | None, mode: str | None = None):
        keys, grouped = [], False
        top = self.aggregates
        if top is None:
            self.aggregates = []
        if self.take("group"):
            self.need("by")
            grouped = True
            held, self.aggregates = self.aggregates, None
            while True:
                if self.kind == "var":
                    keys.append(self.next()[1:])
                elif self.take("("):
                    e = self.expression()
                    name = self.next()[1:] if self.take("as") else f".k{len(keys)}"
                    self.need(")")
                    pattern = Extend(pattern, name, e)
                    keys.append(name)
                elif self.at_iri() or (self.kind == "word" and (self.text.lower() in FUNCTIONS)):
                    pattern = Extend(pattern, f".k{len(keys)}", self.primary())
                    keys.append(f".k{len(keys)}")
                else:
                    break
            self.aggregates = held
        having = []
        if self.take("having"):
            while self.text == "(" or self.at_iri() or (self.kind == "word" and (self.text.lower() in FUNCTIONS or self.text.lower() in AGGREGATES)):
                having.append(self.primary())
        order = []
        if self.take("order"):
            self.need("by")
            while True:
                if way := self.take("asc", "desc"):
                    order.append((self.primary(), way == "desc"))
                elif self.kind == "var" or self.text == "(" or self.at_iri() or (self.kind == "word" and (self.text.lower() in FUNCTIONS or self.text.lower() in AGGREGATES)):
                    order.append((self.primary(), False))
                else:
                    break
        if self.aggregates or grouped:
            pattern = Group(pattern, keys, list(self.aggregates or []))
        if top is None:
            self.aggregates = None
        for e in having:
            pattern = Filter(e, pattern)
        visible = variables(pattern)
        for name, e in items or []:
            if e is not None:
                if name in variables(pattern):
                    raise SparqlError(f"?{name} is bound already")
                pattern = Extend(pattern, name, e)
        if self.word("values") and items is not None and False:
            self.next()
        if order:
            pattern = OrderBy(pattern, order)
        if items is not None or mode is not None or top is not None:
            names = [n for n, _ in items] if items is not None else [v for v in visible if not v.startswith(".")]
            pattern = Project(pattern, names)
        if mode:
            pattern = Distinct(pattern) if mode == "distinct" else Reduced(pattern)
        offset, limit = 0, None
        while way := self.take("limit", "offset"):
            n = int(self.next())
            offset, limit = (offset, n) if way == "limit" else (n, limit)
        return Slice(pattern, offset, limit) if offset or limit is not None else pattern

    # patterns

    def group(self):
        self.need("{")
        if self.word("select"):
            self.next()
            out = self.select(None)
            if self.word("values"):
                self.next()
                out = Join(out, self.values())
            self.need("}")
            return out
        out, filters = None, []
        join = lambda a, b: b if a is None else Join(a, b)
        while not self.take("}"):
            if self.take("."):
                continue
            if self.take("filter"):
                filters.append(self.constraint())
            elif self.take("optional"):
                inner = self.group()
                condition = None
                if isinstance(inner, Filter):
                    condition, inner = inner.expr, inner.inner
                out = LeftJoin(out or Bgp([]), inner, condition)
            elif self.take("minus"):
                out = Minus(out or Bgp([]), self.group())
            elif self.take("graph"):
                name = variable(self.next()[1:]) if self.kind == "var" else self.iri()
                out = join(out, Graph(name, self.group()))
            elif self.take("service"):
                self.take("silent")
                name = variable(self.next()[1:]) if self.kind == "var" else self.iri()
                out = join(out, Service(name, self.group()))
            elif self.take("bind"):
                self.need("(")
                e = self.expression()
                self.need("as")
                name = self.next()[1:]
                self.need(")")
                if out is not None and name in variables(out):
                    raise SparqlError(f"?{name} is bound already")
                out = Extend(out or Bgp([]), name, e)
            elif self.take("values"):
                out = join(out, self.values())
            elif self.text == "{":
                inner = self.group()
                while self.take("union"):
                    inner = Union(inner, self.group())
                out = join(out, inner)
            else:
                for p in self.triples_block(paths=True):
                    if isinstance(p, Bgp) and isinstance(out, Bgp):
                        out = Bgp(out.triples + p.triples)
                    elif isinstance(p, Bgp) and isinstance(out, Join) and isinstance(out.right, Bgp):
                        out = Join(out.left, Bgp(out.right.triples + p.triples))
                    else:
                        out = join(out, p)
        out = out or Bgp([])
        if filters:
            e = filters[0]
            for f in filters[1:]:
                e = Call("&&", (e, f))
            out = Filter(e, out)
        return out

    def constraint(self):
        held, self.aggregates = self.aggregates, None
        out = self.primary()
        self.aggregates = held
        return out

    def values(self) -> Values:
        names, rows = [], []
        if self.kind == "var":
            names = [self.next()[1:]]
            self.need("{")
            while not self.take("}"):
                rows.append([self.data_value()])
        else:
            self.need("(")
            while self.kind == "var":
                names.append(self.next()[1:])
            self.need(")")
            self.need("{")
            while not self.take("}"):
                self.need("(")
                row = []
                while not self.take(")"):
                    row.append(self.data_value())
                if len(row) != len(names):
                    raise SparqlError("a row of VALUES has another length")
                rows.append(row)
        return Values(names, rows)

    def data_value(self) -> Term | None:
        return None if self.take("undef") else self.var_or_term()

    def template(self) -> list:
        self.need("{")
        out: list = []
        while not self.take("}"):
            if self.take("."):
                continue
            for p in self.triples_block(paths=False):
                out += p.triples
        return out

    def triples_block(self, paths: bool) -> list:
        """Patterns of one subject and its predicates; plain triples in Bgps."""
        out: list = []

        def add(s, p, o) -> None:
            if isinstance(p, PathOp):
                out.append(Path(s, p, o))
            elif out and isinstance(out[-1], Bgp):
                out[-1].triples.append((s, p, o))
            else:
                out.append(Bgp([(s, p, o)]))

        compound = self.text in ("(", "[", "<<")
        subject = self.node(add, paths)
        if not (compound and (self.text in (".", "}") or self.kind == "end")):
            self.property_list(subject, add, paths)
        return out

    def node(self, add, paths: bool) -> Term:
        if self.take("("):
            items = []
            while not self.take(")"):
                items.append(self.node(add, paths))
            head = rest = iri(RDF + "nil")
            for k, x in enumerate(reversed(items)):
                head = self.new_bnode()
                add(head, iri(RDF + "first"), x)
                add(head, iri(RDF + "rest"), rest)
                rest = head
            return head
        if self.text == "[" and self.tokens[self.i + 1][1] != "]":
            self.need("[")
            me = self.new_bnode()
            self.property_list(me, add, paths)
            self.need("]")
            return me
        if self.take("<<"):
            s, p, o = self.node(add, False), self.verb_term(), self.node(add, False)
            me = self.reifier() if self.take("~") else self.new_bnode()
            self.need(">>")
            add(me, iri(RDF + "reifies"), triple_term(s, p, o))
            return me
        return self.var_or_term()

    def reifier(self) -> Term:
        return self.var_or_term() if self.kind in ("var", "bnode", "iri", "pname") else self.new_bnode()

    def property_list(self, subject: Term, add, paths: bool) -> None:
        while True:
            verb = self.path() if paths and not (self.kind == "var" or self.word("a") and self.tokens[self.i + 1][1] not in "/|*+?^") else self.verb_term()
            while True:
                o = self.node(add, paths)
                add(subject, verb, o)
                me = None
                while self.text in ("~", "{|"):
                    if self.take("~"):
                        me = self.reifier()
                        add(me, iri(RDF + "reifies"), triple_term(subject, verb, o))
                    else:
                        self.need("{|")
                        if me is None:
                            me = self.new_bnode()
                            add(me, iri(RDF + "reifies"), triple_term(subject, verb, o))
                        self.property_list(me, add, paths)
                        self.need("|}")
                        me = None
                if not self.take(","):
                    break
            again = False
            while self.take(";"):
                again = True
            if not again or self.text in (".", "}", "]", "|}") or self.kind == "end":
                return

    # paths

    def path(self):
        parts = [self.path_sequence()]
        while self.take("|"):
            parts.append(self.path_sequence())
        return parts[0] if len(parts) == 1 else PathOp("alt", tuple(parts))

    def path_sequence(self):
        parts = [self.path_element()]
        while self.take("/"):
            parts.append(self.path_element())
        return parts[0] if len(parts) == 1 else PathOp("seq", tuple(parts))

    def path_element(self):
        inverse = bool(self.take("^"))
        if self.take("("):
            p = self.path()
            self.need(")")
        elif self.take("!"):
            forward, back = [], []
            many = self.take("(")
            while not (many and self.take(")")):
                (back if self.take("^") else forward).append(self.verb_term())
                if not many:
                    break
                self.take("|")
            p = PathOp("neg", (tuple(forward), tuple(back)))
        else:
            p = self.verb_term()
        while way := self.take("*", "+", "?"):
            p = PathOp({"*": "star", "+": "plus", "?": "opt"}[way], (p,))
        return PathOp("inv", (p,)) if inverse else p

    # expressions

    def expression(self):
        out = self.conjunction()
        while self.take("||"):
            out = Call("||", (out, self.conjunction()))
        return out

    def conjunction(self):
        out = self.relation()
        while self.take("&&"):
            out = Call("&&", (out, self.relation()))
        return out

    def relation(self):
        out = self.sum()
        if op := self.take("=", "!=", "<", ">", "<=", ">="):
            right = self.sum()
            return Call("!", (Call("=", (out, right)),)) if op == "!=" else Call(op, (out, right))
        negated = self.word("not") and self.tokens[self.i + 1][1].lower() == "in"
        if negated:
            self.next()
        if self.take("in"):
            self.need("(")
            options = []
            while not self.take(")"):
                options.append(self.expression())
                self.take(",")
            out = Call("in", (out, *options))
            return Call("!", (out,)) if negated else out
        return out

    def sum(self):
        out = self.product()
        while True:
            if op := self.take("+", "-"):
                out = Call(op, (out, self.product()))
            else:
                return out

    def product(self):
        out = self.unary()
        while op := self.take("*", "/"):
            out = Call(op, (out, self.unary()))
        return out

    def unary(self):
        if self.take("!"):
            return Call("!", (self.unary(),))
        if self.text in ("+", "-") and self.kind == "op":
            if self.tokens[self.i + 1][0] == "num":
                return self.literal()
            return Call("u" + self.next(), (self.unary(),))
        return self.primary()

    def primary(self):
        if self.take("("):
            out = self.expression()
            self.need(")")
            return out
        if self.kind == "word":
            name = self.text.lower()
            if name == "not" and self.tokens[self.i + 1][1].lower() == "exists":
                self.i += 2
                return Exists(self.inner_group(), True)
            if name == "exists":
                self.next()
                return Exists(self.inner_group())
            if name in AGGREGATES:
                return self.aggregate()
            if name in FUNCTIONS:
                self.next()
                args = self.arguments()
                if not FUNCTIONS[name][0] <= len(args) <= FUNCTIONS[name][1]:
                    raise SparqlError(f"{name} with {len(args)} arguments")
                return Call({"uri": "iri", "isuri": "isiri"}.get(name, name), tuple(args))
        if self.at_iri():
            name = self.iri()
            if self.text == "(":
                return self.aggregate(name.value) if name.value in self.custom else Call(name.value, tuple(self.arguments()))
            return name
        return self.var_or_term()

    def inner_group(self):
        held, self.aggregates = self.aggregates, None
        out = self.group()
        self.aggregates = held
        return out

    def arguments(self) -> list:
        self.need("(")
        self.take("distinct")
        out = []
        while not self.take(")"):
            out.append(self.expression())
            if not self.take(","):
                self.need(")")
                break
        return out

    def aggregate(self, name: str | None = None):
        name = name or self.next().lower()
        if self.aggregates is None:
            raise SparqlError(f"{name} outside of SELECT, HAVING and ORDER BY")
        held, self.aggregates = self.aggregates, None
        self.need("(")
        distinct = bool(self.take("distinct"))
        arg = None if name == "count" and self.take("*") else self.expression()
        separator = " "
        if self.take(";"):
            self.need("separator")
            self.need("=")
            separator = self.literal().value
        self.need(")")
        self.aggregates = held
        made = Aggregate(name, arg, distinct, separator)
        for var, other in held:
            if other == made:
                return variable(var)
        var = f".a{len(held)}"
        held.append((var, made))
        return variable(var)


def parse(text: str, base: str | None = None, prefixes: dict[str, str] | None = None, aggregates: Iterable[str] = ()) -> Query:
    """Parse a SELECT, ASK, CONSTRUCT or DESCRIBE query; `aggregates` are IRIs that stand for aggregates, not for functions."""
    return _Parser(text, base, prefixes, aggregates).query()
