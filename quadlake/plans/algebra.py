"""SPARQL algebra nodes and expressions, as the parser makes them and the compiler reads them."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..terms import Term


@dataclass(frozen=True)
class Call:
    """An operator, function or cast; name in lower case, or an IRI for casts and extensions."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Exists:
    pattern: object
    negated: bool = False


@dataclass(frozen=True)
class Aggregate:
    name: str
    arg: object
    distinct: bool = False
    separator: str = " "


# Property paths: a Term is one predicate.
@dataclass(frozen=True)
class PathOp:
    """op: seq, alt, inv, star, plus, opt, neg (args: forward predicates, inverse predicates)."""

    op: str
    args: tuple


@dataclass
class Bgp:
    triples: list


@dataclass
class Path:
    subject: Term
    path: object
    object: Term


@dataclass
class Join:
    left: object
    right: object


@dataclass
class LeftJoin:
    left: object
    right: object
    condition: object = None


@dataclass
class Filter:
    expr: object
    inner: object


@dataclass
class Union:
    left: object
    right: object


@dataclass
class Graph:
    name: Term
    inner: object


@dataclass
class Extend:
    inner: object
    var: str
    expr: object


@dataclass
class Minus:
    left: object
    right: object


@dataclass
class Values:
    vars: list
    rows: list


@dataclass
class OrderBy:
    inner: object
    keys: list  # (expr, descending)


@dataclass
class Project:
    inner: object
    vars: list


@dataclass
class Distinct:
    inner: object


@dataclass
class Reduced:
    inner: object


@dataclass
class Slice:
    inner: object
    offset: int
    limit: int | None


@dataclass
class Group:
    inner: object
    keys: list
    aggregates: list  # (var, Aggregate)


@dataclass
class Service:
    name: Term
    inner: object


@dataclass
class Query:
    """form: select, ask, construct or describe."""

    form: str
    pattern: object
    template: list = field(default_factory=list)
    terms: list = field(default_factory=list)
    base: str | None = None
    from_default: list | None = None
    from_named: list | None = None


def variables(node: object) -> list[str]:
    """In-scope variables of a pattern, in order of first use."""
    out: dict[str, None] = {}

    def of_term(t: Term) -> None:
        if t.kind == 4:
            out[t.value] = None
        for x in t.parts:
            of_term(x)

    def walk(n: object) -> None:
        if isinstance(n, Bgp):
            for t in n.triples:
                for x in t:
                    of_term(x)
        elif isinstance(n, Path):
            of_term(n.subject)
            of_term(n.object)
        elif isinstance(n, (Join, LeftJoin, Union)):
            walk(n.left)
            walk(n.right)
        elif isinstance(n, Minus):
            walk(n.left)
        elif isinstance(n, Graph):
            of_term(n.name)
            walk(n.inner)
        elif isinstance(n, Extend):
            walk(n.inner)
            out[n.var] = None
        elif isinstance(n, (Values, Project)):
            out.update(dict.fromkeys(n.vars))
        elif isinstance(n, Group):
            out.update(dict.fromkeys(n.keys))
            out.update(dict.fromkeys(v for v, _ in n.aggregates))
        elif isinstance(n, (Filter, OrderBy, Distinct, Reduced, Slice, Service)):
            walk(n.inner)

    walk(node)
    return list(out)
