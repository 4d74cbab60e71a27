"""Pattern matchers and graph operations on frames of quads (g, s, p, o) or triples (s, p, o)."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from ..terms import BNODE, IRI, LITERAL, TERM_DDL, TRIPLE, VARIABLE, Term, parts_column

Matcher = Callable[[Column], Column]


def anything(c: Column) -> Column:
    return F.lit(True)


def one(t: Term | None) -> Matcher:
    """Equal to t; None matches nothing."""
    return (lambda c: F.lit(False)) if t is None else (lambda c: F.coalesce(c.eqNullSafe(t.column()), F.lit(False)))


def among(terms: Iterable[Term]) -> Matcher:
    """Equal to one of the terms; kinds and values are compared first, as scans can use these."""
    items = list(terms)

    def test(c: Column) -> Column:
        return reduce(lambda a, b: a | b, [one(t)(c) for t in items], F.lit(False))

    return test


def other_than(m: Matcher) -> Matcher:
    return lambda c: ~F.coalesce(m(c), F.lit(False))


def kind(k: int) -> Matcher:
    return lambda c: c["k"] == k


def datatype(iri: str) -> Matcher:
    return lambda c: F.coalesce(c["d"] == iri, F.lit(False))


def language(tag: str) -> Matcher:
    return lambda c: F.coalesce(c["l"] == tag.lower(), F.lit(False))


def graph_name(t: Term | None) -> Matcher:
    """The graph of that name; None is the default graph."""
    return (lambda c: c.isNull()) if t is None else one(t)


def triple(s: Matcher = anything, p: Matcher = anything, o: Matcher = anything) -> Matcher:
    """A triple term whose parts match."""
    from ..functions.scalar import part_of

    def test(c: Column) -> Column:
        parts = [m(part_of(c, i)) for i, m in enumerate((s, p, o)) if m is not anything]
        return reduce(lambda a, b: a & b, parts, c["k"] == TRIPLE)

    return test


def matching(df: DataFrame, s: Matcher = anything, p: Matcher = anything, o: Matcher = anything, g: Matcher = anything) -> DataFrame:
    for name, m in (("s", s), ("p", p), ("o", o), ("g", g)):
        if m is not anything:
            df = df.where(m(F.col(name)))
    return df


def contains(df: DataFrame, quad: tuple) -> bool:
    names = ("s", "p", "o") if len(quad) == 3 else ("g", "s", "p", "o")
    for name, t in zip(names, quad):
        df = df.where(graph_name(t)(F.col(name)))
    return not df.limit(1).isEmpty()


def column_terms(df: DataFrame, column: str, m: Matcher = anything) -> DataFrame:
    """Distinct subjects, predicates, objects or graph names (`t`) that match."""
    return df.select(F.col(column).alias("t")).where(F.col("t").isNotNull() & m(F.col("t"))).distinct()


def every_atom(df: DataFrame) -> DataFrame:
    """Distinct terms of all kinds (`t`), triple terms and those inside of them included. Each level is opened once, for all its terms."""
    columns = [c for c in ("g", "s", "p", "o") if c in df.columns]
    terms = df.select(F.explode(F.array(*columns)).alias("t")).where("t IS NOT NULL").distinct()
    level = terms.where(F.col("t.k") == TRIPLE)
    while not (level := materialize(level, "triple_terms")).isEmpty():
        level = materialize(level.select(F.explode(parts_column(F.col("t"))).alias("t")).distinct(), "parts")
        terms, level = terms.union(level), level.where(F.col("t.k") == TRIPLE)
    return terms.distinct()


def atoms(df: DataFrame, k: int) -> DataFrame:
    """Those of every_atom() of a kind; with TRIPLE the triple terms, nested ones too."""
    return every_atom(df).where(F.col("t.k") == k)


def iris(df: DataFrame) -> DataFrame:
    return atoms(df, IRI)


def blank_nodes(df: DataFrame) -> DataFrame:
    return atoms(df, BNODE)


def literals(df: DataFrame) -> DataFrame:
    return atoms(df, LITERAL)


def variables(df: DataFrame) -> DataFrame:
    return atoms(df, VARIABLE)


def triple_terms(df: DataFrame) -> DataFrame:
    return atoms(df, TRIPLE)


def inserted(df: DataFrame, more: DataFrame) -> DataFrame:
    """Set union."""
    return df.unionByName(more).dropDuplicates()


def _absent(df: DataFrame, others: DataFrame) -> DataFrame:
    renamed = others.select(*[F.col(c).alias(f"x_{c}") for c in df.columns])
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"x_{c}")) for c in df.columns])
    return df.join(renamed, on, "left_anti")


def removed(df: DataFrame, others: DataFrame) -> DataFrame:
    """Set difference."""
    return _absent(df, others)


def insert_count(df: DataFrame, more: DataFrame) -> int:
    """How many of `more` are new."""
    return _absent(more.dropDuplicates(), df).count()


def remove_count(df: DataFrame, others: DataFrame) -> int:
    return df.count() - removed(df, others).count()


def remove_matching(df: DataFrame, **matchers: Matcher) -> DataFrame:
    tests = [F.coalesce(m(F.col(c)), F.lit(False)) for c, m in matchers.items()]
    return df.where(~reduce(lambda a, b: a & b, tests, F.lit(True)))


def retain_matching(df: DataFrame, **matchers: Matcher) -> DataFrame:
    return matching(df, **matchers)


def graph(df: DataFrame, name: Term | None) -> DataFrame:
    """The triples of one graph."""
    return df.where(graph_name(name)(F.col("g"))).select("s", "p", "o")


def union_graph(df: DataFrame) -> DataFrame:
    """All triples, whatever their graph, as a set."""
    return df.select("s", "p", "o").dropDuplicates()


def partial_union_graph(df: DataFrame, g: Matcher) -> DataFrame:
    return df.where(g(F.col("g"))).select("s", "p", "o").dropDuplicates()


def to_quads(df: DataFrame, name: Term | None = None) -> DataFrame:
    return df.select((name.column() if name else F.lit(None).cast(TERM_DDL)).alias("g"), "s", "p", "o")


def to_triples(df: DataFrame) -> DataFrame:
    return df.select("s", "p", "o")
