"""SPARQL algebra to DataFrames: declarative joins, unions and aggregates that Catalyst plans."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import FUNCTIONS, iri_of, part_of
from ..functions.values import Typed, arithmetic, box, compare, condition, constant, ebv, negate, number, numeric_term, order_key, unbox, unified
from ..operators.paths import pairs, reachable, walks
from ..terms import BNODE, IRI, LITERAL, TRIPLE, VARIABLE, XSD, Term, from_row, term
from . import algebra as A
from .parser import SparqlError, parse

GRAPH = "__g"


def enc(name: str) -> str:
    """A variable's column: Spark takes names of other case for equal."""
    return "".join(c.lower() + "^" if c.isupper() else c for c in name)


def col(name: str) -> Column:
    return F.col(f"`{enc(name)}`")


@dataclass
class Solutions:
    """A multiset of solutions: a column for each variable. kinds: static kind of each; maybe: variables that can be unbound."""

    df: DataFrame
    kinds: dict[str, str]
    maybe: set[str] = field(default_factory=set)

    def typed(self, name: str) -> Typed:
        return Typed(self.kinds[name], col(name))

    def select(self, columns: dict[str, Typed], maybe: set[str]) -> Solutions:
        return Solutions(self.df.select(*[t.col.alias(enc(n)) for n, t in columns.items()]), {n: t.kind for n, t in columns.items()}, maybe)

    def cast(self, kinds: dict[str, str]) -> Solutions:
        """The same with some variables in another kind."""
        if all(self.kinds[n] == k for n, k in kinds.items()):
            return self
        out = {}
        for n in self.kinds:
            t = self.typed(n)
            want = kinds.get(n, t.kind)
            out[n] = t if want == t.kind else Typed("term", box(t)) if want == "term" else unified(t, Typed("iri", F.lit("")))[0]
        return self.select(out, self.maybe)


class Store:
    """Where triple patterns are answered from: quads in a DataFrame (g, s, p, o), g null for the default graph."""

    def __init__(self, quads: DataFrame):
        self.quads = quads
        self.spark = quads.sparkSession

    def pattern(self, triple: tuple, active) -> Solutions:
        """One triple pattern over the active graph: None (default), a list of graph names merged, an IRI, or GRAPH (any named graph)."""
        q = self.quads
        bound: list[tuple[str, Column]] = []
        if active is None:
            q = q.where(F.col("g").isNull())
        elif active == GRAPH:
            q = q.where(F.col("g").isNotNull())
            bound.append((GRAPH, F.col("g")))
        elif isinstance(active, list):
            q = q.where(F.col("g.k").eqNullSafe(F.lit(IRI)) & F.col("g.v").isin(active) if active else F.lit(False))
            if len(active) > 1:
                q = q.select("s", "p", "o").distinct()
        else:
            q = q.where((F.col("g.k") == IRI) & (F.col("g.v") == active))
        tests: list[Column] = []

        def match(c: Column, t: Term) -> None:
            if t.kind in (VARIABLE, BNODE):
                bound.append((t.value if t.kind == VARIABLE else f"_:{t.value}", c))
            elif t.kind == TRIPLE and any(_open(x) for x in t.parts):
                tests.append(c["k"] == TRIPLE)
                for i, x in enumerate(t.parts):
                    match(part_of(c, i), x)
            else:
                tests.append(c["v"] == t.value)
                tests.append(c["k"] == t.kind)
                if t.kind == LITERAL:
                    tests.extend([c["d"].eqNullSafe(F.lit(t.datatype)), c["l"].eqNullSafe(F.lit(t.lang)), c["r"].eqNullSafe(F.lit(t.direction))])

        for name, t in zip("spo", triple):
            match(F.col(name), t)
        first: dict[str, Column] = {}
        for name, c in bound:
            if name in first:
                tests.append(first[name] == c)
            else:
                first[name] = c
        for t in tests:
            q = q.where(t)
        return Solutions(q.select(*[c.alias(enc(n)) for n, c in first.items()]), dict.fromkeys(first, "term"))

    def bgp(self, triples: list, active) -> list[Solutions]:
        return [self.pattern(t, active) for t in triples]

    def nodes(self, active) -> DataFrame:
        """Distinct subjects and objects (n, and __g) of the active graph."""
        p = self.pattern((Term(VARIABLE, "s"), Term(VARIABLE, "p"), Term(VARIABLE, "o")), active).df
        g = ["__g"] if active == GRAPH else []
        return p.select(*g, F.col("s").alias("n")).union(p.select(*g, F.col("o").alias("n"))).distinct()

    def nodes_among(self, terms: DataFrame, active) -> DataFrame:
        """Those of terms (n) that are nodes of the active graph (n, and __g)."""
        return self.nodes(active).join(terms.select("n").distinct(), ["n"], "left_semi")

    has_triple_terms = True
    #: Whether patterns are read from files as they are, so that reading them again costs no more than reading a copy.
    reads_files = False

    def about(self, terms: list[Term], active) -> DataFrame:
        """Triples (s, p, o) with one of the terms as subject or object."""
        p = self.pattern((Term(VARIABLE, "s"), Term(VARIABLE, "p"), Term(VARIABLE, "o")), active).df
        names = [t.value for t in terms]
        test = F.lit(False)
        for c in ("s", "o"):
            one = F.lit(False)
            for t in terms:
                one = one | F.col(c).eqNullSafe(t.column())
            test = test | (F.col(f"{c}.v").isin(names) & one)
        return p.where(test).select("s", "p", "o")

    def graphs(self) -> DataFrame:
        """Names of the named graphs, as __g."""
        return self.quads.where(F.col("g").isNotNull()).select(F.col("g").alias(GRAPH)).distinct()


def _patterns(names: list[str], maybe: set[str]) -> list[int]:
    """The sets of names, as bits, that can be bound at once."""
    free = [1 << i for i, v in enumerate(names) if v in maybe]
    return [(1 << len(names)) - 1 - sum(x) for n in range(len(free) + 1) for x in combinations(free, n)]


def _meeting(left: DataFrame, right: DataFrame, names: list[str], mine: list[int], theirs: list[int]) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides and an equi-join condition under which rows that agree on the names bound in both meet, once.

    A row of the left comes once for each set of names that a row of the right (columns r:name) can have bound, and the
    other way round; the keys are both sets and the values of the names in both. mine and theirs: the sets of either side.
    """
    bits = lambda prefix: sum((F.when(F.col(f"`{prefix}{enc(v)}`").isNotNull(), 1 << i).otherwise(0) for i, v in enumerate(names)), F.lit(0))
    each = lambda sets: F.explode(F.array(*map(F.lit, sets))) if len(sets) > 1 else F.lit(sets[0])
    left = left.select("*", bits("").alias("k:l")).select("*", each(theirs).alias("k:r"))
    right = right.select("*", bits("r:").alias("r:k:r")).select("*", each(mine).alias("r:k:l"))
    if len(theirs) == 1:
        right = right.where(F.col("`r:k:r`") == theirs[0])
    on = (F.col("`k:l`") == F.col("`r:k:l`")) & (F.col("`k:r`") == F.col("`r:k:r`"))
    for i, v in enumerate(names):
        shown = lambda p: F.when(F.col(f"`{p}k:l`").bitwiseAND(F.col(f"`{p}k:r`")).bitwiseAND(F.lit(1 << i)) != 0, F.col(f"`{p}{enc(v)}`")).alias(f"{p}k:{i}")  # noqa: B023, E731
        left, right = left.select("*", shown("")), right.select("*", shown("r:"))
        on = on & F.col(f"`k:{i}`").eqNullSafe(F.col(f"`r:k:{i}`"))
    return left, right, on


def _joined(left: Solutions, renamed: DataFrame, right_maybe: set[str], shared: list[str], on: Column, how: str) -> DataFrame:
    """left.df joined to the right's renamed columns on `on`.

    Where each shared variable can be unbound on a side, `on` alone has no key, and any plan of it compares all with all;
    then up to three of the variables become keys by _meeting. Rows that share no bound variable still meet all.
    """
    loose = [v for v in shared if v in left.maybe or v in right_maybe]
    if not loose or any(v not in loose and v != GRAPH for v in shared):
        return left.df.join(renamed, on, how)
    names = loose[:3]
    mine, theirs, columns = _patterns(names, left.maybe), _patterns(names, right_maybe), left.df.columns

    def part(df: DataFrame, sets: list[int], how: str) -> DataFrame:
        a, b, keys = _meeting(df, renamed, names, mine, sets)
        out = a.join(b, on & keys, how)
        return out.select(*[F.col(f"`{c}`") for c in (columns if how in ("left_semi", "left_anti") else [*columns, *renamed.columns])])

    if how == "inner" or len(theirs) == 1:
        return part(left.df, theirs, how)
    if how == "left":
        return part(left.df, theirs, "inner").unionByName(_joined(left, renamed, right_maybe, shared, on, "left_anti"), allowMissingColumns=True)
    rest, found = left.df, None
    for i, one in enumerate(theirs):
        if how == "left_semi":
            hit = part(rest, [one], "left_semi")
            found = hit if found is None else found.unionByName(hit)
        if how == "left_anti" or i + 1 < len(theirs):
            rest = part(rest, [one], "left_anti")
    return rest if found is None else found


def _open(t: Term) -> bool:
    return t.kind in (VARIABLE, BNODE) or any(_open(x) for x in t.parts)


class Compiler:
    """One query over one store. `functions` maps IRIs to callables on typed columns, for extensions; `aggregates` to callables on a typed column and whether DISTINCT."""

    def __init__(self, store: Store, base: str | None = None, named: list[str] | None = None, functions: dict | None = None, aggregates: dict | None = None):
        self.store, self.spark, self.named, self.aggregates = store, store.spark, named, aggregates or {}
        self.functions = {**FUNCTIONS, "iri": iri_of(base), **(functions or {})}
        self.count = 0
        self.given: dict[str, Solutions] = {}

    # patterns

    def pattern(self, n: object, active, beside: Solutions | None = None, alone: bool = False) -> Solutions:
        """The solutions of n; of those that join with `beside`, and with what is given around n, all, of others perhaps not all.

        Closures in n walk from the terms that a variable has there only. What is given is the solutions that bind a variable for sure; it ends at
        nodes whose rows depend on all rows below (groups, slices), where variables have other scopes (projections), and, `alone`, on the right of
        what keeps rows that find nothing there: only what the left binds can narrow that side.
        """
        held = self.given
        if isinstance(n, (A.Project, A.Group, A.Slice)):
            self.given = {}
        elif beside is not None:
            self.given = {**({} if alone else held), **{v: beside for v in beside.kinds if v not in beside.maybe and v != GRAPH}}
        try:
            return getattr(self, "on_" + type(n).__name__.lower())(n, active)
        finally:
            self.given = held

    def _given_terms(self, t: Term) -> DataFrame | None:
        """The terms (n) that a variable of a path can have, if something tells."""
        name = t.value if t.kind == VARIABLE else f"_:{t.value}"
        if t.kind not in (VARIABLE, BNODE) or name not in self.given:
            return None
        return self.given[name].df.select(box(self.given[name].typed(name)).alias("n"))

    def unit(self, active) -> Solutions:
        """One solution without bindings; in GRAPH ?g one for each named graph."""
        if active == GRAPH:
            return Solutions(self._graph_names(), {GRAPH: "term"})
        one = self.spark.range(1).select()
        if isinstance(active, str):
            g = self._graph_names()
            return Solutions(g.where(F.col(GRAPH)["v"] == active).limit(1).select(), {})
        return Solutions(one, {})

    def _graph_names(self) -> DataFrame:
        g = self.store.graphs()
        return g if self.named is None else g.where(F.col(GRAPH)["v"].isin(self.named) if self.named else F.lit(False))

    def on_bgp(self, n: A.Bgp, active) -> Solutions:
        if not n.triples:
            return self.unit(active)
        parts = self.store.bgp(n.triples, active)
        if active == GRAPH and self.named is not None:
            parts = [Solutions(p.df.where(box(p.typed(GRAPH))["v"].isin(self.named) if self.named else F.lit(False)), p.kinds) for p in parts]
        fixed = [sum(not _open(x) for x in t) for t in n.triples] if len(parts) == len(n.triples) else [0] * len(parts)
        left = sorted(range(len(parts)), key=lambda i: -fixed[i])
        out = parts[left.pop(0)]
        while left:
            # next to what is there, the most constants first: no cross product while there is another way
            i = next((i for i in left if set(parts[i].kinds) & set(out.kinds) - {GRAPH}), left[0])
            left.remove(i)
            out = self.join(out, parts[i])
        return out

    def on_path(self, n: A.Path, active) -> Solutions:
        ends = []
        starts, stops = (self._given_terms(t) if walks(n.path) else None for t in (n.subject, n.object))
        df = pairs(self, n.path, active, n.subject, n.object, starts, stops)
        tests = []
        for c, t in (("s", n.subject), ("o", n.object)):
            if t.kind in (VARIABLE, BNODE):
                ends.append((t.value if t.kind == VARIABLE else f"_:{t.value}", F.col(c)))
            else:
                tests.append(F.col(c).eqNullSafe(t.column()))
        if len(ends) == 2 and ends[0][0] == ends[1][0]:
            tests.append(F.col("s") == F.col("o"))
            ends.pop()
        for t in tests:
            df = df.where(t)
        if active == GRAPH:
            ends.append((GRAPH, F.col(GRAPH)))
        return Solutions(df.select(*[c.alias(enc(x)) for x, c in ends]), dict.fromkeys([x for x, _ in ends], "term"))

    def join(self, left: Solutions, right: Solutions, how: str = "inner", condition=None) -> Solutions:
        shared = [v for v in left.kinds if v in right.kinds]
        kinds = {v: unified(left.typed(v), right.typed(v))[0].kind for v in shared}
        left, right = left.cast(kinds), right.cast(kinds)
        renamed = right.df.select(*[col(v).alias(enc(v) if v not in shared else f"r:{enc(v)}") for v in right.kinds])
        on = None
        loose = [v for v in shared if v in left.maybe or v in right.maybe]
        for v in shared:
            a, b = col(v), F.col(f"`r:{enc(v)}`")
            test = (a == b) | a.isNull() | b.isNull() if v in loose else a == b
            on = test if on is None else on & test
        if condition is not None:
            merged = {v: left.typed(v) if v not in loose else Typed(left.kinds[v], F.coalesce(col(v), F.col(f"`r:{enc(v)}`"))) for v in left.kinds}
            merged.update({v: right.typed(v) for v in right.kinds if v not in shared})
            test = F.coalesce(ebv(self.expr(condition, merged)), F.lit(False))
            on = test if on is None else on & test
        if on is None:
            df = left.df.crossJoin(renamed) if how == "inner" else left.df.join(renamed, F.lit(True), how)
        else:
            df = _joined(left, renamed, right.maybe, shared, on, how)
        columns = {v: Typed(left.kinds[v], F.coalesce(col(v), F.col(f"`r:{enc(v)}`")) if v in loose else col(v)) for v in left.kinds}
        columns.update({v: Typed(right.kinds[v], col(v)) for v in right.kinds if v not in shared})
        if how == "inner":
            maybe = {v for v in left.maybe | right.maybe if v not in shared or (v in left.maybe and v in right.maybe)}
        else:
            maybe = {v for v in left.maybe} | {v for v in right.kinds if v not in shared}
        return Solutions(df, left.kinds, left.maybe).select(columns, maybe)

    def on_join(self, n: A.Join, active) -> Solutions:
        """Closures come last, those first that have an end in what is there, and each part sees what the parts before it bind."""
        parts = sorted(_joined_parts(n), key=lambda p: isinstance(p, A.Path) and walks(p.path))
        out = self.pattern(parts.pop(0), active)
        while parts:
            free = [p for p in parts if not (isinstance(p, A.Path) and walks(p.path)) or set(A.variables(p)) & set(out.kinds)]
            part = (free or parts)[0]
            parts = [p for p in parts if p is not part]
            out = self.join(out, self.pattern(part, active, out))
        return out

    def on_leftjoin(self, n: A.LeftJoin, active) -> Solutions:
        left = self.pattern(n.left, active)
        return self.join(left, self.pattern(n.right, active, left, True), "left", n.condition)

    def on_filter(self, n: A.Filter, active) -> Solutions:
        s = self.pattern(n.inner, active)
        for e in _conjuncts(n.expr):
            negated = isinstance(e, A.Call) and e.name == "!" and isinstance(e.args[0], A.Exists)
            if isinstance(e, A.Exists) or negated:
                x = e.args[0] if negated else e
                s = self.exists(s, x.pattern, x.negated != negated, active)
            else:
                s = self._with_exists(s, e, active)
        return s

    def _with_exists(self, s: Solutions, e, active) -> Solutions:
        """Filter by an expression; EXISTS inside of it becomes a column first."""
        kinds, maybe = dict(s.kinds), set(s.maybe)
        s, e = self._flags(s, e, active)
        if isinstance(e, A.Call) and e.name in ("<", ">", "<=", ">="):
            test = condition(e.name, *[self.expr(a, s) for a in e.args])
            if test is not None:
                return self._keep(Solutions(s.df.where(test), s.kinds, s.maybe), kinds, maybe)
        return self._keep(Solutions(s.df.where(ebv(self.expr(e, s))), s.kinds, s.maybe), kinds, maybe)

    def _keep(self, s: Solutions, kinds: dict, maybe: set) -> Solutions:
        return s if set(s.kinds) == set(kinds) else s.select({v: s.typed(v) for v in kinds}, maybe)

    def _flags(self, s: Solutions, e, active) -> tuple[Solutions, object]:
        if isinstance(e, A.Exists):
            self.count += 1
            flag = f".x{self.count}"
            right, conditions = self._inside(e.pattern, active, s)
            # each row is in one of both, so that no row has to be told from another
            yes, no = (self._semi(s, right, how, conditions) for how in ("left_semi", "left_anti"))
            df = yes.df.withColumn(enc(flag), F.lit(not e.negated)).unionByName(no.df.withColumn(enc(flag), F.lit(e.negated)))
            return Solutions(df, {**yes.kinds, flag: "bool"}, yes.maybe), Term(VARIABLE, flag)
        if isinstance(e, A.Call) and any(_has_exists(a) for a in e.args):
            args = []
            for a in e.args:
                s, b = self._flags(s, a, active)
                args.append(b)
            return s, A.Call(e.name, tuple(args))
        return s, e

    def exists(self, s: Solutions, pattern, negated: bool, active) -> Solutions:
        right, conditions = self._inside(pattern, active, s)
        return self._semi(s, right, "left_anti" if negated else "left_semi", conditions)

    def _inside(self, pattern, active, beside: Solutions) -> tuple[Solutions, list]:
        """A pattern without the filters around it, and these."""
        conditions = []
        while isinstance(pattern, A.Filter) and not _has_exists(pattern.expr):
            conditions.append(pattern.expr)
            pattern = pattern.inner
        return self.pattern(pattern, active, beside, True), conditions

    def _semi(self, s: Solutions, right: Solutions, how: str, conditions: list, need_shared: bool = False) -> Solutions:
        shared = [v for v in s.kinds if v in right.kinds and not v.startswith("_:")]
        kinds = {v: unified(s.typed(v), right.typed(v))[0].kind for v in shared}
        left, right = s.cast(kinds), right.cast(kinds)
        wanted = set(shared)
        for c in conditions:
            wanted |= set(_names(c))
        renamed = right.df.select(*[col(v).alias(f"r:{enc(v)}") for v in right.kinds if v in wanted])
        on, both = F.lit(True), F.lit(False)
        for v in shared:
            a, b = col(v), F.col(f"`r:{enc(v)}`")
            loose = v in left.maybe or v in right.maybe
            on = on & ((a == b) | a.isNull() | b.isNull() if loose else a == b)
            if v != GRAPH:
                both = both | (a.isNotNull() & b.isNotNull()) if loose else F.lit(True)
        if need_shared:
            on = on & both
        for c in conditions:
            scope = {v: Typed(right.kinds[v], F.col(f"`r:{enc(v)}`")) for v in right.kinds if v in wanted}
            scope.update({v: left.typed(v) for v in left.kinds})
            on = on & F.coalesce(ebv(self.expr(c, scope)), F.lit(False))
        return Solutions(_joined(left, renamed, right.maybe, shared, on, how), left.kinds, left.maybe)

    def on_minus(self, n: A.Minus, active) -> Solutions:
        s = self.pattern(n.left, active)
        right = self.pattern(n.right, active, s, True)
        if not [v for v in s.kinds if v in right.kinds and v != GRAPH and not v.startswith("_:")]:
            return s
        return self._semi(s, right, "left_anti", [], need_shared=True)

    def on_union(self, n: A.Union, active) -> Solutions:
        a, b = self.pattern(n.left, active), self.pattern(n.right, active)
        names = [*a.kinds, *[v for v in b.kinds if v not in a.kinds]]
        kinds = {v: unified(a.typed(v), b.typed(v))[0].kind for v in names if v in a.kinds and v in b.kinds}
        a, b = a.cast(kinds), b.cast(kinds)
        df = a.df.unionByName(b.df, allowMissingColumns=True)
        maybe = a.maybe | b.maybe | {v for v in names if not (v in a.kinds and v in b.kinds)}
        return Solutions(df, {v: (a if v in a.kinds else b).kinds[v] for v in names}, maybe)

    def on_graph(self, n: A.Graph, active) -> Solutions:
        if n.name.kind != VARIABLE:
            if self.named is not None and n.name.value not in self.named:
                return self._none(n)
            return self.pattern(n.inner, n.name.value)
        s = self.pattern(n.inner, GRAPH)
        name = n.name.value
        if name in s.kinds:
            both = same_or_unbound(s.typed(name), s.typed(GRAPH), name in s.maybe)
            s = Solutions(s.df.where(both), s.kinds, s.maybe)
        columns = {v: s.typed(v) for v in s.kinds if v not in (GRAPH, name)}
        return s.select({**columns, name: s.typed(GRAPH)}, s.maybe - {name})

    def _none(self, n) -> Solutions:
        names = A.variables(n)
        return Solutions(self.spark.range(0).select(*[F.lit(None).cast(_term_type()).alias(enc(v)) for v in names]), dict.fromkeys(names, "term"), set(names))

    def on_extend(self, n: A.Extend, active) -> Solutions:
        s = self.pattern(n.inner, active)
        if n.var in s.kinds:
            raise SparqlError(f"?{n.var} is bound already")
        kinds, maybe = dict(s.kinds), set(s.maybe)
        s, e = self._flags(s, n.expr, active) if _has_exists(n.expr) else (s, n.expr)
        t = self.expr(e, s)
        if t.const is not None:
            t = Typed(t.kind, t.col, None) if t.kind in ("iri", "str", "bool", "int") or box(Typed(t.kind, t.col)) is None else Typed("term", box(t))
        out = Solutions(s.df.withColumn(enc(n.var), t.col), {**s.kinds, n.var: t.kind}, s.maybe | {n.var})
        return self._keep(out, {**kinds, n.var: t.kind}, maybe | {n.var})

    def on_values(self, n: A.Values, active) -> Solutions:
        rows = [tuple(None if t is None else t.row() for t in r) for r in n.rows]
        ddl = ", ".join(f"`{enc(v)}` {_term_type()}" for v in n.vars)
        if n.vars:
            df = self.spark.createDataFrame(rows, ddl)
        else:
            df = self.spark.range(len(rows)).select()
        maybe = {v for i, v in enumerate(n.vars) if any(r[i] is None for r in n.rows)}
        return self.join(Solutions(df, dict.fromkeys(n.vars, "term"), maybe), self.unit(active)) if active == GRAPH else Solutions(df, dict.fromkeys(n.vars, "term"), maybe)

    def on_orderby(self, n: A.OrderBy, active) -> Solutions:
        s = self.pattern(n.inner, active)
        keys = []
        for e, down in n.keys:
            k = order_key(self.expr(e, s))
            keys.append(k.desc_nulls_last() if down else k.asc_nulls_first())
        return Solutions(s.df.orderBy(*keys), s.kinds, s.maybe)

    def on_project(self, n: A.Project, active) -> Solutions:
        s = self.pattern(n.inner, active)
        names = [*n.vars, *([GRAPH] if GRAPH in s.kinds and GRAPH not in n.vars else [])]
        columns = {v: s.typed(v) if v in s.kinds else Typed("term", F.lit(None).cast(_term_type())) for v in names}
        return s.select(columns, {v for v in names if v in s.maybe or v not in s.kinds})

    def on_distinct(self, n: A.Distinct, active) -> Solutions:
        s = self.pattern(n.inner, active)
        return Solutions(s.df.dropDuplicates(), s.kinds, s.maybe)

    on_reduced = on_distinct

    def on_slice(self, n: A.Slice, active) -> Solutions:
        s = self.pattern(n.inner, active)
        df = s.df.offset(n.offset) if n.offset else s.df
        return Solutions(df.limit(n.limit) if n.limit is not None else df, s.kinds, s.maybe)

    def on_service(self, n: A.Service, active) -> Solutions:
        raise NotImplementedError("SERVICE")

    # groups

    def on_group(self, n: A.Group, active) -> Solutions:
        s = self.pattern(n.inner, active)
        keys = [k for k in n.keys if k in s.kinds] + ([GRAPH] if GRAPH in s.kinds else [])
        absent = [k for k in n.keys if k not in s.kinds]
        columns, kinds = [], {}
        for var, a in n.aggregates:
            t = self.aggregate(a, s)
            columns.append(t.col.alias(enc(var)))
            kinds[var] = t.kind
        grouped = s.df.groupBy(*[col(k) for k in keys])
        df = grouped.agg(*columns) if columns else s.df.select(*[col(k) for k in keys]).distinct() if keys else s.df.agg(F.count(F.lit(1)).alias(".n")).drop(".n")
        for k in absent:
            df = df.withColumn(enc(k), F.lit(None).cast(_term_type()))
        all_kinds = {**{k: s.kinds[k] for k in keys}, **dict.fromkeys(absent, "term"), **kinds}
        counts = {v for v, a in n.aggregates if a.name == "count"}
        return Solutions(df, all_kinds, {k for k in all_kinds if k in s.maybe or k in absent or (k in kinds and k not in counts)})

    def aggregate(self, a: A.Aggregate, s: Solutions) -> Typed:
        if a.arg is None:
            every = F.struct(*[col(v) for v in s.kinds if v != GRAPH and not v.startswith("_:")])
            return Typed("int", F.count_distinct(every) if a.distinct else F.count(F.lit(1)))
        x = self.expr(a.arg, s)
        if a.name in self.aggregates:
            return self.aggregates[a.name](x, a.distinct)
        exact = x.col if x.kind != "term" else box(x)
        if a.name == "count":
            return Typed("int", F.count_distinct(exact) if a.distinct else F.count(exact))
        if a.name == "sample":
            return Typed(x.kind, F.min(x.col))
        if a.name == "group_concat":
            from ..functions.scalar import Text

            text = Text(x).text
            bad = F.count_if(text.isNull())
            items = F.sort_array(F.collect_set(text) if a.distinct else F.collect_list(text))
            return Typed("str", F.when(bad == 0, F.array_join(items, a.separator)))
        if a.name in ("min", "max"):
            bad = F.count_if(x.col.isNull())
            f, by = (F.min, F.min_by) if a.name == "min" else (F.max, F.max_by)
            if x.kind != "term":
                return Typed(x.kind, F.when(bad == 0, f(x.col)))
            return Typed("term", F.when(bad == 0, by(x.col, order_key(x))))
        return self._sum(a, x, exact)

    def _sum(self, a: A.Aggregate, x: Typed, exact: Column) -> Typed:
        n = number(x)
        if x.numeric and not (a.distinct and x.kind == "term"):
            bad = F.count_if(x.col.isNull())
            v = x.col.cast("decimal(38,0)") if x.kind == "int" and "decimal" not in str(x.kind) else x.col
            total = F.try_sum(F.when(v.isNotNull(), v)) if not a.distinct else F.sum_distinct(v)
            if a.name == "sum":
                zero = F.lit(0)
                return Typed(x.kind, F.when(bad == 0, F.coalesce(total, zero.cast("decimal(38,0)" if x.kind == "int" else "decimal(38,18)" if x.kind == "dec" else "double"))))
            count = F.greatest((F.count_distinct(v) if a.distinct else F.count(v)), F.lit(1))
            if n.static <= 2:
                return Typed("dec", F.when(bad == 0, F.coalesce(F.try_divide(total.try_cast("decimal(38,18)"), count.cast("decimal(20,0)")).try_cast("decimal(38,18)"), F.lit(0).cast("decimal(38,18)"))))
            return Typed(x.kind, F.when(bad == 0, F.coalesce(total / count, F.lit(0.0))))
        # terms: the widest type met decides, anything but a number spoils the group
        kept = F.struct(n.rank.alias("r"), n.dec.alias("d"), n.dbl.alias("f"), exact.alias("t"))
        bad, top = F.count_if(n.rank.isNull()), F.max(n.rank)
        if a.distinct:
            items = F.collect_set(F.when(n.rank.isNotNull(), kept))
            zero = F.lit(0).cast("decimal(38,18)")
            dec = F.aggregate(items, zero, lambda p, i: (p + F.coalesce(i["d"], zero)).cast("decimal(38,18)"))
            dbl = F.aggregate(items, F.lit(0.0), lambda p, i: p + i["f"])
            count = F.size(items)
        else:
            dec, dbl, count = F.try_sum(n.dec).try_cast("decimal(38,18)"), F.sum(n.dbl), F.count(n.rank)
        if a.name == "avg":
            many = F.greatest(count, F.lit(1))
            dec, dbl, top = F.try_divide(dec, many.cast("decimal(20,0)")).try_cast("decimal(38,18)"), dbl / many, F.greatest(top, F.lit(2))
        empty = term(LITERAL, F.lit("0" if a.name == "sum" else "0.0"), XSD + ("integer" if a.name == "sum" else "decimal"))
        return Typed("term", F.when(bad == 0, F.when(count == 0, empty).otherwise(numeric_term(top, dec.cast("decimal(38,0)"), dec, dbl))))

    # expressions

    def expr(self, e, scope) -> Typed:
        get = scope.typed if isinstance(scope, Solutions) else scope.__getitem__
        names = scope.kinds if isinstance(scope, Solutions) else scope
        if isinstance(e, Term):
            if e.kind == VARIABLE:
                return get(e.value) if e.value in names else Typed("term", F.lit(None).cast(_term_type()))
            if e.kind == TRIPLE and _open(e):
                return self.functions["triple"](*[self.expr(x, scope) for x in e.parts])
            return constant(e)
        if isinstance(e, A.Exists):
            raise SparqlError("EXISTS in this place")
        name, args = e.name, e.args
        if name == "bound":
            return Typed("bool", self.expr(args[0], scope).col.isNotNull())
        x = [self.expr(a, scope) for a in args]
        if name in ("||", "&&"):
            a, b = ebv(x[0]), ebv(x[1])
            return Typed("bool", a | b if name == "||" else a & b)
        if name == "!":
            return Typed("bool", ~ebv(x[0]))
        if name in ("=", "<", ">", "<=", ">="):
            return Typed("bool", compare(name, x[0], x[1]))
        if name == "in":
            out = F.lit(False)
            for y in x[1:]:
                out = out | compare("=", x[0], y)
            return Typed("bool", out)
        if name in ("+", "-", "*", "/"):
            return arithmetic(name, x[0], x[1])
        if name == "u-":
            return negate(x[0])
        if name == "u+":
            return arithmetic("+", Typed("int", F.lit(0)), x[0]) if not x[0].numeric else x[0]
        if name == "if":
            a, b = unified(x[1], x[2])
            c = ebv(x[0])
            return Typed(a.kind, F.when(c, a.col).when(~c, b.col))
        if name == "coalesce":
            if not x:
                return Typed("term", F.lit(None).cast(_term_type()))
            kinds = {y.kind for y in x}
            if len(kinds) > 1:
                x = [Typed("term", box(y)) for y in x]
            return Typed(x[0].kind, F.coalesce(*[y.col for y in x]))
        f = self.functions.get(name)
        if f is None:
            return Typed("term", F.lit(None).cast(_term_type()))
        return f(*x)


def same_or_unbound(a: Typed, b: Typed, loose: bool) -> Column:
    x, y = unified(a, b)
    return (x.col == y.col) | x.col.isNull() if loose else x.col == y.col


def _term_type() -> str:
    from ..terms import TERM_DDL

    return TERM_DDL


def _joined_parts(n) -> list:
    return [*_joined_parts(n.left), *_joined_parts(n.right)] if isinstance(n, A.Join) else [n]


def _conjuncts(e) -> list:
    return _conjuncts(e.args[0]) + _conjuncts(e.args[1]) if isinstance(e, A.Call) and e.name == "&&" else [e]


def _has_exists(e) -> bool:
    return isinstance(e, A.Exists) or (isinstance(e, A.Call) and any(_has_exists(a) for a in e.args))


def _names(e) -> list[str]:
    if isinstance(e, Term):
        return [e.value] if e.kind == VARIABLE else [n for p in e.parts for n in _names(p)]
    return [n for a in getattr(e, "args", ()) for n in _names(a)]


class Result:
    """Bindings of a SELECT: `df` has plain values (text, numbers, booleans, timestamps), `terms` the term structs."""

    def __init__(self, s: Solutions, names: list[str]):
        self.names = names
        self.df = s.df.select(*[unbox(s.typed(v)).alias(v) for v in names])
        self.terms = s.df.select(*[box(s.typed(v)).alias(v) for v in names])

    def rows(self) -> list[dict[str, Term]]:
        """All solutions as Python terms, for small results."""
        return [{v: from_row(r[i]) for i, v in enumerate(self.names) if r[i] is not None} for r in self.terms.collect()]


class Engine:
    """Queries over a store."""

    def __init__(self, store: Store | DataFrame, prefixes: dict[str, str] | None = None, functions: dict | None = None, aggregates: dict | None = None):
        self.store = Store(store) if isinstance(store, DataFrame) else store
        self.prefixes, self.functions, self.aggregates = prefixes, functions, aggregates or {}

    def prepare(self, text: str, base: str | None = None) -> A.Query:
        """A query read once, for query() to run any number of times, on any engine."""
        return parse(text, base, self.prefixes, self.aggregates)

    def query(self, text: str | A.Query, base: str | None = None):
        """SELECT gives a Result, ASK a bool, CONSTRUCT and DESCRIBE a DataFrame (s, p, o) of term structs."""
        q = self.prepare(text, base) if isinstance(text, str) else text
        c = Compiler(self.store, q.base, q.from_named, self.functions, self.aggregates)
        active = q.from_default
        if q.form == "select":
            s = c.pattern(q.pattern, active)
            p = q.pattern
            while not isinstance(p, A.Project):
                p = p.left if isinstance(p, A.Join) else p.inner
            extra = A.variables(q.pattern.right) if isinstance(q.pattern, A.Join) else []
            return Result(s, [*p.vars, *[v for v in extra if v not in p.vars]])
        if q.form == "ask":
            return not c.pattern(q.pattern, active).df.limit(1).isEmpty()
        if q.form == "construct":
            return construct(c.pattern(q.pattern, active), q.template)
        from .describe import describe

        return describe(c, q, active)


def construct(s: Solutions, template: list) -> DataFrame:
    """Triples of the template for each solution: blank nodes are fresh in each; triples with unbound or misplaced terms go."""
    df = s.df.withColumn("__row", F.replace(F.uuid(), F.lit("-"), F.lit("")))

    def of(t: Term) -> Column:
        if t.kind == VARIABLE:
            return box(s.typed(t.value)) if t.value in s.kinds else F.lit(None).cast(_term_type())
        if t.kind == BNODE:
            return term(BNODE, F.concat(F.lit("b"), F.col("__row"), F.lit("x" + t.value.replace(".", "n"))))
        if t.kind == TRIPLE and _open(t):
            return FUNCTIONS["triple"](*[Typed("term", of(x)) for x in t.parts]).col
        return t.column()

    def kind(t: Term) -> Column:
        """The kind of t's term, null if it is unbound; without the term where it is told by the column's kind."""
        x = s.typed(t.value) if t.kind == VARIABLE and t.value in s.kinds else None
        if x is None or x.kind == "term":
            return F.lit(t.kind) if t.kind in (IRI, BNODE, LITERAL) else of(t)["k"]
        return F.when(x.col.isNotNull(), IRI if x.kind == "iri" or x.kind.startswith("ref:") else LITERAL)

    def chosen(parts: list[Column]) -> Column:
        return parts[0] if len(parts) == 1 else reduce(lambda c, i: c.when(F.col("__i") == i, parts[i]), range(1, len(parts)), F.when(F.col("__i") == 0, parts[0]))

    # the number of a triple is unfolded, not its terms: those of triples that are not asked for are never made
    fits = [kind(a).isin(IRI, BNODE) & (kind(b) == IRI) & kind(c).isin(IRI, BNODE, LITERAL, TRIPLE) for a, b, c in template]
    if len(template) > 1:
        df = df.withColumn("__i", F.explode(F.array(*[F.lit(i) for i in range(len(template))])))
    df = df.where(chosen(fits))
    return df.select(*[chosen([of(t[k]) for t in template]).alias(c) for k, c in enumerate("spo")])


def engine(spark: SparkSession, quads: DataFrame, **options) -> Engine:
    return Engine(Store(quads), **options)


__all__ = ["Engine", "Result", "Solutions", "Store", "engine", "reachable"]
