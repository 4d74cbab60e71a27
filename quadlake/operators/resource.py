"""Walking from resource to resource in a graph, over documents if need be."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from ..terms import BNODE, INTEGER_RANGES, IRI, LITERAL, RDF, TERM_DDL, XSD, Term, from_row, iri, term


class Cardinality(ValueError):
    """Not exactly one term where one was asked for."""


class Resource:
    """A term with the graph (s, p, o) that speaks of it; `loader` reads the documents of other resources."""

    def __init__(self, term: Term, graph: DataFrame, loader=None, document: str | None = None):
        self.term, self.graph, self.loader = term, graph, loader
        self.document = document or (term.value.partition("#")[0] if term.kind == IRI else None)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Resource) and self.term == other.term

    def __hash__(self) -> int:
        return hash(self.term)

    def _along(self, p: str | Term, forward: bool, limit: int | None) -> list[Term]:
        p = iri(p) if isinstance(p, str) else p
        start, end = ("s", "o") if forward else ("o", "s")
        df = self.graph.where(F.col(start).eqNullSafe(self.term.column()) & F.col("p").eqNullSafe(p.column())).select(end)
        return [from_row(r[0]) for r in (df.limit(limit) if limit else df).collect()]

    def _one(self, p, forward: bool) -> Term:
        found = self._along(p, forward, 2)
        if len(found) != 1:
            raise Cardinality(f"{'no' if not found else 'more than one'} value of {p}")
        return found[0]

    def get_term(self, p) -> Term:
        return self._one(p, True)

    def get_any_term(self, p) -> Term | None:
        return next(iter(self._along(p, True, 1)), None)

    def get_all_terms(self, p) -> list[Term]:
        return self._along(p, True, None)

    def pred_term(self, p) -> Term:
        return self._one(p, False)

    def pred_any_term(self, p) -> Term | None:
        return next(iter(self._along(p, False, 1)), None)

    def pred_all_terms(self, p) -> list[Term]:
        return self._along(p, False, None)

    def follow(self, t: Term) -> Resource:
        """The neighbour, in its own document where that is another one and there is a loader."""
        if t.kind == LITERAL:
            raise ValueError("a literal is no resource")
        document = t.value.partition("#")[0] if t.kind == IRI else self.document
        if self.loader is not None and document != self.document:
            return Resource(t, self.loader.graph(document), self.loader, document)
        return Resource(t, self.graph, self.loader, self.document)

    def get_resource(self, p) -> Resource:
        return self.follow(self.get_term(p))

    def get_any_resource(self, p) -> Resource | None:
        t = self.get_any_term(p)
        return None if t is None else self.follow(t)

    def get_all_resources(self, p) -> list[Resource]:
        return [self.follow(t) for t in self.get_all_terms(p)]

    def get_typed(self, p, python_type: type):
        """The one value as bool, int, float, Decimal, date, datetime, bytes or str, or as what a callable makes of this resource's neighbour."""
        if python_type in _TYPES:
            return typed(self.get_term(p), python_type)
        return python_type(self.get_resource(p))

    def get_all_typed(self, p, python_type: type) -> list:
        """All values, as get_typed gives one."""
        if python_type in _TYPES:
            return [typed(t, python_type) for t in self.get_all_terms(p)]
        return [python_type(r) for r in self.get_all_resources(p)]

    def get_list(self, p) -> list[Term]:
        head = self.get_term(p)
        if head == iri(RDF + "nil"):
            return []
        rows = list_members(self.graph, head).orderBy("position").select("item").collect()
        if not rows:
            raise ValueError("not a list, or one with a branch or a loop")
        return [from_row(r["item"]) for r in rows]


class WrongLiteral(ValueError):
    """A value that is no literal (`problem` is kind), or one of another datatype (datatype) or text (value)."""

    def __init__(self, problem: str, found: Term):
        super().__init__(f"a wrong {problem}: {found}")
        self.problem, self.found = problem, found


def datatype_of(t: Term) -> str | None:
    if t.kind != LITERAL:
        return None
    return RDF + ("dirLangString" if t.direction else "langString") if t.lang else t.datatype


def check_literal(t: Term, datatype: str, forms: Sequence[str] = ()) -> str:
    """The text of a literal of this datatype, and one of these texts if there are any."""
    problem = "kind" if t.kind != LITERAL else "datatype" if datatype_of(t) != datatype else "value" if forms and t.value not in forms else None
    if problem:
        raise WrongLiteral(problem, t)
    return t.value


def checked_literals(graph: DataFrame, p: str, datatype: str, forms: Sequence[str] = ()) -> DataFrame:
    """check_literal for each triple with predicate p: s, o, value (null where it is wrong), problem (null where it is right)."""
    o = F.col("o")
    own = F.when(o["r"].isNotNull(), RDF + "dirLangString").when(o["l"].isNotNull(), RDF + "langString").otherwise(o["d"])
    problem = F.when(o["k"] != LITERAL, "kind").when(~own.eqNullSafe(F.lit(datatype)), "datatype")
    if forms:
        problem = problem.when(~o["v"].isin(list(forms)), "value")
    rows = graph.where((F.col("p.v") == p) & (F.col("p.k") == IRI)).select("s", "o", problem.alias("problem"))
    return rows.select("s", "o", F.when(F.col("problem").isNull(), F.col("o.v")).alias("value"), "problem")


def _boolean(text: str) -> bool:
    if text not in ("true", "false", "0", "1"):
        raise ValueError(f"not a boolean: {text}")
    return text in ("true", "1")


_TYPES: dict[type, Callable[[str], object]] = {bool: _boolean, int: int, float: lambda x: float(x.replace("INF", "inf")), str: str, Decimal: Decimal, date: lambda x: date.fromisoformat(x.removesuffix("Z")), datetime: datetime.fromisoformat, bytes: bytes.fromhex}


def typed(t: Term, python_type: type):
    """The value of a literal's text; ValueError for other terms and texts."""
    if t.kind != LITERAL:
        raise ValueError("not a literal")
    try:
        return _TYPES[python_type](t.value)
    except ArithmeticError as e:
        raise ValueError(f"not a number: {t.value}") from e


#: Spark types by datatype, and the texts that each allows.
_FRAMES = {
    "string": ("string", None), "boolean": ("boolean", "^(true|false|0|1)$"), "integer": ("decimal(38,0)", r"^[+-]?[0-9]+$"), "decimal": ("decimal(38,18)", r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"),
    "double": ("double", r"^([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?INF|NaN)$"), "date": ("date", "^[0-9]{4}-[0-9]{2}-[0-9]{2}Z?$"), "dateTime": ("timestamp", "^[0-9]{4}-[0-9]{2}-[0-9]{2}T"), "hexBinary": ("binary", "^([0-9a-fA-F]{2})*$"),
}


def typed_values(graph: DataFrame, p: str, name: str) -> DataFrame:
    """For each triple with predicate p: s, o, value as Spark's type for the XSD datatype `name`, problem.

    `problem` is null where value is there, else kind (no literal), datatype (of another one; integers count as decimals, both as doubles), or value (a text
    that the datatype doesn't allow, or beyond Spark's type).
    """
    if name not in _FRAMES:
        raise ValueError(f"unknown datatype: {name}")
    o, (to, form) = F.col("o"), _FRAMES[name]
    wider = {"decimal": ["integer", *INTEGER_RANGES], "double": ["float", "decimal", "integer", *INTEGER_RANGES], "integer": list(INTEGER_RANGES)}.get(name, [])
    text = F.regexp_replace(o["v"], "^([+-]?)INF$", "$1Infinity") if name == "double" else F.regexp_replace(o["v"], "Z$", "") if name == "date" else o["v"]
    value = F.unhex(text) if to == "binary" else text.try_cast(to)
    right = (o["v"].rlike(form) if form else F.lit(True)) & value.isNotNull()
    own = o["d"].isin([XSD + x for x in (name, *wider)]) & o["l"].isNull()
    problem = F.when(o["k"] != LITERAL, "kind").when(~F.coalesce(own, F.lit(False)), "datatype").when(~F.coalesce(right, F.lit(False)), "value")
    rows = graph.where((F.col("p.v") == p) & (F.col("p.k") == IRI)).select("s", "o", value.alias("value"), problem.alias("problem"))
    return rows.select("s", "o", F.when(F.col("problem").isNull(), F.col("value")).alias("value"), "problem")


def list_members(graph: DataFrame, head: Term | None = None) -> DataFrame:
    """head, position (from 0), item and cell for each cell of every well-formed list of a graph, or of the list at `head`: each cell with
    one rdf:first and one rdf:rest, ending in rdf:nil.

    Rounds grow with the logarithm of the longest list: each round every cell takes over what the cell it points at knows,
    so that it points twice as far. Then members are found by these pointers, the shortest first: what is known of a list
    doubles each round, and each member is made once. Loops never reach an end and are left out.
    """
    one = lambda p: graph.where(F.col("p.v") == RDF + p).groupBy("s").agg(F.min("o").alias("o"), F.count("o").alias("n")).where("n = 1").drop("n")
    cells = materialize(one("first").withColumnRenamed("o", "item").join(one("rest").withColumnRenamed("o", "next"), "s"), "cells")
    nil = (F.col("target.k") == IRI) & (F.col("target.v") == RDF + "nil")
    # (cell, target): 2 ** level cells on, or the end if that is nearer
    levels = [cells.select("s", F.col("next").alias("target"))]
    total = cells.count()
    while (1 << len(levels) - 1) <= total and not levels[-1].where(~nil).isEmpty():
        # cells that have reached the end stay as they are: they would all meet at it, in one task
        hops, done = levels[-1].where(~nil), levels[-1].where(nil)
        far = levels[-1].select(F.col("s").alias("target"), F.col("target").alias("t2"))
        levels.append(materialize(hops.join(far, "target", "left").select("s", F.coalesce("t2", "target").alias("target")).unionByName(done), "hops"))
    starts = levels[-1].where(nil).select("s")
    starts = starts.where(F.col("s").eqNullSafe(head.column())) if head is not None else starts.join(cells.select(F.col("next").alias("s")), "s", "left_anti")
    members = materialize(starts.select(F.col("s").alias("head"), "s", F.lit(0).cast("long").alias("position")), "members")
    for level, hops in enumerate(levels[:-1]):
        found = members.join(hops.where(~nil), "s").select("head", F.col("target").alias("s"), (F.col("position") + F.lit(1 << level)).alias("position"))
        members = members.unionByName(materialize(found, "members"))
    return members.join(cells.select("s", "item"), "s").select("head", "position", "item", F.col("s").alias("cell"))


#: Rows of cells among which lists are looked for at once.
NEAR = 100_000


def near_lists(cells: DataFrame, others: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Lists whose cells stand near each other, found without a join; and the triples of all others.

    `cells`: g, s, p, o, distinct triples with rdf:first or rdf:rest alone. The first frame has g, head and cells (labels) and items of lists of blank cells
    whose labels nothing else in `cells` has; with `others` (the remaining quads), whose labels these have not either, but for the head, once, as an object.
    """
    blank = lambda c: F.col(f"{c}.k") == BNODE
    nil = (F.col("o.k") == IRI) & (F.col("o.v") == RDF + "nil")
    name = lambda c: F.xxhash64("g", f"{c}.v")
    first, to = F.col("p.v") == RDF + "first", ~F.col("first") & blank("o")
    rows = cells.withColumn("first", first).select("g", F.col("s.v").alias("label"), F.col("s.k").alias("kind"), "first", (~F.col("first") & nil).alias("nil"), F.when(to, F.col("o.v")).alias("to"),
                                                   F.when(F.col("first") | ~(nil | blank("o")), F.col("o")).alias("o"), F.when(blank("s"), name("s")).alias("hs"), F.when(to, name("o")).alias("ho"))
    schema = f"g {TERM_DDL}, label string, kind tinyint, first boolean, nil boolean, to string, o {TERM_DDL}, items array<{TERM_DDL}>, cells array<string>"
    found = materialize(rows.mapInArrow(_near, schema), "near")
    lists = found.where("cells IS NOT NULL").select("g", F.col("cells")[0].alias("head"), "items", "cells")
    target = F.when(F.col("nil"), iri(RDF + "nil").column()).otherwise(F.coalesce(term(BNODE, F.col("to")), F.col("o")))
    rest = found.where("cells IS NULL").select("g", term(F.col("kind"), F.col("label")).alias("s"), F.when(F.col("first"), iri(RDF + "first").column()).otherwise(iri(RDF + "rest").column()).alias("p"), target.alias("o"))
    # each label adds up to 11 if it is the head of a list and used once, or a further cell, and nothing else
    weights = lists.select(F.posexplode("cells").alias("i", "v")).select(F.xxhash64("v").alias("h"), F.when(F.col("i") == 0, 11 if others is None else 10).otherwise(11).alias("w"))
    used = [(rest, "s", 100), (rest, "o", 100)]
    if others is not None:
        used += [(lists, "g", 100), (rest, "g", 100), (lists.select(F.explode("items").alias("o")), "o", 100), (others, "g", 100), (others, "s", 100), (others, "o", 1)]
    for df, c, w in used:
        weights = weights.unionByName(df.where(blank(c) if c != "s" or df is not rest else F.lit(True)).select(F.xxhash64(f"{c}.v").alias("h"), F.lit(w).alias("w")))
    sums = weights.groupBy("h").agg(F.sum("w").alias("n"), F.max(F.col("w").isin(10, 11)).alias("cell"))
    wrong = materialize(sums.where("cell AND n <> 11").select("h"), "wrong")
    if not wrong.isEmpty():
        of = F.struct("g", "head")
        bad = materialize(lists.select("g", "head", F.explode("cells").alias("v")).withColumn("h", F.xxhash64("v")).join(wrong, "h", "left_semi").select(of.alias("x")).distinct(), "bad")
        lists = lists.withColumn("x", of)
        back = lists.join(bad, "x", "left_semi").select("g", "cells", F.posexplode("items").alias("i", "item"))
        cell = lambda i: term(BNODE, F.get("cells", i))
        link = F.coalesce(cell(F.col("i") + 1), iri(RDF + "nil").column())
        both = F.array(*[F.struct(iri(RDF + p).column().alias("p"), o.alias("o")) for p, o in (("first", F.col("item")), ("rest", link))])
        rest = rest.unionByName(back.select("g", cell(F.col("i")).alias("s"), F.explode(both).alias("t")).select("g", "s", "t.p", "t.o"))
        lists = lists.join(bad, "x", "left_anti").drop("x")
    return lists, rest


def _near(batches):
    """Rows of near_lists to lists that are whole among NEAR rows or so, and triples of the others."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def whole(t: pa.Table) -> tuple:
        """Rows with the items of whole lists, one after the other, the lists' offsets in them, and the rows that no list has."""
        first, end, hs, ho = (x.fill_null(pa.scalar(0).cast(x.type)).to_numpy(zero_copy_only=False) for x in (t.column(c).combine_chunks() for c in ("first", "nil", "hs", "ho")))
        labels, targets = (t.column(c).combine_chunks() for c in ("label", "to"))
        graphs = t.column("g").combine_chunks()
        graphs = [graphs.is_valid().cast("int8"), *[pc.fill_null(pc.cast(x, "string"), "") for x in graphs.flatten()]]
        blank, to_blank = (t.column(c).is_valid().combine_chunks().to_numpy(zero_copy_only=False) for c in ("hs", "ho"))
        same = lambda x, a, y, b: np.logical_and.reduce([pc.equal(u.take(pa.array(a)), v.take(pa.array(b))).to_numpy(zero_copy_only=False) for u, v in ((x, y), *zip(graphs, graphs))])
        order = np.argsort(hs, kind="stable")
        order = order[blank[order]]
        sorted_ = hs[order]
        start = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(order) else np.zeros(0, dtype="i8")
        two = start[np.diff(np.append(start, len(order))) == 2]
        a, b = order[two], order[two + 1]
        good = first[a] != first[b]
        a, b = a[good], b[good]
        item, rest = np.where(first[a], a, b), np.where(first[a], b, a)
        good = same(labels, item, labels, rest) if len(item) else np.zeros(0, dtype=bool)
        item, rest = item[good], rest[good]
        m = len(item)
        # m stands for the end, m + 1 for a cell that is not here
        names = hs[item]
        at = np.minimum(np.searchsorted(names, ho[rest]), max(m - 1, 0))
        there = to_blank[rest] & (names[at] == ho[rest]) if m else np.zeros(0, dtype=bool)
        there[there] = same(targets, rest[there], labels, item[at[there]])
        links = np.bincount(at[there], minlength=m)
        there &= links[at] == 1 if m else there
        step = np.append(np.where(there, at, np.where(end[rest], m, m + 1)), [m, m + 1])
        left, jump = np.append(np.ones(m, dtype="i8"), [0, 0]), step
        back = np.arange(m + 2)
        back[step[:m][there]] = np.flatnonzero(there)
        for _ in range(max(m, 1).bit_length()):
            if (jump[:m] >= m).all():
                break
            left, jump, back = left + left[jump], jump[jump], back[back]
        # a head comes back to itself; in a loop, which has none, no cell reaches the end
        ends = np.flatnonzero(jump[:m] == m)
        for _ in range(max(m, 1).bit_length()):
            if (back[back[ends]] == back[ends]).all():
                break
            back = back[back]
        ends = ends[np.lexsort((-left[ends], back[ends]))]
        heads = back[ends]
        offsets = np.append(np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1]])) if len(heads) else np.zeros(0, dtype="i8"), len(heads))
        free = np.ones(len(t), dtype=bool)
        free[item[ends]] = free[rest[ends]] = False
        return item[ends], offsets, np.flatnonzero(free)

    names = ["g", "label", "kind", "first", "nil", "to", "o", "items", "cells"]

    def lists(t: pa.Table, rows, offsets) -> pa.RecordBatch:
        at, n, rows = pa.array(offsets, pa.int32()), len(offsets) - 1, pa.array(rows)
        o, labels, g = (t.column(c).combine_chunks() for c in ("o", "label", "g"))
        nothing = [pa.nulls(n, t.column(c).type) for c in names[1:7]]
        return pa.RecordBatch.from_arrays([g.take(rows.take(at[:-1])), *nothing, pa.ListArray.from_arrays(at, o.take(rows)), pa.ListArray.from_arrays(at, labels.take(rows))], names=names)

    def others(t: pa.Table) -> list[pa.RecordBatch]:
        n, made = len(t), [t.column(c).combine_chunks() for c in names[:7]]
        return [pa.RecordBatch.from_arrays([*made, pa.nulls(n, pa.list_(made[6].type)), pa.nulls(n, pa.list_(pa.string()))], names=names)] if n else []

    waiting, size, kept = [], 0, None
    for b in batches:
        waiting.append(b)
        size += b.num_rows + b.nbytes // 1000
        if size < NEAR:
            continue
        t = pa.Table.from_batches(waiting)
        rows, offsets, free = whole(t)
        if len(rows):
            yield lists(t, rows, offsets)
        kept = t.take(pa.array(free)).combine_chunks()
        if len(kept) + kept.nbytes // 1000 > NEAR:
            yield from others(kept)
            kept = kept.slice(0, 0)
        waiting, size = kept.to_batches(), 0
    if waiting:
        t = pa.Table.from_batches(waiting)
        rows, offsets, free = whole(t)
        if len(rows):
            yield lists(t, rows, offsets)
        yield from others(t.take(pa.array(free)))


def list_items(graph: DataFrame) -> DataFrame:
    """head, items for every list of list_members, one row a list; a list too long for a row stays with list_members."""
    cells = graph.where(F.col("p.v").isin(RDF + "first", RDF + "rest")).select(F.lit(None).cast(TERM_DDL).alias("g"), "s", "p", "o")
    lists, rest = near_lists(cells)
    lists = lists.select(term(BNODE, F.col("head")).alias("head"), "items")
    if rest.isEmpty():
        return lists
    members = list_members(materialize(rest.select("s", "p", "o"), "cells")).groupBy("head").agg(F.sort_array(F.collect_list(F.struct("position", "item"))).alias("x"))
    return lists.unionByName(members.select("head", F.transform("x", lambda e: e["item"]).alias("items")))
