"""Virtual graphs: relational tables read as RDF without making triples.

Subject IRIs are urn:x:<table>/<key>, predicates urn:x:<table>#<column>. Patterns on one subject become one scan of its
table; foreign keys are compared as the keys they are; text of an IRI is only made where it is asked for.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import Typed, box, compare, constant, unified
from ..plans.compiler import GRAPH, Solutions, Store, enc
from ..storage import spread
from ..terms import BNODE, IRI, LITERAL, RDF, VARIABLE, Term, literal, term

PREFIX = "urn:x:"
#: Rows that a task unfolds.
ROWS = 100_000


@dataclass
class Table:
    """key: columns whose values, joined by '/', name a row; foreign: column -> table whose key it holds; tagged: text column -> column of its language."""

    name: str
    key: list[str]
    foreign: dict[str, str] = field(default_factory=dict)
    tagged: dict[str, str] = field(default_factory=dict)
    skip: tuple[str, ...] = ()


# The driver's tables.
TABLES = [
    Table("region", ["r_regionkey"]), Table("nation", ["n_nationkey"], {"n_regionkey": "region"}), Table("customer", ["c_custkey"], {"c_nationkey": "nation"}),
    Table("supplier", ["s_suppkey"], {"s_nationkey": "nation"}), Table("part", ["p_partkey"]), Table("orders", ["o_orderkey"], {"o_custkey": "customer"}),
    Table("lineitem", [], {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}), Table("events", ["event_id"]), Table("documents", ["doc_id"], tagged={"text": "lang"}),
    Table("labels", ["doc_id"], {"doc_id": "documents"}), Table("pages", ["page_id"]), Table("benchmark", ["item_id"]), Table("conversations", ["conv_id", "turn"]),
]


class VirtualStore(Store):
    """The tables of a folder of Parquet files as a graph; each table is also the named graph urn:x:graph/<table>.

    `rows`: larger tables are dealt out to tasks of so many rows before stars are joined, for queries that make many solutions or much text of a row.
    """

    def __init__(self, spark: SparkSession, folder: str, tables: list[Table] | None = None, rows: int | None = None):
        self.spark, self.folder, self.rows = spark, folder, rows
        self.tables = {t.name: t for t in tables or TABLES}
        self.frames: dict[str, DataFrame] = {}

    def frame(self, name: str) -> DataFrame:
        if name not in self.frames:
            df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            t = self.tables[name]
            self.frames[name] = df if t.key else df.select("*", F.concat_ws("-", F.col("_metadata.file_name"), F.col("_metadata.row_index").cast("string")).alias("__row"))
        return self.frames[name]

    def subject(self, t: Table) -> Typed:
        keys = t.key or ["__row"]
        if len(keys) == 1:
            return Typed(f"ref:{PREFIX}{t.name}/", F.col(keys[0]))
        return Typed("iri", F.concat(F.lit(f"{PREFIX}{t.name}/"), F.concat_ws("/", *keys)))

    def object(self, t: Table, column: str) -> Typed | None:
        c = F.col(column)
        if column in t.foreign:
            return Typed(f"ref:{PREFIX}{t.foreign[column]}/", c)
        if column in t.tagged:
            return Typed("term", term(2, c, None, F.lower(F.col(t.tagged[column]))))
        kind = self.frame(t.name).schema[column].dataType
        if isinstance(kind, (T.IntegerType, T.LongType, T.ShortType)):
            return Typed("int", c.cast("bigint"))
        names = {T.DoubleType: "dbl", T.FloatType: "flt", T.StringType: "str", T.BooleanType: "bool", T.TimestampNTZType: "dt", T.DecimalType: "dec"}
        return next((Typed(k, c) for cls, k in names.items() if isinstance(kind, cls)), None)

    def _table_of(self, p: Term, o: Term) -> str | None:
        if p.value == RDF + "type":
            return o.value.removeprefix(PREFIX) if o.kind == IRI and o.value.removeprefix(PREFIX) in self.tables else None
        name, _, column = p.value.removeprefix(PREFIX).partition("#")
        return name if p.value.startswith(PREFIX) and name in self.tables and column in self.frame(name).columns else None

    def bgp(self, triples: list, active) -> list[Solutions]:
        """Stars (one subject, constant predicates of one table) as one scan each, then all other patterns."""
        stars: dict[tuple, list] = {}
        rest = []
        for t in triples:
            s, p, o = t
            name = self._table_of(p, o) if p.kind == IRI else None
            if name is None or s.kind not in (VARIABLE, BNODE, IRI):
                rest.append(t)
            else:
                stars.setdefault((s, name), []).append(t)
        return [self.star(s, name, ts, active) for (s, name), ts in stars.items()] + [self.pattern(t, active) for t in rest]

    def star(self, s: Term, name: str, triples: list, active) -> Solutions:
        t = self.tables[name]
        df = self.frame(name)
        if self.rows:
            df = spread(df, t.key or ["__row"], self.rows)
        graph = f"{PREFIX}graph/{name}"
        if (isinstance(active, str) and active not in (GRAPH, graph)) or (isinstance(active, list) and graph not in active):
            df = df.where(F.lit(False))
        values: list[tuple[Term, Typed]] = [(s, self.subject(t))]
        for _, p, o in triples:
            if p.value == RDF + "type":
                continue
            column = p.value.partition("#")[2]
            value = self.object(t, column)
            df = df.where(F.col(column).isNotNull())
            values.append((o, value))
        bound: dict[str, Typed] = {GRAPH: Typed("iri", F.lit(graph))} if active == GRAPH else {}
        for target, value in values:
            if target.kind in (VARIABLE, BNODE):
                n = target.value if target.kind == VARIABLE else f"_:{target.value}"
                if n in bound:
                    a, b = unified(bound[n], value)
                    df = df.where(a.col == b.col)
                else:
                    bound[n] = value
            else:
                df = df.where(self._equals(value, target))
        return Solutions(df.select(*[v.col.alias(enc(n)) for n, v in bound.items()]), {n: v.kind for n, v in bound.items()})

    def _equals(self, value: Typed, t: Term):
        """Identity with a constant, on the plain column where that is the same, so that the scan can use it."""
        if value.kind.startswith("ref:"):
            key = t.value.removeprefix(value.kind[4:])
            return value.col == (int(key) if key.isdigit() else key) if t.kind == IRI and t.value.startswith(value.kind[4:]) else F.lit(False)
        c = constant(t)
        if value.kind == c.kind and c.const is not None and (c.kind != "int" or literal(int(t.value)) == t):
            return compare("=", value, c)
        return box(value).eqNullSafe(t.column())

    def pattern(self, triple: tuple, active) -> Solutions:
        """Any other pattern: over the triples of all tables, each row unfolded in one pass."""
        s, p, o = triple
        name = self._table_of(p, o) if p.kind == IRI else None
        if name is not None and s.kind in (VARIABLE, BNODE, IRI):
            return self.star(s, name, [triple], active)
        only = [t for t in (s, o) if t.kind == IRI][:1]
        return Store(self.quads(active, only)).pattern(triple, active if active == GRAPH else None)

    def about(self, terms: list[Term], active) -> DataFrame:
        q = self.quads(active, terms)
        names = [t.value for t in terms]
        return q.where(((F.col("s.k") == IRI) & F.col("s.v").isin(names)) | ((F.col("o.k") == IRI) & F.col("o.v").isin(names))).select("s", "p", "o")

    has_triple_terms = False
    reads_files = True

    def _rows_with(self, t: Table, df: DataFrame, only: list[Term]) -> DataFrame | None:
        """The rows that can have one of the resources as subject or object, found by key; None if there can be none."""
        tests = []
        columns = [(c, f"{PREFIX}{x}/") for c, x in t.foreign.items()] + ([(t.key[0], f"{PREFIX}{t.name}/")] if len(t.key) == 1 else [])
        for c, prefix in columns:
            keys = [x.value.removeprefix(prefix) for x in only if x.value.startswith(prefix)]
            if keys:
                tests.append(F.col(c).isin([int(k) if k.isdigit() else k for k in keys]))
        if len(t.key) != 1 and any(x.value.startswith(f"{PREFIX}{t.name}/") for x in only):
            return df
        if any(x.value == PREFIX + t.name for x in only):
            return df
        out = None
        for test in tests:
            out = test if out is None else out | test
        return None if out is None else df.where(out)

    def quads(self, active=None, only: list[Term] | None = None) -> DataFrame:
        """The triples of all tables (or of those whose graphs are active) as g, s, p, o; with `only`, at least those about these resources."""
        out = None
        for name, t in self.tables.items():
            graph = f"{PREFIX}graph/{name}"
            if (isinstance(active, str) and active not in (GRAPH, graph)) or (isinstance(active, list) and graph not in active):
                continue
            try:
                df = self.frame(name)
            except Exception as e:
                if "PATH_NOT_FOUND" in str(e):
                    continue
                raise
            if only:
                df = self._rows_with(t, df, only)
                if df is None:
                    continue
            else:
                df = spread(df, t.key or ["__row"], ROWS)
            subject = box(self.subject(t))
            items = [F.struct(term(IRI, F.lit(RDF + "type")).alias("p"), term(IRI, F.lit(PREFIX + name)).alias("o"))]
            for c in df.columns:
                value = self.object(t, c) if c != "__row" and c not in t.skip else None
                if value is not None:
                    items.append(F.struct(term(IRI, F.lit(f"{PREFIX}{name}#{c}")).alias("p"), box(value).alias("o")))
            g = term(IRI, F.lit(graph)) if active == GRAPH else F.lit(None).cast("struct<k:tinyint,v:string,d:string,l:string,r:string>")
            rows = df.select(g.alias("g"), subject.alias("s"), F.explode(F.array(*items)).alias("t")).select("g", "s", "t.p", "t.o").where(F.col("o").isNotNull())
            out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self.spark.createDataFrame([], "g struct<k:tinyint,v:string,d:string,l:string,r:string>, s struct<k:tinyint,v:string,d:string,l:string,r:string>, p struct<k:tinyint,v:string,d:string,l:string,r:string>, o struct<k:tinyint,v:string,d:string,l:string,r:string>")

    def nodes_among(self, terms: DataFrame, active) -> DataFrame:
        """As in Store. Where no literal is looked for, the keys of tables and what refers to them will do: no row is unfolded."""
        if not terms.where(F.col("n.k") == LITERAL).isEmpty():
            return super().nodes_among(terms, active)
        out = None
        for name, t in self.tables.items():
            graph = f"{PREFIX}graph/{name}"
            if (isinstance(active, str) and active not in (GRAPH, graph)) or (isinstance(active, list) and graph not in active):
                continue
            df = self.frame(name)
            # each key that is referred to, and the class, is there once: they would meet their term in one task
            for rows, x in ((df, self.subject(t)), *[(df.select(c).distinct(), self.object(t, c)) for c in t.foreign], (df.limit(1), Typed("iri", F.lit(PREFIX + name)))):
                nodes = rows.select(*([term(IRI, F.lit(graph)).alias(GRAPH)] if active == GRAPH else []), box(x).alias("n")).where(F.col("n").isNotNull())
                out = nodes if out is None else out.unionByName(nodes)
        return terms.select("n").distinct().limit(0) if out is None else out.join(terms.select("n").distinct(), ["n"], "left_semi").distinct()

    def graphs(self) -> DataFrame:
        return self.spark.createDataFrame([((IRI, f"{PREFIX}graph/{n}", None, None, None),) for n in self.tables], f"{GRAPH} struct<k:tinyint,v:string,d:string,l:string,r:string>")
