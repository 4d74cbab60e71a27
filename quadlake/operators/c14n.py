"""Canonical blank node labels (RDFC-1.0 with an extension for triple terms) and isomorphism."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import groupby, permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.nquads import line_column
from ..storage import materialize
from ..terms import BNODE, IRI, TERM_DDL, TRIPLE, VARIABLE, Term, bnode, canonical_column, iri, parts_column, term, triple_term
from .components import components

#: The namespace of graphs that stand for triple terms in the extension.
TRIPLE_GRAPH = "urn:quadlake:triple-term:"


#: Blank nodes whose orders are tried, and neighbourhoods that are looked at, before a component is refused as toxic.
MOST_PERMUTED, MOST_CALLS = 6, 2_000_000
#: Nodes without a hash of their own for a task.
NODES = 20_000


class ToxicGraph(ValueError):
    """A graph whose blank nodes are too alike to be told apart within the limits."""


def first_degree_hashes(quads: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """node, hash for each blank node: the hash of its quads with itself as _:a and any other as _:z, sorted; without the driver."""
    bits = {"sha256": 256, "sha384": 384}[algorithm]
    rows = quads.select(*[c for c in ("g", "s", "p", "o")], F.explode(F.array_distinct(F.filter(F.array("g", "s", "p", "o"), lambda t: t.isNotNull() & (t["k"] == BNODE)))).alias("n"))
    mark = lambda c: F.when((F.col(f"{c}.k") == BNODE) & (F.col(f"{c}.v") == F.col("n.v")), "_:a").when(F.col(f"{c}.k") == BNODE, "_:z").otherwise(canonical_column(F.col(c)))
    line = F.concat(F.concat_ws(" ", mark("s"), mark("p"), mark("o"), mark("g")), F.lit(" .\n"))
    return rows.select(F.col("n.v").alias("node"), line.alias("line")).groupBy("node").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("line")), ""), bits).alias("hash"))


def _hash(text: str, algorithm: str) -> str:
    return hashlib.new(algorithm, text.encode()).hexdigest()


class _Issuer:
    def __init__(self, prefix: str, issued: dict[str, str] | None = None, count: int | None = None):
        self.prefix, self.issued = prefix, dict(issued or {})
        self.count = len(self.issued) if count is None else count

    def __call__(self, label: str) -> str:
        if label not in self.issued:
            self.issued[label] = f"{self.prefix}{self.count}"
            self.count += 1
        return self.issued[label]

    def copy(self) -> _Issuer:
        return _Issuer(self.prefix, self.issued, self.count)


class _Namer:
    """N-degree hashes of blank nodes that share a first-degree hash with others; `named`: the canonical names there are so far."""

    def __init__(self, quads: list[tuple], first: dict[str, str], named: dict[str, str], algorithm: str, deepest: int, most_permuted: int, most_calls: int):
        self.first, self.named, self.algorithm, self.deepest, self.most_permuted = first, named, algorithm, deepest, most_permuted
        self.calls_left = most_calls
        self.of: dict[str, list[tuple]] = {}
        for q in quads:
            for label in {t.value for t in q if t is not None and t.kind == BNODE}:
                self.of.setdefault(label, []).append(q)

    def _related(self, label: str, q: tuple, issuer: _Issuer, place: str) -> str:
        name = self.named.get(label) or issuer.issued.get(label)
        text = place + (f"<{q[2].value}>" if place != "g" else "") + (f"_:{name}" if name else self.first[label])
        return _hash(text, self.algorithm)

    def _neighbourhood(self, label: str, issuer: _Issuer, depth: int) -> Iterator:
        """Yields the neighbourhoods that it needs and is sent their results; returns a hash and an issuer. An issuer is copied only where several orders are tried."""
        if depth > self.deepest:
            raise ToxicGraph("the neighbourhood of a blank node goes too deep")
        near: dict[str, set[str]] = {}
        for q in self.of[label]:
            for place, t in (("s", q[1]), ("o", q[3]), ("g", q[0])):
                if t is not None and t.kind == BNODE and t.value != label:
                    near.setdefault(self._related(t.value, q, issuer, place), set()).add(t.value)
        text = ""
        for h in sorted(near):
            text += h
            if len(near[h]) > self.most_permuted:
                raise ToxicGraph("too many blank nodes are alike")
            best: tuple[str, _Issuer] | None = None
            for order in permutations(sorted(near[h])):
                mine, path, todo = issuer.copy() if len(order) > 1 else issuer, "", []
                for x in order:
                    if x in self.named:
                        path += f"_:{self.named[x]}"
                    else:
                        if x not in mine.issued:
                            todo.append(x)
                        path += f"_:{mine(x)}"
                    if best and len(path) >= len(best[0]) and path > best[0]:
                        break
                else:
                    for x in todo:
                        h2, deeper = yield x, mine, depth + 1
                        path += f"_:{mine(x)}<{h2}>"
                        mine = deeper
                        if best and len(path) >= len(best[0]) and path > best[0]:
                            break
                    else:
                        if best is None or path < best[0]:
                            best = (path, mine)
            text += best[0]
            issuer = best[1]
        return _hash(text, self.algorithm), issuer

    def __call__(self, label: str) -> tuple[str, list[str]]:
        """N-degree hash of a node, and the nodes of its neighbourhood in the order of their names. Calls wait on a list, so that no depth is too much for Python."""
        issuer = _Issuer("b")
        issuer(label)
        waiting, answer = [self._neighbourhood(label, issuer, 1)], None
        while waiting:
            try:
                asked = waiting[-1].send(answer)
            except StopIteration as done:
                waiting.pop()
                answer = done.value
            else:
                self.calls_left -= 1
                if self.calls_left < 0:
                    raise ToxicGraph("blank nodes take too long to be told apart")
                waiting.append(self._neighbourhood(*asked))
                answer = None
        return answer[0], list(answer[1].issued)


def canonical_labels(quads: list[tuple], first: dict[str, str], algorithm: str = "sha256", depth_factor: float = 1.0, most_permuted: int = MOST_PERMUTED, named: dict[str, str] | None = None, count: int = 0, most_calls: int = MOST_CALLS) -> dict[str, str]:
    """Label -> c14nN of a list of quads, after the first-degree hashes are known. Nodes of a hash of their own are named at once, in the order of
    hashes; only the others are told apart by the hashes of their neighbourhoods, within the limits.

    Where `count` nodes of hashes of their own have names already, `first` and `quads` need only tell of the other nodes,
    and `named` the names of those that occur in these quads."""
    by_hash: dict[str, list[str]] = {}
    for label, h in first.items():
        by_hash.setdefault(h, []).append(label)
    issue = _Issuer("c14n", named, count)
    for h in sorted(by_hash):
        if len(by_hash[h]) == 1:
            issue(by_hash[h][0])
    namer = _Namer(quads, first, issue.issued, algorithm, max(1, int(depth_factor * (len(first) + count))), most_permuted, most_calls)
    for h in sorted(by_hash):
        results = [namer(label) for label in sorted(by_hash[h]) if label not in issue.issued]
        for _, order in sorted(results, key=lambda r: r[0]):
            for label in order:
                issue(label)
    return issue.issued


def _prepared(quads: DataFrame, extended: bool) -> DataFrame:
    bad = quads.where((F.col("p.k") == BNODE) | F.coalesce(F.col("g.k") == VARIABLE, F.lit(False)) | (F.col("s.k") == VARIABLE) | (F.col("p.k") == VARIABLE) | (F.col("o.k") == VARIABLE) | (F.col("s.k") == TRIPLE) | (F.col("o.k") == TRIPLE))
    if not extended and not bad.limit(1).isEmpty():
        raise ValueError("generalised RDF and triple terms have no canonical form by RDFC-1.0")
    return quads.select("g", "s", "p", "o").distinct()


def _relabel(quads: DataFrame, labels: DataFrame) -> DataFrame:
    """Replace the values of blank nodes by joins with (node, label)."""
    for c in ("g", "s", "p", "o"):
        m = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        quads = quads.join(m, (F.col(f"{c}.k") == BNODE) & (F.col(f"{c}.v") == F.col("_n")), "left")
        quads = quads.withColumn(c, F.when(F.col("_l").isNotNull(), F.struct(F.col(f"{c}.k").alias("k"), F.col("_l").alias("v"), F.col(f"{c}.d").alias("d"), F.col(f"{c}.l").alias("l"), F.col(f"{c}.r").alias("r"))).otherwise(F.col(c))).drop("_n", "_l")
    return quads


def _counted(rows: DataFrame, order: list[str], size: str | None, start: int) -> tuple[DataFrame, int]:
    """rows with `place`: `start` and the sizes (1 each if None) of all rows before them in order; and the sum of all. Each range of the order
    counts by itself, from where the ranges before it end."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size_ = F.lit(1) if size is None else F.col(size)
    ranges = materialize(rows.withColumn("_s", size_.cast("long")).repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    starts, total = [], start
    for r in ranges.groupBy("_p").agg(F.sum("_s").alias("n")).orderBy("_p").collect():
        starts.append((r["_p"], total))
        total += r["n"]
    before = F.coalesce(F.sum("_s").over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    table = F.broadcast(spark.createDataFrame(starts, "_p int, _start long"))  # one row a range
    return ranges.withColumn("place", before).join(table, "_p").withColumn("place", F.col("place") + F.col("_start")).drop("_p", "_s", "_start"), total


def _name(place: Column) -> Column:
    return F.concat(F.lit("c14n"), place.cast("string"))


def _labels(quads: DataFrame, algorithm: str = "sha256", depth_factor: float = 1.0, most_permuted: int = MOST_PERMUTED, most_calls: int = MOST_CALLS, hashes: DataFrame | None = None) -> DataFrame:
    """node, label for each blank node of the quads; `hashes`: their first-degree hashes, if these are known.

    Names of nodes with a first-degree hash of their own go by the order of hashes. The others, joined where they share a quad, fall into components.
    Naming one node of a component by its neighbourhood names them all, and names of other components play no part in that; so each component is
    solved by itself, and then they follow each other by the first-degree hash that comes first in them and by its least N-degree hash.
    A component that takes more than `most_calls` neighbourhoods, one for each of its nodes and each start at least, is toxic.
    """
    hashes = materialize(first_degree_hashes(quads, algorithm), "hashes") if hashes is None else hashes
    counts = hashes.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    alike = materialize(counts.where("n > 1").select("hash"), "alike")
    own, total = _counted(hashes.join(alike, "hash", "left_anti"), ["hash"], None, 0)
    own = materialize(own.select("node", _name(F.col("place")).alias("label")), "names")
    if alike.isEmpty():
        return own
    rest = materialize(hashes.join(alike, "hash", "left_semi"), "rest")
    alone = rest.count()
    everything = total + alone
    keyed = materialize(quads.select(F.struct("g", "s", "p", "o").alias("q")), "quads")
    nodes = F.array_distinct(F.transform(F.filter(F.array("q.g", "q.s", "q.o"), lambda t: t.isNotNull() & (t["k"] == BNODE)), lambda t: t["v"]))
    at = keyed.select("q", F.explode(nodes).alias("node"))
    known = own.select("node", F.col("label").alias("name"), F.lit(None).cast("string").alias("hash")).unionByName(rest.select("node", F.lit(None).cast("string").alias("name"), "hash"))
    # three blank nodes a quad at most
    info = at.join(known, "node").groupBy("q").agg(F.collect_list(F.struct("node", "name", "hash")).alias("nodes"))
    info = materialize(info.withColumn("open", F.transform(F.filter("nodes", lambda x: x["hash"].isNotNull()), lambda x: x["node"])).where(F.size("open") > 0), "open")
    edges = info.where(F.size("open") > 1).select(F.get("open", F.lit(0)).alias("a"), F.explode(F.slice("open", 2, 2)).alias("b"))
    found = components(edges.unionByName(rest.select(F.col("node").alias("a"), F.col("node").alias("b"))))
    member = materialize(rest.join(found, "node"), "members")
    sizes = member.groupBy("label", "hash").agg(F.count(F.lit(1)).alias("n")).groupBy("label").agg(F.min(F.struct("hash", "n")).alias("first"), F.sum("n").alias("nodes"))
    work = materialize(info.select(F.get("open", F.lit(0)).alias("node"), "q", "nodes").join(member.select("node", "label"), "node").drop("node"), "work")
    heavy = work.groupBy("label").agg(F.count(F.lit(1)).alias("quads")).join(sizes, "label").where((F.col("first.n") * F.col("nodes") > most_calls) | (F.col("quads") > most_calls))
    if not heavy.isEmpty():
        raise ToxicGraph("a component has too many blank nodes that are alike")
    deepest = max(1, int(depth_factor * everything))
    # by number, so that Spark doesn't put many small components into few tasks
    parts = max(int(quads.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-alone // NODES))
    dealt = work.select("label", "nodes", "q.g", "q.s", "q.p", "q.o").repartition(parts, "label").sortWithinPartitions("label")
    solved = dealt.mapInArrow(_solver(algorithm, deepest, most_permuted, most_calls), "hash string, degree string, nodes array<string>")
    solved = materialize(solved, "solved")
    toxic = solved.where("hash IS NULL").select("degree").first()
    if toxic:
        raise ToxicGraph(toxic[0])
    placed, _ = _counted(solved.withColumn("size", F.size("nodes")), ["hash", "degree", "nodes"], "size", total)
    names = placed.select("place", F.posexplode("nodes").alias("i", "node")).select("node", _name(F.col("place") + F.col("i")).alias("label"))
    return own.unionByName(names)


def _solver(algorithm: str, deepest: int, most_permuted: int, most_calls: int):
    """For each component, whose quads follow each other, the names' order in it: the first of its first-degree hashes, the least N-degree hash of that, and its nodes; a null hash and a reason if it is toxic."""

    def solve(rows: list[dict]) -> tuple:
        first, named, quads = {}, {}, []
        for row in rows:
            for x in row["nodes"]:
                if x["hash"] is None:
                    named[x["node"]] = x["name"]
                else:
                    first[x["node"]] = x["hash"]
            quads.append(tuple(None if row[c] is None else Term(row[c]["k"], row[c]["v"]) for c in "gspo"))
        least = min(first.values())
        namer = _Namer(quads, first, named, algorithm, deepest, most_permuted, most_calls)
        try:
            return (least, *min((namer(x) for x in sorted(first) if first[x] == least), key=lambda r: r[0]))
        except ToxicGraph as e:
            return None, str(e), []

    def table(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.string(), pa.list_(pa.string())))], names=["hash", "degree", "nodes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for _, rows in groupby((row for b in batches for row in b.to_pylist()), key=lambda row: row["label"]):
            found.append(solve(list(rows)))
            if len(found) == 10_000:
                yield table(found)
                found = []
        if found:
            yield table(found)

    return run


def relabeled(quads: DataFrame, extended: bool = False, **limits) -> DataFrame:
    """The dataset with canonical labels; nothing of it goes through the driver. `extended`: with triple terms and generalised terms as plain quads."""
    quads = _prepared(quads, extended)
    quads = as_quads(quads) if extended else quads
    return _relabel(quads, _labels(quads, **limits))


def normalized(quads: DataFrame, **options) -> DataFrame:
    """The canonical document: its lines (`value`), sorted by code point."""
    return relabeled(quads, **options).select(line_column(quads).alias("value")).orderBy("value")


def _as_quads(quads: list[tuple]) -> list[tuple]:
    """Triple terms and generalised terms as plain quads: each triple term becomes a named graph with its triple, and a blank node of its own."""
    out: list[tuple] = []
    known: dict[str, Term] = {}

    def plain(t: Term | None, place: str) -> Term | None:
        if t is None:
            return None
        if t.kind == VARIABLE:
            return iri(f"{TRIPLE_GRAPH}variable:{t.value}")
        if t.kind == TRIPLE:
            if t.value not in known:
                me = known[t.value] = bnode(f"tt{len(known)}_")
                s, p, o = (plain(x, y) for x, y in zip(t.parts, "spo"))
                for name, x in (("s", s), ("p", p), ("o", o)):
                    out.append((iri(TRIPLE_GRAPH + "graph"), me, iri(TRIPLE_GRAPH + name), x))
            return known[t.value]
        return t

    for g, s, p, o in quads:
        g, s, p, o = plain(g, "g"), plain(s, "s"), plain(p, "p"), plain(o, "o")
        if p.kind != IRI:
            me = bnode(f"gp{len(out)}_")
            out += [(g, s, iri(TRIPLE_GRAPH + "statement"), me), (g, me, iri(TRIPLE_GRAPH + "p"), p), (g, me, iri(TRIPLE_GRAPH + "o"), o)]
        else:
            out.append((g, s, p, o))
    return list(dict.fromkeys(out))


def dataset_hash(quads: list[tuple], algorithm: str = "sha256", **limits) -> str:
    """A hash that is the same for isomorphic datasets only, also with triple terms and generalised terms."""
    from ..sources.nquads import quad_line

    plain = _as_quads([q if len(q) == 4 else (None, *q) for q in quads])
    of: dict[str, list[str]] = {}
    for q in plain:
        for label in {t.value for t in q if t is not None and t.kind == BNODE}:
            swap = tuple(t if t is None or t.kind != BNODE else bnode("a" if t.value == label else "z") for t in q)
            of.setdefault(label, []).append(quad_line(swap) + "\n")
    first = {label: _hash("".join(sorted(lines)), algorithm) for label, lines in of.items()}
    names = canonical_labels(plain, first, algorithm, **limits)
    lines = sorted({quad_line(tuple(t if t is None or t.kind != BNODE else bnode(names[t.value]) for t in q)) for q in plain})
    return _hash("\n".join(lines), algorithm)


def as_quads(quads: DataFrame) -> DataFrame:
    """Triple terms and generalised terms as plain quads, as a set: each triple term becomes a blank node of its own with its parts in a graph for them,
    a statement with another predicate than an IRI a blank node with its predicate and object, a variable an IRI. Triple terms are opened level by level, each once."""
    fixed = lambda name: iri(TRIPLE_GRAPH + name).column()

    def plain(c: Column) -> Column:
        return F.when(c["k"] == TRIPLE, term(BNODE, F.concat(F.lit("tt"), c["v"]))).when(c["k"] == VARIABLE, term(IRI, F.concat(F.lit(TRIPLE_GRAPH + "variable:"), c["v"]))).otherwise(c)

    level = quads.select(F.explode(F.array("g", "s", "p", "o")).alias("t")).where(F.col("t.k") == TRIPLE).distinct()
    out = None
    while not (level := materialize(level, "triple_terms")).isEmpty():
        opened = level.select("t", parts_column(F.col("t")).alias("x"))
        named = F.array(*[F.struct(fixed(c).alias("p"), plain(F.col("x")[i]).alias("o")) for i, c in enumerate("spo")])
        rows = opened.select(fixed("graph").alias("g"), plain(F.col("t")).alias("s"), F.explode(named).alias("y")).select("g", "s", "y.p", "y.o")
        out = rows if out is None else out.unionByName(rows)
        level = level.select(F.explode(parts_column(F.col("t"))).alias("t")).where(F.col("t.k") == TRIPLE).distinct()
    rows = quads.select(*[plain(F.col(c)).alias(c) for c in "gspo"])
    odd = rows.where(F.col("p.k") != IRI)
    me = term(BNODE, F.concat(F.lit("gp"), F.sha2(F.to_json(F.struct("g", "s", "p", "o")), 256)))
    made = F.array(F.struct(F.col("s").alias("s"), fixed("statement").alias("p"), me.alias("o")), F.struct(me.alias("s"), fixed("p").alias("p"), F.col("p").alias("o")), F.struct(me.alias("s"), fixed("o").alias("p"), F.col("o").alias("o")))
    odd = odd.select("g", F.explode(made).alias("y")).select("g", "y.s", "y.p", "y.o")
    rows = rows.where(F.col("p.k") == IRI).unionByName(odd)
    return (rows if out is None else rows.unionByName(out)).distinct()


def isomorphic(a: DataFrame, b: DataFrame, **limits) -> bool:
    """Whether two datasets, or graphs, are equal but for the labels of blank nodes, wherever these are: in triple terms and predicates, too.

    Sizes and ground quads are compared first, then how often each first-degree hash occurs, then the canonical forms of what has blank nodes, all by Spark and
    alike at every size.
    """
    a, b = (x.select(*([c for c in ("g",) if c in x.columns]), "s", "p", "o").distinct() for x in (a, b))
    if a.columns != b.columns or a.count() != b.count():
        return False
    open_ = lambda c: F.coalesce((F.col(f"{c}.k") == BNODE) | ((F.col(f"{c}.k") == TRIPLE) & F.col(f"{c}.v").contains("_:")), F.lit(False))
    blank = reduce(lambda x, y: x | y, [open_(c) for c in a.columns])
    ga, gb = a.where(~blank), b.where(~blank)
    if not ga.exceptAll(gb).isEmpty() or not gb.exceptAll(ga).isEmpty():
        return False
    none = F.lit(None).cast(TERM_DDL)
    a, b = (x.where(blank).select("g" if "g" in x.columns else none.alias("g"), "s", "p", "o") for x in (a, b))
    a, b = (materialize(as_quads(materialize(x, "blank")), "plain") for x in (a, b))
    if a.count() != b.count():
        return False
    hashes = [materialize(first_degree_hashes(x, limits.get("algorithm", "sha256")), "hashes") for x in (a, b)]
    ha, hb = (x.groupBy("hash").agg(F.count(F.lit(1)).alias("n")) for x in hashes)
    if not ha.exceptAll(hb).isEmpty() or not hb.exceptAll(ha).isEmpty():
        return False
    a, b = (materialize(_relabel(x, _labels(x, **limits, hashes=h)), "relabeled") for x, h in zip((a, b), hashes))
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


__all__ = ["ToxicGraph", "as_quads", "canonical_labels", "dataset_hash", "first_degree_hashes", "isomorphic", "normalized", "relabeled", "triple_term"]
