"""Property paths as joins, and closures as joins repeated until nothing new is found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from ..terms import BNODE, VARIABLE, Term

_S, _P, _O = (Term(VARIABLE, x) for x in "spo")


def _step(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of left followed by pairs of right."""
    r = right.select(*[F.col(k).alias(f"r_{k}") for k in keys], F.col("s").alias("r_s"), F.col("o").alias("r_o"))
    on = F.col("o") == F.col("r_s")
    for k in keys:
        on = on & (F.col(k) == F.col(f"r_{k}"))
    return left.join(r, on).select(*keys, "s", F.col("r_o").alias("o"))


def reachable(edges: DataFrame, start: DataFrame | None = None, keys: list[str] | None = None, written: bool = False) -> DataFrame:
    """Distinct pairs (keys, s, o) with a walk of one edge or more from s to o.

    With `start` (s, and any of the keys) only walks from there, one edge farther a round. Else walks double in length each
    round, so that rounds grow with the logarithm of the longest walk. Only new pairs are joined again; cycles end
    the loop since they bring none. `written`: edges are read from files as they are, and need not be kept.
    """
    keys = keys or []
    edges = edges.select(*keys, "s", "o")
    if start is None:
        first = edges.distinct()
    else:
        edges = edges if written else materialize(edges.distinct(), "edges")
        first = edges.join(start.distinct(), start.columns, "left_semi").select(*keys, "s", "o").distinct()
    seen = delta = materialize(first, "closure")
    while not delta.isEmpty():
        found = _step(delta, edges, keys) if start is not None else _step(delta, seen, keys).unionByName(_step(seen, delta, keys))
        delta = materialize(found.distinct().join(seen, [*keys, "s", "o"], "left_anti").select(*keys, "s", "o"), "delta")
        seen = seen.unionByName(delta)
    return seen


def walks(path) -> bool:
    """Whether a path has parts of any length."""
    return not isinstance(path, Term) and (path.op in ("star", "plus") or (path.op != "neg" and any(walks(x) for x in path.args)))


def pairs(compiler, path, active, subject: Term, target: Term, starts: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
    """(s, o, and __g in GRAPH ?g) of a path, at least those that begin at `starts` and end at `ends` (frames with a column n).

    An end is open (None), one term, or a frame of terms. Closures walk from an end that is known: from the subject if it is, else backwards from the
    object; in a sequence what one part has reached is where the next begins. A path of no edges joins each node of the graph to itself, and a
    constant end to itself wherever it is.
    """
    from ..plans.algebra import PathOp
    from ..plans.compiler import GRAPH

    store, keys = compiler.store, [GRAPH] if active == GRAPH else []
    known = lambda t, frame: frame if t.kind in (VARIABLE, BNODE) else t

    def edges(triple: tuple) -> DataFrame:
        from ..functions.values import box

        found = store.pattern(triple, active)
        return found.df.select(*[box(found.typed(k)).alias(k) for k in (*keys, "s", "p", "o") if k in found.kinds])

    def walk(p, s, o) -> DataFrame:
        if isinstance(p, Term):
            return edges((_S, p, _O)).select(*keys, "s", "o")
        if p.op == "inv":
            return _swap(walk(p.args[0], o, s))
        if p.op == "alt":
            out = walk(p.args[0], s, o)
            for q in p.args[1:]:
                out = out.unionByName(walk(q, s, o))
            return out
        if p.op == "seq":
            return sequence(p.args, s, o)
        if p.op == "neg":
            forward, back = p.args
            out = None
            for names, turn in ((forward, False), (back, True)):
                if names or (not turn and not back):
                    e = edges((_S, _P, _O))
                    e = e.where(~F.col("p.v").isin([t.value for t in names]) if names else F.lit(True)).select(*keys, "s", "o")
                    e = _swap(e) if turn else e
                    out = e if out is None else out.unionByName(e)
            return out
        inner = p.args[0]
        if s is None and o is not None:
            return _swap(walk(PathOp(p.op, (PathOp("inv", (inner,)),)), o, None))
        if p.op == "opt":
            return walk(inner, s, o).unionByName(identity(s)).distinct()
        start = None if s is None else from_(s).select(F.col("n").alias("s"))
        out = reachable(walk(inner, None, None), start, keys, store.reads_files)
        return out if p.op == "plus" else out.unionByName(identity(s)).distinct()

    def sequence(parts: tuple, s, o) -> DataFrame:
        reached = lambda df, c, q: df.select(F.col(c).alias("n")).distinct() if walks(q) else None
        if s is None and o is not None:
            out = walk(parts[-1], None, o)
            for q in reversed(parts[:-1]):
                out = _step(walk(q, None, reached(out, "s", q)), out, keys)
            return out
        out = walk(parts[0], s, None)
        for k, q in enumerate(parts[1:], 1):
            at = None if s is None else reached(narrow(out, s), "o", q)
            out = _step(out, walk(q, at, o if k == len(parts) - 1 else None), keys)
        return out

    def narrow(df: DataFrame, s) -> DataFrame:
        return df.join(from_(s).select(F.col("n").alias("s")).distinct(), ["s"], "left_semi")

    def from_(end) -> DataFrame:
        return compiler.spark.range(1).select(end.column().alias("n")) if isinstance(end, Term) else end

    def _swap(df: DataFrame) -> DataFrame:
        return df.select(*keys, F.col("o").alias("s"), F.col("s").alias("o"))

    def identity(s) -> DataFrame:
        if isinstance(s, Term):
            one = store.graphs() if keys else compiler.spark.range(1)
            return one.select(*keys, s.column().alias("s"), s.column().alias("o"))
        nodes = store.nodes(active) if s is None else store.nodes_among(s, active)
        return nodes.select(*keys, F.col("n").alias("s"), F.col("n").alias("o"))

    return walk(path, known(subject, starts), known(target, ends))
