"""DESCRIBE: the triples about resources, and on through blank nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import box
from ..storage import materialize
from ..terms import BNODE, TRIPLE, VARIABLE, Term, canonical_column, from_row
from . import algebra as A

#: So many nodes at most are looked up as constants, which scans can use; more are joined.
FEW = 200


def describe(compiler, q: A.Query, active) -> DataFrame:
    """(s, p, o): triples from and to what is described, and triples that have one of these as a term; blank nodes met on
    the way are described too. Each round only looks at nodes that are new."""

    s = compiler.pattern(q.pattern, active)
    start = None
    for t in q.terms:
        rows = s.df.select(box(s.typed(t.value)).alias("n")) if t.kind == VARIABLE and t.value in s.kinds else compiler.spark.range(1).select(t.column().alias("n")) if t.kind != VARIABLE else None
        if rows is not None:
            start = rows if start is None else start.union(rows)
    found = compiler.store.pattern((Term(VARIABLE, "s"), Term(VARIABLE, "p"), Term(VARIABLE, "o")), active)
    triples = found.df.select(*[box(found.typed(c)).alias(c) for c in "spo"])
    if start is None:
        return triples.where(F.lit(False))
    seen = new = materialize(start.where(F.col("n").isNotNull()).distinct(), "described")
    out = None
    while not new.isEmpty():
        few = new.limit(FEW + 1).collect()
        if len(few) <= FEW:
            near = compiler.store.about([from_row(r["n"]) for r in few], active)
        else:
            near = triples.join(new.select(F.col("n").alias("s")), "s", "left_semi").select("s", "p", "o")
            near = near.unionByName(triples.join(new.select(F.col("n").alias("o")), "o", "left_semi").select("s", "p", "o"))
        about = materialize(near.distinct(), "about")
        text = F.concat(F.lit("<<( "), canonical_column(F.col("s")), F.lit(" "), canonical_column(F.col("p")), F.lit(" "), canonical_column(F.col("o")), F.lit(" )>>"))
        if compiler.store.has_triple_terms:
            mention = triples.where(F.col("o.k") == TRIPLE).join(about.select(text.alias("_t")), F.col("o.v") == F.col("_t"), "left_semi")
            about = about.unionByName(mention)
        out = about if out is None else out.unionByName(about)
        more = about.select(F.explode(F.array("s", "o")).alias("n")).where(F.col("n.k") == BNODE).distinct()
        new = materialize(more.join(seen, "n", "left_anti"), "described")
        seen = seen.union(new)
    return out.distinct()
