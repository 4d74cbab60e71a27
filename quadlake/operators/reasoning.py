"""RDF and RDFS entailment as joins repeated until nothing new follows; each graph by itself."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import part_of
from ..functions.values import class_of, rank_of
from ..plans.compiler import Engine, Store
from ..plans.from_graph import query_of
from ..storage import dealt, discard, distinct_runs, materialize
from ..terms import BNODE, INTEGER_RANGES, IRI, LITERAL, RDF, RDFS, TERM_DDL, TRIPLE, XSD, Term, bnode, iri, literal, term, triple_term
from .paths import reachable

TYPE, SUBCLASS, SUBPROPERTY, DOMAIN, RANGE = RDF + "type", RDFS + "subClassOf", RDFS + "subPropertyOf", RDFS + "domain", RDFS + "range"

# Recognised datatypes, and a value of each.
NOTHING: tuple[str, ...] = ()
SPARQL = tuple(XSD + x for x in ("string", "boolean", "decimal", "float", "double", "dateTime", *INTEGER_RANGES))
WITNESSES = {"string": "", "boolean": "true", "decimal": "0.5", "float": "1.5e0", "double": "1.5e0", "dateTime": "2000-01-01T00:00:00Z", **{x: "-1" if x in ("negativeInteger", "nonPositiveInteger") else "1" for x in INTEGER_RANGES}}
# The axiomatic triples of RDF and RDFS.
RDF_AXIOMS = [(RDF + x, TYPE, RDF + "Property") for x in ("type", "subject", "predicate", "object", "first", "rest", "value", "_1", "reifies")] + [(RDF + "nil", TYPE, RDF + "List")]
_DOMAINS = {TYPE: "Resource", DOMAIN: RDF + "Property", RANGE: RDF + "Property", SUBPROPERTY: RDF + "Property", SUBCLASS: "Class", RDF + "subject": RDF + "Statement", RDF + "predicate": RDF + "Statement", RDF + "object": RDF + "Statement", RDFS + "member": "Resource", RDF + "first": RDF + "List", RDF + "rest": RDF + "List", RDFS + "seeAlso": "Resource", RDFS + "isDefinedBy": "Resource", RDFS + "comment": "Resource", RDFS + "label": "Resource", RDF + "value": "Resource", RDF + "reifies": "Resource"}
_RANGES = {TYPE: "Class", DOMAIN: "Class", RANGE: "Class", SUBPROPERTY: RDF + "Property", SUBCLASS: "Class", RDF + "subject": "Resource", RDF + "predicate": "Resource", RDF + "object": "Resource", RDFS + "member": "Resource", RDF + "first": "Resource", RDF + "rest": RDF + "List", RDFS + "seeAlso": "Resource", RDFS + "isDefinedBy": "Resource", RDFS + "comment": "Literal", RDFS + "label": "Literal", RDF + "value": "Resource", RDF + "reifies": "Proposition"}
_full = lambda x: x if ":" in x else RDFS + x
RDFS_AXIOMS = (
    [(p, DOMAIN, _full(c)) for p, c in _DOMAINS.items()] + [(p, RANGE, _full(c)) for p, c in _RANGES.items()]
    + [(RDF + x, SUBCLASS, RDFS + "Container") for x in ("Alt", "Bag", "Seq")] + [(RDFS + "ContainerMembershipProperty", SUBCLASS, RDF + "Property")]
    + [(triple_term(iri(TYPE), iri(TYPE), iri(RDF + "Property")), TYPE, RDFS + "Proposition")]
    + [(RDFS + "isDefinedBy", SUBPROPERTY, RDFS + "seeAlso"), (RDFS + "Datatype", SUBCLASS, RDFS + "Class"), (RDF + "_1", TYPE, RDFS + "ContainerMembershipProperty"), (RDF + "_1", DOMAIN, RDFS + "Resource"), (RDF + "_1", RANGE, RDFS + "Resource")]
)


#: Triples that are simply made distinct.
LITTLE = 100_000
#: Predicates that old triples are looked through for by name, and old triples that go to all tasks.
MANY, FEW = 200, 10_000


class Inconsistent(ValueError):
    """The graph has no interpretation: an ill-typed literal, or a resource of two datatypes that share no value."""


def normalized(t: Column, recognised: Iterable[str]) -> Column:
    """Literals of recognised integer and decimal types in one form: 01 and 1.0 become the integer 1."""
    known = list(recognised)
    whole = F.regexp_replace(F.regexp_replace(t["v"], r"^\+", ""), r"^(-?)0+(?=[0-9])", "$1")
    whole = F.when(whole == "-0", "0").otherwise(whole)
    short = F.regexp_replace(t["v"], r"\.0*$", "")
    r = rank_of(t)
    of_decimal = F.regexp_replace(F.regexp_replace(short, r"^\+", ""), r"^(-?)0+(?=[0-9])", "$1")
    of_decimal = F.when(of_decimal.isin("", "-", "-0"), "0").otherwise(of_decimal)
    trimmed = F.regexp_replace(F.regexp_replace(t["v"], r"^\+", ""), r"0+$", "")
    use = t["d"].isin(known)
    return (
        F.when(use & (r == 1), term(LITERAL, whole, XSD + "integer"))
        .when(use & (r == 2) & t["v"].rlike(r"^[+-]?[0-9]*(\.0*)?$"), term(LITERAL, of_decimal, XSD + "integer"))
        .when(use & (r == 2), term(LITERAL, trimmed, XSD + "decimal"))
        .otherwise(t)
    )


def _consts(spark, triples: Iterable[tuple]) -> DataFrame:
    rows = [tuple((x if isinstance(x, Term) else iri(x)).row() for x in t) for t in triples]
    return spark.createDataFrame(rows, f"s {TERM_DDL}, p {TERM_DDL}, o {TERM_DDL}")


def _p(df: DataFrame, name: str) -> DataFrame:
    return df.where((F.col("p.v") == name) & (F.col("p.k") == IRI))


def _is(name: str) -> Column:
    return iri(name).column()


def saturate(triples: DataFrame, rules: str = "rdfs", recognised: Iterable[str] = NOTHING, resources: bool = True, check: bool = True) -> DataFrame:
    """Triples (g, s, p, o or s, p, o) with all that follows by `rules`: simple, rdf or rdfs.

    recognised: datatypes whose literals are understood. resources: also state that every term is an rdfs:Resource.
    Rules on schema triples (few) are closed by themselves first; then each round joins only the triples that are new. A
    frame with g is closed graph by graph: g is a key of every join. Raises Inconsistent unless check is off.
    """
    return _closed(None, triples, rules, recognised, resources, check)


def additions(closed: DataFrame, more: DataFrame, rules: str = "rdfs", recognised: Iterable[str] = NOTHING, resources: bool = True, check: bool = True) -> DataFrame:
    """What a closed graph lacks when `more` comes to it: of more, and of all that follows from both, the triples that closed has not.

    `closed` must come from saturate() with the same options, or from it and earlier additions. New triples join the schema; old ones join new
    schema triples only, if there are any. The old graph is read to tell what it has, but neither shuffled where the new triples are few nor written again.
    """
    return _closed(closed, more, rules, recognised, resources, check)


def saturate_stream(quads: DataFrame, folder: str, checkpoint: str, **options):
    """Close a stream of triples or quads: each batch's additions go to a Parquet folder of their own under `folder`, batch after batch; all of them are the closed graph.
    A batch that is repeated writes its folder anew. Returns the running query; options are those of additions()."""

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = [f"{folder}/batch={n}" for n in range(number)]
        batch = materialize(batch, "batch")
        closed = spark.read.schema(batch.schema).parquet(*old) if old else None
        _closed(closed, batch, **{"rules": "rdfs", "recognised": NOTHING, "resources": True, "check": True, **options}).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return quads.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)


def _without(df: DataFrame, old: DataFrame) -> DataFrame:
    """Rows of df that old has not, df being few: old is looked through for them first."""
    names = df.columns

    def same(other: DataFrame) -> tuple[DataFrame, Column]:
        renamed = other.select(*[F.col(c).alias(f"x_{c}") for c in names])
        return renamed, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"x_{c}")) for c in names])

    if "p" in names:
        # triples of other predicates need no look, which are most: what is made says little of the data's own predicates
        made = [r[0] for r in df.select("p.v").distinct().limit(MANY + 1).collect()]
        if len(made) <= MANY:
            old = old.where(F.col("p.v").isin(made))
            if old.limit(FEW + 1).count() <= FEW:
                few, test = same(old)
                return df.join(F.broadcast(few), test, "left_anti")
    wanted, test = same(df)
    there = old.select(*names).join(wanted, test, "left_semi")
    there, test = same(there)
    return df.join(there, test, "left_anti")


def _closed(closed: DataFrame | None, triples: DataFrame, rules: str, recognised: Iterable[str], resources: bool, check: bool) -> DataFrame:
    """The closure of triples; or, beside a closed graph, what is to be added to that."""
    keys = ["g"] if "g" in triples.columns else []
    columns = [*keys, "s", "p", "o"]
    spark, known = triples.sparkSession, list(recognised)
    delta = data = materialize(triples.select(*keys, *[normalized(F.col(c), known).alias(c) for c in ("s", "p", "o")]), "triples")
    size = data.count()
    if check and known:
        ill = data.where((F.col("o.k") == LITERAL) & F.col("o.d").isin(known) & class_of(F.col("o")).isNull())
        if not ill.limit(1).isEmpty():
            raise Inconsistent("an ill-typed literal")
    if rules != "simple":
        axioms = list(RDF_AXIOMS) + (list(RDFS_AXIOMS) if rules == "rdfs" else [])
        for d in known:
            axioms += [(bnode(f"w{known.index(d)}"), iri(TYPE), iri(d))]
            axioms += [(d, TYPE, RDFS + "Datatype")] if rules == "rdfs" else []
        fixed = _consts(spark, axioms)
        if keys:
            fixed = data.select("g").distinct().crossJoin(F.broadcast(fixed))
    with dealt(spark, size):
        whole, other = distinct_runs(data, columns) if size > LITTLE else (None, data.distinct())
        if other is not None:
            delta = materialize(other if whole is None else whole.unionByName(other), "graph")
            if size > LITTLE:
                discard(data)
        if rules != "simple":
            delta = delta.unionByName(materialize(_without(materialize(fixed.distinct(), "axioms"), delta), "axioms"))
    if closed is not None:
        closed = closed.select(*columns)
        with dealt(spark, size + closed.count()):
            delta = materialize(_without(delta, closed), "new")
    if rules == "simple":
        return delta
    added = [delta]
    # what the schema says so far, of all but the triples of this round
    pairs_of = lambda df, p: _p(df, p).select(*keys, "s", "o")
    classes, properties = (None, None) if closed is None else (pairs_of(closed, SUBCLASS), pairs_of(closed, SUBPROPERTY))

    ends = None

    def new_type(df: DataFrame, subject: Column, cls: Column) -> DataFrame:
        return df.select(*keys, subject.alias("s"), _is(TYPE).alias("p"), cls.alias("o"))

    def pair(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
        """left joined to the schema pairs (right.s, right.o) where left[on] is right.s."""
        r = right.select(*[F.col(k).alias(f"r_{k}") for k in keys], F.col("s").alias("r_s"), F.col("o").alias("r_o"))
        test = F.col(on) == F.col("r_s")
        for k in keys:
            test = test & F.col(k).eqNullSafe(F.col(f"r_{k}"))
        return left.join(r, test)

    while not delta.isEmpty():
        old = ([closed] if closed is not None else []) + added[:-1]
        before = reduce(DataFrame.unionByName, old) if old else None
        now = delta if before is None else before.unionByName(delta)
        size = now.count()
        found: list[DataFrame] = []
        inner = delta.where(F.col("o.k") == TRIPLE)
        predicates = delta.select(*keys, F.col("p").alias("t"))
        predicates = predicates.unionByName(inner.select(*keys, part_of(F.col("o"), 1).alias("t")))
        found.append(new_type(predicates.distinct(), F.col("t"), _is(RDF + "Property")))
        lit = delta.where(F.col("o.k") == LITERAL).select(*keys, F.col("o").alias("t")).distinct()
        own = F.when(F.col("t.r").isNotNull(), RDF + "dirLangString").when(F.col("t.l").isNotNull(), RDF + "langString").otherwise(F.col("t.d"))
        wide = F.array(own, *_also(F.col("t"), known))
        typed = lit.where(F.col("t.l").isNotNull() | F.col("t.d").isin([*known, XSD + "string"])).select(*keys, "t", F.explode(wide).alias("d")).where("d IS NOT NULL")
        found.append(new_type(typed, F.col("t"), term(IRI, F.col("d"))))
        if rules == "rdfs":
            terms = delta.select(*keys, F.explode(F.array("s", "p", "o")).alias("t")).distinct()
            members = terms.where((F.col("t.k") == IRI) & F.col("t.v").rlike("^" + RDF.replace(".", "\\.") + "_[1-9][0-9]*$"))
            found += [new_type(members, F.col("t"), _is(RDFS + "ContainerMembershipProperty"))]
            if resources:
                found.append(new_type(terms, F.col("t"), _is(RDFS + "Resource")))
            found.append(new_type(inner.select(*keys, "o"), F.col("o"), _is(RDFS + "Proposition")))
            schema_new = {r[0] for r in delta.where(F.col("p.v").isin(SUBCLASS, SUBPROPERTY, DOMAIN, RANGE)).select("p.v").distinct().collect()}
            more_classes = more_properties = None
            if SUBCLASS in schema_new or classes is None:
                all_classes = materialize(reachable(pairs_of(now, SUBCLASS), keys=keys), "classes")
                more_classes = all_classes if classes is None else materialize(_without(all_classes, classes), "classes")
                classes = all_classes
                found.append(more_classes.select(*keys, "s", _is(SUBCLASS).alias("p"), "o"))
            if SUBPROPERTY in schema_new or properties is None:
                all_properties = materialize(reachable(pairs_of(now, SUBPROPERTY), keys=keys), "properties")
                more_properties = all_properties if properties is None else materialize(_without(all_properties, properties), "properties")
                properties = all_properties
                found.append(more_properties.select(*keys, "s", _is(SUBPROPERTY).alias("p"), "o"))
            if ends is None or schema_new & {DOMAIN, RANGE}:
                # written by themselves: few rows with few keys, which must not deal out all triples by their predicates
                ends = materialize(now.where(F.col("p.v").isin(DOMAIN, RANGE) & (F.col("p.k") == IRI)), "ends")
            proper = lambda df: df.where(F.col("s") != F.col("o"))
            # new triples meet the whole schema, old ones what is new of it
            meetings = [(delta, pairs_of(ends, DOMAIN), pairs_of(ends, RANGE), proper(properties), proper(classes))]
            if before is not None and (schema_new or more_classes is not None or more_properties is not None):
                meetings.append((before, *[pairs_of(delta, x) if x in schema_new else None for x in (DOMAIN, RANGE)], *[None if x is None else proper(x) for x in (more_properties, more_classes)]))
            for rows, domains, ranges, above, wider in meetings:
                # a subject has a type of many triples
                for c, schema in (("s", domains), ("o", ranges)):
                    if schema is not None:
                        found.append(new_type(pair(rows, schema, "p").select(*keys, F.col(c).alias("t"), "r_o").distinct(), F.col("t"), F.col("r_o")))
                if above is not None:
                    found.append(pair(rows, above, "p").select(*keys, "s", F.col("r_o").alias("p"), "o"))
                if wider is not None:
                    found.append(new_type(pair(_p(rows, TYPE), wider, "o"), F.col("s"), F.col("r_o")))
            of = lambda c: _p(delta, TYPE).where((F.col("o.v") == c) & (F.col("o.k") == IRI))  # noqa: B023, E731
            found.append(of(RDF + "Property").select(*keys, "s", _is(SUBPROPERTY).alias("p"), F.col("s").alias("o")))
            found.append(of(RDFS + "Class").select(*keys, "s", _is(SUBCLASS).alias("p"), F.col("s").alias("o")))
            found.append(of(RDFS + "Class").select(*keys, "s", _is(SUBCLASS).alias("p"), _is(RDFS + "Resource").alias("o")))
            found.append(of(RDFS + "ContainerMembershipProperty").select(*keys, "s", _is(SUBPROPERTY).alias("p"), _is(RDFS + "member").alias("o")))
            found.append(of(RDFS + "Datatype").select(*keys, "s", _is(SUBCLASS).alias("p"), _is(RDFS + "Literal").alias("o")))
        # each triple has three terms to speak of
        with dealt(spark, 3 * size):
            raw = materialize(reduce(DataFrame.unionByName, [f.select(*columns) for f in found]), "made")
        count = raw.count()
        with dealt(spark, count + size):
            made, other = distinct_runs(raw, columns) if count > LITTLE else (raw.distinct(), None)
            other = None if other is None else materialize(other, "made")
            delta = materialize(_without(made if other is None else made.unionByName(other), now), "inferred")
        for df in (raw, other) if count > LITTLE else ():
            if df is not None:
                discard(df)
        added.append(delta)
    out = reduce(DataFrame.unionByName, added)
    if check and known:
        touched = out if closed is None else out.unionByName(closed.join(out.select(*[F.col(c).alias(f"x_{c}") for c in (*keys, "s")]).distinct(), reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"x_{c}")) for c in (*keys, "s")]), "left_semi"))
        _check(touched, keys, known)
    return out


def _also(t: Column, known: list[str]) -> list[Column]:
    """Further datatypes of an integer: decimal, and each derived type whose range holds it."""
    out, value = [], t["v"].try_cast("decimal(38,0)")
    integer = (t["d"] == XSD + "integer") & value.isNotNull()
    if XSD + "integer" in known:
        if XSD + "decimal" in known:
            out.append(F.when(integer, XSD + "decimal"))
        for name, (low, high) in INTEGER_RANGES.items():
            if name != "integer" and XSD + name in known:
                ok = integer
                ok = ok if low is None else ok & (value >= F.lit(str(low)).cast("decimal(38,0)"))
                ok = ok if high is None else ok & (value <= F.lit(str(high)).cast("decimal(38,0)"))
                out.append(F.when(ok, XSD + name))
    return out


def _shares(a: str, b: str) -> bool:
    """Whether two datatypes have a common value."""
    x, y = a.removeprefix(XSD), b.removeprefix(XSD)
    if x == y:
        return True
    numbers = [n for n in (x, y) if n in INTEGER_RANGES or n == "decimal"]
    if len(numbers) < 2:
        return False
    low = [INTEGER_RANGES.get(n, (None, None))[0] for n in numbers if INTEGER_RANGES.get(n, (None, None))[0] is not None]
    high = [INTEGER_RANGES.get(n, (None, None))[1] for n in numbers if INTEGER_RANGES.get(n, (None, None))[1] is not None]
    return not low or not high or max(low) <= min(high)


def _check(df: DataFrame, keys: list[str], known: list[str]) -> None:
    types = _p(df, TYPE).where(F.col("o.v").isin(known))
    many = types.groupBy(*keys, "s").agg(F.collect_set("o.v").alias("d")).where(F.size("d") > 1).select("d").distinct()
    apart = [(a, b) for a in known for b in known if a < b and not _shares(a, b)]
    both = lambda a, b: F.array_contains("d", a) & F.array_contains("d", b)
    clash = many.where(reduce(lambda x, y: x | y, [both(a, b) for a, b in apart], F.lit(False))).first()
    if clash:
        a, b = next((a, b) for a, b in apart if a in clash["d"] and b in clash["d"])
        raise Inconsistent(f"a resource of both {a} and {b}")


def entails(premise: DataFrame, conclusion: list[tuple], rules: str = "rdfs", recognised: Iterable[str] = NOTHING) -> bool:
    """Whether the conclusion (triples of terms) follows from the premise (s, p, o); an inconsistent premise entails everything."""
    known = list(recognised)
    try:
        closed = saturate(premise.select("s", "p", "o"), rules, known)
    except Inconsistent:
        return True
    spark = premise.sparkSession
    goal = _consts(spark, [t[-3:] for t in conclusion]) if conclusion else None
    if goal is None:
        return True
    from ..sources.nquads import from_frame

    goal = from_frame(goal.select(*[normalized(F.col(c), known).alias(c) for c in ("s", "p", "o")]))
    store = Store(closed.select(F.lit(None).cast(TERM_DDL).alias("g"), "s", "p", "o"))
    return bool(Engine(store).query(query_of(goal)))


__all__ = ["NOTHING", "SPARQL", "WITNESSES", "Inconsistent", "additions", "entails", "literal", "normalized", "saturate", "saturate_stream"]
