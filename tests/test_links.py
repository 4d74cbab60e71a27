"""Links followed for frames, queries made of graphs, further aggregates and typed values."""

from datetime import date, datetime
from decimal import Decimal
from functools import reduce

import pytest
from pyspark.sql import functions as F

from quadlake.operators.resource import Resource, typed, typed_values
from quadlake.plans.aggregates import statistics, unbound
from quadlake.plans.compiler import Engine
from quadlake.plans.from_graph import query_of
from quadlake.plans.parser import SparqlError, parse
from quadlake.sources.links import Folders, follow_links
from quadlake.sources.loader import LocalLoader
from quadlake.sources.nquads import from_frame, to_frame
from quadlake.sources.turtle import parse_turtle
from quadlake.terms import BNODE, IRI, RDF, XSD, bnode, iri, literal, triple_term, variable

X, NEXT = "http://x/", "http://x/next"

DOCUMENTS = {
    "a.ttl": "@prefix : <http://x/> . <a#me> :next <b>, <missing>, _:n, 'text' ; :other <unseen> . _:n :p 1 .",
    "b.nt": "<http://x/b> <http://x/next> <http://x/c#it> .\n_:n <http://x/p> <<( _:n <http://x/p> _:m )>> .\n",
    "c.jsonld": '{"@id": "http://x/c#it", "http://x/next": [{"@id": "http://x/a"}, {"@id": "http://x/d"}]}',
    "d.rdf": f'<rdf:RDF xmlns:rdf="{RDF}" xmlns:x="http://x/"><rdf:Description rdf:about="http://x/d"><x:next rdf:resource="http://x/bad"/><x:next rdf:resource="http://x/d"/></rdf:Description></rdf:RDF>',
    "bad.ttl": "this is no Turtle",
    "unseen.ttl": "<http://x/unseen> <http://x/next> <http://x/a> .",
    "e.trig": "<http://x/e> <http://x/next> <http://x/b> . <http://x/g> { <http://x/e> <http://x/next> <http://x/unseen> }",
}


def start(spark, *names):
    return to_frame(spark, [(None, iri(X + "start"), iri(NEXT), iri(X + n)) for n in names]).select("s", "p", "o")


def found(followed):
    return {(r.document.removeprefix(X), r.round, r.triples, (r.problem or "").partition(":")[0]) for r in followed.documents.collect()}


@pytest.fixture(params=["folders", "table"])
def source(request, spark, tmp_path):
    if request.param == "table":
        rows = [(X + n.partition(".")[0], text, n.partition(".")[2]) for n, text in DOCUMENTS.items()]
        return spark.createDataFrame([*rows, (X + "a", "", "zz"), (None, "x", "ttl")], "document string, text string, format string")
    for n, text in DOCUMENTS.items():
        (tmp_path / n).write_text(text)
    return Folders({X: str(tmp_path)})


def test_links_of_a_frame(spark, source):
    followed = follow_links(start(spark, "a", "a#me", "e"), [NEXT], source)
    assert found(followed) == {("a", 1, 6, ""), ("e", 1, 1, ""), ("b", 2, 2, ""), ("missing", 2, 0, "not found"), ("c", 3, 2, ""), ("d", 4, 2, ""), ("bad", 5, 0, "not read")}
    rows = followed.triples.collect()
    blank = {}
    for r in rows:
        for t in (r.s, r.o):
            if t.k == BNODE:
                blank.setdefault(r.document, set()).add(t.v)
    assert not blank[X + "a"] & blank[X + "b"] and len(blank[X + "a"]) == 1 and len(blank[X + "b"]) == 1
    nested = next(r for r in rows if r.document == X + "b" and r.s.k == BNODE)
    assert nested.o.v.count(nested.s.v) == 1
    assert found(follow_links(start(spark, "e"), [NEXT], source, rounds=2)) == {("e", 1, 1, ""), ("b", 2, 2, "")}
    assert found(follow_links(start(spark), [NEXT], source)) == set()
    assert follow_links(start(spark, "a"), [X + "none"], source).documents.isEmpty()


def test_terms_of_documents_are_made_by_fields():
    """terms that come again are parsed once, long ones aren't kept; nothing is lost where there is no term, language, direction or problem."""
    from quadlake.sources import links, nquads

    nquads._known.cache_clear()
    long = "x" * 300
    text = "\n".join(f'<http://x/{i}> <http://x/p> "{long}" .' for i in range(5)) + '\n<http://x/1> <http://x/p> "a"@ar--rtl .'
    quads = links.PARSERS["nt"](text, "", "s")
    assert len(quads) == 6 and nquads._known.cache_info().misses == 7
    assert links.PARSERS["nt"]("_:a <http://x/p> <<( _:a <http://x/p> 'x' )>> .".replace("'", '"'), "", "s")[0][1] == bnode("as")
    rows = links._batch([("d", *quads[-1][1:], None) if quads[-1][0] is None else (), ("d", None, None, None, "not read")]).to_pylist()
    assert rows[0]["o"] == {"k": 2, "v": "a", "d": None, "l": "ar", "r": "rtl"} and rows[0]["problem"] is None
    assert rows[1] == {"document": "d", "s": None, "p": None, "o": None, "problem": "not read"}


def test_links_equal_a_walk_of_the_driver(spark, tmp_path):
    """A chain with branches and a cycle, against resources that load their neighbours one by one."""
    for i in range(9):
        links = ", ".join(f"<http://x/n{k}>" for k in {(i + 1) % 9, i * 2 % 9})
        (tmp_path / f"n{i}.ttl").write_text(f"<http://x/n{i}> <{NEXT}> {links} .")
    loader = LocalLoader(spark, {X: str(tmp_path)})
    seen, todo = set(), [Resource(iri(X + "n3"), loader.graph(X + "n3"), loader)]
    while todo:
        r = todo.pop()
        if r not in seen:
            seen.add(r)
            todo += r.get_all_resources(NEXT)
    followed = follow_links(start(spark, "n3"), [NEXT], Folders({X: str(tmp_path)}))
    assert {r.document for r in followed.documents.collect()} == {r.term.value for r in seen}
    whole = reduce(lambda a, b: a.unionByName(b), (loader.graph(X + f"n{i}") for i in range(9)))
    assert set(from_frame(followed.triples.where("document IS NOT NULL").select("s", "p", "o"))) == set(from_frame(whole))


def test_folders_stay_below_their_root(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in-secret.ttl").write_text("")
    (tmp_path / "out.ttl").write_text("")
    fetch = Folders({X: str(tmp_path / "in")})
    with pytest.raises(FileNotFoundError):
        LocalLoader(None, {X: str(tmp_path / "in")}).path(X + "../in-secret")
    for name in ("../out", "../in-secret", "/../out.ttl", "..//out"):
        with pytest.raises(FileNotFoundError):
            fetch(X + name)
    with pytest.raises(FileNotFoundError):
        fetch("http://y/in")


def test_queries_of_graphs(spark):
    data = to_frame(spark, parse_turtle("PREFIX : <http://x/> :a :p :b ; :q 1 . :b :p :c . :c :p :a . :d :p :d ; :r <<( :a :p :b )>> ."))
    engine = Engine(data)
    a, b, c, p, q = (iri(X + n) for n in "abcpq")
    assert engine.query(query_of([(bnode("x"), p, bnode("y")), (bnode("y"), p, bnode("x"))])) and not engine.query(query_of([(a, p, a)]))
    assert engine.query(query_of([])) and engine.query(query_of([(None, a, q, literal(1))])) and not engine.query(query_of([(a, q, literal(2))]))
    v = variable
    rows = engine.query(query_of([(v("s"), p, v("o")), (v("o"), p, bnode("z")), (bnode("z"), bnode("any"), v("s"))], "select")).rows()
    assert {(r["s"], r["o"]) for r in rows} == {(a, b), (b, c), (c, a), (iri(X + "d"), iri(X + "d"))}
    made = engine.query(query_of([(v("s"), p, v("o")), (v("o"), p, bnode("z"))], "construct"))
    assert {(r.s.v, r.o.v) for r in made.collect() if r.o.k == IRI} == {(X + s, X + o) for s, o in ("ab", "bc", "ca", "dd")}
    assert made.where(F.col("o.k") == BNODE).select("o").distinct().count() == 4
    assert engine.query(query_of([(v("s"), iri(X + "r"), triple_term(v("x"), p, b))], "select")).rows() == [{"s": iri(X + "d"), "x": a}]
    odd = to_frame(spark, [(None, a, literal("says"), b), (None, b, bnode("k"), c)])
    assert [r["o"] for r in Engine(odd).query(query_of([(a, literal("says"), v("o"))], "select")).rows()] == [b]
    assert not Engine(odd).query(query_of([(a, literal("says", lang="en"), b)]))
    assert query_of([(a, v("p1"), literal(1)), (a, literal("x"), b)], "select").pattern.vars == ["p1"]
    with pytest.raises(ValueError):
        query_of([], "describe")


def test_aggregates_beside_sparql(spark):
    data = to_frame(spark, parse_turtle("PREFIX : <http://x/> :a :g 1 ; :v 1, 2, 9.0 . :b :g 2 ; :v 4, 'four' . :c :g 3 ; :w 'x', 'y' . :d :g 3 ; :w 'y' ."))
    engine = Engine(data, {"": X, "s": "urn:s:"}, aggregates={**statistics("urn:s:"), "urn:s:none": unbound})
    rows = engine.query("SELECT ?g (s:median(?v) AS ?m) (s:median(?v) + 1 AS ?n) (COUNT(?v) AS ?k) (s:none(?v) AS ?u) { ?s :g ?g ; :v ?v } GROUP BY ?g HAVING (COUNT(*) > 1) ORDER BY ?g").rows()
    assert [{k: t.value for k, t in r.items()} for r in rows] == [{"g": "1", "m": "2.0e0", "n": "3.0e0", "k": "3"}, {"g": "2", "k": "2"}]
    (row,) = engine.query("SELECT (s:mode(?w) AS ?m) (s:approximate_count(?w) AS ?n) { ?s :w ?w }").rows()
    assert row == {"m": literal("y"), "n": literal(2)}
    (empty,) = engine.query("SELECT (s:deviation(?w) AS ?m) { ?s :none ?w }").rows()
    assert empty == {}
    for bad in ("SELECT (SUM(*) AS ?x) { ?s ?p ?o }", "SELECT ?s { ?s ?p ?o FILTER(<urn:s:median>(?o) > 1) }"):
        with pytest.raises(SparqlError):
            parse(bad, aggregates=["urn:s:median"])
    with pytest.raises(ValueError):
        engine.query("SELECT (s:median(DISTINCT ?v) AS ?m) { ?s :v ?v }")


def test_typed_values(spark):
    texts = {"integer": ["7", "x", "+07"], "boolean": ["1", "false", "TRUE"], "decimal": ["1.50", "1e3", "."], "double": ["1e3", "-INF", "NaN", "inf"], "date": ["2020-02-29", "2021-02-29", "2020-02-29Z"], "dateTime": ["2020-01-01T01:02:03Z", "now"], "hexBinary": ["0aFF", "0"], "string": ["", "x"]}
    wanted = {"integer": [7, "value", 7], "boolean": [True, False, "value"], "decimal": [Decimal("1.5"), "value", "value"], "double": [1000.0, float("-inf"), "nan", "value"], "date": [date(2020, 2, 29), "value", date(2020, 2, 29)], "dateTime": [datetime(2020, 1, 1, 1, 2, 3), "value"], "hexBinary": [b"\x0a\xff", "value"], "string": ["", "x"]}
    for name, forms in texts.items():
        triples = [(None, iri(f"{X}{i:02}"), iri(X + "p"), literal(v, XSD + name)) for i, v in enumerate(forms)] + [(None, iri(X + "x"), iri(X + "p"), iri(X)), (None, iri(X + "y"), iri(X + "p"), literal("1", lang="en")), (None, iri(X + "z"), iri(X + "q"), literal("1"))]
        rows = typed_values(to_frame(spark, triples), X + "p", name).orderBy("s.v").collect()
        assert [r.problem or ("nan" if r.value != r.value else r.value) for r in rows] == [*wanted[name], "kind", "datatype"], name
    assert [r.value for r in typed_values(to_frame(spark, [(None, iri(X), iri(X + "p"), literal("5", XSD + "byte"))]), X + "p", "double").collect()] == [5.0]
    assert typed(literal("1.10", XSD + "decimal"), Decimal) == Decimal("1.10") and typed(literal("2020-01-01T00:00:00Z"), datetime).year == 2020 and typed(literal("00ff"), bytes) == b"\x00\xff"
    for t, kind in ((iri(X), str), (literal("x"), int), (literal("x"), Decimal), (literal("yes"), bool)):
        with pytest.raises(ValueError):
            typed(t, kind)
    graph = to_frame(spark, parse_turtle("PREFIX : <http://x/> :a :d '2020-01-02' ; :n :b, :c . :b :name 'B' . :c :name 'C' ."))
    r = Resource(iri(X + "a"), graph)
    assert r.get_typed(X + "d", date) == date(2020, 1, 2)
    assert sorted(r.get_all_typed(X + "n", lambda x: x.get_typed(X + "name", str))) == ["B", "C"]


def test_constructed_triples_of_large_tables(spark, tmp_path):
    """Tables are dealt out before they are joined; triples with unbound or misplaced terms go, and so does no other."""
    from quadlake.operators.mapping import VirtualStore
    from quadlake.plans.compiler import Engine

    spark.range(1000).selectExpr("id AS c_custkey", "IF(id % 10 = 0, NULL, CAST(id % 25 AS int)) AS c_nationkey", "CAST(id AS double) AS c_acctbal").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    store = VirtualStore(spark, str(tmp_path), rows=100)
    text = "CONSTRUCT { ?c <urn:x:in> ?n . ?b <urn:x:of> ?c . ?c <urn:x:has> ?b . ?c ?n _:x . _:x <urn:x:one> ?c } { ?c <urn:x:customer#c_acctbal> ?b OPTIONAL { ?c <urn:x:customer#c_nationkey> ?n } }"
    made = Engine(store).query(text)
    assert store.star(variable("c"), "customer", [(variable("c"), iri("urn:x:customer#c_acctbal"), variable("b"))], None).df.rdd.getNumPartitions() == 10
    found = {r["v"]: r["count"] for r in made.groupBy("p.v").count().collect()}
    assert found == {"urn:x:in": 900, "urn:x:has": 1000, "urn:x:one": 1000, **{f"urn:x:nation/{k}": n for k, n in {r["k"]: r["n"] for r in spark.sql("SELECT id % 25 AS k, count(*) AS n FROM range(1000) WHERE id % 10 > 0 GROUP BY 1").collect()}.items()}}
