"""Formats, graph operations, inference, canonical labels, navigation, virtual graphs and streams."""

import random

import pytest
from pyspark.sql import functions as F

from quadlake import iri as iris
from quadlake.operators import c14n, quads, reasoning
from quadlake.operators.mapping import VirtualStore
from quadlake.operators.resource import Cardinality, Resource, list_items, list_members
from quadlake.plans.compiler import Engine
from quadlake.sources import results
from quadlake.sources.jsonld import file_loader, parse_jsonld, static_loader, to_jsonld
from quadlake.sources.loader import LocalLoader
from quadlake.sources.nquads import ParseError, from_frame, line_column, parse_lines, parse_nquads, quad_line, read_nquads, to_frame, write_nquads
from quadlake.sources.rdfxml import parse_rdfxml, to_rdfxml
from quadlake.sources.turtle import parse_trig, parse_turtle, read_turtle
from quadlake.sources.writers import pretty, write_turtle
from quadlake.terms import LITERAL, RDF, RDFS, XSD, Term, bnode, from_row, iri, literal, triple_term

X = "http://x/"
LINES = [
    '<http://x/a> <http://x/p> "a\\tb\\u00E9\\"c"@en-GB--ltr <http://x/g> .',
    '_:n <http://x/p> "1"^^<http://www.w3.org/2001/XMLSchema#integer> .',
    "# comment",
    "",
    '<http://x/a> <http://x/p> <<( _:n <http://x/q> "x" )>> . # end',
]


def test_nquads(spark, tmp_path):
    (tmp_path / "a.nq").write_text("\n".join(LINES))
    df = read_nquads(spark, str(tmp_path / "a.nq"), preserve_bnodes=True)
    assert set(from_frame(df)) == set(parse_nquads("\n".join(LINES)))
    write_nquads(df, str(tmp_path / "out"), canonical_form=True)
    assert set(from_frame(read_nquads(spark, str(tmp_path / "out"), preserve_bnodes=True))) == set(from_frame(df))
    assert {r[0] for r in df.select(line_column(df)).collect()} == {quad_line(q) for q in from_frame(df)}
    scoped = from_frame(read_nquads(spark, str(tmp_path / "a.nq")))
    labels = {t.value for q in scoped for t in q if t is not None and t.kind == 0}
    assert len(labels) == 1 and labels != {"n"} and any(f"_:{next(iter(labels))} " in q[3].value for q in scoped)
    for bad in ("<http://x/a> <http://x/p> .", '"l" <http://x/p> <http://x/o> .', "<a> <http://x/p> <http://x/o> ."):
        with pytest.raises(ParseError):
            parse_nquads(bad)
    with pytest.raises(Exception, match="not N-Quads"):
        (tmp_path / "bad.nq").write_text("junk\n")
        read_nquads(spark, str(tmp_path / "bad.nq")).collect()


TURTLE = """@prefix : <http://x/> . BASE <http://x/doc>
:a a :T ; :list ( 1 2.5 "three"@en ) ; :blank [ :p [ :q true ] ], [] .
<#frag> :p '''long 'text' here''' , 1e3 .
:s :p :o ~ :r {| :since 2020 |} .
<< :a :p :b >> :q :c . _:b1 :p <<( :a :p :b )>> .
"""


def test_turtle(spark, tmp_path):
    found = parse_turtle(TURTLE)
    assert len(found) == 20
    assert (None, iri(X + "doc#frag"), iri(X + "p"), literal("1e3", XSD + "double")) in found
    assert (None, iri(X + "r"), iri(RDF + "reifies"), triple_term(iri(X + "s"), iri(X + "p"), iri(X + "o"))) in found
    df = to_frame(spark, found)
    assert c14n.isomorphic(df, to_frame(spark, parse_turtle(pretty(found, {"": X}))))
    write_turtle(df, str(tmp_path / "out"), {"": X})
    assert c14n.isomorphic(df, read_turtle(spark, str(tmp_path / "out"), preserve_bnodes=True))
    for bad in (":a :p :b .", "<http://x/a> 'x' <http://x/b> .", "<http://x/a> <http://x/p> <http://x/b>", "<http://x/a> <http://x/p> '\\q' ."):
        with pytest.raises(ParseError):
            parse_turtle(bad)


def test_trig(spark):
    found = parse_trig("PREFIX : <http://x/> :a :p :b . { :c :p :d } :g { :a :p [] } GRAPH _:g2 { :a :p :b . }")
    assert sorted(str(q[0]) for q in found) == ["<http://x/g>", "None", "None", "_:g2"]
    assert c14n.isomorphic(to_frame(spark, found), to_frame(spark, parse_trig(pretty(found, {"": X}))))
    loose = parse_trig("'x' ?v <http://x/o> .", generalized=True)
    assert [t.kind for t in loose[0][1:]] == [2, 4, 1]


RDFXML = """<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://x/" xml:base="http://x/doc">
<e:T rdf:about="#a" e:name="n" xml:lang="en"><e:p rdf:resource="b"/><e:q rdf:parseType="Resource"><e:r rdf:datatype="http://www.w3.org/2001/XMLSchema#integer">5</e:r></e:q>
<e:l rdf:parseType="Collection"><rdf:Description rdf:about="c"/><rdf:Description rdf:nodeID="z"/></e:l></e:T><rdf:Seq><rdf:li>one</rdf:li><rdf:li>two</rdf:li></rdf:Seq></rdf:RDF>"""


def test_rdfxml(spark):
    found = parse_rdfxml(RDFXML)
    assert (None, iri(X + "doc#a"), iri(X + "name"), literal("n", lang="en")) in found and (None, iri(X + "doc#a"), iri(X + "p"), iri(X + "b")) in found
    assert len(found) == 13 and sum(q[2].value.startswith(RDF + "_") for q in found) == 2
    assert c14n.isomorphic(to_frame(spark, found), to_frame(spark, parse_rdfxml(to_rdfxml(found))))


def test_jsonld(spark):
    text = '{"@context": ["ctx", {"l": {"@id": "e:l", "@container": "@list"}, "when": {"@id": "e:when", "@type": "http://www.w3.org/2001/XMLSchema#date"}, "knows": {"@id": "e:knows", "@type": "@id"}}], "@id": "http://x/a", "@type": "e:T", "name": ["A", {"@value": "B", "@language": "fr"}], "l": [1, 2.5, true], "when": "2020-01-01", "knows": {"@id": "http://x/b", "knows": "http://x/a"}, "@graph": [{"@id": "http://x/c", "name": "C"}]}'
    load = static_loader({"http://x/ctx": '{"@context": {"e": "http://x/", "name": "e:name"}}'})
    found = parse_jsonld(text, "http://x/doc", load)
    assert (None, iri(X + "a"), iri(X + "when"), literal("2020-01-01", XSD + "date")) in found
    assert (iri(X + "a"), iri(X + "c"), iri(X + "name"), literal("C")) in found and (None, iri(X + "b"), iri(X + "knows"), iri(X + "a")) in found
    assert c14n.isomorphic(to_frame(spark, found), to_frame(spark, parse_jsonld(to_jsonld(found, native_types=True))))
    with pytest.raises(ValueError):
        parse_jsonld(text, "http://x/doc")
    assert callable(file_loader())


def test_results():
    text = '{"head": {"vars": ["a", "b"]}, "results": {"bindings": [{"a": {"type": "uri", "value": "http://x/a"}, "b": {"type": "literal", "value": "x", "xml:lang": "en", "its:dir": "ltr"}}, {"a": {"type": "triple", "value": {"subject": {"type": "bnode", "value": "s"}, "predicate": {"type": "uri", "value": "http://x/p"}, "object": {"type": "literal", "value": "5", "datatype": "http://www.w3.org/2001/XMLSchema#integer"}}}}]}}'
    decoded = results.from_json(text)
    assert decoded[0] == ["a", "b"] and decoded[1][1]["a"].parts[2] == literal(5)
    assert results.from_json(results.to_json(decoded)) == decoded
    xml = '<sparql xmlns="http://www.w3.org/2005/sparql-results#"><head><variable name="a"/></head><results><result><binding name="a"><literal xml:lang="en">x</literal></binding></result><result/></results></sparql>'
    assert results.from_xml(xml) == (["a"], [{"a": literal("x", lang="en")}, {}])
    assert results.from_xml('<sparql xmlns="http://www.w3.org/2005/sparql-results#"><head/><boolean>true</boolean></sparql>') is True
    client = results.Client("http://e/sparql", send=lambda request: ("application/sparql-results+json", text))
    assert client.query("SELECT * {}") == decoded


def test_graph_operations(spark):
    df = to_frame(spark, parse_trig("PREFIX : <http://x/> :a :p 'x'@en, 5, <<( _:b :q 'in' )>> . :g { :a :p :b . :c :p :b } :h { :a :p :b }"))
    assert quads.matching(df, p=quads.one(iri(X + "p")), o=quads.kind(LITERAL)).count() == 2
    assert quads.matching(df, o=quads.language("EN")).count() == 1 and quads.matching(df, o=quads.datatype(XSD + "integer")).count() == 1
    assert quads.matching(df, g=quads.graph_name(None)).count() == 3 and quads.matching(df, g=quads.other_than(quads.one(iri(X + "g")))).count() == 4
    assert quads.matching(df, o=quads.triple(p=quads.one(iri(X + "q")))).count() == 1 and quads.matching(df, s=quads.among([iri(X + "c"), iri(X + "z")])).count() == 1
    assert quads.contains(df, (iri(X + "g"), iri(X + "c"), iri(X + "p"), iri(X + "b"))) and not quads.contains(df, (None, iri(X + "c"), iri(X + "p"), iri(X + "b")))
    assert quads.union_graph(df).count() == 5 and quads.graph(df, iri(X + "g")).count() == 2 and quads.column_terms(df, "g").count() == 2
    assert quads.literals(df).count() == 3 and quads.blank_nodes(df).count() == 1 and quads.triple_terms(df).count() == 1
    more = to_frame(spark, [(None, iri(X + "a"), iri(X + "p"), literal(5)), (None, iri(X + "new"), iri(X + "p"), literal(5))])
    assert quads.insert_count(df, more) == 1 and quads.inserted(df, more).count() == 7 and quads.removed(df, more).count() == 5 and quads.remove_count(df, more) == 1
    assert quads.remove_matching(df, o=quads.kind(LITERAL)).count() == 4 and quads.retain_matching(df, o=quads.kind(LITERAL)).count() == 2


def triples(text):
    return parse_turtle(f"PREFIX : <http://x/> PREFIX rdf: <{RDF}> PREFIX rdfs: <{RDFS}> PREFIX xsd: <{XSD}> {text}")


ENTAILED = [
    (":a :p _:x .", "_:y :p _:z .", "simple", (), True), (":a :p :b .", ":a :p :c .", "simple", (), False), (":a :p 01 .", ":a :p 1 .", "simple", reasoning.SPARQL, True), (":a :p 1.0 .", ":a :p 1 .", "simple", reasoning.SPARQL, True),
    (":a :p :b .", ":p a rdf:Property .", "rdf", (), True), (":a :p 5, 500 .", "_:x :p _:v . _:v a xsd:byte .", "rdf", reasoning.SPARQL, True), (":a :p 500 .", ":a :p _:v . _:v a xsd:byte .", "rdf", reasoning.SPARQL, False),
]


@pytest.mark.parametrize("premise, conclusion, rules, known, expected", ENTAILED)
def test_entailment(spark, premise, conclusion, rules, known, expected):
    assert reasoning.entails(to_frame(spark, triples(premise)), triples(conclusion), rules, known) is expected


def test_rdfs(spark):
    premise = triples(":C rdfs:subClassOf :D . :D rdfs:subClassOf :E . :a a :C . :p rdfs:domain :F ; rdfs:range :G . :G rdfs:subClassOf :H . :q rdfs:subPropertyOf :p . :x :q :y . :x rdf:_3 :z .")
    closed = set(from_frame(reasoning.saturate(to_frame(spark, premise).select("s", "p", "o"))))
    for t in triples(":a a :D, :E . :C rdfs:subClassOf :E, :C . :x a :F ; :p :y . :y a :G, :H, rdfs:Resource . rdf:_3 rdfs:subPropertyOf rdfs:member . :q rdfs:subPropertyOf :q . :p a rdf:Property . rdfs:label rdfs:range rdfs:Literal ."):
        assert t in closed, t
    for t in triples(":a a :F . :E rdfs:subClassOf :C . :y :p :x ."):
        assert t not in closed, t


def test_inconsistency(spark):
    with pytest.raises(reasoning.Inconsistent):
        reasoning.saturate(to_frame(spark, triples(":a :p 'x'^^xsd:integer .")), "rdf", reasoning.SPARQL)
    with pytest.raises(reasoning.Inconsistent):
        reasoning.saturate(to_frame(spark, [(None, iri(X + "v"), iri(RDF + "type"), iri(XSD + x)) for x in ("integer", "boolean")]), "rdf", reasoning.SPARQL)


def test_each_graph_by_itself(spark):
    df = to_frame(spark, parse_trig(f"PREFIX : <http://x/> PREFIX rdfs: <{RDFS}> :g {{ :C rdfs:subClassOf :D }} :h {{ :a a :C }}"))
    assert reasoning.saturate(df, "rdfs", resources=False).where((F.col("s.v") == X + "a") & (F.col("o.v") == X + "D")).isEmpty()


def cycle(n, tag, p="p"):
    return [(None, bnode(f"{tag}{i}"), iri(X + p), bnode(f"{tag}{(i + 1) % n}")) for i in range(n)]


def test_canonical_labels(spark):
    rng = random.Random(3)
    for make in (cycle(5, "a"), cycle(2, "a") + cycle(3, "b"), [(None, iri(X + "a"), iri(X + "p"), bnode("q")), (None, bnode("q"), iri(X + "r"), literal("v"))], [(bnode("g"), bnode("a"), iri(X + "p"), bnode("b")), (bnode("g"), bnode("b"), iri(X + "p"), bnode("a"))]):
        names = {t.value for q in make for t in q if t is not None and t.kind == 0}
        new = dict(zip(names, rng.sample([f"m{i}" for i in range(50)], len(names))))
        other = [tuple(t if t is None or t.kind else bnode(new[t.value]) for t in q) for q in make]
        rng.shuffle(other)
        a, b = ([r.value for r in c14n.normalized(to_frame(spark, x)).collect()] for x in (make, other))
        assert a == b and a == sorted(a)
        assert c14n.dataset_hash(make) == c14n.dataset_hash(other)
    assert c14n.dataset_hash(cycle(6, "a")) != c14n.dataset_hash(cycle(3, "a") + cycle(3, "b"))
    with pytest.raises(c14n.ToxicGraph):
        c14n.dataset_hash([(None, bnode(f"n{i}"), iri(X + "p"), bnode(f"n{j}")) for i in range(9) for j in range(9) if i != j])
    with pytest.raises(ValueError):
        c14n.normalized(to_frame(spark, [(None, iri(X + "a"), iri(X + "p"), triple_term(iri(X + "a"), iri(X + "p"), iri(X + "b")))]))


def test_isomorphism(spark):
    a = to_frame(spark, parse_turtle("_:a <http://x/p> <<( _:b <http://x/q> 'x' )>> . _:b <http://x/p> 1 ."))
    b = to_frame(spark, parse_turtle("_:z <http://x/p> 1 . _:y <http://x/p> <<( _:z <http://x/q> 'x' )>> ."))
    c = to_frame(spark, parse_turtle("_:y <http://x/p> 1 . _:y <http://x/p> <<( _:z <http://x/q> 'x' )>> ."))
    assert c14n.isomorphic(a, b) and not c14n.isomorphic(a, c)


def test_resources(spark, tmp_path):
    (tmp_path / "one.ttl").write_text("@prefix : <http://x/> . <#r> :id 7 ; :next <two#s> ; :items ( 1 2 3 ) ; :none () ; :many 1, 2 .")
    (tmp_path / "two.ttl").write_text("@prefix : <http://x/> . <#s> :name 'two' ; :back <one#r> .")
    loader = LocalLoader(spark, {"http://d/": str(tmp_path)})
    r = Resource(iri("http://d/one#r"), loader.graph("http://d/one"), loader)
    assert r.get_typed(X + "id", int) == 7 and r.get_resource(X + "next").get_term(X + "name") == literal("two")
    assert [t.value for t in r.get_list(X + "items")] == ["1", "2", "3"] and r.get_list(X + "none") == []
    assert r.get_any_term(X + "zz") is None and len(r.get_all_terms(X + "many")) == 2
    with pytest.raises(Cardinality):
        r.get_term(X + "many")
    assert r.get_resource(X + "next").get_resource(X + "back") == r
    loop = to_frame(spark, parse_turtle(f"PREFIX rdf: <{RDF}> _:a rdf:first 1 ; rdf:rest _:b . _:b rdf:first 2 ; rdf:rest _:a ."))
    assert list_items(loop).count() == 0


def test_lists(spark):
    """Of any length, sharing tails, ending badly; each cell of a list is made once."""
    first, rest, nil = iri(RDF + "first"), iri(RDF + "rest"), iri(RDF + "nil")
    chain = lambda tag, n, end: [q for i in range(n) for q in ((None, bnode(f"{tag}{i}"), first, literal(i)), (None, bnode(f"{tag}{i}"), rest, bnode(f"{tag}{i + 1}") if i + 1 < n else end))]
    quads = chain("a", 1, nil) + chain("b", 9, nil) + chain("c", 2, bnode("b7")) + chain("d", 4, bnode("d1")) + chain("e", 3, iri("http://x/end"))
    found = {r["head"]["v"]: [x["v"] for x in r["items"]] for r in list_items(to_frame(spark, quads)).collect()}
    assert found == {"a0": ["0"], "b0": [str(i) for i in range(9)], "c0": ["0", "1", "7", "8"]}
    assert list_members(to_frame(spark, quads)).count() == 1 + 9 + 4
    middle = Resource(iri("http://x/r"), to_frame(spark, [*quads, (None, iri("http://x/r"), iri(X + "l"), bnode("b5"))]))
    assert [t.value for t in middle.get_list(X + "l")] == [str(i) for i in range(5, 9)]


def test_deep_triple_terms(spark):
    deep = iri(X + "o")
    for i in range(7):
        deep = triple_term(bnode(f"b{i}") if i % 2 else iri(X + "s"), iri(X + "p"), deep if i else literal('a <<( b )>> " c', lang="en"))
    quads = [(iri(X + "g"), iri(X + "s"), iri(X + "p"), deep), (None, iri(X + "s"), iri(X + "p"), triple_term(bnode("b"), iri(X + "p"), iri(X + "o")))]
    lines = [quad_line(q) for q in quads]
    assert parse_nquads("\n".join(lines)) == quads
    frame = lambda x: spark.createDataFrame([(v,) for v in x], "value string")
    assert from_frame(parse_lines(frame(lines), preserve_bnodes=True)) == quads
    for bad in (lines[0].replace(")>> )>>", ")>>", 1), lines[0].replace("<<( <", "<<( <http://x/z> <", 1), lines[0][:-1]):
        with pytest.raises(ParseError):
            parse_nquads(bad)
        with pytest.raises(Exception, match="not N-Quads"):
            parse_lines(frame([bad])).collect()


def test_labels_of_few_alike(spark):
    """Nodes of one hash are named after all others, whose names come from Spark; both ways of naming agree."""
    own = [(None, bnode(f"o{i}"), iri(X + "n"), literal(i)) for i in range(40)]
    alike = [q for k in "xy" for q in ((None, bnode(k), iri(X + "p"), bnode(f"o{'xy'.index(k)}")), (None, bnode(k), iri(X + "q"), iri(X + "z")))]
    quads = own + alike + cycle(3, "c")
    df = to_frame(spark, quads)
    first = {r["node"]: r["hash"] for r in c14n.first_degree_hashes(df).collect()}
    assert len(set(first.values())) < len(first)
    names = c14n.canonical_labels(quads, first)
    assert {r["node"]: r["label"] for r in c14n._labels(df).collect()} == names and sorted(names.values()) == sorted(f"c14n{i}" for i in range(len(first)))
    renamed = to_frame(spark, [tuple(t if t is None or t.kind else bnode("r" + t.value[::-1]) for t in q) for q in quads])
    other = to_frame(spark, own + alike[:2] + [(None, bnode("y"), iri(X + "p"), bnode("o2")), alike[3]] + cycle(3, "c"))
    assert c14n.isomorphic(df, renamed) and not c14n.isomorphic(df, other)


def test_iris():
    base = "http://a/b/c/d;p?q"
    # the examples of RFC 3986
    for reference, wanted in {"g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y#s": "http://a/b/c/g?y#s", "#s": "http://a/b/c/d;p?q#s", "": "http://a/b/c/d;p?q", "../g": "http://a/b/g", "../../../g": "http://a/g", "g;x=1/../y": "http://a/b/c/y"}.items():
        assert iris.resolve(base, reference) == wanted
    for target in ("http://a/b/c/x", "http://a/b/c/d;p?q#z", "http://a/b/y", "http://other/x", "http://a/b/c/d;p?z"):
        assert iris.resolve(base, iris.relativize(base, target, 1)) == target
    assert iris.is_absolute("http://é.example/a?b#c") and not iris.is_absolute("a b") and iris.is_relative("../x") and not iris.is_relative("1:x y")
    assert iris.is_language_tag("en-Latn-GB-x-a") and not iris.is_language_tag("en--GB")


def test_star_is_one_scan(spark):
    e = Engine(VirtualStore(spark, "/root/testdata/sf0.001"))
    df = e.query("SELECT ?f ?q { ?l <urn:x:lineitem#l_returnflag> ?f ; <urn:x:lineitem#l_quantity> ?q ; <urn:x:lineitem#l_shipdate> ?d FILTER(?q > 45) }").df
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan and "l_tax" not in plan
    assert "l_quantity#" in plan.split("DataFilters")[1].split("Format")[0] and "CASE" not in plan


def test_virtual_equals_quads(spark):
    """A query on the tables gives what it gives on their triples."""
    v = VirtualStore(spark, "/root/testdata/sf0.001")
    v.tables = {n: v.tables[n] for n in ("region", "nation", "supplier")}
    q = "SELECT ?r ?n { ?s <urn:x:supplier#s_nationkey> ?x ; <urn:x:supplier#s_acctbal> ?b . ?x <urn:x:nation#n_name> ?n ; <urn:x:nation#n_regionkey>/<urn:x:region#r_name> ?r FILTER(?b > 3000) }"
    rows = lambda e: sorted(map(tuple, e.query(q).df.collect()))
    assert rows(Engine(v)) == rows(Engine(v.quads())) != []


def test_stream(spark, tmp_path):
    from quadlake.streaming.quads import predicate_counts, stream_matching, stream_nquads

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.nq").write_text("<http://x/a> <http://x/p> <http://x/b> .\n<http://x/a> <http://x/q> <http://x/b> .\n")
    s = stream_nquads(spark, str(tmp_path / "in"))
    counts = predicate_counts(stream_matching(s, s=quads.one(iri(X + "a"))))
    query = counts.writeStream.format("memory").queryName("seen").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {tuple(r) for r in spark.table("seen").collect()} == {(X + "p", 1), (X + "q", 1)}


def test_entry():
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) >= 60


def test_terms_round_trip(spark):
    terms = [iri(X + "a"), bnode("b"), literal("x", lang="EN", direction="rtl"), triple_term(iri(X + "a"), iri(X + "p"), literal(1.5))]
    df = to_frame(spark, [(None, iri(X + "s"), iri(X + "p"), t) for t in terms])
    assert [from_row(r.o) for r in df.collect()] == terms and isinstance(terms[0], Term)


def test_many_small_components(spark, monkeypatch):
    """Components are dealt out by number and solved in turn in a task; datasets whose first-degree hashes differ are told apart without being named."""
    from quadlake.terms import BNODE

    monkeypatch.setattr(c14n, "NODES", 10)
    df = spark.range(60).selectExpr("concat('n', id) AS x", "concat('n', IF(id % 3 = 2, id - 2, id + 1)) AS y")
    node = lambda c: F.struct(F.lit(BNODE).cast("tinyint").alias("k"), F.col(c).alias("v"), *[F.lit(None).cast("string").alias(f) for f in "dlr"])
    rings = df.select(node("x").alias("s"), iri("urn:x:next").column().alias("p"), node("y").alias("o"))
    names = c14n.relabeled(quads.to_quads(rings))
    assert sorted(int(r[0][4:]) for r in names.select("s.v").collect()) == list(range(60))
    assert names.where("CAST(substr(s.v, 5) AS int) DIV 3 <> CAST(substr(o.v, 5) AS int) DIV 3").isEmpty()
    one = rings.withColumn("o", F.when(F.col("s.v") == "n5", F.col("s")).otherwise(F.col("o")))
    monkeypatch.setattr(c14n, "_labels", None)
    assert not c14n.isomorphic(rings, one)


def test_finished_cells_of_lists_are_not_joined_again(spark, monkeypatch):
    """Only cells that have not reached the end take part in a round's join."""
    from quadlake.operators import resource

    plans = []
    monkeypatch.setattr(resource, "materialize", lambda df, label="table": (plans.append(df._jdf.queryExecution().optimizedPlan().toString()) if label == "hops" else None, df.localCheckpoint())[1])
    text = " ".join(f"_:h{k} <urn:x:at> ( " + " ".join(str(i) for i in range(k)) + " ) ." for k in range(1, 6))
    found = {len(r["items"]): [x["v"] for x in r["items"]] for r in list_items(to_frame(spark, parse_turtle(text)).select("s", "p", "o")).collect()}
    assert found == {k: [str(i) for i in range(k)] for k in range(1, 6)}
    assert plans and all("Union" in p for p in plans)


def test_every_atom(spark):
    """Terms of all kinds at once, as one kind at a time gives them."""
    inner = triple_term(iri("urn:x:a"), iri("urn:x:b"), literal("c"))
    df = to_frame(spark, [(None, bnode("n"), iri("urn:x:b"), triple_term(bnode("m"), iri("urn:x:d"), inner)), (None, iri("urn:x:a"), iri("urn:x:b"), inner)])
    found = {r["v"]: r["k"] for r in quads.every_atom(df).select("t.v", "t.k").collect()}
    assert sorted(found.values()) == [0, 0, 1, 1, 1, 2, 3, 3] and found["c"] == 2 and quads.every_atom(df).count() == 8
    assert {r[0] for r in quads.iris(df).select("t.v").collect()} == {"urn:x:a", "urn:x:b", "urn:x:d"}
