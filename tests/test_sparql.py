"""Queries over small graphs, with the solutions they must have."""

import itertools

import pytest

from quadlake.plans.compiler import Engine
from quadlake.plans.parser import SparqlError, parse
from quadlake.sources.nquads import to_frame
from quadlake.sources.turtle import parse_trig
from quadlake.terms import XSD, canonical, from_row, parse_term

DATA = """
PREFIX : <http://x/> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#>
:a :p :b . :b :p :c . :c :p :b . :d :q :a, :b .
:a :name "Alice"@en ; :age 30 . :b :name "Bob" ; :age 25.5 . :c :age "old" .
_:r :says <<( :a :p :b )>> .
:g { :a :name "Albert" . :z :p :y }
:h { :z :p :x }
"""


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(to_frame(spark, parse_trig(DATA)).cache(), {"": "http://x/", "xsd": XSD})


def rows(engine, query):
    r = engine.query(query)
    return sorted(tuple(canonical(x[v]).replace("http://x/", "").replace(XSD, "xsd:") if v in x else "-" for v in r.names) for x in r.rows())


def value(engine, expression):
    found = rows(engine, f"SELECT ({expression} AS ?x) {{}}")
    return found[0][0]


PATTERNS = [
    ("SELECT ?s ?o { ?s :p ?o }", [("<a>", "<b>"), ("<b>", "<c>"), ("<c>", "<b>")]),
    ("SELECT ?s { ?s :p ?o . ?o :p ?s }", [("<b>",), ("<c>",)]),
    ("SELECT ?s { ?s :p ?s }", []),
    ("SELECT ?s ?n { ?s :p ?o OPTIONAL { ?s :name ?n } }", [("<a>", '"Alice"@en'), ("<b>", '"Bob"'), ("<c>", "-")]),
    ("SELECT ?s ?n { ?s :age ?a OPTIONAL { ?s :name ?n FILTER(?a > 26) } }", [("<a>", '"Alice"@en'), ("<b>", "-"), ("<c>", "-")]),
    ("SELECT ?s { ?s :age ?a FILTER(?a > 26) }", [("<a>",)]),
    ("SELECT ?s { ?s :age ?a FILTER(?a = 'old' || ?a < 26) }", [("<b>",), ("<c>",)]),
    ("SELECT ?s { { ?s :q :a } UNION { ?s :age 30 } }", [("<a>",), ("<d>",)]),
    ("SELECT ?s { ?s :p ?o MINUS { ?s :name ?n } }", [("<c>",)]),
    ("SELECT ?s { ?s :p ?o MINUS { ?x :name ?n } }", [("<a>",), ("<b>",), ("<c>",)]),
    ("SELECT ?s { ?s :p ?o FILTER NOT EXISTS { ?o :name ?n } }", [("<b>",)]),
    ("SELECT ?s { ?s :p ?o FILTER(EXISTS { ?o :name ?n } && ?s != :c) }", [("<a>",)]),
    ("SELECT ?g ?s { GRAPH ?g { ?s ?p ?o } }", [("<g>", "<a>"), ("<g>", "<z>"), ("<h>", "<z>")]),
    ("SELECT ?n { GRAPH :g { :a :name ?n } }", [('"Albert"',)]),
    ("SELECT ?g { GRAPH ?g {} }", [("<g>",), ("<h>",)]),
    ("SELECT ?g (COUNT(*) AS ?n) { GRAPH ?g { ?s :p ?o } } GROUP BY ?g", [("<g>", '"1"^^<xsd:integer>'), ("<h>", '"1"^^<xsd:integer>')]),
    ("SELECT ?s FROM :g FROM :h { ?s :p ?o }", [("<z>",), ("<z>",)]),
    ("SELECT ?s FROM NAMED :h { GRAPH ?g { ?s :p ?o } }", [("<z>",)]),
    ("SELECT ?x ?y { VALUES (?x ?y) { (1 UNDEF) (2 :b) } ?s :p ?y }", [('"1"^^<xsd:integer>', "<b>"), ('"1"^^<xsd:integer>', "<b>"), ('"1"^^<xsd:integer>', "<c>"), ('"2"^^<xsd:integer>', "<b>"), ('"2"^^<xsd:integer>', "<b>")]),
    ("SELECT ?s ?o { ?r :says <<( ?s :p ?o )>> }", [("<a>", "<b>")]),
    ("SELECT ?x { BIND(1/0 AS ?x) }", [("-",)]),
    ("SELECT DISTINCT ?o { ?s :p ?o }", [("<b>",), ("<c>",)]),
    ("SELECT ?m { { SELECT (MAX(?a) AS ?m) { ?s :age ?a FILTER(isNumeric(?a)) } } }", [('"30"^^<xsd:integer>',)]),
    ("SELECT ?s { ?s :age ?a } ORDER BY DESC(?a) LIMIT 1", [("<c>",)]),
    ("SELECT ?X ?x { VALUES (?X ?x) { (1 2) } }", [('"1"^^<xsd:integer>', '"2"^^<xsd:integer>')]),
]


@pytest.mark.parametrize("query, expected", PATTERNS)
def test_patterns(engine, query, expected):
    assert rows(engine, query) == sorted(expected)


PATHS = [
    (":a :p/:p ?x", ["<c>"]), (":a :p+ ?x", ["<b>", "<c>"]), (":a :p* ?x", ["<a>", "<b>", "<c>"]), (":a :p? ?x", ["<a>", "<b>"]), ("?x ^:q :b", []), (":b ^:q ?x", ["<d>"]),
    ("?x :p+ :c", ["<a>", "<b>", "<c>"]), (":a (:p|:q)/:p ?x", ["<c>"]), (":d !(:p|:name) ?x", ["<a>", "<b>"]), (":b !(^:q) ?x", ["<a>", "<c>"]), (":nowhere :p* ?x", ["<nowhere>"]), (":d (:q/:p)+ ?x", ["<b>", "<c>"]),
]


@pytest.mark.parametrize("path, expected", PATHS)
def test_paths(engine, path, expected):
    assert rows(engine, f"SELECT ?x {{ {path} }}") == sorted((x,) for x in expected)


EXPRESSIONS = [
    ("1+2*3", '"7"^^<xsd:integer>'), ("7/2", '"3.5"^^<xsd:decimal>'), ("1/3 > 0.3333333333", '"true"^^<xsd:boolean>'), ("1.5+1", '"2.5"^^<xsd:decimal>'), ("1e0+1", '"2.0e0"^^<xsd:double>'), ("1e0/0", '"INF"^^<xsd:double>'), ("1/0", "-"),
    ("'a' < 'b'", '"true"^^<xsd:boolean>'), ("1 = 1.0", '"true"^^<xsd:boolean>'), ("sameTerm(1, 1.0)", '"false"^^<xsd:boolean>'), ("'a' = 1", '"false"^^<xsd:boolean>'), ("'a'^^:t = 'b'^^:t", "-"), (":a = :b", '"false"^^<xsd:boolean>'),
    ("'a'@en = 'a'@EN", '"true"^^<xsd:boolean>'), ("!(1/0 = 1) || true", '"true"^^<xsd:boolean>'), ("2 IN (1, 2.0)", '"true"^^<xsd:boolean>'), ("2 NOT IN (1, 3)", '"true"^^<xsd:boolean>'), ("IF(true, 1, 1/0)", '"1"^^<xsd:integer>'),
    ("COALESCE(1/0, 'z')", '"z"'), ("STRLEN('日本')", '"2"^^<xsd:integer>'), ("SUBSTR('foobar', 0, 3)", '"fo"'), ("SUBSTR('foobar'@en, 4)", '"bar"@en'), ("UCASE('a'@en)", '"A"@en'), ("CONCAT('a'@en, 'b'@en)", '"ab"@en'), ("CONCAT('a'@en, 'b')", '"ab"'),
    ("STRBEFORE('abc'@en, 'b')", '"a"@en'), ("STRAFTER('abc', 'z')", '""'), ("CONTAINS('abc'@en, 'b'@fr)", "-"), ("REPLACE('abab', 'a(b)', '$1')", '"bb"'), ("REPLACE('abc', 'z*', 'x')", "-"), ("REGEX('ABC', '^a', 'i')", '"true"^^<xsd:boolean>'),
    ("ENCODE_FOR_URI('a b~*é')", '"a%20b~%2A%C3%A9"'), ("LANG('a'@en--ltr)", '"en"'), ("LANGDIR('a'@en--ltr)", '"ltr"'), ("hasLANG('a')", '"false"^^<xsd:boolean>'), ("LANGMATCHES('en-GB', 'EN')", '"true"^^<xsd:boolean>'),
    ("DATATYPE(1.0)", "<xsd:decimal>"), ("STRDT('1', xsd:integer)", '"1"^^<xsd:integer>'), ("STRLANG('a', 'en')", '"a"@en'), ("ROUND(-1.5)", '"-2.0"^^<xsd:decimal>'), ("CEIL(1.2)", '"2.0"^^<xsd:decimal>'), ("ABS(-3)", '"3"^^<xsd:integer>'), ("FLOOR(-1.5e0)", '"-2.0e0"^^<xsd:double>'),
    ("MD5('abc')", '"900150983cd24fb0d6963f7d28e17f72"'), ("SHA1('abc')", '"a9993e364706816aba3e25717850c26c9cd0d89d"'), ("YEAR('2020-03-04T24:00:00Z'^^xsd:dateTime)", '"2020"^^<xsd:integer>'), ("DAY('2020-03-04T24:00:00Z'^^xsd:dateTime)", '"5"^^<xsd:integer>'),
    ("SECONDS('2020-03-04T05:06:07.25Z'^^xsd:dateTime)", '"7.25"^^<xsd:decimal>'), ("TZ('2020-03-04T05:06:07+02:00'^^xsd:dateTime)", '"+02:00"'), ("'2020-01-01T00:00:00Z'^^xsd:dateTime < '2020-01-01T01:00:00+00:30'^^xsd:dateTime", '"true"^^<xsd:boolean>'),
    ("'2020-01-01T00:00:00Z'^^xsd:dateTime < '2020-01-01T10:00:00'^^xsd:dateTime", "-"), ("xsd:integer('12')", '"12"^^<xsd:integer>'), ("xsd:integer(-1.7)", '"-1"^^<xsd:integer>'), ("xsd:boolean('x')", "-"), ("xsd:double('1e3') = 1000", '"true"^^<xsd:boolean>'), ("xsd:string(1.0)", '"1"'),
    ("xsd:decimal('1.50')", '"1.5"^^<xsd:decimal>'), ("isNUMERIC('1'^^xsd:byte)", '"true"^^<xsd:boolean>'), ("isNUMERIC('300'^^xsd:byte)", '"false"^^<xsd:boolean>'), ("isIRI(IRI('http://x/q'))", '"true"^^<xsd:boolean>'), ("TRIPLE(:a, :p, 1)", '<<( <a> <p> "1"^^<xsd:integer> )>>'),
    ("OBJECT(TRIPLE(:a, :p, 1))", '"1"^^<xsd:integer>'), ("isTRIPLE(:a)", '"false"^^<xsd:boolean>'), (":unknown(1)", "-"), ("BOUND(?nothing)", '"false"^^<xsd:boolean>'), ("'NaN'^^xsd:double = 'NaN'^^xsd:double", '"true"^^<xsd:boolean>'), ("-(2)", '"-2"^^<xsd:integer>'),
]


def test_expressions(engine):
    # one query for all, as each alone costs a job
    names = [f"?x{i}" for i in range(len(EXPRESSIONS))]
    for k in range(0, len(EXPRESSIONS), 12):
        part = EXPRESSIONS[k : k + 12]
        found = rows(engine, "SELECT " + " ".join(f"({e} AS {n})" for (e, _), n in zip(part, names)) + " {}")[0]
        assert list(zip([e for e, _ in part], found)) == [(e, x.replace("http://x/", "")) for e, x in part]


def test_aggregates(engine):
    values = "VALUES (?room ?seats) { ('north' 30) ('south' 8) ('north' 5) ('south' 8) ('north' 30) }"
    n = lambda v, t="integer": f'"{v}"^^<xsd:{t}>'
    got = rows(engine, f"SELECT ?room (SUM(?seats) AS ?all) (SUM(DISTINCT ?seats) AS ?kinds) (COUNT(DISTINCT ?seats) AS ?k) (MAX(?seats) AS ?top) {{ {values} }} GROUP BY ?room")
    assert got == [('"north"', n(65), n(35), n(2), n(30)), ('"south"', n(16), n(8), n(1), n(8))]
    assert rows(engine, f"SELECT (AVG(?seats) AS ?a) (MIN(?seats) AS ?b) (COUNT(*) AS ?c) {{ {values} }}") == [(n("16.2", "decimal"), n(5), n(5))]
    assert rows(engine, "SELECT (SUM(?v) AS ?s) (COUNT(?v) AS ?n) { VALUES ?v { 1 'x' } }") == [("-", n(2))]
    assert rows(engine, "SELECT (SUM(?v) AS ?s) (AVG(?v) AS ?a) (MAX(?v) AS ?m) (GROUP_CONCAT(?v) AS ?g) { VALUES ?v { } }") == [(n(0), n("0.0", "decimal"), "-", '""')]


def test_forms(engine):
    assert engine.query("ASK { :a :p :b }") is True and engine.query("ASK { :a :p :zz }") is False
    made = engine.query("CONSTRUCT { ?s :k _:n . ?n :k ?s } WHERE { ?s :name ?n }").collect()
    assert len(made) == 2 and len({r.o.v for r in made}) == 2
    about = {tuple(canonical(from_row(x)) for x in r) for r in engine.query("DESCRIBE :c").collect()}
    assert {t[0] for t in about} == {"<http://x/b>", "<http://x/c>"} and len(about) == 3


def test_errors():
    for bad in ("SELECT * {", "SELECT ?x { ?x ?y }", "SELECT (1 AS ?x) { VALUES ?x { 1 } }", "SELECT ?x { FILTER(COUNT(?x) > 1) }", "SELECT ?x { ?x unknown:p 1 }"):
        with pytest.raises(SparqlError):
            parse(bad)


def test_canonical_text_round_trip():
    for text in ('"a\\nb\\"c\\\\"', '"x"@en--rtl', '<<( <http://a> <http://b> <<( _:x <http://c> "1"^^<http://d> )>> )>>'):
        assert canonical(parse_term(text)) == text


OPEN = "VALUES (?a ?b) { (1 1) (1 UNDEF) (UNDEF 2) (UNDEF UNDEF) (2 2) (1 1) (3 UNDEF) }"
LEFT = [{"a": 1, "b": 1}, {"a": 1}, {"b": 2}, {}, {"a": 2, "b": 2}, {"a": 1, "b": 1}, {"a": 3}]
RIGHT = [{"b": 1, "a": 1, "c": 5}, {"a": 1, "c": 6}, {"b": 2, "c": 7}, {"c": 8}, {"b": 1, "a": 2, "c": 9}]


def _plain(kind, right):
    agree = lambda x, y: all(x[k] == y[k] for k in x.keys() & y.keys())
    if kind == "join":
        return [{**x, **y} for x, y in itertools.product(LEFT, right) if agree(x, y)]
    if kind == "optional":
        return _plain("join", right) + [x for x in LEFT if not any(agree(x, y) for y in right)]
    if kind == "minus":
        return [x for x in LEFT if not any(agree(x, y) and x.keys() & y.keys() for y in right)]
    return [x for x in LEFT if any(agree(x, y) for y in right) == (kind == "exists")]


@pytest.mark.parametrize("right", [RIGHT, RIGHT[:3], RIGHT[:1] + RIGHT[4:]])
@pytest.mark.parametrize("kind,words", [("join", ""), ("optional", "OPTIONAL"), ("minus", "MINUS"), ("exists", "FILTER EXISTS"), ("not exists", "FILTER NOT EXISTS")])
def test_joins_of_unbound_variables(engine, kind, words, right):
    """Against all pairs, and by a plan that doesn't make them."""
    values = "VALUES (?b ?a ?c) { " + " ".join(f"({x.get('b', 'UNDEF')} {x.get('a', 'UNDEF')} {x['c']})" for x in right) + " }"
    r = engine.query(f"SELECT ?a ?b ?c {{ {OPEN} {words} {{ {values} }} }}")
    found = sorted(str(sorted((k, int(t.value)) for k, t in x.items() if t is not None)) for x in r.rows())
    assert found == sorted(str(sorted(x.items())) for x in _plain(kind, right))
    assert "NestedLoop" not in r.df._jdf.queryExecution().executedPlan().toString()


def test_exists_as_a_value(engine):
    query = "SELECT ?o ?x ?y { ?s :p ?o BIND(EXISTS { ?o :name ?n } AS ?x) BIND(NOT EXISTS { ?o :q ?n } || EXISTS { ?o :age 25.5 } AS ?y) }"
    true, false = ('"%s"^^<xsd:boolean>' % x for x in ("true", "false"))
    assert rows(engine, query) == [("<b>", true, true), ("<b>", true, true), ("<c>", false, true)]
