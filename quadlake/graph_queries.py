"""Queries over graphs made of the driver's tables: formats, matchers, graph operations, inference, canonical labels, lists; each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import c14n, quads, reasoning
from .operators.resource import list_items
from .queries import frame_query
from .storage import materialize, new_path
from .terms import BNODE, IRI, LITERAL, RDF, RDFS, XSD, iri, literal, term

X = "urn:x:"
PLAIN = XSD + "string"


def _iri(*parts: Column | str) -> Column:
    return term(IRI, F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))


def _quad(df: DataFrame, graph: str, s: Column, p: str, o: Column) -> DataFrame:
    return df.select(iri(X + "graph/" + graph).column().alias("g"), s.alias("s"), iri(p).column().alias("p"), o.alias("o"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quads of regions and nations in two named graphs: names, in nations tagged as English, and the region of each nation."""
    region, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation"))
    r, n = _iri(X, "region/", F.col("r_regionkey")), _iri(X, "nation/", F.col("n_nationkey"))
    parts = [
        _quad(region, "region", r, X + "name", term(LITERAL, F.col("r_name"), PLAIN)),
        _quad(nation, "nation", n, X + "name", term(LITERAL, F.col("n_name"), None, F.lit("en"))),
        _quad(nation, "nation", n, X + "in", _iri(X, "region/", F.col("n_regionkey"))),
        _quad(nation, "nation", n, X + "key", term(LITERAL, F.col("n_nationkey").cast("string"), XSD + "integer")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


# The same quads as SQL: graph, subject, predicate, kind, value, datatype, language.
PLACES = f"""
q AS (SELECT '{X}graph/region' AS g, '{X}region/' || r_regionkey AS s, '{X}name' AS p, 'literal' AS k, r_name AS o, '{PLAIN}' AS d, NULL AS l FROM region
      UNION ALL SELECT '{X}graph/nation', '{X}nation/' || n_nationkey, '{X}name', 'literal', n_name, NULL, 'en' FROM nation
      UNION ALL SELECT '{X}graph/nation', '{X}nation/' || n_nationkey, '{X}in', 'iri', '{X}region/' || n_regionkey, NULL, NULL FROM nation
      UNION ALL SELECT '{X}graph/nation', '{X}nation/' || n_nationkey, '{X}key', 'literal', n_nationkey::VARCHAR, '{XSD}integer', NULL FROM nation)"""
FLAT = ("g.v AS g", "s.v AS s", "p.v AS p", "o.v AS o", "o.d AS d", "o.l AS l")
ALL = f"WITH {PLACES} SELECT g, s, p, o, d, l FROM q"


@frame_query("nquads_round_trip", ALL)
def _nquads(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.nquads import read_nquads, write_nquads

    write_nquads(places(spark, sf_dir), path := new_path(spark, "nquads"))
    return read_nquads(spark, path).selectExpr(*FLAT)


@frame_query("nquads_lines", f"""WITH {PLACES} SELECT '<' || s || '> <' || p || '> ' || CASE WHEN k = 'iri' THEN '<' || o || '>' ELSE '"' || o || '"' END
    || CASE WHEN l IS NOT NULL THEN '@' || l WHEN d IS NOT NULL AND d <> '{PLAIN}' THEN '^^<' || d || '>' ELSE '' END || ' <' || g || '> .' AS line FROM q""")
def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.nquads import line_column

    df = places(spark, sf_dir)
    return df.select(F.rtrim(line_column(df)).alias("line"))


@frame_query("ntriples_round_trip", f"WITH {PLACES} SELECT s, p, o, d, l FROM q")
def _ntriples(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.nquads import read_nquads, write_ntriples

    write_ntriples(places(spark, sf_dir), path := new_path(spark, "ntriples"))
    return read_nquads(spark, path).where("g IS NULL").selectExpr(*FLAT[1:])


@frame_query("turtle_round_trip", f"WITH {PLACES} SELECT s, p, o, d, l FROM q")
def _turtle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.turtle import read_turtle
    from .sources.writers import write_turtle

    write_turtle(places(spark, sf_dir).select("s", "p", "o"), path := new_path(spark, "turtle"))
    return read_turtle(spark, path).selectExpr(*FLAT[1:])


@frame_query("trig_round_trip", ALL)
def _trig(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.turtle import read_trig
    from .sources.writers import write_trig

    write_trig(places(spark, sf_dir), path := new_path(spark, "trig"))
    return read_trig(spark, path).selectExpr(*FLAT)


def _matched(name: str, where: str, **matchers) -> None:
    frame_query(name, f"{ALL} WHERE {where}")(lambda spark, d: quads.matching(places(spark, d), **matchers).selectExpr(*FLAT))


_matched("match_one", f"p = '{X}in'", p=quads.one(iri(X + "in")), s=quads.anything)
_matched("match_none", "false", p=quads.one(None))
_matched("match_among", f"o IN ('{X}region/1', 'ASIA') AND (k = 'iri' OR d = '{PLAIN}')", o=quads.among([iri(X + "region/1"), literal("ASIA")]))
_matched("match_other_than", f"p <> '{X}name' AND s <> '{X}nation/3'", p=quads.other_than(quads.one(iri(X + "name"))), s=quads.other_than(quads.one(iri(X + "nation/3"))))
_matched("match_kind", "k = 'literal'", o=quads.kind(LITERAL))
_matched("match_datatype", f"d = '{XSD}integer'", o=quads.datatype(XSD + "integer"))
_matched("match_language", "l = 'en'", o=quads.language("EN"))
_matched("match_graph", f"g = '{X}graph/region'", g=quads.graph_name(iri(X + "graph/region")))
_matched("match_function", "length(o) > 8", o=lambda c: F.length(c["v"]) > 8)


@frame_query("graph_parts", f"""WITH {PLACES} SELECT 'subject' AS what, s AS t FROM q GROUP BY s UNION ALL SELECT 'predicate', p FROM q GROUP BY p
    UNION ALL SELECT 'graph', g FROM q GROUP BY g UNION ALL SELECT 'object', o FROM q WHERE k = 'iri' GROUP BY o""")
def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = places(spark, sf_dir)
    found = [quads.column_terms(df, c, m).select(F.lit(w).alias("what"), F.col("t.v").alias("t")) for w, c, m in (("subject", "s", quads.anything), ("predicate", "p", quads.anything), ("graph", "g", quads.anything), ("object", "o", quads.kind(IRI)))]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


@frame_query("graph_atoms", f"""WITH {PLACES}, t AS (SELECT unnest([g, s, p]) AS v FROM q UNION SELECT o FROM q WHERE k = 'iri')
    SELECT 'iri' AS kind, count(DISTINCT v) AS n FROM t UNION ALL SELECT 'literal', count(DISTINCT (o, d, l)) FROM q WHERE k = 'literal'""")
def _atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = places(spark, sf_dir)
    both = quads.iris(df).select(F.lit("iri").alias("kind"), "t").unionByName(quads.literals(df).select(F.lit("literal").alias("kind"), "t"))
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@frame_query("graph_set_operations", f"WITH {PLACES} SELECT g, s, p, o, d, l FROM q WHERE p <> '{X}key' EXCEPT SELECT g, s, p, o, d, l FROM q WHERE k = 'iri'")
def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = places(spark, sf_dir)
    keyed = quads.remove_matching(df, p=quads.one(iri(X + "key")))
    again = quads.inserted(keyed, quads.retain_matching(keyed, p=quads.one(iri(X + "name"))))
    return quads.removed(again, quads.matching(df, o=quads.kind(IRI))).selectExpr(*FLAT)


@frame_query("graph_counts", f"WITH {PLACES} SELECT 0::BIGINT AS old, count(*) FILTER (k = 'iri')::BIGINT AS removed, bool_or(o = 'EUROPE') AS has FROM q")
def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = materialize(places(spark, sf_dir), "places")
    edges = quads.matching(df, o=quads.kind(IRI))
    europe = [r["s"] for r in quads.matching(df, o=quads.one(literal("EUROPE"))).select("s.v").withColumnRenamed("v", "s").collect()]
    has = bool(europe) and quads.contains(df, (iri(X + "graph/region"), iri(europe[0]), iri(X + "name"), literal("EUROPE")))
    return spark.createDataFrame([(quads.insert_count(df, edges), quads.remove_count(df, edges), has)], "old long, removed long, has boolean")


@frame_query("graph_union", f"WITH {PLACES} SELECT DISTINCT 'all' AS which, s, p, o FROM q UNION ALL SELECT DISTINCT 'region', s, p, o FROM q WHERE g = '{X}graph/region'")
def _union(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = places(spark, sf_dir)
    region = iri(X + "graph/region")
    one = quads.graph(df, region).unionByName(quads.partial_union_graph(df, quads.graph_name(region))).dropDuplicates()
    flat = lambda d, w: d.select(F.lit(w).alias("which"), F.col("s.v").alias("s"), F.col("p.v").alias("p"), F.col("o.v").alias("o"))
    return flat(quads.union_graph(df), "all").unionByName(flat(one, "region"))


def _ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of nations and regions with a schema: in has domain nation, which is a kind of place, and range region; within is above in."""
    df = quads.matching(places(spark, sf_dir), p=quads.one(iri(X + "in"))).select("s", "p", "o")
    schema = [("in", RDFS + "domain", "nation"), ("in", RDFS + "range", "region"), ("nation", RDFS + "subClassOf", "place"), ("place", RDFS + "subClassOf", "thing"), ("in", RDFS + "subPropertyOf", "within")]
    fixed = spark.createDataFrame([(iri(X + s).row(), iri(p).row(), iri(X + o).row()) for s, p, o in schema], df.schema)
    return df.unionByName(fixed)


@frame_query("rdfs_types", f"""SELECT '{X}nation/' || n_nationkey AS s, '{X}' || unnest(['nation', 'place', 'thing']) AS t FROM nation UNION ALL SELECT DISTINCT '{X}region/' || n_regionkey, '{X}region' FROM nation""")
def _types(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = reasoning.saturate(_ontology(spark, sf_dir), "rdfs", resources=False)
    mine = closed.where((F.col("p.v") == RDF + "type") & F.col("o.v").startswith(X) & F.col("s.v").rlike("/[0-9]"))
    return mine.select(F.col("s.v").alias("s"), F.col("o.v").alias("t"))


@frame_query("rdfs_properties", f"SELECT '{X}nation/' || n_nationkey AS s, '{X}' || unnest(['in', 'within']) AS p, '{X}region/' || n_regionkey AS o FROM nation")
def _properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = reasoning.saturate(_ontology(spark, sf_dir), "rdfs", resources=False)
    return closed.where(F.col("p.v").isin(X + "in", X + "within") & F.col("s.v").rlike("/[0-9]")).select(F.col("s.v").alias("s"), F.col("p.v").alias("p"), F.col("o.v").alias("o"))


@frame_query("rdfs_subclasses", f"SELECT * FROM (VALUES ('{X}nation', '{X}place'), ('{X}nation', '{X}thing'), ('{X}place', '{X}thing')) v(c, above)")
def _subclasses(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = reasoning.saturate(_ontology(spark, sf_dir), "rdfs", resources=False)
    mine = closed.where((F.col("p.v") == RDFS + "subClassOf") & F.col("s.v").startswith(X) & F.col("o.v").startswith(X) & (F.col("s.v") != F.col("o.v")))
    return mine.select(F.col("s.v").alias("c"), F.col("o.v").alias("above"))


@frame_query("rdf_property_typing", f"SELECT '{X}in' AS p FROM nation LIMIT 1")
def _property(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = reasoning.saturate(quads.matching(places(spark, sf_dir), p=quads.one(iri(X + "in"))).select("s", "p", "o"), "rdf", resources=False)
    return closed.where((F.col("o.v") == RDF + "Property") & F.col("s.v").startswith(X)).select(F.col("s.v").alias("p"))


def _blank_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as blank nodes with a name and a region: quads of the default graph."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    s = term(BNODE, F.concat(F.lit("n"), F.col("n_nationkey").cast("string")))
    rows = [nation.select(F.lit(None).alias("g"), s.alias("s"), iri(X + p).column().alias("p"), o.alias("o")) for p, o in (("name", term(LITERAL, F.col("n_name"), PLAIN)), ("in", _iri(X, "region/", F.col("n_regionkey"))))]
    return quads.to_quads(rows[0].unionByName(rows[1]).select("s", "p", "o"))


HASHES = f"""
h AS (SELECT n_nationkey, sha256('_:a <{X}in> <{X}region/' || n_regionkey || '> .' || chr(10) || '_:a <{X}name> "' || n_name || '" .' || chr(10)) AS hash FROM nation)"""


@frame_query("c14n_first_hashes", f"WITH {HASHES} SELECT 'n' || n_nationkey AS node, hash FROM h")
def _hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c14n.first_degree_hashes(_blank_nations(spark, sf_dir))


@frame_query("c14n_labels", f"WITH {HASHES} SELECT '_:c14n' || (row_number() OVER (ORDER BY hash) - 1) AS s, n_name AS name FROM h JOIN nation USING (n_nationkey)")
def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = c14n.relabeled(_blank_nations(spark, sf_dir)).where(F.col("p.v") == X + "name")
    return df.select(F.concat(F.lit("_:"), F.col("s.v")).alias("s"), F.col("o.v").alias("name"))


@frame_query("c14n_isomorphic", "SELECT true AS same, false AS other FROM nation LIMIT 1")
def _isomorphic(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _blank_nations(spark, sf_dir)
    swap = F.struct(F.col("s.k").alias("k"), F.concat(F.lit("z"), F.reverse("s.v")).alias("v"), F.col("s.d").alias("d"), F.col("s.l").alias("l"), F.col("s.r").alias("r"))
    renamed = df.withColumn("s", swap)
    return spark.createDataFrame([(c14n.isomorphic(df, renamed), c14n.isomorphic(df, renamed.where(F.col("p.v") != X + "in")))], "same boolean, other boolean")


@frame_query("list_items_of_orders", f"""SELECT '{X}order/' || l_orderkey AS head, string_agg(l_partkey::VARCHAR, ' ' ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) AS items
    FROM lineitem GROUP BY l_orderkey""")
def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    rows = rows.withColumn("_k", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("l_orderkey")))
    cell = lambda k: _iri(X, "order/", F.concat(F.col("l_orderkey").cast("string"), F.when(k == 1, "").otherwise(F.concat(F.lit("#"), k.cast("string")))))
    rest = F.when(F.col("_k") < F.col("_n"), cell(F.col("_k") + 1)).otherwise(iri(RDF + "nil").column())
    item = term(LITERAL, F.col("l_partkey").cast("string"), XSD + "integer")
    cells = [rows.select(cell(F.col("_k")).alias("s"), iri(RDF + p).column().alias("p"), o.alias("o")) for p, o in (("first", item), ("rest", rest))]
    found = list_items(cells[0].unionByName(cells[1]))
    return found.select(F.col("head.v").alias("head"), F.array_join(F.transform("items", lambda t: t["v"]), " ").alias("items"))


@frame_query("iri_relative", "SELECT page_id AS id, regexp_replace(url, '^(https?://[^/]*)/.*$', '\\1') || '/up?x#y' AS up FROM pages")
def _iris(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions.iris import resolve

    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("id"), resolve(F.col("url"), F.lit("/a/../up?x#y")).alias("up"))
