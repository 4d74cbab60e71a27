"""Queries over the driver's tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators.mapping import VirtualStore
from .plans.compiler import Engine

# A prefix for each table.
PREFIXES = {**{k: f"urn:x:{t}#" for k, t in {"r": "region", "n": "nation", "c": "customer", "s": "supplier", "p": "part", "o": "orders", "l": "lineitem", "e": "events", "d": "documents", "lb": "labels", "pg": "pages", "b": "benchmark", "cv": "conversations"}.items()}, "x": "urn:x:", "xsd": "http://www.w3.org/2001/XMLSchema#", "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#"}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _sparql(name: str, query: str, sql: str, casts: dict[str, str] | None = None, rows: int | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = Engine(VirtualStore(spark, sf_dir, rows=rows), PREFIXES).query(query).df
        return df.withColumns({c: df[c].cast(t) for c, t in (casts or {}).items()})

    QUERIES[name], ORACLES[name] = run, sql


_sparql("bgp_star", "SELECT ?f ?st (SUM(?q) AS ?sum_qty) (SUM(?p*(1-?d)) AS ?revenue) (COUNT(*) AS ?n) { ?l l:l_returnflag ?f ; l:l_linestatus ?st ; l:l_quantity ?q ; l:l_extendedprice ?p ; l:l_discount ?d ; l:l_shipdate ?day FILTER(?day <= '1998-09-02T00:00:00'^^xsd:dateTime) } GROUP BY ?f ?st",
        "SELECT l_returnflag AS f, l_linestatus AS st, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice*(1-l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
_star = QUERIES["bgp_star"]


def _rounded(run: Callable, *columns: str, digits: int = 2) -> Callable:
    from pyspark.sql import functions as F

    return lambda spark, d: (lambda df: df.withColumns({c: F.round(c, digits) for c in columns}))(run(spark, d))


QUERIES["bgp_star"] = _rounded(_star, "revenue")
_sparql("bgp_fk_chain", "SELECT ?region (COUNT(?c) AS ?customers) { ?c c:c_nationkey ?n . ?n n:n_regionkey ?r . ?r r:r_name ?region } GROUP BY ?region",
        "SELECT r_name AS region, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
_sparql("bgp_five_way", "SELECT ?nation (SUM(?p*(1-?d)) AS ?revenue) { ?l l:l_orderkey ?o ; l:l_suppkey ?s ; l:l_extendedprice ?p ; l:l_discount ?d . ?o o:o_custkey ?c . ?c c:c_nationkey ?n . ?s s:s_nationkey ?n . ?n n:n_name ?nation } GROUP BY ?nation",
        "SELECT n_name AS nation, round(sum(l_extendedprice*(1-l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
QUERIES["bgp_five_way"] = _rounded(QUERIES["bgp_five_way"], "revenue")
_sparql("bgp_constant_object", "SELECT ?c ?name { ?c c:c_mktsegment 'BUILDING' ; c:c_nationkey <urn:x:nation/3> ; c:c_name ?name }",
        "SELECT 'urn:x:customer/' || c_custkey AS c, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
_sparql("bgp_variable_predicate", "SELECT ?p (COUNT(*) AS ?n) { <urn:x:nation/3> ?p ?o } GROUP BY ?p",
        "SELECT unnest(['http://www.w3.org/1999/02/22-rdf-syntax-ns#type','urn:x:nation#n_nationkey','urn:x:nation#n_name','urn:x:nation#n_regionkey']) AS p, 1::BIGINT AS n")
_sparql("bgp_class", "SELECT ?s ?name { ?s a x:supplier ; s:s_name ?name ; s:s_acctbal ?b FILTER(?b < 0) }", "SELECT 'urn:x:supplier/' || s_suppkey AS s, s_name AS name FROM supplier WHERE s_acctbal < 0")
_sparql("join_values", "SELECT ?name ?tag { VALUES (?size ?tag) { (1 'one') (2 'two') (3 'three') } ?p p:p_size ?size ; p:p_name ?name }",
        "SELECT p_name AS name, tag FROM part JOIN (VALUES (1,'one'),(2,'two'),(3,'three')) v(size,tag) ON p_size = size")
_sparql("values_cross", "SELECT ?a ?b { VALUES ?a { 'x' 'y' } VALUES ?b { 1 2 3 } }", "SELECT a, b FROM (VALUES ('x'),('y')) u(a), (VALUES ('1'),('2'),('3')) v(b)")
_sparql("values_undef", "SELECT ?name ?seg { VALUES (?name ?seg) { (UNDEF 'BUILDING') ('Customer#000000001' UNDEF) } ?c c:c_name ?name ; c:c_mktsegment ?seg }",
        "SELECT c_name AS name, c_mktsegment AS seg FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT c_name, c_mktsegment FROM customer WHERE c_name = 'Customer#000000001'")
_sparql("optional", "SELECT ?name ?total { ?c c:c_name ?name OPTIONAL { ?o o:o_custkey ?c ; o:o_totalprice ?total } }",
        "SELECT c_name AS name, o_totalprice AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
_sparql("optional_condition", "SELECT ?name ?b ?total { ?c c:c_name ?name ; c:c_acctbal ?b OPTIONAL { ?o o:o_custkey ?c ; o:o_totalprice ?total FILTER(?total > ?b * 40) } }",
        "SELECT c_name AS name, c_acctbal AS b, o_totalprice AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 40")
_sparql("optional_chain", "SELECT ?name ?t ?q { ?c c:c_name ?name ; c:c_nationkey <urn:x:nation/5> OPTIONAL { ?o o:o_custkey ?c ; o:o_totalprice ?t OPTIONAL { ?l l:l_orderkey ?o ; l:l_quantity ?q FILTER(?q > 45) } } }",
        "SELECT c_name AS name, o_totalprice AS t, l_quantity AS q FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 45 WHERE c_nationkey = 5")
_sparql("filter_numeric", "SELECT ?o ?t { ?o o:o_totalprice ?t FILTER(?t > 300000 && ?t < 400000.5) }", "SELECT 'urn:x:orders/' || o_orderkey AS o, o_totalprice AS t FROM orders WHERE o_totalprice > 300000 AND o_totalprice < 400000.5")
_sparql("filter_logic", "SELECT ?k { ?p p:p_partkey ?k ; p:p_size ?z ; p:p_type ?t FILTER(!(?z > 25) || (?z = 50 && ?t != 'x') || 1/0 > 1) }", "SELECT p_partkey AS k FROM part WHERE p_size <= 25 OR p_size = 50")
_sparql("filter_in", "SELECT ?k ?z { ?p p:p_partkey ?k ; p:p_size ?z FILTER(?z IN (1, 5, 9.0) && ?z NOT IN (5)) }", "SELECT p_partkey AS k, p_size::BIGINT AS z FROM part WHERE p_size IN (1, 9)")
_sparql("if_coalesce", "SELECT ?k ?a ?b { ?p p:p_partkey ?k ; p:p_size ?z BIND(IF(?z > 25, 'big', 'small') AS ?a) BIND(COALESCE(10 / (?z - ?z), ?z * 2) AS ?b) }",
        "SELECT p_partkey AS k, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS a, (p_size * 2)::VARCHAR AS b FROM part")
_sparql("union_names", "SELECT ?name ?kind { { ?c c:c_name ?name ; c:c_nationkey <urn:x:nation/7> BIND('customer' AS ?kind) } UNION { ?s s:s_name ?name ; s:s_nationkey <urn:x:nation/7> BIND('supplier' AS ?kind) } }",
        "SELECT c_name AS name, 'customer' AS kind FROM customer WHERE c_nationkey = 7 UNION ALL SELECT s_name, 'supplier' FROM supplier WHERE s_nationkey = 7")
_sparql("union_headers", "SELECT ?a ?b { { ?r r:r_name ?a } UNION { ?n n:n_name ?b } }", "SELECT r_name AS a, NULL AS b FROM region UNION ALL SELECT NULL, n_name FROM nation")
_sparql("distinct_segments", "SELECT DISTINCT ?s ?n { ?c c:c_mktsegment ?s ; c:c_nationkey ?n }", "SELECT DISTINCT c_mktsegment AS s, 'urn:x:nation/' || c_nationkey AS n FROM customer")
_sparql("reduced", "SELECT REDUCED ?s { ?o o:o_orderstatus ?s }", "SELECT DISTINCT o_orderstatus AS s FROM orders")
_sparql("minus_orders", "SELECT ?name { ?c c:c_name ?name MINUS { ?o o:o_custkey ?c } }", "SELECT c_name AS name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
_sparql("minus_disjoint", "SELECT ?name { ?r r:r_name ?name MINUS { ?c c:c_name ?other } }", "SELECT r_name AS name FROM region")
_sparql("minus_maybe_unbound", "SELECT ?k ?w { ?c c:c_custkey ?k OPTIONAL { ?c c:c_acctbal ?w FILTER(?w > 5000) } MINUS { ?d c:c_custkey ?k OPTIONAL { ?d c:c_acctbal ?w FILTER(?w > 8000) } } }",
        "SELECT k, w FROM (SELECT c_custkey AS k, CASE WHEN c_acctbal > 5000 THEN c_acctbal END AS w, CASE WHEN c_acctbal > 8000 THEN c_acctbal END AS v FROM customer) WHERE NOT (w IS NULL OR v IS NULL OR w = v)")
_sparql("exists_orders", "SELECT ?name { ?c c:c_name ?name FILTER EXISTS { ?o o:o_custkey ?c ; o:o_totalprice ?t FILTER(?t > 350000) } }",
        "SELECT c_name AS name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 350000)")
_sparql("not_exists_correlated", "SELECT ?name { ?c c:c_name ?name ; c:c_acctbal ?b FILTER NOT EXISTS { ?o o:o_custkey ?c ; o:o_totalprice ?t FILTER(?t > ?b * 30) } }",
        "SELECT c_name AS name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 30)")
_sparql("exists_value", "SELECT ?k ?has { ?c c:c_custkey ?k BIND(EXISTS { ?o o:o_custkey ?c } AS ?has) }", "SELECT c_custkey AS k, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has FROM customer")
_sparql("bind_arithmetic", "SELECT ?k ?x ?y ?z { ?o o:o_orderkey ?k ; o:o_totalprice ?t BIND(?t * 2 + 1 AS ?x) BIND(-?t / 4 AS ?y) BIND(?k * ?k - 1 AS ?z) }",
        "SELECT o_orderkey AS k, o_totalprice * 2 + 1 AS x, -o_totalprice / 4 AS y, o_orderkey * o_orderkey - 1 AS z FROM orders")
_sparql("order_topk", "SELECT ?k ?t { ?o o:o_orderkey ?k ; o:o_totalprice ?t } ORDER BY DESC(?t) ?k LIMIT 10", "SELECT o_orderkey AS k, o_totalprice AS t FROM orders ORDER BY t DESC, k LIMIT 10")
_sparql("slice", "SELECT ?k { ?c c:c_custkey ?k } ORDER BY ?k OFFSET 20 LIMIT 15", "SELECT c_custkey AS k FROM customer ORDER BY k LIMIT 15 OFFSET 20")
_sparql("group_sum_avg", "SELECT ?s (SUM(?z) AS ?total) (AVG(?b) AS ?mean) (COUNT(DISTINCT ?n) AS ?nations) { ?c c:c_mktsegment ?s ; c:c_acctbal ?b ; c:c_custkey ?z ; c:c_nationkey ?n } GROUP BY ?s",
        "SELECT c_mktsegment AS s, sum(c_custkey)::BIGINT AS total, round(avg(c_acctbal), 6) AS mean, count(DISTINCT c_nationkey) AS nations FROM customer GROUP BY 1")
QUERIES["group_sum_avg"] = _rounded(QUERIES["group_sum_avg"], "mean", digits=6)
_sparql("group_min_max", "SELECT ?p (MIN(?t) AS ?low) (MAX(?t) AS ?high) (MIN(?d) AS ?first) (COUNT(*) AS ?n) { ?o o:o_orderpriority ?p ; o:o_totalprice ?t ; o:o_orderdate ?d } GROUP BY ?p",
        "SELECT o_orderpriority AS p, min(o_totalprice) AS low, max(o_totalprice) AS high, min(o_orderdate) AS first, count(*) AS n FROM orders GROUP BY 1")
_sparql("group_concat", "SELECT ?r (GROUP_CONCAT(DISTINCT ?name; SEPARATOR=', ') AS ?names) { ?n n:n_name ?name ; n:n_regionkey ?r } GROUP BY ?r",
        "SELECT 'urn:x:region/' || n_regionkey AS r, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
_sparql("group_having", "SELECT ?c (COUNT(?o) AS ?n) { ?o o:o_custkey ?c } GROUP BY ?c HAVING(COUNT(?o) > 15)", "SELECT 'urn:x:customer/' || o_custkey AS c, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15")
_sparql("group_expression", "SELECT ?y (COUNT(*) AS ?n) { ?o o:o_orderdate ?d } GROUP BY (YEAR(?d) AS ?y)", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1")
_sparql("group_empty", "SELECT (COUNT(*) AS ?n) (SUM(?b) AS ?s) { ?c c:c_acctbal ?b FILTER(?b > 1e12) }", "SELECT 0::BIGINT AS n, 0.0::DOUBLE AS s")
_sparql("group_mixed_types", "SELECT ?f (SUM(?v) AS ?s) (MAX(?v) AS ?m) { VALUES (?f ?v) { ('a' 1) ('a' 2.5) ('b' 3) ('b' 'x') ('c' 1e0) ('c' 2) } } GROUP BY ?f",
        "SELECT * FROM (VALUES ('a','3.5','2.5'),('b',NULL,'x'),('c','3.0e0','2')) t(f,s,m)")
_sparql("count_distinct_all", "SELECT (COUNT(DISTINCT *) AS ?n) { ?c c:c_mktsegment ?s ; c:c_nationkey ?k }", "SELECT count(*) AS n FROM customer")
_sparql("subselect", "SELECT ?name ?best { { SELECT ?c (MAX(?t) AS ?best) { ?o o:o_custkey ?c ; o:o_totalprice ?t } GROUP BY ?c } ?c c:c_name ?name FILTER(?best > 300000) }",
        "SELECT c_name AS name, best FROM (SELECT o_custkey, max(o_totalprice) AS best FROM orders GROUP BY 1) JOIN customer ON c_custkey = o_custkey WHERE best > 300000")
_sparql("graph_constant", "SELECT ?name { GRAPH <urn:x:graph/region> { ?r r:r_name ?name } }", "SELECT r_name AS name FROM region")
_sparql("graph_variable", "SELECT ?g (COUNT(*) AS ?n) { GRAPH ?g { ?s r:r_name|n:n_name ?name } } GROUP BY ?g", "SELECT 'urn:x:graph/region' AS g, count(*) AS n FROM region UNION ALL SELECT 'urn:x:graph/nation', count(*) FROM nation")
_sparql("from_graphs", "SELECT ?n ?name FROM <urn:x:graph/nation> { ?n n:n_name ?name OPTIONAL { ?r r:r_name ?name } }", "SELECT 'urn:x:nation/' || n_nationkey AS n, n_name AS name FROM nation")
_sparql("path_sequence", "SELECT ?c ?name { ?c c:c_nationkey/n:n_regionkey/r:r_name ?name }", "SELECT 'urn:x:customer/' || c_custkey AS c, r_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
_sparql("path_alternative", "SELECT ?name { <urn:x:nation/4> n:n_name|(n:n_regionkey/r:r_name) ?name }", "SELECT n_name AS name FROM nation WHERE n_nationkey = 4 UNION ALL SELECT r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = 4")
_sparql("path_inverse", "SELECT ?r (COUNT(*) AS ?n) { ?r ^n:n_regionkey/^s:s_nationkey ?s } GROUP BY ?r", "SELECT 'urn:x:region/' || n_regionkey AS r, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_regionkey")
_sparql("path_negated", "SELECT ?o { <urn:x:region/1> !(rdf:type|r:r_regionkey) ?o }", "SELECT r_name AS o FROM region WHERE r_regionkey = 1")
_sparql("path_plus", "SELECT ?c ?x { ?c (c:c_nationkey|n:n_regionkey)+ ?x . ?c c:c_mktsegment 'MACHINERY' }",
        "SELECT 'urn:x:customer/' || c_custkey AS c, unnest(['urn:x:nation/' || c_nationkey, 'urn:x:region/' || n_regionkey]) AS x FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'MACHINERY'")
_sparql("path_star", "SELECT ?x { <urn:x:supplier/1> (s:s_nationkey|n:n_regionkey)* ?x }", "SELECT unnest(['urn:x:supplier/1', 'urn:x:nation/' || s_nationkey, 'urn:x:region/' || n_regionkey]) AS x FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey = 1")
_sparql("path_optional", "SELECT ?x { <urn:x:nation/9> n:n_regionkey? ?x }", "SELECT unnest(['urn:x:nation/9', 'urn:x:region/' || n_regionkey]) AS x FROM nation WHERE n_nationkey = 9")
_sparql("fn_strings", "SELECT ?k ?u ?l ?n ?s ?b ?a ?c { ?p p:p_partkey ?k ; p:p_name ?name ; p:p_brand ?brand BIND(UCASE(?name) AS ?u) BIND(LCASE(?brand) AS ?l) BIND(STRLEN(?name) AS ?n) BIND(SUBSTR(?name, 2, 4) AS ?s) BIND(STRBEFORE(?brand, '#') AS ?b) BIND(STRAFTER(?brand, '#') AS ?a) BIND(CONCAT(?brand, '/', STR(?k)) AS ?c) }",
        "SELECT p_partkey AS k, upper(p_name) AS u, lower(p_brand) AS l, length(p_name) AS n, substr(p_name, 2, 4) AS s, CASE WHEN contains(p_brand, '#') THEN split_part(p_brand, '#', 1) ELSE '' END AS b, split_part(p_brand, '#', 2) AS a, p_brand || '/' || p_partkey AS c FROM part")
_sparql("fn_tests", "SELECT ?k { ?p p:p_partkey ?k ; p:p_name ?n ; p:p_type ?t FILTER((CONTAINS(?n, '1') || STRSTARTS(?t, 'S')) && !STRENDS(?n, '0')) }", "SELECT p_partkey AS k FROM part WHERE (contains(p_name, '1') OR starts_with(p_type, 'S')) AND NOT ends_with(p_name, '0')")
_sparql("fn_regex", "SELECT ?u { ?p pg:url ?u FILTER(REGEX(?u, '^HTTPS://[a-z.]+/(en|de)/', 'i')) }", "SELECT url AS u FROM pages WHERE regexp_matches(url, '^HTTPS://[a-z.]+/(en|de)/', 'i')")
_sparql("fn_replace", "SELECT ?i ?h { ?p pg:page_id ?i ; pg:url ?u BIND(REPLACE(?u, '^https?://([^/]+)/.*$', '$1') AS ?h) }", r"SELECT page_id AS i, regexp_replace(url, '^https?://([^/]+)/.*$', '\1') AS h FROM pages")
_sparql("fn_hash", "SELECT ?k ?a ?b { ?c c:c_custkey ?k ; c:c_name ?n BIND(MD5(?n) AS ?a) BIND(SHA256(?n) AS ?b) }", "SELECT c_custkey AS k, md5(c_name) AS a, sha256(c_name) AS b FROM customer")
_sparql("fn_date", "SELECT ?k ?y ?m ?d ?h ?mi ?s { ?e e:event_id ?k ; e:ts ?t BIND(YEAR(?t) AS ?y) BIND(MONTH(?t) AS ?m) BIND(DAY(?t) AS ?d) BIND(HOURS(?t) AS ?h) BIND(MINUTES(?t) AS ?mi) BIND(SECONDS(?t) AS ?s) }",
        "SELECT event_id AS k, year(ts) AS y, month(ts) AS m, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, (microsecond(ts) / 1000000.0)::DOUBLE AS s FROM events")
_sparql("fn_cast", "SELECT ?k ?i ?d ?s ?b { ?c c:c_custkey ?k ; c:c_acctbal ?a BIND(xsd:integer(?a) AS ?i) BIND(xsd:double(?k) AS ?d) BIND(xsd:string(?k) AS ?s) BIND(xsd:boolean(?k - 1) AS ?b) }",
        "SELECT c_custkey AS k, trunc(c_acctbal)::BIGINT AS i, c_custkey::DOUBLE AS d, c_custkey::VARCHAR AS s, c_custkey <> 1 AS b FROM customer")
_sparql("fn_rounding", "SELECT ?k ?a ?c ?f ?r { ?s s:s_suppkey ?k ; s:s_acctbal ?b BIND(ABS(?b) AS ?a) BIND(CEIL(?b) AS ?c) BIND(FLOOR(?b) AS ?f) BIND(ROUND(?b) AS ?r) }",
        "SELECT s_suppkey AS k, abs(s_acctbal) AS a, ceil(s_acctbal) AS c, floor(s_acctbal) AS f, round(s_acctbal) AS r FROM supplier")
_sparql("fn_encode", "SELECT ?i ?e { ?p pg:page_id ?i ; pg:url ?u BIND(ENCODE_FOR_URI(?u) AS ?e) }", "SELECT page_id AS i, url_encode(url) AS e FROM pages")
_sparql("fn_lang", "SELECT ?l (COUNT(*) AS ?n) { ?d d:text ?t FILTER(LANGMATCHES(LANG(?t), '*') && hasLANG(?t)) } GROUP BY (LANG(?t) AS ?l)", "SELECT lang AS l, count(*) AS n FROM documents GROUP BY 1")
_sparql("fn_langmatches", "SELECT ?i { ?d d:doc_id ?i ; d:text ?t FILTER(LANGMATCHES(LANG(?t), 'FR') || LANG(?t) = 'es') }", "SELECT doc_id AS i FROM documents WHERE lang IN ('fr', 'es')")
_sparql("fn_datatype", "SELECT ?dt (COUNT(*) AS ?n) { <urn:x:orders/7> ?p ?o FILTER(isLITERAL(?o)) } GROUP BY (DATATYPE(?o) AS ?dt)",
        "SELECT 'http://www.w3.org/2001/XMLSchema#' || unnest(['integer','string','double','dateTime']) AS dt, unnest([1,2,1,1])::BIGINT AS n FROM orders WHERE o_orderkey = 7")
_sparql("fn_kinds", "SELECT ?k (COUNT(*) AS ?n) { <urn:x:orders/7> ?p ?o BIND(IF(isIRI(?o), 'iri', IF(isNUMERIC(?o), 'number', 'other')) AS ?k) } GROUP BY ?k",
        "SELECT unnest(['iri','number','other']) AS k, unnest([2,2,3])::BIGINT AS n FROM orders WHERE o_orderkey = 7")


_sparql("minus_rows_left", "SELECT ?name { ?n n:n_name ?name ; n:n_regionkey ?r MINUS { ?r r:r_name 'ASIA' } }", "SELECT n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'")
_sparql("minus_large_orders", "SELECT ?k { ?c c:c_custkey ?k MINUS { ?o o:o_custkey ?c ; o:o_totalprice ?t FILTER(?t > 350000) } }", "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 350000)")
_sparql("fn_sha", "SELECT ?k ?a ?b { ?c c:c_custkey ?k ; c:c_name ?n BIND(SHA1(?n) AS ?a) BIND(STRLEN(SHA512(?n)) AS ?b) }", "SELECT c_custkey AS k, sha1(c_name) AS a, 128 AS b FROM customer")
_sparql("fn_sample", "SELECT ?r (SAMPLE(?k) >= 0 AS ?ok) { ?n n:n_regionkey ?r ; n:n_nationkey ?k } GROUP BY ?r", "SELECT 'urn:x:region/' || n_regionkey AS r, true AS ok FROM nation GROUP BY n_regionkey")


def frame_query(name: str, sql: str) -> Callable:
    def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name], ORACLES[name] = run, sql
        return run

    return register


@frame_query("ask_row", "SELECT EXISTS (SELECT 1 FROM region WHERE r_name = 'EUROPE') AS yes, EXISTS (SELECT 1 FROM region WHERE r_name = 'ATLANTIS') AS no")
def _ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(VirtualStore(spark, sf_dir), PREFIXES)
    return spark.createDataFrame([(e.query("ASK { ?r r:r_name 'EUROPE' }"), e.query("ASK { ?r r:r_name 'ATLANTIS' }"))], "yes boolean, no boolean")


@frame_query("construct_edges", "SELECT 'urn:x:nation/' || n_nationkey AS s, 'urn:x:in' AS p, r_name AS o FROM nation JOIN region ON n_regionkey = r_regionkey")
def _construct(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Engine(VirtualStore(spark, sf_dir), PREFIXES).query("CONSTRUCT { ?n x:in ?name } WHERE { ?n n:n_regionkey/r:r_name ?name }")
    return t.selectExpr("s.v AS s", "p.v AS p", "o.v AS o")


@frame_query("describe_region", "SELECT 'urn:x:region/2' AS s, 'urn:x:region#r_name' AS p, r_name AS o FROM region WHERE r_regionkey = 2 UNION ALL SELECT 'urn:x:region/2', 'urn:x:region#r_regionkey', '2' UNION ALL SELECT 'urn:x:region/2', 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'urn:x:region' UNION ALL SELECT 'urn:x:nation/' || n_nationkey, 'urn:x:nation#n_regionkey', 'urn:x:region/2' FROM nation WHERE n_regionkey = 2")
def _describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(VirtualStore(spark, sf_dir), PREFIXES).query("DESCRIBE <urn:x:region/2>").selectExpr("s.v AS s", "p.v AS p", "o.v AS o")


from . import graph_queries, table_queries  # noqa: E402, F401  register their queries here
