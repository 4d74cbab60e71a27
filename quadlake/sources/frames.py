"""JSON-LD and RDF/XML files of frames of any number of triples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.resource import list_members, near_lists
from ..storage import distinct_runs, materialize
from ..terms import BNODE, IRI, LITERAL, RDF, TERM_DDL, XSD, iri, term

#: Triples of a subject that go into one node; a subject with more is written in several.
NODE = 1000
#: Quads that one task writes, so that what is small comes into one file.
SMALL = 50_000
#: Characters of a file, but for a longer line: these formats are read a file at a time.
FILE = 4 << 20
#: Splits a predicate into a namespace and a name that XML allows.
LOCAL_NAME = r"^(?s)(.*?)([A-Za-z_][\w.\-]*)$"
#: Characters that XML has no way to write.
NOT_XML = r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]"


def _name(t: Column) -> Column:
    return F.when(t["k"] == BNODE, F.concat(F.lit("_:"), t["v"])).otherwise(t["v"])


def _quoted(c: Column) -> Column:
    """A string in JSON."""
    text = F.to_json(F.array(c))
    # few texts have anything to escape
    return F.when(c.rlike(r'[\x00-\x1f\x7f"\\]'), F.substr(text, F.lit(2), F.length(text) - 2)).otherwise(F.concat(F.lit('"'), c, F.lit('"')))


def _parted(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with `_c`: subjects of more than NODE triples are dealt into parts of about so many."""
    on = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}{k}").eqNullSafe(F.col(f"{b}{k}")) for k in keys])
    many = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > NODE).select(*[F.col(k).alias(f"x_{k}") for k in keys], "_n")
    out = df.join(many, on("", "x_"), "left").drop(*[f"x_{k}" for k in keys])
    return out.withColumn("_c", F.when(F.col("_n").isNull(), 0).otherwise(F.pmod(F.xxhash64("p", "o"), F.ceil(F.col("_n") / NODE).cast("long"))).cast("int")).drop("_n")


def _gathered(df: DataFrame, keys: list[str]) -> tuple[DataFrame, bool]:
    """df without duplicate rows, with the rows of a subject together: first as they came, then others dealt out by subjects; and whether it is small."""
    df = materialize(df, "quads")
    whole, other = distinct_runs(df, keys, NODE)
    if other is not None:
        whole = whole.unionByName(materialize(_parted(materialize(other, "quads"), keys).repartition(*keys, "_c").sortWithinPartitions(*[F.xxhash64(k) for k in keys], "_c").drop("_c"), "quads"))
    return whole, df.count() <= SMALL


def _files(rows: DataFrame, path: str, head: str, between: str, foot: str, node, mode: str, compression: str | None) -> None:
    """Text files of about FILE characters at most, each with a first and a last line. A file is one record, so that what reads it whole holds a bounded text, whatever the partitions.

    Rows have the text of their subject (two columns), a name and a text each; those of a subject that stand together, NODE at most, are one line, `node(subject, names, texts)`.
    """

    def lines(batches):
        now, names, texts = None, [], []
        for b in batches:
            for *subject, name, text in zip(*[c.to_pylist() for c in b.columns]):
                if subject != now or len(texts) == NODE:
                    if texts:
                        yield node(now, names, texts)
                    now, names, texts = subject, [], []
                names.append(name)
                texts.append(text)
        if texts:
            yield node(now, names, texts)

    def wrap(batches):
        import pyarrow as pa

        document = lambda some: pa.RecordBatch.from_pydict({"value": ["\n".join([head, some[0], *(between + x for x in some[1:]), foot])]})
        some, size = [], 0
        for line in lines(batches):
            if some and size + len(line) > FILE:
                yield document(some)
                some, size = [], 0
            some.append(line)
            size += len(line)
        if some:
            yield document(some)

    out = rows.mapInArrow(wrap, "value string").write.mode(mode).option("maxRecordsPerFile", 1)
    (out.option("compression", compression).option("zlib.compress.level", "BEST_SPEED") if compression else out).text(path)


def _far_folded(quads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lists that nothing else needs to know the cells of: head (with its graph in the label) and items; and the cells.

    Such a list hangs on one triple, not on another list's cell; its cells are blank nodes with an item and a rest alone, named in one graph only.
    """
    blank = lambda c: F.col(f"{c}.k") == BNODE
    scoped = lambda c: F.when(blank(c), term(BNODE, F.concat(F.coalesce(F.to_json("g"), F.lit("")), F.lit("\n"), F.col(f"{c}.v")))).otherwise(F.col(c))
    inner = materialize(quads.select("g", scoped("s").alias("s"), "p", scoped("o").alias("o")), "scoped")
    members = materialize(list_members(inner), "members")
    places = [inner.where(blank("s")).select(F.col("s").alias("cell"), F.lit(1).alias("out"), F.lit(0).alias("used"), F.lit(0).alias("held"))]
    held = F.when(F.col("p.v").isin(RDF + "first", RDF + "rest"), 1).otherwise(0)
    places.append(inner.where(blank("o")).select(F.col("o").alias("cell"), F.lit(0).alias("out"), F.lit(1).alias("used"), held.alias("held")))
    counts = places[0].unionByName(places[1]).groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("out", "used", "held")])
    names = inner.select(F.explode(F.array("s", "o")).alias("t")).where(F.col("t.k") == BNODE).select("t.v", F.substring_index("t.v", "\n", -1).alias("label"))
    graphs = quads.where(F.col("g.k") == BNODE).select(F.col("g.v").alias("v"), F.col("g.v").alias("label"))
    several = names.unionByName(graphs).distinct().groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("label")
    cells = members.join(counts, "cell", "left").withColumn("label", F.substring_index("cell.v", "\n", -1)).join(several.withColumn("_more", F.lit(True)), "label", "left")
    good = (F.col("cell.k") == BNODE) & (F.col("out") == 2) & (F.col("used") == 1) & (F.col("held") == F.when(F.col("position") == 0, 0).otherwise(1)) & F.col("_more").isNull()
    lists = cells.groupBy("head").agg(F.min(F.coalesce(good, F.lit(False))).alias("good"), F.sort_array(F.collect_list(F.struct("position", "item"))).alias("items")).where("good")
    lists = materialize(lists.select("head", F.transform("items", lambda x: x["item"]).alias("items")), "lists")
    return lists, members.join(lists.select("head"), "head", "left_semi").select("cell")


def _folded(quads: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """Lists as _far_folded takes them (head, with its graph in the label, as text, and items), if there are any, and the quads of no such list. Lists whose cells stand together are found as they stand."""
    blank = lambda c: F.col(f"{c}.k") == BNODE
    scoped = lambda c: F.concat(F.coalesce(F.to_json("g"), F.lit("")), F.lit("\n"), c)
    of_cell = blank("s") & F.col("p.v").isin(RDF + "first", RDF + "rest")
    cells, others = quads.where(of_cell), quads.where(~of_cell)
    if cells.isEmpty():
        return None, quads
    near, rest = near_lists(cells, others)
    found = near.select(scoped(F.col("head")).alias("_h"), "items")
    if not rest.isEmpty():
        rest = materialize(rest.select("g", "s", "p", "o"), "rest")
        # what else may use a cell: quads with blank nodes, and the items of lists
        held = near.select("g", iri(RDF + "List").column().alias("s"), iri(RDF + "first").column().alias("p"), F.explode("items").alias("o"))
        lists, gone = _far_folded(rest.unionByName(others.where(F.coalesce(blank("g"), F.lit(False)) | blank("s") | blank("o"))).unionByName(held.where(blank("o"))))
        found = found.unionByName(lists.select(F.col("head.v").alias("_h"), "items"))
        others = others.unionByName(rest.join(gone.select(F.col("cell.v").alias("_v")), scoped(F.col("s.v")) == F.col("_v"), "left_anti"))
    return found, others


def write_jsonld(quads: DataFrame, path: str, lists: bool = True, mode: str = "error", compression: str | None = None) -> None:
    """Expanded JSON-LD files of quads, or triples: each file is an array with a node object a line; nodes of named graphs stand in a node of their graph.

    Nodes are made by subject, in the tasks that write them; a subject of many triples, or one with blank objects where there are lists, has several node objects, which mean the same.
    With `lists`, well-formed lists that hang on one triple become @list; such a list comes into one line. Blank node labels are kept: all files are one document.
    Triple terms, and predicates that are no IRIs, have no JSON-LD and are left out. `compression`: a codec of Spark's text files, which read_jsonld knows by the files' names.
    """
    none = F.lit(None).cast(TERM_DDL)
    df = quads.select("g" if "g" in quads.columns else none.alias("g"), "s", "p", "o").where(F.col("s.k").isin(IRI, BNODE) & (F.col("p.k") == IRI) & F.col("o.k").isin(IRI, BNODE, LITERAL))
    df, small = _gathered(df, ["g", "s"])
    no_items = F.lit(None).cast(f"array<{TERM_DDL}>")
    found, df = _folded(df) if lists else (None, df)
    if found is not None:
        blank = F.col("o.k") == BNODE
        head = F.concat(F.coalesce(F.to_json("g"), F.lit("")), F.lit("\n"), F.col("o.v"))
        of_list = df.where(blank).join(found, head == F.col("_h"), "left").select("g", "s", "p", "o", "items")
        df = df.where(~blank).withColumn("items", no_items).unionByName(of_list)
    else:
        df = df.withColumn("items", no_items)
    if lists:
        nil = (F.col("o.k") == IRI) & (F.col("o.v") == RDF + "nil") & ~F.col("p.v").isin(RDF + "first", RDF + "rest")
        df = df.withColumn("items", F.when(nil, F.array().cast(f"array<{TERM_DDL}>")).otherwise(F.col("items")))

    def value(t: Column) -> Column:
        # items may have got their graph into their labels
        name = F.when(t["k"] == BNODE, F.concat(F.lit("_:"), F.substring_index(t["v"], "\n", -1))).otherwise(t["v"])
        member = lambda key, c: F.coalesce(F.concat(F.lit(f',"{key}":'), _quoted(c)), F.lit(""))
        kind = F.when((t["d"] != XSD + "string") & t["l"].isNull(), t["d"])
        literal = F.concat(F.lit('{"@value":'), _quoted(t["v"]), member("@type", kind), member("@language", t["l"]), member("@direction", t["r"]), F.lit("}"))
        return F.when(t["k"] == LITERAL, literal).otherwise(F.concat(F.lit('{"@id":'), _quoted(name), F.lit("}")))

    is_type = (F.col("p.v") == RDF + "type") & (F.col("o.k") != LITERAL) & F.col("items").isNull()
    listed = F.concat(F.lit('{"@list":['), F.array_join(F.transform("items", value), ","), F.lit("]}"))
    text = F.when(is_type, _quoted(_name(F.col("o")))).when(F.col("items").isNotNull(), listed).otherwise(value(F.col("o")))
    rows = df.select(_quoted(_name(F.col("g"))).alias("g"), _quoted(_name(F.col("s"))).alias("s"), F.when(is_type, '"@type"').otherwise(_quoted(F.col("p.v"))).alias("p"), text.alias("o"))

    def node(subject, names, texts) -> str:
        graph, name = subject
        members: dict[str, list] = {}
        for p, x in zip(names, texts):
            members.setdefault(p, []).append(x)
        made = ",".join([f'{{"@id":{name}', *(f"{p}:[{','.join(some)}]" for p, some in members.items())]) + "}"
        return made if graph is None else f'{{"@id":{graph},"@graph":[{made}]}}'

    _files(rows.coalesce(1) if small else rows, path, "[", ",", "]", node, mode, compression)


def write_rdfxml(triples: DataFrame, path: str, prefixes: dict[str, str] | None = None, strict: bool = True, mode: str = "error", compression: str | None = None) -> None:
    """RDF/XML files of triples of any number, an element with a subject's properties a line; a subject of many triples has several.

    The predicates' namespaces, as many as a vocabulary has, are gathered first and declared in each file; `prefixes` names some, name to namespace or the other way round. Blank node labels are kept: all files
    are one document. What RDF/XML can't hold (triple terms, predicates without a local name, control characters) is an error, or left out if not strict. `compression`: as in write_jsonld.
    """
    space, local = F.regexp_extract("p.v", LOCAL_NAME, 1), F.regexp_extract("p.v", LOCAL_NAME, 2)
    fits = F.col("s.k").isin(IRI, BNODE) & (F.col("p.k") == IRI) & (local != "") & F.col("o.k").isin(IRI, BNODE, LITERAL) & ~F.col("o.v").rlike(NOT_XML)
    if strict:
        fits = F.when(fits, True).otherwise(F.raise_error(F.concat(F.lit("RDF/XML can't hold "), F.to_json(F.struct("s", "p", "o")))).cast("boolean"))
    df, small = _gathered(triples.select("s", "p", "o").where(fits), ["s"])
    df = df.select("s", "p", "o", space.alias("_space"), local.alias("_local"))
    spaces = {RDF: "rdf", **dict((k, v) if ":" in k else (v, k) for k, v in (prefixes or {}).items())}
    for i, r in enumerate(df.select("_space").distinct().orderBy("_space").collect()):
        spaces.setdefault(r[0], f"n{i}")

    def escaped(c: Column, attribute: bool = False) -> Column:
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;"), *((('"', "&quot;"), ("\n", "&#10;"), ("\t", "&#9;")) if attribute else ())):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    attribute = lambda name, c: F.concat(F.lit(f' {name}="'), escaped(c, True), F.lit('"'))
    prefix = F.create_map(*[F.lit(x) for kv in spaces.items() for x in kv])
    name = F.concat(F.try_element_at(prefix, F.col("_space")), F.lit(":"), F.col("_local"))
    o = F.col("o")
    direction = F.coalesce(F.concat(F.lit(' its:version="2.0"'), attribute("its:dir", o["r"])), F.lit(""))
    kind = F.when(o["l"].isNotNull(), F.concat(attribute("xml:lang", o["l"]), direction)).when(o["d"] == XSD + "string", "").otherwise(attribute("rdf:datatype", o["d"]))
    to = F.when(o["k"] == IRI, attribute("rdf:resource", o["v"])).otherwise(attribute("rdf:nodeID", o["v"]))
    element = F.when(o["k"] == LITERAL, F.concat(F.lit("<"), name, kind, F.lit(">"), escaped(o["v"]), F.lit("</"), name, F.lit(">"))).otherwise(F.concat(F.lit("<"), name, to, F.lit("/>")))
    about = F.when(F.col("s.k") == IRI, attribute("rdf:about", F.col("s.v"))).otherwise(attribute("rdf:nodeID", F.col("s.v")))
    rows = df.select(about.alias("s"), F.lit("").alias("e"), F.lit("").alias("p"), element.alias("o"))
    from xml.sax.saxutils import quoteattr

    names = "".join(f" xmlns:{v}={quoteattr(k)}" for k, v in spaces.items()) + ' xmlns:its="http://www.w3.org/2005/11/its"'
    node = lambda subject, _, texts: f"<rdf:Description{subject[0]}>{''.join(texts)}</rdf:Description>"
    _files(rows.coalesce(1) if small else rows, path, f'<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF{names}>', "", "</rdf:RDF>", node, mode, compression)
