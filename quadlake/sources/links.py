"""Links followed from document to document for a whole frame: a frontier of documents read in parallel, round by round."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize, new_path
from ..terms import BNODE, IRI, TERM_DDL, TRIPLE, Term, bnode, triple_term
from .jsonld import parse_jsonld
from .nquads import parse_nquads
from .rdfxml import parse_rdfxml
from .turtle import parse_trig, parse_turtle


def _scoped(t: Term | None, scope: str) -> Term | None:
    if t is not None and t.kind == BNODE:
        return bnode(t.value + scope)
    return triple_term(*(_scoped(x, scope) for x in t.parts)) if t is not None and t.kind == TRIPLE else t


def _lines(text: str, base: str, scope: str) -> list[tuple]:
    quads = parse_nquads(text)
    # texts without either have no blank nodes
    return [tuple(_scoped(t, scope) for t in q) for q in quads] if "_:" in text or "<<" in text else quads


#: Text and format of the document of an IRI; raises where there is none. Called in tasks.
Fetch = Callable[[str], tuple[str, str]]

#: (text, IRI, suffix of blank nodes) to quads of terms, by format.
PARSERS: dict[str, Callable[[str, str, str], list[tuple]]] = {
    "nt": _lines,
    "nq": _lines,
    "ttl": lambda text, base, scope: parse_turtle(text, base, bnode_scope=scope),
    "trig": lambda text, base, scope: parse_trig(text, base, bnode_scope=scope),
    "jsonld": lambda text, base, scope: parse_jsonld(text, base, bnode_scope=scope),
    "rdf": lambda text, base, scope: parse_rdfxml(text, base, scope),
}
_ROWS = f"document string, s {TERM_DDL}, p {TERM_DDL}, o {TERM_DDL}, problem string"


class Folders:
    """A Fetch that takes IRIs below a prefix as files below a folder that all executors see, with or without an extension."""

    def __init__(self, folders: dict[str, str]):
        self.folders = folders

    def __call__(self, iri: str) -> tuple[str, str]:
        for prefix, folder in self.folders.items():
            root = os.path.abspath(folder)
            path = os.path.abspath(os.path.join(root, iri.removeprefix(prefix).lstrip("/")))
            if iri.startswith(prefix) and os.path.commonpath([root, path]) == root:
                for name in (path, *(f"{path}.{x}" for x in PARSERS)):
                    extension = name.rsplit(".", 1)[-1]
                    if extension in PARSERS and os.path.isfile(name):
                        with open(name, encoding="utf-8") as f:
                            return f.read(), extension
        raise FileNotFoundError(iri)


@dataclass
class Followed:
    """What following found.

    `documents`: document, round (from 1) in which it was read, triples (their number), problem (why it couldn't be read, else null).
    `triples`: document (null for the triples given), s, p, o.
    """

    documents: DataFrame
    triples: DataFrame


def document_of(t: Column) -> Column:
    """The document that speaks of a resource: its IRI without the fragment; null for other terms."""
    return F.when(t["k"] == IRI, F.substring_index(t["v"], "#", 1))


def _texts(wanted: DataFrame, source: DataFrame | Fetch) -> DataFrame:
    """document, text, format, problem for each wanted document."""
    if isinstance(source, DataFrame):
        held = source.groupBy("document").agg(F.min(F.struct("format", "text")).alias("x"))
        found = wanted.join(held, "document", "left")
        return found.select("document", F.col("x.text").alias("text"), F.col("x.format").alias("format"), F.when(F.col("x").isNull(), F.concat(F.lit("not found: "), "document")).alias("problem"))

    def run(batches: Iterator):
        import pandas as pd

        for b in batches:
            for d in b["document"]:
                try:
                    row = (d, *source(d), None)
                except Exception as e:  # an answer of its own, kept as a row
                    row = (d, None, None, f"not found: {e}")
                yield pd.DataFrame([row], columns=["document", "text", "format", "problem"])

    return wanted.mapInPandas(run, "document string, text string, format string, problem string")


def _parsed(texts: DataFrame, call: str) -> DataFrame:
    """Triples of the default graphs of documents, and for each document one row without a triple, which holds its problem, if any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            rows: list[tuple] = []
            for d, text, form, problem in zip(*(b.column(c).to_pylist() for c in ("document", "text", "format", "problem"))):
                quads: list[tuple] = []
                if problem is None:
                    scope = f"f{hashlib.sha256(f'{d} {call}'.encode()).hexdigest()[:24]}"
                    try:
                        quads = PARSERS[form](text, d, scope)
                    except KeyError:
                        problem = f"unknown format: {form}"
                    except Exception as e:
                        problem = f"not read: {e}"
                for q in dict.fromkeys(quads):
                    if q[0] is None:
                        rows.append((d, *q[1:], None))
                    if len(rows) >= 10_000:
                        yield _batch(rows)
                        rows = []
                rows.append((d, None, None, None, problem))
            if rows:
                yield _batch(rows)

    return texts.mapInArrow(run, _ROWS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of document, three terms and problem, made field by field: a mapping for each term takes longer than to parse it."""
    document, *places, problem = zip(*rows)
    none = Term(BNODE, "")

    def column(terms: tuple) -> pa.StructArray:
        there = [none if t is None else t for t in terms]
        fields = [pa.array([t.kind for t in there], pa.int8()), *(pa.array([getattr(t, x) for t in there], pa.string()) for x in ("value", "datatype", "lang", "direction"))]
        return pa.StructArray.from_arrays(fields, list("kvdlr"), mask=pa.array([t is None for t in terms]))

    return pa.RecordBatch.from_arrays([pa.array(document, pa.string()), *map(column, places), pa.array(problem, pa.string())], ["document", "s", "p", "o", "problem"])


def follow_links(graph: DataFrame, predicates: Sequence[str | Term], source: DataFrame | Fetch, rounds: int | None = None, parts: int | None = None) -> Followed:
    """The documents that a graph (s, p, o) leads to by these predicates, those that their triples lead to, and so on.

    `source` is a table of documents (document, text, format), of which each round reads the wanted ones by a join, or a Fetch, called in `parts`
    tasks. Each document is read once, however many lead to it; one that can't be read is a row with its problem, and the walk goes on. All
    documents are read at most `rounds` links away, or as far as links go. Of a document only the default graph counts; blank nodes get names of
    their own. Rounds are written, so that no plan grows with their number and a repeated task gives the same rows. A link's fragment names a
    resource within a document. In a table that has a document twice, the first text in the order of format and text counts. Null documents and
    links to other terms than IRIs lead nowhere; an empty graph gives an empty result.
    """
    spark: SparkSession = graph.sparkSession
    along = [p if isinstance(p, str) else p.value for p in predicates]
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = lambda df: df.where((F.col("p.k") == IRI) & F.col("p.v").isin(along)).select(document_of(F.col("o")).alias("document")).where("document IS NOT NULL").distinct()
    path, call, n = new_path(spark, "links"), uuid.uuid4().hex, 0
    given = graph.select(F.lit(None).cast("string").alias("document"), "s", "p", "o", F.lit(None).cast("string").alias("problem"))
    given.write.parquet(f"{path}/round=0")
    read = lambda sub="": spark.read.schema(_ROWS + ("" if sub else ", round int")).parquet(path + sub)
    while rounds is None or n < rounds:
        wanted = links(read(f"/round={n}"))
        if n:
            seen = read().where("s IS NULL AND document IS NOT NULL").select("document")
            wanted = wanted.join(seen, "document", "left_anti")
        # by number, so that Spark doesn't put a small frontier into one task
        wanted = materialize(wanted.repartition(parts, "document"), "frontier")
        if wanted.isEmpty():
            break
        n += 1
        texts = _texts(wanted.repartition(parts, "document"), source)
        _parsed(texts, call).write.parquet(f"{path}/round={n}")
    rows = read()
    documents = rows.where("document IS NOT NULL").groupBy("document", "round").agg(F.count("s").alias("triples"), F.max("problem").alias("problem"))
    return Followed(documents, rows.where("s IS NOT NULL").select("document", "s", "p", "o"))


__all__ = ["PARSERS", "Fetch", "Folders", "Followed", "document_of", "follow_links"]
