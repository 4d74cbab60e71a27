"""Reading documents by their extension, and IRIs that stand for files in local folders."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .jsonld import read_jsonld
from .nquads import read_nquads
from .rdfxml import read_rdfxml
from .turtle import read_trig, read_turtle

#: In the order in which they are tried where an IRI has no extension.
FORMATS: dict[str, Callable[..., DataFrame]] = {"nt": read_nquads, "ttl": read_turtle, "jsonld": read_jsonld, "rdf": read_rdfxml, "nq": read_nquads, "trig": read_trig}


def read_dataset(spark: SparkSession, path: str, **options) -> DataFrame:
    """Quads of files whose extension names the format."""
    extension = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if extension not in FORMATS:
        raise ValueError(f"unknown extension: {path}")
    return FORMATS[extension](spark, path, **options)


def read_graph(spark: SparkSession, path: str, **options) -> DataFrame:
    """Triples of the default graph."""
    return read_dataset(spark, path, **options).where(F.col("g").isNull()).select("s", "p", "o")


class LocalLoader:
    """IRIs below a prefix as files below a folder."""

    def __init__(self, spark: SparkSession, folders: dict[str, str]):
        self.spark, self.folders = spark, folders

    def path(self, iri: str) -> str:
        iri = iri.partition("#")[0]
        for prefix, folder in self.folders.items():
            if iri.startswith(prefix):
                root = os.path.abspath(folder)
                path = os.path.abspath(os.path.join(root, iri[len(prefix) :]))
                if os.path.commonpath([root, path]) != root:
                    break
                if os.path.isfile(path):
                    return path
                for extension in FORMATS:
                    if os.path.isfile(f"{path}.{extension}"):
                        return f"{path}.{extension}"
        raise FileNotFoundError(iri)

    def dataset(self, iri: str) -> DataFrame:
        path = self.path(iri)
        base = {"base": iri.partition("#")[0]} if path.rsplit(".", 1)[-1] not in ("nt", "nq") else {}
        return read_dataset(self.spark, path, **base)

    def graph(self, iri: str) -> DataFrame:
        return self.dataset(iri).where(F.col("g").isNull()).select("s", "p", "o")
