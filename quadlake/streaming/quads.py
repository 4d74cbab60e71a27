"""Quads from a growing folder of N-Quads files: pattern filters and running counts on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quads import Matcher, anything, matching
from ..sources.nquads import parse_lines


def stream_nquads(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """A streaming frame (g, s, p, o); blank node labels are kept."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return parse_lines(lines, preserve_bnodes=True)


def stream_matching(quads: DataFrame, s: Matcher = anything, p: Matcher = anything, o: Matcher = anything, g: Matcher = anything) -> DataFrame:
    """A stateless pattern filter."""
    return matching(quads, s, p, o, g)


def predicate_counts(quads: DataFrame) -> DataFrame:
    """Running number of quads for each predicate; for output mode complete or update."""
    return quads.groupBy(F.col("p.v").alias("predicate")).count()
