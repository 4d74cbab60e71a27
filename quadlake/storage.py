"""Written intermediate tables, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def new_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed at the end of the session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quadlake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/quadlake/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, label: str = "table", most: int = 0) -> DataFrame:
    """Write df once, to files of at most `most` rows where given, and read it back: lineage ends, and a lost executor costs nothing."""
    path = new_path(df.sparkSession, label)
    df.write.option("maxRecordsPerFile", most).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(written: DataFrame) -> None:
    """Remove the files of a frame that materialize() wrote, once nothing reads them any more; and have Spark let go of the shuffles that are behind it, which stay on disk until the driver's JVM collects."""
    _remove(written.sparkSession, written.written_to)
    written.sparkSession.sparkContext._jvm.System.gc()


def file_system(path: str):
    """Arrow's file system of a path, and the path there; in tasks and in the driver."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def spread(df: DataFrame, keys: list[str], rows: int, least: int = 0) -> DataFrame:
    """df dealt out again by keys to tasks of about `rows` rows, if it has more than `least`: a small file of many rows is read by one task, which would also make all that follows from them."""
    count = df.count()
    return df.repartition(-(-count // rows), *keys) if count > max(rows, least) else df


def distinct_runs(df: DataFrame, keys: list[str], longest: int = 1000) -> tuple[DataFrame, DataFrame | None]:
    """The two parts of df.distinct(), of a frame read from files: keys whose rows stand together and differ, taken as they stand, and other keys, if there are any. Only a hash of each run is dealt out, and whole rows of the other keys alone.

    A run of more than `longest` rows, and keys or rows that share a hash, count as others.
    """

    def runs(batches):
        import numpy as np
        import pyarrow as pa

        def ended(h, x, whole: bool):
            """The hashes of the runs that end here, those in doubt twice; and what may go on."""
            start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, dtype="i8")
            end = len(h) if whole or not len(start) else start[-1]
            start = start if whole else start[:-1]
            sizes = np.diff(np.append(start, end))
            run = np.repeat(np.arange(len(start)), sizes)
            order = np.lexsort((x[:end], run))
            same = (run[order][1:] == run[order][:-1]) & (x[order][1:] == x[order][:-1])
            doubt = sizes > longest
            doubt[run[order][1:][same]] = True
            out = np.concatenate([h[start], h[start[doubt]]])
            return pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["h"]), h[end:][: longest + 1], x[end:][: longest + 1]

        h = x = np.zeros(0, dtype="i8")
        for b in batches:
            h, x = (np.concatenate([old, b.column(k).to_numpy(zero_copy_only=False)]) for k, old in enumerate((h, x)))
            out, h, x = ended(h, x, False)
            yield out
        yield ended(h, x, True)[0]

    key = F.xxhash64(*keys)
    others = [c for c in df.columns if c not in keys]
    found = df.select(key.alias("h"), (F.xxhash64(*others) if others else F.lit(0).cast("long")).alias("x")).mapInArrow(runs, "h long")
    again = materialize(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("h").alias("_h")), "again")
    if again.isEmpty():
        return df, None
    rows = df.withColumn("_h", key)
    return rows.join(again, "_h", "left_anti").drop("_h"), rows.join(again, "_h", "left_semi").drop("_h").distinct()


@contextmanager
def dealt(spark: SparkSession, rows: int, each: int = 200_000):
    """Within it, shuffles of so many rows go to tasks of about `each`: Spark counts packed bytes, of which repeated texts take a thirtieth of their memory, and would put millions of rows into a task."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    parts, old = -(-rows // each), [spark.conf.get(x) for x in names]
    if parts > min(int(old[0]), spark.sparkContext.defaultParallelism):
        for name, value in zip(names, (max(parts, int(old[0])), False)):
            spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in zip(names, old):
            spark.conf.set(name, value)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the session has ended: its shared folder is the cluster's to clear
            return
