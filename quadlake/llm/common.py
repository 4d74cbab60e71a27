"""Shared helpers: written intermediate tables and skew-proof prefix sums."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Deletes every ASCII white-space character.
SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is configured and all run on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quadlake-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/quadlake/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends, values no longer change."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stable(df: DataFrame) -> DataFrame:
    """df if it only reads, filters and projects Parquet files, else what it holds, written once: rows of such a frame have a lasting place."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = {re.match(r"[\s:+\-|]*(\w+)", line)[1] for line in plan.splitlines() if re.match(r"[\s:+\-|]*\w", line)}
    if not nodes <= {"Relation", "Project", "Filter"}:
        return materialize(df, "stable")
    try:
        df.select(df.metadataColumn("_metadata")["row_index"])
    except AnalysisException:  # files of another format
        return materialize(df, "stable")
    return df


def placed(docs: DataFrame, *columns: Column) -> DataFrame:
    """The columns of docs, which must be stable(), with `row`: the number of a row's file, in the order of paths, and its place in that file.

    Jobs that read docs again number its rows alike, however the files are split among tasks then: on a machine more or less, after a lost one, or in
    another plan. Paths are read from the rows themselves; as many as there are files come to the driver, which lists them anyway.
    """
    at = docs.metadataColumn("_metadata")
    paths = sorted(r[0] for r in docs.select(at["file_path"]).distinct().collect())
    out = docs.select(*columns, at["file_path"].alias("_path"), at["row_index"].alias("_index"))
    names = out.columns[:-2]
    if len(paths) > 1:
        files = docs.sparkSession.createDataFrame(list(enumerate(paths)), "_file long, _name string")
        out = out.join(F.broadcast(files), F.col("_path") == F.col("_name"))
    file = F.col("_file") if len(paths) > 1 else F.lit(0).cast("long")
    return out.select(*names, (F.shiftleft(file, 40) + F.col("_index")).alias("row"))


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # the session has ended: its shared folder is the cluster's to clear
            return


def buckets_for(rows: int, per_bucket: int = 50_000, least: int = 64) -> int:
    """How many parts a group is dealt into, so that a part stays small at every input size."""
    return max(least, -(-rows // per_bucket))


def joined(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join that keeps the left keys and the right's other columns."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    out = left.join(renamed, on, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"_r_{k}" for k in keys])


def joined_hot(left: DataFrame, right: DataFrame, keys: Sequence[str], count: str, rows: int, share: int = 4096) -> DataFrame:
    """Inner null-safe equi-join for hot keys; `right` has one row a key, with the number of its rows in `left` as `count`.

    Keys with more than 1/share of the `rows` rows of left are fewer than `share`: they are broadcast, and their rows of left stay where they
    are. All others are joined by a shuffle. Both frames should be written tables.
    """
    hot = F.col(count) > F.lit(max(1, rows // share))
    few = F.broadcast(right.where(hot))
    on_hot = joined(left, few, keys)
    cold = joined(left, few.select(*keys), keys, "left_anti")
    return on_hot.unionByName(joined(cold, right.where(~hot).hint("merge"), keys))


def numbered(docs: DataFrame) -> DataFrame:
    """_row (as `row` in the operators' results) and _all, a struct of the columns of docs, whatever their names. docs must be stable()."""
    return placed(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all")).select(F.col("row").alias("_row"), "_all")


def without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """The columns of the rows of numbered() whose number is no `row` of `dropped`."""
    gone = dropped.select(F.col("row").alias("_gone")).hint("merge")
    return rows.join(gone, F.col("_row") == F.col("_gone"), "left_anti").select("_all.*")


def hash_prefix(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str | None, out: str, buckets: int, extra: DataFrame | None = None, spread: Sequence[str] | None = None) -> DataFrame:
    """Exclusive running sum of `value` (rows if None) within `group`, as column `out`.

    The order is by hash bucket of `order`, then by `order`; any fixed order serves the callers. A group of any
    size is spread over `buckets` parts: sums of parts are added up first, so no task sees a whole group.
    `extra` has one row a group; its columns travel with the part sums instead of being joined to all rows, and are
    null in groups that it lacks. `spread` names the columns to hash if not those of `order`.
    """
    v = F.lit(1).cast("long") if value is None else F.col(value).cast("long")
    df = df.withColumn("_v", F.coalesce(v, F.lit(0))).withColumn("_b", F.pmod(F.xxhash64(*(spread or order)), F.lit(buckets)).cast("int"))
    parts = df.groupBy(*group, "_b").agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy(*group or [F.lit(0)]).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_o", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
    if extra is not None:
        parts = joined(parts, extra, group, "left")
    within = Window.partitionBy(*group, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = joined(df, parts, [*group, "_b"])
    return df.withColumn(out, F.coalesce(F.sum("_v").over(within), F.lit(0)) + F.col("_o")).drop("_v", "_b", "_o")


def range_prefix(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Exclusive running sum of `value` within `group` in the order of `order`, for groups of any size.

    Rows are range-partitioned by (group, order) and written, so that a large group lies on many partitions;
    the sums of the pieces are added up, then each piece is summed by itself.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = materialize(df.repartitionByRange(n, *group, *order).withColumn("_p", F.spark_partition_id()), "range")
    parts = df.groupBy(*group, "_p").agg(F.sum(value).alias("_t"))
    before = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_o", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
    within = Window.partitionBy(*group, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = joined(df, parts, [*group, "_p"])
    return df.withColumn(out, F.coalesce(F.sum(value).over(within), F.lit(0)) + F.col("_o")).drop("_p", "_o")
