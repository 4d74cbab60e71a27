"""A written store of quads in several sort orders, with versions.

Each order is a copy of the quads in Parquet files, one folder for each bucket of its leading term, with row groups sorted by all four. A pattern is
answered from the order that has most of its bound terms in front: the bucket of the leading one is a folder, pages of row groups tell about the others.
Changes are written as small tables of additions and removals; a version is a short list of what it is made of, written last and never changed, so that older
versions stay readable and a change that fails leaves nothing behind. Reading merges a version's changes with one join; compacting rewrites the buckets that they touch.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.compiler import GRAPH, Store, _open
from ..storage import file_system, materialize
from ..terms import LITERAL, QUADS, Term, iri, term
from .quads import _absent

#: The places in each order, by which a store sorts its copies.
ORDERS = ("spog", "posg", "ospg", "gspo")
#: Rows, and bytes, that a task sorts at a time: the largest row group.
ROWS, BYTES = 1_000_000, 1 << 28
#: Files that a task writes at a time.
FILES = 256


def order_for(bound: str, held: Iterable[str] = ORDERS) -> str:
    """Of the orders that are held, the one with the longest front of bound positions; of equal ones the first."""

    def front(order: str) -> int:
        return next((i for i, c in enumerate(order) if c not in bound), len(order))

    return max(held, key=front)


def _bucket(t: Term | None, buckets: int) -> int:
    return 0 if t is None else zlib.crc32(f"{t.kind}{t.value}".encode("utf-8", "surrogatepass")) % buckets


def _bucket_column(kind: Column, value: Column, buckets: int) -> Column:
    text = F.concat(kind.cast("string"), value)
    return F.when(kind.isNull(), 0).otherwise(F.crc32(text.cast("binary")) % F.lit(buckets)).cast("int")


_FIELDS = ("v", "k", "d", "l", "r")


def _flat(quads: DataFrame) -> DataFrame:
    """A column for each field of each place: half the bytes of structs to write and compare."""
    return quads.select(*[F.col(c)[f].alias(f"{c}{f}") for f in _FIELDS for c in "gspo"])


def _files(flat: DataFrame) -> DataFrame:
    """Flat rows, written to files that a task sorts at a time."""
    return materialize(flat, "quads", ROWS)


class _Files:
    """Small files of a store's folder, by the Hadoop file system that its tables are in."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        where = self.jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.conf)

    def create(self, path: str, text: str) -> None:
        """A new file; an error if there is one."""
        where, fs = self._at(path)
        out = fs.create(where, False)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, path: str) -> str:
        where, fs = self._at(path)
        source = fs.open(where)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    def names(self, path: str) -> list[str]:
        where, fs = self._at(path)
        return [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []


class QuadStore(Store):
    """A version of a store in a folder that driver and executors share; the newest unless told."""

    reads_files = True

    def __init__(self, spark: SparkSession, folder: str, version: int | None = None):
        self.spark, self.folder, self.files = spark, folder.rstrip("/"), _Files(spark)
        numbers = sorted(int(m[1]) for x in self.files.names(f"{self.folder}/versions") if (m := re.fullmatch(r"(\d+)\.json", x)))
        if not numbers or (version is not None and version not in numbers):
            raise ValueError(f"no such version of a store: {folder}")
        self.version = numbers[-1] if version is None else version
        self.state = json.loads(self.files.read(f"{self.folder}/versions/{self.version:08d}.json"))

    @classmethod
    def create(cls, quads: DataFrame, folder: str, buckets: int = 64, orders: Iterable[str] = ORDERS) -> QuadStore:
        """Write quads (g null for the default graph) as a set. A bucket should come to some hundred MB: `buckets` grows with the data.

        A light store holds fewer orders, each with all quads: it is written sooner and answers everything, but reads more for patterns that none of them suits.
        """
        spark, folder = quads.sparkSession, folder.rstrip("/")
        flat = _flat(quads)
        rows = _files(flat.withColumn("_h", F.xxhash64(*flat.columns)))
        # quads that are there twice have one hash: where no two rows share one, whole quads need not be dealt out and compared
        twice = not rows.groupBy("_h").count().where("count > 1").isEmpty()
        rows = rows.drop("_h")
        rows = _files(rows.distinct()) if twice else rows
        state = {"buckets": buckets, "orders": _written(rows, orders, f"{folder}/base", buckets), "deltas": [], "delta_rows": 0}
        _Files(spark).create(f"{folder}/versions/{0:08d}.json", json.dumps(state))
        return cls(spark, folder)

    # reading

    @property
    def first(self) -> str:
        """The order that is read as a whole."""
        return next(iter(self.state["orders"]))

    def _base(self, order: str, buckets: list[int] | None = None) -> DataFrame:
        paths = self.state["orders"][order]
        wanted = [p for b, p in paths.items() if buckets is None or int(b) in buckets]
        schema = QUADS.simpleString()
        return self.spark.read.schema(QUADS).parquet(*wanted).select("g", "s", "p", "o") if wanted else self.spark.createDataFrame([], schema)

    def _changes(self) -> DataFrame | None:
        """Every quad that the version's changes name, with whether the last of them added it."""
        if not self.state["deltas"]:
            return None
        rows = self.spark.read.schema(T.StructType([*QUADS, T.StructField("add", T.BooleanType()), T.StructField("at", T.IntegerType())])).parquet(*self.state["deltas"])
        return rows.groupBy("g", "s", "p", "o").agg(F.max_by("add", "at").alias("add"))

    def _merged(self, base: DataFrame, tests: list[Column]) -> DataFrame:
        for t in tests:
            base = base.where(t)
        changes = self._changes()
        if changes is None:
            return base
        for t in tests:
            changes = changes.where(t)
        return _absent(base, changes.drop("add")).unionByName(changes.where("add").drop("add"))

    @property
    def quads(self) -> DataFrame:
        """All quads of the version."""
        return self._merged(self._base(self.first), [])

    def rows(self, bound: dict[str, Term | None]) -> DataFrame:
        """The quads with these terms at these places (g: None is the default graph), from the order that suits."""
        order = order_for("".join(bound), self.state["orders"])
        lead = order[0]
        base = self._base(order, [_bucket(bound[lead], self.state["buckets"])] if lead in bound else None)
        tests = []
        for c, t in bound.items():
            if t is None:
                tests.append(F.col(c).isNull())
            else:
                # tests of fields reach the scan; one of the whole term would replace them
                tests += [F.col(f"{c}.v") == t.value, F.col(f"{c}.k") == t.kind]
                if t.kind == LITERAL:
                    tests += [F.col(f"{c}.{f}").eqNullSafe(F.lit(x)) for f, x in (("d", t.datatype), ("l", t.lang), ("r", t.direction))]
        return self._merged(base, tests)

    def pattern(self, triple: tuple, active):
        bound: dict[str, Term | None] = {c: t for c, t in zip("spo", triple) if not _open(t)}
        if active is None:
            bound["g"] = None
        elif isinstance(active, str) and active != GRAPH:
            bound["g"] = iri(active)
        elif isinstance(active, list) and len(active) == 1:
            bound["g"] = iri(active[0])
        return Store(self.rows(bound)).pattern(triple, active)

    def about(self, terms: list[Term], active) -> DataFrame:
        found = [self.rows({c: t}) for t in terms for c in "so"]
        return Store(reduce(DataFrame.unionByName, found).distinct()).about(terms, active)

    def graphs(self) -> DataFrame:
        return self.quads.where(F.col("g").isNotNull()).select(F.col("g").alias(GRAPH)).distinct()

    def contains(self, quad: tuple) -> bool:
        return not self.rows(dict(zip("gspo" if len(quad) == 4 else "spo", quad))).limit(1).isEmpty()

    def touched(self, quads: DataFrame, order: str) -> list[int]:
        """The buckets that quads are in."""
        return [r[0] for r in quads.select(_bucket_column(F.col(f"{order[0]}.k"), F.col(f"{order[0]}.v"), self.state["buckets"]).alias("b")).distinct().collect()]

    def _current(self, quads: DataFrame) -> DataFrame:
        """The version's rows of the buckets that quads are in."""
        base = self._base(self.first, self.touched(quads, self.first))
        return self._merged(base, [])

    # changes

    def inserted(self, more: DataFrame) -> tuple[QuadStore, int]:
        """The next version, with more; and how many of more are new."""
        new = materialize(_absent(more.select("g", "s", "p", "o").distinct(), self._current(more)), "new")
        return self._changed(new, True)

    def removed(self, others: DataFrame) -> tuple[QuadStore, int]:
        """The next version, without others; and how many of others were there."""
        wanted = others.select("g", "s", "p", "o").distinct()
        gone = _absent(wanted, _absent(wanted, self._current(wanted)))
        return self._changed(materialize(gone, "gone"), False)

    def removed_matching(self, **matchers) -> tuple[QuadStore, int]:
        """The next version, without what matches; and how many that were."""
        from .quads import matching

        return self._changed(materialize(matching(self.quads, **matchers), "gone"), False)

    def retained_matching(self, **matchers) -> tuple[QuadStore, int]:
        """The next version, with what matches only; and how many others went."""
        from .quads import remove_matching

        return self._changed(materialize(remove_matching(self.quads, **matchers), "gone"), False)

    def _changed(self, rows: DataFrame, add: bool) -> tuple[QuadStore, int]:
        count = rows.count()
        if not count:
            return self, 0
        path = f"{self.folder}/deltas/{uuid.uuid4().hex}"
        rows.select("g", "s", "p", "o", F.lit(add).alias("add"), F.lit(self.version + 1).alias("at")).write.parquet(path)
        return self._next({**self.state, "deltas": [*self.state["deltas"], path], "delta_rows": self.state["delta_rows"] + count}), count

    def _next(self, state: dict) -> QuadStore:
        """Two writers that start from one version can't both write the next: the second fails."""
        self.files.create(f"{self.folder}/versions/{self.version + 1:08d}.json", json.dumps(state))
        return QuadStore(self.spark, self.folder, self.version + 1)

    def compacted(self) -> QuadStore:
        """The next version, of the same quads, without changes to merge: the buckets that they touch are written anew, the others stay as they are."""
        changes = self._changes()
        if changes is None:
            return self
        changes = materialize(changes, "changes")
        orders = {}
        for order, paths in self.state["orders"].items():
            touched = self.touched(changes, order)
            rows = _absent(self._base(order, touched), changes.drop("add")).unionByName(changes.where("add").drop("add"))
            kept = {b: p for b, p in paths.items() if int(b) not in touched}
            orders[order] = {**kept, **_written(_files(_flat(rows)), [order], f"{self.folder}/base", self.state["buckets"])[order]}
        return self._next({**self.state, "orders": orders, "deltas": [], "delta_rows": 0})


def _blocks(path: str) -> Iterator[pa.Table]:
    """The rows of a file of flat rows in tables of at most ROWS rows and, but for single rows, about BYTES; texts are coded by dictionaries."""
    import pyarrow.parquet as pq

    fs, name = file_system(path)
    with fs.open_input_file(name) as source:
        file = pq.ParquetFile(source, read_dictionary=[f"{c}{f}" for c in "gspo" for f in "vdlr"])
        for i in range(file.num_row_groups):
            group = file.metadata.row_group(i)
            step = max(1, min(ROWS, group.num_rows * BYTES // max(1, group.total_byte_size)))
            for batch in file.iter_batches(step, row_groups=[i]):
                block = pa.Table.from_batches([batch]).unify_dictionaries().combine_chunks()
                # equal texts are one in a dictionary, not in the rows that are written
                size = sum(pc.sum(pc.binary_length(x.dictionary).take(x.indices)).as_py() or 0 for x in (_array(block, f"{c}v") for c in "gspo"))
                n = -(-block.num_rows // max(1, -(-size // BYTES)))
                yield from (block.slice(k, n) for k in range(0, block.num_rows, n))


def _array(block: pa.Table, name: str) -> pa.Array:
    column = block.column(name)
    return column.chunk(0) if column.num_chunks == 1 else column.combine_chunks()


def _ranks(block: pa.Table, c: str, buckets: int) -> tuple[np.ndarray, int, np.ndarray]:
    """For the rows of a block the rank of a place's value, 0 where there is none; the number of ranks; and the bucket. Each value is looked at once."""
    coded = _array(block, f"{c}v")
    values, at = coded.dictionary, pc.fill_null(coded.indices, len(coded.dictionary)).to_numpy(zero_copy_only=False)
    rank = np.zeros(len(values) + 1, np.int64)
    rank[pc.sort_indices(values).to_numpy()] = np.arange(1, len(values) + 1)
    kinds = pc.fill_null(_array(block, f"{c}k"), -1).to_numpy(zero_copy_only=False)
    bucket, texts = np.zeros(len(at), np.int64), values.cast(pa.binary()).to_pylist()
    for k in np.unique(kinds[kinds >= 0]).tolist():
        rows, start, of_value, of_kind = kinds == k, zlib.crc32(str(k).encode()), np.zeros(len(values), np.int64), np.zeros(len(values), bool)
        of_kind[at[rows]] = True
        for i in np.flatnonzero(of_kind).tolist():
            of_value[i] = zlib.crc32(texts[i], start) % buckets
        bucket[rows] = of_value[at[rows]]
    return rank[at], len(values) + 1, bucket


def _sorted(columns: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """Row numbers in the order of columns of numbers below their bounds, by one number for each row where that holds them all."""
    key, size = np.zeros(len(columns[0][0]), np.int64), 1
    for values, bound in columns:
        size *= bound
        if size >= 1 << 63:
            return np.lexsort([v for v, _ in reversed(columns)])
        key = key * bound + values
    return np.argsort(key)


def _place(block: pa.Table, c: str, at: pa.Array) -> pa.StructArray:
    """The terms of a place in these rows."""
    kind, fields = _array(block, f"{c}k").take(at), []
    for f in "vdlr":
        x = _array(block, f"{c}{f}")
        fields.append(pa.nulls(len(at), pa.string()) if x.null_count == len(x) else x.dictionary.take(x.indices.take(at)))
    return pa.StructArray.from_arrays([kind, *fields], list("kvdlr"), mask=kind.is_null())


def _sorter(files: list[list[str]], paths: dict[str, str], buckets: int):
    """For mapInArrow over the numbers of lists of files: sorts their rows, block by block, in each order and writes a file for each order and bucket; gives the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        made: list[tuple[str, int, str]] = []
        writers: dict[tuple[str, int], pq.ParquetWriter] = {}
        for block in (x for b in batches for n in b.column(0).to_pylist() for f in files[n] for x in _blocks(f)):
            ranks = {c: _ranks(block, c, buckets) for c in "gspo"}
            for order, path in paths.items():
                bucket = ranks[order[0]][2]
                at = _sorted([(bucket, buckets), *[ranks[c][:2] for c in order]])
                bucket, numbers = bucket[at], pa.array(at)
                rows = pa.table({c: _place(block, c, numbers) for c in "gspo"})
                starts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(at)]
                for start, end in zip(starts, starts[1:]):
                    key = order, int(bucket[start])
                    if key not in writers:
                        if len(writers) >= FILES:
                            writers.pop(next(iter(writers))).close()
                        # a name that no other attempt of the task takes
                        made.append((*key, f"{uuid.uuid4().hex}.parquet"))
                        fs, root = file_system(f"{path}/_parts")
                        writers[key] = pq.ParquetWriter(f"{root}/{made[-1][2]}", rows.schema, filesystem=fs, write_page_index=True)
                    writers[key].write_table(rows.slice(start, end - start), row_group_size=end - start)
        for w in writers.values():
            w.close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made), (pa.string(), pa.int32(), pa.string()))], ["order", "bucket", "file"])

    return run


def _written(rows: DataFrame, orders: Iterable[str], folder: str, buckets: int) -> dict[str, dict[str, str]]:
    """Write flat rows in each of the orders; gives for each the folder of each bucket that has rows.

    rows: of files that were written. A task writes its share of them in all orders, without dealing them out: a leading term with many rows lies in many files, one of each task
    that has any. Files come into the folders that are read when all are there, only those of attempts that ended well.
    """
    paths = {order: f"{folder}/{order}-{uuid.uuid4().hex}" for order in orders}
    for path in paths.values():
        fs, root = file_system(f"{path}/_parts")
        fs.create_dir(root, recursive=True)
    found: dict[str, dict[str, str]] = {order: {} for order in paths}
    spark, files = rows.sparkSession, sorted(rows.inputFiles())
    tasks = min(len(files), max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(files) // 8))
    shares = [files[i::tasks] for i in range(tasks)]
    made = spark.range(0, tasks, 1, max(1, tasks)).mapInArrow(_sorter(shares, paths, buckets), "order string, bucket int, file string").collect()
    for order, bucket, name in made:
        fs, root = file_system(paths[order])
        if str(bucket) not in found[order]:
            fs.create_dir(f"{root}/_b={bucket}", recursive=True)
            found[order][str(bucket)] = f"{paths[order]}/_b={bucket}"
        fs.move(f"{root}/_parts/{name}", f"{root}/_b={bucket}/{name}")
    return found
