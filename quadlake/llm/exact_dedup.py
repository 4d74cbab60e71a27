"""Exact deduplication by deterministic block naming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, joined, joined_hot, materialize, numbered, placed, stable, without


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, "")


def _named(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """One integer for each row of `distinct`, in sorted order."""
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = distinct.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return materialize(ordered.withColumn("name", F.monotonically_increasing_id()), "names")


def block_identity(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", block_bytes: int = 16384, hash_bits: int = 64) -> DataFrame:
    """One row for each row of docs: row, doc_id, chars, sha256, level, name.

    Two texts have the same (level, name) exactly when they are equal without white space. The normalised text is
    cut into fixed-size blocks. Blocks are grouped by a 64-bit key; the least and greatest content of a group tell
    whether it holds one content, and groups with several are named by content, so a clash of keys never merges
    texts. Sorted contents get integer names; then adjacent names are paired and named again until one name is
    left of each document. `row` is that of placed(). A null text counts as empty,
    which is one empty block. `hash_bits` below 64 forces clashes, for tests.
    """
    docs = stable(docs)
    size = F.octet_length("_n")
    count = F.greatest(F.lit(1), F.ceil(size / F.lit(block_bytes))).cast("int")
    block = lambda i: F.substring(F.col("_n").cast("binary"), i * block_bytes + 1, F.lit(block_bytes))
    mask = -1 if hash_bits >= 64 else (1 << hash_bits) - 1
    key = lambda b: F.xxhash64(b).bitwiseAND(F.lit(mask))
    base = placed(docs, F.col(doc_id).alias("doc_id"), F.coalesce(F.length(text), F.lit(0)).alias("chars"), normalized(F.col(text)).alias("_n"))
    cut = base.withColumn("_blocks", F.transform(F.sequence(F.lit(0), count - 1), block))
    digests = materialize(cut.select("row", "doc_id", "chars", F.sha2("_n", 256).alias("sha256"), F.transform("_blocks", key).alias("keys")), "digests")

    contents = cut.select(F.explode("_blocks").alias("block")).withColumn("key", key(F.col("block")))
    groups = contents.groupBy("key").agg(F.min("block").alias("least"), F.max("block").alias("most"))
    clean = _named(groups.select("key", (F.col("least") != F.col("most")).alias("clash")), ["key"])
    labels = digests.select("row", F.size("keys").alias("blocks"), F.posexplode("keys").alias("pos", "key"))
    clashes = clean.where("clash").select("key")
    state = joined(labels, clean.where("NOT clash").drop("clash"), ["key"])
    if not clashes.isEmpty():
        found = cut.select("row", F.size("_blocks").alias("blocks"), F.posexplode("_blocks").alias("pos", "block")).withColumn("key", key(F.col("block")))
        found = joined(found, clashes, ["key"], "left_semi")
        exact = _named(found.select("key", "block").distinct(), ["key", "block"]).withColumn("name", -F.col("name") - 1)
        state = state.unionByName(joined(found, exact, ["key", "block"]).drop("block"))
    state = state.drop("key")

    done = state.where("blocks = 1").select("row", F.lit(0).alias("level"), "name")
    longest = digests.agg(F.max(F.size("keys"))).first()[0] or 1
    if longest > 1:
        state, level = materialize(state.where("blocks > 1"), "level"), 0
        while longest > 1:
            level, longest = level + 1, -(-longest // 2)
            half = F.expr("pos div 2").cast("int").alias("half")
            left, right = F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))), F.max(F.when(F.col("pos") % 2 == 1, F.col("name")))
            pairs = state.groupBy("row", "blocks", half).agg(left.alias("l"), right.alias("r"))
            pairs = materialize(pairs, "pairs")
            names = _named(pairs.select("l", "r").distinct(), ["l", "r"])
            state = joined(pairs, names, ["l", "r"]).select("row", F.expr("(blocks + 1) div 2").cast("int").alias("blocks"), F.col("half").alias("pos"), "name")
            state = materialize(state, "level")
            done = done.unionByName(state.where("blocks = 1").select("row", F.lit(level).alias("level"), "name"))
            state = state.where("blocks > 1")
    return joined(digests.drop("keys"), done, ["row"])


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """One row for each row of docs: row, doc_id, keep_id, keep_row, group_size, kept, text_sha256.

    Of equal texts the row with the most code points stays, then the smallest doc_id (null last), then the first row.
    Null and empty texts are equal to each other. Rows repeated in full count as separate rows of one group. Other
    columns of docs are ignored, whatever their names. An empty table gives an empty result.
    """
    named = materialize(block_identity(docs, text, doc_id, **options), "named")
    first = F.min(F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"))).alias("first")
    groups = named.groupBy("level", "name").agg(first, F.count(F.lit(1)).alias("group_size")).select("level", "name", "first.keep_id", "first.keep_row", "group_size")
    out = joined_hot(named, materialize(groups, "groups"), ["level", "name"], "group_size", named.count())
    return out.select("row", "doc_id", "keep_id", "keep_row", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha256").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, **options) -> DataFrame:
    """docs without the rows that exact_dedup drops; columns unchanged, whatever their names.

    Of null, empty and white texts together one row stays, and one of repeated rows. An empty table gives an empty result.
    """
    docs = stable(docs)
    return without(numbered(docs), exact_dedup(docs, **options).where("NOT kept"))
