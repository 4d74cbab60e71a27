"""Mixing sources to target weights by drawing fixed-length blocks of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, joined, materialize, numbered, placed, range_prefix, stable

#: Words in a block (fewer in sources of fewer than LEAST_BLOCKS blocks) and blocks in an output shard.
BLOCK_WORDS, SHARD_BLOCKS, LEAST_BLOCKS = 256, 1024, 64
ROUNDS = 6
_CHUNK = 4096


def _number(s: Column) -> Column:
    """48 bits of the md5 of s."""
    return F.conv(F.substring(F.md5(s.cast("binary")), 1, 12), 16, 10).cast("long")


def permuted(key: Column, x: Column, n: Column) -> Column:
    """A pseudorandom permutation of 0..n-1, another for each key: swap-or-not rounds on md5.

    Each round pairs x with k - x modulo n and swaps the pair if a hash of the pair says so; so it is a bijection for every n.
    """
    keys = F.transform(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), lambda r: F.pmod(_number(F.concat_ws(":", key, r)), n))

    def step(a: Column, k: Column) -> Column:
        other = F.pmod(k - a, n)
        bit = F.substring(F.md5(F.concat_ws(":", key, k, F.greatest(a, other)).cast("binary")), 1, 1) >= "8"
        return F.when(bit, other).otherwise(a)

    return F.aggregate(keys, x.cast("long"), step)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), total_share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size -> with index, weight and target; one row a source.

    Sources in the order of code points, null last, take the weights in turn. All targets add up to total_share of all
    sizes; none is above `most` times its source's size, and what is above is shared again by weight. That fixed point is
    min(weight * level, most * size) at one level, found by sorting sources by the level where they fill up.
    Only one row a source meets in one task.
    """
    one = Window.partitionBy(F.lit(0))
    order = F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1
    table = sizes.withColumn("source_index", order.cast("int"))
    table = table.withColumn("weight", F.array(*[F.lit(float(w)) for w in weights])[F.col("source_index") % len(weights)])
    table = table.withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    until = one.orderBy(F.col("_cap") / F.col("weight"), "source_index").rowsBetween(Window.unboundedPreceding, -1)
    full, filled = F.coalesce(F.sum("_cap").over(until), F.lit(0.0)), F.coalesce(F.sum("weight").over(until), F.lit(0.0))
    table = table.withColumn("_level", (F.sum("source_size").over(one) * F.lit(total_share) - full) / (F.sum("weight").over(one) - filled))
    level = F.max("_level").over(one)
    return table.withColumn("target", F.least(F.col("weight") * level, F.col("_cap"))).drop("_cap", "_level")


def sized(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    return placed(stable(docs), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), F.xxhash64(text).alias("_hash"))


def block_amounts(sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """sources with block (words in its blocks), blocks, slots (how many blocks the mix takes of it, twice each at most) and first (slots of the sources before it).

    Blocks have block_words words, in a source of fewer than LEAST_BLOCKS such blocks as many fewer as give it about so many, so that rounding to
    whole blocks leaves small sources near their targets too.
    """
    one = Window.partitionBy(F.lit(0))
    table = sources.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block_words), F.ceil(F.col("source_size") / F.lit(LEAST_BLOCKS)))).cast("long"))
    table = table.withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
    slots = F.least(F.round(F.col("blocks") * F.col("target") / F.col("source_size")), 2 * F.col("blocks"))
    table = table.withColumn("slots", F.when(F.col("source_size") > 0, slots).otherwise(0).cast("long"))
    return table.withColumn("first", F.sum("slots").over(one.orderBy("source_index")) - F.col("slots"))


def draws(amounts: DataFrame, shard_blocks: int = SHARD_BLOCKS, seed: str = "mix") -> DataFrame:
    """One row for each slot of the mix: source_index, slot (within the source), block, shard, position; amounts come from block_amounts().

    Every output shard draws its sources' counts from the multinomial distribution of the targets: each of its positions draws a
    source. A source's slots are numbered through the shards. As counts of all shards add up to the targets only about, a last
    correction follows: slots of a source beyond its target go, in order, to the sources short of theirs. Slot j of a source takes block
    p(j mod blocks), p being the source's own permutation: no block comes twice before all came once.
    """
    spark = amounts.sparkSession
    amounts = materialize(amounts.select("source_index", "blocks", "slots", "first"), "amounts")
    total = amounts.agg(F.sum("slots")).first()[0] or 0
    places = spark.range(0, total, 1, max(1, min(total, max(int(spark.conf.get("spark.sql.shuffle.partitions")), total >> 20))))
    places = places.select(F.expr(f"id div {shard_blocks}").alias("shard"), F.pmod("id", F.lit(shard_blocks)).alias("position"))
    drawn = F.pmod(_number(F.concat_ws(":", F.lit(f"{seed}/shards"), "shard", "position")), F.lit(max(1, total)))
    # a draw finds its source by the piece of the range of draws that it falls into, and there by comparing
    pieces = amounts.where("slots > 0").withColumn("_c", F.explode(F.sequence(F.expr(f"first div {_CHUNK}"), F.expr(f"(first + slots - 1) div {_CHUNK}"))))
    places = places.withColumn("_x", drawn).withColumn("_c", F.expr(f"_x div {_CHUNK}"))
    picked = places.join(pieces.select("source_index", "first", "slots", "_c"), "_c").where("_x >= first AND _x < first + slots").select("shard", "position", "source_index")
    picked = materialize(picked, "draws")

    counts = materialize(picked.groupBy("source_index", "shard").agg(F.count(F.lit(1)).alias("n")), "shard_counts")
    one = Window.partitionBy(F.lit(0)).orderBy("source_index").rowsBetween(Window.unboundedPreceding, -1)
    totals = joined(amounts, counts.groupBy("source_index").agg(F.sum("n").alias("_k")), ["source_index"], "left").withColumn("_k", F.coalesce("_k", F.lit(0)))
    before = lambda x: F.coalesce(F.sum(F.greatest(F.lit(0), x)).over(one), F.lit(0))
    totals = totals.withColumn("_over", before(F.col("_k") - F.col("slots"))).withColumn("_short", before(F.col("slots") - F.col("_k")))
    totals = materialize(totals, "totals")
    counts = joined(range_prefix(counts, ["source_index"], ["shard"], "n", "start"), totals.select("source_index", "slots", "_over"), ["source_index"])
    rank = F.row_number().over(Window.partitionBy("shard", "source_index").orderBy("position")) - 1
    rows = joined(picked.withColumn("_r", rank), counts.select("source_index", "shard", "start", "slots", "_over").hint("merge"), ["source_index", "shard"])
    rows = materialize(rows.select("source_index", "shard", "position", (F.col("start") + F.col("_r")).alias("slot"), "slots", "_over"), "slots")
    freed = rows.where("slot >= slots").select("shard", "position", (F.col("_over") + F.col("slot") - F.col("slots")).alias("_f"))
    short = totals.where("slots > _k").withColumn("slot", F.explode(F.sequence(F.col("_k"), F.col("slots") - 1)))
    short = short.select("source_index", "slot", (F.col("_short") + F.col("slot") - F.col("_k")).alias("_f"))
    rows = rows.where("slot < slots").select("source_index", "shard", "position", "slot").unionByName(short.join(freed, "_f").drop("_f"))
    rows = rows.join(amounts.select("source_index", "blocks"), "source_index")
    block = permuted(F.concat_ws("/", F.lit(seed), "source_index"), F.pmod("slot", "blocks"), F.col("blocks"))
    return rows.select("source_index", "slot", block.alias("block"), "shard", "position")


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", block_words: int = BLOCK_WORDS, **options) -> DataFrame:
    """One row for each row of docs: row, doc_id, size, source_size, target, taken, first_shard, first_position, source_index, start (words of its source before it).

    A source's texts, in the order of doc_id (null first), are one run of words, cut into blocks; `taken` are the
    words of a document in the drawn blocks, repeats counted: twice its size at most. first_shard and first_position say where the first of these
    blocks lies in the mix (null if none is drawn). Null text has no words and is never taken. Null is a source of its own.
    Repeated rows count each. Other columns of docs are ignored. An empty table gives an empty result.
    """
    base = materialize(sized(docs, text, doc_id, source), "sizes")
    sources = source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), **options)
    sources = materialize(block_amounts(sources, block_words), "sources")
    base = joined(base, sources.select("source", "source_index", F.col("block").alias("_w")), ["source"]).drop("source")
    placed = range_prefix(base, ["source_index"], ["doc_id", "_hash", "row"], "size", "start").drop("_hash")
    place = F.min(F.struct("shard", "position")).alias("_place")
    taken = draws(sources).groupBy("source_index", "block").agg(F.count(F.lit(1)).alias("times"), place)
    first, last = F.expr("start div _w"), F.expr("(start + size - 1) div _w")
    spans = placed.withColumn("block", F.explode(F.when(F.col("size") > 0, F.sequence(first, last)).otherwise(F.array(-1 - F.pmod("row", F.lit(1024))))))
    words = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("_w")) - F.greatest(F.col("start"), F.col("block") * F.col("_w"))
    spans = spans.withColumn("words", F.when(F.col("size") > 0, words).otherwise(0))
    # Spark takes exploded rows for as small as the table before; the draws grow with the corpus and must not be broadcast.
    found = joined(spans, taken.hint("merge"), ["source_index", "block"], "left")
    sums = F.sum(F.col("words") * F.coalesce(F.col("times"), F.lit(0))).cast("long").alias("taken")
    out = found.groupBy("row", "doc_id", "size", "source_index", "start").agg(sums, F.min("_place").alias("_place"))
    out = joined(out, sources.select("source_index", "source_size", "target"), ["source_index"])
    return out.select("row", "doc_id", "size", "source_size", "target", "taken", F.col("_place.shard").alias("first_shard"), F.col("_place.position").alias("first_position"), "source_index", "start")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as the mix takes its words; columns unchanged, whatever their names. Rows without words go.

    The fraction is rounded up with its own chance, by a hash of the row's place among its source's words, so that words meet the target for texts of
    any length; neither the files nor the tasks that rows come in matter.
    Null and empty texts go. Repeated rows are drawn each. An empty table gives an empty result.
    """
    docs = stable(docs)
    draw = F.pmod(F.xxhash64(F.lit("copies"), "source_index", "start"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    times = F.floor(F.col("taken") / F.col("size") + draw).cast("int")
    taken = mix(docs, **options).where("size > 0").select(F.col("row").alias("_taken"), times.alias("_times")).where("_times > 0")
    out = numbered(docs).join(taken.hint("merge"), F.col("_row") == F.col("_taken"))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_all.*")


def mix_sql(block_words: int = BLOCK_WORDS, seed: str = "mix") -> str:
    """DuckDB SQL for mix() on a table `documents` with unique doc_id."""
    rounds = "SELECT source_index, slot, n, shard, position, slot % n AS x FROM slots"
    for r in range(ROUNDS):
        key = f"'{seed}/' || source_index"
        k = f"(CAST('0x' || substr(md5({key} || ':' || {r}), 1, 12) AS BIGINT) % n)"
        swap = f"CASE WHEN substr(md5({key} || ':' || k || ':' || greatest(x, o)), 1, 1) >= '8' THEN o ELSE x END"
        rounds = f"SELECT source_index, slot, n, shard, position, {swap} AS x FROM (SELECT *, (k - x + n) % n AS o FROM (SELECT *, {k} AS k FROM ({rounds})))"
    return rf"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
s1 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_index FROM sized GROUP BY source),
s2 AS (SELECT *, [5.0, 2.0, 1.0][(source_index % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM s1),
s3 AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS lv FROM s2
       WINDOW w AS (ORDER BY cap / weight, source_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT source, source_size, source_index, least(weight * (SELECT max(lv) FROM s3), cap) AS target, greatest(1, least({block_words}, ceil(source_size / {LEAST_BLOCKS}.0)))::BIGINT AS w FROM s3),
sources AS (SELECT *, ceil(source_size / w)::BIGINT AS n FROM s4),
a1 AS (SELECT *, CASE WHEN source_size > 0 THEN least(round(n * target / source_size), 2 * n)::BIGINT ELSE 0 END AS wanted FROM sources),
amounts AS (SELECT *, (sum(wanted) OVER (ORDER BY source_index) - wanted)::BIGINT AS before, (sum(wanted) OVER ())::BIGINT AS total FROM a1),
places AS (SELECT g // {SHARD_BLOCKS} AS shard, g % {SHARD_BLOCKS} AS position FROM (SELECT unnest(range((SELECT max(total) FROM amounts))) AS g)),
numbers AS (SELECT shard, position, CAST('0x' || substr(md5('{seed}/shards:' || shard || ':' || position), 1, 12) AS BIGINT) % (SELECT max(total) FROM amounts) AS x FROM places),
picked AS (SELECT shard, position, source_index, wanted, row_number() OVER (PARTITION BY source_index ORDER BY shard, position) - 1 AS slot
           FROM numbers JOIN amounts ON x >= before AND x < before + wanted),
t1 AS (SELECT a.source_index, wanted, coalesce(k, 0) AS k FROM amounts a LEFT JOIN (SELECT source_index, count(*) AS k FROM picked GROUP BY ALL) c ON a.source_index = c.source_index),
totals AS (SELECT *, coalesce(sum(greatest(0, k - wanted)) OVER o, 0) AS surplus, coalesce(sum(greatest(0, wanted - k)) OVER o, 0) AS short FROM t1
           WINDOW o AS (ORDER BY source_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
freed AS (SELECT shard, position, surplus + slot - p.wanted AS f FROM picked p JOIN totals t ON p.source_index = t.source_index WHERE slot >= p.wanted),
filled AS (SELECT source_index, slot, short + slot - k AS f FROM (SELECT *, unnest(range(k, wanted)) AS slot FROM totals WHERE wanted > k)),
chosen AS (SELECT source_index, shard, position, slot FROM picked WHERE slot < wanted UNION ALL SELECT source_index, shard, position, slot FROM filled JOIN freed ON filled.f = freed.f),
slots AS (SELECT c.*, n FROM chosen c JOIN sources s ON c.source_index = s.source_index),
drawn AS (SELECT source_index, x AS block, count(*) AS times, min(shard * {SHARD_BLOCKS} + position) AS place FROM ({rounds}) GROUP BY ALL),
placed AS (SELECT d.doc_id, d.size, a.source_index, a.source_size, a.target, a.w,
       coalesce(sum(d.size) OVER (PARTITION BY a.source_index ORDER BY d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
       FROM sized d JOIN sources a ON d.source IS NOT DISTINCT FROM a.source),
spans AS (SELECT *, unnest(CASE WHEN size > 0 THEN range(start // w, (start + size - 1) // w + 1) ELSE [-1] END) AS block FROM placed)
SELECT s.doc_id, s.size, s.source_size, s.target,
       sum(CASE WHEN s.size > 0 THEN (least(start + s.size, (s.block + 1) * w) - greatest(start, s.block * w)) * coalesce(times, 0) ELSE 0 END)::BIGINT AS taken,
       min(place) // {SHARD_BLOCKS} AS first_shard, min(place) % {SHARD_BLOCKS} AS first_position
FROM spans s LEFT JOIN drawn d ON s.source_index = d.source_index AND s.block = d.block GROUP BY ALL"""
