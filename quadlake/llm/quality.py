"""Quality rules as a short-circuit cascade, ordered by rejection per cost as measured on a sample."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, materialize

WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """`reject` is true of bad documents; it sees the columns of base_counts and `text`. Null counts as false."""

    name: str
    reject: Column


def default_rules() -> list[Rule]:
    words = F.filter(F.split("text", SPACES + "+"), lambda w: w != "")
    letters = F.length(F.regexp_replace("text", r"\P{L}", ""))
    capitals = F.length(F.regexp_replace("text", r"\P{Lu}", ""))
    return [
        Rule("symbols", F.col("n_symbols") * 2 > F.col("n_words")),
        Rule("repeated_lines", F.col("n_dup_lines") * 10 > F.col("n_lines") * 3),
        Rule("word_length", (F.col("word_chars") > F.col("n_words") * 15) | (F.col("word_chars") < F.col("n_words") * 2)),
        Rule("few_letters", letters * 10 < F.col("word_chars") * 6),
        Rule("capitals", capitals * 2 > letters),
        Rule("few_distinct_words", F.size(F.array_distinct(words)) * 20 < F.col("n_words")),
    ]


def base_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, text, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words for each row of docs.

    Null text has no words. n_repeat_words are the words in windows of eight that occur twice or more in the text.
    Windows are compared by a 64-bit hash of their words' 64-bit hashes. A document's arrays stay within its row: nothing
    is shuffled, and the sort is made only for documents that repeat a window.
    """
    raw = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    split = raw.select(
        "*",
        F.transform(F.filter(F.split("text", SPACES + "+"), lambda w: w != ""), lambda w: F.xxhash64(w)).alias("_h"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    counted = split.select(
        "doc_id",
        "text",
        "_h",
        F.size("_h").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
    )
    window = lambda i: F.xxhash64(*[F.col("_h")[i + k] for k in range(WINDOW)])
    none = F.array().cast("array<bigint>")
    hashed = counted.withColumn("_w", F.when(F.col("n_words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("_h") - WINDOW), window)).otherwise(none)).drop("_h")
    ordered = hashed.withColumn("_s", F.when(F.size(F.array_distinct("_w")) < F.size("_w"), F.array_sort(F.transform("_w", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_w")
    s, n = F.col("_s"), F.size("_s")
    again = lambda x, k: ((k > 0) & (s[F.greatest(k - 1, F.lit(0))]["h"] == x["h"])) | ((k < n - 1) & (s[F.least(k + 1, n - 1)]["h"] == x["h"]))
    at = F.sort_array(F.transform(F.filter("_s", again), lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    cover = F.aggregate(at, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    return ordered.withColumn("n_repeat_words", F.coalesce(cover, F.lit(0)).cast("long")).drop("_s")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


#: Rounds over the sample in which a rule's cost is measured.
_ROUNDS = 4


def _seconds(sample: DataFrame, reject: Column) -> float:
    """How long reject takes for _ROUNDS rounds over the sample, after a first run."""
    rows = sample.withColumn("_time", F.explode(F.sequence(F.lit(1), F.lit(_ROUNDS)))).agg(F.count_if(reject), F.max("_time"))
    rows.first()
    began = time.perf_counter()
    rows.first()
    return time.perf_counter() - began


def ordered_rules(sample: DataFrame, rules: list[Rule]) -> list[tuple[Rule, float, float]]:
    """(rule, share rejected of the rows that reach it, seconds a row), best rejection per cost first. `sample` is a small written table of base counts.

    A rule's cost is what its run takes beyond that of an empty rule. Then the rule that rejects most per cost of the rows left comes next, and its rows go.
    The order changes the time a cascade takes, never its verdict.
    """
    if not rules:
        return []
    n = max(1, sample.count())
    empty = _seconds(sample, F.col("n_words") < 0)
    costs = [max(_seconds(sample, r.reject) - empty, 1e-4) / (_ROUNDS * n) for r in rules]
    flags = [F.coalesce(r.reject, F.lit(False)).alias(f"_f{k}") for k, r in enumerate(rules)]
    kinds = [(tuple(r)[:-1], r["count"]) for r in sample.select(*flags).groupBy(*[f"_f{k}" for k in range(len(rules))]).count().collect()]
    found, left = [], set(range(len(rules)))
    while left:
        reached = max(1, sum(c for _, c in kinds))
        share = {k: sum(c for f, c in kinds if f[k]) / reached for k in left}
        best = min(left, key=lambda k: (-share[k] / costs[k], costs[k], rules[k].name))
        found.append((rules[best], share[best], costs[best]))
        left.remove(best)
        kinds = [(f, c) for f, c in kinds if not f[best]]
    return found


def cascade(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects, else null; rules after it are not evaluated."""
    if not rules:
        return F.lit(None).cast("string")
    out = F.when(rules[0].reject, rules[0].name)
    for rule in rules[1:]:
        out = out.when(rule.reject, rule.name)
    return out


def quality_filter(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rules: list[Rule] | None = None, sample_rows: int = 2000) -> DataFrame:
    """Base counts of each row with base_failed, failed_rule and kept.

    Rules default to default_rules(). Costs and selectivities come from about sample_rows rows less those that the base rule rejects, taken by a hash of
    doc_id; every row gets a verdict from all rules. Null and empty texts fail the base rule. Repeated rows get equal
    verdicts. Other columns of docs are ignored. An empty table gives an empty result.
    """
    rules = default_rules() if rules is None else rules
    rows = docs.count()
    share = min(1.0, sample_rows / max(1, rows))
    some = docs.where(F.pmod(F.xxhash64(F.col(doc_id), F.lit(11)), F.lit(1 << 40)) < F.lit(share * (1 << 40)))
    measured = ordered_rules(materialize(base_counts(some, text, doc_id), "sample").where(~base_failed()), rules)
    out = base_counts(docs, text, doc_id).withColumn("base_failed", base_failed())
    out = out.withColumn("failed_rule", F.when(F.col("base_failed"), "base").otherwise(cascade([r for r, _, _ in measured])))
    return out.withColumn("kept", F.col("failed_rule").isNull())
