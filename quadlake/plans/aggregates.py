"""Aggregates beyond SPARQL's own, for `Engine(aggregates=...)`: an IRI stands for a callable on a typed column and whether DISTINCT was asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.values import Typed, box, number

Custom = Callable[[Typed, bool], Typed]


def over_numbers(f: Callable[[Column], Column]) -> Custom:
    """An aggregate of Spark over numbers as doubles; unbound for a group with another value, as SUM is, or without values."""

    def run(x: Typed, distinct: bool) -> Typed:
        if distinct:
            raise ValueError("DISTINCT is not there for this aggregate")
        n = number(x)
        return Typed("dbl", F.when(F.count_if(n.rank.isNull()) == 0, f(n.dbl)))

    return run


def over_terms(f: Callable[[Column], Column], kind: str) -> Custom:
    """An aggregate of Spark over terms, unbound ones left out; its result has the kind `kind` (int, dbl, bool, str or term)."""
    return lambda x, distinct: Typed(kind, f(box(x)))


def unbound(x: Typed, distinct: bool) -> Typed:
    """What an aggregate without a meaning gives: nothing for any group."""
    return Typed("int", F.max(F.lit(None).cast("bigint")))


def statistics(prefix: str) -> dict[str, Custom]:
    """median, variance and deviation (of samples), skewness, kurtosis, approximate_count and mode (the least of the most frequent), each below a prefix."""
    numbers = {"median": F.median, "variance": F.var_samp, "deviation": F.stddev_samp, "skewness": F.skewness, "kurtosis": F.kurtosis}
    out = {prefix + name: over_numbers(f) for name, f in numbers.items()}
    out[prefix + "approximate_count"] = over_terms(lambda t: F.approx_count_distinct(t), "int")
    out[prefix + "mode"] = over_terms(lambda t: F.mode(t, deterministic=True), "term")
    return out


__all__ = ["Custom", "over_numbers", "over_terms", "statistics", "unbound"]
