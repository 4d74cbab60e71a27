"""IRIs split, resolved and made relative in Spark's own expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import iri as iris

NAMES = ("scheme", "authority", "path", "query", "fragment")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once and stands once in the plan, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _after(c: Column, mark: str) -> Column:
    return F.substr(c, F.instr(c, mark) + len(mark))


def split(c: Column) -> Column:
    """A struct of scheme, authority, path, query and fragment of a reference; those that it has not are null, the path is empty."""

    def head(x: Column) -> Column:
        whole, hier = F.substring_index(x, "#", 1), F.substring_index(F.substring_index(x, "#", 1), "?", 1)
        return F.struct(whole.alias("whole"), hier.alias("hier"), F.when(hier.rlike("^[^:/]+:"), _after(hier, ":")).alias("rest"), F.when(x.contains("#"), _after(x, "#")).alias("fragment"))

    def parts(h: Column) -> Column:
        rest = F.coalesce(h["rest"], h["hier"])
        beyond = F.when(rest.startswith("//"), F.substr(rest, F.lit(3)))
        authority = F.substring_index(beyond, "/", 1)
        scheme = F.when(h["rest"].isNotNull(), F.substring_index(h["hier"], ":", 1))
        path = F.coalesce(F.substr(beyond, F.length(authority) + 1), rest)
        query = F.when(h["whole"].contains("?"), _after(h["whole"], "?"))
        return F.when(h["whole"].isNotNull(), F.struct(scheme.alias("scheme"), authority.alias("authority"), path.alias("path"), query.alias("query"), h["fragment"].alias("fragment")))

    return let(let(c, head), parts)


def join(parts: dict[str, Column]) -> Column:
    some = lambda c, before, after="": F.coalesce(F.concat(F.lit(before), c, F.lit(after)), F.lit(""))
    return F.concat(some(parts["scheme"], "", ":"), some(parts["authority"], "//"), parts["path"], some(parts["query"], "?"), some(parts["fragment"], "#"))


def without_dots(path: Column) -> Column:
    """Removal of dot segments, as a fold over the segments."""
    start = F.array().cast("array<string>")

    def step(out: Column, x: Column) -> Column:
        up = F.when(F.size(out) > 1, F.slice(out, F.lit(1), F.greatest(F.lit(0), F.size(out) - 1))).otherwise(out)
        return F.when(x == "..", up).when(x == ".", out).otherwise(F.concat(out, F.array(x)))

    def of(parts: Column) -> Column:
        end = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(start)
        return F.array_join(F.concat(F.aggregate(parts, start, step), end), "/")

    return let(F.split(path, "/", -1), of)


def _resolved(x: Column) -> Column:
    """x: a struct of the parts b of a base and r of a reference."""
    b, r = x["b"], x["r"]
    folder = F.regexp_extract(b["path"], "(?s)^(.*/)", 1)
    path = F.when(r["path"].startswith("/"), r["path"]).when(b["authority"].isNotNull() & (b["path"] == ""), F.concat(F.lit("/"), r["path"])).otherwise(F.concat(folder, r["path"]))
    own = r["scheme"].isNotNull() | r["authority"].isNotNull()
    same = ~own & (r["path"] == "")
    return join({
        "scheme": F.coalesce(r["scheme"], b["scheme"]),
        "authority": F.when(own, r["authority"]).otherwise(b["authority"]),
        "path": F.when(same, b["path"]).otherwise(without_dots(F.when(own, r["path"]).otherwise(path))),
        "query": F.when(same, F.coalesce(r["query"], b["query"])).otherwise(r["query"]),
        "fragment": r["fragment"],
    })


def resolve(base: Column, reference: Column) -> Column:
    """RFC 3986, section 5.2; null if either is."""
    return let(F.struct(split(base).alias("b"), split(reference).alias("r")), lambda x: F.when(x["b"].isNotNull() & x["r"].isNotNull(), _resolved(x)))


def is_absolute(c: Column) -> Column:
    return c.rlike(iris.ABSOLUTE_IRI)


def is_relative(c: Column) -> Column:
    return c.rlike(iris.RELATIVE_IRI)


def _options(x: Column, parents: int) -> Column:
    """References from x.b to x.i (x.target whole), the usual ones, null where they don't apply; x.common: folders that both share."""
    b, i = x["b"], x["i"]
    none = F.lit(None).cast("string")
    nothing = {"scheme": none, "authority": none, "path": F.lit(""), "query": none, "fragment": none}
    tail = join({**nothing, "query": i["query"], "fragment": i["fragment"]})
    near = b["scheme"].eqNullSafe(i["scheme"]) & b["authority"].eqNullSafe(i["authority"])
    here = near & (b["path"] == i["path"])
    up = F.size(x["folders"]) - x["common"]
    path = F.concat(F.repeat(F.lit("../"), up), F.array_join(F.slice(x["own"], x["common"] + 1, F.size(x["own"])), "/"))
    climbs = near & (x["common"] > 0) & (up <= parents)
    far = F.when(i["authority"].isNotNull() & b["scheme"].eqNullSafe(i["scheme"]), join({**{n: i[n] for n in NAMES}, "scheme": none})).otherwise(x["target"])
    return F.array(
        F.when(here & b["query"].eqNullSafe(i["query"]), join({**nothing, "fragment": i["fragment"]})),
        F.when(here, tail),
        F.when(climbs, F.concat(F.when(path == "", F.lit("./")).otherwise(path), tail)),
        F.when(climbs, F.concat(F.lit("./"), path, tail)),
        F.when(near, F.concat(i["path"], tail)),
        far,
    )


def relativize(base: Column, target: Column, parents: int = 0) -> Column:
    """The shortest of the usual references that resolves to target, climbing `parents` folders at most; target itself if there is none."""

    def folders(x: Column) -> Column:
        own, mine = F.split(x["i"]["path"], "/", -1), F.split(x["b"]["path"], "/", -1)
        return F.struct(x["b"].alias("b"), x["i"].alias("i"), x["target"].alias("target"), own.alias("own"), F.slice(mine, F.lit(1), F.size(mine) - 1).alias("folders"))

    def shared(x: Column) -> Column:
        equal = F.zip_with(x["folders"], F.slice(x["own"], F.lit(1), F.size(x["own"]) - 1), lambda p, q: p.eqNullSafe(q))
        common = let(equal, lambda e: F.when(F.array_contains(e, False), F.array_position(e, F.lit(False)).cast("int") - 1).otherwise(F.size(e)))
        return F.struct(*[x[n].alias(n) for n in ("b", "i", "target", "own", "folders")], common.alias("common"))

    def best(x: Column) -> Column:
        fits = lambda r: F.when(is_absolute(r) | is_relative(r), let(F.struct(x["b"].alias("b"), split(r).alias("r")), _resolved)) == x["target"]
        good = F.filter(_options(x, parents), lambda r: r.isNotNull() & F.coalesce(fits(r), F.lit(False)))
        short = F.aggregate(good, F.lit(None).cast("string"), lambda a, r: F.when(a.isNull() | (F.length(r) < F.length(a)), r).otherwise(a))
        return F.coalesce(short, x["target"])

    start = F.struct(split(base).alias("b"), split(target).alias("i"), target.alias("target"))
    return let(let(let(start, folders), shared), best)
