"""Typed columns and the four relations on RDF terms: identity, `=`, `<` and the total order."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..terms import BNODE, INT_TYPES, INTEGER_RANGES, IRI, LITERAL, TRIPLE, XSD, Term, term

# Lexical forms.
INTEGER_FORM = r"^[+-]?[0-9]+$"
DECIMAL_FORM = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"
DOUBLE_FORM = r"^([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?INF|NaN)$"
DATETIME_FORM = r"^-?([1-9][0-9]{4,}|[0-9]{4})-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])T(([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?|24:00:00(\.0+)?)(Z|[+-](0[0-9]|1[0-3]):[0-5][0-9]|[+-]14:00)?$"
_RANKS = {"int": 1, "dec": 2, "flt": 3, "dbl": 4}
_BIG, _DEC = "decimal(38,0)", "decimal(38,18)"


@dataclass
class Typed:
    """A column with its static kind: term (the struct), iri, str, int, dec, flt, dbl, bool, dt (naive timestamp),
    or ref:<prefix> (a key that with the prefix makes an IRI). `const`: the constant it stands for."""

    kind: str
    col: Column
    const: Term | None = None

    @property
    def numeric(self) -> bool:
        return self.kind in _RANKS


def constant(t: Term) -> Typed:
    if t.kind == IRI:
        return Typed("iri", F.lit(t.value), t)
    if t.kind == LITERAL and t.datatype:
        name = t.datatype.removeprefix(XSD)
        try:
            if name == "string":
                return Typed("str", F.lit(t.value), t)
            if name == "integer" and t.value.lstrip("+-").isdigit():
                return Typed("int", F.lit(int(t.value)) if abs(int(t.value)) < 2**62 else F.lit(t.value).cast(_BIG), t)
            if name == "decimal":
                float(t.value)
                return Typed("dec", F.expr(f"try_cast('{float(t.value) if 'e' in t.value.lower() else t.value}' AS {_DEC})"), t)
            if name in ("double", "float") and t.value.lstrip("+-")[:1] in "0123456789.":
                return Typed("dbl" if name == "double" else "flt", F.lit(float(t.value)).cast(name), t)
            if name == "dateTime" and re.match(DATETIME_FORM, t.value) and re.match(r"^[0-9]{4}-.*T(?!24).*[0-9]$", t.value) and not re.search(r"[+-][0-9]{2}:[0-9]{2}$", t.value):
                return Typed("dt", F.lit(t.value).try_cast("timestamp_ntz"), t)
            if name == "boolean" and t.value in ("true", "false"):
                return Typed("bool", F.lit(t.value == "true"), t)
        except ValueError:
            pass
    return Typed("term", t.column(), t)


def decimal_text(d: Column) -> Column:
    text = F.regexp_replace(d.cast(_DEC).cast("string"), r"0+$", "")
    text = F.when(d.cast(_DEC) == 0, "0.").otherwise(text)
    return F.when(text.endswith("."), F.concat(text, F.lit("0"))).otherwise(text)


def double_text(x: Column) -> Column:
    """The form 1.5e0; INF, -INF and NaN."""
    size = F.abs(x)
    plain, minus = size.cast("string"), F.when(x.cast("string").startswith("-"), "-").otherwise("")
    large = F.rtrim(F.replace(plain, F.lit("."), F.lit("")), F.lit("0"))
    small = F.rtrim(F.ltrim(F.replace(plain, F.lit("."), F.lit("")), F.lit("0")), F.lit("0"))
    made = lambda digits, exp: F.concat(minus, F.substring(digits, 1, 1), F.lit("."), F.when(F.length(digits) == 1, "0").otherwise(F.substring(digits, 2, 400)), F.lit("e"), exp.cast("string"))
    # Spark writes numbers from 0.001 to 10,000,000 without an exponent
    exp = F.when(size < 10, 0).when(size < 100, 1).when(size < 1e3, 2).when(size < 1e4, 3).when(size < 1e5, 4).when(size < 1e6, 5).otherwise(6)
    zeros = F.length(plain) - F.length(F.ltrim(F.replace(plain, F.lit("."), F.lit("")), F.lit("0"))) - 1
    return (
        F.when(F.isnan(x), "NaN").when(size.cast("double") == float("inf"), F.concat(minus, F.lit("INF")))
        .when(x == 0, F.concat(minus, F.lit("0.0e0"))).when((size >= 1e7) | (size < 1e-3) | plain.contains("E"), F.concat(minus, F.replace(plain, F.lit("E"), F.lit("e"))))
        .when(size >= 1, made(large, exp)).otherwise(made(small, -zeros))
    )


def datetime_text(ts: Column) -> Column:
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.regexp_replace(F.date_format(ts, "SSSSSS"), "0+$", "")
    # years of four digits are written alike by a cast, which takes a tenth of the time
    usual = (F.year(ts) >= 1) & (F.year(ts) <= 9999)
    return F.when(usual, F.replace(ts.cast("timestamp_ntz").cast("string"), F.lit(" "), F.lit("T"))).otherwise(F.when(micros == "", whole).otherwise(F.concat(whole, F.lit("."), micros)))


def text_of_iri(x: Typed) -> Column:
    return F.concat(F.lit(x.kind[4:]), x.col.cast("string")) if x.kind.startswith("ref:") else x.col


def box(x: Typed) -> Column:
    """The term struct."""
    if x.kind == "term":
        return x.col
    if x.const is not None:
        return x.const.column()
    if x.kind == "iri" or x.kind.startswith("ref:"):
        return F.when(x.col.isNotNull(), term(IRI, text_of_iri(x), given=True))
    texts = {"str": lambda: x.col, "int": lambda: x.col.cast(_BIG).cast("string"), "dec": lambda: decimal_text(x.col), "flt": lambda: double_text(x.col), "dbl": lambda: double_text(x.col), "bool": lambda: x.col.cast("string"), "dt": lambda: datetime_text(x.col)}
    types = {"str": "string", "int": "integer", "dec": "decimal", "flt": "float", "dbl": "double", "bool": "boolean", "dt": "dateTime"}
    if x.kind == "dec":
        return term(LITERAL, texts[x.kind](), XSD + types[x.kind])
    # the text is null where the value is, so that it is made once only
    return F.when(x.col.isNotNull(), term(LITERAL, texts[x.kind](), XSD + types[x.kind], given=True))


def unbox(x: Typed) -> Column:
    """A plain value: text of an IRI, label or literal, or a number, boolean or timestamp."""
    if x.kind == "term":
        return x.col["v"]
    if x.kind.startswith("ref:"):
        return text_of_iri(x)
    return x.col.cast("bigint") if x.kind == "int" else x.col.cast("double") if x.kind in ("dec", "flt") else x.col


def rank_of(t: Column) -> Column:
    """1 integer, 2 decimal, 3 float, 4 double; null if no well-formed number."""
    n = t["v"].try_cast(_BIG)
    low, high = F.lit(None).cast(_BIG), F.lit(None).cast(_BIG)
    bounds = lambda k: [(XSD + name, r[k]) for name, r in INTEGER_RANGES.items() if r[k] is not None]
    for k in (0, 1):
        chosen = None
        for name, bound in bounds(k):
            value = F.lit(str(bound)).cast(_BIG)
            chosen = F.when(t["d"] == name, value) if chosen is None else chosen.when(t["d"] == name, value)
        low, high = (chosen, high) if k == 0 else (low, chosen)
    whole = t["d"].isin(INT_TYPES) & t["v"].rlike(INTEGER_FORM) & F.coalesce(n >= low, F.lit(True)) & F.coalesce(n <= high, F.lit(True))
    real = t["v"].rlike(DOUBLE_FORM)
    return F.when(whole, 1).when((t["d"] == XSD + "decimal") & t["v"].rlike(DECIMAL_FORM), 2).when((t["d"] == XSD + "float") & real, 3).when((t["d"] == XSD + "double") & real, 4)


def _double(text: Column) -> Column:
    special = F.regexp_replace(F.regexp_replace(text, r"INF$", "Infinity"), r"^\+Inf", "Inf")
    return special.try_cast("double")


@dataclass
class Number:
    """rank, value as decimal (ranks 1 and 2 that fit) and value as double."""

    rank: Column
    dec: Column
    dbl: Column
    static: int | None


def number(x: Typed) -> Number:
    none = F.lit(None)
    if x.numeric:
        r = _RANKS[x.kind]
        dec = x.col.cast(_BIG if r == 1 else _DEC) if r <= 2 else none.cast(_DEC)
        return Number(F.when(x.col.isNotNull(), r), dec, x.col.cast("double"), r)
    if x.kind != "term":
        return Number(none.cast("int"), none.cast(_DEC), none.cast("double"), None)
    r = rank_of(x.col)
    return Number(r, F.when(r <= 2, x.col["v"].try_cast(_DEC)), F.when(r.isNotNull(), F.when(r == 3, _double(x.col["v"]).cast("float").cast("double")).otherwise(_double(x.col["v"]))), None)


def numeric_term(rank: Column, integer: Column, dec: Column, dbl: Column) -> Column:
    kind = lambda name: F.lit(XSD + name)
    text = F.when(rank == 1, integer.cast(_BIG).cast("string")).when(rank == 2, decimal_text(dec)).when(rank == 3, double_text(dbl.cast("float"))).when(rank == 4, double_text(dbl))
    return term(LITERAL, text, F.when(rank == 1, kind("integer")).when(rank == 2, kind("decimal")).when(rank == 3, kind("float")).otherwise(kind("double")))


def arithmetic(op: str, a: Typed, b: Typed) -> Typed:
    """+ - * / with promotion integer, decimal, float, double; errors are null."""
    x, y = number(a), number(b)
    tried = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}

    def fit(c: Column, to: str) -> Column:
        return c.try_cast(to)

    def on_int() -> Column:
        return fit(tried[op](fit(x.dec, _BIG), fit(y.dec, _BIG)), _BIG)

    def on_dec() -> Column:
        if op == "/":
            # the narrower the operands, the more digits Spark keeps behind the point
            whole = lambda d: F.when(d == fit(d, "decimal(20,0)"), fit(d, "decimal(20,0)"))
            ways = [F.try_divide(whole(x.dec), whole(y.dec)), *[F.try_divide(fit(F.when(fit(x.dec, t) == x.dec, x.dec), t), fit(F.when(fit(y.dec, t) == y.dec, y.dec), t)) for t in ("decimal(24,8)", _DEC)]]
            return F.coalesce(*[fit(w, _DEC) for w in ways])
        return fit(tried[op](fit(x.dec, "decimal(28,10)"), fit(y.dec, "decimal(28,10)")) if op == "*" else tried[op](fit(x.dec, _DEC), fit(y.dec, _DEC)), _DEC)

    def on_dbl() -> Column:
        if op != "/":
            return {"+": x.dbl + y.dbl, "-": x.dbl - y.dbl, "*": x.dbl * y.dbl}[op]
        inf = F.lit(float("inf"))
        zero = F.when(F.isnan(x.dbl) | (x.dbl == 0), F.lit(float("nan"))).when(x.dbl > 0, inf).otherwise(-inf)
        return F.when(x.dbl.isNotNull(), F.when(y.dbl == 0, zero).otherwise(F.try_divide(x.dbl, y.dbl)))

    if x.static and y.static:
        r = max(x.static, y.static)
        if r == 1 and op != "/":
            return Typed("int", on_int())
        return Typed("dec", on_dec()) if r <= 2 else Typed("flt", on_dbl().cast("float")) if r == 3 else Typed("dbl", on_dbl())
    r = F.when(x.rank.isNotNull() & y.rank.isNotNull(), F.greatest(x.rank, y.rank))
    if op == "/":
        r = F.when(r == 1, 2).otherwise(r)
    return Typed("term", numeric_term(r, on_int() if op != "/" else F.lit(None), on_dec(), on_dbl()))


def negate(x: Typed) -> Typed:
    return arithmetic("-", Typed("int", F.lit(0)), x) if x.kind not in ("dbl", "flt") else Typed(x.kind, -x.col)


def moment(t: Column) -> tuple[Column, Column]:
    """(instant as if UTC where no zone is given, zoned?) of a dateTime term; null if ill-formed."""
    v = F.when((t["d"] == XSD + "dateTime") & t["v"].rlike(DATETIME_FORM), t["v"])
    zone = F.regexp_extract(v, r"(Z|[+-][0-9]{2}:[0-9]{2})$", 1)
    local = F.regexp_replace(v, r"(Z|[+-][0-9]{2}:[0-9]{2})$", "")
    late = local.contains("T24:00:00")
    ts = F.replace(local, F.lit("T24:"), F.lit("T00:")).try_cast("timestamp_ntz")
    ts = F.when(late, ts + F.expr("INTERVAL 1 DAY")).otherwise(ts)
    minutes = F.when(zone.isin("", "Z"), 0).otherwise(F.concat(zone.substr(1, 1), F.lit("1")).try_cast("int") * (zone.substr(2, 2).try_cast("int") * 60 + zone.substr(5, 2).try_cast("int")))
    return ts - F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"), F.lit(0)), zone != ""


def class_of(t: Column) -> Column:
    """n number, s string, l tagged string, b boolean, t dateTime; null: unknown or ill-formed."""
    b = (t["d"] == XSD + "boolean") & t["v"].isin("true", "false", "0", "1")
    return F.when(t["k"] != LITERAL, None).when(t["l"].isNotNull(), "l").when(t["d"] == XSD + "string", "s").when(rank_of(t).isNotNull(), "n").when(b, "b").when(moment(t)[0].isNotNull(), "t")


def _ordered(op: str, a: Column, b: Column) -> Column:
    return {"=": a == b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]


def _numbers(op: str, a: Typed, b: Typed) -> Column:
    x, y = number(a), number(b)
    if x.static and y.static:
        if a.kind == b.kind and max(x.static, y.static) <= 2:
            return _ordered(op, a.col, b.col)
        both = _ordered(op, x.dbl, y.dbl)
    else:
        both = None
    if both is None or max(x.static or 0, y.static or 0) <= 2:
        # in one decimal type: Spark would round decimals of 18 places to compare them with whole ones of 38 digits
        both = F.coalesce(_ordered(op, x.dec.try_cast(_DEC), y.dec.try_cast(_DEC)), _ordered(op, x.dbl, y.dbl))
    return both if op == "=" else F.when(~(F.isnan(x.dbl) | F.isnan(y.dbl)), both)


def _with_plain(op: str, a: Typed, b: Typed) -> Column:
    """A term against a number, string, boolean or IRI of known type."""
    t = a.col
    if b.kind == "iri" or b.kind.startswith("ref:"):
        same = (t["k"] == IRI) & (t["v"] == text_of_iri(b))
        return same if op == "=" else F.when(same, F.lit(None).cast("boolean"))
    if b.kind == "str":
        mine, test = t["d"] == XSD + "string", _ordered(op, t["v"], b.col)
    elif b.kind == "bool":
        mine, test = (t["d"] == XSD + "boolean") & t["v"].isin("true", "false", "0", "1"), _ordered(op, t["v"].isin("true", "1"), b.col)
    else:
        mine, test = number(a).rank.isNotNull(), _numbers(op, a, b)
    mine = (t["k"] == LITERAL) & F.coalesce(mine, F.lit(False))
    if op != "=":
        return F.when(mine, test)
    return F.when(t.isNotNull() & b.col.isNotNull(), F.when(mine, test).when((t["k"] != LITERAL) | class_of(t).isNotNull(), F.lit(False)))


def compare(op: str, a: Typed, b: Typed) -> Column:
    """SPARQL = < > <= >=; null is an error."""
    resource = lambda x: x.kind == "iri" or x.kind.startswith("ref:")
    if a.numeric and b.numeric:
        return _numbers(op, a, b)
    if a.kind == b.kind and a.kind in ("str", "bool", "dt"):
        return _ordered(op, a.col, b.col)
    if resource(a) and resource(b):
        if op != "=":
            return F.when(text_of_iri(a) == text_of_iri(b), F.lit(None).cast("boolean"))
        return a.col == b.col if a.kind == b.kind else text_of_iri(a) == text_of_iri(b)
    if op != "=" and (a.numeric or b.numeric) and "term" in (a.kind, b.kind):
        return _numbers(op, a, b)
    if "term" not in (a.kind, b.kind):
        missing = a.col.isNull() | b.col.isNull()
        return F.when(~missing, F.lit(False) if op == "=" else F.lit(None).cast("boolean"))
    if a.kind != "term" and a.kind != "dt":
        return _with_plain({"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(op, op), b, a)
    if b.kind != "term" and b.kind != "dt":
        return _with_plain(op, a, b)
    x, y = box(a), box(b)
    tx, ty = Typed("term", x), Typed("term", y)
    cx, cy = class_of(x), class_of(y)
    (mx, zx), (my, zy) = moment(x), moment(y)
    day = F.expr("INTERVAL 14 HOURS")
    apart = F.when(zx == zy, _ordered(op, mx, my)).when(mx + day < my, _ordered(op, F.lit(0), F.lit(1))).when(my + day < mx, _ordered(op, F.lit(1), F.lit(0)))
    booleans = _ordered(op, x["v"].isin("true", "1"), y["v"].isin("true", "1"))
    tagged = F.struct(x["l"], x["v"]), F.struct(y["l"], y["v"])
    by_class = F.when(cx == "n", _numbers(op, tx, ty)).when(cx == "s", _ordered(op, x["v"], y["v"])).when(cx == "b", booleans).when(cx == "t", apart)
    same = x.eqNullSafe(y)
    bound = x.isNotNull() & y.isNotNull()
    if op == "=":
        by_class = by_class.when(cx == "l", F.lit(False))
        other = F.when((x["k"] < LITERAL) | (y["k"] < LITERAL) | (x["k"] != y["k"]), F.lit(False)).when(x["k"] == TRIPLE, F.lit(False)).when(cx.isNull() | cy.isNull(), F.lit(None).cast("boolean")).when(cx != cy, F.lit(False)).otherwise(by_class)
        return F.when(bound, F.when(same, F.lit(True)).otherwise(other))
    by_class = by_class.when(cx == "l", _ordered(op, *tagged))
    literals = (x["k"] == LITERAL) & (y["k"] == LITERAL)
    return F.when(bound & literals, F.when(same & (cx.isNull()), F.lit(op in ("<=", ">="))).when(cx == cy, by_class))


def condition(op: str, a: Typed, b: Typed) -> Column | None:
    """A comparison of numbers of known types where errors count as false, in a form that scans can use; None for others."""
    if not (a.numeric and b.numeric) or op not in ("<", ">", "<=", ">=") or (a.kind != b.kind and {"int", "dec"} == {a.kind, b.kind}):
        return None
    out = _ordered(op, a.col, b.col)
    # Spark takes NaN for the greatest number
    for x, greater in ((a, op[0] == ">"), (b, op[0] == "<")):
        if greater and x.kind in ("dbl", "flt") and x.const is None:
            out = out & ~F.isnan(x.col)
    return out


def ebv(x: Typed) -> Column:
    """Effective boolean value; null is an error."""
    if x.kind == "bool":
        return x.col
    if x.kind == "str":
        return x.col != ""
    if x.numeric:
        return (x.col != 0) & ~F.isnan(x.col.cast("double"))
    if x.kind != "term":
        return F.lit(None).cast("boolean")
    c, n = class_of(x.col), number(x)
    return F.when(c == "b", x.col["v"].isin("true", "1")).when(c == "s", x.col["v"] != "").when(c == "n", (n.dbl != 0) & ~F.isnan(n.dbl))


def same_term(a: Typed, b: Typed) -> Column:
    if a.kind == b.kind and a.kind != "term" and a.const is None and b.const is None:
        return a.col == b.col
    x, y = box(a), box(b)
    return F.when(x.isNotNull() & y.isNotNull(), x.eqNullSafe(y))


def order_key(x: Typed) -> Column:
    """A sortable column: unbound first, then blank nodes, IRIs, literals by class and value, triple terms."""
    if x.kind.startswith("ref:"):
        return text_of_iri(x)
    if x.kind != "term":
        return x.col
    t, n = x.col, number(x)
    c = class_of(t)
    place = F.when(c == "n", 1).when(c == "s", 2).when(c == "l", 3).when(c == "b", 4).when(c == "t", 5).otherwise(F.when(t["k"] == LITERAL, 6).otherwise(0))
    return F.when(t.isNotNull(), F.struct(t["k"].alias("k"), place.alias("c"), n.dbl.alias("n"), F.when(c == "t", moment(t)[0]).alias("t"), F.coalesce(F.when(place == 6, t["d"]), t["l"], F.lit("")).alias("l"), t["v"].alias("v"), F.coalesce(t["d"], F.lit("")).alias("d"), F.coalesce(t["r"], F.lit("~")).alias("r")))


def unified(a: Typed, b: Typed) -> tuple[Typed, Typed]:
    """Both sides in one kind, for joins, unions and conditionals."""
    if a.kind == b.kind:
        return a, b
    resource = lambda x: x.kind == "iri" or x.kind.startswith("ref:")
    if resource(a) and resource(b):
        return Typed("iri", text_of_iri(a)), Typed("iri", text_of_iri(b))
    return Typed("term", box(a)), Typed("term", box(b))


__all__ = ["BNODE", "INT_TYPES", "Typed", "arithmetic", "box", "compare", "constant", "ebv", "negate", "number", "order_key", "same_term", "text_of_iri", "unbox", "unified"]
