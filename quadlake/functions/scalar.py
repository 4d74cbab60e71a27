"""SPARQL's scalar functions and casts on typed columns; a null result is an error."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import iri as iris
from ..terms import BNODE, IRI, LITERAL, RDF, TRIPLE, XSD, canonical_column, parts_column, term
from .iris import is_relative, resolve
from .values import DATETIME_FORM, Typed, box, class_of, compare, decimal_text, moment, number, numeric_term, rank_of, same_term, text_of_iri


class Text:
    """A string argument: text with language and direction (null where plain); text is null for all but strings."""

    def __init__(self, x: Typed):
        none = F.lit(None).cast("string")
        if x.kind == "str":
            self.text, self.lang, self.dir, self.plain = x.col, none, none, True
        elif x.kind == "term":
            ok = (x.col["k"] == LITERAL) & ((x.col["d"] == XSD + "string") | x.col["l"].isNotNull())
            self.text, self.lang, self.dir, self.plain = F.when(ok, x.col["v"]), x.col["l"], x.col["r"], False
        else:
            self.text, self.lang, self.dir, self.plain = none, none, none, True

    def like(self, text: Column) -> Typed:
        """Other text with this language."""
        if self.plain:
            return Typed("str", text)
        return Typed("term", term(LITERAL, text, F.when(self.lang.isNull(), XSD + "string"), self.lang, self.dir))

    def takes(self, other: Text) -> Column:
        """Whether `other` may be compared with this string: plain, or of the same language and direction."""
        if other.plain:
            return F.lit(True)
        return other.lang.isNull() | (other.lang.eqNullSafe(self.lang) & other.dir.eqNullSafe(self.dir))


def _pair(a: Typed, b: Typed, f: Callable[[Column, Column], Column]) -> Column:
    x, y = Text(a), Text(b)
    return F.when(x.text.isNotNull() & y.text.isNotNull() & x.takes(y), f(x.text, y.text))


def _is_resource(x: Typed) -> bool:
    return x.kind == "iri" or x.kind.startswith("ref:")


def _native(x: Typed) -> bool:
    return x.kind != "term" and not _is_resource(x)


def str_(x: Typed) -> Typed:
    if _is_resource(x):
        return Typed("str", text_of_iri(x))
    t = box(x)
    return x if x.kind == "str" else Typed("str", F.when(t["k"].isin(IRI, LITERAL), t["v"]))


def _literal_field(x: Typed, field: str) -> Typed:
    if _native(x):
        return Typed("str", F.when(x.col.isNotNull(), ""))
    t = box(x)
    return Typed("str", F.when(t["k"] == LITERAL, F.coalesce(t[field], F.lit(""))))


def datatype(x: Typed) -> Typed:
    t = box(x)
    tagged = F.when(t["r"].isNotNull(), RDF + "dirLangString").when(t["l"].isNotNull(), RDF + "langString").otherwise(t["d"])
    return Typed("iri", F.when(t["k"] == LITERAL, tagged))


def iri_of(base: str | None) -> Callable[[Typed], Typed]:
    def make(x: Typed) -> Typed:
        if _is_resource(x):
            return x
        t = box(x)
        text = F.when((t["k"] == IRI) | ((t["k"] == LITERAL) & (t["d"] == XSD + "string")), t["v"])
        good = F.when(text.rlike(iris.ABSOLUTE), text)
        if base is None:
            return Typed("iri", good)

        return Typed("iri", F.coalesce(good, F.when(is_relative(text), resolve(F.lit(base), text))))

    return make


def _rounded(x: Typed, f: Callable[[Column], Column]) -> Typed:
    if x.kind == "int":
        return Typed("int", f(x.col)) if f is F.abs else x
    if x.kind == "dec":
        return Typed("dec", f(x.col).cast("decimal(38,18)"))
    n = number(x)
    keep = F.isnan(n.dbl) | (F.abs(n.dbl) > 9e15)
    made = n.dbl if f is None else F.when(keep, F.abs(n.dbl) if f is F.abs else n.dbl).otherwise(f(n.dbl).cast("double"))
    if x.kind in ("dbl", "flt"):
        return Typed(x.kind, made.cast("double" if x.kind == "dbl" else "float"))
    dec = f(n.dec).cast("decimal(38,18)")
    return Typed("term", numeric_term(n.rank, dec.cast("decimal(38,0)"), dec, made))



def _round(x: Typed) -> Typed:
    if x.kind == "int":
        return x
    n = number(x)
    if x.kind == "dec":
        return Typed("dec", F.round(x.col, 0).cast("decimal(38,18)"))
    dbl = F.when(F.isnan(n.dbl) | (F.abs(n.dbl) > 9e15), n.dbl).otherwise(F.signum(n.dbl) * F.floor(F.abs(n.dbl) + 0.5))
    if x.kind in ("dbl", "flt"):
        return Typed(x.kind, dbl.cast("double" if x.kind == "dbl" else "float"))
    dec = F.round(n.dec, 0).cast("decimal(38,18)")
    return Typed("term", numeric_term(n.rank, dec.cast("decimal(38,0)"), dec, dbl))


def concat(*xs: Typed) -> Typed:
    if not xs:
        return Typed("str", F.lit(""))
    texts = [Text(x) for x in xs]
    joined = F.concat(*[t.text for t in texts])
    if all(t.plain for t in texts):
        return Typed("str", joined)
    same = F.lit(True)
    for t in texts[1:]:
        same = same & t.lang.eqNullSafe(texts[0].lang) & t.dir.eqNullSafe(texts[0].dir)
    lang, direction = F.when(same, texts[0].lang), F.when(same, texts[0].dir)
    return Typed("term", term(LITERAL, joined, F.when(lang.isNull(), XSD + "string"), lang, direction))


def langmatches(a: Typed, b: Typed) -> Typed:
    def f(tag: Column, wanted: Column) -> Column:
        low, w = F.lower(tag), F.lower(wanted)
        valid = tag.rlike(iris.LANG_TAG)
        return F.when(w == "*", valid).otherwise(valid & ((low == w) | F.startswith(low, F.concat(w, F.lit("-")))))

    return Typed("bool", _pair(a, b, f))


def substr(x: Typed, start: Typed, length: Typed | None = None) -> Typed:
    """XPath's substring: positions p with round(start) <= p < round(start) + round(length)."""
    t, s = Text(x), number(start)
    half = lambda d: F.floor(d + 0.5)
    first = half(s.dbl)
    if length is None:
        end = F.lit(2.0**31 - 2)
        bad = F.isnan(s.dbl)
    else:
        n = number(length)
        end, bad = first + half(n.dbl), F.isnan(s.dbl) | F.isnan(n.dbl)
    low = F.greatest(first, F.lit(1))
    size = F.greatest(F.least(end, F.lit(2.0**31 - 2)) - low, F.lit(0))
    return t.like(F.when(~bad, F.substring(t.text, low.cast("int"), size.cast("int"))))


def _flags(flags: Typed | None) -> str | None:
    """Inline flags of a constant argument; None if one is not known."""
    if flags is None:
        return ""
    given = flags.const.value if flags.const is not None else None
    return None if given is None or set(given) - set("smix") else "".join(sorted(set(given)))


def _pattern(p: Typed, flags: Typed | None) -> Column:
    """The pattern with its flags; null if it is not allowed: look-around and back references are not."""
    inline = _flags(flags)
    text = Text(p).text
    if inline is None:
        return F.lit(None).cast("string")
    if p.const is not None:
        try:
            re.compile(re.sub(r"\\[pP]\{\w+\}|\\[pP]\w", ".", p.const.value))
        except re.error:
            return F.lit(None).cast("string")
    allowed = F.when(~text.rlike(r"\(\?[=!<]|\\[1-9]"), text)
    return F.concat(F.lit(f"(?{inline})"), allowed) if inline else allowed


def regex(x: Typed, p: Typed, flags: Typed | None = None) -> Typed:
    return Typed("bool", F.regexp_like(Text(x).text, _pattern(p, flags)))


def replace(x: Typed, p: Typed, r: Typed, flags: Typed | None = None) -> Typed:
    t, pattern = Text(x), _pattern(p, flags)
    made = F.regexp_replace(t.text, pattern, Text(r).text)
    return t.like(F.when(~F.regexp_like(F.lit(""), pattern), made))


def encode_for_uri(x: Typed) -> Typed:
    text = F.url_encode(Text(x).text)
    for a, b in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return Typed("str", text)


def _around(x: Typed, y: Typed, after: bool) -> Typed:
    a, b = Text(x), Text(y)
    at = F.position(b.text, a.text)
    part = F.substring(a.text, at + F.length(b.text), F.lit(2**31 - 1)) if after else F.substring(a.text, F.lit(1), at - 1)
    empty_of = F.when(b.text == "", a.text if after else F.lit("")).otherwise(part)
    ok = a.text.isNotNull() & b.text.isNotNull() & a.takes(b)
    found = (at > 0) | (b.text == "")
    if a.plain:
        return Typed("str", F.when(ok, F.when(found, empty_of).otherwise("")))
    return Typed("term", F.when(ok, F.when(found, box(a.like(empty_of))).otherwise(term(LITERAL, F.lit(""), XSD + "string"))))


def _field(x: Typed, i: int, native: Callable[[Column], Column]) -> Typed:
    if x.kind == "dt":
        return Typed("int", native(x.col).cast("bigint"))
    t = box(x)
    v = F.when((t["d"] == XSD + "dateTime") & t["v"].rlike(DATETIME_FORM), t["v"])
    at = F.regexp_extract(v, r"^(-?\d+)-(\d\d)-(\d\d)T(\d\d):(\d\d):", i).try_cast("bigint")
    if i <= 4:  # 24:00:00 is the next day
        late = F.replace(F.regexp_replace(v, r"(Z|[+-]\d\d:\d\d)$", ""), F.lit("T24:"), F.lit("T00:")).try_cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")
        at = F.when(v.contains("T24:"), native(late).cast("bigint")).otherwise(at)
    return Typed("int", at)


def seconds(x: Typed) -> Typed:
    if x.kind == "dt":
        return Typed("dec", (F.second(x.col) + F.date_format(x.col, "SSSSSS").cast("decimal(38,18)") / 1000000).cast("decimal(38,18)"))
    t = box(x)
    v = F.when((t["d"] == XSD + "dateTime") & t["v"].rlike(DATETIME_FORM), t["v"])
    return Typed("dec", F.regexp_extract(v, r":(\d\d(?:\.\d+)?)(?:Z|[+-]\d\d:\d\d)?$", 1).try_cast("decimal(38,18)"))


def _zone(x: Typed) -> Column:
    t = box(x)
    return F.regexp_extract(F.when((t["d"] == XSD + "dateTime") & t["v"].rlike(DATETIME_FORM), t["v"]), r"(Z|[+-]\d\d:\d\d)$", 1)


def timezone(x: Typed) -> Typed:
    z = _zone(x)
    h, m = z.substr(2, 2).try_cast("int"), z.substr(5, 2).try_cast("int")
    sign = F.when(z.startswith("-") & ((h > 0) | (m > 0)), "-").otherwise("")
    hours, minutes = F.when(h > 0, F.concat(h.cast("string"), F.lit("H"))).otherwise(""), F.when(m > 0, F.concat(m.cast("string"), F.lit("M"))).otherwise("")
    text = F.when(z == "", None).when((z == "Z") | ((h == 0) & (m == 0)), "PT0S").otherwise(F.concat(sign, F.lit("PT"), hours, minutes))
    return Typed("term", term(LITERAL, text, XSD + "dayTimeDuration"))


def _digest(f: Callable[[Column], Column]) -> Callable[[Typed], Typed]:
    def make(x: Typed) -> Typed:
        t = Text(x)
        plain = t.text if t.plain else F.when(t.lang.isNull(), t.text)
        return Typed("str", f(plain.cast("binary")))

    return make


def _plain(x: Typed) -> Column:
    t = Text(x)
    return t.text if t.plain else F.when(t.lang.isNull(), t.text)


def strlang(x: Typed, tag: Typed) -> Typed:
    return Typed("term", term(LITERAL, F.when(_plain(tag).rlike(iris.LANG_TAG), _plain(x)), None, F.lower(_plain(tag))))


def strlangdir(x: Typed, tag: Typed, direction: Typed) -> Typed:
    ok = _plain(tag).rlike(iris.LANG_TAG) & _plain(direction).isin("ltr", "rtl")
    return Typed("term", term(LITERAL, F.when(ok, _plain(x)), None, F.lower(_plain(tag)), _plain(direction)))


def strdt(x: Typed, kind: Typed) -> Typed:
    t = box(kind)
    name = F.when((t["k"] == IRI) & ~t["v"].isin(RDF + "langString", RDF + "dirLangString"), t["v"])
    return Typed("term", term(LITERAL, F.when(name.isNotNull(), _plain(x)), name))


def _is(x: Typed, kind: int) -> Typed:
    if _is_resource(x):
        return Typed("bool", F.when(x.col.isNotNull(), F.lit(kind == IRI)))
    if x.kind != "term":
        return Typed("bool", F.when(x.col.isNotNull(), F.lit(kind == LITERAL)))
    return Typed("bool", x.col["k"] == kind)


def isnumeric(x: Typed) -> Typed:
    if x.kind != "term":
        return Typed("bool", F.when(x.col.isNotNull(), F.lit(x.numeric)))
    return Typed("bool", F.when(x.col.isNotNull(), rank_of(x.col).isNotNull()))


def triple(s: Typed, p: Typed, o: Typed) -> Typed:
    a, b, c = box(s), box(p), box(o)
    ok = a["k"].isin(IRI, BNODE) & (b["k"] == IRI)
    text = F.concat(F.lit("<<( "), canonical_column(a), F.lit(" "), canonical_column(b), F.lit(" "), canonical_column(c), F.lit(" )>>"))
    return Typed("term", term(TRIPLE, F.when(ok, text)))


def part_of(t: Column, i: int) -> Column:
    """Subject, predicate or object of a triple term."""
    return F.get(parts_column(t), F.lit(i))


def to_boolean(x: Typed) -> Typed:
    if x.kind == "bool":
        return x
    n, t = number(x), box(x)
    text = F.trim(t["v"])
    plain = (t["d"] == XSD + "string") | (class_of(t) == "b")
    return Typed("bool", F.when(n.rank.isNotNull(), (n.dbl != 0) & ~F.isnan(n.dbl)).when(plain & text.isin("true", "1"), True).when(plain & text.isin("false", "0"), False))


def _text_or_number(x: Typed) -> tuple[Column, Column, Column]:
    """(number as double, as decimal, text of a plain string); booleans count as 1 and 0."""
    n, t = number(x), box(x)
    flag = F.when(class_of(t) == "b", F.when(t["v"].isin("true", "1"), 1).otherwise(0))
    return F.coalesce(n.dbl, flag.cast("double")), F.coalesce(n.dec, flag.cast("decimal(38,18)")), F.when(t["d"] == XSD + "string", F.trim(t["v"]))


def to_double(x: Typed, kind: str = "dbl") -> Typed:
    if x.kind == kind:
        return x
    d, _, text = _text_or_number(x)
    special = F.regexp_replace(F.when(text.rlike(r"^([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?INF|NaN)$"), text), "INF", "Infinity")
    return Typed(kind, F.coalesce(d, F.regexp_replace(special, r"^\+I", "I").try_cast("double")).cast("double" if kind == "dbl" else "float"))


def to_decimal(x: Typed) -> Typed:
    d, dec, text = _text_or_number(x)
    return Typed("dec", F.coalesce(dec, F.when(~F.isnan(d), d.try_cast("decimal(38,18)")), F.when(text.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"), text).try_cast("decimal(38,18)")))


def to_integer(x: Typed) -> Typed:
    if x.kind == "int":
        return x
    d, dec, text = _text_or_number(x)
    whole = F.when(dec >= 0, F.floor(dec)).otherwise(F.ceil(dec)).cast("decimal(38,0)")
    of_double = F.when(~F.isnan(d), F.when(d >= 0, F.floor(d)).otherwise(F.ceil(d)).try_cast("decimal(38,0)"))
    return Typed("int", F.coalesce(whole, of_double, F.when(text.rlike(r"^[+-]?[0-9]+$"), text).try_cast("decimal(38,0)")))


def to_datetime(x: Typed) -> Typed:
    if x.kind == "dt":
        return x
    t = box(x)
    text = F.when(t["d"].isin(XSD + "string", XSD + "dateTime"), F.trim(t["v"]))
    return Typed("term", term(LITERAL, F.when(text.rlike(DATETIME_FORM) & (moment(term(LITERAL, text, XSD + "dateTime"))[0].isNotNull() | text.rlike(r"^-|^\d{5}")), text), XSD + "dateTime"))


def to_string(x: Typed) -> Typed:
    if x.kind in ("dbl", "flt") or (x.kind == "term"):
        n, t = number(x), box(x)
        plain = decimal_text(n.dbl.try_cast("decimal(38,18)"))
        plain = F.when(plain.endswith(".0"), F.regexp_replace(plain, r"\.0$", "")).otherwise(plain)
        middle = (F.abs(n.dbl) >= 1e-6) & (F.abs(n.dbl) < 1e6)
        special = F.when(n.dbl == 0, "0").when(middle, plain).otherwise(F.upper(t["v"]))
        dec = F.when(n.rank == 2, F.regexp_replace(decimal_text(n.dec), r"\.0$", ""))
        return Typed("str", F.when(n.rank >= 3, F.when(F.isnan(n.dbl), "NaN").otherwise(special)).when(n.rank == 2, dec).otherwise(F.when(t["k"].isin(IRI, LITERAL), t["v"])))
    if x.kind == "dec":
        return Typed("str", F.regexp_replace(decimal_text(x.col), r"\.0$", ""))
    return str_(x)


def _fresh() -> Typed:
    return Typed("term", term(BNODE, F.replace(F.uuid(), F.lit("-"), F.lit(""))))


FUNCTIONS: dict[str, Callable[..., Typed]] = {
    "str": str_, "lang": lambda x: _literal_field(x, "l"), "langdir": lambda x: _literal_field(x, "r"),
    "haslang": lambda x: Typed("bool", F.when(box(x).isNotNull(), box(x)["l"].isNotNull())), "haslangdir": lambda x: Typed("bool", F.when(box(x).isNotNull(), box(x)["r"].isNotNull())),
    "datatype": datatype, "bnode": lambda *x: _fresh() if not x else Typed("term", term(BNODE, F.concat(F.lit("l"), F.md5(_plain(x[0]).cast("binary"))))),
    "rand": lambda: Typed("dbl", F.rand()), "abs": lambda x: _rounded(x, F.abs), "ceil": lambda x: _rounded(x, F.ceil), "floor": lambda x: _rounded(x, F.floor), "round": _round,
    "concat": concat, "langmatches": langmatches, "substr": substr, "strlen": lambda x: Typed("int", F.length(Text(x).text).cast("bigint")), "replace": replace, "regex": regex,
    "ucase": lambda x: Text(x).like(F.upper(Text(x).text)), "lcase": lambda x: Text(x).like(F.lower(Text(x).text)), "encode_for_uri": encode_for_uri,
    "contains": lambda a, b: Typed("bool", _pair(a, b, F.contains)), "strstarts": lambda a, b: Typed("bool", _pair(a, b, F.startswith)), "strends": lambda a, b: Typed("bool", _pair(a, b, F.endswith)),
    "strbefore": lambda a, b: _around(a, b, False), "strafter": lambda a, b: _around(a, b, True),
    "year": lambda x: _field(x, 1, F.year), "month": lambda x: _field(x, 2, F.month), "day": lambda x: _field(x, 3, F.dayofmonth), "hours": lambda x: _field(x, 4, F.hour), "minutes": lambda x: _field(x, 5, F.minute), "seconds": seconds,
    "timezone": timezone, "tz": lambda x: Typed("str", _zone(x)), "now": lambda: Typed("dt", F.current_timestamp().cast("timestamp_ntz")),
    "uuid": lambda: Typed("iri", F.concat(F.lit("urn:uuid:"), F.uuid())), "struuid": lambda: Typed("str", F.uuid()),
    "md5": _digest(F.md5), "sha1": _digest(F.sha1), "sha256": _digest(lambda b: F.sha2(b, 256)), "sha384": _digest(lambda b: F.sha2(b, 384)), "sha512": _digest(lambda b: F.sha2(b, 512)),
    "strlang": strlang, "strlangdir": strlangdir, "strdt": strdt, "isiri": lambda x: _is(x, IRI), "isblank": lambda x: _is(x, BNODE), "isliteral": lambda x: _is(x, LITERAL), "istriple": lambda x: _is(x, TRIPLE), "isnumeric": isnumeric,
    "triple": triple, "subject": lambda x: Typed("term", part_of(box(x), 0)), "predicate": lambda x: Typed("term", part_of(box(x), 1)), "object": lambda x: Typed("term", part_of(box(x), 2)),
    "sameterm": lambda a, b: Typed("bool", same_term(a, b)),
    XSD + "boolean": to_boolean, XSD + "double": to_double, XSD + "float": lambda x: to_double(x, "flt"), XSD + "decimal": to_decimal, XSD + "integer": to_integer, XSD + "dateTime": to_datetime, XSD + "string": to_string,
}

__all__ = ["FUNCTIONS", "Text", "compare", "iri_of", "part_of"]
