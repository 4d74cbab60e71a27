"""RDF terms: Python values, the Spark struct, and columns that build, test and print them."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BNODE, IRI, LITERAL, TRIPLE, VARIABLE = range(5)
TERM = T.StructType([T.StructField("k", T.ByteType(), False), T.StructField("v", T.StringType(), False), T.StructField("d", T.StringType()), T.StructField("l", T.StringType()), T.StructField("r", T.StringType())])
TERM_DDL = TERM.simpleString()
QUADS = T.StructType([T.StructField("g", TERM), T.StructField("s", TERM, False), T.StructField("p", TERM, False), T.StructField("o", TERM, False)])

# Namespaces.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
XSD = "http://www.w3.org/2001/XMLSchema#"
OWL = "http://www.w3.org/2002/07/owl#"
XML = "http://www.w3.org/XML/1998/namespace"

# Integer datatypes and their ranges.
INTEGER_RANGES = {
    "integer": (None, None), "long": (-(2**63), 2**63 - 1), "int": (-(2**31), 2**31 - 1), "short": (-(2**15), 2**15 - 1), "byte": (-128, 127),
    "nonNegativeInteger": (0, None), "positiveInteger": (1, None), "nonPositiveInteger": (None, 0), "negativeInteger": (None, -1),
    "unsignedLong": (0, 2**64 - 1), "unsignedInt": (0, 2**32 - 1), "unsignedShort": (0, 2**16 - 1), "unsignedByte": (0, 255),
}
INT_TYPES = [XSD + x for x in INTEGER_RANGES]
NUMERIC = [*INT_TYPES, XSD + "decimal", XSD + "float", XSD + "double"]


@dataclass(frozen=True)
class Term:
    """A constant term. kind as in the struct; value: IRI, label, lexical form, variable name, or canonical text of a triple term."""

    kind: int
    value: str
    datatype: str | None = None
    lang: str | None = None
    direction: str | None = None
    parts: tuple = ()

    def row(self) -> tuple:
        return (self.kind, self.value, self.datatype, self.lang, self.direction)

    def column(self) -> Column:
        return term(self.kind, F.lit(self.value), self.datatype, self.lang, self.direction)

    def __str__(self) -> str:
        return canonical(self)


def iri(value: str) -> Term:
    return Term(IRI, value)


def bnode(label: str) -> Term:
    return Term(BNODE, label)


def variable(name: str) -> Term:
    return Term(VARIABLE, name)


def literal(value: object, datatype: str | None = None, lang: str | None = None, direction: str | None = None) -> Term:
    """A literal from a lexical form, or from a bool, int or float."""
    if lang is not None:
        return Term(LITERAL, str(value), None, lang.lower(), direction)
    if datatype is None:
        datatype = XSD + ("boolean" if isinstance(value, bool) else "integer" if isinstance(value, int) else "double" if isinstance(value, float) else "string")
    text = str(value).lower() if isinstance(value, bool) else double_text(value) if isinstance(value, float) else str(value)
    return Term(LITERAL, text, datatype)


def triple_term(s: Term, p: Term, o: Term) -> Term:
    return Term(TRIPLE, f"<<( {canonical(s)} {canonical(p)} {canonical(o)} )>>", parts=(s, p, o))


def double_text(x: float) -> str:
    if x != x:
        return "NaN"
    if x in (float("inf"), float("-inf")):
        return "INF" if x > 0 else "-INF"
    mantissa, exponent = f"{x!r}e0".replace("e0", "", 1).split("e") if "e" in repr(x) else (None, None)
    if mantissa is None:
        sign, digits = ("-", repr(x)[1:]) if repr(x).startswith("-") else ("", repr(x))
        whole, part = digits.split(".")
        if whole.strip("0"):
            exp, all_digits = len(whole) - 1, whole + part
        else:
            zeros = len(part) - len(part.lstrip("0"))
            if not part.strip("0"):
                return sign + "0.0e0"
            exp, all_digits = -zeros - 1, part.lstrip("0")
        rest = all_digits[1:].rstrip("0") or "0"
        return f"{sign}{all_digits[0]}.{rest}e{exp}"
    return f"{mantissa if '.' in mantissa else mantissa + '.0'}e{int(exponent)}"


def escape(text: str) -> str:
    """N-Triples escapes in canonical form."""
    names = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
    return "".join(names.get(c) or (f"\\u{ord(c):04X}" if ord(c) < 0x20 or c == "\x7f" else c) for c in text)


def canonical(t: Term) -> str:
    """Canonical N-Triples text of a term."""
    if t.kind == IRI:
        return f"<{t.value}>"
    if t.kind == BNODE:
        return f"_:{t.value}"
    if t.kind == VARIABLE:
        return f"?{t.value}"
    if t.kind == TRIPLE:
        return t.value
    tail = f"@{t.lang}" + (f"--{t.direction}" if t.direction else "") if t.lang else "" if t.datatype == XSD + "string" else f"^^<{t.datatype}>"
    return f'"{escape(t.value)}"{tail}'


def from_row(row) -> Term | None:
    """A struct value of Spark as a Term; triple terms get their parts back."""
    if row is None:
        return None
    k, v, d, lang, r = row
    return parse_term(v) if k == TRIPLE else Term(k, v, d, lang, r)


_TOKEN = re.compile(r'\s*(?:(<<\()|(\)>>)|<([^<>"{}|^`\\\x00-\x20]*)>|_:([^\s<>"()]*[^\s<>"().])|\?([^\s()<>]+)|"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+?)(?:--(ltr|rtl))?(?![A-Za-z0-9-]))?)')
_ESC = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))")
_CHARS = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def unescape(text: str) -> str:
    return _ESC.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _CHARS[m[3]], text) if "\\" in text else text


def parse_term(text: str, at: int = 0) -> Term:
    t, end = _term_at(text, at)
    if text[end:].strip():
        raise ValueError(f"not one term: {text!r}")
    return t


def _term_at(text: str, at: int) -> tuple[Term, int]:
    m = _TOKEN.match(text, at)
    if not m or m[2]:
        raise ValueError(f"no term at {at}: {text!r}")
    if m[1]:
        parts, end = [], m.end()
        for _ in range(3):
            t, end = _term_at(text, end)
            parts.append(t)
        m = _TOKEN.match(text, end)
        if not m or not m[2]:
            raise ValueError(f"triple term without end: {text!r}")
        return triple_term(*parts), m.end()
    if m[3] is not None:
        return iri(unescape(m[3])), m.end()
    if m[4] is not None:
        return bnode(m[4]), m.end()
    if m[5] is not None:
        return variable(m[5]), m.end()
    return literal(unescape(m[6]), m[7], m[8], m[9]), m.end()


# Columns


def term(kind: int | Column, value: Column, datatype: str | Column | None = None, lang: str | Column | None = None, direction: str | Column | None = None, given: bool = False) -> Column:
    """The struct, or null if the value is null. given: the value is known not to be, and isn't asked."""
    s = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    k = kind if isinstance(kind, Column) else F.lit(kind)
    fields = {"k": k.cast("tinyint"), "v": value.cast("string"), "d": s(datatype), "l": s(lang), "r": s(direction)}
    made = F.named_struct(*[x for name, c in fields.items() for x in (F.lit(name), c)])
    return made if given else F.when(value.isNotNull(), made)


def canonical_column(t: Column) -> Column:
    """Canonical N-Triples text of a term column, in Spark alone."""
    text = t["v"]
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        text = F.replace(text, F.lit(a), F.lit(b))
    for code in [*range(8), 11, *range(14, 32), 127]:
        text = F.replace(text, F.lit(chr(code)), F.lit(f"\\u{code:04X}")) if code else text
    # few texts have anything to escape: the others are looked through once
    text = F.when(t["v"].rlike(r'[\x01-\x1f\x7f"\\]'), text).otherwise(t["v"])
    tail = F.when(t["l"].isNotNull(), F.concat(F.lit("@"), t["l"], F.coalesce(F.concat(F.lit("--"), t["r"]), F.lit("")))).when(t["d"] == XSD + "string", "").otherwise(F.concat(F.lit("^^<"), t["d"], F.lit(">")))
    quoted = F.concat(F.lit('"'), text, F.lit('"'), tail)
    return F.when(t["k"] == IRI, F.concat(F.lit("<"), t["v"], F.lit(">"))).when(t["k"] == BNODE, F.concat(F.lit("_:"), t["v"])).when(t["k"] == VARIABLE, F.concat(F.lit("?"), t["v"])).when(t["k"] == TRIPLE, t["v"]).otherwise(quoted)


#: Canonical text has no control characters, so two of them can stand for an escaped backslash and an escaped quote while it is cut up.
_BACKSLASH, _QUOTE = "\x01", "\x02"
_TOKENS = r'<<\(|\)>>|<[^<>]*>|_:[^\s"]+|\?[^\s"]+|"[^"]*"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?'
_HEAD = r'^<<\( (<[^<>]*>|_:[^\s"]+|\?[^\s"]+) (<[^<>]*>) '


def _read_term(x: Column) -> Column:
    """The struct of one term of canonical text with the two stand-ins."""
    back = lambda c: F.replace(F.replace(c, F.lit(_BACKSLASH), F.lit("\\\\")), F.lit(_QUOTE), F.lit('\\"'))
    bare = text = F.regexp_extract(x, '^"([^"]*)"', 1)
    for a, b in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f"), *((chr(c), f"\\u{c:04X}") for c in (*range(1, 8), 11, *range(14, 32), 127))):
        text = F.replace(text, F.lit(b), F.lit(a)) if a not in (_BACKSLASH, _QUOTE) else text
    # these two come last, each with what stands for it in plain text
    for c in (_BACKSLASH, _QUOTE):
        text = F.replace(text, F.lit(f"\\u{ord(c):04X}"), F.lit("\\" + ("1" if c == _BACKSLASH else "2")))
    text = F.replace(F.replace(text, F.lit(_BACKSLASH), F.lit("\\0")), F.lit(_QUOTE), F.lit('"'))
    text = F.replace(F.replace(F.replace(text, F.lit("\\1"), F.lit(_BACKSLASH)), F.lit("\\2"), F.lit(_QUOTE)), F.lit("\\0"), F.lit("\\"))
    text = F.when(x.rlike(r"[\x01\x02\\]"), text).otherwise(bare)
    some = lambda pattern, group=1: F.nullif(F.regexp_extract(x, pattern, group), F.lit(""))
    tagged = ~F.substring(x, -1, 1).isin('"', ">")
    lang, way = (F.when(tagged, some(form)) for form in ('"@([A-Za-z0-9-]+?)(?:--(?:ltr|rtl))?$', '"@[A-Za-z0-9-]+?--(ltr|rtl)$'))
    kind = F.when(x.endswith(">"), some(r'"\^\^<([^>]*)>$'))
    rest = lambda n, less=0: x.substr(F.lit(n), F.length(x) - F.lit(n - 1 + less))
    plain = term(LITERAL, text, F.when(lang.isNull(), F.coalesce(kind, F.lit(XSD + "string"))), lang, way)
    return F.when(x.startswith("<<("), term(TRIPLE, back(x))).when(x.startswith("<"), term(IRI, rest(2, 1))).when(x.startswith("_:"), term(BNODE, rest(3))).when(x.startswith("?"), term(VARIABLE, rest(2))).otherwise(plain)


def parts_column(t: Column) -> Column:
    """Subject, predicate and object of a triple term, read from its canonical text in Spark alone; null for other terms."""
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("parts"))

    def step(a: Column, x: Column) -> Column:
        n = F.size(a["parts"])
        more = F.concat(F.slice(a["parts"], F.lit(1), F.greatest(F.lit(0), n - 1)), F.array(F.concat(F.get(a["parts"], n - 1), F.lit(" "), x)))
        depth = a["depth"] + F.when(x == "<<(", 1).when(x == ")>>", -1).otherwise(0)
        return F.struct(depth.alias("depth"), F.when(a["depth"] == 0, F.concat(a["parts"], F.array(x))).otherwise(more).alias("parts"))

    def parts(v: Column) -> Column:
        """What comes after a subject and a predicate that are plain is the object as it stands: only other triple terms are cut into tokens."""
        head = F.regexp_extract(v, _HEAD, 0)
        rest = F.substring(v, F.length(head) + 1, F.length(v) - F.length(head) - 4)
        plain = F.array(F.regexp_extract(v, _HEAD, 1), F.regexp_extract(v, _HEAD, 2), rest)
        tokens = F.regexp_extract_all(v, F.lit(_TOKENS), F.lit(0))
        tokens = F.slice(tokens, F.lit(2), F.greatest(F.lit(0), F.size(tokens) - 2))
        return F.when(v.endswith(" )>>") & (head != ""), plain).otherwise(F.aggregate(tokens, start, step, lambda a: a["parts"]))

    stand = lambda v: F.replace(F.replace(v, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))
    read = lambda v: F.get(F.transform(F.array(stand(v)), lambda x: F.transform(parts(x), _read_term)), F.lit(0))
    # bound to a lambda, so that the parts of parts of parts don't multiply in the plan
    return F.get(F.transform(F.array(t), lambda x: F.when(x["k"] == TRIPLE, read(x["v"]))), F.lit(0))
