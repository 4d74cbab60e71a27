"""N-Triples, N-Quads and their generalised form: splittable line formats, read and written by Spark alone."""

from __future__ import annotations

import re
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..iri import is_absolute
from ..terms import BNODE, IRI, LITERAL, QUADS, RDF, TERM_DDL, TRIPLE, VARIABLE, XSD, Term, canonical, canonical_column, from_row, parse_term, term

_IRI = r"<(?:[^<>\"{}|^`\\\x00-\x20]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>"
_BNODE = r"_:[\w:][\w:.\-·]*"
_LIT = rf'"(?:[^"\\\n\r]|\\.)*"(?:\^\^{_IRI}|@[A-Za-z]+(?:-[A-Za-z0-9]+)*(?:--(?:ltr|rtl))?)?'
_VAR = r"\?\w+"
_DEEP = rf"(?:{_IRI}|{_BNODE}|{_LIT}|{_VAR})"


def _nested(depth: int) -> str:
    """A pattern of any term, with triple terms up to some depth."""
    out = _DEEP
    for _ in range(depth):
        out = rf"(?:{_DEEP}|<<\(\s*{out}\s*{out}\s*{out}\s*\)>>)"
    return out


_TERM = _nested(1)
#: Lines with triple terms of depth 1 at most; _deep_terms takes others apart.
LINE = rf"^\s*({_TERM})\s*({_TERM})\s*({_TERM})\s*({_IRI}|{_BNODE}|{_TERM})?\s*\.\s*(?:#.*)?$"


_PIECE = re.compile(rf"\s*(?:(<<\()|(\)>>)|({_IRI}|_:[\w:](?:[\w:.\-·]*[\w:\-·])?|{_LIT}|{_VAR}))")
_END = re.compile(r"\s*\.\s*(#.*)?")


def _deep_terms(line: str) -> list[str] | None:
    """The texts of the three or four terms of a line, nested at any depth; None if it is no quad."""
    out: list[str] = []
    inside: list[int] = []
    start = at = 0
    while m := _PIECE.match(line, at):
        at = m.end()
        if not inside:
            start = m.start(m.lastindex)
        if m[1]:
            inside.append(0)
            continue
        if m[2] and (not inside or inside.pop() != 3):
            return None
        if inside:
            inside[-1] += 1
        else:
            out.append(line[start:at])
    return out if not inside and len(out) in (3, 4) and _END.fullmatch(line, at) else None


class ParseError(ValueError):
    """Text that is not in the format; line and column count from 0."""

    def __init__(self, message: str, line: int = 0, column: int = 0):
        super().__init__(f"{message} at line {line}, column {column}")
        self.line, self.column = line, column


def _unescaped(text: Column) -> Column:
    """Escapes undone; the rare \\u ones by a worker, only for lines that have any."""
    plain = text
    for a, b in (("\\\\", "\x00"), ("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ("\\b", "\b"), ("\\f", "\f"), ('\\"', '"'), ("\\'", "'"), ("\x00", "\\")):
        plain = F.replace(plain, F.lit(a), F.lit(b))
    return F.when(~text.contains("\\"), text).otherwise(F.when(text.rlike(r"\\[uU]"), _decode(F.when(text.rlike(r"\\[uU]"), text))).otherwise(plain))


@F.pandas_udf(T.StringType())
def _decode(s):
    from quadlake.terms import unescape

    return s.map(lambda v: None if v is None else unescape(v))


def term_column(text: Column, scope: Column | None = None) -> Column:
    """A term struct from its N-Triples text; blank nodes get `scope` as suffix."""
    first = text.substr(1, 1)
    label = text.substr(F.lit(3), F.length(text))
    body = F.regexp_extract(text, r'^"((?:[^"\\]|\\.)*)"', 1)
    tail = F.regexp_replace(text, r'^"(?:[^"\\]|\\.)*"', "")
    lang = F.regexp_extract(tail, r"^@([A-Za-z0-9]+(?:-[A-Za-z0-9]+)*)", 1)
    direction = F.regexp_extract(tail, r"--(ltr|rtl)$", 1)
    kind = F.regexp_extract(tail, r"^\^\^<(.*)>$", 1)
    none = lambda c: F.when(c != "", c)
    datatype = F.when(lang != "", None).when(kind != "", _unescaped(kind)).otherwise(XSD + "string")
    return (
        F.when(text.startswith("<<("), term(TRIPLE, _retext(F.when(text.startswith("<<("), text), scope if scope is not None else F.lit(None).cast("string"))))
        .when(first == "<", term(IRI, _unescaped(F.substring(text, F.lit(2), F.length(text) - 2))))
        .when(first == "_", term(BNODE, F.concat(label, scope) if scope is not None else label))
        .when(first == "?", term(VARIABLE, text.substr(F.lit(2), F.length(text))))
        .when(first == '"', term(LITERAL, _unescaped(body), datatype, none(F.lower(lang)), none(direction)))
    )


@F.pandas_udf(T.StringType())
def _retext(s, scope):
    """Canonical text of triple terms."""
    from quadlake.terms import canonical, parse_term

    def one(v, suffix):
        if v is None:
            return None
        if suffix is not None:
            v = re.sub(r"(?<![\w<:/#])(_:[\w:][\w:.\-·]*)", lambda m: m[1] + suffix, v)
        return canonical(parse_term(v))

    return s.combine(scope, one)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _deep(lines):
    """The terms of lines with deep triple terms."""
    return lines.map(lambda v: None if v is None else _deep_terms(v))


def read_nquads(spark: SparkSession, path: str, preserve_bnodes: bool = False, strict: bool = True) -> DataFrame:
    """Quads of N-Triples or N-Quads files, one line a row, any number of tasks a file.

    Blank nodes get a suffix that is the same within a file and different between files, and between calls, unless preserve_bnodes. With
    strict, a line that is neither a quad nor blank nor a comment, or a term in a position that RDF does not allow, raises when
    the rows are used; else (generalised RDF) any kind of term may stand anywhere.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"))
    return parse_lines(lines, preserve_bnodes, strict, uuid.uuid4().hex)


def parse_lines(lines: DataFrame, preserve_bnodes: bool = False, strict: bool = True, call: str = "") -> DataFrame:
    """As read_nquads, of a frame with `value` and, if it has one, `_file`; also of a streaming one. `call` sets blank nodes apart from those of other calls."""
    scope = None
    if not preserve_bnodes:
        scope = F.concat(F.lit("f"), F.substring(F.sha2(F.concat(F.col("_file"), F.lit("\n" + call)), 256), 1, 24)) if "_file" in lines.columns else F.lit(f"f0{call}")
    rows = lines.where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    if scope is not None:
        rows, scope = rows.withColumn("_scope", scope), F.col("_scope")
    flat = F.col("value").rlike(LINE)
    # only lines that nest triple terms in triple terms go through Python
    rows = rows.withColumn("_deep", _deep(F.when(~flat & F.col("value").rlike(r"<<\(.*<<\("), F.col("value"))))
    part = lambda i: F.when(flat, F.regexp_extract("value", LINE, i)).otherwise(F.coalesce(F.get("_deep", F.lit(i - 1)), F.lit("")))
    good = flat | F.col("_deep").isNotNull()
    # every column fails on a bad line: whichever of them is asked for
    bad = lambda: F.raise_error(F.concat(F.lit("not N-Quads: "), F.col("value"))).cast(TERM_DDL)
    terms = {n: F.when(good, term_column(F.when(part(i) != "", part(i)), scope)).otherwise(bad()) for n, i in (("s", 1), ("p", 2), ("o", 3), ("g", 4))}
    out = rows.select(*[terms[n].alias(n) for n in ("g", "s", "p", "o")])
    if not strict:
        return out
    ok = {"s": F.col("s.k").isin(IRI, BNODE), "p": F.col("p.k") == IRI, "o": F.col("o.k") != VARIABLE, "g": F.col("g").isNull() | F.col("g.k").isin(IRI, BNODE)}
    wrong = lambda n: F.raise_error(F.concat(F.lit(f"not allowed as {n}: "), F.to_json(F.col(n)))).cast(TERM_DDL)
    return out.select(*[F.when(ok[n], F.col(n)).otherwise(wrong(n)).alias(n) for n in ("g", "s", "p", "o")])


def line_column(df: DataFrame, canonical_form: bool = True) -> Column:
    """The line of a quad: canonical with single spaces, else with tabs."""
    gap = " " if canonical_form else "\t"
    text = [canonical_column(F.col(c)) for c in ("s", "p", "o")]
    if "g" in df.columns:
        text.append(F.when(F.col("g").isNotNull(), canonical_column(F.col("g"))))
    return F.concat(F.concat_ws(gap, *text), F.lit(gap + "."))


def write_nquads(df: DataFrame, path: str, canonical_form: bool = False, mode: str = "error") -> None:
    """Quads (or triples, where there is no column g) as text files."""
    df.select(line_column(df, canonical_form)).write.mode(mode).text(path)


def write_ntriples(df: DataFrame, path: str, canonical_form: bool = False, mode: str = "error") -> None:
    write_nquads(df.select("s", "p", "o"), path, canonical_form, mode)


_PY = re.compile(LINE, re.S)


#: Terms that come again, as predicates do, are parsed and tested once.
_known, _is_absolute = lru_cache(1 << 14)(parse_term), lru_cache(1 << 14)(is_absolute)
#: Longer ones are not kept.
_SHORT = 200


def _parsed(text: str) -> Term:
    return _known(text) if len(text) <= _SHORT else parse_term(text)


def _absolute(text: str) -> bool:
    return _is_absolute(text) if len(text) <= _SHORT else is_absolute(text)


def parse_nquads(text: str, strict: bool = True) -> list[tuple]:
    """(g, s, p, o) terms of a small document, in Python; ParseError names the line."""
    out = []
    for n, line in enumerate(re.split("\r\n|\n|\r", text)):
        if re.match(r"^\s*(#.*)?$", line):
            continue
        m = _PY.match(line)
        texts = m.groups() if m else _deep_terms(line)
        if not texts:
            raise ParseError("not N-Quads", n)
        try:
            s, p, o = (_parsed(x) for x in texts[:3])
            g = _parsed(texts[3]) if len(texts) > 3 and texts[3] else None
        except (ValueError, KeyError) as e:
            raise ParseError(str(e), n) from e
        if strict and (s.kind not in (IRI, BNODE) or p.kind != IRI or o.kind == VARIABLE or (g is not None and g.kind not in (IRI, BNODE)) or any(t is not None and t.kind == IRI and not _absolute(t.value) for t in (s, p, o, g))):
            raise ParseError("a term in a wrong place", n)
        out.append((g, s, p, o))
    return out


def to_frame(spark: SparkSession, quads: list[tuple]) -> DataFrame:
    """(g, s, p, o) terms as a frame; triples get no graph."""
    rows = [(None, *q) if len(q) == 3 else q for q in quads]
    return spark.createDataFrame([tuple(None if t is None else t.row() for t in q) for q in rows], QUADS)


def from_frame(df: DataFrame) -> list[tuple]:
    """All quads of a small frame as terms."""
    columns = [c for c in ("g", "s", "p", "o") if c in df.columns]
    return [tuple(from_row(r[c]) for c in columns) if "g" in columns else (None, *(from_row(r[c]) for c in columns)) for r in df.select(*columns).collect()]


def quad_line(q: tuple) -> str:
    g, s, p, o = q if len(q) == 4 else (None, *q)
    return " ".join([canonical(t) for t in (s, p, o, g) if t is not None]) + " ."


__all__ = ["RDF", "ParseError", "Term", "from_frame", "line_column", "parse_lines", "parse_nquads", "quad_line", "read_nquads", "to_frame", "write_nquads", "write_ntriples"]
