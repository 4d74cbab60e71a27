"""Turtle and TriG writers: streaming ones for frames of any size, and a pretty one for small graphs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..terms import BNODE, IRI, LITERAL, RDF, TRIPLE, XSD, Term, canonical, canonical_column, escape, iri

_LOCAL = re.compile(r"^[A-Za-z_][\w\-]*$")


def short(t: Term, prefixes: dict[str, str]) -> str:
    """A term in Turtle: prefixed names, and bare numbers and booleans."""
    if t.kind == IRI:
        if t.value == RDF + "nil":
            return "()"
        for name, space in prefixes.items():
            if t.value.startswith(space) and _LOCAL.match(t.value[len(space) :]):
                return f"{name}:{t.value[len(space) :]}"
    if t.kind == TRIPLE:
        return "<<( " + " ".join(short(x, prefixes) for x in t.parts) + " )>>"
    if t.kind == LITERAL and t.datatype:
        if (t.datatype == XSD + "integer" and re.match(r"^[+-]?\d+$", t.value)) or (t.datatype == XSD + "decimal" and re.match(r"^[+-]?\d*\.\d+$", t.value)) or (t.datatype == XSD + "double" and re.match(r"^[+-]?(\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+$", t.value)) or (t.datatype == XSD + "boolean" and t.value in ("true", "false")):
            return t.value
        if t.datatype != XSD + "string":
            return f'"{escape(t.value)}"^^{short(iri(t.datatype), prefixes)}'
    return canonical(t)


def pretty(quads: list[tuple], prefixes: dict[str, str] | None = None, indent: str = "  ") -> str:
    """Turtle, or TriG where there are named graphs: subjects together, lists and blank nodes of one use written in place."""
    prefixes = dict(prefixes or {})
    graphs: dict[Term | None, list] = {}
    for q in quads:
        g, s, p, o = q if len(q) == 4 else (None, *q)
        graphs.setdefault(g, []).append((s, p, o))
    everywhere: dict[Term, set] = {}
    for g, triples in graphs.items():
        for t in triples:
            for x in (*t, *([g] if g else [])):
                everywhere.setdefault(x, set()).add(g)
                for inner in re.findall(r"_:([\w.\-]+)", x.value) if x.kind == TRIPLE else []:
                    everywhere.setdefault(Term(BNODE, inner), set()).update({g, "term"})
    out = [f"PREFIX {k}: <{v}>" for k, v in prefixes.items()]
    for g in sorted(graphs, key=lambda t: (t is not None, t and (t.kind, t.value))):
        body = _graph(graphs[g], prefixes, indent, lambda x: len(everywhere[x]) == 1)
        out += body if g is None else [f"GRAPH {short(g, prefixes)} {{", *[indent + line for b in body for line in b.split("\n")], "}"]
    return "\n".join(out) + "\n"


def _graph(triples: list[tuple], prefixes: dict[str, str], indent: str, local) -> list[str]:
    first, rest, nil = iri(RDF + "first"), iri(RDF + "rest"), iri(RDF + "nil")
    props: dict[Term, dict[Term, list[Term]]] = {}
    uses: dict[Term, int] = {}
    for s, p, o in dict.fromkeys(triples):
        props.setdefault(s, {}).setdefault(p, []).append(o)
        uses[o] = uses.get(o, 0) + 1

    def owner_loops(t: Term) -> bool:
        """Whether t is reached from itself, so that it can't stand in place."""
        todo, seen = [o for v in props.get(t, {}).values() for o in v], set()
        while todo:
            x = todo.pop()
            if x == t:
                return True
            if x not in seen:
                seen.add(x)
                todo += [o for v in props.get(x, {}).values() for o in v]
        return False

    inline = {t for t in props if t.kind == BNODE and uses.get(t, 0) == 1 and local(t) and not owner_loops(t)}

    def items(t: Term) -> list[Term] | None:
        out = []
        while t != nil:
            if t not in inline or set(props[t]) != {first, rest} or any(len(v) != 1 for v in props[t].values()):
                return None
            out.append(props[t][first][0])
            t = props[t][rest][0]
        return out

    def node(t: Term, depth: int) -> str:
        if t in inline:
            found = items(t)
            if found is not None:
                return "( " + " ".join(node(x, depth) for x in found) + " )"
            return "[ " + body(t, depth + 1) + " ]"
        return short(t, prefixes)

    def body(t: Term, depth: int) -> str:
        gap = " ;\n" + indent * depth
        order = sorted(props[t], key=lambda p: (p.value != RDF + "type", p.value))
        return gap.join(("a" if p.value == RDF + "type" else short(p, prefixes)) + " " + ", ".join(node(o, depth) for o in sorted(props[t][p], key=lambda x: (x.kind, x.value))) for p in order)

    return [f"{short(s, prefixes)} {body(s, 1)} ." for s in sorted(props, key=lambda t: (t.kind, t.value)) if s not in inline]


def _prefixed(c, prefixes: dict[str, str]):
    out = canonical_column(c)
    for name, space in prefixes.items():
        local = F.substring(c["v"], F.lit(len(space) + 1), F.lit(2**31 - 1))
        out = F.when((c["k"] == IRI) & c["v"].startswith(space) & local.rlike(r"^[A-Za-z_][A-Za-z0-9_\-]*$"), F.concat(F.lit(f"{name}:"), local)).otherwise(out)
    return out


def write_turtle(df: DataFrame, path: str, prefixes: dict[str, str] | None = None, mode: str = "error") -> None:
    """Turtle files of triples of any number, a statement a line; each file has the prefixes. Lines of a subject stand together.

    Blank node labels are kept, so the files are one document in several parts.
    """
    prefixes = prefixes or {}
    statement = F.concat_ws(" ", *[_prefixed(F.col(c), prefixes) for c in ("s", "p", "o")], F.lit("."))
    head = "".join(f"PREFIX {k}: <{v}>\n" for k, v in prefixes.items())
    lines = df.repartition("s").sortWithinPartitions("s", "p").select(statement.alias("value"), F.monotonically_increasing_id().alias("_i"))
    first = F.pmod("_i", F.lit(1 << 33)) == 0
    lines.select(F.when(first, F.concat(F.lit(head), F.col("value"))).otherwise(F.col("value")).alias("value")).write.mode(mode).text(path)


def write_trig(df: DataFrame, path: str, prefixes: dict[str, str] | None = None, mode: str = "error") -> None:
    """TriG files of quads of any number, each quad a graph block of its own line, those of a graph together."""
    prefixes = prefixes or {}
    triple = F.concat_ws(" ", *[_prefixed(F.col(c), prefixes) for c in ("s", "p", "o")])
    text = F.when(F.col("g").isNull(), F.concat(triple, F.lit(" ."))).otherwise(F.concat(F.lit("GRAPH "), _prefixed(F.col("g"), prefixes), F.lit(" { "), triple, F.lit(" }")))
    head = "".join(f"PREFIX {k}: <{v}>\n" for k, v in prefixes.items())
    lines = df.repartition("g", "s").sortWithinPartitions("g", "s").select(text.alias("value"), F.monotonically_increasing_id().alias("_i"))
    first = F.pmod("_i", F.lit(1 << 33)) == 0
    lines.select(F.when(first, F.concat(F.lit(head), F.col("value"))).otherwise(F.col("value")).alias("value")).write.mode(mode).text(path)
