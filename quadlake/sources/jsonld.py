"""JSON-LD: documents to quads (contexts inline, static or from local files) and quads to documents."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .. import iri as iris
from ..terms import BNODE, IRI, LITERAL, RDF, XSD, Term, bnode, double_text, iri, literal
from .turtle import new_scopes, read_documents

Loader = Callable[[str], str]


def no_loader(url: str) -> str:
    raise ValueError(f"remote document {url} and no loader")


def static_loader(documents: dict[str, str]) -> Loader:
    def load(url: str) -> str:
        if url not in documents:
            raise ValueError(f"unknown document {url}")
        return documents[url]

    return load


def file_loader(folders: dict[str, str] | None = None) -> Loader:
    """file: URLs, and URLs below a prefix that stands for a folder."""

    def load(url: str) -> str:
        for prefix, folder in (folders or {}).items():
            if url.startswith(prefix):
                return (Path(folder) / url.removeprefix(prefix)).read_text()
        if url.startswith("file://"):
            return Path(url.removeprefix("file://")).read_text()
        raise ValueError(f"no folder for {url}")

    return load


def chain_loader(*loaders: Loader) -> Loader:
    def load(url: str) -> str:
        for k, one in enumerate(loaders):
            try:
                return one(url)
            except (ValueError, OSError):
                if k == len(loaders) - 1:
                    raise
        raise ValueError(f"no loader for {url}")

    return load


class _Context:
    def __init__(self, base: str | None):
        self.base, self.vocab, self.lang, self.direction, self.terms = base, None, None, None, {}

    def copy(self) -> _Context:
        c = _Context(self.base)
        c.vocab, c.lang, c.direction, c.terms = self.vocab, self.lang, self.direction, dict(self.terms)
        return c


class _Reader:
    def __init__(self, base: str | None, loader: Loader, direction: str | None, scope: str, generalized: bool):
        self.base, self.loader, self.rdf_direction, self.scope, self.loose = base, loader, direction, scope, generalized
        self.out: list[tuple] = []
        self.fresh = 0

    def new(self) -> Term:
        self.fresh += 1
        return bnode(f"j{self.fresh}{self.scope}")

    def context(self, c: _Context, value) -> _Context:
        out = c.copy()
        for part in value if isinstance(value, list) else [value]:
            if part is None:
                out = _Context(self.base)
            elif isinstance(part, str):
                out = self.context(out, json.loads(self.loader(iris.resolve(out.base, part) if out.base else part)).get("@context", {}))
            else:
                if "@base" in part:
                    out.base = iris.resolve(out.base, part["@base"]) if out.base and part["@base"] else part["@base"]
                if "@vocab" in part:
                    out.vocab = self.expand(out, part["@vocab"], True) if part["@vocab"] else part["@vocab"]
                out.lang = part.get("@language", out.lang)
                out.direction = part.get("@direction", out.direction)
                for k, v in part.items():
                    if not k.startswith("@"):
                        out.terms[k] = {"@id": v} if isinstance(v, str) or v is None else dict(v)
        return out

    def expand(self, c: _Context, text: str, vocab: bool, seen: tuple = ()) -> str | None:
        if text.startswith("@"):
            return text
        if vocab and text in c.terms and text not in seen:
            target = c.terms[text].get("@id", text)
            if target is None:
                return None
            if target != text:
                return self.expand(c, target, True, (*seen, text))
        prefix, colon, rest = text.partition(":")
        if colon and prefix == "_":
            return text
        if colon and not rest.startswith("//") and prefix in c.terms and prefix not in seen:
            return (self.expand(c, prefix, True, (*seen, text)) or "") + rest
        if colon and iris.is_absolute(text):
            return text
        if vocab:
            return c.vocab + text if c.vocab is not None else None if not iris.is_absolute(text) else text
        return iris.resolve(c.base, text) if c.base else text

    def resource(self, text: str | None) -> Term | None:
        if text is None:
            return None
        if text.startswith("_:"):
            return bnode(text[2:] + self.scope)
        return iri(text) if iris.is_absolute(text) else None

    def document(self, data) -> None:
        for x in data if isinstance(data, list) else [data]:
            self.node(_Context(self.base), x, None)

    def node(self, c: _Context, x: dict, graph: Term | None) -> Term | None:
        if "@context" in x:
            c = self.context(c, x["@context"])
        keys = {self.expand(c, k, True): k for k in x if k != "@context"}
        if "@graph" in keys and not set(keys) - {"@graph"} and graph is None:
            for y in _list(x[keys["@graph"]]):
                if isinstance(y, dict):
                    self.node(c, y, None)
            return None
        me = self.resource(self.expand(c, x[keys["@id"]], False)) if "@id" in keys else self.new()
        if "@id" in keys and me is None:
            return None
        add = lambda s, p, o: self.out.append((graph, s, p, o))
        for t in _list(x[keys["@type"]]) if "@type" in keys else []:
            o = self.resource(self.expand(c, t, True))
            if o:
                add(me, iri(RDF + "type"), o)
        if "@graph" in keys:
            for y in _list(x[keys["@graph"]]):
                self.node(c, y, me)
        for full, k in sorted(((f, k) for f, k in keys.items() if f), key=lambda p: p[0]):
            if full == "@reverse":
                for rk, rv in x[k].items():
                    p = self.resource(self.expand(c, rk, True))
                    for y in _list(rv):
                        o = self.value(c, y, {}, graph)
                        if p and o:
                            add(o, p, me)
                continue
            if full == "@included":
                for y in _list(x[k]):
                    self.node(c, y, graph)
                continue
            definition = c.terms.get(k, {})
            if full.startswith("@"):
                continue
            reverse = "@reverse" in definition
            p = self.resource(self.expand(c, definition["@reverse"], True) if reverse else full)
            if p is None or (p.kind == BNODE and not self.loose):
                continue
            inner = self.context(c, definition["@context"]) if "@context" in definition else c
            box = definition.get("@container")
            box = box if isinstance(box, list) else [box]
            values = x[k]
            if "@language" in box and isinstance(values, dict):
                for tag, texts in values.items():
                    for t in _list(texts):
                        add(me, p, literal(t, lang=None if tag == "@none" else tag))
                continue
            if ("@index" in box or "@id" in box or "@type" in box) and isinstance(values, dict):
                flat = []
                for name, some in values.items():
                    for y in _list(some):
                        if "@id" in box and isinstance(y, dict) and name != "@none":
                            y = {"@id": name, **y}
                        elif "@type" in box and name != "@none":
                            y = {"@type": name, **y} if isinstance(y, dict) else {"@id": y, "@type": name}
                        flat.append(y)
                values = flat
            if "@list" in box and not (isinstance(values, dict) and "@list" in values):
                values = [{"@list": _list(values)}]
            for y in _list(values):
                o = self.value(inner, y, definition, graph)
                if o is not None:
                    add(o, p, me) if reverse else add(me, p, o)
        return me

    def value(self, c: _Context, y, definition: dict, graph: Term | None) -> Term | None:
        kind = definition.get("@type")
        if y is None:
            return None
        if isinstance(y, dict):
            if "@context" in y:
                c = self.context(c, y["@context"])
            keys = {self.expand(c, k, True): k for k in y if k != "@context"}
            if "@value" in keys:
                v = y[keys["@value"]]
                t = y.get(keys.get("@type"))
                if t == "@json":
                    return literal(json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False), RDF + "JSON")
                return None if v is None else self.literal(c, v, self.expand(c, t, True) if t else None, y.get(keys.get("@language")), y.get(keys.get("@direction")))
            if "@list" in keys:
                items = [self.value(c, z, {k: v for k, v in definition.items() if k != "@container"}, graph) for z in _list(y[keys["@list"]])]
                items = [i for i in items if i is not None]
                cells = [self.new() for _ in items]
                for i, o in enumerate(items):
                    self.out.append((graph, cells[i], iri(RDF + "first"), o))
                    self.out.append((graph, cells[i], iri(RDF + "rest"), cells[i + 1] if i + 1 < len(items) else iri(RDF + "nil")))
                return cells[0] if cells else iri(RDF + "nil")
            if "@set" in keys:
                raise ValueError("a set in this place")
            return self.node(c, y, graph)
        if kind in ("@id", "@vocab") and isinstance(y, str):
            return self.resource(self.expand(c, y, kind == "@vocab"))
        if kind == "@json":
            return literal(json.dumps(y, sort_keys=True, separators=(",", ":"), ensure_ascii=False), RDF + "JSON")
        if kind and not kind.startswith("@"):
            return self.literal(c, y, self.expand(c, kind, True), None, None)
        if isinstance(y, str):
            return self.literal(c, y, None, definition.get("@language", c.lang), definition.get("@direction", c.direction))
        return self.literal(c, y, None, None, None)

    def literal(self, c: _Context, v, datatype: str | None, lang: str | None, direction: str | None) -> Term:
        if isinstance(v, bool):
            return literal(str(v).lower(), datatype or XSD + "boolean")
        if isinstance(v, float) and (v % 1 or datatype == XSD + "double" or abs(v) >= 1e21):
            return literal(double_text(v).replace("e", "E"), datatype or XSD + "double")
        if isinstance(v, (int, float)):
            return literal(double_text(float(v)).replace("e", "E") if datatype == XSD + "double" else str(int(v)), datatype or XSD + "integer")
        if direction and not datatype and self.rdf_direction == "i18n-datatype":
            return literal(v, f"https://www.w3.org/ns/i18n#{(lang or '').lower()}_{direction}")
        if lang and not datatype:
            return literal(v, lang=lang, direction=direction if self.rdf_direction is None else None)
        return literal(v, datatype or XSD + "string")


class _Plain(ValueError):
    """A node object that is more than expanded."""


class _Expanded:
    """Expanded node objects with names and texts alone, as write_jsonld makes them, to rows of terms (as Term.row() gives them), without a context."""

    def __init__(self, scope: str):
        self.scope, self.fresh, self.out, self.known = scope, 0, [], {}

    def resource(self, text: str) -> tuple:
        if type(text) is not str:
            raise _Plain
        if text.startswith("_:"):
            return (BNODE, text[2:] + self.scope, None, None, None)
        if not iris.is_absolute(text):
            raise _Plain
        return (IRI, text, None, None, None)

    def name(self, text: str) -> tuple:
        """An IRI that many rows share."""
        if text not in self.known:
            t = self.resource(text)
            if t[0] != IRI:
                raise _Plain
            self.known[text] = t
        return self.known[text]

    def node(self, x: dict, graph: tuple | None) -> None:
        if type(x) is not dict or "@id" not in x:
            raise _Plain
        me, out = self.resource(x["@id"]), self.out
        for k, values in x.items():
            if k == "@id":
                continue
            if type(values) is not list:
                raise _Plain
            if k == "@type":
                p = self.name(RDF + "type")
                out += [(graph, me, p, self.resource(t)) for t in values]
            elif k == "@graph":
                for y in values:
                    self.node(y, me)
            else:
                p = self.name(k)
                out += [(graph, me, p, self.value(y, graph)) for y in values]

    def value(self, y: dict, graph: tuple | None) -> tuple:
        if type(y) is not dict:
            raise _Plain
        if "@value" in y:
            v, kind, lang, direction = y["@value"], y.get("@type"), y.get("@language"), y.get("@direction")
            if type(v) is not str or 1 + ("@type" in y) + ("@language" in y) + ("@direction" in y) != len(y) or (kind is not None) + (lang is not None) == 2 or (direction is not None and lang is None):
                raise _Plain
            if lang is not None:
                if type(lang) is not str or not lang:
                    raise _Plain
                return (LITERAL, v, None, lang.lower(), direction)
            return (LITERAL, v, XSD + "string" if kind is None else self.name(kind)[1], None, None)
        if len(y) != 1:
            raise _Plain
        if "@id" in y:
            return self.resource(y["@id"])
        if "@list" not in y or type(y["@list"]) is not list:
            raise _Plain
        nil = self.name(RDF + "nil")
        items = [self.value(z, graph) for z in y["@list"]]
        n, self.fresh = self.fresh, self.fresh + len(items)
        cells = [(BNODE, f"e{n + i}{self.scope}", None, None, None) for i in range(len(items))] + [nil]
        first, rest = self.name(RDF + "first"), self.name(RDF + "rest")
        for i, o in enumerate(items):
            self.out.append((graph, cells[i], first, o))
            self.out.append((graph, cells[i], rest, cells[i + 1]))
        return cells[0]


def _rows(text: str, base: str | None, scope: str) -> list[tuple]:
    """Rows of a document's quads: of expanded node objects straight away, of others by way of terms."""
    import gc

    gc.disable()  # a document makes very many objects, and no cycles
    try:
        data = json.loads(text)
        fast, slow = _Expanded(scope), _Reader(base, no_loader, None, scope, False)
        for x in data if isinstance(data, list) else [data]:
            before = len(fast.out), fast.fresh
            try:
                fast.node(x, None)
            except _Plain:
                del fast.out[before[0] :]
                fast.fresh = before[1]
                slow.document(x)
        return list(dict.fromkeys(fast.out + [tuple(None if t is None else t.row() for t in q) for q in slow.out]))
    finally:
        gc.enable()


def _list(x) -> list:
    if isinstance(x, dict) and "@set" in x:
        x = x["@set"]
    return [] if x is None else x if isinstance(x, list) else [x]


def parse_jsonld(text: str, base: str | None = None, loader: Loader = no_loader, expand_context=None, rdf_direction: str | None = None, generalized: bool = False, bnode_scope: str = "") -> list[tuple]:
    """Quads (g, s, p, o) of terms."""
    r = _Reader(base, loader, rdf_direction, bnode_scope, generalized)
    data = json.loads(text)
    if expand_context is not None:
        data = [{"@context": [expand_context, d.get("@context", {})], **{k: v for k, v in d.items() if k != "@context"}} for d in _list(data)]
    r.document(data)
    return list(dict.fromkeys(r.out))


def read_jsonld(spark: SparkSession, path: str, base: str | None = None, preserve_bnodes: bool = False, **options) -> DataFrame:
    scope = new_scopes(preserve_bnodes)
    if not options:
        return read_documents(spark, path, lambda text, name: _rows(text, base or name, scope(name)))
    return read_documents(spark, path, lambda text, name: parse_jsonld(text, base or name, bnode_scope=scope(name), **options))


def to_jsonld(quads: list[tuple], native_types: bool = False, use_rdf_type: bool = False, rdf_direction: str | None = None, indent: int | None = None) -> str:
    """An expanded document: nodes by subject, named graphs nested, well-formed lists collapsed."""
    graphs: dict[Term | None, list] = {}
    for q in quads:
        g, s, p, o = q if len(q) == 4 else (None, *q)
        graphs.setdefault(g, []).append((s, p, o))
    first, rest, nil = iri(RDF + "first"), iri(RDF + "rest"), iri(RDF + "nil")

    def name(t: Term) -> str:
        return f"_:{t.value}" if t.kind == BNODE else t.value

    def nodes(triples: list[tuple]) -> list[dict]:
        props: dict[Term, dict[Term, list[Term]]] = {}
        uses: dict[Term, list] = {}
        for s, p, o in triples:
            props.setdefault(s, {}).setdefault(p, []).append(o)
            uses.setdefault(o, []).append((s, p))
        cell = lambda t: t.kind == BNODE and set(props.get(t, {})) == {first, rest} and all(len(v) == 1 for v in props[t].values()) and len(uses.get(t, [])) == 1

        def items(t: Term) -> list[Term] | None:
            out, seen = [], set()
            while t != nil:
                if t in seen or not cell(t):
                    return None
                seen.add(t)
                out.append(props[t][first][0])
                t = props[t][rest][0]
            return out

        inside: set[Term] = set()

        def value(o: Term, p: Term):
            if p not in (first, rest) and (o == nil or cell(o)):
                found = items(o)
                if found is not None:
                    t = o
                    while t != nil:
                        inside.add(t)
                        t = props[t][rest][0]
                    return {"@list": [value(x, p) for x in found]}
            if o.kind != LITERAL:
                return {"@id": name(o)}
            if o.lang:
                return {"@value": o.value, "@language": o.lang, **({"@direction": o.direction} if o.direction else {})}
            if rdf_direction == "i18n-datatype" and o.datatype.startswith("https://www.w3.org/ns/i18n#"):
                lang, _, direction = o.datatype.partition("#")[2].partition("_")
                return {"@value": o.value, **({"@language": lang} if lang else {}), "@direction": direction}
            if o.datatype == RDF + "JSON":
                return {"@value": json.loads(o.value), "@type": "@json"}
            if native_types and o.datatype == XSD + "boolean" and o.value in ("true", "false"):
                return {"@value": o.value == "true"}
            if native_types and o.datatype in (XSD + "integer", XSD + "double"):
                return {"@value": int(o.value) if o.datatype == XSD + "integer" else float(o.value)}
            return {"@value": o.value} if o.datatype == XSD + "string" else {"@value": o.value, "@type": o.datatype}

        made = {}
        for s, pairs in props.items():
            node: dict = {"@id": name(s)}
            for p, objects in pairs.items():
                if p.value == RDF + "type" and not use_rdf_type and all(o.kind != LITERAL for o in objects):
                    node["@type"] = [name(o) for o in objects]
                else:
                    node[p.value] = [value(o, p) for o in objects]
            made[s] = node
        return [made[s] for s in sorted(made, key=lambda t: (t.kind, t.value)) if s not in inside]

    out = {n["@id"]: n for n in nodes(graphs.get(None, []))}
    for g, triples in graphs.items():
        if g is not None:
            out.setdefault(name(g), {"@id": name(g)})["@graph"] = nodes(triples)
    return json.dumps([out[k] for k in sorted(out)], ensure_ascii=False, indent=indent)


__all__ = ["IRI", "chain_loader", "file_loader", "no_loader", "parse_jsonld", "read_jsonld", "static_loader", "to_jsonld"]
