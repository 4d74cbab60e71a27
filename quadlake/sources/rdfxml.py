"""RDF/XML documents."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession

from .. import iri as iris
from ..terms import BNODE, IRI, LITERAL, RDF, XML, XSD, Term, bnode, iri, literal
from .turtle import new_scopes, read_documents

_R = f"{{{RDF}}}"
# Names that mean syntax, not properties.
_SYNTAX = {"RDF", "ID", "about", "bagID", "parseType", "resource", "nodeID", "datatype", "li", "Description", "aboutEach", "aboutEachPrefix"}


class _Reader:
    def __init__(self, base: str | None, scope: str):
        self.base, self.scope, self.fresh, self.out, self.ids = base, scope, 0, [], set()

    def new(self) -> Term:
        self.fresh += 1
        return bnode(f"x{self.fresh}{self.scope}")

    def resolve(self, text: str, base: str | None) -> Term:
        return iri(iris.resolve(base, text) if base and not iris.is_absolute(text) else text)

    def name(self, tag: str) -> Term:
        if not tag.startswith("{"):
            raise ValueError(f"a name without a namespace: {tag}")
        return iri(tag[1:].replace("}", ""))

    def by_id(self, text: str, base: str | None) -> Term:
        t = self.resolve("#" + text, base)
        if t.value in self.ids:
            raise ValueError(f"rdf:ID {text} twice")
        self.ids.add(t.value)
        return t

    def add(self, s: Term, p: Term, o: Term) -> None:
        self.out.append((None, s, p, o))

    def document(self, root: ET.Element) -> None:
        base, lang = self.context(root, self.base, None)
        for e in root if root.tag == _R + "RDF" else [root]:
            self.node(e, base, lang)

    def context(self, e: ET.Element, base, lang):
        base = iris.resolve(base, e.get(f"{{{XML}}}base")) if base and e.get(f"{{{XML}}}base") is not None else e.get(f"{{{XML}}}base", base)
        return base, e.get(f"{{{XML}}}lang", lang)

    def subject(self, e: ET.Element, base) -> Term:
        if _R + "about" in e.attrib:
            return self.resolve(e.get(_R + "about"), base)
        if _R + "ID" in e.attrib:
            return self.by_id(e.get(_R + "ID"), base)
        if _R + "nodeID" in e.attrib:
            return bnode(e.get(_R + "nodeID") + self.scope)
        return self.new()

    def attributes(self, s: Term, e: ET.Element, lang, base) -> None:
        for k, v in e.attrib.items():
            if k.startswith(f"{{{XML}}}") or (k.startswith(_R) and k.removeprefix(_R) in _SYNTAX) or not k.startswith("{"):
                continue
            if k == _R + "type":
                self.add(s, iri(RDF + "type"), self.resolve(v, base))
            else:
                self.add(s, self.name(k), literal(v, lang=lang or None))

    def node(self, e: ET.Element, base, lang) -> Term:
        base, lang = self.context(e, base, lang)
        s = self.subject(e, base)
        if e.tag != _R + "Description":
            self.add(s, iri(RDF + "type"), self.name(e.tag))
        self.attributes(s, e, lang, base)
        counter = 0
        for child in e:
            p = self.name(child.tag)
            if child.tag == _R + "li":
                counter += 1
                p = iri(f"{RDF}_{counter}")
            self.property(s, p, child, base, lang)
        return s

    def property(self, s: Term, p: Term, e: ET.Element, base, lang) -> None:
        base, lang = self.context(e, base, lang)
        kind = e.get(_R + "parseType")
        if kind == "Resource":
            o = self.new()
            self.add(s, p, o)
            for child in e:
                self.property(o, self.name(child.tag), child, base, lang)
        elif kind == "Collection":
            items = [self.node(c, base, lang) for c in e]
            cells = [self.new() for _ in items]
            o = cells[0] if cells else iri(RDF + "nil")
            self.add(s, p, o)
            for i, x in enumerate(items):
                self.add(cells[i], iri(RDF + "first"), x)
                self.add(cells[i], iri(RDF + "rest"), cells[i + 1] if i + 1 < len(items) else iri(RDF + "nil"))
        elif kind is not None:
            o = literal((e.text or "") + "".join(ET.tostring(c, encoding="unicode") for c in e), RDF + "XMLLiteral")
            self.add(s, p, o)
        elif len(e):
            o = self.node(e[0], base, lang)
            self.add(s, p, o)
        elif _R + "resource" in e.attrib or _R + "nodeID" in e.attrib or any(k.startswith("{") and not k.startswith(f"{{{XML}}}") and k not in (_R + "ID", _R + "datatype") for k in e.attrib):
            o = self.resolve(e.get(_R + "resource"), base) if _R + "resource" in e.attrib else bnode(e.get(_R + "nodeID") + self.scope) if _R + "nodeID" in e.attrib else self.new()
            self.attributes(o, e, lang, base)
            self.add(s, p, o)
        else:
            datatype = e.get(_R + "datatype")
            o = literal(e.text or "", self.resolve(datatype, base).value) if datatype else literal(e.text or "", lang=lang or None)
            self.add(s, p, o)
        if _R + "ID" in e.attrib:
            me = self.by_id(e.get(_R + "ID"), base)
            for name, x in (("type", iri(RDF + "Statement")), ("subject", s), ("predicate", p), ("object", o)):
                self.add(me, iri(RDF + name), x)


def parse_rdfxml(text: str, base: str | None = None, bnode_scope: str = "") -> list[tuple]:
    r = _Reader(base, bnode_scope)
    r.document(ET.fromstring(text))
    return r.out


def read_rdfxml(spark: SparkSession, path: str, base: str | None = None, preserve_bnodes: bool = False) -> DataFrame:
    scope = new_scopes(preserve_bnodes)
    return read_documents(spark, path, lambda text, name: parse_rdfxml(text, base or name, scope(name)))


def to_rdfxml(triples: list[tuple]) -> str:
    """A document of the triples that RDF/XML can hold; others (triple terms, predicates without a local name) are left out."""
    spaces: dict[str, str] = {RDF: "rdf"}
    body = []
    by_subject: dict[Term, list] = {}
    for t in triples:
        by_subject.setdefault(t[-3], []).append(t[-2:])
    for s, pairs in by_subject.items():
        if s.kind not in (IRI, BNODE):
            continue
        inner = []
        for p, o in pairs:
            m = re.match(r"^(.*?)([A-Za-z_][\w.\-]*)$", p.value) if p.kind == IRI else None
            if not m or o.kind not in (IRI, BNODE, LITERAL):
                continue
            name = f"{spaces.setdefault(m[1], f'n{len(spaces)}')}:{m[2]}"
            if o.kind == LITERAL:
                attribute = f" xml:lang={quoteattr(o.lang)}" if o.lang else "" if o.datatype == XSD + "string" else f" rdf:datatype={quoteattr(o.datatype)}"
                inner.append(f"    <{name}{attribute}>{escape(o.value)}</{name}>")
            else:
                inner.append(f"    <{name} rdf:{'resource' if o.kind == IRI else 'nodeID'}={quoteattr(o.value)}/>")
        if inner:
            body += [f"  <rdf:Description rdf:{'about' if s.kind == IRI else 'nodeID'}={quoteattr(s.value)}>", *inner, "  </rdf:Description>"]
    names = "".join(f" xmlns:{v}={quoteattr(k)}" for k, v in spaces.items())
    return "\n".join([f'<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF{names}>', *body, "</rdf:RDF>", ""])
