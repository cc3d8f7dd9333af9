"""Turtle, TriG, JSON-LD, RDF/XML and OBO files as quads. A file is read by one worker; N-Triples and N-Quads split (see rdf)."""

from __future__ import annotations

import hashlib
import json
from urllib.parse import urljoin
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplewright.plans import sparql_parser as S
from triplewright.sources.rdf import DEFAULT_GRAPH

RDF = S.RDF
XML = "{http://www.w3.org/XML/1998/namespace}"


class _Turtle(S.Parser):
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text):
            m = S._TOKEN.match(text, at)
            if not m:
                raise S.SparqlError(f"cannot read {text[at : at + 20]!r}")
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at, self.prefixes, self.base = 0, {}, ""

    def directive(self) -> bool:
        """Reads a prefix or base if one stands here."""
        kind, text = self.peek()
        word = text.lstrip("@").upper()
        if kind not in ("lang", "word") or word not in ("PREFIX", "BASE"):
            return False
        self.at += 1
        if word == "PREFIX":
            name = self.next()[1]
            self.prefixes[name[:-1]] = self.next()[1][1:-1]
        else:
            self.base = self.next()[1][1:-1]
        self.op(".")
        return True

    def triples(self) -> list:
        out: list = []
        while self.peek()[0] != "end":
            if not self.directive() and not self.op("."):
                out += self.triples_same_subject()
        return out

    def quads(self) -> list:
        """(g, s, p, o) of TriG; g is null outside graph blocks and in blocks without a name."""
        out: list = []
        while self.peek()[0] != "end":
            if self.directive() or self.op("."):
                continue
            graph, block = None, self.op("{")
            if not block and (self.word("GRAPH") or self.peek(1)[1] == "{"):
                graph, block = self.term(), True
                self.need("{")
            if not block:
                out += [(None, *t) for t in self.triples_same_subject()]
                continue
            while not self.op("}"):
                if not self.op("."):
                    out += [(graph, *t) for t in self.triples_same_subject()]
        return out


def turtle(text: str, scope: str = "") -> list[tuple[str, str, str]]:
    """Triples of a Turtle text; blank nodes are named within scope."""
    name = lambda t: f"_:{scope}{t.name.lstrip('_')}" if isinstance(t, S.Var) else t
    return [tuple(map(name, t)) for t in _Turtle(text).triples()]


def trig(text: str, scope: str = "") -> list[tuple]:
    """Quads of a TriG text; blank nodes are named within scope."""
    name = lambda t: f"_:{scope}{t.name.lstrip('_')}" if isinstance(t, S.Var) else t
    return [tuple(map(name, t)) for t in _Turtle(text).quads()]


class _JsonLd:
    """Quads of a JSON-LD document: inline contexts (terms, prefixes, vocabulary, base, language, containers), nested nodes, values, lists, sets, graphs.

    Contexts by address are not fetched: they are errors, as are reversed properties.
    """

    def __init__(self, scope: str):
        self.scope, self.out, self.count = scope, [], 0

    def blank(self, name: str | None = None) -> str:
        self.count += name is None
        return f"_:{self.scope}{name or f'j{self.count}'}"

    def context(self, active: dict, local) -> dict:
        out = dict(active)
        for part in local if isinstance(local, list) else [local]:
            if part is None:
                out = {}
            elif isinstance(part, str):
                raise ValueError(f"the context {part} is not in the document")
            else:
                out |= part
        return out

    def expand(self, name: str, ctx: dict, vocabulary: bool = False, depth: int = 0) -> str | None:
        """The IRI (or _:name) of a name; null for what means nothing in the context. vocabulary: for properties and types."""
        if name.startswith("@") or depth > 20:
            return name
        if name in ctx and (vocabulary or depth):
            term = ctx[name]
            target = term.get("@id", name) if isinstance(term, dict) else term
            if target is None:
                return None
            if target != name:
                return self.expand(target, ctx, True, depth + 1)
        prefix, colon, rest = name.partition(":")
        if colon:
            if prefix == "_":
                return self.blank(rest)
            if prefix in ctx and not rest.startswith("//"):
                return (self.expand(prefix, ctx, True, depth + 1) or "") + rest
            return name
        if vocabulary:
            return ctx["@vocab"] + name if ctx.get("@vocab") else None
        return urljoin(ctx.get("@base", ""), name)

    @staticmethod
    def term(iri: str) -> str:
        return iri if iri.startswith("_:") else f"<{iri}>"

    def node(self, e: dict, ctx: dict, graph) -> str:
        """The node's term, after its statements."""
        ctx = self.context(ctx, e["@context"]) if "@context" in e else ctx
        key = lambda k: self.expand(k, ctx, True)
        named = {key(k): v for k, v in e.items() if (key(k) or "").startswith("@")}
        s = self.term(self.expand(named["@id"], ctx)) if "@id" in named else self.blank()
        if "@reverse" in named:
            raise ValueError("reversed properties are not read")
        for t in self.each(named.get("@type", [])):
            self.out.append((graph, s, f"<{RDF}type>", self.term(self.expand(t, ctx, True) or urljoin(ctx.get("@base", ""), t))))
        for k, v in e.items():
            p = key(k)
            if p and not p.startswith("@") and ":" in p:
                rule = ctx.get(k) if isinstance(ctx.get(k), dict) else {}
                if rule.get("@container") == "@list" and not (isinstance(v, dict) and "@list" in v):
                    v = {"@list": self.each(v)}
                if rule.get("@container") == "@language" and isinstance(v, dict):
                    v = [{"@value": x, "@language": lang} for lang, xs in v.items() for x in self.each(xs)]
                for x in self.each(v):
                    if (o := self.value(x, rule, ctx, graph)) is not None:
                        self.out.append((graph, s, self.term(p), o))
        if "@graph" in named:
            for x in self.each(named["@graph"]):  # a node that holds a graph names it
                self.node(x, ctx, s)
        return s

    @classmethod
    def each(cls, v) -> list:
        """The members of a list or set, a set's sets among them; anything else is a single one."""
        if isinstance(v, dict) and "@set" in v:
            v = v["@set"]
        return [] if v is None else [x for y in v for x in (cls.each(y) if isinstance(y, dict) and "@set" in y else [y])] if isinstance(v, list) else [v]

    def value(self, v, rule: dict, ctx: dict, graph) -> str | None:
        if isinstance(v, dict) and "@value" in v:
            x, kind, lang = v["@value"], v.get("@type"), v.get("@language")
            return None if x is None else self.literal(x, self.expand(kind, ctx, True) if kind else None, lang)
        if isinstance(v, dict) and "@list" in v:
            head = f"<{RDF}nil>"
            for x in reversed(self.each(v["@list"])):
                if (o := self.value(x, rule, ctx, graph)) is not None:
                    cell = self.blank()
                    self.out += [(graph, cell, f"<{RDF}first>", o), (graph, cell, f"<{RDF}rest>", head)]
                    head = cell
            return head
        if isinstance(v, dict):
            return self.node(v, ctx, graph)
        if v is None:
            return None
        kind = rule.get("@type")
        if isinstance(v, str) and kind in ("@id", "@vocab"):
            return self.term(self.expand(v, ctx, kind == "@vocab") or self.expand(v, ctx))
        return self.literal(v, self.expand(kind, ctx, True) if kind else None, rule.get("@language", ctx.get("@language")) if isinstance(v, str) and not kind else None)

    @staticmethod
    def literal(x, datatype: str | None, lang: str | None) -> str:
        if isinstance(x, bool):
            return S.literal("true" if x else "false", datatype=datatype or S.XSD + "boolean")
        whole = isinstance(x, int) or isinstance(x, float) and x.is_integer()
        if isinstance(x, int | float) and abs(x) < 1e21 and (whole and datatype is None or isinstance(x, int)):
            return S.literal(str(int(x)), datatype=datatype or S.XSD + "integer")
        if isinstance(x, int | float):
            digits, power = f"{x:.15E}".split("E")
            digits = digits.rstrip("0")
            return S.literal(f"{digits + '0' if digits.endswith('.') else digits}E{int(power)}", datatype=datatype or S.XSD + "double")
        return S.literal(x, lang, datatype)


def jsonld(text: str, scope: str = "") -> list[tuple]:
    """Quads of a JSON-LD document."""
    reader, document = _JsonLd(scope), json.loads(text)
    for e in document if isinstance(document, list) else [document]:
        ctx = reader.context({}, e["@context"]) if "@context" in e else {}
        if set(e) <= {"@context", "@graph"}:
            for x in reader.each(e.get("@graph")):
                reader.node(x, ctx, None)
        else:
            reader.node(e, {}, None)
    return reader.out


def rdfxml(text: str, scope: str = "") -> list[tuple[str, str, str]]:
    """Triples of RDF/XML: node elements, property elements and attributes, nested nodes, collections, literals with type and language."""
    root, out, counter = ElementTree.fromstring(text), [], [0]
    base = root.get(XML + "base", "")
    iri = lambda tag: tag[1:].replace("}", "")
    full = lambda ref: f"<{ref if ':' in ref else base + ref}>"

    def blank(name: str | None = None) -> str:
        counter[0] += name is None
        return f"_:{scope}{name or f'x{counter[0]}'}"

    def node(e, lang) -> str:
        lang = e.get(XML + "lang", lang)
        about, ident, named = e.get(f"{{{RDF}}}about"), e.get(f"{{{RDF}}}ID"), e.get(f"{{{RDF}}}nodeID")
        s = full(about) if about is not None else f"<{base}#{ident}>" if ident else blank(named)
        if iri(e.tag) != RDF + "Description":
            out.append((s, f"<{RDF}type>", f"<{iri(e.tag)}>"))
        for k, v in e.attrib.items():
            if not k.startswith((f"{{{RDF}}}", XML)):
                out.append((s, f"<{iri(k)}>", S.literal(v, lang)))
        for child in e:
            prop(s, child, lang)
        return s

    def prop(s, e, lang) -> None:
        lang, p = e.get(XML + "lang", lang), f"<{iri(e.tag)}>"
        resource, named, kind = e.get(f"{{{RDF}}}resource"), e.get(f"{{{RDF}}}nodeID"), e.get(f"{{{RDF}}}parseType")
        if resource is not None:
            out.append((s, p, full(resource)))
        elif named:
            out.append((s, p, blank(named)))
        elif kind == "Collection":
            cells = [(blank(), node(c, lang)) for c in e]
            out.append((s, p, cells[0][0] if cells else f"<{RDF}nil>"))
            for i, (cell, item) in enumerate(cells):
                out.extend([(cell, f"<{RDF}first>", item), (cell, f"<{RDF}rest>", cells[i + 1][0] if i + 1 < len(cells) else f"<{RDF}nil>")])
        elif kind == "Resource":
            b = blank()
            out.append((s, p, b))
            for c in e:
                prop(b, c, lang)
        elif len(e):
            for c in e:
                out.append((s, p, node(c, lang)))
        else:
            datatype = e.get(f"{{{RDF}}}datatype")
            out.append((s, p, S.literal(e.text or "", None if datatype else lang, datatype)))

    for e in root if iri(root.tag) == RDF + "RDF" else [root]:
        node(e, root.get(XML + "lang"))
    return out


def obo(text: str, scope: str = "") -> list[tuple[str, str, str]]:
    """Triples of OBO stanzas: names, definitions, synonyms, is_a, obsolescence."""
    out, rdfs, owl = [], "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#"
    term = lambda i: f"<http://purl.obolibrary.org/obo/{i.replace(':', '_')}>" if ":" in i else f"<http://purl.obolibrary.org/obo/{i}>"
    for stanza in text.split("\n[")[1:]:
        kind, _, body = stanza.partition("]")
        pairs = [line.partition(": ")[::2] for line in body.splitlines() if ": " in line]
        s = next((term(v.strip()) for k, v in pairs if k == "id"), None)
        if s is None:
            continue
        out.append((s, f"<{RDF}type>", f"<{owl}{'Class' if kind == 'Term' else 'ObjectProperty' if kind == 'Typedef' else 'NamedIndividual'}>"))
        for k, v in pairs:
            quoted = v.split('"')[1] if v.count('"') > 1 else v
            value = v.split(" ! ")[0].strip()
            if k == "name":
                out.append((s, f"<{rdfs}label>", S.literal(v.strip())))
            elif k == "def":
                out.append((s, "<http://purl.obolibrary.org/obo/IAO_0000115>", S.literal(quoted)))
            elif k == "synonym":
                out.append((s, "<http://www.geneontology.org/formats/oboInOwl#hasExactSynonym>", S.literal(quoted)))
            elif k == "is_a":
                out.append((s, f"<{rdfs}{'subClassOf' if kind == 'Term' else 'subPropertyOf'}>", term(value)))
            elif k == "is_obsolete" and value == "true":
                out.append((s, f"<{owl}deprecated>", S.literal("true", datatype=S.XSD + "boolean")))
    return out


#: Parsers of a file's text: they give triples, or quads whose graph may be null.
PARSERS = {"turtle": turtle, "trig": trig, "jsonld": jsonld, "rdfxml": rdfxml, "obo": obo}


def load(spark: SparkSession, path: str, syntax: str, graph: str | None = None) -> DataFrame:
    """Distinct quads of whole files, those outside named graphs in `graph`; a file that cannot be read fails the job with its name, a syntax that isn't known at once."""
    if syntax not in PARSERS:
        raise ValueError(f"unknown syntax {syntax!r}; known are {', '.join(PARSERS)}")
    parse = PARSERS[syntax]

    def run(batches):
        for batch in batches:
            rows = []
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    found = parse(content.decode("utf-8-sig"), hashlib.md5(name.encode()).hexdigest()[:8] + "_")
                    rows += [t if len(t) == 4 else (None, *t) for t in found]
                except Exception as e:
                    raise ValueError(f"{name}: {e}") from e
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["g", "s", "p", "o"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "g string, s string, p string, o string").select(F.coalesce("g", F.lit(graph or DEFAULT_GRAPH)).alias("g"), "s", "p", "o").distinct()
