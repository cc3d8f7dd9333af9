"""Manchester class expressions: parser, references, evaluation on DataFrames.

An expression gives the set of classes below it: (g, cls). Named classes are reflexive-transitive closures, and/or/not are set operations,
restrictions are joins over the restriction and asserter tables, widened by sub-properties and subclasses.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplewright.functions import terms as T
from triplewright.operators import axioms, expressions
from triplewright.operators.hierarchy import reachable
from triplewright.operators.staging import stage

XSD = T.XSD


class ParseError(ValueError):
    pass


class AmbiguousLabel(ValueError):
    pass


@dataclass(frozen=True)
class Named:
    ref: str


@dataclass(frozen=True)
class And:
    left: object
    right: object


@dataclass(frozen=True)
class Or:
    left: object
    right: object


@dataclass(frozen=True)
class Not:
    inner: object


@dataclass(frozen=True)
class Restriction:
    """kind: some, only, value, self, min, max, exactly."""

    prop: str
    kind: str
    filler: object = None
    n: int | None = None
    inverse: bool = False


@dataclass(frozen=True)
class Datatype:
    name: str
    facets: tuple = ()


@dataclass(frozen=True)
class Literal:
    term: str


_TOKEN = re.compile(r"\s*(?:(<[^>]*>)|('(?:[^'\\]|\\.)*')|(\"(?:[^\"\\]|\\.)*\"(?:@[A-Za-z-]+|\^\^[\w:]+)?)|([()\[\]{},]|<=|>=|<|>)|([+-]?[0-9]+(?:\.[0-9]+)?(?![\w:]))|([\w:./#~-]+))")
_KEYWORDS = {"and", "or", "not", "some", "only", "value", "self", "min", "max", "exactly", "inverse", "that"}
_DATATYPES = {"integer", "int", "decimal", "double", "float", "string", "boolean", "date", "dateTime", "nonNegativeInteger", "positiveInteger"}
#: Facets and their names.
FACETS = {">=": XSD + "minInclusive", ">": XSD + "minExclusive", "<=": XSD + "maxInclusive", "<": XSD + "maxExclusive", "length": XSD + "length", "minLength": XSD + "minLength", "maxLength": XSD + "maxLength", "pattern": XSD + "pattern"}


class _Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ParseError(f"cannot read {text[at : at + 15]!r}")
            self.tokens.append(m[0].strip())
            at = m.end()
        self.at = 0

    def peek(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self, *words):
        t = self.peek()
        if t is not None and (t.lower() if t.lower() in _KEYWORDS else t) in words:
            self.at += 1
            return t
        return None

    def next(self):
        t = self.peek()
        if t is None:
            raise ParseError("the expression ends too early")
        self.at += 1
        return t

    def whole(self):
        out = self.disjunction()
        if self.peek() is not None:
            raise ParseError(f"unexpected {self.peek()!r}")
        return out

    def disjunction(self):
        left = self.conjunction()
        while self.take("or"):
            left = Or(left, self.conjunction())
        return left

    def conjunction(self):
        left = self.unary()
        while self.take("and", "that"):
            left = And(left, self.unary())
        return left

    def unary(self):
        if self.take("not"):
            return Not(self.unary())
        if self.take("("):
            out = self.disjunction()
            if not self.take(")"):
                raise ParseError("expected )")
            return out
        inverse = bool(self.take("inverse"))
        if inverse and self.take("("):
            ref = self.reference()
            self.take(")")
        else:
            ref = self.reference()
        kind = self.take("some", "only", "value", "self", "min", "max", "exactly")
        if not kind:
            if inverse:
                raise ParseError("inverse needs a restriction")
            return Named(ref)
        kind = kind.lower()
        if kind == "self":
            return Restriction(ref, kind, inverse=inverse)
        if kind in ("min", "max", "exactly"):
            number = self.next()
            if not number.isdigit():
                raise ParseError(f"expected a number, found {number!r}")
            t = self.peek()
            filler = self.filler() if t is not None and t not in (")", "and", "or") else None
            return Restriction(ref, kind, filler, int(number), inverse)
        if kind == "value":
            return Restriction(ref, kind, self.value(), inverse=inverse)
        return Restriction(ref, kind, self.filler(), inverse=inverse)

    def value(self):
        t = self.peek()
        if t and (t[0] == '"' or re.fullmatch(r"[+-]?[0-9]+(\.[0-9]+)?|true|false", t)):
            self.at += 1
            return Literal(self.literal(t))
        return Named(self.reference())

    @staticmethod
    def literal(t: str) -> str:
        if t[0] == '"':
            body, tail = t[1 : t.rindex('"')], t[t.rindex('"') + 1 :]
            return f'"{body}"' + (tail if tail.startswith("@") else f"^^<{XSD}{tail.rpartition(':')[2]}>" if tail and not tail.endswith(":string") else "")
        kind = "boolean" if t in ("true", "false") else "decimal" if "." in t else "integer"
        return f'"{t}"^^<{XSD}{kind}>'

    def filler(self):
        t = self.peek()
        if t and t.startswith("xsd:") and t[4:] in _DATATYPES or t in _DATATYPES:
            self.at += 1
            found = []
            if self.take("["):
                while not self.take("]"):
                    facet = self.next()
                    if facet not in FACETS:
                        raise ParseError(f"unknown facet {facet!r}")
                    found.append((FACETS[facet], self.literal(self.next())))
                    self.take(",")
            return Datatype(XSD + t.removeprefix("xsd:"), tuple(found))
        return self.unary()

    def reference(self) -> str:
        t = self.next()
        if t in "()[]{},<=>=" or t.lower() in _KEYWORDS or t[0] == '"':
            raise ParseError(f"expected a name, found {t!r}")
        return t[1:-1] if t[0] in "<'" else t


def parse(text: str):
    return _Parser(text).whole()


def references(node) -> set[str]:
    if isinstance(node, Named):
        return {node.ref}
    if isinstance(node, And | Or):
        return references(node.left) | references(node.right)
    if isinstance(node, Not):
        return references(node.inner)
    if isinstance(node, Restriction):
        return {node.prop} | (references(node.filler) if node.filler is not None else set())
    return set()


def _wanted(refs: set[str]) -> tuple[dict[str, str], dict[str, tuple[str, str]]]:
    """References that are IRIs, and of the others what local name and what normalised label they stand for."""
    from triplewright.operators.search import normalise

    direct = {r: r for r in refs if re.match(r"[a-z][a-z0-9+.-]*:", r)}
    return direct, {r: (re.sub(r"^.*\((\w+):(\w+)\)$", r"\1_\2", r) if r.endswith(")") else r.replace(":", "_"), normalise(r)) for r in refs if r not in direct}


def resolve_versions(index: DataFrame, refs: set[str]) -> list[tuple[dict[str, str], DataFrame | None]]:
    """(reference -> IRI, versions (g) in which the references stand for these), as many as there are ways to read them.

    Each version reads a name by local name, else by normalised label, in its own entities; versions that don't know every name are left out. A name that
    no version knows is an error, as is one that stands for several terms of one version. References that are IRIs alone hold in all versions (None).
    """
    direct, wanted = _wanted(refs)
    if not wanted:
        return [(direct, None)]
    names = index.sparkSession.createDataFrame([(r, *x) for r, x in wanted.items()], "ref string, wanted_short string, wanted_norm string")  # a row per name written
    rows = index.select(F.col("version_id").alias("g"), "iri", "short", "norm")
    hits = [rows.join(F.broadcast(names), F.col(c) == F.col(f"wanted_{c}")).select("g", "ref", "iri", F.lit(i).alias("rank")) for i, c in enumerate(("short", "norm"))]
    found = stage(hits[0].unionByName(hits[1]).groupBy("g", "ref", "rank").agg(F.array_sort(F.collect_set("iri")).alias("iris")).groupBy("g", "ref").agg(F.min_by("iris", "rank").alias("iris")))
    known = {r.ref for r in found.select("ref").distinct().collect()}  # at most the names written
    for r in wanted:
        if r not in known:
            raise ParseError(f"unknown name {r!r}")
    if several := found.where("size(iris) > 1").first():
        raise AmbiguousLabel(f"{several.ref!r} stands for {', '.join(several.iris)}")
    able = found.groupBy("g").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("ref", F.col("iris")[0].alias("iri")))).alias("read")).where(F.col("n") == len(wanted))
    able = stage(able.select("g", "read"))
    ways = able.select("read").distinct().collect()
    return [(direct | {x.ref: x.iri for x in w.read}, able.where(F.col("read") == F.array(*(F.struct(F.lit(x.ref).alias("ref"), F.lit(x.iri).alias("iri")) for x in w.read))).select("g")) for w in ways]


def resolve(index: DataFrame, refs: set[str]) -> dict[str, str]:
    """reference -> IRI, where all versions read them in one way; names that stand for different terms are an error."""
    ways = resolve_versions(index, refs)
    if len(ways) > 1:
        raise AmbiguousLabel(f"versions read {', '.join(sorted(r for r in ways[0][0] if any(w[0][r] != ways[0][0][r] for w in ways)))} in different ways")
    return ways[0][0] if ways else _wanted(refs)[0]


def expression_key(node, names: dict[str, str]) -> tuple[str, str | None, list[str]]:
    """(key, kind, members) of an expression, as expressions.keys has it for stored ones."""
    if isinstance(node, Named):
        return f"<{names[node.ref]}>", None, []
    if isinstance(node, Literal):
        return node.term, None, []
    if isinstance(node, Datatype):
        return (expressions.key_of_data(f"<{node.name}>", [(f"<{f}>", v) for f, v in node.facets]) if node.facets else f"<{node.name}>"), None, []
    if isinstance(node, And | Or):
        kind = "and" if isinstance(node, And) else "or"
        return expressions.key_of_set(kind, [expression_key(node.left, names), expression_key(node.right, names)])
    if isinstance(node, Not):
        return expressions.key_of("not", expression_key(node.inner, names)[0]), None, []
    if node.kind == "self":
        filler = f'"true"^^<{XSD}boolean>'
    else:
        filler = expression_key(node.filler, names)[0] if node.filler is not None else f"<{axioms.OWL}Thing>"
    return expressions.key_of_restriction(node.kind, f"<{names[node.prop]}>", bool(node.inverse), node.n if node.kind in ("min", "max", "exactly") else None, filler), None, []


class Evaluator:
    """Tables of a quad store for evaluation; all versions (graphs) at once."""

    def __init__(self, quads: DataFrame, index: DataFrame, inferred: DataFrame | None = None):
        self.quads, self.index = quads, index
        typed = quads.where((F.col("p") == f"<{axioms.RDF}type>") & (F.col("o") == f"<{axioms.OWL}Class>") & F.col("s").startswith("<"))
        self.all = typed.select("g", F.col("s").alias("cls")).distinct()
        self.edges = quads.where((F.col("p") == f"<{axioms.RDFS}subClassOf>") & F.col("s").startswith("<") & F.col("o").startswith("<")).select("g", F.col("s").alias("child"), F.col("o").alias("parent"))
        if inferred is not None:
            self.edges = self.edges.unionByName(inferred)
        self.properties = quads.where(F.col("p") == f"<{axioms.RDFS}subPropertyOf>").select("g", F.col("s").alias("child"), F.col("o").alias("parent"))
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = stage({"restrictions": axioms.restrictions, "asserters": axioms.asserters, "facets": axioms.facets, "expressions": expressions.keys}[name](self.quads))
        return self._tables[name]

    def below(self, classes: DataFrame, direct: bool = False) -> DataFrame:
        """Classes (g, cls) and everything below them."""
        seeds = classes.select("g", F.col("cls").alias("parent")).distinct()
        if direct:
            down = self.edges.join(seeds, ["g", "parent"], "left_semi").select("g", F.col("child").alias("cls"))
        else:
            down = reachable(self.edges, "parent", "child", seeds, ["g"]).select("g", F.col("child").alias("cls"))
        return classes.select("g", "cls").unionByName(down).distinct()

    def graphs(self) -> DataFrame:
        return self.quads.select("g").distinct()

    def run(self, text: str, direct: bool = False) -> DataFrame:
        """(g, cls) of an expression's named subclasses; each version reads names in its own way, and one that doesn't know them all has no answers."""
        node, out = parse(text), None
        for names, versions in resolve_versions(self.index, references(node)):
            found = self.evaluate(node, names, direct)
            found = found if versions is None else found.join(versions, "g", "left_semi").select("g", "cls")
            out = found if out is None else out.unionByName(found)
        return self.all.limit(0) if out is None else out

    def evaluate(self, node, names: dict[str, str], direct: bool = False) -> DataFrame:
        if isinstance(node, Named):
            iri = names[node.ref]
            if iri.endswith("owl#Thing"):
                return self.all
            here = self.all.where(F.col("cls") == f"<{iri}>")
            if direct:
                return self.below(self.graphs().withColumn("cls", F.lit(f"<{iri}>")), True).where(F.col("cls") != f"<{iri}>")
            return self.below(here)
        if isinstance(node, And):
            return self.evaluate(node.left, names, direct).intersect(self.evaluate(node.right, names, direct))
        if isinstance(node, Or):
            return self.evaluate(node.left, names, direct).unionByName(self.evaluate(node.right, names, direct)).distinct()
        if isinstance(node, Not):
            return self.all.subtract(self.evaluate(node.inner, names, False))
        return self.restriction(node, names)

    def restriction(self, node: Restriction, names: dict[str, str]) -> DataFrame:
        prop = f"<{names[node.prop]}>"
        subs = reachable(self.properties, "parent", "child", self.graphs().withColumn("parent", F.lit(prop)), ["g"]).select("g", F.col("child").alias("prop"))
        props = self.graphs().withColumn("prop", F.lit(prop)).unionByName(subs).distinct()
        if node.inverse:
            return self.inverse(node, names, props)
        rows = self.table("restrictions").where("not inverse").join(props, ["g", "prop"], "left_semi")
        rows = self.by_filler(rows, node, names)
        stated = self.table("asserters").where("startswith(cls, '<')")
        if node.kind in ("only", "value", "self"):
            stated = stated.where("src = 'sub'")
        return self.below(stated.join(rows.select("g", "node").distinct(), ["g", "node"], "left_semi").select("g", "cls").distinct())

    def by_filler(self, rows: DataFrame, node: Restriction, names: dict[str, str]) -> DataFrame:
        f, thing = node.filler, f"<{axioms.OWL}Thing>"
        if node.kind in ("min", "max", "exactly"):
            test = {"min": F.col("n") >= node.n, "max": F.col("n") <= node.n, "exactly": F.col("n") == node.n}[node.kind]
            kinds = rows.where((F.col("kind") == node.kind) & test)
            if node.kind == "min" and node.n <= 1:  # some is min 1
                kinds = kinds.unionByName(rows.where("kind = 'some'"))
            # an unqualified restriction is one of owl:Thing
            if f is None or isinstance(f, Named):
                return kinds.where(F.col("filler") == (f"<{names[f.ref]}>" if f is not None else thing))
            return self.by_key(kinds, f, names)
        rows = rows.where(F.col("kind") == node.kind)
        if node.kind == "self":
            return rows.where(F.col("filler") == f'"true"^^<{XSD}boolean>')
        if isinstance(f, Literal):
            return rows.where(F.col("filler") == f.term)
        if isinstance(f, Named):
            return rows.where(F.col("filler") == f"<{names[f.ref]}>")
        if isinstance(f, Datatype):
            if not f.facets:
                return rows.where(F.col("filler") == f"<{f.name}>")
            hit = F.lit(False)
            for facet, value in f.facets:
                hit = hit | ((F.col("facet") == f"<{facet}>") & (F.col("value") == value))
            nodes = self.table("facets").where(F.col("base") == f"<{f.name}>").where(hit).groupBy("g", F.col("node").alias("filler")).agg(F.count_distinct("facet").alias("k")).where(F.col("k") == len({x for x, _ in f.facets}))
            return rows.join(nodes.select("g", "filler"), ["g", "filler"], "left_semi")
        return self.by_key(rows, f, names)

    def by_key(self, rows: DataFrame, filler, names: dict[str, str]) -> DataFrame:
        """Rows whose filler is the same expression."""
        same = self.table("expressions").where(F.col("key") == expression_key(filler, names)[0]).select("g", F.col("node").alias("filler"))
        return rows.join(same, ["g", "filler"], "left_semi")

    def inverse(self, node: Restriction, names: dict[str, str], props: DataFrame) -> DataFrame:
        """Fillers of the forward restriction that the filler class or a class below it holds."""
        holders = self.evaluate(node.filler, names) if node.filler is not None else self.all
        rows = self.table("restrictions").where("not inverse and kind = 'some' and startswith(filler, '<')").join(props, ["g", "prop"], "left_semi")
        held = self.table("asserters").join(holders, ["g", "cls"], "left_semi")
        return rows.join(held.select("g", "node").distinct(), ["g", "node"], "left_semi").select("g", F.col("filler").alias("cls")).distinct()

    def relation(self, text: str, relation: str) -> DataFrame:
        """Superclasses of a named class, or classes equivalent to it (each reaching the other)."""
        node = parse(text)
        if not isinstance(node, Named):
            raise ParseError("only a named class has superclasses and equivalents here")
        term = f"<{resolve(self.index, {node.ref})[node.ref]}>"
        up = reachable(self.edges, "child", "parent", self.graphs().withColumn("child", F.lit(term)), ["g"]).select("g", F.col("parent").alias("cls")).where(F.col("cls") != term)
        if relation == "superclasses":
            return up
        down = self.below(self.graphs().withColumn("cls", F.lit(term)))
        return up.intersect(down)

    def labelled(self, result: DataFrame, lang: str | None = None) -> DataFrame:
        """(g, iri, label), the label in a language where there is one, else the local name."""
        from triplewright.functions import text as X

        named = self.index.select(F.col("version_id").alias("g"), "iri", "label", "labels")
        out = result.select("g", T.lexical(F.col("cls")).alias("iri")).join(named, ["g", "iri"], "left")
        return out.select("g", "iri", F.coalesce(X.choose_label(F.col("labels"), lang, F.col("label")), X.local_name(F.col("iri"))).alias("label"))
