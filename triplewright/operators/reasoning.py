"""Reasoning in OWL 2 EL over quads: classification, unsatisfiable classes, justifications, and changes without starting anew.

Facts are rows (g, x, p, c): with an empty p, c subsumes x; else x has a p-successor in c. Nodes are classes, individuals and blank class expressions alike. Each
rule takes one axiom and one or two facts (an intersection: one fact per member):

- a below b (subclass, equivalence, type, member of a union, a member's intersection): what is below a is below b
- all members of an intersection: the intersection
- an existential restriction: a successor; a successor in the filler: the restriction (cardinalities of at least one and values are such restrictions)
- subproperties; chains of two properties (longer ones and transitive properties are written as such); domains; ranges, on a successor of the property's own
- two members of a disjoint set, or a class and its complement: owl:Nothing; a successor in owl:Nothing: owl:Nothing

Each round joins what the round before found with the axioms and with all facts known, so that no pair of known facts is joined again, and is written to
the shared folder. With `keep`, every rule's use is a row (conclusion, rule, premises, axiom), whether its conclusion was known or not: the table of
derivations from which justifications and retractions are read. Graphs are apart from each other.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triplewright.operators.axioms import KINDS, OWL, RDF, RDFS, lists, restrictions
from triplewright.operators.hierarchy import reachable
from triplewright.operators.staging import stage

THING, NOTHING = f"<{OWL}Thing>", f"<{OWL}Nothing>"
#: Forms of facts: subsumptions, those by owl:Nothing, successors, tags of successors.
FORMS = frozenset(("below", "empty", "leads", "tag"))
FACT = ["g", "x", "p", "c"]
#: Axioms of a kind that are broadcast: a few MB at most.
FEW = 10_000
_BUILT_IN = (f"<{OWL}", f"<{RDF}", f"<{RDFS}", "<http://www.w3.org/2001/XMLSchema#")


#: Predicates that axioms and class expressions are written with.
_SCHEMA = [f"<{OWL}{n}>" for n in (
    *KINDS, "equivalentClass", "equivalentProperty", "intersectionOf", "unionOf", "disjointUnionOf", "disjointWith", "members", "complementOf", "propertyChainAxiom", "onProperty", "onClass", "onDataRange", "inverseOf",
)] + [f"<{RDFS}{n}>" for n in ("subClassOf", "subPropertyOf", "domain", "range")] + [f"<{RDF}{n}>" for n in ("type", "first", "rest")]


def _owl(name: str) -> str:
    return f"<{OWL}{name}>"


def _union(frames: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, frames)


def axioms(quads: DataFrame) -> DataFrame:
    """(g, kind, a, b, d, ax): axioms in the forms that rules take; ax is the stated triple, null for what a class expression means by itself. A row may be there twice.

    sub (a below b), isa (a is a b), and (intersection a has b), to (a leads by b to d), from (a is led to by b into d), subprop, chain (a of b after d), domain, range (property a,
    class b), set (b is in the disjoint set a), tag (node a is a b-successor), rel (a leads by b to d, stated of individuals).

    Blank restrictions of the same property and filler are one node: each by itself they would all be below each other.
    """
    stated, whole = F.concat_ws(" ", "s", "p", "o"), quads
    typing, told_of = F.col("p") == f"<{RDF}type>", [_owl(n) for n in ("TransitiveProperty", "AllDisjointClasses", "ObjectProperty")]
    user = ~functools.reduce(Column.__or__, (F.col("o").startswith(x) for x in _BUILT_IN))
    # read once, and each predicate's files alone; what follows reads little
    quads = stage(quads.where(F.col("p").isin(*_SCHEMA) & (~typing | user | F.col("o").isin(*told_of))).select("g", "s", "p", "o"), by="p")
    there = {r.p for r in quads.select("p").distinct().collect()}
    has = lambda *names: bool(there.intersection(names))
    by = lambda *names: quads.where(F.col("p").isin(*names)).withColumn("ax", stated)

    def rows(df: DataFrame, kind: str, a, b, d=None, ax="ax") -> DataFrame:
        column = lambda c: F.lit(None).cast("string") if c is None else F.col(c) if isinstance(c, str) else c
        return df.select("g", F.lit(kind).alias("kind"), column(a).alias("a"), column(b).alias("b"), column(d).alias("d"), column(ax).alias("ax"))

    items = stage(lists(quads)) if has(f"<{RDF}first>") else None
    listed = lambda name: by(name).join(items.withColumnRenamed("head", "o"), ["g", "o"])
    has_lists = lambda name: items is not None and has(name)
    same, both = by(_owl("equivalentClass")), by(_owl("equivalentProperty"))
    out = [rows(quads.where(F.lit(False)).withColumn("ax", stated), "sub", "s", "o")]
    if has(f"<{RDFS}subClassOf>", _owl("equivalentClass")):
        out.append(rows(by(f"<{RDFS}subClassOf>", _owl("equivalentClass")), "sub", "s", "o"))
    if has(_owl("equivalentClass")):
        out.append(rows(same, "sub", "o", "s"))
    if has_lists(_owl("intersectionOf")):
        parts = listed(_owl("intersectionOf"))
        out += [rows(parts, "sub", "s", "item", ax=None), rows(parts, "and", "s", "item", ax=None)]
    if has_lists(_owl("unionOf")):
        out.append(rows(listed(_owl("unionOf")), "sub", "item", "s", ax=None))
    if has_lists(_owl("disjointUnionOf")):
        divided = listed(_owl("disjointUnionOf"))
        out += [rows(divided, "sub", "item", "s"), rows(divided, "set", "o", "item")]
    if has(f"<{RDFS}subPropertyOf>", _owl("equivalentProperty")):
        out += [rows(by(f"<{RDFS}subPropertyOf>").unionByName(both), "subprop", "s", "o"), rows(both, "subprop", "o", "s")]
    out += [rows(by(f"<{RDFS}{kind}>"), kind, "s", "o") for kind in ("domain", "range") if has(f"<{RDFS}{kind}>")]
    if has(f"<{RDF}type>"):
        typed = by(f"<{RDF}type>")
        out += [rows(typed.where(user), "isa", "s", "o"), rows(typed.where(F.col("o") == _owl("TransitiveProperty")), "chain", "s", "s", "s")]
        if has_lists(_owl("members")):
            groups = typed.where(F.col("o") == _owl("AllDisjointClasses")).select("g", "s", "ax")
            out.append(rows(groups.join(listed(_owl("members")).drop("ax"), ["g", "s"]), "set", "s", "item"))
        objects = typed.where(F.col("o") == _owl("ObjectProperty")).select("g", F.col("s").alias("p")).distinct()
        if not objects.isEmpty():
            out.append(rows(whole.withColumn("ax", stated).join(objects, ["g", "p"]), "rel", "s", "p", "o"))
    if has(_owl("disjointWith")):
        apart = by(_owl("disjointWith"))
        out += [rows(apart, "set", "ax", "s"), rows(apart, "set", "ax", "o")]
    if has(_owl("complementOf")):
        negated = by(_owl("complementOf"))
        out += [rows(negated, "set", F.concat(F.lit("not "), "s"), x, ax=None) for x in ("s", "o")]
    if has_lists(_owl("propertyChainAxiom")):
        # p1 after p2 after ... are read from the left, with a property of their own for every beginning
        chains = listed(_owl("propertyChainAxiom")).select("g", "s", "o", "ax", "pos", "item")
        ends = chains.groupBy("g", "o").agg(F.max("pos").alias("end"), F.min_by("item", "pos").alias("first"))
        steps = chains.join(ends, ["g", "o"])
        begun = lambda k: F.concat(F.lit("_:chain:"), "o", F.lit(":"), k.cast("string"))
        steps_of = steps.where("pos > 0")
        out.append(rows(steps_of, "chain", F.when(F.col("pos") == F.col("end"), F.col("s")).otherwise(begun(F.col("pos"))), F.when(F.col("pos") == 1, F.col("first")).otherwise(begun(F.col("pos") - 1)), "item"))
        out.append(rows(steps.where("end = 0"), "subprop", "item", "s"))
    told = _union(out)
    some = stage(restrictions(quads).where("not inverse and (kind in ('some', 'value') or (kind = 'min' and n = 1))").select("g", "node", "prop", "filler")) if has(_owl("onProperty")) else None
    if some is None or some.isEmpty():
        return told

    names, rest = _shared_names(some)
    told = stage(_renamed(told, names.select("g", "node", "name")), by="kind")
    some = stage(names.select("g", F.col("name").alias("node"), "prop", "filler").unionByName(_renamed(rest, names.select("g", "node", "name"), "node", "filler")).distinct())
    if has(f"<{RDFS}range>"):
        ranges = quads.where(F.col("p") == f"<{RDFS}range>").select("g", F.col("s").alias("wider")).distinct()
        wider = _union([by(f"<{RDFS}subPropertyOf>").unionByName(both).select("g", F.col("s").alias("prop"), F.col("o").alias("wider")), both.select("g", F.col("o").alias("prop"), F.col("s").alias("wider"))])
        ranged = stage(_union([reachable(wider, "prop", "wider", by=["g"]), ranges.select("g", F.col("wider").alias("prop"), "wider")]).join(ranges, ["g", "wider"]).select("g", "prop").distinct())
    # that something is below a restriction matters where that is a condition; elsewhere it says less than the successor does. A range is known of
    # the filler's own successor only, and relations are stated of the individual itself: there the restriction says more
    blank = lambda c: F.col(c).startswith("_:")
    at = lambda kinds, c: told.where(F.col("kind").isin(*kinds) & blank(c)).select("g", F.col(c).alias("node"))
    asked = _union([at(("sub", "isa", "rel"), "a"), at(("and", "set"), "b"), at(("rel",), "d"), some.where(blank("filler")).select("g", F.col("filler").alias("node"))]).distinct()
    met = [some.where(~blank("node")), some.join(asked, ["g", "node"], "left_semi")]
    if has(f"<{RDFS}range>"):
        met.append(some.join(ranged, ["g", "prop"], "left_semi"))
    if has(f"<{RDF}type>"):
        met.append(some.join(told.where("kind = 'rel'").select("g", F.col("a").alias("filler")).distinct(), ["g", "filler"], "left_semi"))
    out = [told, rows(some, "to", "node", "prop", "filler", ax=None), rows(_union([m.select(*some.columns) for m in met]).distinct(), "from", "node", "prop", "filler", ax=None)]
    if has(f"<{RDFS}range>"):
        own = some.join(ranged, ["g", "prop"]).withColumn("own", F.concat(F.lit("_:range:"), "prop", F.lit(":"), "filler"))
        out += [rows(own, "to", "node", "prop", "own", ax=None), rows(own, "sub", "own", "filler", ax=None), rows(own, "tag", "own", "prop", ax=None)]
    return _union(out)


def _shared_names(some: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(g, node, name, prop, filler): blank restrictions and the name that all of the same property and filler share, made of these; the filler is under its own.
    And restrictions without such a name: those of named classes, and those that are their own fillers."""
    name = F.concat(F.lit("_:some:"), "prop", F.lit(":"), "filler").alias("name")
    named = lambda df: df.select("g", "node", name, "prop", "filler")
    is_blank = F.col("node").startswith("_:")
    blank, rest = some.where(is_blank), some.where(~is_blank)
    nested = stage(blank.where("startswith(filler, '_:')").join(blank.select("g", F.col("node").alias("filler")), ["g", "filler"], "left_semi").select(*some.columns))
    if nested.isEmpty():
        return named(blank), rest
    names = [stage(named(blank.join(nested.select("g", "node"), ["g", "node"], "left_anti")))]
    while True:
        inner = names[-1].select("g", F.col("node").alias("filler"), F.col("name").alias("inner"))
        new = stage(named(nested.join(inner, ["g", "filler"]).select("g", "node", "prop", F.col("inner").alias("filler"))))
        if new.isEmpty():
            found = _union(names)
            return found, rest.unionByName(nested.join(found.select("g", "node"), ["g", "node"], "left_anti").select(*some.columns))
        names.append(new)


def _renamed(df: DataFrame, names: DataFrame, *columns: str) -> DataFrame:
    """df with blank nodes in its columns (a, b and d unless given) under the names that they share. Rows in which the only blank node is the second column's, the common case, meet the names once."""
    first, second, *rest = columns = columns or ("a", "b", "d")
    blank = lambda c: F.coalesce(F.col(c).startswith("_:"), F.lit(False))
    others = functools.reduce(Column.__or__, map(blank, (first, *rest)))

    def under(part: DataFrame, column: str) -> DataFrame:
        met = part.join(names.withColumnRenamed("node", column), ["g", column], "left")
        return met.withColumn(column, F.coalesce("name", column)).select(*df.columns)

    return _union([df.where(~others & ~blank(second)), under(df.where(~others & blank(second)), second), functools.reduce(under, columns, df.where(others))])


def _column(value, if_none: str | None = None) -> Column:
    return F.lit(if_none).cast("string") if value is None else F.col(value) if isinstance(value, str) else value


def _premise(x, p, c) -> Column:
    """A fact; without p, that c subsumes x."""
    return F.struct(_column(x).alias("x"), _column(p, "").alias("p"), _column(c).alias("c"))


def _row(df: DataFrame, rule: str, x, p, c, premises: list[Column] | Column, ax="ax") -> DataFrame:
    """A use of a rule; without p, its conclusion is that c subsumes x."""
    if isinstance(premises, list):
        premises = F.array(*premises).cast("array<struct<x: string, p: string, c: string>>")
    return df.select("g", _column(x).alias("x"), _column(p, "").alias("p"), _column(c).alias("c"), F.lit(rule).alias("rule"), premises.alias("premises"), _column(ax).alias("ax"))


def starting(axioms: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """What holds without premises: each node (those of `more` too, if given: g, x) is below itself (and owl:Thing, where that is used as a condition), stated relations, tags."""
    at = lambda kinds, c: axioms.where(F.col("kind").isin(*kinds)).select("g", F.col(c).alias("x"))
    nodes = _union([at(("sub", "isa", "and", "rel"), "a"), at(("sub", "isa", "and", "set", "domain", "range"), "b"), at(("to", "from", "rel"), "d"), *([] if more is None else [more])]).distinct()
    used = axioms.where(f"(kind in ('sub', 'isa') and a = '{THING}') or (kind = 'from' and d = '{THING}') or (kind in ('and', 'set') and b = '{THING}')").select("g").distinct()
    told, tags = axioms.where("kind = 'rel'"), axioms.where("kind = 'tag'")
    return _union([
        _row(nodes, "self", "x", None, "x", [], None), _row(nodes.join(used, "g"), "self", "x", None, F.lit(THING), [], None),
        _row(told, "stated", "a", "b", "d", []), _row(tags, "tag", "a", "b", F.lit(""), [], None),
    ])


def fire(new: DataFrame, known: DataFrame, axioms: DataFrame, kinds: dict[str, int], every: DataFrame | None = None, new_has: frozenset[str] = FORMS, known_has: frozenset[str] = FORMS, led: bool = True) -> DataFrame:
    """Every use of a rule with an axiom of `axioms` and facts of `known`, one of `new` at least among them. kinds: those that axioms hold, and how many of each; few are broadcast.

    new_has, known_has: forms of facts among them; rules that ask for others are left out. led: whether anything leads to what new facts are about.
    every: all axioms, where `axioms` are only some; a disjoint set's and an intersection's other members come from there.
    """
    every = axioms if every is None else every
    few = lambda frame, *names: F.broadcast(frame) if sum(kinds.get(n, 0) for n in names) <= FEW else frame
    of = lambda kind: few(axioms.where(F.col("kind") == kind), kind)
    of_every = lambda kind: of(kind) if every is axioms else every.where(F.col("kind") == kind)
    below = lambda frame, x="x", c="c": frame.where("p = ''").select("g", F.col("x").alias(x), F.col("c").alias(c))
    leads = lambda frame, x="x", p="p", y="y": frame.where("p <> '' and c <> ''").select("g", F.col("x").alias(x), F.col("p").alias(p), F.col("c").alias(y))
    out = []
    # of two facts either may be the new one
    sides = ((new, new_has, known, known_has), (known, known_has, new, new_has)) if new is not known and led else ((new, new_has, known, known_has),)
    pairs = lambda second: [(r, s) for r, in_r, s, in_s in sides if "leads" in in_r and second in in_s]

    up = few(axioms.where("kind in ('sub', 'isa')").select("g", F.col("a").alias("c"), "b", "ax"), "sub", "isa")
    out.append(_row(below(new).join(up, ["g", "c"]), "below", "x", None, "b", [_premise("x", None, "c")]))
    if "and" in kinds and "below" in new_has:
        members = of("and").select("g", F.col("a").alias("node")).distinct().join(of_every("and").select("g", F.col("a").alias("node"), F.col("b").alias("c")), ["g", "node"])
        touched = below(new).join(members, ["g", "c"]).select("g", "x", "node").distinct()
        lacking = touched.join(members, ["g", "node"]).join(below(known), ["g", "x", "c"], "left_anti").select("g", "x", "node").distinct()
        whole = members.groupBy("g", "node").agg(F.array_sort(F.collect_set("c")).alias("items"))  # as many as one expression has
        met = touched.join(lacking, ["g", "x", "node"], "left_anti").join(whole, ["g", "node"])
        out.append(_row(met, "and", "x", None, "node", F.transform("items", lambda i: _premise("x", None, i)), None))
    if "to" in kinds and "below" in new_has:
        led = of("to").select("g", F.col("a").alias("c"), "b", "d", "ax")
        out.append(_row(below(new).join(led, ["g", "c"]), "to", "x", "b", "d", [_premise("x", None, "c")]))
    if "from" in kinds:
        into = of("from").select("g", F.col("a").alias("node"), F.col("b").alias("p"), F.col("d").alias("c"), "ax")
        for r, s in pairs("below"):
            held = below(s, "y").join(into, ["g", "c"])
            out.append(_row(leads(r).join(held, ["g", "p", "y"]), "from", "x", None, "node", [_premise("x", "p", "y"), _premise("y", None, "c")]))
    if "subprop" in kinds and new_has & {"leads", "tag"}:
        wider = of("subprop").select("g", F.col("a").alias("p"), "b", "ax")
        out.append(_row(new.where("p <> ''").select(*FACT).join(wider, ["g", "p"]), "subprop", "x", "b", "c", [_premise("x", "p", "c")]))
    if "chain" in kinds:
        chains = of("chain").select("g", F.col("a").alias("of"), F.col("b").alias("p"), F.col("d").alias("q"), "ax")
        for r, s in pairs("leads"):
            half = leads(r).join(chains, ["g", "p"])
            out.append(_row(half.join(leads(s, "y", "q", "z"), ["g", "y", "q"]), "chain", "x", "of", "z", [_premise("x", "p", "y"), _premise("y", "q", "z")]))
    if "domain" in kinds and "leads" in new_has:
        out.append(_row(leads(new).join(of("domain").select("g", F.col("a").alias("p"), "b", "ax"), ["g", "p"]), "domain", "x", None, "b", [_premise("x", "p", "y")]))
    if "range" in kinds and "tag" in new_has:
        tags = new.where("p <> '' and c = ''").select("g", "x", "p")
        out.append(_row(tags.join(of("range").select("g", F.col("a").alias("p"), "b", "ax"), ["g", "p"]), "range", "x", None, "b", [_premise("x", "p", F.lit(""))]))
    if "set" in kinds and "below" in new_has:
        sets = lambda frame: frame.select("g", F.col("a").alias("set"), F.col("b").alias("c"), "ax")
        touched = below(new).join(sets(of("set")), ["g", "c"])
        other = below(known, "x", "k").join(sets(of_every("set")).select("g", "set", F.col("c").alias("k")), ["g", "k"])
        met = touched.join(other, ["g", "x", "set"]).where("c <> k").withColumns({"one": F.least("c", "k"), "two": F.greatest("c", "k")})
        out.append(_row(met, "disjoint", "x", None, F.lit(NOTHING), [_premise("x", None, "one"), _premise("x", None, "two")]))
    if "bottom" in kinds:
        for r, s in pairs("empty"):
            empty = below(s, "y").where(F.col("c") == NOTHING).select("g", "y")
            out.append(_row(leads(r).join(empty, ["g", "y"]), "bottom", "x", None, F.lit(NOTHING), [_premise("x", "p", "y"), _premise("y", None, F.lit(NOTHING))], None))
    return _union(out)


def forms_of(facts: DataFrame) -> frozenset[str]:
    """Forms of facts that there are; none if there are no facts."""
    form = F.when((F.col("p") == "") & (F.col("c") == NOTHING), "empty").when(F.col("p") == "", "below").when(F.col("c") == "", "tag").otherwise("leads")
    found = frozenset(r.form for r in facts.select(form.alias("form")).distinct().collect())
    return found | {"below"} if "empty" in found else found


def kinds_of(axioms: DataFrame) -> dict[str, int]:
    """Kinds of axioms there are (twelve at most) with their numbers, and 'bottom' if anything can be unsatisfiable."""
    found = {r.kind: r["count"] for r in axioms.groupBy("kind").count().collect()}
    fails = "set" in found or not axioms.where(f"b = '{NOTHING}' or d = '{NOTHING}'").isEmpty()
    return found | ({"bottom": 0} if fails else {})


def _leaves(axioms: DataFrame) -> DataFrame:
    """(g, kind, a, b, ax, part): what says that a is below b. part: 'core', or if nothing but this says anything of a, 'one' where it has one b and 'many' where it has several.

    What follows for such an a is what follows for its b, and what intersections and disjoint sets find in several of them; nothing else rests on it.
    """
    at = lambda kinds, c: axioms.where(F.col("kind").isin(*kinds)).select("g", F.col(c).alias("a"))
    bound = _union([at(("sub", "isa", "and", "set", "domain", "range"), "b"), at(("to", "from", "rel"), "d"), at(("and", "to", "from", "tag", "rel"), "a")]).distinct().withColumn("bound", F.lit(True))
    up = axioms.where("kind in ('sub', 'isa')").select("g", "kind", "a", "b", "ax").join(bound, ["g", "a"], "left").withColumn("bound", F.coalesce("bound", F.col("a").isin(THING, NOTHING)))
    own = W.partitionBy("g", "a").orderBy("b")
    whole = own.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    part = F.when(F.col("bound"), "core").when(F.first("b").over(whole) == F.last("b").over(whole), "one").otherwise("many")
    again = F.lag("b").over(own) == F.col("b")
    return up.withColumns({"part": part, "again": again}).where("part = 'core' or again is null or not again").select("g", "kind", "a", "b", "ax", "part")


@dataclass
class Closure:
    """Axioms, all facts that follow, and, if kept, all uses of rules (g, x, p, c, rule, premises, ax). kinds: numbers of axioms by kind, if known."""

    axioms: DataFrame
    facts: DataFrame
    derivations: DataFrame | None
    kinds: dict[str, int] | None = None

    @staticmethod
    def of(quads: DataFrame, keep: bool = False, max_rounds: int = 1000) -> Closure:
        stored = axioms(quads)
        stored = stage(stored if keep else stored.withColumn("ax", F.lit(None).cast("string")), by="kind")  # only derivations name what is stated
        kinds = kinds_of(stored)
        if "rel" in kinds:  # what is stated of an individual doesn't follow for what is below it
            start = stage(starting(stored)) if keep else starting(stored)
            new = stage(start.select(*FACT).distinct())
            return Closure(stored, new, start if keep else None, kinds)._saturated(new, max_rounds)
        up = stage(_leaves(stored), by="part")
        parts = {r.part: r["count"] for r in up.groupBy("part").count().collect()}
        edges = {part: up.where(F.col("part") == part) for part in ("core", "one", "many")}
        rest = stored.where("kind not in ('sub', 'isa')").unionByName(edges["core"].withColumn("d", F.lit(None).cast("string")).select(*stored.columns))
        leaves = [edges[part] for part in ("one", "many") if part in parts]
        start = starting(rest, _union(leaves).select("g", F.col("b").alias("x"))) if leaves else starting(rest)
        start = stage(start) if keep else start
        new = stage(start.select(*FACT).distinct())
        core_kinds = {k: n for k, n in kinds.items() if k not in ("sub", "isa")} | {"sub": parts.get("core", 0)}
        core = Closure(rest, new, start if keep else None, core_kinds)._saturated(new, max_rounds)
        if not leaves:
            return replace(core, axioms=stored, kinds=kinds)
        return core._with_leaves(stored, kinds, edges, parts, max_rounds)

    def _with_leaves(self, stored: DataFrame, kinds: dict[str, int], edges: dict[str, DataFrame], parts: dict[str, int], max_rounds: int) -> Closure:
        """The closure of all axioms, this one being that of those which don't speak of leaves (see _leaves)."""
        keep = self.derivations is not None

        def inherited(part: str) -> DataFrame:
            """Facts of leaves: each is below itself, and has what its b has, which closes them under all rules but those that several b meet in."""
            of = edges[part].select("g", F.col("a").alias("leaf"), F.col("b").alias("x"))
            taken = of.join(self.facts.where("p = '' or c <> ''"), ["g", "x"]).select("g", F.col("leaf").alias("x"), "p", "c")
            return (edges[part].select("g", F.col("a").alias("x")).distinct() if part == "many" else edges[part].select("g", F.col("a").alias("x"))).select("g", "x", F.lit("").alias("p"), F.col("x").alias("c")).unionByName(taken.distinct() if part == "many" else taken)

        found = []
        if "many" in parts:
            meeting = {k: n for k, n in self.kinds.items() if k in ("and", "set")}
            first = inherited("many")
            if meeting:
                first = stage(first)
                known = self.facts.unionByName(first)
                new = stage(fire(first, known, self.axioms.where("kind in ('and', 'set')"), meeting, led=False).select(*FACT).distinct().join(first, FACT, "left_anti"))
                first = replace(self, facts=known.unionByName(new), derivations=None)._saturated(new, max_rounds, [self.facts], [first, new])
            found.append(first)
        if "one" in parts:
            found.append(inherited("one"))
        leaves, uses = _union(found), None
        if keep:
            leaves = stage(leaves)
            start = leaves.where("p = '' and x = c")
            self_uses = _row(start, "self", "x", None, "x", [], F.lit(None).cast("string"))
            every = self.axioms.unionByName(_union([edges[p] for p in ("one", "many") if p in parts]).withColumn("d", F.lit(None).cast("string")).select(*stored.columns))
            uses = stage(_union([self.derivations, self_uses, fire(leaves, self.facts.unionByName(leaves), every, kinds, led=False).distinct()]))
        return Closure(stored, self.facts.unionByName(leaves), uses, kinds)

    def _saturated(self, new: DataFrame, max_rounds: int = 1000, fixed: list[DataFrame] | None = None, own: list[DataFrame] | None = None):
        """The closure, facts `new` of it not having been joined yet.

        fixed, own: given for leaves, that nothing leads to: facts that they rest on, and their own with `new` among them; their facts are returned.
        """
        kinds, keep = self.kinds or kinds_of(self.axioms), self.derivations is not None
        parts, uses, fixed = own or [self.facts], [self.derivations] if keep else [], fixed or []
        known_has, new_has = forms_of(self.facts) if own is None else FORMS, forms_of(new)
        for _ in range(max_rounds):
            if not new_has:
                if own is not None:
                    return _union(parts)
                return replace(self, facts=_union(parts), derivations=stage(_union(uses).distinct()) if keep else None, kinds=kinds)
            known = _union([*fixed, *parts])
            found = fire(new, known, self.axioms, kinds, None, new_has, known_has, own is None)
            if keep:
                found = stage(found.distinct())
                uses.append(found)
            new = stage(found.select(*FACT).distinct().join(_union(parts), FACT, "left_anti"))
            new_has = forms_of(new)
            known_has |= new_has
            parts.append(new)
            if len(parts) > 4:  # every rule reads all that is known
                parts = [stage(_union(parts))]
        raise RuntimeError(f"the classification did not end in {max_rounds} rounds")

    def pairs(self) -> DataFrame:
        """(g, child, parent): named classes and what subsumes them, owl:Nothing among it, owl:Thing and the class itself not."""
        inside = lambda c: F.col(c).substr(F.lit(2), F.length(c) - 2)
        named = self.facts.where("p = '' and startswith(x, '<') and startswith(c, '<') and x <> c").where((F.col("c") != THING) & (F.col("x") != NOTHING))
        if self.kinds is not None and not {"isa", "rel"} & self.kinds.keys():
            return named.select("g", inside("x").alias("child"), inside("c").alias("parent"))
        single = self.axioms.where("kind in ('isa', 'rel')").select("g", F.col("a").alias("x")).unionByName(self.axioms.where("kind = 'rel'").select("g", F.col("d").alias("x")))
        return named.join(single.distinct(), ["g", "x"], "left_anti").select("g", inside("x").alias("child"), inside("c").alias("parent"))

    def unsatisfiable(self) -> DataFrame:
        """(g, cls): named classes below owl:Nothing."""
        return self.pairs().where(F.col("parent") == NOTHING[1:-1]).select("g", F.col("child").alias("cls"))

    def consistency(self) -> DataFrame:
        """(g, consistent, unsatisfiable): whether a graph has a model (no individual, and not owl:Thing, is in owl:Nothing), and how many classes are unsatisfiable."""
        graphs = self.axioms.select("g").distinct()
        single = self.axioms.where("kind in ('isa', 'rel')").select("g", F.col("a").alias("x")).unionByName(self.axioms.where("kind = 'rel'").select("g", F.col("d").alias("x"))).distinct()
        bottom = self.facts.where(f"p = '' and c = '{NOTHING}'").select("g", "x")
        broken = bottom.join(single, ["g", "x"], "left_semi").unionByName(bottom.where(f"x = '{THING}'")).select("g").distinct().withColumn("broken", F.lit(True))
        counts = self.unsatisfiable().groupBy("g").agg(F.count("*").alias("unsatisfiable"))
        return graphs.join(broken, "g", "left").join(counts, "g", "left").select("g", F.col("broken").isNull().alias("consistent"), F.coalesce("unsatisfiable", F.lit(0)).alias("unsatisfiable"))

    def retract(self, gone: DataFrame) -> Closure:
        """Without the stated triples `gone` (g, ax): what loses a derivation is taken out with all that was derived from it, then what still has a derivation from the rest is put back."""
        gone = stage(gone.select("g", "ax").distinct())
        left = self._kept().join(gone, ["g", "ax"], "left_anti")
        premises = stage(left.select(*FACT, F.explode("premises").alias("e")).select(*FACT, F.col("e.x").alias("px"), F.col("e.p").alias("pp"), F.col("e.c").alias("pc")).distinct())
        over = front = stage(self._kept().join(gone, ["g", "ax"], "left_semi").select(*FACT).distinct())
        while not front.isEmpty():
            of = front.select("g", F.col("x").alias("px"), F.col("p").alias("pp"), F.col("c").alias("pc"))
            front = stage(premises.join(of, ["g", "px", "pp", "pc"], "left_semi").select(*FACT).distinct().join(over, FACT, "left_anti"))
            over = stage(over.unionByName(front))
        uses = stage(left.join(over, FACT, "left_semi").withColumn("use", F.monotonically_increasing_id()))
        while True:
            back = stage(_unhurt(uses, over).select(*FACT).distinct())
            if back.isEmpty():
                break
            over = stage(over.join(back, FACT, "left_anti"))
            uses = stage(uses.join(back, FACT, "left_anti"))
        rest = left.join(over, FACT, "left_anti").withColumn("use", F.monotonically_increasing_id())
        return Closure(stage(self.axioms.join(gone, ["g", "ax"], "left_anti").select(*self.axioms.columns)), stage(self.facts.join(over, FACT, "left_anti")), stage(_unhurt(stage(rest), over).drop("use")))

    def extend(self, quads: DataFrame) -> Closure:
        """With all of quads (those before among them): only axioms that are new are joined with what is known."""
        every = axioms(quads)
        every = stage(every if self.derivations is not None else every.withColumn("ax", F.lit(None).cast("string")), by="kind")
        same = [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in every.columns]
        fresh = stage(every.alias("n").join(self.axioms.alias("o"), functools.reduce(Column.__and__, same), "left_anti"))
        facts = stage(self.facts)
        found = fire(facts, facts, fresh, kinds_of(fresh), every).unionByName(starting(fresh))
        whole = stage(self.axioms.unionByName(fresh))
        if "bottom" in kinds_of(whole) and "bottom" not in kinds_of(self.axioms):
            found = found.unionByName(fire(facts, facts, fresh.limit(0), {"bottom": 0}))
        # owl:Thing may have become a condition for nodes that were there
        found = stage(found.unionByName(starting(whole)).distinct())
        new = stage(found.select(*FACT).distinct().join(facts, FACT, "left_anti"))
        kept = stage(self.derivations.unionByName(found).distinct()) if self.derivations is not None else None
        return Closure(whole, stage(facts.unionByName(new)), kept)._saturated(new)

    def _kept(self) -> DataFrame:
        if self.derivations is None:
            raise ValueError("the closure was made without keeping its derivations")
        return self.derivations


def _unhurt(uses: DataFrame, over: DataFrame) -> DataFrame:
    """Those of uses (with a number `use`) no premise of which is in `over`."""
    of = over.select("g", F.struct("x", "p", "c").alias("e"))
    hurt = uses.select("g", "use", F.explode("premises").alias("e")).join(of, ["g", "e"], "left_semi").select("use").distinct()
    return uses.join(hurt, "use", "left_anti")


def classify(quads: DataFrame) -> DataFrame:
    """(g, child, parent): subsumptions between named classes that follow, in each graph by itself."""
    return Closure.of(quads).pairs()


def _numbered(closure: Closure) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Facts (g, x, p, c, fact), stated triples (g, ax, said), and uses of rules by these numbers: (use, fact, premises, said)."""
    number = lambda df, name: stage(df.withColumn(name, F.monotonically_increasing_id()))
    facts = number(closure.facts.select(*FACT), "fact")
    said = number(closure.axioms.where("ax is not null").select("g", "ax").distinct(), "said")
    uses = number(closure._kept().join(facts, FACT).join(said, ["g", "ax"], "left").select("g", "fact", "premises", "said"), "use")
    of = facts.select("g", F.col("x").alias("px"), F.col("p").alias("pp"), F.col("c").alias("pc"), F.col("fact").alias("premise"))
    each = uses.where("size(premises) > 0").select("g", "use", "fact", "said", F.size("premises").alias("n"), F.explode("premises").alias("e")).select("g", "use", "fact", "said", "n", F.col("e.x").alias("px"), F.col("e.p").alias("pp"), F.col("e.c").alias("pc"))
    met = each.join(of, ["g", "px", "pp", "pc"]).groupBy("use").agg(F.max("fact").alias("fact"), F.max("said").alias("said"), F.max("n").alias("n"), F.collect_list("premise").alias("premises")).where("size(premises) = n")
    free = uses.where("size(premises) = 0").select("use", "fact", F.array().cast("array<long>").alias("premises"), "said")
    return facts, said, stage(free.unionByName(met.drop("n")))


def _relevant(uses: DataFrame, goals: DataFrame) -> DataFrame:
    """Numbered uses of rules that the goals (a column fact) rest on."""
    seen = front = goals
    parts = []
    while True:
        rows = stage(uses.join(front, "fact", "left_semi"))
        parts.append(rows)
        front = stage(rows.select(F.explode("premises").alias("fact")).distinct().join(seen, "fact", "left_anti"))
        if front.isEmpty():
            return _union(parts)
        seen = stage(seen.unionByName(front))


def _least(sets: DataFrame) -> DataFrame:
    """Per fact the distinct sets (axs) that hold no other set of the fact."""
    distinct = sets.select("fact", "axs").distinct()
    small = distinct.select("fact", F.col("axs").alias("within"))
    held = distinct.join(small, "fact").where("size(within) < size(axs) and size(array_except(within, axs)) = 0").select("fact", "axs").distinct()
    return distinct.join(held, ["fact", "axs"], "left_anti")


def justifications(closure: Closure, goals: DataFrame, most: int = 100) -> DataFrame:
    """(g, child, parent, axioms) for each goal (g, child, parent): its minimal sets of stated triples, all of them, a row each.

    Each fact carries the minimal sets that derive it; facts and triples go by numbers until the end. A round joins, for every use of a rule, the sets of its premises and adds its axiom
    (growing), and drops sets that hold another of the same fact (shrinking), until no fact gets a new set; only facts that a round derives anew are looked at.
    A fact with more than `most` sets is an error: the result would not be whole. A goal that doesn't follow has no row.
    """
    name = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    facts, said, numbered = _numbered(closure)
    asked = stage(goals.select("g", name("child").alias("x"), F.lit("").alias("p"), name("parent").alias("c")).distinct().join(facts, FACT).select("fact"))
    uses = stage(_relevant(numbered, asked))
    longest = uses.agg(F.max(F.size("premises"))).first()[0]
    if longest is None:
        return goals.select("g", "child", "parent").withColumn("axioms", F.lit(None).cast("array<string>")).limit(0)
    own = F.when(F.col("said").isNull(), F.array().cast("array<long>")).otherwise(F.array("said"))
    known = fresh = stage(_least(uses.where("size(premises) = 0").select("fact", own.alias("axs"))))
    rests = uses.where("size(premises) > 0")
    while True:
        changed = fresh.select(F.col("fact").alias("e")).distinct()
        hit = rests.select("use", F.explode("premises").alias("e")).join(changed, "e", "left_semi").select("use").distinct()
        part = stage(rests.join(hit, "use", "left_semi").select("fact", "premises", own.alias("axs")))  # read once for each number of premises
        sets = known.select(F.col("fact").alias("e"), F.col("axs").alias("more"))
        done = []
        for i in range(longest):
            if i:
                done.append(part.where(F.size("premises") == i).select("fact", "axs"))
            part = part.where(F.size("premises") > i).withColumn("e", F.element_at("premises", i + 1)).join(sets, "e").withColumn("axs", F.array_sort(F.array_union("axs", "more"))).drop("e", "more")
        derived = stage(_union([*done, part.select("fact", "axs")]).distinct().join(known, ["fact", "axs"], "left_anti"))
        if derived.isEmpty():
            break
        touched = derived.select("fact").distinct()
        better = stage(_least(derived.unionByName(known.join(touched, "fact", "left_semi"))))
        fresh = stage(better.join(known, ["fact", "axs"], "left_anti"))
        if fresh.isEmpty():
            break
        if not better.groupBy("fact").count().where(F.col("count") > most).isEmpty():
            raise RuntimeError(f"a fact has more than {most} justifications: raise the bound")
        known = stage(known.join(touched, "fact", "left_anti").unionByName(better))
    inside = lambda c: F.col(c).substr(F.lit(2), F.length(c) - 2)
    found = stage(known.join(asked, "fact", "left_semi").withColumn("set", F.monotonically_increasing_id()))
    texts = found.select("set", "fact", F.explode_outer("axs").alias("said")).join(said.select("said", "ax"), "said", "left").groupBy("set").agg(F.max("fact").alias("fact"), F.array_sort(F.collect_list("ax")).alias("axioms"))
    return texts.join(facts, "fact").select("g", inside("x").alias("child"), inside("c").alias("parent"), "axioms")
