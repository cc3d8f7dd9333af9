"""Reasoning against a plain fixpoint over sets of axioms, and justifications against all subsets."""

import itertools
import random

import pytest

from triplewright.operators import axioms, reasoning
from triplewright.operators.axioms import OWL, RDF, RDFS

EX = "http://e/"
NOTHING, THING = f"<{OWL}Nothing>", f"<{OWL}Thing>"
G = "<urn:g>"


def iri(name):
    return name if name.startswith(("<", "_:")) else f"<{EX}{name}>"


def plain(stated):
    """Subsumptions (x, c) between all nodes by naive rules; stated: axioms as tuples."""
    some = {n: (p, f) for k, n, p, f in (x for x in stated if x[0] == "some")}
    parts = {n: (a, b) for k, n, a, b in (x for x in stated if x[0] == "and")}
    nodes = {y for x in stated for y in x[1:] if x[0] in ("sub", "and", "disjoint")} | {f for _, f in some.values()} | {x[2] for x in stated if x[0] in ("domain", "range")} | set(some)
    wider = {x[1:] for x in stated if x[0] == "subprop"} | {(x[1], x[1]) for x in stated if x[0] == "range"}
    while more := {(a, d) for a, b in wider for c, d in wider if b == c} - wider:
        wider |= more
    below, led = {(n, n) for n in nodes}, set()
    ranged = lambda p: {c for q, w in wider if q == p for k, r, c in (x for x in stated if x[0] == "range") if r == w}
    own = {(p, f): f"_:own {p} {f}" for p, f in some.values() if ranged(p)}
    below |= {(n, n) for n in own.values()}
    while True:
        new, roles = set(), set()
        for x, c in below:
            new |= {(x, a[2]) for a in stated if a[0] == "sub" and a[1] == c}
            new |= {(x, i) for n, (a, b) in parts.items() if n == c for i in (a, b)}
            new |= {(x, n) for n, (a, b) in parts.items() if c in (a, b) and (x, a) in below and (x, b) in below}
            if c in some:
                p, f = some[c]
                roles.add((x, p, own.get((p, f), f)))
            new |= {(x, NOTHING) for a in stated if a[0] == "disjoint" and a[1] == c and (x, a[2]) in below and a[1] != a[2]}
        for (p, f), n in own.items():
            new |= {(n, f)} | {(n, c) for c in ranged(p)}
        for x, p, y in led:
            roles |= {(x, a[2], y) for a in stated if a[0] == "subprop" and a[1] == p}
            roles |= {(x, a[1], z) for a in stated if a[0] == "chain" and a[2] == p for w, q, z in led if w == y and q == a[3]}
            new |= {(x, a[2]) for a in stated if a[0] == "domain" and a[1] == p}
            new |= {(x, n) for n, (q, f) in some.items() if q == p and (y, f) in below}
            if (y, NOTHING) in below:
                new.add((x, NOTHING))
        if new <= below and roles <= led:
            return below
        below |= new
        led |= roles


def quads(stated):
    """Triples of the axioms; (axiom, its stated triple) too."""
    out, text = [], {}
    for i, x in enumerate(stated):
        kind, a, rest = x[0], iri(x[1]), [iri(y) for y in x[2:]]
        if kind in ("sub", "disjoint", "subprop", "domain", "range"):
            p = {"sub": f"<{RDFS}subClassOf>", "disjoint": f"<{OWL}disjointWith>", "subprop": f"<{RDFS}subPropertyOf>", "domain": f"<{RDFS}domain>", "range": f"<{RDFS}range>"}[kind]
            out.append((a, p, rest[0]))
        elif kind == "some":
            out += [(a, f"<{OWL}onProperty>", rest[0]), (a, f"<{OWL}someValuesFrom>", rest[1])]
        elif kind in ("and", "chain"):
            out += [(a, f"<{OWL}{'intersectionOf' if kind == 'and' else 'propertyChainAxiom'}>", f"_:l{i}")]
            out += [(f"_:l{i}", f"<{RDF}first>", rest[0]), (f"_:l{i}", f"<{RDF}rest>", f"_:m{i}"), (f"_:m{i}", f"<{RDF}first>", rest[1]), (f"_:m{i}", f"<{RDF}rest>", f"<{RDF}nil>")]
            text[x] = " ".join(out[-5])
        text.setdefault(x, " ".join(out[-1]))
    return [(G, *t) for t in out], text


def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, s string, p string, o string")


def random_axioms(rng, n):
    classes, props, nodes = [f"C{i}" for i in range(6)], ["p", "q", "r"], [f"_:x{i}" for i in range(5)]
    stated = [("some", nodes[i], rng.choice(props), rng.choice([*classes, nodes[3]] if i < 3 else classes)) for i in range(4)] + [("and", nodes[4], *rng.sample([*classes, *nodes[:2]], 2))]
    term = lambda: rng.choice([*classes, *classes, *nodes])
    for _ in range(n):
        kind = rng.choice(["sub"] * 6 + ["disjoint", "subprop", "chain", "domain", "range"])
        stated.append({"sub": lambda: ("sub", term(), rng.choice([*classes, *nodes, NOTHING] if rng.random() < 0.2 else [*classes, *nodes])), "disjoint": lambda: ("disjoint", *rng.sample(classes, 2)), "subprop": lambda: ("subprop", *rng.sample(props, 2)),
                       "chain": lambda: ("chain", *(rng.choice(props) for _ in range(3))), "domain": lambda: ("domain", rng.choice(props), rng.choice(classes)), "range": lambda: ("range", rng.choice(props), rng.choice(classes))}[kind]())
    return list(dict.fromkeys(stated))


def mirrored(stated):
    """Disjointness holds both ways round."""
    return stated + [("disjoint", x[2], x[1]) for x in stated if x[0] == "disjoint"]


def named(pairs):
    return {(iri(a)[1:-1], iri(b)[1:-1]) for a, b in pairs if a != b and not a.startswith("_:") and not b.startswith("_:") and a != NOTHING}


def test_random_axioms_equal_the_plain_fixpoint(spark):
    """Many sets of axioms at once: each in a graph of its own."""
    rng = random.Random(11)
    sets = [random_axioms(rng, rng.randint(3, 14)) for _ in range(40)]
    rows = [(f"<urn:{i}>", s, p, o) for i, stated in enumerate(sets) for _, s, p, o in quads(stated)[0]]
    closure = reasoning.Closure.of(frame(spark, rows))
    found = {}
    for r in closure.pairs().collect():
        found.setdefault(r.g, set()).add((r.child, r.parent))
    expected = [named(plain(mirrored(stated))) for stated in sets]
    for i, pairs in enumerate(expected):
        assert found.get(f"<urn:{i}>", set()) == pairs, sets[i]
    assert any((a, NOTHING[1:-1]) in pairs for pairs in expected for a, _ in pairs)
    empty = {(r.g, r.cls) for r in closure.unsatisfiable().collect()}
    assert empty == {(f"<urn:{i}>", a) for i, pairs in enumerate(expected) for a, b in pairs if b == NOTHING[1:-1]}


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(5)
    sets = []
    while len(sets) < 12:
        stated = random_axioms(rng, 8)
        if len(named(plain(mirrored(stated)))) > 3:
            sets.append(stated)
    rows = [(f"<urn:{i}>", s, p, o) for i, stated in enumerate(sets) for _, s, p, o in quads(stated)[0]]
    return sets, rows, reasoning.Closure.of(frame(spark, rows), keep=True)


def test_justifications_equal_all_subsets(spark, small):
    sets, _, closure = small
    goals = closure.pairs()
    found = {}
    for r in reasoning.justifications(closure, goals).collect():
        found.setdefault((r.g, r.child, r.parent), set()).add(frozenset(r.axioms))
    assert found.keys() == {(r.g, r.child, r.parent) for r in goals.collect()}
    for i, stated in enumerate(sets):
        text = quads(stated)[1]
        fixed = [x for x in stated if x[0] in ("some", "and")]
        free = [x for x in stated if x not in fixed]
        minimal: dict = {}
        for n in range(len(free) + 1):
            for subset in itertools.combinations(free, n):
                for pair in named(plain(mirrored(fixed + list(subset)))):
                    held = minimal.setdefault(pair, [])
                    if not any(s <= set(subset) for s in held):
                        held.append(set(subset))
        for (a, b), least in minimal.items():
            assert found[f"<urn:{i}>", a, b] == {frozenset(text[x] for x in s) for s in least}, (a, b, stated)
    assert max(map(len, found.values())) > 1
    with pytest.raises(RuntimeError, match="more than 1 justifications"):
        reasoning.justifications(closure, goals, most=1)


def test_a_goal_that_does_not_follow_has_no_justification(spark, small):
    goals = spark.createDataFrame([("<urn:0>", EX + "none", EX + "such")], "g string, child string, parent string")
    assert reasoning.justifications(small[2], goals).count() == 0


def pairs_of(closure):
    return {tuple(r) for r in closure.pairs().collect()}


def test_changes_equal_starting_anew(spark, small):
    sets, rows, closure = small
    rng = random.Random(9)
    gone, left = [], []
    for i, stated in enumerate(sets):
        text = quads(stated)[1]
        out = set(rng.sample([x for x in stated if x[0] not in ("some", "and")], 3))
        gone += [(f"<urn:{i}>", text[x]) for x in out]
        left += [(f"<urn:{i}>", s, p, o) for _, s, p, o in quads([x if x not in out else ("sub", "kept", "kept") for x in stated])[0]]
    less = closure.retract(spark.createDataFrame(gone, "g string, ax string"))
    anew = reasoning.Closure.of(frame(spark, left))
    assert pairs_of(less) == pairs_of(anew) < pairs_of(closure)
    more = less.extend(frame(spark, rows))
    assert pairs_of(more) == pairs_of(closure)
    # what was put back has its derivations again
    uses = lambda c: {tuple(r) for r in c.derivations.where("ax is not null").select("g", "x", "p", "c", "rule", "ax").collect()}
    assert uses(more) == uses(closure)


def test_further_forms(spark):
    """Chains of three, transitivity, values, at least one, complements, all disjoint, disjoint unions, owl:Thing as a condition, individuals."""
    t, sub, eq = f"<{RDF}type>", f"<{RDFS}subClassOf>", f"<{OWL}equivalentClass>"

    def listed(name, items):
        cells = [f"_:{name}{i}" for i in range(len(items))] + [f"<{RDF}nil>"]
        return [x for i, item in enumerate(items) for x in ((cells[i], f"<{RDF}first>", iri(item)), (cells[i], f"<{RDF}rest>", cells[i + 1]))]

    def some(node, p, filler, kind="someValuesFrom"):
        return [(node, f"<{OWL}onProperty>", iri(p)), (node, f"<{OWL}{kind}>", iri(filler) if not filler.startswith('"') else filler)]

    triples = [(iri("r"), f"<{OWL}propertyChainAxiom>", "_:ch0"), *listed("ch", ["p", "q", "p"]), (iri("tr"), t, f"<{OWL}TransitiveProperty>")]
    triples += [(iri("A"), sub, "_:a"), *some("_:a", "p", "B"), (iri("B"), sub, "_:b"), *some("_:b", "q", "C"), (iri("C"), sub, "_:c"), *some("_:c", "p", "D"), (iri("Hit"), eq, "_:h"), *some("_:h", "r", "D")]
    triples += [(iri(f"T{i}"), sub, f"_:t{i}") for i in range(4)] + [x for i in range(4) for x in some(f"_:t{i}", "tr", f"T{i + 1}")] + [(iri("Far"), eq, "_:far"), *some("_:far", "tr", "T4")]
    triples += [(iri("V"), sub, "_:v"), *some("_:v", "p", "ind", "hasValue"), (iri("VV"), eq, "_:vv"), *some("_:vv", "p", "ind", "hasValue"), (iri("M"), sub, "_:m"), *some("_:m", "p", '"1"^^<http://www.w3.org/2001/XMLSchema#integer>', "minCardinality"), (iri("Any"), eq, "_:any"), *some("_:any", "p", THING)]
    triples += [(iri("N"), sub, "_:not"), ("_:not", f"<{OWL}complementOf>", iri("B")), (iri("NB"), sub, iri("N")), (iri("NB"), sub, iri("B"))]
    triples += [("_:all", t, f"<{OWL}AllDisjointClasses>"), ("_:all", f"<{OWL}members>", "_:d0"), *listed("d", ["X", "Y", "Z"]), (iri("XZ"), sub, iri("X")), (iri("XZ"), sub, iri("Z"))]
    triples += [(iri("U"), f"<{OWL}disjointUnionOf>", "_:u0"), *listed("u", ["U1", "U2"]), (iri("Both"), sub, iri("U1")), (iri("Both"), sub, iri("U2"))]
    triples += [(iri("i"), t, iri("A")), (iri("j"), t, iri("X")), (iri("p"), t, f"<{OWL}ObjectProperty>"), (iri("i"), iri("p"), iri("j"))]
    closure = reasoning.Closure.of(frame(spark, [(G, *x) for x in triples]))
    found = {(r.child.removeprefix(EX), r.parent.removeprefix(EX)) for r in closure.pairs().collect()}
    assert {("A", "Hit"), ("V", "VV"), ("U1", "U"), ("A", "Any"), ("M", "Any"), ("V", "Any"), *((f"T{i}", "Far") for i in range(4))} <= found
    assert ("B", "Hit") not in found and not any(a in ("i", "j") for a, _ in found)
    assert {r.cls.removeprefix(EX) for r in closure.unsatisfiable().collect()} == {"NB", "XZ", "Both"}
    assert [tuple(r) for r in closure.consistency().collect()] == [(G, True, 3)]
    worse = closure.extend(frame(spark, [(G, *x) for x in [*triples, (iri("j"), t, iri("Y"))]])) if closure.derivations is not None else reasoning.Closure.of(frame(spark, [(G, *x) for x in [*triples, (iri("j"), t, iri("Y"))]]))
    assert [tuple(r) for r in worse.consistency().collect()] == [(G, False, 3)]


def test_empty_and_shared_function(spark):
    none = frame(spark, [])
    assert reasoning.classify(none).count() == 0 and axioms.classify_el(none).count() == 0 and reasoning.Closure.of(none).consistency().count() == 0


def test_equal_restrictions_are_one_node(spark):
    """Each class with a blank restriction of its own: by itself every class would be below every such node, as many facts as the square of the classes."""
    sub, eq, n = f"<{RDFS}subClassOf>", f"<{OWL}equivalentClass>", 40
    some = lambda node, p, filler: [(node, f"<{OWL}onProperty>", iri(p)), (node, f"<{OWL}someValuesFrom>", iri(filler))]
    triples = [x for i in range(n) for x in [(iri(f"C{i}"), sub, f"_:c{i}"), *some(f"_:c{i}", "p", "D"), (iri(f"N{i}"), sub, f"_:o{i}"), *some(f"_:o{i}", "q", f"_:m{i}"), *some(f"_:m{i}", "p", "D")]]
    triples += [(iri("E"), eq, "_:e"), *some("_:e", "p", "D"), (iri("Hit"), eq, "_:h"), *some("_:h", "q", "_:k"), *some("_:k", "p", "D"), (iri("L"), sub, "_:l"), *some("_:l", "p", "_:l"), (iri("K"), eq, "_:kl"), *some("_:kl", "p", "_:l")]
    closure = reasoning.Closure.of(frame(spark, [(G, *x) for x in triples]), keep=True)
    expected = {(f"C{i}", "E") for i in range(n)} | {(f"N{i}", "Hit") for i in range(n)} | {("L", "K")}
    assert {(r.child.removeprefix(EX), r.parent.removeprefix(EX)) for r in closure.pairs().collect()} == expected
    assert closure.facts.count() < 12 * n and closure.derivations.count() < 24 * n
    found = reasoning.justifications(closure, closure.pairs().where("child in ('http://e/C3', 'http://e/N3')")).collect()
    assert {(r.child.removeprefix(EX), *r.axioms) for r in found} == {("C3", f"{iri('C3')} {sub} _:c3", f"{iri('E')} {eq} _:e"), ("N3", f"{iri('Hit')} {eq} _:h", f"{iri('N3')} {sub} _:o3")}


def test_rounds_leave_out_what_nothing_rests_on(spark, monkeypatch):
    """Classes that only have superclasses: what follows for them is read from these, and several of these meet once."""
    stated = [("sub", f"K{i}", f"K{i + 1}") for i in range(6)] + [("sub", f"X{i}", "K0") for i in range(30)] + [("disjoint", "K6", "B")] + [("sub", f"Y{i}", c) for i in range(30) for c in ("K2", "B")] + [("sub", "Y0", "B"), ("sub", "X0", "K0")]
    met, fire = [], reasoning.fire
    monkeypatch.setattr(reasoning, "fire", lambda new, *rest, **more: (met.append({r.x for r in new.select("x").distinct().collect()}), fire(new, *rest, **more))[1])
    closure = reasoning.Closure.of(frame(spark, quads(stated)[0]))
    pairs = [(r.child, r.parent) for r in closure.pairs().collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == named(plain(mirrored(stated)))
    assert not any(x.startswith(f"<{EX}X") for xs in met for x in xs)
    assert sum(any(x.startswith(f"<{EX}Y") for x in xs) for xs in met) <= 3 < len(met)


def test_a_round_looks_at_what_it_derives_anew(spark, monkeypatch):
    """A round of justifications is given facts that it found sets for, not all that were known before."""
    stated = [("sub", f"K{i}", f"K{i + 1}") for i in range(6)]
    given, least = [], reasoning._least
    monkeypatch.setattr(reasoning, "_least", lambda sets, *key: (given.append(sets.count()), least(sets, *key))[1])
    rows, text = quads(stated)
    closure = reasoning.Closure.of(frame(spark, rows), keep=True)
    found = reasoning.justifications(closure, spark.createDataFrame([(G, EX + "K0", EX + "K6")], "g string, child string, parent string")).collect()
    assert [r.axioms for r in found] == [sorted(text.values())]
    assert sum(given) <= 10
