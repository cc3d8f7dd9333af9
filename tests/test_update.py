"""Updates against a plain-Python store, and the store's versions."""

import random

import pytest

from triplewright.plans.sparql import DEFAULT_GRAPH
from triplewright.plans.sparql_parser import SparqlError, Unsupported
from triplewright.plans.sparql_update import Parser, QuadStore

EX = "http://e/"
G1, G2 = f"<{EX}g1>", f"<{EX}g2>"
PRE = f"PREFIX : <{EX}> "


def iri(x):
    return f"<{EX}{x}>"


def start():
    rng = random.Random(4)
    return {(g, iri(f"s{rng.randrange(4)}"), iri(f"p{rng.randrange(3)}"), rng.choice([iri(f"s{rng.randrange(4)}"), f'"{rng.randrange(5)}"'])) for g in (G1, G2, DEFAULT_GRAPH) for _ in range(14)}


def store(spark, tmp_path, quads):
    return QuadStore.create(spark.createDataFrame(sorted(quads), "g string, s string, p string, o string").repartition(2), f"{tmp_path}/store")


def held(s, version=None):
    return {tuple(r) for r in s.quads(version).collect()}


# (update, the same on a set of quads)
CASES = [
    ("INSERT DATA { :a :p0 :b . GRAPH :g1 { :a :p0 'x'@en , 5 } }", lambda q: q | {(DEFAULT_GRAPH, iri("a"), iri("p0"), iri("b")), (G1, iri("a"), iri("p0"), '"x"@en'), (G1, iri("a"), iri("p0"), '"5"^^<http://www.w3.org/2001/XMLSchema#integer>')}),
    ("DELETE DATA { GRAPH :g1 { :s0 :p0 :s1 . :none :p0 :s1 } }", lambda q: q - {(G1, iri("s0"), iri("p0"), iri("s1"))}),
    ("DELETE WHERE { GRAPH :g1 { ?s :p0 ?o } }", lambda q: {x for x in q if not (x[0] == G1 and x[2] == iri("p0"))}),
    ("DELETE WHERE { ?s :p1 ?o }", lambda q: {x for x in q if not (x[0] == DEFAULT_GRAPH and x[2] == iri("p1"))}),
    ("WITH :g2 DELETE { ?s :p0 ?o } INSERT { ?s :q ?o . GRAPH :new { ?o :of ?s } } WHERE { ?s :p0 ?o }",
     lambda q: {x for x in q if not (x[0] == G2 and x[2] == iri("p0"))} | {(G2, s, iri("q"), o) for g, s, p, o in q if g == G2 and p == iri("p0")} | {(iri("new"), o, iri("of"), s) for g, s, p, o in q if g == G2 and p == iri("p0") and o.startswith("<")}),
    ("INSERT { GRAPH ?g { ?s :seen ?g } } WHERE { GRAPH ?g { ?s :p2 ?o } }", lambda q: q | {(g, s, iri("seen"), g) for g, s, p, o in q if g != DEFAULT_GRAPH and p == iri("p2")}),
    ("DELETE { GRAPH :g1 { ?s ?p ?o } } USING :g2 WHERE { ?s ?p ?o }", lambda q: q - {(G1, s, p, o) for g, s, p, o in q if g == G2}),
    ("DELETE { GRAPH :g1 { ?s ?p ?o } } INSERT { GRAPH :g1 { ?s ?p ?o } } WHERE { GRAPH :g1 { ?s ?p ?o } }", lambda q: q),
    ("CLEAR GRAPH :g1", lambda q: {x for x in q if x[0] != G1}), ("DROP NAMED", lambda q: {x for x in q if x[0] == DEFAULT_GRAPH}), ("CLEAR DEFAULT", lambda q: {x for x in q if x[0] != DEFAULT_GRAPH}), ("DROP SILENT GRAPH :none", lambda q: q),
    ("COPY :g1 TO :g2", lambda q: {x for x in q if x[0] != G2} | {(G2, *x[1:]) for x in q if x[0] == G1}), ("ADD :g1 TO DEFAULT", lambda q: q | {(DEFAULT_GRAPH, *x[1:]) for x in q if x[0] == G1}),
    ("MOVE :g1 TO :g3", lambda q: {x for x in q if x[0] != G1} | {(iri("g3"), *x[1:]) for x in q if x[0] == G1}),
    ("CLEAR GRAPH :g1 ; INSERT DATA { GRAPH :g1 { :a :b :c } } ; INSERT { GRAPH :g4 { ?s :b ?o } } WHERE { GRAPH :g1 { ?s :b ?o } }", lambda q: {x for x in q if x[0] != G1} | {(g, iri("a"), iri("b"), iri("c")) for g in (G1, iri("g4"))}),
]


def test_equals_a_plain_store(spark, tmp_path):
    """All cases one after the other, the first quads being put back in before each."""
    quads = start()
    s, expected = store(spark, tmp_path, quads), quads
    for n, (text, plain) in enumerate(CASES, 1):
        s.update(PRE + text)
        expected = plain(expected)
        assert held(s) == expected, text
        if len(expected) < 25:
            back = " ".join(f"GRAPH {g} {{ {x} {p} {o} }}" for g, x, p, o in quads if g != DEFAULT_GRAPH) + " ".join(f" {x} {p} {o} ." for g, x, p, o in quads if g == DEFAULT_GRAPH)
            s.update(PRE + f"INSERT DATA {{ {back} }}")
            expected = expected | quads
    assert held(s) == expected and held(s, 0) == quads


def test_versions_conflicts_and_housekeeping(spark, tmp_path):
    quads = start()
    s = store(spark, tmp_path, quads)
    s.update(PRE + "INSERT DATA { GRAPH :g1 { :x :y :z } }")
    s.update(PRE + "CLEAR GRAPH :g2")
    now = held(s)
    with pytest.raises(RuntimeError, match="another writer"):
        s._commit(s.quads(), None, 1)
    with pytest.raises(SparqlError):
        s.update(PRE + "CLEAR DEFAULT ; DROP GRAPH :none")
    assert held(s) == now and s.versions() == [0, 1, 2]
    s.compact()
    s.forget(3)
    assert s.versions() == [3] and held(QuadStore(spark, s.path)) == now
    s.update("")
    assert s.versions() == [3]


def test_blank_nodes_are_new_for_each_solution(spark, tmp_path):
    s = store(spark, tmp_path, {(G1, iri(f"s{i}"), iri("p"), iri("o")) for i in range(5)})
    s.update(PRE + "INSERT { GRAPH :n { ?s :has [ :kind :k ] } } WHERE { GRAPH :g1 { ?s :p ?o } } ; INSERT DATA { GRAPH :m { _:a :q _:b . _:a :q _:c } }")
    new = held(s)
    nodes = [o for g, _, p, o in new if g == iri("n") and p == iri("has")]
    assert len(set(nodes)) == 5 and {x for g, x, p, _ in new if g == iri("n") and p == iri("kind")} == set(nodes)
    assert len({x for g, x, _, _ in new if g == iri("m")}) == 1 and len({o for g, _, _, o in new if g == iri("m")}) == 2


@pytest.mark.parametrize("text, error", [("LOAD <http://e/x>", Unsupported), ("DELETE DATA { ?s :p :o }", SparqlError), ("INSERT DATA { ?s :p :o }", SparqlError), ("DELETE { _:a :p ?o } WHERE { ?s :p ?o }", SparqlError), ("SELECT * WHERE { ?s ?p ?o }", SparqlError),
                                         ("INSERT { ?s :p ?o } WHERE { SERVICE <http://e/> { ?s :p ?o } }", Unsupported), ("INSERT DATA { :a :p :b } INSERT DATA { :a :p :c }", SparqlError)])
def test_what_is_refused(text, error):
    with pytest.raises(error):
        Parser(PRE + text).parse()
