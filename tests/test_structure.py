"""Nested class expressions, reduction with cycles, distances, and result documents, against plain Python."""

import csv
import io
import itertools
import json
import random
from pathlib import Path
from xml.etree import ElementTree

import pytest

from triplewright.functions import terms
from triplewright.operators import expressions, fleet, hierarchy
from triplewright.operators.axioms import OWL, RDF, RDFS
from triplewright.plans import mos
from triplewright.sources import results, syntaxes

G, EX = "<urn:g>", "http://e/"
SUB = f"<{RDFS}subClassOf>"


def iri(name):
    return name if name.startswith(("_:", "<")) else f"<{EX}{name}>"


def frame(spark, triples):
    return spark.createDataFrame([(G, *map(iri, t)) for t in triples], "g string, s string, p string, o string")


def some(node, prop, filler, kind="some"):
    return [(node, f"<{OWL}onProperty>", prop), (node, f"<{OWL}{kind}ValuesFrom>", filler)]


def listed(node, op, name, items):
    cells = [f"_:{name}{i}" for i in range(len(items))] + [f"<{RDF}nil>"]
    return [(node, f"<{OWL}{op}Of>", cells[0])] + [x for i, item in enumerate(items) for x in ((cells[i], f"<{RDF}first>", item), (cells[i], f"<{RDF}rest>", cells[i + 1]))]


@pytest.fixture(scope="module")
def nested(spark):
    """Classes K0.. below `p some X` for different X."""
    t = []
    t += some("_:i0", "q", "C") + some("_:i1", "q", "D") + some("_:i2", "q", "C", "all")
    t += listed("_:i3", "intersection", "l3", ["C", "_:i0", "D"]) + listed("_:i4", "union", "l4", ["C", "D"]) + [("_:i5", f"<{OWL}complementOf>", "_:i4")]
    t += listed("_:i6", "intersection", "l6", ["D", "_:i7"]) + listed("_:i7", "intersection", "l7", ["_:i8", "C"]) + some("_:i8", "q", "C") + some("_:i9", "q", "_:i10") + some("_:i10", "q", "C")
    for i in range(10):
        t += some(f"_:r{i}", "p", f"_:i{i}") + [(f"K{i}", SUB, f"_:r{i}")]
    classes = ["C", "D", *(f"K{i}" for i in range(10))]
    return frame(spark, t + [(c, f"<{RDF}type>", f"<{OWL}Class>") for c in classes])


@pytest.fixture(scope="module")
def evaluator(spark, nested):
    return mos.Evaluator(nested, spark.createDataFrame([("none", "none", "none", "none")], "version_id string, iri string, short string, norm string"))


C, D, P, Q = (f"<{EX}{x}>" for x in "CDpq")


@pytest.mark.parametrize("text, expected", [
    (f"{P} some ({Q} some {C})", "08"), (f"{P} some ({Q} some {D})", "1"), (f"{P} some ({Q} only {C})", "2"), (f"{P} some ({D} and {C} and ({Q} some {C}))", "36"),
    (f"{P} some ({D} or {C})", "4"), (f"{P} some (not ({C} or {D}))", "5"), (f"{P} some ({Q} some ({Q} some {C}))", "9"), (f"{P} some ({C} and {D})", ""), (f"{P} only ({Q} some {C})", ""),
])
def test_nested_fillers_match_only_themselves(evaluator, text, expected):
    found = {r.cls for r in evaluator.run(text).collect()}
    assert found == {f"<{EX}K{i}>" for i in expected}


def test_keys_ignore_names_order_and_brackets(nested):
    keys = {r.node: r.key for r in expressions.keys(nested).collect()}
    assert keys["_:i3"] == keys["_:i6"] and keys["_:i0"] == keys["_:i8"] == keys["_:i10"] and len({keys[f"_:i{i}"] for i in (0, 1, 2, 3, 4, 5, 9)}) == 7
    assert keys["_:r3"] == keys["_:r6"]


def test_reduction_equals_brute_force(spark):
    """Random graphs with cycles: an edge stays if no third class, equivalent to neither end, lies between; equivalent classes are each other's parents."""
    rng = random.Random(3)
    for _ in range(2):
        names = [f"n{i}" for i in range(12)]
        closure = {(rng.choice(names), rng.choice(names)) for _ in range(16)}
        while more := {(a, d) for a, b in closure for c, d in closure if b == c} - closure:
            closure |= more
        same = lambda a, b: (a, b) in closure and (b, a) in closure
        expected = {(a, b) for a, b in closure if a != b and (same(a, b) or not any((a, q) in closure and (q, b) in closure and not same(a, q) and not same(q, b) for q in names))}
        out = hierarchy.reduce_direct(spark.createDataFrame(sorted(closure), "child string, parent string"))
        assert {tuple(r) for r in out.select("child", "parent").collect()} == expected
        for a, b in closure:  # a parent outside a class's cycle is reached by the reduced edges
            assert same(a, b) or any((a, q) in expected and not same(a, q) or (a, q) in expected for q in names)


def test_distances_are_shortest(spark):
    rng = random.Random(8)
    edges = {(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(60)}
    expected, front, steps = {}, {"n1"}, 0
    while front:
        steps += 1
        front = {b for a, b in edges if a in front} - set(expected)
        expected |= {x: steps for x in front}
    found = hierarchy.distances(spark.createDataFrame(sorted(edges), "child string, parent string"), "child", "parent", spark.createDataFrame([("n1",)], "child string"))
    assert {r.parent: r.steps for r in found.collect()} == expected


def test_inherited_properties_come_from_the_nearest(spark):
    """Of 41 ancestors in a line, whose names run against their distance, the nearest thirty count."""
    chain = [f"<{EX}a{99 - i:02}>" for i in range(42)]
    edges = spark.createDataFrame([(G, a, b) for a, b in itertools.pairwise(chain)], "g string, child string, parent string")
    quads = frame(spark, [(f"p{i:02}", f"<{RDFS}domain>", c) for i, c in enumerate(chain)])
    found = {r.prop_iri for r in fleet.inherited_schema_properties(quads, edges, chain[0][1:-1]).collect()}
    assert found == {f"{EX}p{i:02}" for i in range(1, 31)}


def test_long_paths_are_found(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(30)], "child string, parent string")
    assert hierarchy.shortest_path(edges, "n0", "n30") == [f"n{i}" for i in range(31)] and hierarchy.shortest_path(edges, "n30", "n0") is None


ROWS = [("<http://e/a?x=1&y=2>", '"a"b\\c"'), (None, '"tab\there\nand, more"@en'), ("_:b1", '"7"^^<http://www.w3.org/2001/XMLSchema#integer>'), ("<http://e/z>", '""'), (None, None), ("<http://e/q>", '"<&>"')]


def written(spark, tmp_path, kind, rows):
    df = spark.createDataFrame(rows, "x string, y string").repartition(3)
    results.write(df, f"{tmp_path}/{kind}", kind)
    return "".join(p.read_text() for p in sorted(Path(f"{tmp_path}/{kind}").glob("part-*")))


@pytest.mark.parametrize("rows", [ROWS, ROWS[:1], []])
def test_files_are_whole_documents(spark, tmp_path, rows):
    bindings = json.loads(written(spark, tmp_path, "json", rows))["results"]["bindings"]
    assert len(bindings) == len(rows) and sorted(b["y"]["value"] for b in bindings if "y" in b) == sorted(terms.lexical_of(y) for _, y in rows if y)
    root = ElementTree.fromstring(written(spark, tmp_path, "xml", rows))
    space = "{http://www.w3.org/2005/sparql-results#}"
    assert [v.get("name") for v in root.iter(f"{space}variable")] == ["x", "y"] and len(list(root.iter(f"{space}result"))) == len(rows)
    assert sorted(e.text or "" for e in root.iter(f"{space}literal")) == sorted(terms.lexical_of(y) for _, y in rows if y)
    table = list(csv.reader(io.StringIO(written(spark, tmp_path, "csv", rows), newline="")))
    assert table[0] == ["x", "y"] and sorted(r[1] for r in table[1:]) == sorted(terms.lexical_of(y) if y else "" for _, y in rows)


def test_tsv_can_be_read_back(spark, tmp_path):
    lines = written(spark, tmp_path, "tsv", ROWS).rstrip("\n").split("\n")
    assert lines[0] == "?x\t?y" and len(lines) == len(ROWS) + 1
    signs = {"t": "\t", "n": "\n", "r": "\r", "\\": "\\", '"': '"'}

    def back(cell):
        if not cell.startswith('"'):
            return cell or None
        out, i = "", 1
        while cell[i] != '"':
            out, i = (out + signs[cell[i + 1]], i + 2) if cell[i] == "\\" else (out + cell[i], i + 1)
        return f'"{out}"{cell[i + 1:]}'

    assert sorted((tuple(map(back, line.split("\t"))) for line in lines[1:]), key=str) == sorted(ROWS, key=str)


def test_a_long_result_is_no_single_document(spark):
    df = spark.createDataFrame(ROWS, "x string, y string")
    assert json.loads(results.document(df, "json"))["head"]["vars"] == ["x", "y"]
    with pytest.raises(ValueError, match="more than 3 rows"):
        results.document(df, "json", most=3)


def test_jsonld_sets_and_large_numbers():
    text = '{"@context": {"@vocab": "http://e/"}, "@id": "http://e/s", "p": {"@set": [1, {"@set": ["x"]}, {"@list": [2]}]}, "q": [1e21, 100000000000000000000, 1000000000000000000000, 5.0]}'
    found = {(p, o) for _, s, p, o in syntaxes.jsonld(text) if s == "<http://e/s>" and not o.startswith("_:")}
    xsd = terms.XSD
    assert found == {("<http://e/p>", f'"1"^^<{xsd}integer>'), ("<http://e/p>", '"x"'), *(("<http://e/q>", f'"{v}"^^<{xsd}{t}>') for v, t in (("1.0E21", "double"), ("100000000000000000000", "integer"), ("5", "integer")))}


def test_names_are_read_by_version(spark):
    """One label, two terms in two versions; a third version doesn't know it; a name twice in one version is an error."""
    sub, typ, cls = SUB, f"<{RDF}type>", f"<{OWL}Class>"
    rows = [(g, iri(c), typ, cls) for g, c in (("v1", "A1"), ("v1", "K1"), ("v2", "A2"), ("v2", "K2"), ("v3", "A1"), ("v3", "K3"))]
    rows += [("v1", iri("K1"), sub, iri("A1")), ("v2", iri("K2"), sub, iri("A2")), ("v3", iri("K3"), sub, iri("A1"))]
    index = [("v1", EX + "A1", "A1", "heart"), ("v2", EX + "A2", "A2", "heart"), ("v3", EX + "A1", "A1", "other"), ("v2", EX + "X", "X", "twice"), ("v2", EX + "Y", "Y", "twice"), ("v1", EX + "X", "X", "only here")]
    e = mos.Evaluator(spark.createDataFrame(rows, "g string, s string, p string, o string"), spark.createDataFrame(index, "version_id string, iri string, short string, norm string"))
    found = lambda text: {(r.g, r.cls.rpartition("/")[2][:-1]) for r in e.run(text).collect()}
    assert found("heart") == {("v1", "A1"), ("v1", "K1"), ("v2", "A2"), ("v2", "K2")}
    assert found("A1") == {("v1", "A1"), ("v1", "K1"), ("v3", "A1"), ("v3", "K3")}
    assert found("heart or 'only here'") == {("v1", "A1"), ("v1", "K1")} and found("A2 and 'only here'") == set()
    for text, error in (("nowhere", mos.ParseError), ("twice", mos.AmbiguousLabel)):
        with pytest.raises(error):
            e.run(text)
