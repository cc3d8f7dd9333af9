"""Profiles: a graph per rule, which it breaks and no other."""

import pytest

from triplewright.operators import profiles
from triplewright.sources import syntaxes

PRE = "@prefix : <http://e/> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . :p a owl:ObjectProperty . "


def some(p, c, kind="some"):
    return f"[ a owl:Restriction ; owl:onProperty :{p} ; owl:{kind}ValuesFrom {c} ]"


def most(n, p="p"):
    return f"[ owl:onProperty :{p} ; owl:maxCardinality {n} ]"


ALL = lambda kind, *names: {(n, kind) for n in names}
CASES = [
    (":C rdfs:subClassOf :D", set()),
    (":C rdfs:subClassOf [ owl:unionOf ( :D :E ) ]", ALL("or on the right", "EL", "QL", "RL")),
    ("[ owl:unionOf ( :D :E ) ] rdfs:subClassOf :C", ALL("or on the left", "EL", "QL")),
    (f":C rdfs:subClassOf {some('p', ':D')}", ALL("some on the right", "RL")),
    (f"{some('p', ':D')} rdfs:subClassOf :C", ALL("some on the left", "QL")),
    (f"{some('p', 'owl:Thing')} rdfs:subClassOf :C", set()),
    (f":C rdfs:subClassOf {some('p', ':D', 'all')}", ALL("only on the right", "EL", "QL")),
    (f"{some('p', ':D', 'all')} rdfs:subClassOf :C", ALL("only on the left", "EL", "QL", "RL")),
    (f":C rdfs:subClassOf [ owl:complementOf {some('p', ':D')} ]", ALL("not on the right", "EL") | ALL("some on the left", "QL")),
    (f":C rdfs:subClassOf [ owl:intersectionOf ( :D [ owl:complementOf [ owl:intersectionOf ( :E {some('p', ':F')} ) ] ] ) ]", ALL("not on the right", "EL") | {("QL", "and on the left"), ("QL", "some on the left")}),
    (f":C rdfs:subClassOf {most(1)}", ALL("max on the right", "EL", "QL")),
    (f":C rdfs:subClassOf {most(2)}", ALL("max on the right", "EL", "QL", "RL")),
    (f":p a owl:TransitiveProperty . :C rdfs:subClassOf {most(1)}", ALL("max on the right", "EL", "QL") | {("QL", "TransitiveProperty"), ("DL", "not simple: cardinality")}),
    (f":p rdfs:subPropertyOf :q . :p a owl:TransitiveProperty . :C rdfs:subClassOf {most(0, 'q')}", ALL("max on the right", "EL", "QL") | {("QL", "TransitiveProperty"), ("DL", "not simple: cardinality")}),
    (":p owl:propertyChainAxiom ( :p :q )", ALL("propertyChainAxiom", "QL")), (":p owl:propertyChainAxiom ( :p :p )", ALL("propertyChainAxiom", "QL")),
    (":p owl:propertyChainAxiom ( :q :p :r )", ALL("propertyChainAxiom", "QL") | ALL("chains without an order", "DL")),
    (":r owl:propertyChainAxiom ( :p :q ) . :p owl:propertyChainAxiom ( :r :s )", ALL("propertyChainAxiom", "QL") | ALL("chains without an order", "DL")),
    (":p a owl:DatatypeProperty", ALL("a property of two kinds", "DL")),
    (f":C owl:equivalentClass {some('p', ':D')}", {("QL", "some on the left"), ("RL", "some on the right")}),
    (":C rdfs:subClassOf [ owl:onProperty :p ; owl:hasSelf true ]", ALL("self on the right", "QL", "RL")),
    (":d rdfs:range xsd:boolean", ALL("datatype", "EL", "QL")), (f":C rdfs:subClassOf {some('d', 'xsd:float')}", ALL("datatype", "EL", "QL") | ALL("some on the right", "RL")),
    (":p a owl:FunctionalProperty", ALL("FunctionalProperty", "EL", "QL")), (":d a owl:FunctionalProperty", ALL("FunctionalProperty", "QL")), (":p a owl:ReflexiveProperty", ALL("ReflexiveProperty", "RL")),
    (":C owl:unionOf ( :D :E )", {("EL", "or on the left"), ("EL", "or on the right"), ("QL", "or on the left"), ("QL", "or on the right"), ("RL", "or on the right")}),
    (":C owl:oneOf ( :i )", ALL("oneOf on the left", "QL") | ALL("oneOf on the right", "QL", "RL")), (":C owl:disjointUnionOf ( :D :E )", ALL("disjointUnionOf", "EL", "QL", "RL")),
    (f":q rdfs:domain {some('p', ':D', 'all')}", ALL("only on the right", "EL", "QL")), (f":i a {some('p', ':D')}", ALL("some on the right", "RL")),
    (f"{some('p', ':D')} owl:disjointWith :C", ALL("some on the left", "QL")),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(f"<urn:{i}>", *t) for i, (text, _) in enumerate(CASES) for t in syntaxes.turtle(f"{PRE} {text} .", f"g{i}_")]
    quads = spark.createDataFrame(rows, "g string, s string, p string, o string")
    return profiles.violations(quads).collect(), profiles.verdicts(quads).collect()


@pytest.mark.parametrize("i", range(len(CASES)))
def test_each_rule(found, i):
    assert {(r.profile, r.kind) for r in found[0] if r.g == f"<urn:{i}>"} == CASES[i][1], CASES[i][0]


def test_verdicts(found):
    for i, (_, broken) in enumerate(CASES):
        outside = {p for p, _ in broken}
        outside = set(profiles.PROFILES) if "DL" in outside else outside
        assert {r.profile for r in found[1] if r.g == f"<urn:{i}>" and not r.conforms} == outside


def test_error_kinds_and_empty(spark):
    texts = {"Invalid annotation found in x": "invalid_annotation", "ParserError at 3": "rdf_syntax", "unexpected Property Kind": "property_kind", "": "other"}
    rows = spark.createDataFrame([(t,) for t in texts], "m string")
    assert {r.m: r.k for r in rows.select("m", profiles.error_kind("m").alias("k")).collect()} == texts
    none = spark.createDataFrame([], "g string, s string, p string, o string")
    assert profiles.verdicts(none).count() == 0
