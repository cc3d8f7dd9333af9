from triplewright.sources import syntaxes
from triplewright.sources.syntaxes import obo, rdfxml, turtle

TTL = """@prefix ex: <http://ex/> . @prefix owl: <http://www.w3.org/2002/07/owl#> . PREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#>
ex:a a owl:Class ; rdfs:label "A \\"q\\""@en, 'B' ; rdfs:subClassOf [ owl:onProperty ex:p ; owl:someValuesFrom ex:b ] .
ex:l owl:members ( ex:a ex:b ) . # end
ex:a ex:n 5, 2.5, true .
"""
XML = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xml:base="http://ex/">
<owl:Class rdf:about="http://ex/a"><rdfs:label xml:lang="en">A</rdfs:label><rdfs:subClassOf><owl:Restriction><owl:onProperty rdf:resource="http://ex/p"/><owl:someValuesFrom rdf:resource="b"/></owl:Restriction></rdfs:subClassOf></owl:Class>
<rdf:Description rdf:about="http://ex/l"><owl:members rdf:parseType="Collection"><rdf:Description rdf:about="http://ex/a"/><rdf:Description rdf:about="http://ex/b"/></owl:members></rdf:Description></rdf:RDF>"""
OBO = """format-version: 1.2

[Term]
id: GO:0000001
name: start
def: "The first." [x]
synonym: "begin" EXACT []
is_a: GO:0000002 ! other

[Typedef]
id: part_of
name: part of
"""


def test_turtle():
    got = turtle(TTL)
    assert ("<http://ex/a>", "<http://www.w3.org/2000/01/rdf-schema#label>", '"A "q""@en') in got
    assert ("<http://ex/a>", "<http://ex/n>", '"2.5"^^<http://www.w3.org/2001/XMLSchema#decimal>') in got
    assert len(got) == 3 + 1 + 2 + 1 + 4 + 3 and sum(s.startswith("_:") for s, _, _ in got) == 6


def test_rdfxml():
    got = rdfxml(XML)
    assert ("<http://ex/a>", "<http://www.w3.org/2000/01/rdf-schema#label>", '"A"@en') in got
    assert any(p.endswith("someValuesFrom>") and o == "<http://ex/b>" for _, p, o in got) and sum(p.endswith("#first>") for _, p, _ in got) == 2


def test_obo():
    got = obo(OBO)
    s = "<http://purl.obolibrary.org/obo/GO_0000001>"
    assert (s, "<http://www.w3.org/2000/01/rdf-schema#subClassOf>", "<http://purl.obolibrary.org/obo/GO_0000002>") in got
    assert (s, "<http://purl.obolibrary.org/obo/IAO_0000115>", '"The first."') in got and len(got) == 7


def test_files(spark, tmp_path):
    for name, text in (("a.ttl", TTL), ("b.ttl", TTL)):
        (tmp_path / name).write_text(text, encoding="utf-8")
    quads = syntaxes.load(spark, str(tmp_path), "turtle", "<urn:g>")
    one = len(turtle(TTL))
    blank = sum("_:" in s + o for s, _, o in turtle(TTL))
    assert quads.count() == one + blank  # blank nodes of two files stay apart


TRIG = """@prefix ex: <http://ex/> . ex:s ex:p ex:o . ex:g { ex:a ex:b "x"@en ; ex:c [ ex:d 1 ] . ex:a ex:e ex:f } GRAPH ex:h { ex:i ex:j ex:k . } { ex:l ex:m ex:n }"""
JSONLD = """{"@context": {"@vocab": "http://v/", "ex": "http://ex/", "name": {"@id": "ex:name", "@language": "en"}, "knows": {"@id": "ex:knows", "@type": "@id"}, "parts": {"@id": "ex:parts", "@container": "@list"}, "when": {"@id": "ex:when", "@type": "http://www.w3.org/2001/XMLSchema#date"}, "skip": null, "@base": "http://base/"},
"@id": "a", "@type": ["Person", "ex:T"], "name": "Ann", "knows": ["ex:b", "c", {"@id": "_:x", "name": ["X", null]}], "parts": [1, 2.5, true], "when": "2024-01-01", "skip": "no", "other": {"@value": "v", "@language": "de"}, "@graph": [{"@id": "ex:in", "ex:q": "r"}]}"""


def test_trig():
    got = syntaxes.trig(TRIG)
    ex = "<http://ex/{}>".format
    assert (None, ex("s"), ex("p"), ex("o")) in got and (ex("g"), ex("a"), ex("b"), '"x"@en') in got and (ex("g"), ex("a"), ex("e"), ex("f")) in got
    assert (ex("h"), ex("i"), ex("j"), ex("k")) in got and (None, ex("l"), ex("m"), ex("n")) in got
    assert len(got) == 7 and [t for t in got if t[1].startswith("_:")][0][0] == ex("g")


def test_jsonld():
    got = syntaxes.jsonld(JSONLD, "z_")
    a, ex, xsd = "<http://base/a>", "<http://ex/{}>".format, "http://www.w3.org/2001/XMLSchema#"
    triples = {t[1:] for t in got if t[0] is None}
    assert {(a, f"<{syntaxes.RDF}type>", "<http://v/Person>"), (a, f"<{syntaxes.RDF}type>", ex("T")), (a, ex("name"), '"Ann"@en'), (a, ex("knows"), ex("b")), (a, ex("knows"), "<http://base/c>")} <= triples
    assert {(a, ex("knows"), "_:z_x"), ("_:z_x", ex("name"), '"X"@en'), (a, ex("when"), f'"2024-01-01"^^<{xsd}date>'), (a, "<http://v/other>", '"v"@de')} <= triples
    assert [t for t in got if t[0]] == [(a, ex("in"), ex("q"), '"r"')]
    firsts = [t[3] for t in got if t[2] == f"<{syntaxes.RDF}first>"]
    assert sorted(firsts) == sorted([f'"1"^^<{xsd}integer>', f'"2.5E0"^^<{xsd}double>', f'"true"^^<{xsd}boolean>']) and not any("skip" in t[2] for t in got)


def test_files_keep_their_graphs(spark, tmp_path):
    (tmp_path / "a.trig").write_text(TRIG)
    rows = syntaxes.load(spark, f"{tmp_path}/a.trig", "trig", "<urn:d>").collect()
    assert len(rows) == 7 and {r.g for r in rows} == {"<urn:d>", "<http://ex/g>", "<http://ex/h>"}
    try:
        syntaxes.load(spark, str(tmp_path), "n4")
        raise AssertionError("an unknown syntax passed")
    except ValueError as e:
        assert "unknown syntax" in str(e)
