import pytest
from pyspark.sql import functions as F

from triplewright.operators import axioms, indexing, search, versions
from triplewright.plans import mos
from triplewright.sources import rdf
from triplewright.streaming import usage

OWL, RDF, RDFS, XSD = axioms.OWL, axioms.RDF, axioms.RDFS, "http://www.w3.org/2001/XMLSchema#"


def e(x):
    return f"<http://ex/{x}>"


def quads_of(spark, triples):
    return spark.createDataFrame([("<urn:g>", *t) for t in triples], "g string, s string, p string, o string")


def test_nquads_files(spark, tmp_path):
    (tmp_path / "a.nq").write_text('<http://a> <http://p> "x \\"y\\" \\\\n\\n"@en .\n# note\nbroken line\n_:b <http://p> <http://c> <http://g> .\n<http://a> <http://p> "bad tag"@x1234567890 .\n<http://a> <http://p> "x \\"y\\" \\\\n\\n"@en .\n', encoding="utf-8")
    rows = {tuple(r) for r in rdf.load(spark, str(tmp_path / "a.nq")).collect()}
    assert (rdf.DEFAULT_GRAPH, "<http://a>", "<http://p>", '"x "y" \\n\n"@en') in rows
    assert (rdf.DEFAULT_GRAPH, "<http://a>", "<http://p>", '"bad tag"') in rows
    assert len(rows) == 3 and any(r[1].startswith("_:") and r[1] != "_:b" for r in rows)
    quads = rdf.load(spark, str(tmp_path / "a.nq"))
    again = rdf.parse_nquads(rdf.to_nquads(quads))
    assert {tuple(r) for r in again.collect()} == rows


def test_canonical_identity_ignores_order(spark):
    a = quads_of(spark, [(e(i), e("p"), e(i + 1)) for i in range(20)])
    same = rdf.canonical_identity(a.orderBy(F.desc("s"))).first().identity
    assert rdf.canonical_identity(a.unionByName(a)).first().identity == same
    assert rdf.canonical_identity(a.where(F.col("s") != e(3))).first().identity != same


@pytest.fixture(scope="module")
def pizza(spark):
    typ, sub = f"<{RDF}type>", f"<{RDFS}subClassOf>"
    cls = [(e(c), typ, f"<{OWL}Class>") for c in ("Pizza", "Margherita", "Topping", "Tomato", "Cheese", "Hot", "Veggie", "Big")]
    labels = [(e(c), f"<{RDFS}label>", f'"{c}"@en') for c in ("Pizza", "Margherita", "Topping", "Tomato", "Cheese", "Hot", "Veggie", "Big")]
    return quads_of(spark, cls + labels + [
        (e("hasTopping"), typ, f"<{OWL}ObjectProperty>"), (e("hasBase"), typ, f"<{OWL}ObjectProperty>"), (e("hasTomato"), f"<{RDFS}subPropertyOf>", e("hasTopping")), (e("hasTopping"), f"<{RDFS}label>", '"has topping"'),
        (e("Margherita"), sub, e("Pizza")), (e("Tomato"), sub, e("Topping")), (e("Cheese"), sub, e("Topping")),
        (e("Margherita"), sub, "_:r1"), ("_:r1", f"<{OWL}onProperty>", e("hasTopping")), ("_:r1", f"<{OWL}someValuesFrom>", e("Tomato")),
        (e("Hot"), sub, e("Margherita")),
        (e("Veggie"), f"<{OWL}equivalentClass>", "_:i"), ("_:i", f"<{OWL}intersectionOf>", "_:l1"), ("_:l1", f"<{RDF}first>", e("Pizza")), ("_:l1", f"<{RDF}rest>", "_:l2"), ("_:l2", f"<{RDF}first>", "_:r2"), ("_:l2", f"<{RDF}rest>", f"<{RDF}nil>"),
        ("_:r2", f"<{OWL}onProperty>", e("hasTopping")), ("_:r2", f"<{OWL}someValuesFrom>", e("Tomato")),
        (e("Big"), sub, "_:c"), ("_:c", f"<{OWL}onProperty>", e("hasTopping")), ("_:c", f"<{OWL}minQualifiedCardinality>", f'"3"^^<{XSD}nonNegativeInteger>'), ("_:c", f"<{OWL}onClass>", e("Cheese")),
        (e("Big"), sub, "_:d"), ("_:d", f"<{OWL}onProperty>", e("size")), ("_:d", f"<{OWL}someValuesFrom>", "_:dt"), ("_:dt", f"<{OWL}onDatatype>", f"<{XSD}integer>"), ("_:dt", f"<{OWL}withRestrictions>", "_:f1"), ("_:f1", f"<{RDF}first>", "_:fc"), ("_:f1", f"<{RDF}rest>", f"<{RDF}nil>"), ("_:fc", f"<{XSD}minInclusive>", f'"5"^^<{XSD}integer>'),
        (e("Cheese"), f"<{OWL}disjointWith>", e("Tomato")),
    ]).cache()


@pytest.mark.parametrize("text, classes", {
    "'Pizza'": {"Pizza", "Margherita", "Hot"},
    "'has topping' some Tomato": {"Margherita", "Hot", "Veggie"},
    "Pizza and hasTopping some Tomato": {"Margherita", "Hot"},
    "Topping or Hot": {"Topping", "Tomato", "Cheese", "Hot"},
    "not Topping": {"Pizza", "Margherita", "Hot", "Veggie", "Big"},
    "hasTopping min 2 Cheese": {"Big"},
    "hasTopping min 4 Cheese": set(),
    "hasTopping max 3 Cheese": set(),
    "<http://ex/size> some xsd:integer[>= 5]": {"Big"},
    "<http://ex/size> some xsd:integer[>= 6]": set(),
    "inverse hasTopping some Margherita": {"Tomato"},
}.items())
def test_class_expressions(pizza, text, classes):
    index = indexing.entity_index(pizza)
    rows = mos.Evaluator(pizza, index).run(text).collect()
    assert {r.cls[len("<http://ex/") : -1] for r in rows} == classes


def test_mos_errors(pizza):
    for bad in ("", "Pizza and", "hasTopping some", "(Pizza", "hasTopping min x Cheese", "inverse hasTopping"):
        with pytest.raises(mos.ParseError):
            mos.parse(bad)
    with pytest.raises(mos.ParseError):
        mos.resolve(indexing.entity_index(pizza), {"Nothing like it"})


def test_manchester_and_classification(pizza):
    texts = {r.node: r.text for r in axioms.manchester(pizza).collect()}
    assert texts["_:i"] == "Pizza and (hasTopping some Tomato)" and texts["_:c"] == "hasTopping min 3 Cheese"
    got = {(r.child[10:], r.parent[10:]) for r in axioms.classify_el(pizza).collect()}
    assert {("Margherita", "Veggie"), ("Hot", "Veggie"), ("Hot", "Pizza"), ("Veggie", "Pizza")} <= got and ("Veggie", "Margherita") not in got
    assert {(r.a, r.b) for r in axioms.disjoint_pairs(pizza).collect()} == {(e("Cheese"), e("Tomato")), (e("Tomato"), e("Cheese"))}


def test_fingerprints_ignore_names(spark):
    a = quads_of(spark, [("_:x", e("p"), "_:y"), ("_:y", e("q"), e("a")), ("_:z", e("p"), "_:w"), ("_:w", e("q"), e("a")), ("_:c", e("p"), "_:c")])
    prints = {r.node: r.print for r in versions.fingerprints(a.select("s", "p", "o")).collect()}
    assert prints["_:x"] == prints["_:z"] and prints["_:y"] == prints["_:w"] != prints["_:x"] and "_:c" in prints


def test_keyset_pages(spark, sf_dir):
    from triplewright.plans.views import Tables

    index, cursor, seen = Tables(spark, sf_dir).index.cache(), None, []
    while True:
        rows, cursor = search.keyset_page(index, 90, cursor)
        seen += [r.iri for r in rows]
        if not cursor:
            break
    assert len(seen) == len(set(seen)) == index.count()


def test_usage_stream(spark, tmp_path):
    rows = [(i, f"2024-01-0{1 + i % 3} 10:00:00", f"v{i % 4}", "view", i % 2) for i in range(40)]
    events = spark.createDataFrame(rows, "event_id int, ts string, visitor string, kind string, ontology int").withColumn("ts", F.to_timestamp("ts")).withColumn("day", F.to_date("ts"))
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = usage.stream_daily(stream, usage.overwrite(f"{tmp_path}/out", ["ontology", "kind", "day"]), f"{tmp_path}/cp")
    q.processAllAvailable()
    q.stop()
    got = {(r.ontology, str(r.day)): r.total for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r.ontology, str(r.day)): r["count"] for r in events.groupBy("ontology", "day").count().collect()}
    assert got == want
    q = usage.unique_visits(stream).writeStream.format("memory").queryName("uniq").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("uniq").count() == usage.unique_visits(events).count()
