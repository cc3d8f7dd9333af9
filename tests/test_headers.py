"""Headers and records on odd input: nulls, repeats, empty tables, blank headers, other time zones, columns that are not there."""

import glob
import json

from pyspark.sql import functions as F

from triplewright.operators import versions
from triplewright.sources import headers, records
from triplewright.sources.headers import DC, DCT, OWL, RDF, RDFS
from triplewright.streaming import usage

TYPE, ONTOLOGY = f"<{RDF}type>", f"<{OWL}Ontology>"


def quads(spark, *rows):
    return spark.createDataFrame([(g, s, p, o) for g, s, p, o in rows], "g string, s string, p string, o string")


def catalogue(spark, *rows):
    return spark.createDataFrame(list(rows), "g string, iri string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_subjects_never_bleed(spark):
    q = quads(spark, ("a", "<http://x/o#>", TYPE, ONTOLOGY), ("a", "<http://x/other>", TYPE, ONTOLOGY), ("b", "<http://x/root>", TYPE, ONTOLOGY), ("b", "<http://x/root>", TYPE, ONTOLOGY), ("b", "<http://x/root>", f"<{OWL}imports>", "<http://x/imp>"), ("b", "<http://x/imp>", TYPE, ONTOLOGY),
              ("c", "_:h", TYPE, ONTOLOGY), ("d", "<http://x/1>", TYPE, ONTOLOGY), ("d", "<http://x/2>", TYPE, ONTOLOGY), ("e", "<http://x/only>", TYPE, ONTOLOGY), ("not catalogued", "<http://x/1>", TYPE, ONTOLOGY), ("f", None, TYPE, ONTOLOGY))
    c = catalogue(spark, ("a", "http://x/o"), ("a", "http://x/o"), ("b", "http://y"), ("c", "http://y"), ("d", "http://y#"), ("e", None), ("f", ""), ("g", "urn:y"))
    assert rows(headers.header_subjects(q, c)) == [
        ("a", "<http://x/o#>", "variant"), ("b", "<http://x/root>", "root"), ("d", "<http://y#>", "catalogued"), ("d", "<http://y>", "catalogued"), ("e", "<http://x/only>", "root"), ("g", "<urn:y>", "catalogued")]


def test_annotations_prefer_properties_and_name_twenty(spark):
    s = "<http://x/o>"
    q = quads(spark, *(("a", s, f"<{DCT}creator>", f'"{i:02}"') for i in range(25)), ("a", s, f"<{DC}creator>", '"00"'), ("a", s, f"<{RDFS}label>", '"A label"@en'), ("a", s, f"<{DC}title>", '"DC"'), ("a", s, f"<{DC}rights>", '"(c)"'), ("a", None, f"<{DC}title>", '"lost"'), ("a", s, f"<{DCT}title>", None))
    got = {r.g: r for r in headers.annotations(q, catalogue(spark, ("a", "http://x/o"), ("b", "http://x/o"))).collect()}
    assert (got["a"].title, got["a"].description, got["a"].license, got["a"].creators) == ("DC", None, "(c)", [f"{i:02}" for i in range(20)])
    assert (got["b"].title, got["b"].creators) == (None, [])


def test_blank_header_only_without_title(spark):
    said = lambda g, s, p, o: (g, s, f"<{p}>", o)
    q = quads(spark, *(("a" if own else "b", "_:h", TYPE, ONTOLOGY) for own in (0, 1)), said("a", "_:h", DCT + "title", '"Blank"'), said("b", "_:h", DCT + "title", '"Blank"'), said("a", "<http://x/o>", DCT + "title", '"Eigen"@de'), said("a", "<http://x/o>", RDFS + "label", '"own"@en'),
              said("b", "<http://x/o>", RDFS + "seeAlso", "<http://z>"), said("b", "_:h", RDFS + "seeAlso", "_:z"), said("b", "_:h", RDFS + "seeAlso", "<http://z>"))
    got = rows(headers.header_roles(q, catalogue(spark, ("a", "http://x/o"), ("b", "http://x/o"))))
    assert got == [("a", "title", 1, "Eigen"), ("b", "see_also", 1, "http://z"), ("b", "see_also", 2, "z"), ("b", "title", 1, "Blank")]


def test_empty_tables(spark):
    q, c = quads(spark), catalogue(spark)
    for f in (headers.header_subjects, headers.annotations, headers.header_roles, headers.header_candidates, headers.version_iris):
        assert f(q, c).collect() == []
    assert headers.preferred_namespaces(q).collect() == []
    none = spark.createDataFrame([], "ontology_id string, version_id string, iri string")
    for f in (records.dataset_records, records.activities, records.artefacts, records.artefact_records, records.distributions):
        assert f(none, "http://app", F.lit("<urn:m>")).collect() == []
    listed = {r.p.rsplit("#", 1)[1]: r.o for r in records.collection(none, F.col("iri"), "http://app/l", ["iri"], 1, 5, F.lit("<urn:m>")).collect()}
    assert "next>" not in listed and "previous>" not in listed and listed["last>"] == "<http://app/l?page=1&page_size=5>"


def test_moments_in_utc_and_absent_columns(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        one = spark.sql("SELECT 'o' AS ontology_id, 'v' AS version_id, 'x' AS extra, make_timestamp(2024, 7, 1, 12, 0, 0.25, 'Europe/Berlin') AS created, timestamp_ntz'2024-01-02 03:04:05' AS ended")
        made = {r.p: r.o for r in records.dataset_records(one, "http://app", F.lit("<urn:m>")).collect()}
        ended = {r.p: r.o for r in records.activities(one, "http://app", F.lit("<urn:m>")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert made[f"<{DCT}created>"].startswith('"2024-07-01T10:00:00.250000+00:00"^^') and f"<{DCT}title>" not in made
    assert ended["<http://www.w3.org/ns/prov#endedAtTime>"].startswith('"2024-01-02T03:04:05+00:00"^^')


def test_fingerprints_stop_when_nothing_changes(spark):
    def chain(n, name):
        return [(f"_:{name}{i}", "p", f"_:{name}{i + 1}") for i in range(n)] + [(f"_:{name}{n}", "p", "end")]

    triples = spark.createDataFrame(chain(3, "a") + chain(3, "b") + chain(14, "c") + [("_:x", "p", "_:y"), ("_:y", "p", "_:x"), ("s", "p", "_:a0")], "s string, p string, o string")
    got = {r.node: r.print for r in versions.fingerprints(triples).collect()}
    assert got["_:a0"] == got["_:b0"] == got["_:c11"] != got["_:a1"] and got["_:x"] == got["_:y"]
    assert len(got) == 4 + 4 + 15 + 2
    below = {}
    for s, p, o in triples.collect():
        below.setdefault(s, []).append((p, o))

    def plain(node, depth):
        import hashlib

        if depth == 0:
            return "max"
        lines = sorted(f"{p}\t{plain(o, depth - 1) if o in below and o.startswith('_:') else o}" for p, o in below[node])
        return hashlib.sha1("\n".join(lines).encode()).hexdigest()[:16]

    assert got == {n: plain(n, 10) for n in got}


def test_export_is_one_document(spark, tmp_path):
    table = spark.createDataFrame([(i, None if i % 3 else 'say "x", a comma', f"2024-01-{i + 1:02}") for i in range(9)], "n long, kind string, day string").withColumn("day", F.to_date("day")).repartition(3)
    for name, rows_of in (("whole", table), ("empty", table.limit(0))):
        n = usage.export(rows_of, f"{tmp_path}/{name}", "2024-01-01T00:00:00+00:00")
        text = "".join(open(f).read() for f in sorted(glob.glob(f"{tmp_path}/{name}/part-*")))
        found = json.loads(text)
        assert found["exported_at"] == "2024-01-01T00:00:00+00:00" and found["count"] == n == len(found["rows"]) == rows_of.count()
        assert sorted((r["n"], r["kind"], r["day"]) for r in found["rows"]) == sorted((r.n, r.kind, str(r.day)) for r in rows_of.collect())


def test_resolvability_and_stale_differences(spark):
    from triplewright.functions import text as X

    heads = spark.createDataFrame([(None, "@prefix a: <b> ."), (None, None), ("text/plain", " \n<?xml?><x>OWL</x>"), ("text/plain", "<https://a> <https://b> <c> ."), (" ", "@base"), ("text/xml", "<rdf:RDF"), ("application/n-quads;q=1", None)], "t string, h string")
    assert [r[0] for r in heads.select(X.rdf_media(F.col("t"), F.col("h"))).collect()] == [True, False, True, True, False, False, True]
    diffs = spark.createDataFrame([(1, 2, "ready", "failed", "ready"), (1, 3, "ready", "ready", "failed"), (3, 1, "ready", "missing", "missing"), (1, 2, "failed", "failed", "failed"), (2, 1, "ready", "ready", None)], "from_id int, to_id int, status string, from_state string, to_state string")
    assert sorted((r.from_id, r.to_id) for r in versions.stale_diffs(diffs, spark.createDataFrame([(1,), (1,)], "id int")).collect()) == [(1, 2), (2, 1), (3, 1)]
