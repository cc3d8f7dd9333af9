"""Files read in pieces against files read as a whole."""

import re

import pytest

from triplewright.sources import splitting, syntaxes

HEAD = "@prefix ex: <http://e/> .\nPREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#>\n@base <http://b/> . # where it is\n\n"
BODY = "".join(
    f'ex:s{i} a ex:C ;\n  rdfs:label "Label {i}. With a dot"@en , "v. {i}" ;\n  ex:size {i} , {i}.5 .\n\n# a remark\n<r{i}> ex:part _:shared , [ ex:p ex:o{i} ] .\nex:l{i} ex:list ( ex:a "b" [] ) .\n_:shared ex:n ex:s{i} . ex:same ex:line ex:s{i} .\n'
    for i in range(150)
) + "[] a ex:Twice .\n[] a ex:Twice .\nex:last ex:p ex:o ."
OBO = "format-version: 1.2\nontology: x\n\n" + "".join(f"[Term]\nid: X:{i}\nname: term {i}\ndef: \"A [bracket] {i}.\" []\nis_a: X:{i + 1} ! next\n\n" for i in range(200)) + "[Typedef]\nid: part_of\nname: part of\n"


def quads(df):
    """Rows with nodes that have no label replaced by a sign (how many of them there are is compared apart), labels kept."""
    rows = [tuple(r) for r in df.collect()]
    sign = lambda t: re.sub(r"^_:[0-9a-f]{8}_(?!n).*", "_", t)
    nodes = {t for r in rows for t in r[1:] if sign(t) == "_"}
    return sorted(tuple(map(sign, r)) for r in rows), len(nodes)


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("text", [HEAD + BODY, "﻿" + HEAD + BODY, HEAD + 'ex:x rdfs:comment """Two\nlines.\nand a dot.\n""" .\n' + BODY, HEAD + BODY + "\n# ends with a dot.\nex:z ex:p ex:o .\n", HEAD + BODY + "\n@prefix ex: <http://other/> .\nex:z ex:p ex:o .\n", (HEAD + BODY).replace("\n", "\r\n"), "<http://a> <http://b> <http://c> .\n", ""])
def test_turtle_in_pieces_equals_the_whole(spark, tmp_path, small_splits, text):
    (tmp_path / "a.ttl").write_bytes(text.encode())
    found = splitting.load(spark, str(tmp_path), "turtle", "<urn:g>")
    assert quads(found) == quads(syntaxes.load(spark, str(tmp_path), "turtle", "<urn:g>"))
    assert quads(found) == quads(found)


def test_a_file_is_shared_out(spark, tmp_path, small_splits):
    (tmp_path / "a.ttl").write_text(HEAD + BODY)
    (tmp_path / "b.ttl").write_text("@prefix ex: <http://other/> .\nex:only ex:here _:shared .\n")
    pieces = spark.read.option("lineSep", splitting.SEPARATOR["turtle"]).text(str(tmp_path))
    assert pieces.rdd.getNumPartitions() > 10
    assert quads(splitting.load(spark, str(tmp_path), "turtle")) == quads(syntaxes.load(spark, str(tmp_path), "turtle"))
    assert {r.file[-5:]: r.whole for r in splitting.surveyed(spark, str(tmp_path)).collect()} == {"a.ttl": False, "b.ttl": False}


def test_obo_in_pieces_equals_the_whole(spark, tmp_path, small_splits):
    (tmp_path / "a.obo").write_text(OBO)
    found = splitting.load(spark, str(tmp_path), "obo", "<urn:g>")
    assert quads(found) == quads(syntaxes.load(spark, str(tmp_path), "obo", "<urn:g>")) and found.count() > 700


def test_what_cannot_be_read_names_its_file(spark, tmp_path):
    (tmp_path / "bad.ttl").write_text("@prefix ex: <http://e/> .\nex:a ex:b .\n")
    with pytest.raises(Exception, match="bad.ttl"):
        splitting.load(spark, str(tmp_path), "turtle").count()
    with pytest.raises(ValueError):
        splitting.load(spark, str(tmp_path), "rdfxml")
