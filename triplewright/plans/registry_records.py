"""Queries of headers, metadata records and an annotated index, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from triplewright.functions import text as X
from triplewright.operators import indexing, versions
from triplewright.operators.staging import shared_dir
from triplewright.plans.registry import query
from triplewright.sources import headers, records
from triplewright.sources.headers import DC, DCT, MOD, OWL, RDF, RDFS, SCHEMA, SKOS, VANN
from triplewright.sources.records import DCAT, FOAF, HYDRA, PROV, SD, VOID
from triplewright.streaming import usage

_INT, _TIME = "^^<http://www.w3.org/2001/XMLSchema#integer>", "+00:00\"^^<http://www.w3.org/2001/XMLSchema#dateTime>"

# A graph per customer, its header at another address (0, 1), at a root that imports (2), nowhere (3, 4) or at a blank node (5)
_C = "(SELECT *, c_custkey AS k, c_custkey % 6 AS m, c_nationkey AS n FROM {customer})"
_NODE = """CASE m WHEN 0 THEN '<http://ex/o/' || k || '>' WHEN 1 THEN '<http://ex/o/' || k || '#>' WHEN 2 THEN '<http://ex/root/' || k || '>' WHEN 3 THEN '<http://ex/o/' || k || '>' WHEN 4 THEN '<urn:o:' || k || '>' ELSE '_:h' || k END"""
_CATALOGUE = f"""SELECT '<urn:h:' || k || '>' AS g, CASE WHEN m = 5 AND n % 2 = 0 THEN NULL WHEN m = 4 THEN 'urn:o:' || k WHEN m = 0 THEN 'http://ex/o/' || k || '/' ELSE 'http://ex/o/' || k END AS iri FROM {_C} c"""


def _say(s: str, p: str, o: str, where: str = "true") -> str:
    return f"CASE WHEN {where} THEN named_struct('s', {s}, 'p', '<{p}>', 'o', {o}) END"


_HEADERS = "SELECT g, x.* FROM (SELECT '<urn:h:' || k || '>' AS g, explode(array(" + ", ".join([
    _say(_NODE, RDF + "type", f"'<{OWL}Ontology>'", "m IN (0, 1, 2, 5)"), *(_say(f"'<http://ex/{x}/' || k || '>'", RDF + "type", f"'<{OWL}Ontology>'", w) for x, w in (("a", "m = 3"), ("b", "m = 3"), ("imp", "m = 2"))),
    _say(_NODE, OWL + "imports", "'<http://ex/imp/' || k || '>'", "m = 2"), _say("'<http://ex/imp/' || k || '>'", DCT + "title", "'\"Imported\"'", "m = 2"), _say("'<http://ex/imp/' || k || '>'", OWL + "versionIRI", "'<http://ex/0>'", "m IN (2, 4)"),
    _say(_NODE, DCT + "title", "'\"' || c_name || '\"@de'"), _say(_NODE, DCT + "title", "'\"en ' || c_name || '\"@en'", "n % 2 = 0"), _say(_NODE, RDFS + "comment", "'\"' || c_mktsegment || '\"'"),
    _say(_NODE, DCT + "creator", "'<http://ex/nation/' || n || '>'"), _say(_NODE, DCT + "creator", "'\"' || c_name || '\"'"), _say(_NODE, DC + "creator", "'\"' || c_name || '\"'"), _say(_NODE, DC + "creator", "'\"Zed\"'"),
    _say(_NODE, DCT + "rights", "'\"rights\"'", "n % 3 = 0"), _say(_NODE, DCT + "license", "'<http://ex/license/' || (k % 4) || '>'", "n % 2 = 0"), _say(_NODE, OWL + "versionIRI", "'<http://ex/v/' || k || '>'"),
    _say(_NODE, VANN + "preferredNamespacePrefix", "'\"p' || k || '\"'"), _say(_NODE, VANN + "preferredNamespaceUri", "CASE k % 4 WHEN 0 THEN '\" http://ns/' || k || ' \"' WHEN 1 THEN '<http://ns/' || k || '>' ELSE '\"no\"' END", "k % 4 < 3"),
    _say(_NODE, "http://ex/own", "'\"x\"'"), _say("'<http://ex/own>'", RDFS + "label", "'\"own\"@en'", "k % 2 = 0"), _say("'<http://ex/own>'", RDFS + "label", "'\"eigen\"@de'", "k % 2 = 0"),
]) + f")) AS x FROM {_C} c) y WHERE x IS NOT NULL"
_SQL_C = _C.replace("{customer}", "customer")


def _headers(t):
    """The graphs, and the IRI each is known by."""
    return t.spark.sql(_HEADERS, customer=t.customer), t.spark.sql(_CATALOGUE, customer=t.customer)


query("header_subjects", f"""SELECT '<urn:h:' || k || '>' AS g, CASE m WHEN 0 THEN '<http://ex/o/' || k || '>' WHEN 1 THEN '<http://ex/o/' || k || '#>' WHEN 2 THEN '<http://ex/root/' || k || '>' WHEN 3 THEN '<http://ex/o/' || k || '>' ELSE '<urn:o:' || k || '>' END AS s,
CASE WHEN m < 2 THEN 'variant' WHEN m = 2 THEN 'root' ELSE 'catalogued' END AS rule FROM {_SQL_C} c WHERE m < 5 UNION ALL SELECT '<urn:h:' || k || '>', '<http://ex/o/' || k || e || '>', 'catalogued' FROM {_SQL_C} c, (VALUES ('/'), ('#')) x(e) WHERE m = 3""")(
    lambda t: headers.header_subjects(*_headers(t)))
query("header_annotations", f"""SELECT '<urn:h:' || k || '>' AS g, CASE WHEN m < 5 THEN c_name END AS title, CASE WHEN m < 5 THEN c_mktsegment END AS description, CASE WHEN m = 5 THEN NULL WHEN n % 2 = 0 THEN 'http://ex/license/' || (k % 4) WHEN n % 3 = 0 THEN 'rights' END AS license,
CASE WHEN m < 5 THEN c_name || '|http://ex/nation/' || n || '|Zed' ELSE '' END AS creators, CASE WHEN m < 5 THEN 'p' || k END AS preferred_prefix FROM {_SQL_C} c""")(
    lambda t: headers.annotations(*_headers(t)).withColumn("creators", F.array_join("creators", "|")))
query("header_roles", f"""WITH c AS (SELECT *, '<urn:h:' || k || '>' AS g FROM {_SQL_C} c WHERE m > 2)
SELECT g, 'title' AS role, 1 AS position, CASE WHEN n % 2 = 0 THEN 'en ' || c_name ELSE c_name END AS value FROM c UNION ALL SELECT g, 'description', 1, c_mktsegment FROM c UNION ALL SELECT g, 'creator', 1, c_name FROM c UNION ALL SELECT g, 'creator', 2, 'http://ex/nation/' || n FROM c
UNION ALL SELECT g, 'creator', 3, 'Zed' FROM c UNION ALL SELECT g, 'license', 1, CASE WHEN n % 2 = 0 THEN 'http://ex/license/' || (k % 4) ELSE 'rights' END FROM c WHERE n % 2 = 0 OR n % 3 = 0 UNION ALL SELECT g, 'version_iri', 1, 'http://ex/v/' || k FROM c
UNION ALL SELECT g, 'prefix', 1, 'p' || k FROM c UNION ALL SELECT g, 'namespace_uri', 1, CASE k % 4 WHEN 0 THEN ' http://ns/' || k || ' ' WHEN 1 THEN 'http://ns/' || k ELSE 'no' END FROM c WHERE k % 4 < 3""")(
    lambda t: headers.header_roles(*_headers(t)))
query("header_candidates", f"""WITH c AS (SELECT *, '<urn:h:' || k || '>' AS g FROM {_SQL_C} c WHERE m > 2), r AS (
SELECT g, 'title' AS role, '{DCT}title' AS property, c_name AS value, 'de' AS language, false AS is_iri FROM c UNION ALL SELECT g, 'title', '{DCT}title', 'en ' || c_name, 'en', false FROM c WHERE n % 2 = 0 UNION ALL SELECT g, 'description', '{RDFS}comment', c_mktsegment, NULL, false FROM c
UNION ALL SELECT g, 'creator', '{DCT}creator', 'http://ex/nation/' || n, NULL, true FROM c UNION ALL SELECT g, 'creator', '{DCT}creator', c_name, NULL, false FROM c UNION ALL SELECT g, 'creator', '{DC}creator', c_name, NULL, false FROM c UNION ALL SELECT g, 'creator', '{DC}creator', 'Zed', NULL, false FROM c
UNION ALL SELECT g, 'license', '{DCT}rights', 'rights', NULL, false FROM c WHERE n % 3 = 0 UNION ALL SELECT g, 'license', '{DCT}license', 'http://ex/license/' || (k % 4), NULL, true FROM c WHERE n % 2 = 0 UNION ALL SELECT g, 'version_iri', '{OWL}versionIRI', 'http://ex/v/' || k, NULL, true FROM c
UNION ALL SELECT g, 'prefix', '{VANN}preferredNamespacePrefix', 'p' || k, NULL, false FROM c UNION ALL SELECT g, 'namespace_uri', '{VANN}preferredNamespaceUri', CASE k % 4 WHEN 0 THEN ' http://ns/' || k || ' ' WHEN 1 THEN 'http://ns/' || k ELSE 'no' END, NULL, k % 4 = 1 FROM c WHERE k % 4 < 3
UNION ALL SELECT g, 'unknown', '{RDF}type', '{OWL}Ontology', NULL, true FROM c WHERE m = 5 UNION ALL SELECT g, 'unknown', 'http://ex/own', 'x', NULL, false FROM c)
SELECT r.*, CASE WHEN property = 'http://ex/own' AND k % 2 = 0 THEN 'own' END AS label FROM r JOIN c USING (g)""")(lambda t: headers.header_candidates(*_headers(t)))
query("header_version_iris", f"SELECT '<urn:h:' || k || '>' AS g, 'http://ex/v/' || k AS version_iri FROM {_SQL_C} c WHERE m IN (3, 4) OR m = 5 AND n % 2 = 0")(lambda t: headers.version_iris(*_headers(t)))
query("header_namespaces", f"SELECT '<urn:h:' || k || '>' AS g, 'http://ns/' || k AS namespace FROM {_SQL_C} c WHERE m IN (0, 1, 2, 5) AND k % 4 < 2")(lambda t: headers.preferred_namespaces(_headers(t)[0]))

# Records: a version per order
_O = """(SELECT o_orderkey AS k, o_custkey AS c, o_orderpriority AS title, o_orderstatus AS st, CAST(o_orderdate AS TIMESTAMP) AS made FROM orders)"""
_AT = "strftime(made, '%Y-%m-%dT%H:%M:%S')"


def _union(g: str, source: str, facts: list[tuple[str, str, str, str]]) -> str:
    """SQL of facts (subject, predicate, object, condition) over a source."""
    return " UNION ALL ".join(f"SELECT {g} AS g, {s} AS s, '<{p}>' AS p, {o} AS o FROM {source} r WHERE {w}" for s, p, o, w in facts)


def _versions(t):
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    return t.orders.select(
        F.col("o_custkey").alias("ontology_id"), k.alias("version_id"), F.concat(F.lit("http://ex/o/"), F.col("o_custkey")).alias("ontology_iri"), F.concat(F.lit("http://ex/o/"), F.col("o_custkey")).alias("iri"),
        F.when(k % 2 == 0, F.concat(F.lit("http://ex/v/"), k)).otherwise("").alias("version_iri"), F.when(status == "F", F.concat(F.lit("http://ex/files/"), k)).alias("download_url"),
        F.element_at(F.array(*map(F.lit, ("OWL", "ttl", "obo", "zip"))), (k % 4 + 1).cast("int")).alias("format"), F.when(k % 3 == 0, "Owner").otherwise("").alias("owner"), F.when(k % 5 == 0, "http://ex/license").alias("license_url"), F.when(k % 5 == 1, "MIT").otherwise("http://ex/license").alias("license"),
        F.col("o_orderpriority").alias("title"), F.lit("").alias("description"), F.array(F.lit("http://ex/c/1"), F.col("o_orderpriority"), F.lit("http://ex/c/1")).alias("creators"), F.col("o_orderdate").cast("timestamp_ntz").alias("created"), F.col("o_orderdate").cast("timestamp_ntz").alias("modified"),
        k.alias("triples"), (k % 7).alias("classes"), F.lit(None).cast("long").alias("properties"), F.lit(0).alias("entities"), F.lit(3).alias("distinct_subjects"), F.lit(4).alias("distinct_objects"),
        F.when(k % 2 == 0, "ready").otherwise("other").alias("status"), F.when(k % 3 == 0, F.concat(F.lit("short"), k)).alias("shortname"), (k % 2).alias("version_triples"), F.when(k % 4 == 0, F.concat(F.lit("http://ex/src/"), k)).alias("source_url"), F.lit("url").alias("mode"), F.lit("ab").alias("sha256"))


_BASE = "http://app"
_D, _FILE = "'<http://app/api/v1/ontologies/' || c || '/' || k || '>'", "'<http://app/api/v1/ontologies/' || c || '/' || k || '/download>'"


def _graph():
    return F.concat(F.lit("<urn:m:"), F.col("version_id"), F.lit(">"))


_SG = "'<urn:m:' || k || '>'"
query("records_dcat", _union(_SG, _O, [
    (_D, RDF + "type", f"'<{DCAT}Dataset>'", "true"), (_D, DCT + "identifier", "'\"' || k || '\"'", "true"), (_D, DCT + "isVersionOf", "'<http://ex/o/' || c || '>'", "true"), (_D, DCT + "created", f"'\"' || {_AT} || '{_TIME}'", "true"),
    (_D, DCT + "title", "'\"' || title || '\"'", "true"), (_D, DCT + "creator", "'<http://ex/c/1>'", "true"), (_D, DCT + "creator", "'\"' || title || '\"'", "true"), (_D, OWL + "versionIRI", "'<http://ex/v/' || k || '>'", "k % 2 = 0"), (_D, DCT + "publisher", "'\"Owner\"'", "k % 3 = 0"),
    (_D, DCT + "license", "'<http://ex/license>'", "k % 5 = 0"), (_D, DCAT + "distribution", _FILE, "true"), (_FILE, RDF + "type", f"'<{DCAT}Distribution>'", "true"), (_FILE, DCAT + "downloadURL", "'<http://ex/files/' || k || '>'", "st = 'F'"),
    (_FILE, DCAT + "mediaType", "CASE k % 4 WHEN 0 THEN '\"application/owl+xml\"' WHEN 1 THEN '\"text/turtle\"' WHEN 2 THEN '\"text/plain\"' ELSE '\"application/octet-stream\"' END", "true"), (_FILE, DCT + "format", "CASE k % 4 WHEN 0 THEN '\"OWL\"' WHEN 1 THEN '\"ttl\"' WHEN 2 THEN '\"obo\"' ELSE '\"zip\"' END", "true"),
    (_D, VOID + "triples", f"'\"' || k || '\"{_INT}'", "true"), (_D, VOID + "classes", f"'\"' || (k % 7) || '\"{_INT}'", "true"), (_D, VOID + "entities", f"'\"0\"{_INT}'", "true"), (_D, VOID + "distinctSubjects", f"'\"3\"{_INT}'", "true"), (_D, VOID + "distinctObjects", f"'\"4\"{_INT}'", "true"),
    (_D, VOID + "sparqlEndpoint", "'<http://app/sparql>'", "true")]))(lambda t: records.dataset_records(_versions(t), _BASE + "/", _graph()))
_ACT, _MADE, _SRC = "'<http://app/api/v1/versions/' || k || '/provenance>'", "'<http://app/api/v1/ontologies/' || k || '>'", "'<http://ex/src/' || k || '>'"
query("records_prov", _union(_SG, _O, [
    (_ACT, RDF + "type", f"'<{PROV}Activity>'", "true"), (_ACT, PROV + "endedAtTime", f"'\"' || {_AT} || '{_TIME}'", "true"), (_ACT, PROV + "generated", _MADE, "true"), (_MADE, RDF + "type", f"'<{PROV}Entity>'", "true"), (_MADE, PROV + "wasGeneratedBy", _ACT, "true"),
    (_SRC, RDF + "type", f"'<{PROV}Entity>'", "k % 4 = 0"), (_ACT, PROV + "used", _SRC, "k % 4 = 0"), (_ACT, _BASE + "/vocab#sha256", "'\"ab\"'", "true"), (_ACT, _BASE + "/vocab#tripleCount", f"'\"' || k || '\"{_INT}'", "true"), (_ACT, _BASE + "/vocab#registrationMode", "'\"url\"'", "true")]))(
    lambda t: records.activities(_versions(t).withColumn("ended", F.col("created")), _BASE, _graph()))
_A, _ID = "'<http://ex/o/' || c || '>'", "CASE WHEN k % 3 = 0 THEN 'short' || k ELSE c::VARCHAR END"
_DIST = f"'<http://app/mod/artefacts/' || {_ID} || '/distributions/' || k || '>'"
query("mod_artefacts", _union(_SG, _O, [
    (_A, RDF + "type", f"'<{MOD}SemanticArtefact>'", "true"), (_A, RDF + "type", f"'<{OWL}Ontology>'", "true"), (_A, MOD + "acronym", "'\"short' || k || '\"'", "k % 3 = 0"), (_A, DCT + "title", "'\"' || title || '\"'", "true"),
    (_A, DCT + "creator", "'\"http://ex/c/1\"'", "true"), (_A, DCT + "creator", "'\"' || title || '\"'", "true"), (_A, DCT + "license", "CASE WHEN k % 5 = 1 THEN '\"MIT\"' ELSE '<http://ex/license>' END", "true"), (_A, OWL + "versionIRI", "'<http://ex/v/' || k || '>'", "k % 2 = 0"),
    (_A, DCT + "created", f"'\"' || {_AT} || '{_TIME}'", "true"), (_A, DCT + "modified", f"'\"' || {_AT} || '{_TIME}'", "true"), (_A, MOD + "numberOfClasses", f"'\"' || (k % 7) || '\"{_INT}'", "true"), (_A, VOID + "triples", f"'\"' || CASE WHEN k % 7 = 0 THEN k % 2 ELSE k % 7 END || '\"{_INT}'", "true"),
    (_A, MOD + "status", f"'<{MOD}Released>'", "k % 2 = 0"), (_A, DCAT + "distribution", _DIST, "true")]))(
    lambda t: records.artefacts(_versions(t).withColumn("triples", F.col("classes")), _BASE, _graph()))
_REC = f"'<http://app/mod/records/' || {_ID} || '>'"
query("mod_records", _union(_SG, _O, [(_REC, RDF + "type", f"'<{DCAT}CatalogRecord>'", "true"), (_REC, FOAF + "primaryTopic", _A, "true"), (_REC, DCT + "created", f"'\"' || {_AT} || '{_TIME}'", "true"), (_REC, DCT + "modified", f"'\"' || {_AT} || '{_TIME}'", "true")]))(
    lambda t: records.artefact_records(_versions(t), _BASE, _graph()))
query("mod_distributions", _union(_SG, _O, [
    (_DIST, RDF + "type", f"'<{MOD}SemanticArtefactDistribution>'", "true"), (_DIST, RDF + "type", f"'<{DCAT}Distribution>'", "true"), (_DIST, DCAT + "accessURL", _FILE, "true"), (_DIST, DCAT + "downloadURL", _FILE, "true"),
    (_DIST, DCT + "format", "CASE k % 4 WHEN 0 THEN '\"OWL\"' WHEN 1 THEN '\"ttl\"' WHEN 2 THEN '\"obo\"' ELSE '\"zip\"' END", "true"), (_DIST, DCAT + "mediaType", "CASE k % 4 WHEN 0 THEN '\"application/OWL\"' WHEN 1 THEN '\"text/turtle\"' WHEN 2 THEN '\"text/obo\"' ELSE '\"application/zip\"' END", "true"),
    (_DIST, DCT + "created", f"'\"' || {_AT} || '{_TIME}'", "true")]))(lambda t: records.distributions(_versions(t), _BASE, _graph()))
query("mod_resources", _union("'<urn:m:' || version_id || '>'", "(SELECT * FROM entities WHERE type = 'individual')", [("'<' || iri || '>'", RDF + "type", f"'<{OWL}NamedIndividual>'", "true"), ("'<' || iri || '>'", RDFS + "label", "'\"' || label || '\"@en'", "true")]))(
    lambda t: records.resources(t.entities.where("type = 'individual'").withColumn("lang", F.lit("en")), "individual", _graph()))
_CAT, _SRV = "'<http://app/mod/>'", "'<http://app/sparql>'"
query("mod_catalogue", _union("'<urn:m>'", "(SELECT count(*) AS n FROM customer)", [
    (_CAT, RDF + "type", f"'<{MOD}SemanticArtefactCatalog>'", "true"), (_CAT, RDF + "type", f"'<{DCAT}Catalog>'", "true"), (_CAT, DCT + "title", "'\"All\"'", "true"), (_CAT, DCT + "description", "'\"Of all\"'", "true"), (_CAT, MOD + "numberOfArtefacts", f"'\"' || n || '\"{_INT}'", "true"),
    (_SRV, RDF + "type", f"'<{SD}Service>'", "true"), (_CAT, SD + "endpoint", _SRV, "true"), (_CAT, DCAT + "dataset", "'<http://app/mod/artefacts>'", "true")]))(lambda t: records.catalogue(t.customer, _BASE, "All", "Of all", F.lit("<urn:m>")))
_COL, _VIEW = "'<http://app/mod/records>'", "'<http://app/mod/records?page=2&page_size=7>'"
query("mod_collection_page", "WITH t AS (SELECT count(*) AS n FROM customer) " + _union("'<urn:m>'", "t", [
    (_COL, RDF + "type", f"'<{HYDRA}Collection>'", "true"), (_COL, HYDRA + "totalItems", f"'\"' || n || '\"{_INT}'", "true"), (_COL, HYDRA + "itemsPerPage", f"'\"7\"{_INT}'", "true"), (_COL, HYDRA + "view", _VIEW, "true"),
    (_VIEW, HYDRA + "previous", "'<http://app/mod/records?page=1&page_size=7>'", "true"), (_VIEW, HYDRA + "next", "'<http://app/mod/records?page=3&page_size=7>'", "n > 14"), (_VIEW, HYDRA + "first", "'<http://app/mod/records?page=1&page_size=7>'", "true"),
    (_VIEW, HYDRA + "last", "'<http://app/mod/records?page=' || greatest(1, (n + 6) // 7) || '&page_size=7>'", "true")]) + f" UNION ALL SELECT '<urn:m>', {_COL}, '<{HYDRA}member>', '<http://app/mod/records/' || c_custkey || '>' FROM (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 7 OFFSET 7)")(
    lambda t: records.collection(t.customer, F.concat(F.lit("<http://app/mod/records/"), F.col("c_custkey"), F.lit(">")), "http://app/mod/records", ["c_custkey"], 2, 7, F.lit("<urn:m>")))

# An index whose labels, synonyms, definitions and marks can each be wrong
_IAO, _EXACT, _BROAD = indexing.DEFINITIONS[0], indexing.SYNONYMS[1], indexing.SYNONYMS[3]


def _of_part(p: str, o: str, where: str = "true") -> str:
    return f"CASE WHEN {where} THEN named_struct('s', '<http://ex/part/' || k || '>', 'p', '<{p}>', 'o', {o}) END"


_ANNOTATED = "SELECT '<urn:g:x>' AS g, x.* FROM (SELECT explode(array(" + ", ".join([
    _of_part(RDF + "type", f"'<{OWL}Class>'"), _of_part(RDFS + "label", "'\"' || p_name || '\"@en-US'"), _of_part(RDFS + "label", "'\"' || p_name || '\"@de'", "k % 2 = 0"), _of_part(SKOS + "prefLabel", "'\"' || p_name || '\"@en'", "k % 3 = 0"), _of_part(SKOS + "prefLabel", "'\"English ' || k || '\"@en'", "k % 5 = 0"),
    _of_part(DCT + "title", "'\"Titel\"@de'", "k % 4 = 0"), _of_part(SKOS + "altLabel", "'\"' || p_type || '\"'"), _of_part(_EXACT, "'\"' || p_name || '\"'"), _of_part(_EXACT, "'\"zz\"@en'", "k % 3 = 1"), _of_part(_BROAD, "'\"' || p_type || '\"@en'"), _of_part(_BROAD, "'\"English ' || k || '\"'", "k % 2 = 1"),
    _of_part(DCT + "description", "'\"fourth\"'"), _of_part(RDFS + "comment", "'\"third\"'", "k % 2 = 0"), _of_part(SKOS + "definition", "'\"second\"'", "k % 3 = 0"), _of_part(_IAO, "'\"first\"'", "k % 5 = 0"),
    _of_part(OWL + "deprecated", "'\"true\"^^<http://www.w3.org/2001/XMLSchema#boolean>'", "k % 7 = 0"), _of_part(OWL + "deprecated", "'\"false\"^^<http://www.w3.org/2001/XMLSchema#boolean>'", "k % 7 = 1"), _of_part(OWL + "deprecated", "'\"true\"'", "k % 7 = 2"),
]) + ")) AS x FROM (SELECT *, p_partkey AS k FROM {part}) p) y WHERE x IS NOT NULL"
# the English prefLabel equal to the first label is the same label (value and primary tag): the first kept is tagged en-US, so that only 'English k' is tagged en
query("entity_index_annotated", """SELECT 'http://ex/part/' || k AS iri, CASE WHEN k % 5 = 0 THEN 'English ' || k ELSE p_name END AS label, CASE WHEN k % 5 = 0 THEN 'English ' || k ELSE p_name END AS label_en,
CASE WHEN k % 4 = 0 THEN 'Titel' WHEN k % 2 = 0 THEN p_name END AS label_de, p_type || CASE WHEN k % 3 = 1 THEN '|zz' ELSE '' END || CASE WHEN k % 2 = 1 AND k % 5 > 0 THEN '|English ' || k ELSE '' END AS synonyms,
CASE WHEN k % 5 = 0 THEN 'first' WHEN k % 3 = 0 THEN 'second' WHEN k % 2 = 0 THEN 'third' ELSE 'fourth' END AS definition FROM (SELECT *, p_partkey AS k FROM part) WHERE k % 7 > 0""")(
    lambda t: indexing.entity_index(t.spark.sql(_ANNOTATED, part=t.part)).select("iri", "label", F.col("labels")["en"].alias("label_en"), F.col("labels")["de"].alias("label_de"), F.array_join("synonyms", "|").alias("synonyms"), "definition"))
query("deprecated_entities", "SELECT '<urn:g:x>' AS g, '<http://ex/part/' || p_partkey || '>' AS s FROM part WHERE p_partkey % 7 = 0")(lambda t: indexing.deprecated(t.spark.sql(_ANNOTATED, part=t.part)))

# Housekeeping by the key of an order or a part
_TYPES = ("text/turtle; charset=utf-8", "Application/XML", "text/xml", "text/plain", "", " application/octet-stream ", "text/html", None)
_HEADS = ("@PREFIX x: <y> .", "<http://a/b>  <http://c> 1 .", " <?XML version='1.0'?><x xmlns='owl'/>", "plain words", "<HTTP://a> <http://b>")
query("rdf_media", """SELECT k, coalesce(t IN (0, 1) OR t IN (3, 4, 5, 7) AND h IN (0, 1, 2) AND NOT far, false) AS is_rdf FROM (SELECT o_orderkey AS k, o_orderkey % 8 AS t, o_orderkey % 5 AS h, o_orderkey % 3 = 0 AS far FROM orders)""")(
    lambda t: t.orders.select(F.col("o_orderkey").alias("k"), X.rdf_media(
        F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("o_orderkey") % 8 + 1).cast("int")),
        F.concat(F.when(F.col("o_orderkey") % 3 == 0, F.repeat(F.lit("\u00e9 "), 1366)).otherwise(""), F.element_at(F.array(*map(F.lit, _HEADS)), (F.col("o_orderkey") % 5 + 1).cast("int")))).alias("is_rdf")))
query("checks_retryable", """SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 2 = 0 AND (o_orderkey % 5 = 0 OR o_orderkey % 5 = 1 AND o_orderkey % 3 = 0) AND (o_orderkey % 7 > 0 OR o_orderdate <= TIMESTAMP '1995-01-01')
ORDER BY CASE WHEN o_orderkey % 11 > 0 THEN o_orderdate END NULLS FIRST, o_orderkey LIMIT 50""")(
    lambda t: (lambda k: usage.retryable(t.orders.select(
        k.alias("id"), F.when(k % 4 != 1, k % 2 == 1).alias("resolvable"), F.when(k % 5 == 0, 503).when(k % 5 > 1, 404).alias("http_status"), F.when(k % 3 == 0, "no answer").alias("error"),
        F.when(k % 7 == 0, F.col("o_orderdate")).alias("retry_after"), F.when(k % 11 > 0, F.col("o_orderdate")).alias("checked_at")), F.lit("1995-01-01").cast("timestamp_ntz"), 50).select("id"))(F.col("o_orderkey")))
_JOBS = "SELECT l_orderkey AS version_id, CASE WHEN l_quantity < 45 THEN 'reason' ELSE 'index' END AS type, CASE l_partkey % 5 WHEN 0 THEN 'done' WHEN 1 THEN 'running' WHEN 2 THEN 'pending' WHEN 3 THEN 'failed' ELSE 'cancelled' END AS status FROM {lineitem}"
_STATES = f"""s AS (SELECT o_orderkey AS version_id, CASE WHEN bool_or(status = 'done') THEN 'ready' WHEN bool_or(status IN ('running', 'pending')) THEN 'pending' WHEN bool_or(status = 'failed') THEN 'failed' ELSE 'missing' END AS status
FROM orders LEFT JOIN ({_JOBS.format(lineitem="lineitem")}) j ON version_id = o_orderkey AND type = 'reason' GROUP BY 1)"""


def _states(t):
    return versions.reasoning_status(t.orders.select(F.col("o_orderkey").alias("version_id")), t.spark.sql(_JOBS, lineitem=t.lineitem))


query("reasoning_status", f"WITH {_STATES} SELECT * FROM s")(_states)
query("diffs_stale", f"""WITH {_STATES}, d AS (SELECT o_orderkey AS from_id, o_orderkey + 1 AS to_id, CASE o_orderkey % 3 WHEN 0 THEN 'ready' WHEN 1 THEN 'pending' END AS from_state, CASE WHEN o_orderkey % 2 = 0 THEN 'ready' ELSE 'failed' END AS to_state FROM orders WHERE o_orderstatus = 'F')
SELECT from_id, to_id FROM d WHERE coalesce(from_state, '') <> 'ready' AND from_id IN (SELECT version_id FROM s WHERE status = 'ready') OR to_state <> 'ready' AND to_id IN (SELECT version_id FROM s WHERE status = 'ready')""")(
    lambda t: (lambda k: versions.stale_diffs(t.orders.select(
        k.alias("from_id"), (k + 1).alias("to_id"), F.when(F.col("o_orderstatus") == "F", "ready").otherwise("pending").alias("status"), F.when(k % 3 == 0, "ready").when(k % 3 == 1, "pending").alias("from_state"),
        F.when(k % 2 == 0, "ready").otherwise("failed").alias("to_state")), _states(t).where("status = 'ready'").withColumnRenamed("version_id", "id")).select("from_id", "to_id"))(F.col("o_orderkey")))


def _exported(t):
    """Usage by day as a written document, its rows read back."""
    path = f"{shared_dir(t.spark)}/export"
    usage.export(t.usage.groupBy(F.col("ontology").alias("ontology_id"), "kind", "day").agg(F.count_distinct("user_id").alias("unique_count"), F.count("*").alias("total_count")), path, "2024-01-01T00:00:00+00:00")
    lines = t.spark.read.text(path).where("value like '%ontology_id%'").select(F.regexp_replace("value", "^,", "").alias("line"))
    return lines.select(F.from_json("line", "ontology_id long, kind string, day string, unique_count long, total_count long").alias("x")).select("x.*")


query("usage_export", "SELECT ontology AS ontology_id, kind, strftime(day, '%Y-%m-%d') AS day, count(DISTINCT user_id) AS unique_count, count(*) AS total_count FROM usage GROUP BY 1, 2, day")(_exported)
