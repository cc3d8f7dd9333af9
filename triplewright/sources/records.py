"""Metadata of versions as quads: dataset and provenance records, and the graphs of a catalogue of ontologies.

Every function maps rows to quads by one explode, without a shuffle, and takes the graph's term as a column. Facts whose
subject or object is null are left out, as are empty texts where that is said; columns that are not there count as null,
others are ignored. Moments are written in UTC; those without a zone are taken as UTC. A slash at the end of `base` is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplewright.functions import terms as T
from triplewright.sources.headers import DCT, MOD, OWL, RDF, RDFS, SCHEMA, SKOS, VANN

DCAT, VOID, PROV = "http://www.w3.org/ns/dcat#", "http://rdfs.org/ns/void#", "http://www.w3.org/ns/prov#"
FOAF, HYDRA, SD = "http://xmlns.com/foaf/0.1/", "http://www.w3.org/ns/hydra/core#", "http://www.w3.org/ns/sparql-service-description#"
#: Media types of formats in dataset records; others are octet streams.
DATASET_MEDIA = {
    "owl": "application/owl+xml", "rdf": "application/rdf+xml", "ttl": "text/turtle", "nt": "application/n-triples",
    "jsonld": "application/ld+json", "obo": "text/plain", "omn": "text/plain",
}
#: Media types of formats in the catalogue; others are application/ and the format.
CATALOGUE_MEDIA = {
    "owl": "application/owl+xml", "ttl": "text/turtle", "turtle": "text/turtle", "rdf": "application/rdf+xml", "xml": "application/rdf+xml",
    "nt": "application/n-triples", "obo": "text/obo", "json": "application/ld+json", "jsonld": "application/ld+json",
}
#: What a version's status is in the catalogue; others are not stated.
STATUS = {"ready": MOD + "Released", "deprecated": MOD + "Obsolete", "ingested": MOD + "Draft", "reasoning": MOD + "Draft"}
#: Types of listed resources; others are classes.
RESOURCES = {
    "class": OWL + "Class", "individual": OWL + "NamedIndividual", "property": RDF + "Property",
    "concept": SKOS + "Concept", "scheme": SKOS + "ConceptScheme", "collection": SKOS + "Collection",
}
_FACT = "array<struct<s:string,p:string,o:string>>"


class _Rows:
    """Columns of a table, null where it has none."""

    def __init__(self, rows: DataFrame):
        self.types = dict(rows.dtypes)

    def text(self, name: str) -> Column:
        return F.col(name).cast("string") if name in self.types else F.lit(None).cast("string")

    def filled(self, name: str) -> Column:
        """The text, null if empty."""
        return F.nullif(self.text(name), F.lit(""))

    def texts(self, name: str) -> Column:
        return F.col(name).cast("array<string>") if name in self.types else F.array().cast("array<string>")

    def moment(self, name: str) -> Column:
        """A dateTime literal; fractions only where there are any."""
        if name not in self.types:
            return F.lit(None).cast("string")
        at = F.col(name).cast("timestamp_ntz")
        at = F.convert_timezone(F.current_timezone(), F.lit("UTC"), at) if self.types[name] == "timestamp" else at
        text = F.regexp_replace(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")
        return T.typed(F.concat(text, F.lit("+00:00")), T.XSD + "dateTime")

    def count(self, name: str) -> Column:
        return T.typed(F.col(name).cast("long"), T.XSD + "integer") if name in self.types else F.lit(None).cast("string")


def _fact(s: Column, p: str, o: Column) -> Column:
    return F.struct(s.alias("s"), F.lit(f"<{p}>").alias("p"), o.alias("o"))


def _facts(s: Column, p: str, values: Column, make) -> Column:
    """A fact for each value of an array."""
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.struct(s.alias("s"), F.lit(f"<{p}>").alias("p"), make(v).alias("o")))


def _quads(rows: DataFrame, graph: Column, single: list[Column], *lists: Column) -> DataFrame:
    """(g, s, p, o) of each row's facts, equal ones of a row once."""
    facts = F.array_distinct(F.concat(F.array(*single).cast(_FACT), *(x.cast(_FACT) for x in lists)))
    return rows.select(graph.alias("g"), F.explode(facts).alias("x")).select("g", "x.s", "x.p", "x.o").where("s is not null and o is not null")


def _named(iri: str) -> Column:
    return F.lit(f"<{iri}>")


def _iri(*parts) -> Column:
    return T.iri(F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts)))


def _address_or_text(v: Column, pattern: str = "^http") -> Column:
    return F.when(F.regexp_like(v, F.lit(pattern)), T.iri(v)).otherwise(T.plain(v))


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def dataset_records(versions: DataFrame, base: str, graph: Column) -> DataFrame:
    """DCAT and VoID of versions (ontology_id, version_id, ontology_iri, version_iri, download_url, format, owner, license_url,
    title, description, creators, created, triples, classes, properties, entities, distinct_subjects, distinct_objects).

    Empty titles, descriptions, owners, licenses, version IRIs and download addresses are not stated. A creator that is an
    http(s) address is an IRI, else a text.
    """
    base, r = base.rstrip("/"), _Rows(versions)
    at = F.concat(F.lit(f"{base}/api/v1/ontologies/"), r.text("ontology_id"), F.lit("/"), r.text("version_id"))
    d, file = T.iri(at), _iri(at, "/download")
    counts = {"triples": "triples", "classes": "classes", "properties": "properties", "entities": "entities", "distinctSubjects": "distinct_subjects", "distinctObjects": "distinct_objects"}
    single = [
        _fact(d, RDF + "type", _named(DCAT + "Dataset")), _fact(d, DCT + "identifier", T.plain(r.text("version_id"))), _fact(d, DCT + "isVersionOf", T.iri(r.text("ontology_iri"))), _fact(d, DCT + "created", r.moment("created")),
        _fact(d, DCT + "title", T.plain(r.filled("title"))), _fact(d, DCT + "description", T.plain(r.filled("description"))), _fact(d, OWL + "versionIRI", T.iri(r.filled("version_iri"))),
        _fact(d, DCT + "publisher", T.plain(r.filled("owner"))), _fact(d, DCT + "license", T.iri(r.filled("license_url"))), _fact(d, DCAT + "distribution", file),
        _fact(file, RDF + "type", _named(DCAT + "Distribution")), _fact(file, DCAT + "downloadURL", T.iri(r.filled("download_url"))),
        _fact(file, DCAT + "mediaType", T.plain(F.coalesce(_lookup(DATASET_MEDIA, F.lower(r.text("format"))), F.lit("application/octet-stream")))), _fact(file, DCT + "format", T.plain(r.text("format"))),
        *(_fact(d, VOID + p, r.count(c)) for p, c in counts.items()), _fact(d, VOID + "sparqlEndpoint", _named(f"{base}/sparql")),
    ]
    return _quads(versions, graph, single, _facts(d, DCT + "creator", r.texts("creators"), lambda v: _address_or_text(v, "^https?://")))


def activities(ingested: DataFrame, base: str, graph: Column) -> DataFrame:
    """PROV of ingestions (version_id, source_url, mode, sha256, triples, ended): activity, what it made, what it used."""
    base, r = base.rstrip("/"), _Rows(ingested)
    act, made, used = _iri(f"{base}/api/v1/versions/", r.text("version_id"), "/provenance"), _iri(f"{base}/api/v1/ontologies/", r.text("version_id")), T.iri(r.filled("source_url"))
    return _quads(ingested, graph, [
        _fact(act, RDF + "type", _named(PROV + "Activity")), _fact(act, PROV + "endedAtTime", r.moment("ended")), _fact(act, PROV + "generated", made), _fact(made, RDF + "type", _named(PROV + "Entity")),
        _fact(made, PROV + "wasGeneratedBy", act), _fact(used, RDF + "type", _named(PROV + "Entity")), _fact(act, PROV + "used", used), _fact(act, f"{base}/vocab#sha256", T.plain(r.text("sha256"))),
        _fact(act, f"{base}/vocab#tripleCount", r.count("triples")), _fact(act, f"{base}/vocab#registrationMode", T.plain(r.text("mode"))),
    ])


def _artefact_id(r: _Rows) -> Column:
    return F.coalesce(r.filled("shortname"), r.text("ontology_id"))


def artefacts(ontologies: DataFrame, base: str, graph: Column) -> DataFrame:
    """Catalogue entries of ontologies with a version (ontology_id, iri, shortname, ontology_title, created, version_id, version_iri,
    modified, status, version_triples), what its header says (title, description, creators, contributors, publishers, license,
    homepage, version_info, language, citation, funding, prefix, namespace_uri) and counts (classes, properties, individuals, triples).

    Empty texts are not stated. The header's title comes before the catalogue's. A count of triples that is null or zero gives
    way to the version's. Licenses, homepages and namespaces that start with http are IRIs.
    """
    base, r = base.rstrip("/"), _Rows(ontologies)
    a, text = T.iri(r.text("iri")), lambda name: T.plain(r.filled(name))
    triples = F.coalesce(F.nullif(r.count("triples"), F.lit(f'"0"^^<{T.XSD}integer>')), r.count("version_triples"))
    single = [
        _fact(a, RDF + "type", _named(MOD + "SemanticArtefact")), _fact(a, RDF + "type", _named(OWL + "Ontology")), _fact(a, MOD + "acronym", text("shortname")),
        _fact(a, DCT + "title", T.plain(F.coalesce(r.filled("title"), r.filled("ontology_title")))), _fact(a, DCT + "description", text("description")),
        _fact(a, DCT + "license", _address_or_text(r.filled("license"))), _fact(a, FOAF + "homepage", _address_or_text(r.filled("homepage"))), _fact(a, OWL + "versionInfo", text("version_info")),
        _fact(a, OWL + "versionIRI", T.iri(r.filled("version_iri"))), _fact(a, DCT + "language", text("language")), _fact(a, SCHEMA + "citation", text("citation")), _fact(a, SCHEMA + "funding", text("funding")),
        _fact(a, VANN + "preferredNamespacePrefix", text("prefix")), _fact(a, VANN + "preferredNamespaceUri", _address_or_text(r.filled("namespace_uri"))),
        _fact(a, DCT + "created", r.moment("created")), _fact(a, DCT + "modified", r.moment("modified")),
        _fact(a, MOD + "numberOfClasses", r.count("classes")), _fact(a, MOD + "numberOfProperties", r.count("properties")), _fact(a, MOD + "numberOfIndividuals", r.count("individuals")), _fact(a, VOID + "triples", triples),
        _fact(a, MOD + "status", T.iri(_lookup(STATUS, r.text("status")))), _fact(a, DCAT + "distribution", _iri(f"{base}/mod/artefacts/", _artefact_id(r), "/distributions/", r.text("version_id"))),
    ]
    lists = [_facts(a, DCT + p, F.filter(r.texts(c), lambda v: v != ""), T.plain) for p, c in (("creator", "creators"), ("contributor", "contributors"), ("publisher", "publishers"))]
    return _quads(ontologies, graph, single, *lists)


def artefact_records(ontologies: DataFrame, base: str, graph: Column) -> DataFrame:
    """The catalogue's records of ontologies (ontology_id, iri, shortname, created, modified)."""
    base, r = base.rstrip("/"), _Rows(ontologies)
    record = _iri(f"{base}/mod/records/", _artefact_id(r))
    return _quads(ontologies, graph, [_fact(record, RDF + "type", _named(DCAT + "CatalogRecord")), _fact(record, FOAF + "primaryTopic", T.iri(r.text("iri"))), _fact(record, DCT + "created", r.moment("created")), _fact(record, DCT + "modified", r.moment("modified"))])


def distributions(versions: DataFrame, base: str, graph: Column) -> DataFrame:
    """Files of versions (ontology_id, shortname, version_id, format, created)."""
    base, r = base.rstrip("/"), _Rows(versions)
    d, file = _iri(f"{base}/mod/artefacts/", _artefact_id(r), "/distributions/", r.text("version_id")), _iri(f"{base}/api/v1/ontologies/", r.text("ontology_id"), "/", r.text("version_id"), "/download")
    kind = r.text("format")
    return _quads(versions, graph, [
        _fact(d, RDF + "type", _named(MOD + "SemanticArtefactDistribution")), _fact(d, RDF + "type", _named(DCAT + "Distribution")), _fact(d, DCAT + "accessURL", file), _fact(d, DCAT + "downloadURL", file),
        _fact(d, DCT + "format", T.plain(kind)), _fact(d, DCAT + "mediaType", T.plain(F.coalesce(_lookup(CATALOGUE_MEDIA, kind), F.concat(F.lit("application/"), kind)))), _fact(d, DCT + "created", r.moment("created")),
    ])


def resources(entities: DataFrame, entity_type: str, graph: Column) -> DataFrame:
    """Types and labels of entities (iri, label, lang) that are listed as one kind of resource; empty labels are not stated."""
    r, tag = _Rows(entities), _Rows(entities).filled("lang")
    label = r.filled("label")
    e = T.iri(r.text("iri"))
    return _quads(entities, graph, [_fact(e, RDF + "type", _named(RESOURCES.get(entity_type, OWL + "Class"))), _fact(e, RDFS + "label", F.when(tag.isNotNull(), F.concat(T.plain(label), F.lit("@"), tag)).otherwise(T.plain(label)))])


def catalogue(ontologies: DataFrame, base: str, title: str, description: str, graph: Column) -> DataFrame:
    """The catalogue itself: its names, its SPARQL service and how many ontologies it holds."""
    base = base.rstrip("/")
    cat, service = _named(f"{base}/mod/"), _named(f"{base}/sparql")
    rows = ontologies.agg(F.count("*").alias("n"))
    return _quads(rows, graph, [
        _fact(cat, RDF + "type", _named(MOD + "SemanticArtefactCatalog")), _fact(cat, RDF + "type", _named(DCAT + "Catalog")), _fact(cat, DCT + "title", F.lit(f'"{title}"')), _fact(cat, DCT + "description", F.lit(f'"{description}"')),
        _fact(cat, MOD + "numberOfArtefacts", T.typed(F.col("n"), T.XSD + "integer")), _fact(service, RDF + "type", _named(SD + "Service")), _fact(cat, SD + "endpoint", service), _fact(cat, DCAT + "dataset", _named(f"{base}/mod/artefacts")),
    ])


def page(members: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """The rows of a page counted from 1."""
    return members.orderBy(*order).offset((number - 1) * size).limit(size)


def collection(members: DataFrame, member: Column, url: str, order: list, number: int, size: int, graph: Column) -> DataFrame:
    """A listed page: how many rows there are, the page's members, and the pages before, after, first and last."""
    col, address = _named(url), lambda n: _iri(f"{url}?page=", n, f"&page_size={size}")
    view, last = address(str(number)), F.greatest(F.lit(1), F.ceil(F.col("n") / size)).cast("string")
    head = _quads(members.agg(F.count("*").alias("n")), graph, [
        _fact(col, RDF + "type", _named(HYDRA + "Collection")), _fact(col, HYDRA + "totalItems", T.typed(F.col("n"), T.XSD + "integer")), _fact(col, HYDRA + "itemsPerPage", F.lit(f'"{size}"^^<{T.XSD}integer>')), _fact(col, HYDRA + "view", view),
        *([_fact(view, HYDRA + "previous", address(str(number - 1)))] if number > 1 else []), _fact(view, HYDRA + "next", F.when(F.col("n") > number * size, address(str(number + 1)))),
        _fact(view, HYDRA + "first", address("1")), _fact(view, HYDRA + "last", address(last)),
    ])
    return head.unionByName(_quads(page(members, order, number, size), graph, [_fact(col, HYDRA + "member", member)]).distinct())
