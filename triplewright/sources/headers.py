"""What graphs say of themselves: the header's node, its roles, annotations, version and namespace, for all graphs in one pass.

`catalogue` holds a row per graph, (g, iri): the IRI by which the ontology is known. Quads may repeat; those without a subject or
object state nothing. Where several values are as good as each other, the smallest term is taken, so that results don't depend
on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triplewright.functions import terms as T

OWL, RDF, RDFS, SKOS = "http://www.w3.org/2002/07/owl#", "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2004/02/skos/core#"
DCT, DC, MOD, VANN, SCHEMA = "http://purl.org/dc/terms/", "http://purl.org/dc/elements/1.1/", "https://w3id.org/mod#", "http://purl.org/vocab/vann/", "https://schema.org/"

#: Roles of header metadata and their properties in order of preference.
ROLES = {
    "title": [DCT + "title", RDFS + "label", DC + "title"],
    "shortname": [DCT + "alternative", OWL + "acronym"],
    "description": [DCT + "description", RDFS + "comment", DC + "description"],
    "creator": [DCT + "creator", DC + "creator", "http://purl.org/pav/authoredBy"],
    "contributor": [DCT + "contributor"],
    "publisher": [DCT + "publisher"],
    "license": [DCT + "license", DCT + "rights"],
    "homepage": ["http://xmlns.com/foaf/0.1/homepage", "http://www.w3.org/ns/dcat#accessURL", SCHEMA + "includedInDataCatalog"],
    "version_info": [OWL + "versionInfo"],
    "prefix": [VANN + "preferredNamespacePrefix"],
    "namespace_uri": [VANN + "preferredNamespaceUri"],
    "created": [DCT + "created", DCT + "issued"],
    "modified": [DCT + "modified"],
    "language": [DCT + "language"],
    "citation": [DCT + "bibliographicCitation"],
    "funding": [SCHEMA + "funding"],
    "status": [MOD + "status"],
    "syntax": [MOD + "hasSyntax", MOD + "hasRepresentationLanguage"],
    "version_iri": [OWL + "versionIRI"],
    "see_also": [RDFS + "seeAlso"],
    "is_defined_by": [RDFS + "isDefinedBy"],
    "competency_question": [MOD + "competencyQuestion"],
    "endorsed_by": [MOD + "endorsedBy"],
    "relies_on": [MOD + "reliesOn"],
    "similar": [MOD + "similar"],
    "generalizes": [MOD + "generalizes"],
    "specializes": [MOD + "specializes"],
    "known_usage": [MOD + "knownUsage"],
    "used_in_project": [MOD + "usedInProject"],
}
#: Roles that keep every value.
MULTIPLE = ("creator", "contributor", "publisher", "see_also", "competency_question", "endorsed_by", "relies_on", "similar", "generalizes", "specializes", "known_usage", "used_in_project")
#: Annotations of a record and their properties in order of preference; rights stand in where no license is stated.
ANNOTATIONS = {
    "title": [DCT + "title", DC + "title", SKOS + "prefLabel", RDFS + "label"],
    "description": [DCT + "description", DC + "description", RDFS + "comment"],
    "license": [DCT + "license", DC + "license", "http://creativecommons.org/ns#license", "http://schema.org/license", SCHEMA + "license", "http://www.w3.org/1999/xhtml/vocab#license"],
    "rights": [DCT + "rights", DC + "rights"],
    "preferred_prefix": [VANN + "preferredNamespacePrefix"],
    "creators": [DCT + "creator", DC + "creator"],
}
CREATORS = 20  # creators that a record names
_TYPE, _ONTOLOGY = f"<{RDF}type>", f"<{OWL}Ontology>"


def value(term: Column) -> Column:
    """The text of a term; a blank node gives its label."""
    return F.when(T.is_blank(term), term.substr(F.lit(3), F.length(term))).otherwise(T.lexical(term))


def _places(table: dict[str, list[str]]) -> Column:
    """Predicate -> array of (role, rank): a property may serve several roles."""
    uses: dict[str, list[Column]] = {}
    for role, properties in table.items():
        for rank, p in enumerate(properties):
            uses.setdefault(f"<{p}>", []).append(F.struct(F.lit(role).alias("role"), F.lit(rank).alias("rank")))
    return F.create_map(*(x for p, places in uses.items() for x in (F.lit(p), F.array(*places))))


def _known(table: dict[str, list[str]]) -> list[str]:
    return sorted({f"<{p}>" for properties in table.values() for p in properties})


def variants(iri: Column) -> Column:
    """An http(s) IRI and itself without its last slash or hash, or with either; other texts have none."""
    bare = iri.substr(F.lit(1), F.length(iri) - 1)
    ends = iri.endswith("/") | iri.endswith("#")
    return F.when(F.regexp_like(iri, F.lit("^https?://")), F.when(ends, F.array(iri, bare)).otherwise(F.array(iri, F.concat(iri, F.lit("/")), F.concat(iri, F.lit("#"))))).otherwise(F.array().cast("array<string>"))


def header_subjects(quads: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(g, s, rule): the nodes that are each ontology's own header, never an imported one's.

    'variant': variants of the catalogued IRI that are typed owl:Ontology; else 'root': the one such node that nothing in the
    graph imports, if there is one only; else 'catalogued': the IRI's variants, or the IRI itself where it isn't http. A graph
    whose one root is a blank node gives no row (header_roles reads those), nor does an empty or null IRI without a root.
    """
    s, p, o = F.col("s"), F.col("p"), F.col("o")
    typed = (p == _TYPE) & (o == _ONTOLOGY)
    said = quads.where(typed | (p == f"<{OWL}imports>")).select("g", F.when(typed, s).otherwise(o).alias("s"), typed.alias("head"), (~typed).alias("imported"), F.lit(False).alias("spelled"))
    iri = F.col("iri")
    spellings = F.when(F.regexp_like(iri, F.lit("^https?://")), variants(iri)).when(iri != "", F.array(iri))
    known = catalogue.select("g", F.explode_outer(spellings).alias("v")).select("g", T.iri(F.col("v")).alias("s"), F.lit(False).alias("head"), F.lit(False).alias("imported"), F.lit(True).alias("spelled"))
    nodes = said.unionByName(known).groupBy("g", "s").agg(*(F.bool_or(c).alias(c) for c in ("head", "imported", "spelled")))
    root = F.col("head") & ~F.col("imported")
    graphs = nodes.groupBy("g").agg(
        F.bool_or("spelled").alias("known"), F.count_if(root).alias("n"), F.min(F.when(root, s)).alias("root"),
        F.collect_list(F.when(F.col("spelled") & s.isNotNull(), F.struct("s", "head"))).alias("spelled"),  # three for each catalogued IRI
    ).where("known")
    hits = F.filter("spelled", lambda x: x["head"])
    rule = F.when(F.size(hits) > 0, "variant").when(F.col("n") == 1, "root").otherwise("catalogued")
    chosen = F.when(F.size(hits) > 0, hits["s"]).when(F.col("n") == 1, F.array("root")).otherwise(F.col("spelled")["s"])
    return graphs.select("g", F.explode(chosen).alias("s"), rule.alias("rule")).where(s.startswith("<"))


def annotations(quads: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(g, title, description, license, creators, preferred_prefix) for every catalogued graph, null or empty where nothing is stated.

    A scalar is the value of the first property that has one. Creators are the first CREATORS distinct terms by property and
    term: only these are ever gathered.
    """
    stated = quads.where(F.col("p").isin(_known(ANNOTATIONS)) & F.col("o").isNotNull()).join(header_subjects(quads, catalogue).select("g", "s"), ["g", "s"], "left_semi")
    placed = stated.select("g", "o", F.explode(F.element_at(_places(ANNOTATIONS), F.col("p"))).alias("x")).select("g", "o", "x.role", "x.rank")
    ranked = placed.groupBy("g", "role", "o").agg(F.min("rank").alias("rank"))
    ranked = ranked.withColumn("at", F.row_number().over(W.partitionBy("g", "role").orderBy("rank", "o"))).where(F.col("at") <= CREATORS)
    first = lambda role: F.max(F.when((F.col("role") == role) & (F.col("at") == 1), value(F.col("o"))))
    creators = F.array_sort(F.collect_list(F.when(F.col("role") == "creators", F.struct("at", "o"))))
    stated = ranked.groupBy("g").agg(
        first("title").alias("title"), first("description").alias("description"), F.coalesce(first("license"), first("rights")).alias("license"), first("preferred_prefix").alias("preferred_prefix"), creators.alias("creators"))
    out = catalogue.select("g").distinct().join(stated, "g", "left")
    return out.select("g", "title", "description", "license", F.coalesce(F.transform("creators", lambda x: value(x["o"])), F.array().cast("array<string>")).alias("creators"), "preferred_prefix")


def header_quads(quads: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(g, p, o) of the catalogued IRIs; a graph where those give no title adds what its blank owl:Ontology nodes say."""
    known = catalogue.select("g", T.iri(F.col("iri")).alias("s"), F.lit(True).alias("spelled"))
    blank = quads.where((F.col("p") == _TYPE) & (F.col("o") == _ONTOLOGY) & F.col("s").startswith("_:")).select("g", "s", F.lit(False).alias("spelled")).join(catalogue.select("g"), "g", "left_semi")
    nodes = known.unionByName(blank).where("s is not null").distinct()
    found = quads.where("o is not null").join(nodes, ["g", "s"])
    title = F.col("spelled") & F.col("p").isin(*(f"<{p}>" for p in ROLES["title"]))
    found = found.withColumn("titled", F.bool_or(title).over(W.partitionBy("g")))
    return found.where("spelled or not titled").select("g", "p", "o").distinct()


def header_roles(quads: DataFrame, catalogue: DataFrame, roles: dict[str, list[str]] = ROLES, multiple=MULTIPLE) -> DataFrame:
    """(g, role, position, value) from 1: every distinct value of the roles in `multiple`, by property and term; of the others
    the first property's, where a value tagged en comes before the rest. Roles without a value have no row."""
    found = header_quads(quads, catalogue).where(F.col("p").isin(_known(roles)))
    placed = found.select("g", "o", value(F.col("o")).alias("value"), F.explode(F.element_at(_places(roles), F.col("p"))).alias("x")).select("g", "o", "value", "x.role", "x.rank")
    many = F.col("role").isin(*multiple)
    tagged = F.when(many | (T.lang(F.col("o")) == "en"), 0).otherwise(1).alias("tagged")
    each = placed.groupBy("g", "role", "value").agg(F.min(F.struct("rank", tagged, "o")).alias("at"))
    each = each.withColumn("position", F.row_number().over(W.partitionBy("g", "role").orderBy("at")))
    return each.where(many | (F.col("position") == 1)).select("g", "role", "position", "value")


def header_candidates(quads: DataFrame, catalogue: DataFrame, roles: dict[str, list[str]] = ROLES) -> DataFrame:
    """(g, role, property, value, language, is_iri, label): all that a header states, under each role its property serves or
    'unknown'. The label is the property's in the same graph, untagged or English, the smallest."""
    found = header_quads(quads, catalogue)
    names = quads.where((F.col("p") == f"<{RDFS}label>") & T.lang(F.col("o")).isin("", "en")).groupBy("g", F.col("s").alias("p")).agg(T.lexical(F.min("o")).alias("label"))
    found = found.join(names, ["g", "p"], "left")
    places = F.coalesce(F.transform(F.element_at(_places(roles), F.col("p")), lambda x: x["role"]), F.array(F.lit("unknown")))
    return found.select("g", F.explode(places).alias("role"), T.lexical(F.col("p")).alias("property"), value(F.col("o")).alias("value"), F.nullif(T.lang(F.col("o")), F.lit("")).alias("language"), T.is_iri(F.col("o")).alias("is_iri"), "label")


def version_iris(quads: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(g, version_iri): the catalogued node's owl:versionIRI; any node's in graphs whose IRI is null or empty."""
    stated = quads.where(F.col("p") == f"<{OWL}versionIRI>").select("g", "s", "o")
    named = F.col("iri").isNotNull() & (F.col("iri") != "")
    found = stated.join(catalogue.select("g", "iri").distinct(), "g").where(~named | (F.col("s") == T.iri(F.col("iri"))))
    return found.groupBy("g").agg(value(F.min("o")).alias("version_iri"))


def preferred_namespaces(quads: DataFrame) -> DataFrame:
    """(g, namespace): what an owl:Ontology node declares as its preferred namespace, IRI or text, if it is an http(s) address."""
    stated = F.col("p") == f"<{VANN}preferredNamespaceUri>"
    text = F.trim(value(F.col("o")))
    nodes = quads.where(stated | (F.col("p") == _TYPE) & (F.col("o") == _ONTOLOGY)).groupBy("g", "s").agg(
        F.bool_or(~stated).alias("head"), F.min(F.when(stated & F.regexp_like(text, F.lit("^https?://")), text)).alias("namespace"))
    return nodes.where("head and namespace is not null").groupBy("g").agg(F.min("namespace").alias("namespace"))
