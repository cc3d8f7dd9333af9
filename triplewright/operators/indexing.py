"""From quads to the entity index: types, labels, synonyms, definitions, flags, roles."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplewright.functions import terms as T
from triplewright.functions import text as X

OWL, RDF, RDFS, SKOS = "http://www.w3.org/2002/07/owl#", "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2004/02/skos/core#"
#: Types in order of priority.
TYPES = (
    (OWL + "Class", "class"), (OWL + "ObjectProperty", "object_property"), (OWL + "DatatypeProperty", "datatype_property"), (OWL + "AnnotationProperty", "annotation_property"),
    (RDFS + "Class", "class"), (RDF + "Property", "object_property"), (SKOS + "Concept", "concept"), (OWL + "NamedIndividual", "individual"),
)
DCTERMS, OBO_IN_OWL = "http://purl.org/dc/terms/", "http://www.geneontology.org/formats/oboInOwl#"
#: Properties of labels, definitions and synonyms in order of preference.
LABELS = (RDFS + "label", SKOS + "prefLabel", DCTERMS + "title", "http://purl.org/dc/elements/1.1/title", "https://schema.org/name")
DEFINITIONS = ("http://purl.obolibrary.org/obo/IAO_0000115", SKOS + "definition", RDFS + "comment", DCTERMS + "description")
SYNONYMS = (SKOS + "altLabel", OBO_IN_OWL + "hasExactSynonym", OBO_IN_OWL + "hasRelatedSynonym", OBO_IN_OWL + "hasBroadSynonym", OBO_IN_OWL + "hasNarrowSynonym")
TYPE = f"<{RDF}type>"


def _ranked(spark, values, kind: str):
    return F.broadcast(spark.createDataFrame([(f"<{v}>", i) for i, v in enumerate(values)], f"{kind} string, rank int"))  # a constant table


def entity_types(quads: DataFrame) -> DataFrame:
    """(g, s, type, is_individual): the type of highest priority of each IRI subject."""
    spark = quads.sparkSession
    table = F.broadcast(spark.createDataFrame([(f"<{iri}>", t, i) for i, (iri, t) in enumerate(TYPES)], "o string, type string, rank int"))  # a constant table
    typed = quads.where((F.col("p") == TYPE) & F.col("s").startswith("<")).join(table, "o")
    return typed.groupBy("g", "s").agg(F.min_by("type", "rank").alias("type"), F.bool_or(F.col("o") == f"<{OWL}NamedIndividual>").alias("is_individual"))


#: Vocabularies whose classes make no individuals.
VOCABULARIES = (OWL, RDF, RDFS, SKOS, "http://xmlns.com/foaf/0.1/", "http://purl.org/vocab/vann/")


def _own_class(o):
    """Whether a type is a class outside the vocabularies."""
    return o.startswith("<") & ~F.regexp_like(o, F.lit("^<(" + "|".join(re.escape(v) for v in VOCABULARIES) + ")"))


def individuals_fallback(quads: DataFrame, types: DataFrame) -> DataFrame:
    """Subjects typed by a class outside the vocabularies, in graphs where no entity is declared."""
    empty = quads.select("g").distinct().join(types.select("g").distinct(), "g", "left_anti")
    other = quads.where((F.col("p") == TYPE) & F.col("s").startswith("<") & _own_class(F.col("o")))
    return other.join(empty, "g", "left_semi").select("g", "s", F.lit("individual").alias("type"), F.lit(True).alias("is_individual")).distinct()


def individual_types(quads: DataFrame) -> DataFrame:
    """(g, s, types) of declared individuals, without the declaration itself."""
    declared = quads.where((F.col("p") == TYPE) & (F.col("o") == f"<{OWL}NamedIndividual>")).select("g", "s").distinct()
    rest = quads.where((F.col("p") == TYPE) & (F.col("o") != f"<{OWL}NamedIndividual>") & F.col("o").startswith("<"))
    return rest.join(declared, ["g", "s"], "left_semi").groupBy("g", "s").agg(F.array_sort(F.collect_set(T.lexical(F.col("o")))).alias("types"))


def deprecated(quads: DataFrame) -> DataFrame:
    return quads.where((F.col("p") == f"<{OWL}deprecated>") & (F.col("o") == f'"true"^^<{T.XSD}boolean>')).select("g", "s").distinct()


def _base(tag):
    """The language of a tag without its region, in lower case."""
    return F.split_part(F.lower(tag), F.lit("-"), F.lit(1))


def _first_of(entries, key):
    """Sorted entries without those whose key an earlier one has."""
    return F.filter(entries, lambda x, i: ~F.exists(F.slice(entries, 1, i), lambda y: key(x) == key(y)))


def entity_index(quads: DataFrame, labels=LABELS, synonyms=SYNONYMS, definitions=DEFINITIONS) -> DataFrame:
    """The index: a row per (version_id, iri). Deprecated entities are left out; version_id is the graph.

    Quads are read once and meet in one shuffle by (graph, subject). Labels are taken in order of property, value and tag, each (value, language) once;
    synonyms and definitions each value once.
    """
    spaces = {f"<{p}>": (i, at) for i, properties in enumerate((labels, synonyms, definitions)) for at, p in enumerate(properties)}
    role = F.create_map(*(x for p, (i, at) in spaces.items() for x in (F.lit(p), F.struct(F.lit(i).alias("role"), F.lit(at).alias("rank")))))
    kinds = F.create_map(*(x for i, (t, name) in enumerate(TYPES) for x in (F.lit(f"<{t}>"), F.struct(F.lit(i).alias("rank"), F.lit(name).alias("type")))))
    s, p, o = F.col("s"), F.col("p"), F.col("o")
    ups = [f"<{RDFS}subClassOf>", f"<{RDFS}subPropertyOf>"]
    read = quads.where(s.startswith("<") & p.isin(TYPE, f"<{OWL}deprecated>", *ups, *spaces))
    read = read.select("g", "s", "p", "o", F.element_at(role, p).alias("r"), F.when(p == TYPE, F.element_at(kinds, o)).alias("k"))

    def texts(i: int):
        entry = F.struct(F.col("r.rank").alias("rank"), T.lexical(o).alias("value"), T.lang(o).alias("lang"))
        return F.array_sort(F.collect_set(F.when((F.col("r.role") == i) & o.startswith('"'), entry)))

    found = read.groupBy("g", "s").agg(
        F.min("k").alias("k"), F.bool_or((p == TYPE) & (o == f"<{OWL}NamedIndividual>")).alias("named"), F.bool_or((p == TYPE) & _own_class(o)).alias("own"),
        F.bool_or((p == f"<{OWL}deprecated>") & (o == f'"true"^^<{T.XSD}boolean>')).alias("deprecated"), F.bool_or(p.isin(*ups) & o.startswith("<") & (o != f"<{OWL}Thing>")).alias("child"),
        *(texts(i).alias(name) for i, name in enumerate(("labelled", "synonymous", "defined"))),
    )
    declared = found.where("k is not null").select("g", "s", F.col("k.type").alias("type"), F.col("named").alias("is_individual"), "deprecated", "child", "labelled", "synonymous", "defined")
    none = found.groupBy("g").agg(F.count("k").alias("n")).where("n = 0").select("g")  # a row for each graph that declares nothing
    others = found.where("own").join(none, "g", "left_semi").select("g", "s", F.lit("individual").alias("type"), F.lit(True).alias("is_individual"), "deprecated", "child", "labelled", "synonymous", "defined")
    out = declared.unionByName(others).where("not deprecated")
    iri, labelled, synonymous, defined = T.lexical(s), F.col("labelled"), F.col("synonymous"), F.col("defined")
    labelled = _first_of(labelled, lambda x: F.struct(x["value"], _base(x["lang"])))
    english = F.try_element_at(F.filter(labelled, lambda x: x.lang == "en"), F.lit(1))
    short = X.local_name(iri)
    values = lambda c: F.transform(c, lambda x: x["value"])
    by_language = F.map_from_entries(F.transform(F.array_distinct(F.transform(labelled, lambda x: _base(x["lang"]))), lambda t: F.struct(t, F.element_at(F.filter(labelled, lambda x: _base(x["lang"]) == t), -1)["value"])))
    out = out.select(
        F.col("g").alias("version_id"), iri.alias("iri"), "type", "is_individual", (~F.col("child")).alias("is_root"), short.alias("short"),
        F.coalesce(english["value"], F.try_element_at(labelled, F.lit(1))["value"], X.humanise(short)).alias("label"), by_language.alias("labels"),
        F.array_except(F.array_distinct(values(synonymous)), values(labelled)).alias("synonyms"), F.coalesce(F.try_element_at(defined, F.lit(1))["value"], F.lit("")).alias("definition"),
    )
    return out.withColumn("norm", X.normalise_label(F.col("label"))).withColumn("search_text", X.search_text(F.col("label"), F.col("short"), F.map_values("labels"), F.col("synonyms")))


def language_counts(quads: DataFrame, properties) -> DataFrame:
    """Literals per raw tag of label, synonym and definition properties."""
    return quads.where(F.col("o").startswith('"') & F.col("p").isin(*(f"<{p}>" for p in properties))).groupBy("g", T.lang(F.col("o")).alias("lang")).agg(F.count("*").alias("n"))


def role_properties(quads: DataFrame, registry: list[str]) -> DataFrame:
    """Registered properties by how many distinct classes use them, most first, registry order among equals."""
    classes = quads.where((F.col("p") == TYPE) & (F.col("o") == f"<{OWL}Class>")).select("g", "s").distinct()
    used = quads.join(_ranked(quads.sparkSession, registry, "p"), "p").join(classes, ["g", "s"], "left_semi")
    return used.groupBy("g", "p", "rank").agg(F.count_distinct("s").alias("n")).orderBy("g", F.desc("n"), "rank")


def unknown_properties(quads: DataFrame, registry: list[str], share: float = 0.05) -> DataFrame:
    """Literal-valued properties outside the registry on more than max(1, share of the classes) classes, with the percentage."""
    classes = quads.where((F.col("p") == TYPE) & (F.col("o") == f"<{OWL}Class>")).select("g", "s").distinct()
    totals = classes.groupBy("g").agg(F.count("*").alias("classes"))
    used = quads.where(F.col("o").startswith('"') & ~F.col("p").isin(*(f"<{p}>" for p in registry))).join(classes, ["g", "s"], "left_semi")
    counts = used.groupBy("g", "p").agg(F.count_distinct("s").alias("n")).join(totals, "g")
    return counts.where(F.col("n") > F.greatest(F.lit(1), F.floor(F.lit(share) * F.col("classes")))).select("g", "p", "n", F.round(100 * F.col("n") / F.col("classes"), 2).alias("pct"))
