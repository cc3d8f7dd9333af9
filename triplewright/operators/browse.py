"""Browsing: pages of roots, terms and individuals, trees, routing of searches, catalogue search, fillers, repairs, profiles."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triplewright.functions import terms as T
from triplewright.operators import axioms, hierarchy
from triplewright.operators.search import normalise

OWL, RDF, RDFS = axioms.OWL, axioms.RDF, axioms.RDFS


def page(entities: DataFrame, limit: int, offset: int = 0, types: list[str] | None = None, hide_obsolete: bool = False) -> DataFrame:
    """A page by lower label and IRI."""
    if types:
        entities = entities.where(F.col("type").isin(types))
    if hide_obsolete:
        entities = entities.where(~F.coalesce("deprecated", F.lit(False)))
    return entities.orderBy(F.lower(F.coalesce("label", "iri")), "iri").offset(offset).limit(limit)


def root_cache(entities: DataFrame, edges: DataFrame, each: int = 100) -> DataFrame:
    """The first roots of each version and type, with has_children."""
    w = W.partitionBy("version_id", "type").orderBy(F.lower("label"), "iri")
    top = hierarchy.roots(entities, edges).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= each)
    return top.select("version_id", "type", "iri", "rank", "has_children")


def inferred_roots(roots: DataFrame, unsatisfiable: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Roots in order; owl:Nothing comes first if anything is unsatisfiable."""
    nothing = unsatisfiable.limit(1).select(F.lit(hierarchy.NOTHING).alias("iri"), F.lit("owl:Nothing").alias("label"), F.lit(0).alias("first"))
    both = roots.select("iri", "label", F.lit(1).alias("first")).unionByName(nothing)
    return both.orderBy("first", F.lower("label"), "iri").offset(offset).limit(limit).select("iri", "label")


def inverse_targets_hidden(entities: DataFrame, quads: DataFrame) -> DataFrame:
    """Entities without the properties that something states as its inverse."""
    hidden = quads.where(F.col("p") == f"<{OWL}inverseOf>").where("startswith(o, '<')").select(T.lexical(F.col("o")).alias("iri")).distinct()
    return entities.join(hidden, "iri", "left_anti")


def with_fallback(inferred: DataFrame, asserted: DataFrame) -> DataFrame:
    """Inferred rows, or the asserted ones if there are none; decided within the plan."""
    none = inferred.limit(1).agg(F.count("*").alias("_n")).where("_n = 0")
    return inferred.unionByName(asserted.crossJoin(F.broadcast(none)).drop("_n"))  # one row


def tree_to(entities: DataFrame, edges: DataFrame, iri: str) -> DataFrame:
    """Nodes (iri, parent, label) of the paths from the roots to an entity, and the siblings along them."""
    up = edges.sparkSession.createDataFrame([(iri,)], "child string")
    above = hierarchy.reachable(edges, "child", "parent", up).select(F.col("parent").alias("parent")).distinct()
    shown = edges.join(above, "parent", "left_semi").select(F.col("child").alias("iri"), "parent").distinct()
    return shown.join(entities.select("iri", "label"), "iri", "left").select("iri", "parent", "label")


def neighbourhood(edges: DataFrame, iri: str) -> DataFrame:
    """Edges that touch an entity."""
    return edges.where((F.col("child") == iri) | (F.col("parent") == iri)).select("child", "parent").distinct()


def route(query: str) -> str:
    """Which search a query goes to: an address looks up an entity, what reads as a class expression is evaluated, the rest is searched."""
    from triplewright.plans import mos

    text = query.strip()
    if re.match(r"https?://\S+$", text):
        return "entity"
    try:
        return "expression" if not isinstance(mos.parse(text), mos.Named) else "semantic" if len(text) >= 3 else "keyword"
    except mos.ParseError:
        return "semantic" if len(text) >= 3 else "keyword"


def catalogue_search(catalogue: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Rows whose shortname, IRI, title or description holds the query, in tiers 0 to 4: exact shortname, its beginning, title's beginning, title or shortname, the rest."""
    q = query.strip().lower()
    low = {c: F.lower(F.coalesce(c, F.lit(""))) for c in ("shortname", "iri", "title", "description")}
    tier = F.when(low["shortname"] == q, 0).when(low["shortname"].startswith(q), 1).when(low["title"].startswith(q), 2).when(low["title"].contains(q) | low["shortname"].contains(q), 3).otherwise(4)
    hit = low["shortname"].contains(q) | low["iri"].contains(q) | low["title"].contains(q) | low["description"].contains(q)
    return catalogue.where(hit).withColumn("tier", tier).orderBy("tier", F.col("title").asc_nulls_last(), "iri").limit(limit)


def per_version_hits(entities: DataFrame, query: str, each: int = 5) -> DataFrame:
    """The best few hits of each version."""
    q = normalise(query)
    w = W.partitionBy("version_id").orderBy(F.when(F.col("norm") == q, 0).otherwise(1), F.length("label"), "label", "iri")
    return entities.where(F.col("norm").startswith(q)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= each).select("version_id", "iri", "label", "rank")


def observed_fillers(quads: DataFrame, prop: str, limit: int = 20) -> DataFrame:
    """Fillers of a property and its sub-properties by how many restrictions hold them."""
    subs = hierarchy.reachable(quads.where(F.col("p") == f"<{RDFS}subPropertyOf>").select(F.col("o").alias("parent"), F.col("s").alias("child")), "parent", "child", quads.sparkSession.createDataFrame([(f"<{prop}>",)], "parent string"))
    props = subs.select(F.col("child").alias("prop")).unionByName(quads.sparkSession.createDataFrame([(f"<{prop}>",)], "prop string")).distinct()
    return axioms.restrictions(quads).join(props, "prop", "left_semi").groupBy("filler").agg(F.count_distinct("g", "node").alias("n")).orderBy(F.desc("n"), "filler").limit(limit)


def uniquified(names: DataFrame, key: str = "id", name: str = "shortname") -> DataFrame:
    """Names that repeat get -2, -3 and so on in order of the key."""
    n = F.row_number().over(W.partitionBy(name).orderBy(key))
    return names.withColumn(name, F.when(n > 1, F.concat(F.substring(name, 1, 60), F.lit("-"), n.cast("string"))).otherwise(F.col(name)))


def merged_identities(rows: DataFrame, key: Column, id: str = "id", created: str = "created_at") -> DataFrame:
    """(id, keeper): rows of one identity belong to the one created first."""
    keyed = rows.select(id, created, key.alias("_key"))
    first = keyed.groupBy("_key").agg(F.min_by(id, F.struct(created, id)).alias("keeper"))
    return keyed.join(first, "_key").select(id, "keeper")


def source_of(entities: DataFrame, imports: DataFrame, host_tokens: list[str]) -> DataFrame:
    """entities with `source`: the import whose base begins the IRI (the longest), nothing for the host's own, else the prefix."""
    from triplewright.operators.catalogue import with_prefix

    found = with_prefix(entities, "iri", imports.select(F.col("base").alias("namespace"), F.col("name").alias("prefix")))
    own = F.col("prefix").isin(host_tokens)
    return found.withColumn("source", F.when(own, F.lit("")).otherwise(F.col("prefix"))).drop("prefix")


def pick_texts(quads: DataFrame, properties: list[str]) -> DataFrame:
    """(g, s, value): of the first property with values in English or untagged, the longest (of equals the smallest)."""
    table = F.broadcast(quads.sparkSession.createDataFrame([(f"<{p}>", i) for i, p in enumerate(properties)], "p string, rank int"))  # as long as the caller's list
    found = quads.join(table, "p").where(F.col("o").startswith('"') & T.lang(F.col("o")).isin("", "en"))
    value = T.lexical(F.col("o"))
    return found.groupBy("g", "s").agg(F.min(F.struct("rank", (-F.length(value)).alias("n"), value.alias("value")))["value"].alias("value"))


def term_record(quads: DataFrame, iri: str) -> DataFrame:
    """(predicate, values) of a term, values ordered; blank objects are left out."""
    own = quads.where((F.col("s") == f"<{iri}>") & ~F.col("o").startswith("_:")).select(T.lexical(F.col("p")).alias("predicate"), T.lexical(F.col("o")).alias("v")).distinct()
    return own.groupBy("predicate").agg(F.array_join(F.array_sort(F.collect_list("v")), "|").alias("values"))


def inherited(quads: DataFrame, edges: DataFrame, iri: str) -> DataFrame:
    """(ancestor, node) of the anonymous superclasses of a class's ancestors."""
    up = hierarchy.reachable(edges, "child", "parent", edges.sparkSession.createDataFrame([(iri,)], "child string")).select(T.iri(F.col("parent")).alias("cls")).distinct()
    return axioms.asserters(quads).where("startswith(node, '_:') and src = 'sub'").join(up, "cls", "left_semi").select(F.col("cls").alias("ancestor"), "node")


def input_repairs(quads: DataFrame) -> DataFrame:
    """Quads as a reasoner takes them: one ontology header type per graph, classes that are used declared, reserved predicates dropped, properties of two kinds kept as object properties."""
    typ = F.col("p") == f"<{RDF}type>"
    heads = quads.where(typ & (F.col("o") == f"<{OWL}Ontology>"))
    extra = heads.join(heads.groupBy("g").agg(F.min("s").alias("first")), "g").where("s <> first").select("g", "s", "p", "o")
    reserved = quads.where(F.col("p").startswith(f"<{OWL}") & F.col("p").isin(f"<{OWL}Class>", f"<{OWL}Ontology>", f"<{OWL}Thing>")).select("g", "s", "p", "o")
    obj = quads.where(typ & (F.col("o") == f"<{OWL}ObjectProperty>")).select("g", "s")
    puns = quads.where(typ & (F.col("o") == f"<{OWL}DatatypeProperty>")).join(obj, ["g", "s"], "left_semi").select("g", "s", "p", "o")
    used = quads.where((F.col("p") == f"<{RDFS}subClassOf>")).select("g", F.explode(F.array("s", "o")).alias("s")).where("startswith(s, '<')").distinct()
    declared = quads.where(typ & (F.col("o") == f"<{OWL}Class>")).select("g", "s")
    added = used.join(declared, ["g", "s"], "left_anti").select("g", "s", F.lit(f"<{RDF}type>").alias("p"), F.lit(f"<{OWL}Class>").alias("o"))
    out = quads.select("g", "s", "p", "o")
    for bad in (extra, reserved, puns):
        out = out.join(bad, ["g", "s", "p", "o"], "left_anti")
    return out.unionByName(added)


#: Constructs that an OWL 2 profile does not allow.
PROFILE_BARRED = {
    "EL": ("allValuesFrom", "unionOf", "complementOf", "maxCardinality", "minCardinality", "cardinality", "maxQualifiedCardinality", "minQualifiedCardinality", "qualifiedCardinality", "inverseOf", "FunctionalProperty", "InverseFunctionalProperty", "SymmetricProperty", "AsymmetricProperty"),
    "QL": ("allValuesFrom", "unionOf", "oneOf", "hasValue", "maxCardinality", "minCardinality", "cardinality", "maxQualifiedCardinality", "minQualifiedCardinality", "qualifiedCardinality", "TransitiveProperty", "FunctionalProperty", "sameAs", "propertyChainAxiom", "hasKey"),
    "RL": ("hasSelf", "minCardinality", "cardinality", "minQualifiedCardinality", "qualifiedCardinality", "disjointUnionOf", "ReflexiveProperty"),
}


def owl_profiles(quads: DataFrame, by: str = "g") -> DataFrame:
    """(by, profile, conforms, violations) by the constructs used; a subset of the profiles' rules."""
    barred = F.broadcast(quads.sparkSession.createDataFrame([(p, f"<{OWL}{c}>") for p, cs in PROFILE_BARRED.items() for c in cs], "profile string, construct string"))  # a constant table
    construct = F.when(F.col("p") == f"<{RDF}type>", F.col("o")).otherwise(F.col("p"))
    hits = quads.select(by, construct.alias("construct")).join(barred, "construct").groupBy(by, "profile").agg(F.count("*").alias("violations"))
    every = quads.select(by).distinct().crossJoin(barred.select("profile").distinct())  # three rows
    return every.join(hits, [by, "profile"], "left").select(by, "profile", F.col("violations").isNull().alias("conforms"), F.coalesce("violations", F.lit(0)).alias("violations"))


def mapping_counts(quads: DataFrame, prefixes: DataFrame, predicates) -> DataFrame:
    """(p, prefix, n) of mapping triples per predicate and prefix of the target."""
    from triplewright.operators.catalogue import with_prefix

    found = quads.where(F.col("p").isin(*(f"<{p}>" for p in predicates))).select("p", T.lexical(F.col("o")).alias("target"))
    return with_prefix(found, "target", prefixes).groupBy("p", "prefix").agg(F.count("*").alias("n"))


def snapshot(history: DataFrame, today: DataFrame, day: str = "day") -> DataFrame:
    """History with the row of each of today's days replaced."""
    return history.join(today.select(day), day, "left_anti").unionByName(today.select(*history.columns))
