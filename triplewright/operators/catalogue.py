"""Catalogue analytics: counts, coverage, languages, licenses, reuse, profiles, FAIR scores, stages."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OWL, RDF, RDFS = "http://www.w3.org/2002/07/owl#", "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
TYPES = {"classes": ("Class",), "object_properties": ("ObjectProperty",), "data_properties": ("DatatypeProperty",), "annotation_properties": ("AnnotationProperty",), "individuals": ("NamedIndividual",)}


def _typed_subjects(quads: DataFrame, kinds: dict[str, tuple], by: str) -> DataFrame:
    """Distinct subjects per kind: declarations alone are made distinct, one row for each subject and type, then counted."""
    of = F.create_map(*(x for name, iris in kinds.items() for i in iris for x in (F.lit(f"<{i}>"), F.lit(name))))
    declared = quads.where(F.col("p") == f"<{RDF}type>").select(by, "s", F.element_at(of, F.col("o")).alias("kind")).where("kind is not null").distinct()
    return declared.groupBy(by).agg(*(F.count_if(F.col("kind") == name).alias(name) for name in kinds))


def graph_counts(quads: DataFrame, by: str = "g") -> DataFrame:
    """Triples and distinct IRI subjects per OWL type."""
    kinds = _typed_subjects(quads.where(F.col("s").startswith("<")), {name: tuple(OWL + t for t in names) for name, names in TYPES.items()}, by)
    totals = quads.groupBy(by).agg(F.count("*").alias("triples"))
    return totals.join(kinds, by, "left").select(by, "triples", *(F.coalesce(name, F.lit(0)).alias(name) for name in TYPES))


def void(quads: DataFrame, by: str = "g") -> DataFrame:
    """VoID statistics: triples, classes, properties, individuals, distinct subjects, distinct objects that are no literals."""
    names = {"classes": (OWL + "Class", RDFS + "Class"), "properties": (OWL + "ObjectProperty", OWL + "DatatypeProperty", OWL + "AnnotationProperty", RDF + "Property"), "individuals": (OWL + "NamedIndividual",)}
    totals = quads.groupBy(by).agg(F.count("*").alias("triples"))
    # subjects and objects as one column of marked terms, made distinct in one shuffle
    ends = F.array_compact(F.array(F.struct(F.lit(True).alias("subject"), F.col("s").alias("term")), F.when(~F.col("o").startswith('"'), F.struct(F.lit(False).alias("subject"), F.col("o").alias("term")))))
    terms = quads.select(by, F.explode(ends).alias("e")).select(by, "e.*").distinct().groupBy(by).agg(F.count_if("subject").alias("distinct_subjects"), F.count_if(~F.col("subject")).alias("distinct_objects"))
    out = totals.join(_typed_subjects(quads, names, by), by, "left").join(terms, by, "left")
    return out.select(by, "triples", *(F.coalesce(name, F.lit(0)).alias(name) for name in (*names, "distinct_subjects", "distinct_objects")))


def coverage(entities: DataFrame, by: tuple = ("version_id", "type")) -> DataFrame:
    """Totals with label, with definition, multilingual (two tags or more, "" counting), and the same of native entities (no source).

    entities: labels (map tag -> label), definition, source.
    """
    native = F.coalesce("source", F.lit("")) == ""
    label, definition = F.coalesce(F.size("labels") > 0, F.lit(False)), F.coalesce(F.col("definition") != "", F.lit(False))
    many = F.coalesce(F.size("labels") > 1, F.lit(False))
    return entities.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(label).alias("with_label"), F.count_if(definition).alias("with_definition"), F.count_if(many).alias("multilingual"),
        F.count_if(native).alias("native_total"), F.count_if(native & label).alias("native_with_label"), F.count_if(native & definition).alias("native_with_definition"),
    )


def languages(entities: DataFrame, by: tuple = ("type",)) -> DataFrame:
    """Entities per language tag."""
    return entities.select(*by, F.explode(F.map_keys("labels")).alias("lang")).groupBy(*by, "lang").agg(F.count("*").alias("n"))


def by_source(entities: DataFrame) -> DataFrame:
    """Documented entities per source, with grand totals in the rows where source is null."""
    source = F.coalesce("source", F.lit("")).alias("source")
    return entities.select(source, (F.col("definition") != "").alias("defined")).rollup("source").agg(F.count("*").alias("total"), F.count_if("defined").alias("with_definition"))


def distinct_terms(entities: DataFrame, latest: DataFrame) -> DataFrame:
    """Distinct IRIs per type over the latest versions."""
    return entities.join(latest.select("version_id"), "version_id", "left_semi").groupBy("type").agg(F.count("*").alias("rows"), F.count_distinct("iri").alias("terms"))


def counted(df: DataFrame, key: Column, name: str = "value") -> DataFrame:
    """Facet counts, most first; null counts as none."""
    return df.groupBy(F.coalesce(key, F.lit("none")).alias(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name)


def publish_state(license: Column, triples: Column, title: Column, status: Column, least_triples: int = 10, allowed: list[str] = ()) -> Column:
    """Reasons for which a version is held (an array); a version that is ready is never held again.

    license: its identifier, which must be an allowed one; an empty list of these asks for none. Unknown counts of triples are none, blank titles are none.
    """
    reasons = [F.when(F.coalesce(triples, F.lit(0)) < least_triples, "too_few_triples"), F.when(F.trim(F.coalesce(title, F.lit(""))) == "", "title")]
    if allowed:
        reasons.insert(0, F.when(~F.coalesce(license.isin(list(allowed)), F.lit(False)), "license"))
    return F.when(status == "ready", F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*reasons)))


def effective_license(stated: Column, overlay: Column) -> Column:
    """The overlay fills an absence only."""
    return F.coalesce(F.when(stated != "", stated), F.when(overlay != "", overlay))


#: Constructs that show a language tier, the highest tier first, in order of precedence; "a X" is a type, others are predicates.
LADDER = {
    "owl": (
        "a owl:Restriction", "owl:onProperty", "owl:someValuesFrom", "owl:allValuesFrom", "owl:hasValue", "owl:hasSelf", "owl:minCardinality", "owl:maxCardinality", "owl:cardinality",
        "owl:minQualifiedCardinality", "owl:maxQualifiedCardinality", "owl:qualifiedCardinality", "owl:onClass", "owl:onDataRange", "owl:unionOf", "owl:intersectionOf", "owl:complementOf", "owl:oneOf",
        "owl:disjointWith", "owl:disjointUnionOf", "a owl:AllDisjointClasses", "a owl:AllDisjointProperties", "a owl:AllDifferent", "a owl:NegativePropertyAssertion", "owl:propertyDisjointWith",
        "owl:hasKey", "owl:propertyChainAxiom",
    ),
    "rdfs-plus": (
        "a owl:Class", "a owl:ObjectProperty", "a owl:DatatypeProperty", "a owl:TransitiveProperty", "a owl:SymmetricProperty", "a owl:AsymmetricProperty", "a owl:ReflexiveProperty", "a owl:IrreflexiveProperty",
        "a owl:FunctionalProperty", "a owl:InverseFunctionalProperty", "owl:inverseOf", "owl:equivalentClass", "owl:equivalentProperty", "owl:sameAs", "owl:differentFrom",
    ),
    "rdfs": ("a rdfs:Class", "a rdfs:Datatype", "a rdfs:ContainerMembershipProperty", "a rdf:Property", "rdfs:subClassOf", "rdfs:subPropertyOf", "rdfs:domain", "rdfs:range"),
}
_SPACES = {"owl": OWL, "rdf": RDF, "rdfs": RDFS}


def language_tier(quads: DataFrame, by: str = "g") -> DataFrame:
    """(by, tier, construct): the first construct of the ladder that is present, as a predicate or as a type; else rdf and null."""
    steps = []
    for tier, constructs in LADDER.items():
        for c in constructs:
            space, local = c.removeprefix("a ").split(":")
            steps.append((len(steps), tier, f"{space}:{local}", ("a " if c.startswith("a ") else "") + f"<{_SPACES[space]}{local}>"))
    ladder = F.broadcast(quads.sparkSession.createDataFrame(steps, "rank int, tier string, construct string, used string"))  # a constant table
    used = F.when(F.col("p") == f"<{RDF}type>", F.concat(F.lit("a "), F.col("o"))).otherwise(F.col("p"))
    best = quads.select(by, used.alias("used")).join(ladder, "used", "left").groupBy(by).agg(F.min(F.when(F.col("rank").isNotNull(), F.struct("rank", "tier", "construct"))).alias("m"))
    return best.select(by, F.coalesce("m.tier", F.lit("rdf")).alias("tier"), F.col("m.construct").alias("construct"))


def with_prefix(df: DataFrame, iri: str, prefixes: DataFrame) -> DataFrame:
    """df with the prefix whose namespace begins the IRI, the longest if several; raw namespace where none does.

    Namespaces are cut at the IRI's last # or /, which makes this an equi join; a prefix for a namespace further up is found by the
    shorter cuts.
    """
    cuts = F.transform(F.sequence(F.lit(1), F.length(iri)), lambda i: F.when(F.col(iri).substr(i, F.lit(1)).isin("/", "#", "_"), F.col(iri).substr(F.lit(1), i)))
    keyed = df.select(iri).distinct().select(iri, F.explode(F.array_compact(cuts)).alias("namespace"))
    best = keyed.join(prefixes, "namespace").groupBy(iri).agg(F.max_by("prefix", F.length("namespace")).alias("_prefix"))
    raw = F.regexp_extract(F.col(iri), r"^(.*[/#])", 1)
    return df.join(best, iri, "left").withColumn("prefix", F.coalesce("_prefix", raw)).drop("_prefix")


def reused_terms(entities: DataFrame, host_prefix: str, samples: int = 5) -> DataFrame:
    """Foreign entities (iri, type, prefix) per prefix: classes, properties, the first few IRIs.

    Samples are taken per share of a prefix first, then of those samples: a prefix of very many terms is not ranked in one task.
    """
    foreign = entities.where(F.col("prefix") != host_prefix)
    share = foreign.groupBy("prefix", F.expr("pmod(xxhash64(iri), 64)").alias("_share")).agg(
        F.count_if(F.col("type") == "class").alias("classes"), F.count_if(F.col("type").isin("object_property", "datatype_property", "annotation_property")).alias("properties"),
    )
    ranked = foreign.withColumn("_share", F.expr("pmod(xxhash64(iri), 64)")).withColumn("_n", F.row_number().over(W.partitionBy("prefix", "_share").orderBy("iri"))).where(F.col("_n") <= samples)
    firsts = ranked.groupBy("prefix").agg(F.slice(F.array_sort(F.collect_list("iri")), 1, samples).alias("first"))
    counts = share.groupBy("prefix").agg(F.sum("classes").alias("classes"), F.sum("properties").alias("properties"))
    return counts.join(firsts, "prefix").select("prefix", "classes", "properties", F.array_join("first", " ").alias("samples"))


#: Mapping predicates.
MAPPINGS = (SKOS + "exactMatch", SKOS + "closeMatch", SKOS + "broadMatch", SKOS + "narrowMatch", SKOS + "relatedMatch", OWL + "sameAs", "http://www.geneontology.org/formats/oboInOwl#hasDbXref")


def mireot(quads: DataFrame, host: str, imported: list[str], annotations: list[str]) -> DataFrame:
    """Terms of other namespaces taken over one by one: at most one parent of each kind, otherwise only annotations, source not imported."""
    foreign = quads.where(F.col("s").startswith("<") & ~F.col("s").startswith(f"<{host}"))
    for i in imported:
        foreign = foreign.where(~F.col("s").startswith(f"<{i}"))
    allowed = [f"<{p}>" for p in (*annotations, RDF + "type", RDFS + "subClassOf", RDFS + "subPropertyOf")]
    return foreign.groupBy("s").agg(
        F.count_if(F.col("p") == f"<{RDFS}subClassOf>").alias("parents"), F.count_if(F.col("p") == f"<{RDFS}subPropertyOf>").alias("super_properties"), F.bool_and(F.col("p").isin(*allowed)).alias("clean"),
    ).where("clean and parents <= 1 and super_properties <= 1").select(F.col("s").alias("term"))


#: What marks a media type or a file name as RDF.
RDF_MEDIA = ("rdf", "turtle", "ttl", "n-triples", "ntriples", "n3", "json-ld", "ld+json", "owl")
RDF_ENDINGS = ("ttl", "rdf", "owl", "nt", "n3", "nq", "trig", "jsonld")


def url_ending(url: Column) -> Column:
    """The file ending of a URL's last segment in lower case, without query and fragment; null if there is none."""
    last = F.substring_index(F.rtrim(F.regexp_extract(url, r"^[^?#]*", 0), F.lit("/")), "/", -1)
    return F.nullif(F.lower(F.when(last.contains("."), F.substring_index(last, ".", -1))), F.lit(""))


def fair_scores(versions: DataFrame) -> DataFrame:
    """FAIR scores per version: 19 checks in four principles; a principle is the mean of its checks, the score the mean of the principles.

    Columns used: iri, final_url, resolvable, content_type, version_iri, title, description, prefix, shortname, groups, tier, profiles, profiles_unavailable,
    reused, imports, mappings, mireot, license, spdx, license_ok, creators, created, publishers, roles_filled, label_share, definition_share.
    Completeness checks (roles, labels, definitions) score their fraction.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    one = lambda c: F.when(yes(c), 1.0).otherwise(0.0)
    there = lambda name: F.coalesce(F.col(name), F.lit("")) != ""
    share = lambda name: F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    media = F.lower(F.coalesce("content_type", F.lit("")))
    rdf = functools.reduce(lambda x, y: x | y, (media.contains(m) for m in RDF_MEDIA)) | F.coalesce(F.coalesce(url_ending(F.col("final_url")), url_ending(F.col("iri"))).isin(*RDF_ENDINGS), F.lit(False))
    checks = {
        "f": [
            one(there("iri")), one(F.col("resolvable")), one(there("version_iri")), one(there("title") & there("description")), one(there("prefix") | there("shortname")),
            one(F.exists("groups", lambda g: F.lower(g).isin("lov", "obo", "obo-foundry", "bioportal"))),
        ],
        "a": [F.when(yes(F.col("resolvable")) & rdf, 1.0).when(yes(F.col("resolvable")), 0.5).otherwise(0.0), one(F.lower("iri").rlike("^https?://")), F.lit(1.0)],
        "i": [
            one(there("tier")), F.when(yes(F.size("profiles") > 0), 1.0).when(yes(F.col("profiles_unavailable")), 0.5).otherwise(0.0), one(F.col("reused") >= 1),
            F.when(yes(F.col("imports") > 0), 1.0).when(yes(F.col("mappings") > 0) | yes(F.col("mireot") > 0), 0.5).otherwise(0.0),
        ],
        "r": [
            one(there("license") | there("spdx")), F.when(there("spdx"), F.when(yes(F.col("license_ok")), 1.0).otherwise(0.5)).otherwise(0.0),
            one(yes(F.col("creators") > 0) | (there("created") & yes(F.col("publishers") > 0))), share("roles_filled"), share("label_share"), share("definition_share"),
        ],
    }
    means = {k: F.round(sum(v[1:], v[0]) / len(v), 4) for k, v in checks.items()}
    out = versions.select("version_id", *(m.alias(k) for k, m in means.items()))
    overall = F.round((F.col("f") + F.col("a") + F.col("i") + F.col("r")) / 4, 4)
    return out.withColumn("score", overall).withColumn("verdict", F.when(F.col("score") >= 0.85, "strong").when(F.col("score") >= 0.5, "fair").otherwise("weak"))


def graded(share: Column) -> Column:
    """Status of a completeness check."""
    return F.when(share >= 0.85, "pass").when(share >= 0.5, "partial").otherwise("fail")


def own_share(coverage: DataFrame, what: str, by: tuple = ("version_id",)) -> DataFrame:
    """(by, matched, total, share) of label or definition: of native terms where a version has any, else of all; coverage as coverage() gives it."""
    sums = coverage.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("native_total", f"native_with_{what}", "total", f"with_{what}")))
    native = F.col("native_total") > 0
    picked = sums.select(*by, F.when(native, F.col(f"native_with_{what}")).otherwise(F.col(f"with_{what}")).alias("matched"), F.when(native, F.col("native_total")).otherwise(F.col("total")).alias("total"))
    return picked.withColumn("share", F.when(F.col("total") > 0, F.col("matched") / F.col("total")).otherwise(0.0))


def fair_fleet(scores: DataFrame, score: str = "score") -> DataFrame:
    """Histogram, mean and population deviation of percentages."""
    s = F.col(score)
    return scores.agg(
        F.count("*").alias("n"), F.count_if(s < 50).alias("below_50"), F.count_if((s >= 50) & (s < 70)).alias("from_50"), F.count_if((s >= 70) & (s < 85)).alias("from_70"), F.count_if(s >= 85).alias("from_85"),
        F.round(F.avg(s), 4).alias("mean"), F.round(F.stddev_pop(s), 4).alias("deviation"),
    )


def pipeline_stages(versions: DataFrame, done: dict[str, DataFrame]) -> DataFrame:
    """For each stage the versions that have it and those that lack it; done: stage -> DataFrame with version_id."""
    out = versions.select("version_id")
    for name, df in done.items():
        out = out.join(df.select("version_id").distinct().withColumn(name, F.lit(True)), "version_id", "left")
    rows = out.agg(*(F.count_if(F.col(n)).alias(n) for n in done), F.count("*").alias("_all"))
    return rows.select(F.explode(F.array(*(F.struct(F.lit(n).alias("stage"), F.col(n).alias("done"), (F.col("_all") - F.col(n)).alias("missing")) for n in done))).alias("x")).select("x.*")


def agreement(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Share of agreeing verdicts per scope, in percent with one digit."""
    both = left.select(*keys, F.col(value).alias("a")).join(right.select(*keys, F.col(value).alias("b")), keys)
    return both.groupBy(keys[-1]).agg(F.count("*").alias("n"), F.round(100 * F.avg((F.col("a") == F.col("b")).cast("double")), 1).alias("agreed"))
