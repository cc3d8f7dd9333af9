"""Roll-ups over the latest versions of a catalogue, filters by what they hold, housekeeping of versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triplewright.functions import text as X
from triplewright.functions import terms as T
from triplewright.operators.hierarchy import distances
from triplewright.operators.versions import latest_by_time

RDFS, SCHEMA = "http://www.w3.org/2000/01/rdf-schema#", "https://schema.org/"
#: Profiles and tiers that are counted.
PROFILES, TIERS = ("el", "rl", "ql", "dl"), ("rdf", "rdfs", "rdfs-plus", "owl")
COVERAGE = ("total", "with_label", "with_definition", "multilingual", "native_total", "native_with_label", "native_with_definition")


def fleet_coverage(versions: DataFrame, coverage: DataFrame) -> DataFrame:
    """(type, ontologies, sums of the coverage columns) over the latest ready versions; versions whose coverage isn't known are left out.

    coverage: (version_id, type, ...) as catalogue.coverage gives it; columns it lacks count zero.
    """
    latest = latest_by_time(versions).select(F.col("id").alias("version_id"), "ontology_id")
    there = [c for c in COVERAGE if c in coverage.columns]
    return coverage.join(latest, "version_id").groupBy("type").agg(F.count_distinct("ontology_id").alias("ontologies"), *(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in there))


def fleet_profiles(versions: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row: how many latest ready versions there are with a verdict, how many lie in each profile and in each tier.

    profiles: (version_id, tier, el, rl, ql, dl), booleans that may be null.
    """
    latest = latest_by_time(versions).select(F.col("id").alias("version_id"))
    inside = [F.count_if(F.coalesce(p, F.lit(False))).alias(f"{p}_count") for p in PROFILES]
    tiers = [F.count_if(F.col("tier") == t).alias(f"tier_{t.replace('-', '_')}_count") for t in TIERS]
    return profiles.join(latest, "version_id").agg(F.count("*").alias("fleet_size"), *inside, *tiers)


def fleet_reuse(versions: DataFrame, reuse: DataFrame) -> DataFrame:
    """One row: versions, those that reuse anything, distinct sources, mapping buckets and imports of the latest ready versions.

    reuse: (version_id, signal, prefix, n) with signal term, mapping or import; a mapping row is a bucket of predicate and target.
    """
    latest = latest_by_time(versions).select(F.col("id").alias("version_id"))
    own = latest.join(reuse, "version_id", "left")
    return own.agg(
        F.count_distinct("version_id").alias("fleet_size"), F.count_distinct(F.when(F.col("signal").isNotNull(), F.col("version_id"))).alias("reusing"),
        F.count_distinct(F.when(F.col("signal") == "term", F.col("prefix"))).alias("sources"), F.count_if(F.col("signal") == "mapping").alias("mappings_count"), F.count_if(F.col("signal") == "import").alias("imports_count"),
    )


def top_sources(versions: DataFrame, reuse: DataFrame, k: int = 10) -> DataFrame:
    """(prefix, reusers_count) of the k sources that most latest ready versions reuse terms of."""
    latest = latest_by_time(versions).select(F.col("id").alias("version_id"), "ontology_id")
    used = reuse.where("signal = 'term'").join(latest, "version_id").groupBy("prefix").agg(F.count_distinct("ontology_id").alias("reusers_count"))
    return used.orderBy(F.desc("reusers_count"), "prefix").limit(k)


def that_reuse(versions: DataFrame, reuse: DataFrame, prefix: str) -> DataFrame:
    """(ontology_id) of those whose latest ready version reuses terms of a prefix or imports it."""
    hits = reuse.where(F.col("signal").isin("term", "import") & (F.col("prefix") == prefix)).select("version_id").distinct()
    return latest_by_time(versions).withColumnRenamed("id", "version_id").join(hits, "version_id", "left_semi").select("ontology_id").distinct()


def that_conform(versions: DataFrame, profiles: DataFrame, profile: str | None = None, tier: str | None = None) -> DataFrame:
    """(ontology_id) of those whose latest ready version lies in a profile, or is of a tier."""
    hits = profiles
    if profile:
        hits = hits.where(F.coalesce(profile, F.lit(False)))
    if tier:
        hits = hits.where(F.col("tier") == tier)
    return latest_by_time(versions).withColumnRenamed("id", "version_id").join(hits.select("version_id").distinct(), "version_id", "left_semi").select("ontology_id").distinct()


def reuse_report(terms: DataFrame, mappings: DataFrame, imports: DataFrame, mireot: DataFrame) -> DataFrame:
    """The four signals as rows (version_id, signal, prefix, n): terms (version_id, prefix, n), mappings (version_id, predicate, prefix, n), imports (version_id, prefix), mireot (version_id, term)."""
    return (
        terms.select("version_id", F.lit("term").alias("signal"), "prefix", F.col("n").cast("long").alias("n"))
        .unionByName(mappings.select("version_id", F.lit("mapping").alias("signal"), "prefix", F.col("n").cast("long").alias("n")))
        .unionByName(imports.select("version_id", F.lit("import").alias("signal"), "prefix", F.lit(1).cast("long").alias("n")))
        .unionByName(mireot.groupBy("version_id").agg(F.count("*").alias("n")).select("version_id", F.lit("mireot").alias("signal"), F.lit(None).cast("string").alias("prefix"), "n"))
    )


def version_stats(entities: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Entities by type per version; individuals are those indexed or, if more, those declared (version_id, individuals)."""
    kinds = ("class", "object_property", "datatype_property", "annotation_property", "individual", "concept")
    out = entities.groupBy("version_id").agg(*(F.count_if(F.col("type") == k).alias(k) for k in kinds))
    if declared is None:
        return out
    return out.join(declared, "version_id", "left").withColumn("individual", F.greatest("individual", F.coalesce("individuals", F.lit(0)))).drop("individuals")


def within_limit(entities: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Entities without the individuals of versions that have more than so many distinct ones."""
    many = entities.where("type = 'individual'").groupBy("version_id").agg(F.count_distinct("iri").alias("_n")).where(F.col("_n") > most).select("version_id")
    return entities.where("type <> 'individual'").unionByName(entities.where("type = 'individual'").join(many, "version_id", "left_anti"))


def individuals_of(entities: DataFrame, cls: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the individuals that state a class among their types, by lower label and IRI."""
    return entities.where((F.col("type") == "individual") & F.array_contains("types", cls)).orderBy(F.lower("label"), "iri", "version_id").offset(offset).limit(limit)


def properties_named(entities: DataFrame, name: str) -> DataFrame:
    """(iri, type) of object and datatype properties by IRI, exact normalised label or local name."""
    from triplewright.operators.search import normalise

    same = (F.col("iri") == name) | (F.col("norm") == normalise(name)) | (F.col("short") == name)
    return entities.where(F.col("type").isin("object_property", "datatype_property") & same).select("iri", "type").distinct()


def prefix_pool(entities: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """The first max(20 limit, 500) labels in byte order that begin with the query: a pool that is ranked without reading all hits."""
    from triplewright.operators.search import normalise

    return entities.where(F.col("norm").startswith(normalise(query))).orderBy("norm", "iri", "version_id").limit(max(20 * limit, 500))


def able_versions(index: DataFrame, names: list[str], classified: DataFrame | None = None) -> DataFrame:
    """(version_id) of versions that know every plain name by label or local name, and have a classification if that is asked for."""
    from triplewright.operators.search import normalise

    known = index.select("version_id", F.explode(F.array_compact(F.array(*(F.when((F.col("norm") == normalise(n)) | (F.col("short") == n), F.lit(i)) for i, n in enumerate(names))))).alias("name")) if names else None
    out = known.groupBy("version_id").agg(F.count_distinct("name").alias("n")).where(F.col("n") == len(names)).select("version_id") if names else index.select("version_id").distinct()
    return out if classified is None else out.join(classified.select("version_id").distinct(), "version_id", "left_semi")


def inherited_schema_properties(quads: DataFrame, edges: DataFrame, cls: str, most: int = 30, limit: int = 500) -> DataFrame:
    """(from_iri, prop_iri, range_iri) of properties whose domain is one of a class's nearest ancestors in its graph, ordered.

    edges: (g, child, parent) of terms. Ancestors beyond `most` (the nearest first) are left out, as are rows beyond the limit: both are the page's.
    """
    term = f"<{cls}>"
    seeds = edges.where(F.col("child") == term).select("g", "child").distinct()
    up = distances(edges, "child", "parent", seeds, ["g"]).select("g", F.col("parent").alias("ancestor"), "steps").where(F.col("ancestor") != term)
    some = up.withColumn("_n", F.row_number().over(W.partitionBy("g").orderBy("steps", "ancestor"))).where(F.col("_n") <= most).drop("_n", "steps")
    of = lambda *names: [f"<{n}>" for n in names]
    domain = quads.where(F.col("p").isin(*of(RDFS + "domain", SCHEMA + "domainIncludes")) & F.col("s").startswith("<")).select("g", F.col("s").alias("prop"), F.col("o").alias("ancestor"))
    ranges = quads.where(F.col("p").isin(*of(RDFS + "range", SCHEMA + "rangeIncludes")) & F.col("o").startswith("<")).select("g", F.col("s").alias("prop"), F.col("o").alias("range"))
    found = domain.join(some, ["g", "ancestor"]).join(ranges, ["g", "prop"], "left")
    return found.select(T.lexical(F.col("ancestor")).alias("from_iri"), T.lexical(F.col("prop")).alias("prop_iri"), T.lexical(F.col("range")).alias("range_iri")).distinct().orderBy("from_iri", "prop_iri", "range_iri").limit(limit)


def inferred_page(inferred: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of inferred (child, parent) pairs of IRIs, by child and parent."""
    return inferred.where("not startswith(child, '_:') and not startswith(parent, '_:')").orderBy("child", "parent").offset(offset).limit(limit)


def relabelled(rows: DataFrame, overlay: DataFrame, iri: str = "iri", label: str = "label") -> DataFrame:
    """rows with the overlay's (iri, label) in place of their own label where it has one."""
    theirs = overlay.select(F.col("iri").alias(iri), F.col("label").alias("_label")).dropDuplicates([iri])
    return rows.join(theirs, iri, "left").withColumn(label, F.coalesce("_label", label)).select(*rows.columns)


def identity_iri(subject: Column, namespace: Column) -> Column:
    """The declared namespace if the ontology's subject lies in it or isn't known, else the subject."""
    cn, cs = X.canonical_iri(namespace), X.canonical_iri(subject)
    inside = subject.isNull() | (cs == cn) | cs.startswith(F.concat(cn, F.lit("/"))) | cs.startswith(F.concat(cn, F.lit("#")))
    return F.when(F.coalesce(namespace, F.lit("")) == "", subject).when(inside, namespace).otherwise(subject)


def superseded(versions: DataFrame, kept: int | str) -> DataFrame:
    """Versions without the drafts in need of review that a kept one replaces: those of its ontology with its version IRI."""
    keeper = versions.where(F.col("id") == kept).select("ontology_id", "version_iri", F.lit("needs_review").alias("status"), F.lit(True).alias("_gone"))
    marked = versions.join(keeper, ["ontology_id", "version_iri", "status"], "left")
    return marked.where((F.col("id") == kept) | F.col("_gone").isNull()).select(*versions.columns)


def retry_after(header: Column, now: Column) -> Column:
    """When to try again, by a Retry-After header of seconds or of an HTTP date in any of its three forms; null for neither."""
    value = F.trim(header)
    seconds = F.when(value.rlike(r"^\d{1,9}$"), F.timestamp_seconds(F.unix_timestamp(now) + value.try_cast("long")))
    months = "jan feb mar apr may jun jul aug sep oct nov dec".split()

    def date(pattern: str, day: int, month: int, year: int, clock: int) -> Column:
        part = lambda i: F.regexp_extract(value, pattern, i)
        number = F.array_position(F.array(*map(F.lit, months)), F.lower(part(month)))
        whole = F.when(F.length(part(year)) == 2, F.concat(F.when(part(year).try_cast("int") >= 70, "19").otherwise("20"), part(year))).otherwise(part(year))
        return F.when((part(day) != "") & (number > 0), F.try_to_timestamp(F.concat_ws("-", whole, F.lpad(number.cast("string"), 2, "0"), F.concat(F.lpad(F.trim(part(day)), 2, "0"), F.lit(" "), part(clock)))))

    modern = date(r"^\w{3}, (\d{1,2}) (\w{3}) (\d{4}) (\d\d:\d\d:\d\d) GMT$", 1, 2, 3, 4)
    dashed = date(r"^\w+, (\d{1,2})-(\w{3})-(\d{2}) (\d\d:\d\d:\d\d) GMT$", 1, 2, 3, 4)
    plain = date(r"^\w{3} (\w{3}) ([ \d]\d) (\d\d:\d\d:\d\d) (\d{4})$", 2, 1, 4, 3)
    return F.coalesce(seconds, modern, dashed, plain)


def effective_language(asked: Column, preferred: Column) -> Column:
    """The language asked for, else the user's, else none."""
    return F.coalesce(F.nullif(F.trim(asked), F.lit("")), F.nullif(F.trim(preferred), F.lit("")))


def host_tokens(candidates: list[str]) -> tuple[set[str], list[str]]:
    """Names and namespaces by which an ontology's own terms are told: from the IRIs that it may be known by. A generic token is left out."""
    names, spaces = set(), []
    for iri in candidates:
        bare = iri.rstrip("#/")
        token = bare.rsplit("/", 1)[-1].rsplit("#", 1)[-1].split(".")[0].lower()
        if token and token != "obo":
            names.add(token)
        spaces += [s for s in (bare + "#", bare + "/") if s not in spaces]
    return names, spaces


def healed(scores: DataFrame, compute) -> DataFrame:
    """scores (version_id, score, ...) with missing ones computed: compute(version ids) gives (version_id, score)."""
    missing = scores.where("score is null").select("version_id")
    made = compute(missing).select("version_id", F.col("score").alias("_score"))
    return scores.join(made, "version_id", "left").withColumn("score", F.coalesce("score", "_score")).select(*scores.columns)
