"""RDF in and out: format detection, N-Triples and N-Quads, replacing and cleaning graphs, identity and deduplication."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triplewright.functions import terms as T
from triplewright.plans.sparql import DEFAULT_GRAPH

#: Formats by media type, extension, and the beginning of the content.
MEDIA = {"text/turtle": "turtle", "application/rdf+xml": "rdfxml", "application/owl+xml": "owlxml", "application/ld+json": "jsonld", "application/n-triples": "ntriples", "application/n-quads": "nquads", "application/trig": "trig", "text/n3": "turtle", "text/obo": "obo"}
EXTENSIONS = {"ttl": "turtle", "n3": "turtle", "rdf": "rdfxml", "owl": "rdfxml", "xml": "rdfxml", "owx": "owlxml", "jsonld": "jsonld", "nt": "ntriples", "nq": "nquads", "trig": "trig", "obo": "obo", "omn": "manchester", "ofn": "functional"}
SIGNATURES = {r"^\s*(@prefix|@base|PREFIX\s)": "turtle", r"<rdf:RDF": "rdfxml", r"<Ontology": "owlxml", r"^\s*[\[{].*\"@(context|id|graph)\"": "jsonld", r"^\s*format-version:": "obo", r"^\s*(Prefix|Ontology)\(": "functional", r"^\s*(Prefix|Ontology):": "manchester", r"^\s*(<[^>]*>|_:\S+)\s+<[^>]*>\s+\S.*\.\s*$": "ntriples"}
_TERM = r"<[^<>\"{}|^`\\\x00-\x20]*>|_:[^\s<>\"]+|\"(?:[^\"\\]|\\.)*\"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?"
_LINE = rf"^\s*(<[^>]*>|_:\S+)\s*(<[^>]*>)\s*({_TERM})\s*(<[^>]*>|_:\S+)?\s*\.\s*(?:#.*)?$"


def detect_format(content_type: Column, filename: Column, head: Column) -> Column:
    """Media type before extension before signature; RDF/XML whose head speaks of an owl Ontology is OWL/XML; text/plain says nothing."""
    media = F.trim(F.lower(F.split_part(content_type, F.lit(";"), F.lit(1))))
    by_media = F.coalesce(*(F.when(media == k, v) for k, v in MEDIA.items()))
    extension = F.lower(F.regexp_extract(filename, r"\.([A-Za-z0-9]+)$", 1))
    by_extension = F.coalesce(*(F.when(extension == k, v) for k, v in EXTENSIONS.items()))
    start = F.substring(head, 1, 512)
    by_signature = F.coalesce(*(F.when(start.rlike("(?s)" + k if "@(" in k else "(?m)" + k), v) for k, v in SIGNATURES.items()))
    found = F.coalesce(by_media, by_extension, by_signature)
    lead = F.substring(head, 1, 4096)
    return F.when((found == "rdfxml") & lead.contains("<Ontology") & lead.contains("owl"), "owlxml").otherwise(found)


def unescaped(term: Column) -> Column:
    """Escapes of N-Triples literals undone (the common ones)."""
    out = F.replace(term, F.lit("\\\\"), F.lit("\x00"))
    for code, char in (("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ('\\"', '"')):
        out = F.replace(out, F.lit(code), F.lit(char))
    return F.replace(out, F.lit("\x00"), F.lit("\\"))


def parse_nquads(lines: DataFrame, column: str = "value", graph: str | None = None) -> DataFrame:
    """(g, s, p, o) of N-Triples or N-Quads lines. Lines that aren't statements are left out; language tags that aren't valid are dropped, the literal stays."""
    c = F.col(column)
    part = lambda i: F.regexp_extract(c, _LINE, i)
    tag = F.regexp_extract(part(3), r'(?s)^"(?:.*)"@([A-Za-z0-9-]+)$', 1)
    bad = (tag != "") & ~tag.rlike(r"^[A-Za-z]{2,8}(-[A-Za-z0-9]{1,8})*$")
    o = F.when(bad, F.regexp_extract(part(3), r'(?s)^(".*")@', 1)).otherwise(part(3))
    named = F.when(part(4) != "", part(4)).otherwise(F.lit(graph or DEFAULT_GRAPH))
    return lines.where(c.rlike(_LINE)).select(named.alias("g"), part(1).alias("s"), part(2).alias("p"), F.when(o.startswith('"'), unescaped(o)).otherwise(o).alias("o"))


def load(spark: SparkSession, path: str, graph: str | None = None) -> DataFrame:
    """Distinct quads of N-Triples and N-Quads files; blank nodes are kept apart by graph."""
    quads = parse_nquads(spark.read.text(path), graph=graph)
    scope = lambda c: F.when(F.col(c).startswith("_:"), F.concat(F.lit("_:"), F.substring(F.md5("g"), 1, 8), F.lit("_"), F.substring(F.col(c), 3, 1000))).otherwise(F.col(c)).alias(c)
    return quads.select("g", scope("s"), "p", scope("o")).distinct()


def to_nquads(quads: DataFrame) -> DataFrame:
    """One column `value` of N-Quads lines; the default graph's quads are triples."""
    body = F.regexp_extract(F.col("o"), r'(?s)^"(.*)"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?$', 1)
    suffix = F.col("o").substr(F.length(body) + 3, F.length("o"))
    escaped = F.replace(F.replace(F.replace(F.replace(F.replace(body, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
    o = F.when(F.col("o").startswith('"'), F.concat(F.lit('"'), escaped, F.lit('"'), suffix)).otherwise(F.col("o"))
    return quads.select(F.concat_ws(" ", "s", "p", o, F.when(F.col("g") != DEFAULT_GRAPH, F.col("g")), F.lit(".")).alias("value"))


def replace_graph(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored quads with the new ones' graphs replaced."""
    return stored.join(new.select("g").distinct(), "g", "left_anti").select("g", "s", "p", "o").unionByName(new.select("g", "s", "p", "o").distinct())


def append(stored: DataFrame, new: DataFrame) -> DataFrame:
    return stored.select("g", "s", "p", "o").unionByName(new.select("g", "s", "p", "o")).distinct()


def drop_graphs(stored: DataFrame, graphs: list[str]) -> DataFrame:
    return stored.where(~F.col("g").isin(graphs))


def replace_record(stored: DataFrame, new: DataFrame) -> DataFrame:
    """All triples of the new record's subjects replaced."""
    return stored.join(new.select("s").distinct(), "s", "left_anti").select("g", "s", "p", "o").unionByName(new.select("g", "s", "p", "o"))


def content_identity(contents: DataFrame, content: str = "content") -> DataFrame:
    """SHA-256 of the bytes, with the number of equal ones and the first of them."""
    return contents.withColumn("sha", F.sha2(F.col(content).cast("binary"), 256)).groupBy("sha").agg(F.count("*").alias("copies"), F.min("id").alias("first"))


def canonical_identity(quads: DataFrame) -> DataFrame:
    """A hash of each graph that its triples' order doesn't matter to: the sum and the count of the triples' hashes, hashed.

    Adding hashes up needs no sorted list of a whole graph in one place.
    """
    h = F.sha2(F.concat_ws(" ", "s", "p", "o"), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).alias(f"h{i}") for i in range(5)]
    return quads.select("g", "s", "p", "o").distinct().groupBy("g").agg(F.count("*").alias("n"), *parts).select("g", F.sha2(F.concat_ws(",", "n", *(f"h{i}" for i in range(5))), 256).alias("identity"))


def ingest_problem(quads: DataFrame) -> DataFrame:
    """(g, problem) for graphs that are empty of meaning: only OWL/XML syntax words typed, and no typed IRI subject."""
    typed, owl = F.col("p").endswith("#type>"), "<http://www.w3.org/2002/07/owl#"
    words = F.col("o").isin(*(f"{owl}{w}>" for w in ("Declaration", "AbbreviatedIRI", "IRI")))
    counts = quads.groupBy("g").agg(F.count_if(typed & words).alias("words"), F.count_if(typed & ~words & F.col("s").startswith("<") & F.col("o").startswith("<")).alias("typed"))
    return counts.select("g", F.when((F.col("words") > 0) & (F.col("typed") == 0), "lossy").otherwise("").alias("problem"))


def strip_bled(quads: DataFrame, host: str, properties: list[str]) -> DataFrame:
    """Without the host's annotations whose (predicate, value) another IRI subject states as well."""
    bled = quads.where(F.col("p").isin(properties) & (F.col("s") != host) & F.col("s").startswith("<")).select("p", "o").distinct()
    own = quads.where((F.col("s") == host) & F.col("p").isin(properties)).join(bled, ["p", "o"], "left_semi").select("g", "s", "p", "o")
    return quads.join(own, ["g", "s", "p", "o"], "left_anti")


def ontology_iris(quads: DataFrame) -> DataFrame:
    """(g, iri): the smallest subject typed owl:Ontology that nothing in its graph imports."""
    owl = "http://www.w3.org/2002/07/owl#"
    heads = quads.where(F.col("p").endswith("#type>") & (F.col("o") == f"<{owl}Ontology>") & F.col("s").startswith("<")).select("g", "s")
    imported = quads.where(F.col("p") == f"<{owl}imports>").select("g", F.col("o").alias("s")).distinct()
    return heads.join(imported, ["g", "s"], "left_anti").groupBy("g").agg(T.lexical(F.min("s")).alias("iri"))


def header_values(quads: DataFrame, roles: dict[str, list[str]]) -> DataFrame:
    """(g, role, value) of the graphs' headers: for a role its first property with a value, English before others, the smallest of equals."""
    spark = quads.sparkSession
    table = F.broadcast(spark.createDataFrame([(r, f"<{p}>", i) for r, ps in roles.items() for i, p in enumerate(ps)], "role string, p string, rank int"))  # as long as the caller's list
    heads = ontology_iris(quads).select("g", T.iri(F.col("iri")).alias("s"))
    found = quads.join(heads, ["g", "s"], "left_semi").join(table, "p")
    tag = T.lang(F.col("o"))
    return found.groupBy("g", "role").agg(F.min_by(T.lexical(F.col("o")), F.struct("rank", F.when(tag == "en", 0).otherwise(1), "o")).alias("value"))


def import_closure(imports: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(iri, import_iri, depth): what each start (iri) imports, directly or not, by the shortest way; all of it, or up to max_depth."""
    from triplewright.operators.staging import stage

    found = stage(imports.join(starts, "iri", "left_semi").select("iri", "import_iri", F.lit(1).alias("depth")).distinct())
    frontier = found
    for depth in itertools.count(2) if max_depth is None else range(2, max_depth + 1):
        step = frontier.select(F.col("iri").alias("start"), F.col("import_iri").alias("iri")).join(imports, "iri").select(F.col("start").alias("iri"), "import_iri", F.lit(depth).alias("depth")).distinct()
        frontier = stage(step.join(found, ["iri", "import_iri"], "left_anti"))
        if frontier.isEmpty():
            break
        found = stage(found.unionByName(frontier))
    return found


def as_triples(rows: DataFrame, subject: Column, columns: dict[str, tuple[str, str]], graph: Column) -> DataFrame:
    """Rows as quads: columns maps a column to (predicate, kind), kind being iri, text or a datatype; nulls give nothing."""
    make = lambda c, kind: T.iri(F.col(c)) if kind == "iri" else T.plain(F.col(c).cast("string")) if kind == "text" else T.typed(F.col(c), kind)
    items = F.array(*(F.struct(F.lit(f"<{p}>").alias("p"), make(c, kind).alias("o")) for c, (p, kind) in columns.items()))
    return rows.select(graph.alias("g"), subject.alias("s"), F.explode(items).alias("x")).select("g", "s", "x.p", "x.o").where("o is not null")
