"""Queries of the fleet roll-ups, filters, housekeeping and result formats, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from triplewright.operators import axioms, fleet
from triplewright.plans import sparql
from triplewright.plans.registry import EX, PRE, query
from triplewright.sources import results

# the latest ready order of each customer, ties included
_LATEST = "l AS (SELECT id, ontology_id FROM versions v WHERE status = 'ready' AND created_at = (SELECT max(created_at) FROM versions w WHERE w.status = 'ready' AND w.ontology_id = v.ontology_id))"


def _reuse(t):
    """What an order reuses: a line item's flag as a source of terms, its status as an import, its part's brand as a mapping bucket."""
    line = t.lineitem.select(F.col("l_orderkey").alias("version_id"), "l_returnflag", "l_linestatus", "l_partkey")
    terms = line.groupBy("version_id", F.col("l_returnflag").alias("prefix")).agg(F.count("*").alias("n"))
    imports = line.where("l_linestatus = 'O'").select("version_id", F.col("l_linestatus").alias("prefix")).distinct()
    mappings = line.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").groupBy("version_id", F.col("p_brand").alias("prefix")).agg(F.count("*").alias("n")).withColumn("predicate", F.lit("x"))
    return fleet.reuse_report(terms, mappings, imports, line.select("version_id", F.col("l_partkey").alias("term")))


_REUSE = """r AS (SELECT l_orderkey AS version_id, 'term' AS signal, l_returnflag AS prefix, count(*) AS n FROM lineitem GROUP BY 1, 2, 3 UNION ALL SELECT DISTINCT l_orderkey, 'import', l_linestatus, 1 FROM lineitem WHERE l_linestatus = 'O'
UNION ALL SELECT l_orderkey, 'mapping', p_brand, count(*) FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3 UNION ALL SELECT l_orderkey, 'mireot', NULL, count(*) FROM lineitem GROUP BY 1)"""


def _profiles(t):
    k = F.col("id")
    return t.versions.where("id % 5 <> 0").select(k.alias("version_id"), F.when(k % 4 == 0, "rdf").when(k % 4 == 1, "rdfs").when(k % 4 == 2, "rdfs-plus").otherwise("owl").alias("tier"), (k % 2 == 0).alias("el"), F.when(k % 3 == 0, True).alias("rl"), F.lit(False).alias("ql"), (k % 7 < 5).alias("dl"))


query("reuse_report", f"WITH {_REUSE} SELECT * FROM r")(_reuse)
query("fleet_reuse", f"""WITH {_LATEST}, {_REUSE} SELECT count(DISTINCT id) AS fleet_size, count(DISTINCT version_id) AS reusing, count(DISTINCT CASE WHEN signal = 'term' THEN prefix END) AS sources,
count(*) FILTER (signal = 'mapping') AS mappings_count, count(*) FILTER (signal = 'import') AS imports_count FROM l LEFT JOIN r ON id = version_id""")(lambda t: fleet.fleet_reuse(t.versions, _reuse(t)))
query("fleet_top_sources", f"WITH {_LATEST}, {_REUSE} SELECT prefix, count(DISTINCT ontology_id) AS reusers_count FROM l JOIN r ON id = version_id WHERE signal = 'term' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2")(
    lambda t: fleet.top_sources(t.versions, _reuse(t), 2))
query("fleet_that_reuse", f"WITH {_LATEST}, {_REUSE} SELECT DISTINCT ontology_id FROM l JOIN r ON id = version_id WHERE signal IN ('term', 'import') AND prefix = 'O'")(lambda t: fleet.that_reuse(t.versions, _reuse(t), "O"))
query("fleet_profiles", f"""WITH {_LATEST} SELECT count(*) AS fleet_size, count(*) FILTER (id % 2 = 0) AS el_count, count(*) FILTER (id % 3 = 0) AS rl_count, 0::BIGINT AS ql_count, count(*) FILTER (id % 7 < 5) AS dl_count,
count(*) FILTER (id % 4 = 0) AS tier_rdf_count, count(*) FILTER (id % 4 = 1) AS tier_rdfs_count, count(*) FILTER (id % 4 = 2) AS tier_rdfs_plus_count, count(*) FILTER (id % 4 = 3) AS tier_owl_count FROM l WHERE id % 5 <> 0""")(
    lambda t: fleet.fleet_profiles(t.versions, _profiles(t)))
query("fleet_that_conform", f"WITH {_LATEST} SELECT DISTINCT ontology_id FROM l WHERE id % 5 <> 0 AND id % 2 = 0 AND id % 4 = 2")(lambda t: fleet.that_conform(t.versions, _profiles(t), "el", "rdfs-plus"))
query("fleet_coverage", f"""WITH {_LATEST}, c AS (SELECT l_orderkey AS version_id, l_returnflag AS type, count(*) AS total, count(*) FILTER (l_quantity > 25) AS with_label FROM lineitem GROUP BY 1, 2)
SELECT type, count(DISTINCT ontology_id) AS ontologies, sum(total)::BIGINT AS total, sum(with_label)::BIGINT AS with_label FROM l JOIN c ON id = version_id GROUP BY 1""")(
    lambda t: fleet.fleet_coverage(t.versions, t.lineitem.groupBy(F.col("l_orderkey").alias("version_id"), F.col("l_returnflag").alias("type")).agg(F.count("*").alias("total"), F.count_if(F.col("l_quantity") > 25).alias("with_label"))))
query("version_stats", """SELECT version_id, count(*) FILTER (type = 'class') AS class, 0::BIGINT AS object_property, 0::BIGINT AS datatype_property, 0::BIGINT AS annotation_property,
greatest(count(*) FILTER (type = 'individual'), CASE WHEN version_id = 'geo' THEN 7 ELSE 0 END) AS individual, 0::BIGINT AS concept FROM entities GROUP BY 1""")(
    lambda t: fleet.version_stats(t.entities, t.spark.createDataFrame([("geo", 7), ("org", 3)], "version_id string, individuals long")))
query("individuals_within_limit", "SELECT version_id, type, count(*) AS n FROM entities WHERE type <> 'individual' GROUP BY 1, 2")(lambda t: fleet.within_limit(t.entities, 100).groupBy("version_id", "type").agg(F.count("*").alias("n")))
query("individuals_of_class", "SELECT iri, label FROM entities WHERE type = 'individual' AND source = 'BUILDING' ORDER BY lower(label), iri LIMIT 12 OFFSET 3")(
    lambda t: fleet.individuals_of(t.entities.withColumn("types", F.array(F.concat(F.lit(EX), F.col("source")), F.lit(EX + "Any"))), EX + "BUILDING", 12, 3).select("iri", "label"))
query("properties_named", "SELECT DISTINCT iri, 'object_property' AS type FROM entities WHERE type = 'class' AND lower(label) = 'asia'")(
    lambda t: fleet.properties_named(t.index.withColumn("type", F.when(F.col("type") == "class", "object_property").otherwise("class")), "The ASIA"))
query("search_pool", "SELECT iri FROM entities WHERE lower(label) LIKE 's%' ORDER BY lower(label), iri LIMIT 500")(lambda t: fleet.prefix_pool(t.index, "S", 10).select("iri"))
query("able_versions", "SELECT 'geo' AS version_id")(lambda t: fleet.able_versions(t.index, ["Middle East", "N_3"], t.edges))
query("inherited_schema", """/*recursive*/ WITH w AS (SELECT child, parent FROM edges WHERE version_id = 'geo' AND child = 'http://ex/nation/6')
SELECT parent AS from_iri, 'http://ex/p1' AS prop_iri, 'http://ex/range' AS range_iri FROM w UNION ALL SELECT parent, 'http://ex/p2', NULL FROM w""")(lambda t: _inherited(t))


def _inherited(t):
    region = t.quads.where(f"g = '<urn:g:geo>' and p = '<{fleet.RDFS}subClassOf>'").select("g", F.col("o").alias("r")).distinct()
    rows = F.array(*(F.struct(F.lit(f"<{EX}{s}>").alias("s"), F.lit(f"<{p}>").alias("p"), o.alias("o")) for s, p, o in (
        ("p1", fleet.RDFS + "domain", F.col("r")), ("p1", fleet.RDFS + "range", F.lit(f"<{EX}range>")), ("p2", fleet.SCHEMA + "domainIncludes", F.col("r")), ("p2", fleet.RDFS + "range", F.lit("_:x")))))
    more = region.select("g", F.explode(rows).alias("x")).select("g", "x.*").distinct()
    edges = t.quads.where(f"p = '<{fleet.RDFS}subClassOf>'").select("g", F.col("s").alias("child"), F.col("o").alias("parent"))
    return fleet.inherited_schema_properties(t.quads.unionByName(more), edges, EX + "nation/6")


query("inferred_page", "SELECT child, parent FROM edges WHERE version_id <> 'parts' ORDER BY child, parent LIMIT 20 OFFSET 5")(lambda t: fleet.inferred_page(t.edges.where("version_id <> 'parts'").select("child", "parent"), 20, 5))
query("labels_overlaid", "SELECT iri, CASE WHEN n_nationkey % 2 = 0 THEN 'New ' || n_nationkey ELSE n_name END AS label FROM nation, (SELECT iri FROM entities WHERE iri LIKE '%/nation/%') e WHERE iri = 'http://ex/nation/' || n_nationkey")(
    lambda t: fleet.relabelled(t.entities.where("iri like '%/nation/%'").select("iri", "label"), t.nation.where("n_nationkey % 2 = 0").select(F.concat(F.lit(EX + "nation/"), F.col("n_nationkey")).alias("iri"), F.concat(F.lit("New "), F.col("n_nationkey")).alias("label"))))
query("identity_iris", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'http://ex/sulo/' WHEN 1 THEN 'http://ex/other/x.owl' WHEN 2 THEN 'http://ex/sulo/' ELSE 'http://ex/a#' END AS iri FROM part")(
    lambda t: t.part.select("p_partkey", (lambda k: fleet.identity_iri(
        F.when(k == 0, EX + "sulo/sulo-0.2.0.ttl").when(k == 1, EX + "other/x.owl").when(k == 3, EX + "a#"), F.when(k < 3, EX + "sulo/").otherwise("")))(F.col("p_partkey") % 4).alias("iri")))
query("drafts_superseded", "WITH k AS (SELECT ontology_id AS o, version_iri AS i FROM versions WHERE id = 1) SELECT id FROM versions, k WHERE id = 1 OR NOT (ontology_id = o AND version_iri = i AND id % 2 = 0)")(
    lambda t: fleet.superseded(t.versions.withColumn("status", F.when(F.col("id") % 2 == 0, "needs_review").otherwise("ready")), 1).select("id"))
query("retry_after", """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN TIMESTAMP '2024-01-01 00:02:00' WHEN 4 THEN NULL ELSE TIMESTAMP '1994-11-06 08:49:37' END AS at FROM customer""")(
    lambda t: t.customer.select("c_custkey", (lambda k: fleet.retry_after(
        F.when(k == 0, " 120").when(k == 1, "Sun, 06 Nov 1994 08:49:37 GMT").when(k == 2, "Sunday, 06-Nov-94 08:49:37 GMT").when(k == 3, "Sun Nov  6 08:49:37 1994").otherwise("soon"), F.lit("2024-01-01 00:00:00").cast("timestamp")))(F.col("c_custkey") % 5).cast("timestamp_ntz").alias("at")))
query("languages_effective", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang WHEN doc_id % 3 = 1 THEN 'user' END AS lang FROM documents")(
    lambda t: t.documents.select("doc_id", fleet.effective_language(F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise(" "), F.when(F.col("doc_id") % 3 == 1, "user")).alias("lang")))
query("scores_healed", "SELECT p_partkey AS version_id, CASE WHEN p_partkey % 3 = 0 THEN 100 + p_partkey ELSE p_size END::BIGINT AS score FROM part")(
    lambda t: fleet.healed(t.part.select(F.col("p_partkey").alias("version_id"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_size").cast("long")).alias("score")), lambda ids: ids.select("version_id", (F.col("version_id") + 100).alias("score"))))
_SOLUTIONS = "SELECT ?s ?l ?z WHERE { ?s rdfs:label ?l . ?s a owl:Class OPTIONAL { ?s :size ?z } }"
_ROWS = """q AS (SELECT 'http://ex/region/' || r_regionkey AS s, r_name AS l, NULL AS z FROM region UNION ALL SELECT 'http://ex/nation/' || n_nationkey, n_name, NULL FROM nation UNION ALL SELECT 'http://ex/supplier/' || s_suppkey, s_name, NULL FROM supplier
UNION ALL SELECT 'http://ex/part/' || p_partkey, p_name, p_size FROM part)"""
_INTEGER = "http://www.w3.org/2001/XMLSchema#integer"
for _kind, _line in (
    ("json", f"""'{{"s":{{"type":"uri","value":"' || s || '"}},"l":{{"type":"literal","value":"' || l || '","xml:lang":"en"}}' || coalesce(',"z":{{"type":"literal","value":"' || z || '","datatype":"{_INTEGER}"}}', '') || '}}'"""),
    ("xml", f"""'<result><binding name="s"><uri>' || s || '</uri></binding><binding name="l"><literal xml:lang="en">' || l || '</literal></binding>' || coalesce('<binding name="z"><literal datatype="{_INTEGER}">' || z || '</literal></binding>', '') || '</result>'"""),
    ("csv", "s || ',' || l || ',' || coalesce(z::VARCHAR, '')"),
    ("tsv", f"""'<' || s || '>' || chr(9) || '"' || l || '"@en' || chr(9) || coalesce('"' || z || '"^^<{_INTEGER}>', '')"""),
):
    query(f"results_{_kind}", f"WITH {_ROWS} SELECT {_line} AS line FROM q")(lambda t, kind=_kind: results.LINES[kind](sparql.run(t.quads, PRE + _SOLUTIONS, disjoint=True)))
query("unsatisfiable_classes", "SELECT '<urn:g:geo>' AS g, 'http://ex/nation/' || n_nationkey AS cls FROM nation WHERE n_regionkey = 0 UNION ALL SELECT '<urn:g:geo>', 'http://ex/region/0'")(
    lambda t: axioms.unsatisfiable(axioms.classify_el(t.quads.unionByName(t.spark.createDataFrame([("<urn:g:geo>", f"<{EX}region/0>", f"<{axioms.RDFS}subClassOf>", f"<{axioms.OWL}Nothing>")], "g string, s string, p string, o string")))))
