"""Queries of browsing, repair and catalogue operators; imported by registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from triplewright.functions import text as X
from triplewright.operators import browse, catalogue, indexing
from triplewright.plans.registry import EX, query
from triplewright.sources import rdf

query("term_page", "SELECT iri, label FROM entities WHERE type = 'class' ORDER BY lower(label), iri LIMIT 40 OFFSET 20")(lambda t: browse.page(t.entities, 40, 20, ["class"]).select("iri", "label"))
query("root_cache", """
SELECT version_id, type, iri, rank, iri IN (SELECT parent FROM edges) AS has_children FROM (SELECT *, row_number() OVER (PARTITION BY version_id, type ORDER BY lower(label), iri) AS rank FROM entities WHERE iri NOT IN (SELECT child FROM edges)) WHERE rank <= 100""")(
    lambda t: browse.root_cache(t.entities, t.edges))
query("inferred_roots", "SELECT 'http://www.w3.org/2002/07/owl#Nothing' AS iri, 'owl:Nothing' AS label UNION ALL SELECT 'http://ex/region/' || r_regionkey, r_name FROM region")(
    lambda t: browse.inferred_roots(t.entities.where("iri like '%region%'"), t.part.where("p_partkey = 1"), 10))
query("inferred_or_asserted", "SELECT iri FROM entities WHERE version_id = 'geo'")(lambda t: browse.with_fallback(t.entities.where("version_id = 'none'").select("iri"), t.entities.where("version_id = 'geo'").select("iri")))
query("tree_to_entity", "SELECT 'http://ex/nation/' || n_nationkey AS iri, 'http://ex/region/' || n_regionkey AS parent, n_name AS label FROM nation WHERE n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 7)")(
    lambda t: browse.tree_to(t.entities, t.edges, EX + "nation/7"))
query("neighbourhood", "SELECT DISTINCT child, parent FROM edges WHERE child = 'http://ex/nation/3' OR parent = 'http://ex/nation/3'")(lambda t: browse.neighbourhood(t.edges, EX + "nation/3"))
query("inverse_hidden", "SELECT iri FROM entities")(lambda t: browse.inverse_targets_hidden(t.entities, t.quads).select("iri"))
query("catalogue_search", """
SELECT iri, CASE WHEN lower(short) = 'n_1' THEN 0 WHEN lower(short) LIKE 'n\\_1%' ESCAPE '\\' THEN 1 WHEN lower(label) LIKE 'n\\_1%' ESCAPE '\\' THEN 2 WHEN lower(label) LIKE '%n\\_1%' ESCAPE '\\' OR lower(short) LIKE '%n\\_1%' ESCAPE '\\' THEN 3 ELSE 4 END AS tier
FROM entities WHERE lower(short) LIKE '%n\\_1%' ESCAPE '\\' OR lower(label) LIKE '%n\\_1%' ESCAPE '\\'""")(
    lambda t: browse.catalogue_search(t.entities.select(F.col("short").alias("shortname"), "iri", F.col("label").alias("title"), F.lit("").alias("description")), "N_1").select("iri", "tier"))
query("per_version_hits", """
SELECT version_id, iri, label, rank FROM (SELECT *, row_number() OVER (PARTITION BY version_id ORDER BY CASE WHEN lower(label) = 'n' THEN 0 ELSE 1 END, length(label), label, iri) AS rank FROM entities WHERE lower(label) LIKE 'n%') WHERE rank <= 5""")(lambda t: browse.per_version_hits(t.index, "n"))
query("observed_fillers", """
SELECT '<http://ex/supplier/' || s || '>' AS filler, count(*) AS n FROM (SELECT l_partkey, min(l_suppkey) AS s FROM lineitem GROUP BY 1) GROUP BY 1 ORDER BY n DESC, filler LIMIT 20""")(lambda t: browse.observed_fillers(t.quads, EX + "suppliedBy"))
query("shortnames_unique", "SELECT id, CASE WHEN n > 1 THEN shortname || '-' || n ELSE shortname END AS shortname FROM (SELECT p_partkey AS id, replace(p_name, ' ', '-') AS shortname, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)")(
    lambda t: browse.uniquified(t.part.select(F.col("p_partkey").alias("id"), X.shortname(F.lit(None).cast("string"), F.col("p_name"), F.lit("http://x/y")).alias("shortname"))))
query("identity_merge", "SELECT id, first_value(id) OVER (PARTITION BY ontology_id ORDER BY created_at, id) AS keeper FROM versions")(
    lambda t: browse.merged_identities(t.versions, X.canonical_iri(F.concat(F.lit("http://ex/"), F.col("ontology_id"), F.when(F.col("id") % 2 == 0, "#").otherwise("/")))))
query("entity_sources", "SELECT iri, CASE WHEN iri LIKE 'http://ex/part/%' THEN '' WHEN iri LIKE 'http://ex/nation/%' THEN 'nations' ELSE regexp_extract(iri, '^(.*[/#])', 1) END AS source FROM entities")(
    lambda t: browse.source_of(t.entities.select("iri"), t.spark.createDataFrame([("http://ex/part/", "parts"), ("http://ex/nation/", "nations")], "base string, name string"), ["parts"]))
query("title_pick", "SELECT g, s, regexp_extract(o, '^\"(.*)\"', 1) AS value FROM quads WHERE p LIKE '%#label>'")(lambda t: browse.pick_texts(t.quads, [catalogue.RDFS + "label"]))
query("term_record", """
SELECT 'http://ex/brand' AS predicate, p_brand AS "values" FROM part WHERE p_partkey = 3 UNION ALL SELECT 'http://ex/size', CAST(p_size AS VARCHAR) FROM part WHERE p_partkey = 3
UNION ALL SELECT 'http://www.w3.org/2000/01/rdf-schema#label', p_name FROM part WHERE p_partkey = 3 UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'http://www.w3.org/2002/07/owl#Class'""")(lambda t: browse.term_record(t.quads, EX + "part/3"))
query("reasoner_input", """
SELECT g, s, p, o FROM quads UNION ALL SELECT DISTINCT 'x' AS g, 'x', 'x', 'x' FROM region WHERE false
UNION ALL SELECT g, s, '<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>', '<http://www.w3.org/2002/07/owl#Class>' FROM (SELECT DISTINCT g, s FROM (SELECT g, s FROM quads WHERE p LIKE '%#subClassOf>' UNION ALL SELECT g, o FROM quads WHERE p LIKE '%#subClassOf>') WHERE s LIKE '<%' AND (g, s) NOT IN (SELECT (g, s) FROM quads WHERE o LIKE '%owl#Class>'))""")(lambda t: browse.input_repairs(t.quads))
query("owl_profiles", "SELECT g, profile, true AS conforms, 0::BIGINT AS violations FROM (SELECT DISTINCT g FROM quads), (VALUES ('EL'), ('QL'), ('RL')) v(profile)")(lambda t: browse.owl_profiles(t.quads))
query("reuse_mappings", "SELECT '<http://www.w3.org/2004/02/skos/core#closeMatch>' AS p, 'n' AS prefix, count(*) AS n FROM customer")(
    lambda t: browse.mapping_counts(t.customer.select(F.lit("<http://www.w3.org/2004/02/skos/core#closeMatch>").alias("p"), F.concat(F.lit("<http://ex/nation/"), F.col("c_nationkey"), F.lit(">")).alias("o")), t.spark.createDataFrame([("http://ex/nation/", "n")], "namespace string, prefix string"), catalogue.MAPPINGS))
query("fair_history", "SELECT day, CASE WHEN day = DATE '2024-01-05' THEN 0.5 ELSE n END AS score FROM (SELECT day, CAST(count(*) AS DOUBLE) AS n FROM usage GROUP BY 1)")(
    lambda t: browse.snapshot(t.usage.groupBy("day").agg(F.count("*").cast("double").alias("score")), t.spark.sql("SELECT date'2024-01-05' AS day, 0.5D AS score")))
query("import_exports", "SELECT DISTINCT 'http://ex/nation/' || s_nationkey AS imported, 'http://ex/supplier/' || s_suppkey AS importer FROM supplier")(
    lambda t: t.edges.where("child like '%supplier%'").select(F.col("parent").alias("imported"), F.col("child").alias("importer")).distinct())
def _typed_customers(t):
    """Types of customers beside their declaration: the market segment, and every other one a buyer, stated twice; blank types count as none."""
    names = F.array_compact(F.array(F.concat(F.lit("<http://ex/"), F.col("c_mktsegment"), F.lit(">")), F.when(F.col("c_custkey") % 2 == 0, "<http://ex/ABuyer>"), F.when(F.col("c_custkey") % 2 == 0, "<http://ex/ABuyer>"), F.lit("_:x")))
    return t.customer.select(F.lit("<urn:g:org>").alias("g"), F.concat(F.lit("<http://ex/customer/"), F.col("c_custkey"), F.lit(">")).alias("s"), F.lit(indexing.TYPE).alias("p"), F.explode(names).alias("o"))


query("individual_types", """SELECT '<urn:g:org>' AS g, '<http://ex/customer/' || c_custkey || '>' AS s, CASE WHEN c_custkey % 2 = 0 THEN 'http://ex/ABuyer http://ex/' || c_mktsegment ELSE 'http://ex/' || c_mktsegment END AS types FROM customer""")(
    lambda t: indexing.individual_types(t.quads.unionByName(_typed_customers(t))).withColumn("types", F.array_join("types", " ")))
query("job_list", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")(
    lambda t: t.orders.where((F.col("o_orderstatus") == "F") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50).select("o_orderkey"))
query("rdf_replace_record", "SELECT g, s, p, o FROM quads WHERE s <> '<http://ex/part/1>' UNION ALL SELECT '<urn:g:parts>', '<http://ex/part/1>', '<p>', '<o>'")(
    lambda t: rdf.replace_record(t.quads, t.spark.createDataFrame([("<urn:g:parts>", "<http://ex/part/1>", "<p>", "<o>")], "g string, s string, p string, o string")))
query("rdf_drop_graph", "SELECT g, s, p, o FROM quads WHERE g <> '<urn:g:geo>'")(lambda t: rdf.drop_graphs(t.quads, ["<urn:g:geo>"]))
query("csv_rekeyed", "SELECT p_brand AS prefix, sum(p_size) AS total FROM part GROUP BY 1")(
    lambda t: catalogue.with_prefix(t.part.select(F.concat(F.lit("http://ex/"), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit("/x")).alias("iri"), "p_size"), "iri", t.part.select(F.concat(F.lit("http://ex/"), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit("/")).alias("namespace"), F.col("p_brand").alias("prefix")).distinct()).groupBy("prefix").agg(F.sum("p_size").alias("total")))
