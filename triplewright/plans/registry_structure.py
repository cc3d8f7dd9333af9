"""Queries of updates, nested expressions, reduction with cycles and nearest ancestors, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from triplewright.operators import expressions, fleet, hierarchy, profiles
from triplewright.operators.axioms import OWL, RDF, RDFS
from triplewright.operators.staging import shared_dir
from triplewright.plans import mos
from triplewright.plans.registry import EX, PRE, _related, query
from triplewright.plans.registry_reasoning import _LINKS, G, frame, iri, leads, stated
from triplewright.plans.sparql_update import QuadStore
from triplewright.sources import splitting

_SUB = f"<{RDFS}subClassOf>"


def _updated(t, text: str):
    store = QuadStore.create(t.quads, shared_dir(t.spark))
    store.update(PRE + text)
    return store.quads()


_LABEL, _IRI = f"<{RDFS}label>", "'<http://ex/{0}/' || {1} || '>'"
query("update_delete_insert", f"""SELECT g, s, CASE p WHEN '{_LABEL}' THEN '<http://ex/name>' ELSE p END AS p, o FROM quads WHERE g = '<urn:g:geo>'
UNION ALL SELECT '<urn:g:was>', s, '<http://ex/was>', o FROM quads WHERE g = '<urn:g:geo>' AND p = '{_LABEL}' UNION ALL SELECT * FROM quads WHERE g <> '<urn:g:geo>'""")(
    lambda t: _updated(t, "WITH <urn:g:geo> DELETE { ?s rdfs:label ?l } INSERT { ?s :name ?l . GRAPH <urn:g:was> { ?s :was ?l } } WHERE { ?s rdfs:label ?l ; a owl:Class }"))
query("update_delete_where", "SELECT * FROM quads WHERE NOT (g = '<urn:g:parts>' AND s IN (SELECT '<http://ex/part/' || p_partkey || '>' FROM part WHERE p_brand = 'Brand#3') AND p IN ('<http://ex/brand>', '<http://ex/size>'))")(
    lambda t: _updated(t, "DELETE WHERE { GRAPH <urn:g:parts> { ?s :brand 'Brand#3' ; :size ?z } }"))
query("update_graphs", """SELECT * FROM quads WHERE g = '<urn:g:parts>' UNION ALL SELECT '<urn:g:copy>', s, p, o FROM quads WHERE g = '<urn:g:geo>' UNION ALL SELECT '<urn:g:org>', s, p, o FROM quads WHERE g IN ('<urn:g:geo>', '<urn:g:org>')
UNION ALL SELECT '<urn:g:copy>', '<http://ex/a>', '<http://ex/b>', '"c"'""")(
    lambda t: _updated(t, "COPY <urn:g:geo> TO <urn:g:copy> ; ADD <urn:g:geo> TO <urn:g:org> ; DROP GRAPH <urn:g:geo> ; INSERT DATA { GRAPH <urn:g:copy> { :a :b 'c' } }"))


def _nested(t):
    """Orders below: contains some (suppliedBy some the first supplier of one of their parts)."""
    inner = "(SELECT q.k AS k, p.low AS low FROM (SELECT l_orderkey AS k, min(l_partkey) AS part FROM {lineitem} GROUP BY l_orderkey) q JOIN (SELECT l_partkey AS k, min(l_suppkey) AS low FROM {lineitem} GROUP BY l_partkey) p ON p.k = q.part)"
    rows = leads(inner, iri("order", "k"), "'_:o' || k", "contains", "'_:i' || k") + [(f"'{G}'", "'_:i' || k", f"'<{OWL}onProperty>'", iri("suppliedBy"), inner), (f"'{G}'", "'_:i' || k", f"'<{OWL}someValuesFrom>'", iri("supplier", "low"), inner)]
    rows += [(f"'{G}'", iri("order", "k"), f"'<{RDF}type>'", f"'<{OWL}Class>'", inner)]
    return frame(t, rows)


def _evaluator(quads, t):
    return mos.Evaluator(quads, t.index)


query("mos_nested", f"WITH {_LINKS} SELECT '{G}' AS g, '<http://ex/order/' || o || '>' AS cls FROM o WHERE s_suppkey = 2")(lambda t: _evaluator(_nested(t), t).run("<http://ex/contains> some (<http://ex/suppliedBy> some <http://ex/supplier/2>)"))
query("expression_keys", f"WITH {_LINKS} SELECT count(*) AS nodes, count(DISTINCT s_suppkey) AS keys FROM o")(
    lambda t: expressions.keys(_nested(t)).where("startswith(node, '_:i')").agg(F.count("*").alias("nodes"), F.count_distinct("key").alias("keys")))
# every nation has a twin, each below the other: both keep the region as a parent
query("hierarchy_reduction_cycles", """SELECT 'http://ex/nation/' || n_nationkey AS child, 'http://ex/region/' || n_regionkey AS parent FROM nation UNION ALL SELECT 'http://ex/twin/' || n_nationkey, 'http://ex/region/' || n_regionkey FROM nation
UNION ALL SELECT 'http://ex/nation/' || n_nationkey, 'http://ex/twin/' || n_nationkey FROM nation UNION ALL SELECT 'http://ex/twin/' || n_nationkey, 'http://ex/nation/' || n_nationkey FROM nation
UNION ALL SELECT 'http://ex/customer/' || c_custkey, 'http://ex/' || k || c_nationkey FROM customer CROSS JOIN (VALUES ('nation/'), ('twin/')) v(k) UNION ALL SELECT 'http://ex/supplier/' || s_suppkey, 'http://ex/' || k || s_nationkey FROM supplier CROSS JOIN (VALUES ('nation/'), ('twin/')) v(k)""")(
    lambda t: hierarchy.reduce_direct(hierarchy.reachable(t.edges.where("version_id <> 'parts'").select("child", "parent").unionByName(
        t.nation.select(F.concat(F.lit(EX + "nation/"), "n_nationkey").alias("child"), F.concat(F.lit(EX + "twin/"), "n_nationkey").alias("parent"))).unionByName(
        t.nation.select(F.concat(F.lit(EX + "twin/"), "n_nationkey").alias("child"), F.concat(F.lit(EX + "nation/"), "n_nationkey").alias("parent"))), "child", "parent")).select("child", "parent"))
query("hierarchy_distances", "SELECT 'http://ex/customer/' || c_custkey AS child, 'http://ex/nation/' || c_nationkey AS parent, 1 AS steps FROM customer UNION ALL SELECT 'http://ex/customer/' || c_custkey, 'http://ex/region/' || n_regionkey, 2 FROM customer JOIN nation ON n_nationkey = c_nationkey")(
    lambda t: hierarchy.distances(t.edges, "child", "parent", t.edges.where("child like '%customer%'").select("child")))


def _far(t):
    """Parts in a line by key, each with a property of its own as domain: of part 1's ancestors the nearest thirty count."""
    edges = t.part.select(F.lit("<urn:g:line>").alias("g"), F.concat(F.lit("<http://ex/part/"), F.col("p_partkey"), F.lit(">")).alias("child"), F.concat(F.lit("<http://ex/part/"), F.col("p_partkey") + 1, F.lit(">")).alias("parent")).where("p_partkey <= 60")
    quads = t.part.select(F.lit("<urn:g:line>").alias("g"), F.concat(F.lit("<http://ex/p"), F.col("p_partkey"), F.lit(">")).alias("s"), F.lit(f"<{RDFS}domain>").alias("p"), F.concat(F.lit("<http://ex/part/"), F.col("p_partkey"), F.lit(">")).alias("o"))
    return fleet.inherited_schema_properties(quads, edges, "http://ex/part/1").select("prop_iri")


query("inherited_schema_nearest", "SELECT 'http://ex/p' || p_partkey AS prop_iri FROM part WHERE p_partkey BETWEEN 2 AND 31")(_far)


# profiles: parts lead to suppliers by an existential restriction on the right, which RL doesn't have; of other kinds each position has its own rules
_GRAPHS = "(VALUES ('<urn:g:geo>'), ('<urn:g:org>'), ('<urn:g:parts>')) g(g) CROSS JOIN (VALUES ('EL'), ('QL'), ('RL'), ('DL')) p(profile)"
query("owl_profile_verdicts", f"SELECT g, profile, NOT (g = '<urn:g:parts>' AND profile = 'RL') AS conforms, CASE WHEN g = '<urn:g:parts>' AND profile = 'RL' THEN (SELECT count(DISTINCT l_partkey) FROM lineitem) ELSE 0 END AS violations FROM {_GRAPHS}")(
    lambda t: profiles.verdicts(t.quads))
query("owl_profile_positions", """WITH k AS (SELECT p_partkey % 7 AS k, p_size % 5 AS n FROM part), v AS (
SELECT 'EL' AS profile, CASE k WHEN 0 THEN 'only' WHEN 3 THEN 'max' WHEN 4 THEN 'exactly' ELSE 'min' END AS kind FROM k WHERE k IN (0, 3, 4, 5, 6)
UNION ALL SELECT 'QL', CASE k WHEN 0 THEN 'only' WHEN 1 THEN 'value' WHEN 2 THEN 'self' WHEN 3 THEN 'max' WHEN 4 THEN 'exactly' ELSE 'min' END FROM k
UNION ALL SELECT 'RL', CASE k WHEN 2 THEN 'self' WHEN 3 THEN 'max' WHEN 4 THEN 'exactly' ELSE 'min' END FROM k WHERE k IN (2, 4, 5, 6) OR k = 3 AND n > 1)
SELECT profile, kind || ' on the right' AS kind, count(*) AS n FROM v GROUP BY 1, 2""")(lambda t: profiles.violations(_related(t).quads).groupBy("profile", "kind").agg(F.count("*").alias("n")))
# a chain of places of which one is transitive, counted by customers: not simple, so outside DL
query("owl_profile_dl", "SELECT 'not simple: cardinality' AS kind, 'http://ex/within' AS term FROM customer GROUP BY 1, 2")(lambda t: profiles.violations(frame(t, [
    (f"'{G}'", "'_:c' || c_custkey", f"'<{OWL}onProperty>'", "'<http://ex/within>'", "{customer}"), (f"'{G}'", "'_:c' || c_custkey", f"'<{OWL}maxCardinality>'", "'\"1\"^^<http://www.w3.org/2001/XMLSchema#integer>'", "{customer}"),
    (f"'{G}'", iri("customer", "c_custkey"), f"'{_SUB}'", "'_:c' || c_custkey", "{customer}"), *stated(("<http://ex/within>", f"<{RDF}type>", f"<{OWL}TransitiveProperty>"))])).where("profile = 'DL'").select("kind", F.expr("substring(term, 2, length(term) - 2)").alias("term")))


def _split(t):
    """Triples of two graphs as Turtle files with a prefix, read back in pieces."""
    path = shared_dir(t.spark)
    short = lambda c: F.when(F.col(c).startswith("<http://ex/nation/"), F.concat(F.lit("n:"), F.expr(f"substring({c}, 19, length({c}) - 19)"))).otherwise(F.col(c))
    body = t.quads.where("g <> '<urn:g:parts>'").select(F.concat_ws(" ", short("s"), "p", short("o"), F.lit(".")).alias("value"))
    head = t.spark.createDataFrame([("@prefix n: <http://ex/nation/> .",)], "value string")
    head.unionByName(body).coalesce(1).sortWithinPartitions(~F.col("value").startswith("@")).write.text(path)  # one file, so that there is something to cut
    return splitting.load(t.spark, path, "turtle", "<urn:g:all>").select("s", "p", "o")


query("rdf_turtle_in_pieces", "SELECT s, p, o FROM quads WHERE g <> '<urn:g:parts>'")(_split)
