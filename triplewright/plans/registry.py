"""Queries of the core engine by name, each with SQL that states the same result."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triplewright.functions import terms as T
from triplewright.functions import text as X
from triplewright.operators import axioms, catalogue, hierarchy, indexing, search, versions
from triplewright.plans import mos, sparql
from triplewright.plans.views import Tables, expected
from triplewright.sources import rdf
from triplewright.streaming import usage

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "sparql_group"
PRE = "PREFIX : <http://ex/> PREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#> PREFIX owl: <http://www.w3.org/2002/07/owl#> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> "
EX = "http://ex/"


def query(name: str, sql: str | None = None):
    """Registers a function of Tables under a name, with the SQL of its result."""

    def add(function):
        QUERIES[name] = lambda spark, sf_dir: function(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = expected(sql)
        return function

    return add


def sparql_query(name: str, text: str, sql: str | None, disjoint: bool = True) -> None:
    """disjoint: each kind of row makes triples of one graph; else one graph is there twice under two names, as a default graph that needs duplicate removal."""

    def quads(t: Tables):
        return t.quads if disjoint else t.quads.unionByName(t.quads.where("g = '<urn:g:geo>'").withColumn("g", F.lit("<urn:g:copy>")))

    query(name, sql)(lambda t: sparql.run(quads(t), PRE + text, decode=not text.startswith(("ASK", "CONSTRUCT", "DESCRIBE")), disjoint=disjoint))


# SPARQL
_NATIONS = "SELECT 'http://ex/nation/' || n_nationkey AS s, n_name AS l, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey"
sparql_query("sparql_scan_union", "SELECT ?s ?l WHERE { ?s rdfs:label ?l ; rdfs:subClassOf ?r . ?r a owl:Class ; rdfs:label ?x }", """
SELECT 'http://ex/nation/' || n_nationkey AS s, n_name AS l FROM nation UNION ALL SELECT 'http://ex/supplier/' || s_suppkey, s_name FROM supplier UNION ALL SELECT 'http://ex/customer/' || c_custkey, c_name FROM customer""", disjoint=False)
sparql_query("sparql_group_union", "SELECT ?r (COUNT(?s) AS ?n) WHERE { ?s rdfs:subClassOf ?x . ?x rdfs:label ?r } GROUP BY ?r", """
SELECT r, count(*)::VARCHAR AS n FROM (SELECT r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_name FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey) GROUP BY 1""", disjoint=False)
sparql_query("sparql_avg_distinct", "SELECT ?b WHERE { ?p :brand ?b ; :size ?z } GROUP BY ?b HAVING (ABS(AVG(DISTINCT ?z) * COUNT(DISTINCT ?z) - SUM(DISTINCT ?z)) < 0.001 && ABS(AVG(?z) * COUNT(?z) - SUM(?z)) < 0.001)", "SELECT DISTINCT p_brand AS b FROM part")
sparql_query("sparql_big_integers", "SELECT ?s (?z + 9007199254740993 AS ?x) (?z * 3000000000000 AS ?y) WHERE { ?s :size ?z }", """
SELECT 'http://ex/part/' || p_partkey AS s, (p_size::HUGEINT + 9007199254740993)::VARCHAR AS x, (p_size::HUGEINT * 3000000000000)::VARCHAR AS y FROM part""")
sparql_query("sparql_date_fields", """SELECT ?s (HOURS(?d) AS ?h) (MINUTES(?d) AS ?m) (SECONDS(?d) AS ?q) (YEAR(?d) AS ?y) (TIMEZONE(?d) AS ?z) (TZ(?d) AS ?t)
WHERE { ?s a owl:Class ; rdfs:subClassOf ?r . ?r rdfs:label ?l BIND("2024-03-05T23:07:08.25-05:30"^^xsd:dateTime AS ?d) }""", """
SELECT s, '23' AS h, '7' AS m, '8.25' AS q, '2024' AS y, '-PT5H30M' AS z, '-05:30' AS t FROM (SELECT 'http://ex/nation/' || n_nationkey AS s FROM nation UNION ALL SELECT 'http://ex/supplier/' || s_suppkey FROM supplier)""")
sparql_query("sparql_exists_or", "SELECT ?s WHERE { ?s rdfs:subClassOf ?x FILTER(EXISTS { ?s a owl:NamedIndividual } || !EXISTS { ?x rdfs:subClassOf ?y } || ?s = <http://ex/supplier/1>) }", """
SELECT 'http://ex/customer/' || c_custkey AS s FROM customer UNION ALL SELECT 'http://ex/nation/' || n_nationkey FROM nation UNION ALL SELECT 'http://ex/part/' || l_partkey FROM (SELECT DISTINCT l_partkey FROM lineitem) UNION ALL SELECT 'http://ex/supplier/1'""")
sparql_query("sparql_graph_path", "SELECT ?g ?s ?o WHERE { GRAPH ?g { ?s rdfs:subClassOf+ ?o . ?s a owl:Class } }", """
SELECT 'urn:g:geo' AS g, 'http://ex/nation/' || n_nationkey AS s, 'http://ex/region/' || n_regionkey AS o FROM nation UNION ALL SELECT 'urn:g:org', 'http://ex/supplier/' || s_suppkey, 'http://ex/nation/' || s_nationkey FROM supplier
UNION ALL SELECT 'urn:g:parts', 'http://ex/part/' || l_partkey, NULL FROM (SELECT DISTINCT l_partkey FROM lineitem)""")
sparql_query("sparql_optional_twice", "SELECT ?s ?l ?r WHERE { ?s rdfs:subClassOf ?x . ?s a owl:Class OPTIONAL { ?x a owl:Class . ?x rdfs:label ?l FILTER(STR(?l) < 'F') } OPTIONAL { ?x rdfs:label ?l . ?x rdfs:subClassOf ?y . ?y rdfs:label ?r } }", """
SELECT 'http://ex/nation/' || n_nationkey AS s, CASE WHEN r_name < 'F' THEN r_name END AS l, NULL AS r FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'http://ex/supplier/' || s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'http://ex/part/' || l_partkey, NULL, NULL FROM (SELECT DISTINCT l_partkey FROM lineitem)""")
sparql_query("sparql_scan", "SELECT ?s ?l WHERE { ?s rdfs:label ?l ; a owl:Class ; rdfs:subClassOf ?r }", """
SELECT 'http://ex/nation/' || n_nationkey AS s, n_name AS l FROM nation UNION ALL SELECT 'http://ex/supplier/' || s_suppkey, s_name FROM supplier
UNION ALL SELECT 'http://ex/part/' || p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)""")
sparql_query("sparql_join", "SELECT ?c ?n ?r WHERE { ?c rdfs:subClassOf ?x ; a owl:NamedIndividual . ?x rdfs:label ?n ; rdfs:subClassOf ?y . ?y rdfs:label ?r }", """
SELECT 'http://ex/customer/' || c_custkey AS c, n_name AS n, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
sparql_query("sparql_graph", "SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?s ?p ?o } } GROUP BY ?g", "SELECT substr(g, 2, length(g) - 2) AS g, CAST(count(*) AS VARCHAR) AS n FROM quads GROUP BY 1")
sparql_query("sparql_from", "SELECT (COUNT(DISTINCT ?s) AS ?n) FROM <urn:g:geo> WHERE { ?s ?p ?o }", "SELECT CAST(count(DISTINCT s) AS VARCHAR) AS n FROM quads WHERE g = '<urn:g:geo>'")
sparql_query("sparql_optional", "SELECT ?s ?z WHERE { ?s a owl:Class OPTIONAL { ?s :size ?z FILTER(?z > 25) } }", """
SELECT 'http://ex/part/' || p_partkey AS s, CASE WHEN p_size > 25 THEN CAST(p_size AS VARCHAR) END AS z FROM part
UNION ALL SELECT 'http://ex/supplier/' || s_suppkey, NULL FROM supplier UNION ALL SELECT 'http://ex/nation/' || n_nationkey, NULL FROM nation UNION ALL SELECT 'http://ex/region/' || r_regionkey, NULL FROM region""")
sparql_query("sparql_union", "SELECT ?l WHERE { { ?s rdfs:subClassOf <http://ex/region/1> ; rdfs:label ?l } UNION { ?s rdfs:subClassOf <http://ex/nation/1> ; rdfs:label ?l } }", """
SELECT n_name AS l FROM nation WHERE n_regionkey = 1 UNION ALL SELECT c_name FROM customer WHERE c_nationkey = 1 UNION ALL SELECT s_name FROM supplier WHERE s_nationkey = 1""")
sparql_query("sparql_minus", "SELECT ?s WHERE { ?s :size ?z MINUS { ?s :brand 'Brand#1' } }", "SELECT 'http://ex/part/' || p_partkey AS s FROM part WHERE p_brand <> 'Brand#1'")
sparql_query("sparql_not_exists", "SELECT ?n WHERE { ?n rdfs:subClassOf ?r . ?r rdfs:label ?l FILTER NOT EXISTS { ?x rdfs:subClassOf ?n } FILTER(STRSTARTS(STR(?n), 'http://ex/nation')) }", """
SELECT 'http://ex/nation/' || n_nationkey AS n FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer) AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier)""")
sparql_query("sparql_exists", "SELECT ?n WHERE { ?n a owl:Class FILTER EXISTS { ?s rdfs:subClassOf ?n ; a owl:Class } }", """
SELECT 'http://ex/nation/' || n_nationkey AS n FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier) UNION SELECT 'http://ex/region/' || n_regionkey FROM nation""")
sparql_query("sparql_filter", "SELECT ?s WHERE { ?s :size ?z ; rdfs:label ?l FILTER((?z >= 10 && ?z < 20 || ?z = 50) && !CONTAINS(?l, 'ring')) }", """
SELECT 'http://ex/part/' || p_partkey AS s FROM part WHERE (p_size >= 10 AND p_size < 20 OR p_size = 50) AND p_name NOT LIKE '%ring%'""")
# literals of seven kinds by the part's key; what has no order or can't be told apart is an error, which leaves a variable unbound
_KINDS = """SELECT '<urn:g:v>' AS g, '<http://ex/part/' || p_partkey || '>' AS s, '<http://ex/value>' AS p, CASE p_partkey % 7 WHEN 0 THEN '"' || p_size || '"^^<http://www.w3.org/2001/XMLSchema#integer>'
WHEN 1 THEN '"' || p_size || '.5"^^<http://www.w3.org/2001/XMLSchema#decimal>' WHEN 2 THEN '"' || p_name || '"' WHEN 3 THEN '"' || p_name || '"@en' WHEN 4 THEN '"19' || lpad(p_size, 2, '0') || '-01-02T00:00:00Z"^^<http://www.w3.org/2001/XMLSchema#dateTime>'
WHEN 5 THEN CASE WHEN p_size < 25 THEN '"true"' ELSE '"false"' END || '^^<http://www.w3.org/2001/XMLSchema#boolean>' ELSE '"' || p_size || '"^^<http://ex/own>' END AS o FROM {part}"""
query("sparql_kinds", """SELECT 'http://ex/part/' || p_partkey AS s, CASE k WHEN 0 THEN p_size > 20 WHEN 1 THEN p_size >= 20 END::VARCHAR AS a, CASE k WHEN 2 THEN p_name < 'old' END::VARCHAR AS b,
CASE k WHEN 4 THEN p_size > 50 END::VARCHAR AS c, CASE k WHEN 5 THEN p_size >= 25 END::VARCHAR AS d, CASE WHEN k = 6 THEN NULL WHEN k = 0 THEN p_size <> 20 ELSE true END::VARCHAR AS e, CASE WHEN k = 6 AND p_size = 7 THEN true END::VARCHAR AS f,
CASE WHEN k = 0 AND p_size > 20 OR k = 1 AND p_size >= 20 THEN 'more' WHEN k < 2 THEN 'less' END AS i FROM (SELECT *, p_partkey % 7 AS k FROM part)""")(
    lambda t: sparql.run(t.spark.sql(_KINDS, part=t.part), PRE + """SELECT ?s (?v > 20 AS ?a) (?v < "old" AS ?b) (?v > "1950-01-02T01:00:00+01:00"^^xsd:dateTime AS ?c) (?v < true AS ?d) (?v != 20 AS ?e) (?v = "7"^^:own AS ?f) (IF(?v > 20, "more", "less") AS ?i) WHERE { ?s :value ?v }""", decode=True, disjoint=True))
query("sparql_kinds_filter", """SELECT 'http://ex/part/' || p_partkey AS s FROM part WHERE p_partkey % 7 = 0 AND p_size > 1 OR p_partkey % 7 = 1 AND p_size >= 1""")(
    lambda t: sparql.run(t.spark.sql(_KINDS, part=t.part), PRE + "SELECT ?s WHERE { ?s :value ?v FILTER(?v > 1) }", decode=True, disjoint=True))
# a sum over what isn't all numbers is an error
query("sparql_sum_error", "SELECT p_brand AS b, CASE WHEN bool_and(p_partkey % 7 < 1) THEN sum(p_size)::VARCHAR END AS n FROM part GROUP BY 1")(
    lambda t: sparql.run(t.spark.sql(_KINDS, part=t.part).unionByName(t.quads.where("p = '<http://ex/brand>'")), PRE + "SELECT ?b (SUM(?v) AS ?n) WHERE { ?s :value ?v ; :brand ?b } GROUP BY ?b", decode=True, disjoint=True))
sparql_query("sparql_bind", "SELECT ?s ?d WHERE { ?s :size ?z BIND(?z * 2 - 1 AS ?d) }", "SELECT 'http://ex/part/' || p_partkey AS s, CAST(p_size * 2 - 1 AS VARCHAR) AS d FROM part")
sparql_query("sparql_values", "SELECT ?s ?k WHERE { VALUES (?b ?k) { ('Brand#1' 'one') ('Brand#2' 'two') } ?s :brand ?b }", """
SELECT 'http://ex/part/' || p_partkey AS s, CASE p_brand WHEN 'Brand#1' THEN 'one' ELSE 'two' END AS k FROM part WHERE p_brand IN ('Brand#1', 'Brand#2')""")
sparql_query("sparql_subselect", "SELECT ?b ?m WHERE { { SELECT ?b (MAX(?z) AS ?m) WHERE { ?s :brand ?b ; :size ?z } GROUP BY ?b } FILTER(?m >= 50) }", "SELECT p_brand AS b, CAST(max(p_size) AS VARCHAR) AS m FROM part GROUP BY 1 HAVING max(p_size) >= 50")
sparql_query("sparql_distinct", "SELECT DISTINCT ?b WHERE { ?s :brand ?b }", "SELECT DISTINCT p_brand AS b FROM part")
sparql_query("sparql_order", "SELECT ?s ?z WHERE { ?s :size ?z } ORDER BY DESC(?z) ?s LIMIT 25 OFFSET 5", """
SELECT 'http://ex/part/' || p_partkey AS s, CAST(p_size AS VARCHAR) AS z FROM part ORDER BY p_size DESC, s LIMIT 25 OFFSET 5""")
sparql_query("sparql_group", "SELECT ?r (COUNT(?c) AS ?n) (COUNT(DISTINCT ?x) AS ?nations) WHERE { ?c rdfs:subClassOf ?x . ?x rdfs:subClassOf ?y . ?y rdfs:label ?r } GROUP BY ?r", """
SELECT r_name AS r, CAST(count(*) AS VARCHAR) AS n, CAST(count(DISTINCT k) AS VARCHAR) AS nations FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) x
JOIN nation ON k = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
sparql_query("sparql_aggregates", "SELECT ?b (SUM(?z) AS ?total) (MIN(?z) AS ?lo) (MAX(?z) AS ?hi) (SAMPLE(?b) AS ?one) WHERE { ?s :brand ?b ; :size ?z } GROUP BY ?b", """
SELECT p_brand AS b, CAST(sum(p_size) AS VARCHAR) AS total, CAST(min(p_size) AS VARCHAR) AS lo, CAST(max(p_size) AS VARCHAR) AS hi, p_brand AS one FROM part GROUP BY 1""")
sparql_query("sparql_group_concat", "SELECT ?r (GROUP_CONCAT(?l; SEPARATOR=', ') AS ?all) WHERE { ?n rdfs:subClassOf ?r ; rdfs:label ?l . ?r rdfs:label ?x . FILTER(STRSTARTS(STR(?r), 'http://ex/region')) } GROUP BY ?r", """
SELECT 'http://ex/region/' || n_regionkey AS r, string_agg(n_name, ', ' ORDER BY n_name) AS "all" FROM nation GROUP BY 1""")
sparql_query("sparql_having", "SELECT ?b (COUNT(*) AS ?n) WHERE { ?s :brand ?b } GROUP BY ?b HAVING(COUNT(*) > 70)", "SELECT p_brand AS b, CAST(count(*) AS VARCHAR) AS n FROM part GROUP BY 1 HAVING count(*) > 70")
sparql_query("sparql_path_sequence", "SELECT ?c WHERE { ?c rdfs:subClassOf/rdfs:subClassOf <http://ex/region/2> }", """
SELECT 'http://ex/customer/' || c_custkey AS c FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2 UNION ALL SELECT 'http://ex/supplier/' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2""")
sparql_query("sparql_path_alternative", "SELECT ?v WHERE { <http://ex/part/3> (:brand|:size|rdfs:label) ?v }", "SELECT unnest([p_brand, CAST(p_size AS VARCHAR), p_name]) AS v FROM part WHERE p_partkey = 3")
sparql_query("sparql_path_inverse", "SELECT ?s WHERE { <http://ex/nation/3> ^rdfs:subClassOf ?s }", "SELECT 'http://ex/customer/' || c_custkey AS s FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'http://ex/supplier/' || s_suppkey FROM supplier WHERE s_nationkey = 3")
sparql_query("sparql_path_plus", "SELECT ?c WHERE { ?c rdfs:subClassOf+ <http://ex/region/0> }", """
SELECT 'http://ex/nation/' || n_nationkey AS c FROM nation WHERE n_regionkey = 0 UNION ALL SELECT 'http://ex/customer/' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 0
UNION ALL SELECT 'http://ex/supplier/' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 0""")
sparql_query("sparql_path_star", "SELECT ?x WHERE { <http://ex/customer/7> rdfs:subClassOf* ?x }", """
SELECT unnest(['http://ex/customer/7', 'http://ex/nation/' || n_nationkey, 'http://ex/region/' || n_regionkey]) AS x FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 7""")
sparql_query("sparql_path_negated", "SELECT ?v WHERE { <http://ex/part/3> !(rdfs:label|rdfs:subClassOf|a) ?v }", "SELECT unnest([p_brand, CAST(p_size AS VARCHAR)]) AS v FROM part WHERE p_partkey = 3")
sparql_query("sparql_ask", "ASK { ?s :size 50 }", "SELECT count(*) > 0 AS answer FROM part WHERE p_size = 50")
sparql_query("sparql_construct", "CONSTRUCT { ?r :has ?n } WHERE { ?n rdfs:subClassOf ?r . ?r a owl:Class ; rdfs:label ?l FILTER(STRSTARTS(STR(?r), 'http://ex/region')) }", """
SELECT DISTINCT '<http://ex/region/' || n_regionkey || '>' AS s, '<http://ex/has>' AS p, '<http://ex/nation/' || n_nationkey || '>' AS o FROM nation""")
sparql_query("sparql_describe", "DESCRIBE <http://ex/part/5>", "SELECT DISTINCT s, p, o FROM quads WHERE s IN ('<http://ex/part/5>', '_:r5')")
sparql_query("sparql_terms", "SELECT ?s ?g ?d WHERE { ?s rdfs:label ?l BIND(LANG(?l) AS ?g) BIND(STR(DATATYPE(?l)) AS ?d) FILTER(isLiteral(?l) && isIRI(?s) && langMatches(LANG(?l), 'EN')) }", """
SELECT substr(s, 2, length(s) - 2) AS s, 'en' AS g, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#langString' AS d FROM (SELECT DISTINCT s, o FROM quads WHERE p LIKE '%#label>') x""")
sparql_query("sparql_functions", "SELECT ?s ?a ?b ?c ?h WHERE { ?s :brand ?l BIND(UCASE(STRBEFORE(?l, '#')) AS ?a) BIND(STRLEN(?l) AS ?b) BIND(CONCAT(SUBSTR(?l, 1, 2), STRAFTER(?l, '#')) AS ?c) BIND(MD5(?l) AS ?h) FILTER(REGEX(?l, '#1[0-5]$')) }", """
SELECT 'http://ex/part/' || p_partkey AS s, 'BRAND' AS a, CAST(length(p_brand) AS VARCHAR) AS b, 'Br' || split_part(p_brand, '#', 2) AS c, md5(p_brand) AS h FROM part WHERE regexp_matches(p_brand, '#1[0-5]$')""")

# entities and text
query("entity_types", "SELECT s, CASE WHEN o LIKE '%#Class>' THEN 'class' ELSE 'individual' END AS type, o LIKE '%Individual>' AS is_individual FROM quads WHERE p LIKE '%#type>'")(
    lambda t: indexing.entity_types(t.quads).select("s", "type", "is_individual"))
query("entity_index", """
SELECT substr(q.s, 2, length(q.s) - 2) AS iri, CASE WHEN q.o LIKE '%#Class>' THEN 'class' ELSE 'individual' END AS type, split_part(substr(q.s, 2, length(q.s) - 2), '/', 5) AS short, regexp_extract(l.o, '^"(.*)"', 1) AS label,
trim(regexp_replace(regexp_replace(lower(regexp_extract(l.o, '^"(.*)"', 1)), '[^a-z0-9_\\s:<>]', ' ', 'g'), '\\s+', ' ', 'g')) AS norm,
NOT EXISTS (SELECT 1 FROM quads x WHERE x.s = q.s AND x.p LIKE '%#subClassOf>' AND x.o LIKE '<%') AS is_root
FROM quads q JOIN quads l ON q.s = l.s AND l.p LIKE '%#label>' WHERE q.p LIKE '%#type>'""")(lambda t: indexing.entity_index(t.quads).select("iri", "type", "short", "label", "norm", "is_root"))
query("language_counts", "SELECT g, 'en' AS lang, count(*) AS n FROM quads WHERE p LIKE '%#label>' GROUP BY 1")(lambda t: indexing.language_counts(t.quads, indexing.LABELS + indexing.DEFINITIONS))
query("role_properties", """
SELECT g, p, count(DISTINCT s) AS n FROM quads WHERE p IN ('<http://www.w3.org/2000/01/rdf-schema#label>', '<http://ex/brand>') AND s IN (SELECT s FROM quads WHERE o LIKE '%owl#Class>') GROUP BY 1, 2""")(
    lambda t: indexing.role_properties(t.quads, [indexing.RDFS + "label", EX + "brand"]).select("g", "p", "n"))
query("unknown_properties", """
WITH c AS (SELECT g, s FROM quads WHERE o LIKE '%owl#Class>'), n AS (SELECT g, count(*) AS classes FROM c GROUP BY 1)
SELECT q.g, q.p, count(DISTINCT q.s) AS n, round(100.0 * count(DISTINCT q.s) / any_value(classes), 2) AS pct FROM quads q JOIN c ON q.g = c.g AND q.s = c.s JOIN n ON q.g = n.g
WHERE q.o LIKE '"%' AND q.p NOT LIKE '%#label>' GROUP BY 1, 2""")(lambda t: indexing.unknown_properties(t.quads, [indexing.RDFS + "label"]))
query("labels_normalised", """
SELECT p_partkey, lower(p_name) AS norm, 'P_' || p_partkey AS short, upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) || ' ' || p_partkey AS words FROM part""")(
    lambda t: t.part.select("p_partkey", X.normalise_label(F.concat(F.lit("The "), F.col("p_name"), F.lit("!"))).alias("norm"), X.local_name(F.concat(F.lit("http://x/y#P_"), F.col("p_partkey"))).alias("short"),
                            X.humanise(F.concat(F.initcap("p_type"), F.lit("_"), F.col("p_partkey"))).alias("words")))
query("labels_corrupt", """
SELECT doc_id, (length(text) - length(replace(text, '?', ''))) >= 2 AND (text LIKE '%??%' OR (length(text) - length(replace(text, '?', ''))) >= 0.2 * length(regexp_replace(text, '\\s', '', 'g'))) AS corrupt FROM documents""")(
    lambda t: t.documents.select("doc_id", X.corrupt_label(F.col("text")).alias("corrupt")))
query("languages_canonical", "SELECT lang, count(*) AS n FROM documents GROUP BY 1")(lambda t: t.documents.groupBy(X.canonical_language(F.concat(F.upper("lang"), F.lit("-XX"))).alias("lang")).agg(F.count("*").alias("n")))
query("label_choice", "SELECT doc_id, CASE lang WHEN 'de' THEN 'own' WHEN 'en' THEN 'own' ELSE 'none' END AS label FROM documents")(
    lambda t: t.documents.select("doc_id", F.coalesce(X.choose_from_list(F.array(F.struct(F.lit("none").alias("value"), F.lit("xx").alias("lang")), F.struct(F.lit("own").alias("value"), F.col("lang"))), "de")["value"], F.lit("")).alias("label")))
query("iri_identity", "SELECT c_custkey, 'http://ex/o' || c_custkey AS id, 'file' AS why, 'o' || c_custkey AS curie FROM customer")(
    lambda t: t.customer.select("c_custkey", *(lambda iri: (X.canonical_iri(iri).alias("id"), X.instability(iri).alias("why"), X.display_name(F.lit(""), iri).alias("curie")))(F.concat(F.lit("http://ex/o"), F.col("c_custkey"), F.lit("/o"), F.col("c_custkey"), F.lit(".owl")))))
query("shortnames", "SELECT r_regionkey, replace(lower(r_name), ' ', '-') AS short FROM region")(lambda t: t.region.select("r_regionkey", X.shortname(F.lit(None).cast("string"), F.col("r_name"), F.lit("http://x/y")).alias("short")))
query("url_parts", "SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://(?:[^/?#@]*@)?([^/:?#]*)', 1)) AS host, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '^[^:/]+://[^/]*/(?:.*/)?[^/]*\\.([A-Za-z0-9]+)$', 1)) AS extension FROM pages")(lambda t: t.pages.select("page_id", X.host(F.col("url")).alias("host"), X.extension(F.col("url")).alias("extension")))
query("licenses", """
SELECT id, CASE license WHEN '1-URGENT' THEN 'CC-BY-4.0' WHEN '2-HIGH' THEN 'CC0-1.0' WHEN '3-MEDIUM' THEN 'MIT' WHEN '5-LOW' THEN 'CC-BY-SA-3.0' END AS spdx FROM versions""")(
    lambda t: t.versions.select("id", X.spdx(F.when(F.col("license") == "1-URGENT", "https://creativecommons.org/licenses/by/4.0/").when(F.col("license") == "2-HIGH", "CC0 public domain").when(F.col("license") == "3-MEDIUM", "The MIT License").when(F.col("license") == "5-LOW", "CC BY-SA 3.0")).alias("spdx")))

# search
query("search_prefix", """
SELECT 'http://ex/part/' || p_partkey AS iri, p_name AS label, 1 AS tier FROM part WHERE p_name LIKE 'red%' ORDER BY CASE WHEN p_name = 'red' THEN 0 ELSE 1 END, length(p_name), p_name, iri LIMIT 20""")(
    lambda t: t.search_index.search("Red", 20).select("iri", "label", "tier"))
query("search_text", """
SELECT 'http://ex/part/' || p_partkey AS iri, p_name AS label, 2 AS tier FROM part WHERE p_name LIKE '%widget%' AND p_name LIKE 'blue%' ORDER BY length(p_name), p_name, iri LIMIT 20""")(
    lambda t: t.search_index.search("widget blu", 20).select("iri", "label", "tier"))
# a share of the query's seven trigrams in one word of a label
query("search_fuzzy", f"""
WITH w AS (SELECT iri, label, unnest(regexp_split_to_array(lower(label), '[^a-z0-9]+')) AS word FROM entities),
g AS (SELECT iri, label, len(list_intersect(list_transform(range(1, length(word) + 2), lambda i: substr('  ' || word || ' ', i, 3)), ['  w', ' wi', 'wid', 'idg', 'dgi', 'git', 'it '])) / 7.0 AS share FROM w WHERE word <> '')
SELECT iri FROM (SELECT iri, label, round(max(share), 6) AS share FROM g GROUP BY 1, 2) WHERE share >= {search.SIMILAR} ORDER BY share DESC, length(label), label, iri LIMIT 10""")(lambda t: t.search_index.autocomplete("widgit", 10).select("iri"))
query("search_vectors", """
WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 7)
SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], v::DOUBLE[]) / (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_inner_product(v::DOUBLE[], v::DOUBLE[]))), 4) AS score
FROM embeddings, q WHERE vec_id <> 7 ORDER BY score DESC, vec_id LIMIT 15""")(lambda t: search.neighbours(t.embeddings, 7, 15))
query("search_fusion", """
WITH a AS (SELECT p_partkey AS k, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS r FROM part), b AS (SELECT p_partkey AS k, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r FROM part),
x AS (SELECT k, r, 0 AS l FROM a WHERE r <= 30 UNION ALL SELECT k, r, 1 FROM b WHERE r <= 30) SELECT k AS iri, round(sum(1.0 / (60 + r)), 5) AS score FROM x GROUP BY 1""")(
    lambda t: (lambda top: search.fuse(top("p_size"), top("p_retailprice")))(lambda c: t.part.orderBy(F.desc(c), "p_partkey").limit(30).select(F.col("p_partkey").alias("iri"), F.row_number().over(W.orderBy(F.desc(c), "p_partkey")).alias("rank"))))
query("search_facets", "SELECT version_id, count(*) AS n FROM entities GROUP BY 1")(lambda t: search.facets(t.entities))
query("search_keyset", "SELECT iri, label FROM entities WHERE (label, iri) > ('Customer#000000010', '') ORDER BY label, iri LIMIT 50")(
    lambda t: t.entities.where(F.struct("label", "iri") > F.struct(F.lit("Customer#000000010").alias("label"), F.lit("").alias("iri"))).orderBy("label", "iri").limit(50).select("iri", "label"))
query("search_by_iri", "SELECT rank, iri, label FROM (VALUES (0, 'http://ex/part/9'), (1, 'http://ex/nation/2'), (2, 'http://ex/part/1')) v(rank, iri) JOIN entities USING (iri)")(
    lambda t: search.fetch_ranked(t.index, [EX + "part/9", EX + "nation/2", EX + "part/1"]).select("rank", "iri", "label"))
query("search_disambiguated", "SELECT iri, CASE WHEN count(*) OVER (PARTITION BY label) > 1 THEN label || ' (' || short || ')' ELSE label END AS label FROM entities WHERE version_id <> 'org'")(
    lambda t: search.disambiguated(t.entities.where("version_id <> 'org'")).select("iri", "label"))
query("search_embedding_text", "SELECT iri, label || '.' || CASE WHEN definition <> '' THEN ' ' || definition ELSE '' END || CASE WHEN source <> '' THEN ' Synonyms: ' || source || '.' ELSE '' END AS text FROM entities")(
    lambda t: t.entities.select("iri", search.embedding_text(F.col("label"), F.col("definition"), F.when(F.col("source") != "", F.array("source")).otherwise(F.array()), F.array().cast("array<string>"), F.array().cast("array<string>")).alias("text")))
query("search_changed_texts", "SELECT iri, sha256(label) AS text_hash FROM entities WHERE version_id = 'parts' AND CAST(split_part(iri, '/', 5) AS BIGINT) % 3 <> 0")(
    lambda t: (lambda e: search.changed_texts(e, e.where(F.split_part("iri", F.lit("/"), F.lit(5)).cast("long") % 3 == 0).select("iri", F.sha2("text", 256).alias("text_hash"))).select("iri", "text_hash"))(t.entities.where("version_id = 'parts'").select("iri", F.col("label").alias("text"))))

# hierarchy
query("hierarchy_edges", "SELECT g, substr(s, 2, length(s) - 2) AS child, substr(o, 2, length(o) - 2) AS parent, 'class' AS kind FROM quads WHERE p LIKE '%#subClassOf>' AND o LIKE '<%'")(lambda t: hierarchy.extract_edges(t.quads))
query("hierarchy_roots", "SELECT iri, iri IN (SELECT parent FROM edges) AS has_children FROM entities WHERE iri NOT IN (SELECT child FROM edges)")(lambda t: hierarchy.roots(t.entities, t.edges).select("iri", "has_children"))
query("hierarchy_children", "SELECT iri, label, iri IN (SELECT parent FROM edges) AS has_children FROM entities WHERE iri IN (SELECT child FROM edges WHERE parent = 'http://ex/region/1')")(
    lambda t: hierarchy.one_hop(t.entities, t.edges, EX + "region/1").select("iri", "label", "has_children"))
query("hierarchy_parents", "SELECT iri, label FROM entities WHERE iri IN (SELECT parent FROM edges WHERE child = 'http://ex/customer/11')")(lambda t: hierarchy.one_hop(t.entities, t.edges, EX + "customer/11", "parents").select("iri", "label"))
query("hierarchy_descendants", """/*recursive*/ WITH w AS (SELECT child FROM edges WHERE parent = 'http://ex/region/3' UNION SELECT e.child FROM edges e JOIN w ON e.parent = w.child) SELECT iri FROM entities WHERE iri IN (SELECT child FROM w)""")(
    lambda t: hierarchy.walk(t.entities, t.edges, EX + "region/3").select("iri"))
query("hierarchy_ancestors", """/*recursive*/ WITH w AS (SELECT parent FROM edges WHERE child = 'http://ex/supplier/4' UNION SELECT e.parent FROM edges e JOIN w ON e.child = w.parent) SELECT iri FROM entities WHERE iri IN (SELECT parent FROM w)""")(
    lambda t: hierarchy.walk(t.entities, t.edges, EX + "supplier/4", "ancestors").select("iri"))
query("hierarchy_closure", """/*recursive*/ WITH w AS (SELECT child, parent FROM edges UNION SELECT w.child, e.parent FROM w JOIN edges e ON w.parent = e.child) SELECT child, parent FROM w""")(
    lambda t: hierarchy.reachable(t.edges, "child", "parent"))
query("hierarchy_reduction", "SELECT DISTINCT child, parent FROM edges")(lambda t: hierarchy.reduce_direct(hierarchy.reachable(t.edges, "child", "parent")))
query("hierarchy_inferred", """/*recursive*/ WITH w AS (SELECT child, parent FROM edges UNION SELECT w.child, e.parent FROM w JOIN edges e ON w.parent = e.child)
SELECT child, parent FROM w WHERE (child, parent) NOT IN (SELECT (child, parent) FROM edges)""")(lambda t: hierarchy.inferred_superclasses(t.edges, t.edges))
query("hierarchy_replace", "SELECT version_id, child, parent, kind FROM edges WHERE version_id <> 'geo' UNION ALL SELECT 'geo', 'http://ex/new', 'http://ex/region/0', 'class'")(
    lambda t: hierarchy.replace_edges(t.edges, t.spark.createDataFrame([("geo", EX + "new", EX + "region/0", "class")], "version_id string, child string, parent string, kind string"), ["class"]))
query("hierarchy_path", "SELECT 'http://ex/customer/5' || ' > ' || 'http://ex/nation/' || n_nationkey || ' > ' || 'http://ex/region/' || n_regionkey AS path FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 5")(
    lambda t: (lambda region: t.spark.createDataFrame([(" > ".join(hierarchy.shortest_path(t.edges, EX + "customer/5", region) or []),)], "path string"))(
        t.customer.where("c_custkey = 5").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit(EX + "region/"), F.col("n_regionkey"))).first()[0]))
query("classification_el", """/*recursive*/ WITH e AS (SELECT version_id, child, parent FROM edges WHERE version_id <> 'parts'), w AS (SELECT version_id, child, parent FROM e UNION SELECT w.version_id, w.child, e.parent FROM w JOIN e ON w.parent = e.child AND w.version_id = e.version_id)
SELECT '<urn:g:' || version_id || '>' AS g, child, parent FROM w""")(lambda t: axioms.classify_el(t.quads))
# a class per nation of what something of that nation supplies, suppliers below nations in the same graph: parts are in the nation's class by an existential rule, and in a class of two conditions by an intersection
query("classification_existential", """
WITH k AS (SELECT l_partkey, min(l_suppkey) AS s FROM lineitem GROUP BY 1), n AS (SELECT l_partkey, s_nationkey AS n, s_suppkey AS s FROM k JOIN supplier ON s = s_suppkey)
SELECT '<urn:g:parts>' AS g, 'http://ex/part/' || l_partkey AS child, 'http://ex/from/' || n AS parent FROM n
UNION ALL SELECT '<urn:g:parts>', 'http://ex/part/' || l_partkey, 'http://ex/stated' FROM n WHERE n % 2 = 0
UNION ALL SELECT '<urn:g:parts>', 'http://ex/part/' || l_partkey, 'http://ex/both' FROM n WHERE n = 4
UNION ALL SELECT '<urn:g:parts>', 'http://ex/both', 'http://ex/from/4' UNION ALL SELECT '<urn:g:parts>', 'http://ex/both', 'http://ex/stated'
UNION ALL SELECT '<urn:g:parts>', 'http://ex/from/' || n_nationkey, 'http://ex/stated' FROM nation WHERE n_nationkey % 2 = 0
UNION ALL SELECT '<urn:g:parts>', 'http://ex/from/4', 'http://ex/both'
UNION ALL SELECT '<urn:g:parts>', 'http://ex/supplier/' || s_suppkey, 'http://ex/nation/' || s_nationkey FROM supplier""")(lambda t: axioms.classify_el(_existential(t)))


def _existential(t: Tables):
    """The parts' graph with a class http://ex/from/N = suppliedBy some nation N, even ones below http://ex/stated, and http://ex/both = from/4 and stated."""
    owl, rdf_, rdfs = axioms.OWL, axioms.RDF, axioms.RDFS
    n, nation = F.col("n_nationkey").cast("string"), t.nation
    row = lambda s, p, o: F.struct(s.alias("s"), F.lit(f"<{p}>").alias("p"), o.alias("o"))
    named = lambda kind, k: F.concat(F.lit(f"<{EX}{kind}/"), k, F.lit(">"))
    node = F.concat(F.lit("_:from"), n)
    rows = F.array(row(named("from", n), owl + "equivalentClass", node), row(node, owl + "onProperty", F.lit(f"<{EX}suppliedBy>")), row(node, owl + "someValuesFrom", named("nation", n)))
    classes = nation.select(F.explode(rows).alias("x")).unionByName(nation.where("n_nationkey % 2 = 0").select(row(named("from", n), rdfs + "subClassOf", F.lit(f"<{EX}stated>")).alias("x")))
    below = t.supplier.select(row(named("supplier", F.col("s_suppkey").cast("string")), rdfs + "subClassOf", named("nation", F.col("s_nationkey").cast("string"))).alias("x"))
    both = [(f"<{EX}both>", f"<{owl}equivalentClass>", "_:i"), ("_:i", f"<{owl}intersectionOf>", "_:l"), ("_:l", f"<{rdf_}first>", f"<{EX}from/4>"), ("_:l", f"<{rdf_}rest>", "_:m"), ("_:m", f"<{rdf_}first>", f"<{EX}stated>"), ("_:m", f"<{rdf_}rest>", f"<{rdf_}nil>")]
    more = classes.unionByName(below).select("x.*").unionByName(t.spark.createDataFrame(both, "s string, p string, o string")).withColumn("g", F.lit("<urn:g:parts>"))
    return t.quads.where(f"g = '<urn:g:parts>' and p <> '<{rdfs}label>'").unionByName(more.select("g", "s", "p", "o"))


# axioms and class expressions
query("axiom_restrictions", "SELECT '_:r' || l_partkey AS node, '<http://ex/suppliedBy>' AS prop, 'some' AS kind, '<http://ex/supplier/' || min(l_suppkey) || '>' AS filler FROM lineitem GROUP BY l_partkey")(
    lambda t: axioms.restrictions(t.quads).select("node", "prop", "kind", "filler"))
query("axiom_property_usage", "SELECT '<http://ex/part/' || l_partkey || '>' AS cls, 'sub' AS relation, 'some' AS kind, '<http://ex/supplier/' || min(l_suppkey) || '>' AS filler FROM lineitem GROUP BY l_partkey ORDER BY 1, 2, 3, 4 LIMIT 50")(
    lambda t: axioms.property_usage(t.quads, EX + "suppliedBy"))
query("axiom_class_usage", "SELECT '<http://ex/part/' || l_partkey || '>' AS cls, 'sub' AS relation, '<http://ex/suppliedBy>' AS prop, 'some' AS kind FROM lineitem GROUP BY l_partkey HAVING min(l_suppkey) = 1")(lambda t: axioms.class_usage(t.quads, EX + "supplier/1"))
query("axiom_manchester", "SELECT '_:r' || l_partkey AS node, 'suppliedBy some ' || min(l_suppkey) AS text FROM lineitem GROUP BY l_partkey")(lambda t: axioms.manchester(t.quads).select("node", "text"))
query("axiom_node_closure", "SELECT g, s, p, o FROM quads WHERE s IN ('<http://ex/part/5>', '_:r5')")(lambda t: axioms.closure_of_nodes(t.quads, t.spark.createDataFrame([("<http://ex/part/5>",)], "s string")).select("g", "s", "p", "o"))


def _evaluator(t: Tables) -> mos.Evaluator:
    return mos.Evaluator(t.quads, indexing.entity_index(t.quads))


_SUPPLIED = "SELECT l_partkey AS k, min(l_suppkey) AS s FROM lineitem GROUP BY 1"
query("mos_named", "SELECT '<urn:g:geo>' AS g, '<http://ex/region/1>' AS cls UNION ALL SELECT '<urn:g:geo>', '<http://ex/nation/' || n_nationkey || '>' FROM nation WHERE n_regionkey = 1")(lambda t: _evaluator(t).run("<http://ex/region/1>"))
query("mos_some", f"SELECT '<urn:g:parts>' AS g, '<http://ex/part/' || k || '>' AS cls FROM ({_SUPPLIED}) WHERE s = 2")(lambda t: _evaluator(t).run("<http://ex/suppliedBy> some <http://ex/supplier/2>"))
query("mos_or", f"SELECT '<urn:g:parts>' AS g, '<http://ex/part/' || k || '>' AS cls FROM ({_SUPPLIED}) WHERE s IN (1, 2)")(lambda t: _evaluator(t).run("<http://ex/suppliedBy> some <http://ex/supplier/2> or <http://ex/suppliedBy> some <http://ex/supplier/1>"))
query("mos_and_not", f"SELECT '<urn:g:parts>' AS g, '<http://ex/part/' || k || '>' AS cls FROM ({_SUPPLIED}) WHERE s = 2 AND k <> 3")(lambda t: _evaluator(t).run("(<http://ex/suppliedBy> some <http://ex/supplier/2>) and not <http://ex/part/3>"))
query("mos_min", f"SELECT '<urn:g:parts>' AS g, '<http://ex/part/' || k || '>' AS cls FROM ({_SUPPLIED}) WHERE s = 3")(lambda t: _evaluator(t).run("<http://ex/suppliedBy> min 1 <http://ex/supplier/3>"))
def _related(t: Tables) -> mos.Evaluator:
    """Parts below one restriction each on http://ex/rel, of seven kinds by their key; numbers are their size modulo five."""
    k, owl = F.col("p_partkey") % 7, axioms.OWL
    cls, node = F.concat(F.lit(f"<{EX}part/"), F.col("p_partkey"), F.lit(">")), F.concat(F.lit("_:q"), F.col("p_partkey"))
    n = F.concat(F.lit('"'), F.col("p_size") % 5, F.lit(f'"^^<{T.XSD}nonNegativeInteger>'))
    row = lambda s, p, o: F.struct(s.alias("s"), F.lit(f"<{p}>").alias("p"), o.alias("o"))
    one = lambda p, o: F.array(row(node, owl + p, o))
    counted = lambda p: F.array(row(node, owl + p, n), row(node, owl + "onClass", F.lit(f"<{EX}C>")))
    kind = (
        F.when(k == 0, one("allValuesFrom", F.lit(f"<{EX}C>"))).when(k == 1, one("hasValue", F.lit('"v"'))).when(k == 2, one("hasSelf", F.lit(f'"true"^^<{T.XSD}boolean>'))).when(k == 3, counted("maxQualifiedCardinality"))
        .when(k == 4, counted("qualifiedCardinality")).when(k == 5, counted("minQualifiedCardinality")).otherwise(one("minCardinality", n))
    )
    head = F.array(row(cls, axioms.RDFS + "subClassOf", node), row(node, owl + "onProperty", F.lit(f"<{EX}rel>")), row(cls, axioms.RDF + "type", F.lit(f"<{owl}Class>")))
    quads = t.part.select(F.lit("<urn:g:parts>").alias("g"), F.explode(F.concat(head, kind)).alias("x")).select("g", "x.*")
    return mos.Evaluator(quads, t.entities)


for _name, _text, _where in (
    ("only", "<http://ex/rel> only <http://ex/C>", "p_partkey % 7 = 0"), ("value", '<http://ex/rel> value "v"', "p_partkey % 7 = 1"), ("self", "<http://ex/rel> Self", "p_partkey % 7 = 2"),
    ("max", "<http://ex/rel> max 2 <http://ex/C>", "p_partkey % 7 = 3 AND p_size % 5 <= 2"), ("exactly", "<http://ex/rel> exactly 2 <http://ex/C>", "p_partkey % 7 = 4 AND p_size % 5 = 2"),
    ("min_qualified", "<http://ex/rel> min 2 <http://ex/C>", "p_partkey % 7 = 5 AND p_size % 5 >= 2"), ("min_thing", "<http://ex/rel> min 2 <http://www.w3.org/2002/07/owl#Thing>", "p_partkey % 7 = 6 AND p_size % 5 >= 2"),
):
    query(f"mos_{_name}", f"SELECT '<urn:g:parts>' AS g, '<http://ex/part/' || p_partkey || '>' AS cls FROM part WHERE {_where}")(lambda t, text=_text: _related(t).run(text))
query("mos_inverse", f"SELECT '<urn:g:parts>' AS g, '<http://ex/supplier/' || s || '>' AS cls FROM ({_SUPPLIED}) WHERE k = 3")(lambda t: _evaluator(t).run("inverse <http://ex/suppliedBy> some <http://ex/part/3>"))
query("mos_superclasses", "SELECT '<urn:g:geo>' AS g, '<http://ex/region/' || n_regionkey || '>' AS cls FROM nation WHERE n_nationkey = 4")(lambda t: _evaluator(t).relation("<http://ex/nation/4>", "superclasses"))

# versions and differences
query("version_order", """
SELECT id, row_number() OVER w AS position, lead(id) OVER w AS predecessor FROM versions WHERE status NOT IN ('pending', 'failed')
WINDOW w AS (PARTITION BY ontology_id ORDER BY ontology_id % 1, id % 7 DESC, id % 13 DESC, created_at DESC, id DESC)""")(lambda t: versions.ordered(t.versions).select("id", "position", "predecessor"))
query("version_defaults", """
SELECT ontology_id, id AS version_id FROM (SELECT *, row_number() OVER (PARTITION BY ontology_id ORDER BY id % 7 DESC, id % 13 DESC, created_at DESC, id DESC) AS n FROM versions WHERE status <> 'pending') WHERE n = 1""")(lambda t: versions.defaults(t.versions))
query("version_latest", "SELECT id FROM versions v WHERE status = 'ready' AND created_at = (SELECT max(created_at) FROM versions x WHERE x.ontology_id = v.ontology_id AND x.status = 'ready')")(lambda t: versions.latest_by_time(t.versions).select("id"))
query("version_consecutive", "SELECT id, lag(id) OVER (PARTITION BY ontology_id ORDER BY created_at, id) AS previous FROM versions")(
    lambda t: versions.consecutive(t.versions, t.spark.createDataFrame([], "from_id long, to_id long, status string")).select("id", "previous"))


def _snapshots(t: Tables):
    """Parts as of two versions: every fifth is missing from the first, every seventh from the second, every third has another label."""
    e = t.part.select(F.lit("class").alias("type"), F.concat(F.lit(EX + "part/"), F.col("p_partkey")).alias("iri"), "p_partkey", F.col("p_name").alias("value"))
    new = e.where("p_partkey % 7 <> 0").withColumn("value", F.when(F.col("p_partkey") % 3 == 0, F.concat("value", F.lit("!"))).otherwise(F.col("value")))
    facts = lambda df: df.select("iri", F.lit("label").alias("pred"), F.lit("en").alias("lang"), "value")
    old = e.where("p_partkey % 5 <> 0")
    return old, new, facts(old), facts(new)


query("diff_entities", """
SELECT 'class' AS type, 'http://ex/part/' || p_partkey AS iri, CASE WHEN p_partkey % 5 = 0 THEN 'added' WHEN p_partkey % 7 = 0 THEN 'removed' ELSE 'modified' END AS change FROM part
WHERE (p_partkey % 5 = 0 AND p_partkey % 7 <> 0) OR (p_partkey % 5 <> 0 AND p_partkey % 7 = 0) OR (p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 3 = 0)""")(lambda t: versions.entity_changes(*_snapshots(t)))
query("diff_literals", """
SELECT 'http://ex/part/' || p_partkey AS iri, CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS removed, CASE WHEN p_partkey % 7 <> 0 THEN p_name || CASE WHEN p_partkey % 3 = 0 THEN '!' ELSE '' END END AS added FROM part
WHERE (p_partkey % 5 <> 0 OR p_partkey % 7 <> 0) AND (p_partkey % 5 = 0 OR p_partkey % 7 = 0 OR p_partkey % 3 = 0)""")(lambda t: versions.literal_changes(*_snapshots(t)[2:]).select("iri", "removed", "added"))
query("diff_structure", """
SELECT 'http://ex/part/' || p_partkey AS iri, p_name AS value, 'removed' AS change FROM part WHERE p_partkey % 5 <> 0 AND (p_partkey % 7 = 0 OR p_partkey % 3 = 0)
UNION ALL SELECT 'http://ex/part/' || p_partkey, p_name || CASE WHEN p_partkey % 3 = 0 THEN '!' ELSE '' END, 'added' FROM part WHERE p_partkey % 7 <> 0 AND (p_partkey % 5 = 0 OR p_partkey % 3 = 0)""")(
    lambda t: versions.structural_changes(*_snapshots(t)[2:]).select("iri", "value", "change"))
# a restriction's node has two lines: what property, what filler
query("diff_fingerprints", """
WITH k AS (SELECT l_partkey, min(l_suppkey) AS s FROM lineitem GROUP BY 1)
SELECT '_:r' || l_partkey AS node, left(sha1('<http://www.w3.org/2002/07/owl#onProperty>' || chr(9) || '<http://ex/suppliedBy>' || chr(10) || '<http://www.w3.org/2002/07/owl#someValuesFrom>' || chr(9) || '<http://ex/supplier/' || s || '>'), 16) AS print FROM k""")(
    lambda t: versions.fingerprints(t.quads))
query("update_states", "SELECT id, CASE WHEN id % 4 = 0 THEN 'up_to_date' WHEN id % 4 = 1 THEN 'unversioned' WHEN id % 4 = 2 THEN 'skipped' ELSE 'available' END AS state FROM versions")(
    lambda t: t.versions.select("id", versions.update_state(F.lit("a"), F.when(F.col("id") % 4 == 0, "a").otherwise("b"), F.lit(5), F.when(F.col("id") % 4 == 1, None).when(F.col("id") % 4 == 2, 4).otherwise(6)).alias("state")))

# catalogue
def _tiers(t: Tables):
    """A graph per nation, with constructs of one of five mixtures beside a label."""
    k = F.col("n_nationkey") % 5
    row = lambda p, o: F.struct(F.lit("<s>").alias("s"), F.lit(p).alias("p"), F.lit(o).alias("o"))
    a, owl, rdfs = f"<{catalogue.RDF}type>", catalogue.OWL, catalogue.RDFS
    none = [row(f"<{rdfs}label>", '"x"'), row(a, f"<{owl}Ontology>"), row(a, f"<{owl}AnnotationProperty>"), row(f"<{owl}Restriction>", "<x>")]
    light = [row(f"<{rdfs}subClassOf>", "<x>"), row(a, f"<{rdfs}Class>")]
    mixtures = F.when(k == 0, F.array(*none)).when(k == 1, F.array(*none, *light)).when(k == 2, F.array(*none, *light, row(f"<{owl}inverseOf>", "<x>"), row(f"<{owl}sameAs>", "<x>"))).when(
        k == 3, F.array(*none, *light, row(a, f"<{owl}Class>"), row(f"<{owl}oneOf>", "<x>"))).otherwise(F.array(*none, row(f"<{rdfs}range>", "<x>"), row("<x>", f"<{owl}Class>")))
    return t.nation.select(F.concat(F.lit("g"), F.col("n_nationkey")).alias("g"), F.explode(mixtures).alias("x")).select("g", "x.*")


query("graph_counts", """
SELECT g, count(*) AS triples, count(DISTINCT CASE WHEN p LIKE '%#type>' AND o LIKE '%owl#Class>' AND s LIKE '<%' THEN s END) AS classes, count(DISTINCT CASE WHEN p LIKE '%#type>' AND o LIKE '%owl#NamedIndividual>' THEN s END) AS individuals FROM quads GROUP BY 1""")(
    lambda t: catalogue.graph_counts(t.quads).select("g", "triples", "classes", "individuals"))
query("void_counts", "SELECT g, count(*) AS triples, count(DISTINCT s) AS distinct_subjects, count(DISTINCT CASE WHEN o NOT LIKE '\"%' THEN o END) AS distinct_objects FROM quads GROUP BY 1")(
    lambda t: catalogue.void(t.quads).select("g", "triples", "distinct_subjects", "distinct_objects"))
query("coverage", """
SELECT version_id, type, count(*) AS total, count(*) AS with_label, count(*) FILTER (definition <> '') AS with_definition, 0::BIGINT AS multilingual, count(*) FILTER (source = '') AS native_total,
count(*) FILTER (source = '' AND definition <> '') AS native_with_definition FROM entities GROUP BY 1, 2""")(
    lambda t: catalogue.coverage(t.entities.withColumn("labels", F.create_map(F.lit("en"), F.col("label")))).drop("native_with_label"))
query("coverage_languages", "SELECT source AS type, lang, count(*) AS n FROM documents GROUP BY 1, 2")(
    lambda t: catalogue.languages(t.documents.select(F.col("source").alias("type"), F.create_map(F.col("lang"), F.lit("x")).alias("labels"))))
query("coverage_sources", "SELECT source, count(*) AS total, count(*) FILTER (definition <> '') AS with_definition FROM entities GROUP BY ROLLUP (source)")(lambda t: catalogue.by_source(t.entities))
query("public_stats", "SELECT type, count(*) AS rows, count(DISTINCT iri) AS terms FROM entities WHERE version_id IN ('org', 'parts') GROUP BY 1")(
    lambda t: catalogue.distinct_terms(t.entities, t.spark.createDataFrame([("org",), ("parts",)], "version_id string")))
query("license_facets", "SELECT coalesce(license, 'none') AS value, count(*) AS n FROM versions GROUP BY 1")(lambda t: catalogue.counted(t.versions, F.col("license")))
query("publish_gate", """
SELECT id, CASE WHEN status = 'ready' THEN '' ELSE array_to_string(list_filter([
  CASE WHEN license IN ('5-LOW', '1-URGENT') THEN 'license' END, CASE WHEN id % 11 = 0 OR size < 100000 THEN 'too_few_triples' END, CASE WHEN id % 7 = 0 THEN 'title' END], lambda x: x IS NOT NULL), ',') END AS reasons FROM versions""")(
    lambda t: t.versions.select("id", F.array_join(catalogue.publish_state(
        F.when(F.col("license") != "5-LOW", F.col("license")), F.when(F.col("id") % 11 != 0, F.col("size")), F.when(F.col("id") % 7 == 0, " ").otherwise("t"), F.col("status"), 100_000,
        ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]), ",").alias("reasons")))
# the graphs declare classes and individuals; parts alone has restrictions
query("language_tier", "SELECT g, CASE WHEN g = '<urn:g:parts>' THEN 'owl' ELSE 'rdfs-plus' END AS tier, CASE WHEN g = '<urn:g:parts>' THEN 'owl:onProperty' ELSE 'owl:Class' END AS construct FROM quads GROUP BY 1")(
    lambda t: catalogue.language_tier(t.quads))
query("language_tiers", """
SELECT 'g' || n_nationkey AS g, CASE n_nationkey % 5 WHEN 0 THEN 'rdf' WHEN 1 THEN 'rdfs' WHEN 2 THEN 'rdfs-plus' WHEN 3 THEN 'owl' ELSE 'rdfs' END AS tier,
CASE n_nationkey % 5 WHEN 1 THEN 'rdfs:Class' WHEN 2 THEN 'owl:inverseOf' WHEN 3 THEN 'owl:oneOf' WHEN 4 THEN 'rdfs:range' END AS construct FROM nation""")(lambda t: catalogue.language_tier(_tiers(t)))
query("iri_prefixes", "SELECT iri, CASE WHEN iri LIKE 'http://ex/part/%' THEN 'part' ELSE 'ex' END AS prefix FROM entities")(
    lambda t: catalogue.with_prefix(t.entities, "iri", t.spark.createDataFrame([("http://ex/", "ex"), ("http://ex/part/", "part")], "namespace string, prefix string")).select("iri", "prefix"))
query("reuse_terms", "SELECT split_part(iri, '/', 4) AS prefix, count(*) FILTER (type = 'class') AS classes, count(*) FILTER (type LIKE '%property') AS properties FROM entities WHERE iri NOT LIKE 'http://ex/part/%' GROUP BY 1")(
    lambda t: catalogue.reused_terms(t.entities.withColumn("prefix", F.split_part("iri", F.lit("/"), F.lit(4))), "part").select("prefix", "classes", "properties"))
query("reuse_mireot", "SELECT '<http://ex/customer/' || c_custkey || '>' AS term FROM customer UNION ALL SELECT '<http://ex/supplier/' || s_suppkey || '>' FROM supplier")(
    lambda t: catalogue.mireot(t.quads, EX + "part/", [EX + "nation/", EX + "region/"], [catalogue.RDFS + "label"]))
query("fair_fleet", """
SELECT count(*) AS n, count(*) FILTER (s < 50) AS below_50, count(*) FILTER (s >= 50 AND s < 70) AS from_50, count(*) FILTER (s >= 70 AND s < 85) AS from_70, count(*) FILTER (s >= 85) AS from_85, round(avg(s), 4) AS mean, round(stddev_pop(s), 4) AS deviation
FROM (SELECT p_size * 2 AS s FROM part)""")(lambda t: catalogue.fair_fleet(t.part.select((F.col("p_size") * 2).alias("score"))))


def _fair(t: Tables):
    v = t.versions
    n = lambda k: F.col("id") % k
    return v.select(
        F.col("id").alias("version_id"), F.concat(F.lit("http://ex/"), F.col("id"), F.when(n(3) == 0, ".owl").when(n(3) == 1, "?x.ttl").otherwise("#a.b")).alias("iri"),
        F.when(n(4) == 0, F.concat(F.lit("http://ex/"), F.col("id"), F.lit(".TTL?raw=1"))).alias("final_url"), (n(2) == 0).alias("resolvable"),
        F.when(n(10) == 0, "Application/N-Triples").otherwise("text/html").alias("content_type"), "version_iri", F.lit("t").alias("title"), F.when(n(3) == 0, "d").alias("description"),
        F.lit("").alias("prefix"), F.lit("s").alias("shortname"), F.array(F.when(n(5) == 0, "OBO").otherwise("x")).alias("groups"), F.when(n(7) != 0, "rdf").alias("tier"),
        F.array().cast("array<string>").alias("profiles"), F.lit(True).alias("profiles_unavailable"),
        n(2).alias("reused"), F.lit(0).alias("imports"), F.lit(1).alias("mappings"), F.lit(0).alias("mireot"), "license", F.lit("MIT").alias("spdx"), F.lit(False).alias("license_ok"), F.lit(0).alias("creators"), F.lit("").alias("created"), F.lit(1).alias("publishers"),
        (n(10) / 10).alias("roles_filled"), (n(4) / 4).alias("label_share"), F.when(n(5) != 0, n(5) / 5).alias("definition_share"),
    )


query("fair_scores", """
WITH x AS (SELECT id AS version_id, round((1 + (id % 2 = 0)::INT + 1 + (id % 3 = 0)::INT + 1 + (id % 5 = 0)::INT) / 6.0::DOUBLE, 4) AS f,
  round((CASE WHEN id % 2 = 1 THEN 0 WHEN id % 4 = 0 OR id % 3 = 0 OR id % 10 = 0 THEN 1 ELSE 0.5::DOUBLE END + 2) / 3, 4) AS a,
  round(((id % 7 <> 0)::INT + 0.5::DOUBLE + id % 2 + 0.5::DOUBLE) / 4, 4) AS i,
  round((1 + 0.5::DOUBLE + 0 + (id % 10) / 10.0::DOUBLE + (id % 4) / 4.0::DOUBLE + (id % 5) / 5.0::DOUBLE) / 6, 4) AS r FROM versions)
SELECT version_id, f, a, i, r, round((f + a + i + r) / 4, 4) AS score, CASE WHEN round((f + a + i + r) / 4, 4) >= 0.85 THEN 'strong' WHEN round((f + a + i + r) / 4, 4) >= 0.5 THEN 'fair' ELSE 'weak' END AS verdict FROM x""")(lambda t: catalogue.fair_scores(_fair(t)))
query("fair_own_share", """
SELECT version_id, CASE WHEN count(*) FILTER (source = '') > 0 THEN count(*) FILTER (source = '' AND definition <> '') ELSE count(*) FILTER (definition <> '') END AS matched,
CASE WHEN count(*) FILTER (source = '') > 0 THEN count(*) FILTER (source = '') ELSE count(*) END AS total FROM entities GROUP BY 1""")(
    lambda t: catalogue.own_share(catalogue.coverage(t.entities.withColumn("labels", F.create_map(F.lit("en"), F.col("label")))), "definition").select("version_id", "matched", "total"))
query("pipeline_stages", "SELECT 'events' AS stage, (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT user_id FROM events)) AS done, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)) AS missing UNION ALL SELECT 'orders', (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)), (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))")(
    lambda t: catalogue.pipeline_stages(t.customer.select(F.col("c_custkey").alias("version_id")), {"events": t.events.select(F.col("user_id").alias("version_id")), "orders": t.orders.select(F.col("o_custkey").alias("version_id"))}))
query("verdict_agreement", "SELECT p_brand AS scope, count(*) AS n, round(100 * avg((p_size > 25)::INT), 1) AS agreed FROM part GROUP BY 1")(
    lambda t: catalogue.agreement(t.part.select("p_partkey", F.col("p_brand").alias("scope"), F.lit(True).alias("ok")), t.part.select("p_partkey", F.col("p_brand").alias("scope"), (F.col("p_size") > 25).alias("ok")), ["p_partkey", "scope"], "ok"))
query("admin_overview", """
SELECT ontology_id, n, id AS latest FROM (SELECT ontology_id, id, count(*) OVER (PARTITION BY ontology_id) AS n, row_number() OVER (PARTITION BY ontology_id ORDER BY created_at DESC, id DESC) AS k FROM versions) WHERE k = 1""")(
    lambda t: t.versions.groupBy("ontology_id").agg(F.count("*").alias("n"), F.max_by("id", F.struct("created_at", "id")).alias("latest")))
query("owner_stats", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS uploads, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY 1")(
    lambda t: t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("uploads"), F.round(F.avg("o_totalprice"), 2).alias("mean")))
query("mapping_estimate", "SELECT p_type AS acronym, p_brand AS prefix, count(*) AS n, p_brand NOT IN ('Brand#1', 'Brand#2') AS candidate FROM part GROUP BY 1, 2")(
    lambda t: (lambda m, i: m.groupBy("acronym", "prefix").agg(F.count("*").alias("n")).join(i, "prefix", "left").select("acronym", "prefix", "n", F.col("declared").isNull().alias("candidate")))(
        t.part.select(F.col("p_type").alias("acronym"), F.col("p_brand").alias("prefix")), t.part.where(F.col("p_brand").isin("Brand#1", "Brand#2")).select(F.col("p_brand").alias("prefix")).distinct().withColumn("declared", F.lit(True))))

# sources and sinks
query("rdf_round_trip", "SELECT DISTINCT g, s, p, o FROM quads WHERE g = '<urn:g:geo>'")(lambda t: rdf.parse_nquads(rdf.to_nquads(t.quads.where("g = '<urn:g:geo>'"))).distinct())
query("rdf_formats", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'turtle' WHEN 1 THEN 'jsonld' WHEN 2 THEN 'owlxml' ELSE 'ntriples' END AS format FROM part")(
    lambda t: t.part.select("p_partkey", (lambda k: rdf.detect_format(F.when(k == 1, "application/ld+json").otherwise("text/plain"), F.when(k == 0, "x.ttl").when(k == 2, "x.owl").otherwise("x"), F.when(k == 2, "<Ontology owl").otherwise("<a> <b> <c> .")))(F.col("p_partkey") % 4).alias("format")))
query("rdf_replace_graph", "SELECT g, s, p, o FROM quads WHERE g <> '<urn:g:geo>' UNION ALL SELECT '<urn:g:geo>', '<a>', '<b>', '<c>'")(lambda t: rdf.replace_graph(t.quads, t.spark.createDataFrame([("<urn:g:geo>", "<a>", "<b>", "<c>")], "g string, s string, p string, o string")))
query("rdf_append", "SELECT DISTINCT g, s, p, o FROM quads")(lambda t: rdf.append(t.quads, t.quads.where("g = '<urn:g:geo>'")))
query("rdf_content_identity", "SELECT sha256(text) AS sha, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY 1")(lambda t: rdf.content_identity(t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("content"))))
query("rdf_ingest_guard", "SELECT DISTINCT g, '' AS problem FROM quads")(lambda t: rdf.ingest_problem(t.quads))
query("rdf_strip_bled", """
WITH others AS (SELECT DISTINCT o AS theirs FROM quads WHERE p LIKE '%#label>' AND s <> '<http://ex/part/1>')
SELECT g, s, p, o FROM quads LEFT JOIN others ON o = theirs AND s = '<http://ex/part/1>' AND p LIKE '%#label>' WHERE theirs IS NULL""")(
    lambda t: rdf.strip_bled(t.quads, "<http://ex/part/1>", [f"<{catalogue.RDFS}label>"]).select("g", "s", "p", "o"))
query("rdf_triples_of_rows", "SELECT '<urn:t>' AS g, '<http://ex/r/' || r_regionkey || '>' AS s, '<http://ex/name>' AS p, '\"' || r_name || '\"' AS o FROM region")(
    lambda t: rdf.as_triples(t.region, T.iri(F.concat(F.lit(EX + "r/"), F.col("r_regionkey"))), {"r_name": (EX + "name", "text")}, F.lit("<urn:t>")))
query("import_closure", """/*recursive*/ WITH w AS (SELECT child, parent, 1 AS d FROM edges UNION SELECT w.child, e.parent, d + 1 FROM w JOIN edges e ON w.parent = e.child) SELECT child AS iri, parent AS import_iri, d AS depth FROM w WHERE child LIKE '%supplier%'""")(
    lambda t: rdf.import_closure(t.edges.select(F.col("child").alias("iri"), F.col("parent").alias("import_iri")), t.edges.where("child like '%supplier%'").select(F.col("child").alias("iri")).distinct()))

# usage
query("usage_daily", "SELECT ontology, kind, day, count(*) AS total, count(DISTINCT user_id) AS visitors FROM usage GROUP BY 1, 2, 3")(lambda t: usage.daily(t.usage))
query("usage_unique", "SELECT ontology, kind, day, count(DISTINCT user_id) AS n FROM usage GROUP BY 1, 2, 3")(
    lambda t: usage.unique_visits(t.usage.withColumn("visitor", usage.visitor("salt", F.col("user_id").cast("string"), F.lit("agent"), F.col("ontology"), F.col("day")))).groupBy("ontology", "kind", "day").agg(F.count("*").alias("n")))
query("usage_trend", """
WITH d AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-02-12', INTERVAL 7 DAY))::DATE AS bucket) SELECT bucket, count(day) AS n FROM d LEFT JOIN usage ON date_trunc('week', day) = bucket GROUP BY 1""")(
    lambda t: usage.trend(t.usage.groupBy("day").agg(F.count("*").alias("total")), "2024-01-01", "2024-02-12"))
query("usage_totals", "SELECT kind, count(*) AS n FROM usage GROUP BY 1")(lambda t: t.usage.groupBy("kind").agg(F.count("*").alias("n")))
query("usage_upsert", "SELECT kind, CASE WHEN kind = 'view' THEN 0 ELSE count(*) END AS n FROM usage GROUP BY 1")(
    lambda t: usage.upsert(t.usage.groupBy("kind").agg(F.count("*").alias("n")), t.spark.createDataFrame([("view", 0)], "kind string, n long"), ["kind"]))
query("usage_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM usage")(lambda t: t.usage.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")))
query("host_schedule", "SELECT page_id AS id, 30 * (row_number() OVER (PARTITION BY lower(regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1)) ORDER BY CASE WHEN page_id % 5 = 0 THEN -1 ELSE page_id % 17 END, page_id) - 1) AS delay FROM pages")(
    lambda t: usage.host_schedule(t.pages.select(F.col("page_id").alias("id"), X.host(F.col("url")).alias("host"), F.when(F.col("page_id") % 5 != 0, F.col("page_id") % 17).alias("last_checked")), 30).select("id", F.col("delay").cast("long").alias("delay")))
query("held_drafts", "SELECT id, CASE WHEN id % 40 >= 30 THEN 'retire' WHEN id % 40 >= 7 AND id % 2 = 1 THEN 'nudge' ELSE 'wait' END AS action FROM versions")(
    lambda t: t.versions.select("id", usage.held_action(F.col("id") % 40, F.col("id") % 2 == 0).alias("action")))
query("missing_embeddings", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")(lambda t: t.documents.join(t.embeddings.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti").select("doc_id"))

from triplewright.plans import registry_browse  # noqa: E402, F401  adds its queries
from triplewright.plans import registry_fleet  # noqa: E402, F401  adds its queries
from triplewright.plans import registry_reasoning  # noqa: E402, F401  adds its queries
from triplewright.plans import registry_search  # noqa: E402, F401  adds its queries
from triplewright.plans import registry_structure  # noqa: E402, F401  adds its queries
from triplewright.plans import registry_records  # noqa: E402, F401  adds its queries
