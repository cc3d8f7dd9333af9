"""Queries of the stored search index, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from triplewright.operators import search
from triplewright.plans.registry import query

def _hits(word: str) -> str:
    """Hits of a word over the whole search text: labels that begin with it first, then entities with a word that does."""
    return rf"""h AS (SELECT iri, label, type, version_id, short, source, CASE WHEN lower(label) LIKE '{word}%' THEN 1 ELSE 2 END AS tier, CASE WHEN lower(label) = '{word}' THEN 0 ELSE 1 END AS exact
FROM entities WHERE regexp_matches(lower(label || ' ' || short || ' ' || definition || ' ' || source), '(^|[^a-z0-9_]){word}')),
r AS (SELECT *, row_number() OVER (ORDER BY tier, CASE WHEN tier = 1 THEN exact ELSE 0 END, length(label), label, iri) - 1 AS k FROM h)"""


_DOCUMENT = "iri, label, short AS short_form, replace(short, '_', ':') AS obo_id, version_id AS ontology_name, upper(version_id) AS ontology_prefix, type"

query("search_index_sizes", r"""
WITH w AS (SELECT DISTINCT version_id, iri, unnest(regexp_split_to_array(lower(label), '[^a-z0-9]+')) AS word FROM entities),
g AS (SELECT DISTINCT version_id, iri, unnest(list_transform(range(1, length(word) + 2), lambda i: substr('  ' || word || ' ', i, 3))) AS gram FROM w WHERE word <> '')
SELECT (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM g) AS grams, (SELECT count(DISTINCT gram) FROM g) AS distinct_grams""")(
    lambda t: t.search_index.totals().agg(F.sum("n").alias("entities")).crossJoin(t.search_index.gram_counts.agg(F.sum("n").alias("grams"), F.count("*").alias("distinct_grams"))))  # two rows of sums
query("search_documents", f"WITH {_hits('red')}, f AS (SELECT * FROM r WHERE type IN ('class', 'concept') ORDER BY k LIMIT 65) SELECT row_number() OVER (ORDER BY k) - 1 AS position, {_DOCUMENT}, coalesce(source = '' OR source = version_id, true) AS is_defining_ontology, (SELECT count(*) FROM f) AS found FROM f QUALIFY position BETWEEN 5 AND 14")(
    lambda t: t.search_index.documents("Red", rows=10, start=5, type="class"))
query("search_documents_local", f"WITH {_hits('nation')}, f AS (SELECT * FROM r ORDER BY k LIMIT 60), l AS (SELECT * FROM f WHERE source = '') SELECT row_number() OVER (ORDER BY k) - 1 AS position, {_DOCUMENT}, true AS is_defining_ontology, (SELECT count(*) FROM l) AS found FROM l QUALIFY position < 10")(
    lambda t: t.search_index.documents("Nation", local=True))
# beyond the labels that begin with the word, similar ones fill the thirty that a page is cut from
query("search_select", """WITH h AS (SELECT * FROM entities WHERE lower(label) LIKE 'customer#00000001%' ORDER BY length(label), label, iri LIMIT 30)
SELECT row_number() OVER (ORDER BY length(label), label, iri) - 1 AS position, iri, label, short AS short_form, short[:1] || ':' || short[3:] AS obo_id, version_id AS ontology_name, upper(version_id) AS ontology_prefix, type, true AS is_defining_ontology, 30 AS found FROM h QUALIFY position < 10""")(
    lambda t: t.search_index.select("Customer#00000001").where("position < 10"))
query("search_suggest", """WITH r AS (SELECT label, row_number() OVER (ORDER BY length(label), label, iri) - 1 AS k FROM entities WHERE lower(label) LIKE 'customer#0000%'),
f AS (SELECT label, min(k) AS position FROM r WHERE k < 27 GROUP BY label) SELECT position, label AS autosuggest FROM f ORDER BY position LIMIT 7""")(lambda t: t.search_index.suggest("Customer#0000", rows=7))
query("search_hit_facets", f"WITH {_hits('red')} SELECT version_id, count(DISTINCT iri) AS n FROM r GROUP BY version_id")(lambda t: t.search_index.hit_facets("Red"))
query("search_index_facets", "SELECT type, count(*) AS n FROM entities GROUP BY type")(lambda t: t.search_index.totals("type"))
# the same rows as the tiers over the entities themselves, for words of every kind of entity
_WORDS = ("red", "widget blu", "Brand#1", "asia", "nation of region", "customer#00000", "supplier 00", "widgit", "old", "economy small", "x")


def _agreement(t):
    """Per query word: how many rows the index and a scan of the entities give in the same order."""
    rows = []
    for w in _WORDS:
        pair = [[tuple(r) for r in f(w, 50).collect()] for f in (t.search_index.autocomplete, lambda q, n: search.autocomplete(t.index, q, n))]  # fifty rows each, at most
        rows.append((w, sum(a == b for a, b in zip(*pair)) - abs(len(pair[0]) - len(pair[1])), len(pair[1])))
    return t.spark.createDataFrame(rows, "word string, same int, scanned int").where("same = scanned").select("word")


query("search_index_agrees", " UNION ALL ".join(f"SELECT '{w}' AS word" for w in _WORDS))(_agreement)

# vectors by the index: the same rows as a scan of all
_NEAR = """WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = {of}) SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], v::DOUBLE[]) / (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_inner_product(v::DOUBLE[], v::DOUBLE[]))), 4) AS score
FROM embeddings, q WHERE vec_id <> {of} AND {where} ORDER BY score DESC, vec_id LIMIT {k}"""
query("vector_index_neighbours", _NEAR.format(of=7, where="true", k=15))(lambda t: t.vector_index.neighbours(7, 15).select("vec_id", "score"))
query("vector_index_scoped", _NEAR.format(of=11, where="label % 2 = 1", k=20))(lambda t: t.vector_index.neighbours(11, 20, F.col("label") % 2 == 1).select("vec_id", "score"))
query("vector_index_cells", "SELECT count(*) AS n, true AS whole FROM embeddings")(
    lambda t: t.vector_index.vectors.agg(F.count("*").alias("n")).withColumn("whole", F.lit(sum(c.n for c in t.vector_index.cells)) == F.col("n")))
