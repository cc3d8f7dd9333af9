"""Quads, entities, edges, versions and usage as SQL over the star-schema tables.

The text is read by Spark (tables in braces are DataFrames) and, with bare names, by the SQL that states expected results.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_TYPE, _LABEL, _SUB = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>", "<http://www.w3.org/2000/01/rdf-schema#label>", "<http://www.w3.org/2000/01/rdf-schema#subClassOf>"
_OWL = "http://www.w3.org/2002/07/owl#"
_INT = "http://www.w3.org/2001/XMLSchema#integer"


def _named(graph: str, table: str, kind: str, key: str, label: str, owl: str) -> str:
    iri = f"'<http://ex/{kind}/' || {key} || '>'"
    return f"""
SELECT '<urn:g:{graph}>' AS g, {iri} AS s, '{_TYPE}' AS p, '<{_OWL}{owl}>' AS o FROM {{{table}}}
UNION ALL SELECT '<urn:g:{graph}>', {iri}, '{_LABEL}', '"' || {label} || '"@en' FROM {{{table}}}"""


def _below(graph: str, table: str, kind: str, key: str, up: str, upkey: str) -> str:
    return f"SELECT '<urn:g:{graph}>' AS g, '<http://ex/{kind}/' || {key} || '>' AS s, '{_SUB}' AS p, '<http://ex/{up}/' || {upkey} || '>' AS o FROM {{{table}}}"


VIEWS = {
    "quads": " UNION ALL ".join([
        _named("geo", "region", "region", "r_regionkey", "r_name", "Class"), _named("geo", "nation", "nation", "n_nationkey", "n_name", "Class"),
        _named("org", "customer", "customer", "c_custkey", "c_name", "NamedIndividual"), _named("org", "supplier", "supplier", "s_suppkey", "s_name", "Class"), _named("parts", "part", "part", "p_partkey", "p_name", "Class"),
        _below("geo", "nation", "nation", "n_nationkey", "region", "n_regionkey"), _below("org", "customer", "customer", "c_custkey", "nation", "c_nationkey"), _below("org", "supplier", "supplier", "s_suppkey", "nation", "s_nationkey"),
        f"SELECT '<urn:g:parts>' AS g, '<http://ex/part/' || p_partkey || '>' AS s, '<http://ex/size>' AS p, '\"' || p_size || '\"^^<{_INT}>' AS o FROM {{part}}",
        "SELECT '<urn:g:parts>' AS g, '<http://ex/part/' || p_partkey || '>' AS s, '<http://ex/brand>' AS p, '\"' || p_brand || '\"' AS o FROM {part}",
        f"SELECT '<urn:g:parts>' AS g, '<http://ex/part/' || l_partkey || '>' AS s, '{_SUB}' AS p, '_:r' || l_partkey AS o FROM (SELECT DISTINCT l_partkey FROM {{lineitem}}) x",
        f"SELECT '<urn:g:parts>' AS g, '_:r' || l_partkey AS s, '<{_OWL}onProperty>' AS p, '<http://ex/suppliedBy>' AS o FROM (SELECT DISTINCT l_partkey FROM {{lineitem}}) x",
        f"SELECT '<urn:g:parts>' AS g, '_:r' || l_partkey AS s, '<{_OWL}someValuesFrom>' AS p, '<http://ex/supplier/' || k || '>' AS o FROM (SELECT l_partkey, min(l_suppkey) AS k FROM {{lineitem}} GROUP BY l_partkey) x",
    ]),
    "entities": """
SELECT 'geo' AS version_id, 'http://ex/region/' || r_regionkey AS iri, 'class' AS type, r_name AS label, 'R_' || r_regionkey AS short, '' AS source, '' AS definition FROM {region}
UNION ALL SELECT 'geo', 'http://ex/nation/' || n_nationkey, 'class', n_name, 'N_' || n_nationkey, '', 'Nation of region ' || n_regionkey FROM {nation}
UNION ALL SELECT 'org', 'http://ex/customer/' || c_custkey, 'individual', c_name, 'C_' || c_custkey, c_mktsegment, CASE WHEN c_acctbal > 0 THEN 'In credit' ELSE '' END FROM {customer}
UNION ALL SELECT 'org', 'http://ex/supplier/' || s_suppkey, 'class', s_name, 'S_' || s_suppkey, '', '' FROM {supplier}
UNION ALL SELECT 'parts', 'http://ex/part/' || p_partkey, 'class', p_name, 'P_' || p_partkey, p_brand, p_type FROM {part}""",
    "edges": """
SELECT 'geo' AS version_id, 'http://ex/nation/' || n_nationkey AS child, 'http://ex/region/' || n_regionkey AS parent, 'class' AS kind FROM {nation}
UNION ALL SELECT 'org', 'http://ex/customer/' || c_custkey, 'http://ex/nation/' || c_nationkey, 'class' FROM {customer}
UNION ALL SELECT 'org', 'http://ex/supplier/' || s_suppkey, 'http://ex/nation/' || s_nationkey, 'class' FROM {supplier}
UNION ALL SELECT 'parts', 'http://ex/part/' || p_partkey, 'http://ex/type/' || p_type, 'class' FROM {part}""",
    "versions": """
SELECT o_orderkey AS id, o_custkey AS ontology_id, 'http://ex/o/' || o_custkey || '/' || (o_orderkey % 7) || '.' || (o_orderkey % 13) AS version_iri,
  CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'pending' ELSE 'indexed' END AS status, o_orderdate AS created_at, o_orderpriority AS license, o_totalprice AS size FROM {orders}""",
    "usage": "SELECT event_id, ts, CAST(ts AS DATE) AS day, user_id, user_id % 20 AS ontology, event_type AS kind, value, props FROM {events}",
}


def expected(sql: str) -> str:
    """SQL over base tables and views as one statement; views used are put in front."""
    names = {b: b for b in BASE}
    used = [v for v in VIEWS if v in sql]
    recursive = "RECURSIVE " if "/*recursive*/" in sql else ""
    body = sql.replace("/*recursive*/", "").strip()
    views = [f"{v} AS ({VIEWS[v].format(**names)})" for v in used]
    if body.upper().startswith("WITH "):
        body = ", " + body[5:] if views else body
        return f"WITH {recursive}{', '.join(views)}{body}" if views else body.replace("WITH ", f"WITH {recursive}", 1)
    return f"WITH {', '.join(views)} {body}" if views else body


class Tables:
    """The tables of a folder, and the views over them, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        if name in VIEWS:
            text = VIEWS[name]
            return self.spark.sql(text, **{b: getattr(self, b) for b in BASE if f"{{{b}}}" in text})
        raise AttributeError(name)

    @cached_property
    def index(self) -> DataFrame:
        """Entities with normalised labels and search text."""
        from pyspark.sql import functions as F

        from triplewright.functions import text as X

        return self.entities.withColumn("norm", X.normalise_label(F.col("label"))).withColumn("search_text", X.search_text(F.col("label"), F.col("short"), F.array("definition"), F.array("source")))

    def _written(self, kind: str, build):
        """What build() has written for this folder, once a session."""
        key = (self.spark.sparkContext.applicationId, self.dir, kind)
        if key not in _WRITTEN:
            _WRITTEN[key] = build()
        return _WRITTEN[key]

    @property
    def search_index(self):
        """The written search index of this folder's entities."""
        from triplewright.operators.search_index import SearchIndex

        return self._written("search", lambda: SearchIndex.build(self.index))

    @property
    def vector_index(self):
        """The written index of this folder's vectors."""
        from triplewright.operators.vector_index import VectorIndex

        return self._written("vectors", lambda: VectorIndex.build(self.embeddings))


#: (application, folder, kind) -> what is written for it.
_WRITTEN: dict = {}
