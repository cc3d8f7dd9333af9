"""Queries of the EL reasoner, each rule with the SQL of what it must find, justifications and changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from triplewright.operators import reasoning
from triplewright.operators.axioms import OWL, RDF, RDFS
from triplewright.plans.registry import query
from triplewright.plans.views import BASE

G = "<urn:g:all>"
_TYPE, _SUB, _EQ = f"<{RDF}type>", f"<{RDFS}subClassOf>", f"<{OWL}equivalentClass>"
#: Parts with the first and the last of their suppliers, orders with one of their parts.
_PARTS = "(SELECT l_partkey AS k, min(l_suppkey) AS low, max(l_suppkey) AS high FROM {lineitem} GROUP BY l_partkey)"
_ORDERS = "(SELECT l_orderkey AS k, min(l_partkey) AS part FROM {lineitem} GROUP BY l_orderkey)"


def iri(kind: str, key: str | None = None) -> str:
    """SQL of an IRI."""
    return f"'<http://ex/{kind}>'" if key is None else f"'<http://ex/{kind}/' || {key} || '>'"


def below(table: str, a: str, b: str, graph: str = f"'{G}'") -> list[tuple[str, str, str, str, str]]:
    """Triples as SQL of (g, s, p, o, table)."""
    return [(graph, a, f"'{_SUB}'", b, table)]


def leads(table: str, a: str, node: str, prop: str, filler: str, how: str = _SUB) -> list[tuple[str, str, str, str, str]]:
    """a is below (or equivalent to) something that leads by a property into the filler."""
    return [(f"'{G}'", a, f"'{how}'", node, table), (f"'{G}'", node, f"'<{OWL}onProperty>'", iri(prop), table), (f"'{G}'", node, f"'<{OWL}someValuesFrom>'", filler, table)]


def stated(*triples: tuple[str, str, str]) -> list[tuple[str, str, str, str, str]]:
    return [(f"'{G}'", *(f"'{x}'" for x in triple), "(SELECT 1)") for triple in triples]


GEO = below("{nation}", iri("nation", "n_nationkey"), iri("region", "n_regionkey")) + below("{supplier}", iri("supplier", "s_suppkey"), iri("nation", "s_nationkey"))
SPAN = below(_PARTS, iri("part", "k"), iri("supplier", "low")) + below(_PARTS, iri("part", "k"), iri("supplier", "high"))
SUPPLIED = leads(_PARTS, iri("part", "k"), "'_:p' || k", "suppliedBy", iri("supplier", "low"))
ORDERED = leads(_ORDERS, iri("order", "k"), "'_:o' || k", "contains", iri("part", "part"))
_CELL = "'_:d' || r_regionkey"
APART = [
    *stated(("_:apart", _TYPE, f"<{OWL}AllDisjointClasses>"), ("_:apart", f"<{OWL}members>", "_:d0")),
    (f"'{G}'", _CELL, f"'<{RDF}first>'", iri("region", "r_regionkey"), "{region}"),
    (f"'{G}'", _CELL, f"'<{RDF}rest>'", f"CASE WHEN r_regionkey = (SELECT max(r_regionkey) FROM {{region}}) THEN '<{RDF}nil>' ELSE '_:d' || (r_regionkey + 1) END", "{region}"),
]


def frame(t, *parts):
    rows = [row for part in parts for row in part]
    text = " UNION ALL ".join(f"SELECT {g} AS g, {s} AS s, {p} AS p, {o} AS o FROM {table}" for g, s, p, o, table in rows)
    return t.spark.sql(text, **{b: getattr(t, b) for b in BASE if f"{{{b}}}" in text})


#: Parts with suppliers of two regions, in SQL.
_TWO = f"""two AS (SELECT k, low, high, a.s_nationkey AS n1, b.s_nationkey AS n2, x.n_regionkey AS r1, y.n_regionkey AS r2 FROM {_PARTS.format(lineitem='lineitem')} JOIN supplier a ON a.s_suppkey = low JOIN supplier b ON b.s_suppkey = high
JOIN nation x ON x.n_nationkey = a.s_nationkey JOIN nation y ON y.n_nationkey = b.s_nationkey WHERE x.n_regionkey <> y.n_regionkey)"""
_LINKS = f"k AS (SELECT * FROM {_PARTS.format(lineitem='lineitem')} JOIN supplier ON s_suppkey = low JOIN nation ON n_nationkey = s_nationkey), o AS (SELECT q.k AS o, k.* FROM {_ORDERS.format(lineitem='lineitem')} q JOIN k ON k.k = q.part)"

query("el_disjoint", f"WITH {_TWO} SELECT '{G}' AS g, 'http://ex/part/' || k AS cls FROM two")(lambda t: reasoning.Closure.of(frame(t, GEO, SPAN, APART)).unsatisfiable())
query("el_bottom_over_roles", f"""WITH {_LINKS} SELECT '{G}' AS g, 'http://ex/region/0' AS cls UNION ALL SELECT '{G}', 'http://ex/nation/' || n_nationkey FROM nation WHERE n_regionkey = 0
UNION ALL SELECT '{G}', 'http://ex/supplier/' || s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 0
UNION ALL SELECT '{G}', 'http://ex/part/' || k FROM k WHERE n_regionkey = 0 UNION ALL SELECT '{G}', 'http://ex/order/' || o FROM o WHERE n_regionkey = 0""")(
    lambda t: reasoning.Closure.of(frame(t, GEO, SUPPLIED, ORDERED, stated(("<http://ex/region/0>", _SUB, f"<{OWL}Nothing>")))).unsatisfiable())
# a wider property has the domain and the range; the condition asks for the range in a successor by the narrow one
_WIDER = stated(
    ("<http://ex/suppliedBy>", f"<{RDFS}subPropertyOf>", "<http://ex/comesFrom>"), ("<http://ex/comesFrom>", f"<{RDFS}domain>", "<http://ex/Good>"), ("<http://ex/comesFrom>", f"<{RDFS}range>", "<http://ex/Origin>"),
    ("<http://ex/Sourced>", _EQ, "_:sourced"), ("_:sourced", f"<{OWL}onProperty>", "<http://ex/suppliedBy>"), ("_:sourced", f"<{OWL}someValuesFrom>", "<http://ex/Origin>"),
)
query("el_domain_range", f"""SELECT '{G}' AS g, 'http://ex/part/' || k AS child, 'http://ex/' || c AS parent FROM (SELECT DISTINCT l_partkey AS k FROM lineitem) CROSS JOIN (VALUES ('Good'), ('Sourced')) v(c)
UNION ALL SELECT '{G}', 'http://ex/Sourced', 'http://ex/Good'""")(lambda t: reasoning.classify(frame(t, SUPPLIED, _WIDER)))
_CHAIN = stated(
    ("<http://ex/sourcedFrom>", f"<{OWL}propertyChainAxiom>", "_:c0"), ("_:c0", f"<{RDF}first>", "<http://ex/contains>"), ("_:c0", f"<{RDF}rest>", "_:c1"), ("_:c1", f"<{RDF}first>", "<http://ex/suppliedBy>"), ("_:c1", f"<{RDF}rest>", f"<{RDF}nil>"),
)
_FROM = leads("{nation}", iri("from", "n_nationkey"), "'_:f' || n_nationkey", "sourcedFrom", iri("nation", "n_nationkey"), _EQ)
query("el_chain", f"""WITH {_LINKS} SELECT '{G}' AS g, 'http://ex/order/' || o AS child, 'http://ex/from/' || n_nationkey AS parent FROM o
UNION ALL SELECT '{G}', 'http://ex/supplier/' || s_suppkey, 'http://ex/nation/' || s_nationkey FROM supplier""")(
    lambda t: reasoning.classify(frame(t, below("{supplier}", iri("supplier", "s_suppkey"), iri("nation", "s_nationkey")), SUPPLIED, ORDERED, _CHAIN, _FROM)))
_PLACES = leads("{customer}", iri("customer", "c_custkey"), "'_:c' || c_custkey", "within", iri("nation", "c_nationkey")) + leads("{nation}", iri("nation", "n_nationkey"), "'_:n' || n_nationkey", "within", iri("region", "n_regionkey"))
_IN = leads("{region}", iri("in", "r_regionkey"), "'_:i' || r_regionkey", "within", iri("region", "r_regionkey"), _EQ)
query("el_transitive", f"""SELECT '{G}' AS g, 'http://ex/customer/' || c_custkey AS child, 'http://ex/in/' || n_regionkey AS parent FROM customer JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT '{G}', 'http://ex/nation/' || n_nationkey, 'http://ex/in/' || n_regionkey FROM nation""")(
    lambda t: reasoning.classify(frame(t, _PLACES, _IN, stated(("<http://ex/within>", _TYPE, f"<{OWL}TransitiveProperty>")))))


def _justified(t):
    closure = reasoning.Closure.of(frame(t, GEO, SPAN, APART), keep=True)
    goals = closure.unsatisfiable().select("g", F.col("cls").alias("child"), F.lit(f"{OWL}Nothing").alias("parent"))
    return reasoning.justifications(closure, goals).select("child", F.array_join("axioms", "\n").alias("axioms"))


def _axiom(a: str, b: str) -> str:
    return f"{a} || ' {_SUB} ' || {b}"


query("el_justifications", f"""WITH {_TWO} SELECT 'http://ex/part/' || k AS child, array_to_string(list_sort([{", ".join(
    _axiom(*x) for i, s in ((1, "low"), (2, "high")) for x in ((iri("part", "k"), iri("supplier", s)), (iri("supplier", s), iri("nation", f"n{i}")), (iri("nation", f"n{i}"), iri("region", f"r{i}"))))},
'_:apart {_TYPE} <{OWL}AllDisjointClasses>']), chr(10)) AS axioms FROM two""")(_justified)


def _retracted(t):
    closure = reasoning.Closure.of(frame(t, GEO, SPAN, APART), keep=True)
    gone = frame(t, GEO[:1]).where(F.col("o") == "<http://ex/region/1>").select("g", F.concat_ws(" ", "s", "p", "o").alias("ax"))
    return closure.retract(gone).unsatisfiable()


query("el_retracted", f"WITH {_TWO} SELECT '{G}' AS g, 'http://ex/part/' || k AS cls FROM two WHERE r1 <> 1 AND r2 <> 1")(_retracted)
query("el_extended", f"WITH {_TWO} SELECT '{G}' AS g, 'http://ex/part/' || k AS cls FROM two")(lambda t: reasoning.Closure.of(frame(t, GEO, SPAN)).extend(frame(t, GEO, SPAN, APART)).unsatisfiable())
# customers as individuals, a graph per nation: whoever has little credit is in two disjoint classes
_GRAPH = "'<urn:n:' || c_nationkey || '>'"
_MONEY = [(_GRAPH, iri("customer", "c_custkey"), f"'{_TYPE}'", iri("Credit"), "(SELECT * FROM {customer} WHERE c_acctbal > 0)"), (_GRAPH, iri("customer", "c_custkey"), f"'{_TYPE}'", iri("Low"), "(SELECT * FROM {customer} WHERE c_acctbal < 50)"),
          (_GRAPH, iri("Credit"), f"'<{OWL}disjointWith>'", iri("Low"), "(SELECT DISTINCT c_nationkey FROM {customer})")]
query("el_consistency", "SELECT '<urn:n:' || c_nationkey || '>' AS g, NOT bool_or(c_acctbal > 0 AND c_acctbal < 50) AS consistent, 0 AS unsatisfiable FROM customer GROUP BY c_nationkey")(lambda t: reasoning.Closure.of(frame(t, _MONEY)).consistency())
