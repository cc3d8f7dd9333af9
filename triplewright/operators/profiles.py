"""OWL 2 profiles by position: which axioms and class expressions of a graph keep it out of EL, QL, RL or DL.

A class expression stands on the left of an inclusion (sub), on the right (super), or both; that is passed down the trees of expressions: to fillers
and members as it is, through a complement, and to the filler of a maximum, as sub. What a profile allows depends on it (FIXED RULES below, as the standard has
them). DL asks that only simple properties stand in cardinalities, Self and functional, irreflexive, asymmetric or disjoint properties, that property
chains have an order, and that no property is of two kinds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplewright.operators.axioms import OWL, RDF, RDFS, lists, restrictions
from triplewright.operators.hierarchy import reachable
from triplewright.operators.staging import stage

XSD = "http://www.w3.org/2001/XMLSchema#"
PROFILES = ("EL", "QL", "RL", "DL")
#: FIXED RULES. What each profile allows of class expressions: (profile, position) -> SQL over kind, filler, size, n.
ALLOWED = {
    ("EL", "sub"): "kind in ('and', 'some', 'value', 'self') or (kind = 'oneOf' and size = 1)",
    ("EL", "super"): "kind in ('and', 'some', 'value', 'self') or (kind = 'oneOf' and size = 1)",
    ("QL", "sub"): f"kind = 'some' and (filler = '<{OWL}Thing>' or data)",
    ("QL", "super"): "kind in ('and', 'not') or (kind = 'some' and not startswith(filler, '_:'))",
    ("RL", "sub"): "kind in ('and', 'or', 'oneOf', 'some', 'value')",
    ("RL", "super"): "kind in ('and', 'not', 'only', 'value') or (kind = 'max' and n <= 1)",
}
#: FIXED RULES. Predicates and types of axioms that a profile doesn't have.
BARRED = {
    "EL": ("inverseOf", "disjointUnionOf", "propertyDisjointWith", "AllDisjointProperties", "IrreflexiveProperty", "AsymmetricProperty", "SymmetricProperty", "InverseFunctionalProperty"),
    "QL": ("disjointUnionOf", "propertyChainAxiom", "hasKey", "sameAs", "FunctionalProperty", "InverseFunctionalProperty", "TransitiveProperty", "NegativePropertyAssertion"),
    "RL": ("disjointUnionOf", "ReflexiveProperty"),
}
#: FIXED RULES. Datatypes that EL and QL don't have.
OTHER_TYPES = ("boolean", "double", "float", "long", "int", "short", "byte", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte", "positiveInteger", "negativeInteger", "nonPositiveInteger", "language")
#: Uses that ask for a simple property, as types of the property.
_SIMPLE_TYPES = ("FunctionalProperty", "InverseFunctionalProperty", "IrreflexiveProperty", "AsymmetricProperty")
_SETS = {"intersectionOf": "and", "unionOf": "or", "oneOf": "oneOf"}


def _owl(*names: str) -> list[str]:
    return [f"<{OWL}{n}>" for n in names]


def expressions(quads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((g, node, kind, filler, size, n), (g, node, child, kind)): class expressions, and what stands in them."""
    r = restrictions(quads).select("g", "node", "kind", "filler", F.lit(0).alias("size"), "n")
    members = stage(quads.where(F.col("p").isin(*_owl(*_SETS))).select("g", F.col("s").alias("node"), F.col("p").alias("op"), F.col("o").alias("head")).join(lists(quads), ["g", "head"]))
    kind = F.coalesce(*(F.when(F.col("op") == f"<{OWL}{p}>", k) for p, k in _SETS.items()))
    sets = members.groupBy("g", "node", kind.alias("kind")).agg(F.count("*").cast("int").alias("size")).select("g", "node", "kind", F.lit(None).cast("string").alias("filler"), "size", F.lit(None).cast("int").alias("n"))
    nots = quads.where(F.col("p") == f"<{OWL}complementOf>").select("g", F.col("s").alias("node"), F.lit("not").alias("kind"), F.col("o").alias("filler"), F.lit(0).alias("size"), F.lit(None).cast("int").alias("n"))
    every = stage(r.unionByName(sets).unionByName(nots).distinct())
    parts = every.where("filler is not null and kind not in ('value', 'self')").select("g", "node", F.col("filler").alias("child"), "kind")
    return every, parts.unionByName(members.where(kind != "oneOf").select("g", "node", F.col("item").alias("child"), kind.alias("kind")))


def positions(quads: DataFrame, parts: DataFrame) -> DataFrame:
    """(g, node, position) of the class expressions that axioms hold."""
    by = lambda *names: quads.where(F.col("p").isin(*names))
    at = lambda df, column, position: df.select("g", F.concat(F.lit(f"{position} "), column).alias("at"))
    sub, same, apart = by(f"<{RDFS}subClassOf>"), by(*_owl("equivalentClass")), by(*_owl("disjointWith"))
    groups = quads.where((F.col("p") == f"<{RDF}type>") & (F.col("o") == f"<{OWL}AllDisjointClasses>")).select("g", "s")
    listed = by(*_owl("members")).join(groups, ["g", "s"]).select("g", F.col("o").alias("head")).join(lists(quads), ["g", "head"])
    typed = by(f"<{RDF}type>").where(F.col("o").startswith("_:"))
    # a class that an expression's triples hang on directly is defined by it: both positions
    named = by(*_owl(*_SETS, "complementOf")).where(F.col("s").startswith("<"))
    seeds = [at(sub, "s", "sub"), at(sub, "o", "super"), at(apart, "s", "sub"), at(apart, "o", "sub"), at(listed, "item", "sub"), at(by(f"<{RDFS}domain>", f"<{RDFS}range>"), "o", "super"), at(typed, "o", "super")]
    seeds += [at(df, c, p) for df, c in ((same, "s"), (same, "o"), (named, "s")) for p in ("sub", "super")]
    start = seeds[0]
    for more in seeds[1:]:
        start = start.unionByName(more)
    start = stage(start.distinct())
    steps = None
    for p in ("sub", "super"):
        # the operand of a complement and the filler of a maximum are on the left
        child = F.when(F.col("kind").isin("not", "max"), F.concat(F.lit("sub "), "child")).otherwise(F.concat(F.lit(f"{p} "), "child"))
        more = parts.select("g", F.concat(F.lit(f"{p} "), "node").alias("at"), child.alias("to"))
        steps = more if steps is None else steps.unionByName(more)
    every = start.unionByName(reachable(steps, "at", "to", start, ["g"]).select("g", F.col("to").alias("at"))).distinct()
    return every.select("g", F.expr("substring(at, locate(' ', at) + 1)").alias("node"), F.substring_index("at", " ", 1).alias("position"))


def violations(quads: DataFrame) -> DataFrame:
    """(g, profile, kind, term): what keeps a graph out of a profile, each term of each kind once."""
    every, parts = expressions(quads)
    data = F.coalesce(F.col("filler").startswith(f"<{XSD}") | (F.col("filler") == f"<{RDFS}Literal>"), F.lit(False))
    placed = stage(every.withColumn("data", data).join(positions(quads, parts), ["g", "node"]).distinct())
    row = lambda df, profile, kind, term: df.select("g", F.lit(profile).alias("profile"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), F.col(term).alias("term"))
    out = []
    for (profile, position), allowed in ALLOWED.items():
        out.append(row(placed.where((F.col("position") == position) & ~F.coalesce(F.expr(allowed), F.lit(False))), profile, F.concat("kind", F.lit(f" on the {'left' if position == 'sub' else 'right'}")), "node"))
    local = lambda c: F.substring_index(F.regexp_replace(c, ">$", ""), "#", -1)
    objects = quads.where((F.col("p") == f"<{RDF}type>") & (F.col("o") == f"<{OWL}ObjectProperty>")).select("g", "s").distinct()
    for profile, names in BARRED.items():
        used = quads.where(F.col("p").isin(*_owl(*names)) | ((F.col("p") == f"<{RDF}type>") & F.col("o").isin(*_owl(*names))))
        out.append(row(used, profile, local(F.when(F.col("p") == f"<{RDF}type>", F.col("o")).otherwise(F.col("p"))), "s"))
    functional = quads.where((F.col("p") == f"<{RDF}type>") & (F.col("o") == f"<{OWL}FunctionalProperty>")).join(objects, ["g", "s"], "left_semi")
    out.append(row(functional, "EL", "FunctionalProperty", "s"))  # functional data properties are in EL
    types = [f"<{XSD}{t}>" for t in OTHER_TYPES]
    for profile in ("EL", "QL"):
        out.append(row(quads.where((F.col("p") == f"<{RDFS}range>") & F.col("o").isin(types)), profile, "datatype", "o"))
        out.append(row(placed.where(F.col("filler").isin(types)), profile, "datatype", "filler"))
    out += _global(quads, row)
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole.distinct()


def _global(quads: DataFrame, row) -> list[DataFrame]:
    """Violations of what DL asks of properties."""
    by = lambda *names: quads.where(F.col("p").isin(*names))
    typed = lambda *names: quads.where((F.col("p") == f"<{RDF}type>") & F.col("o").isin(*_owl(*names)))
    chains = stage(by(*_owl("propertyChainAxiom")).select("g", F.col("s").alias("prop"), F.col("o").alias("head")).join(lists(quads), ["g", "head"]).select("g", "prop", "head", "pos", "item"))
    same = by(*_owl("equivalentProperty"))
    wider = by(f"<{RDFS}subPropertyOf>").unionByName(same).select("g", F.col("s").alias("prop"), F.col("o").alias("wider")).unionByName(same.select("g", F.col("o").alias("prop"), F.col("s").alias("wider")))
    composed = typed("TransitiveProperty").select("g", F.col("s").alias("prop")).unionByName(chains.select("g", "prop")).distinct()
    loose = stage(composed.unionByName(reachable(wider, "prop", "wider", composed, ["g"]).select("g", F.col("wider").alias("prop"))).distinct())
    counted = restrictions(quads).where("kind in ('min', 'max', 'exactly', 'self')").select("g", "prop", F.when(F.col("kind") == "self", "Self").otherwise("cardinality").alias("use"))
    local = F.substring_index(F.regexp_replace("o", ">$", ""), "#", -1)
    asked = counted.unionByName(typed(*_SIMPLE_TYPES).select("g", F.col("s").alias("prop"), local.alias("use")))
    apart = by(*_owl("propertyDisjointWith"))
    asked = asked.unionByName(apart.select("g", F.col("s").alias("prop"), F.lit("propertyDisjointWith").alias("use"))).unionByName(apart.select("g", F.col("o").alias("prop"), F.lit("propertyDisjointWith").alias("use")))
    simple = row(asked.join(loose, ["g", "prop"], "left_semi"), "DL", F.concat(F.lit("not simple: "), "use"), "prop")
    # r after r, r at the one end of its own chain: allowed; any other member comes before the chain's property
    ends = chains.groupBy("g", "prop", "head").agg(F.max("pos").alias("end"), F.count(F.when(F.col("item") == F.col("prop"), 1)).alias("own"))
    placed = chains.join(ends, ["g", "prop", "head"])
    inner = placed.where("item = prop and not (end = 1 and own = 2) and (own > 1 or not (pos = 0 or pos = end))").select("g", "prop")
    before = placed.where("item <> prop").select("g", F.col("item").alias("a"), F.col("prop").alias("b")).unionByName(wider.select("g", F.col("prop").alias("a"), F.col("wider").alias("b")))
    cyclic = reachable(before, "a", "b", by=["g"]).where("a = b").select("g", F.col("a").alias("prop"))
    irregular = row(inner.unionByName(cyclic.join(chains.select("g", "prop").unionByName(chains.select("g", F.col("item").alias("prop"))).distinct(), ["g", "prop"], "left_semi")), "DL", "chains without an order", "prop")
    kinds = typed("ObjectProperty", "DatatypeProperty", "AnnotationProperty").groupBy("g", F.col("s").alias("prop")).agg(F.count_distinct("o").alias("k")).where("k > 1")
    return [simple, irregular, row(kinds, "DL", "a property of two kinds", "prop")]


def verdicts(quads: DataFrame) -> DataFrame:
    """(g, profile, conforms, violations) of every graph; what isn't in DL is in no profile."""
    found = stage(violations(quads))
    counts = found.groupBy("g", "profile").agg(F.count("*").alias("violations"))
    broken = found.where("profile = 'DL'").select("g").distinct().withColumn("outside", F.lit(True))
    every = quads.select("g").distinct().withColumn("profile", F.explode(F.array(*map(F.lit, PROFILES))))
    out = every.join(counts, ["g", "profile"], "left").join(broken, "g", "left")
    return out.select("g", "profile", (F.col("violations").isNull() & F.col("outside").isNull()).alias("conforms"), F.coalesce("violations", F.lit(0)).alias("violations"))


#: FIXED VALUES: kinds of errors by what a reader's message holds, the first that fits.
ERROR_KINDS = (
    ("invalid_annotation", ("invalid annotation found",)), ("equivalent_class_undeclared", ("unknown entity in equivalent class",)),
    ("property_kind", ("types of two properties do not match", "unexpected property kind", "cannot distinguish the types")),
    ("annotation_property_equivalent", ("annotation properties cannot be equivalent",)), ("rdf_syntax", ("parsererror", "syntax")),
)


def error_kind(message):
    """The kind of a reader's error message (a column); 'other' if none is known."""
    text, out = F.lower(message), None
    for kind, signs in ERROR_KINDS:
        hit = text.contains(signs[0])
        for s in signs[1:]:
            hit = hit | text.contains(s)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("other")
