"""Anonymous class expressions as tables: lists, restrictions, asserters, usage; Manchester rendering; EL classification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplewright.functions import terms as T
from triplewright.functions import text as X
from triplewright.operators.hierarchy import reachable
from triplewright.operators.staging import stage

OWL, RDF, RDFS = "http://www.w3.org/2002/07/owl#", "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#"
#: Restriction predicates and their kinds.
KINDS = {"someValuesFrom": "some", "allValuesFrom": "only", "hasValue": "value", "hasSelf": "self", "minCardinality": "min", "minQualifiedCardinality": "min", "maxCardinality": "max", "maxQualifiedCardinality": "max", "cardinality": "exactly", "qualifiedCardinality": "exactly"}


def lists(quads: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(g, head, pos, item) of every rdf:List; a head is a cell that something else than a list refers to, or that nothing refers to.

    Each round doubles how far lists are followed from their heads, over steps that double too: rows in all are as many as the lists'
    members, not their squares. A circular list ends where it meets itself.
    """
    first = quads.where(F.col("p") == f"<{RDF}first>").select("g", F.col("s").alias("cell"), F.col("o").alias("item"))
    rest = quads.where((F.col("p") == f"<{RDF}rest>") & (F.col("o") != f"<{RDF}nil>")).select("g", F.col("s").alias("cell"), F.col("o").alias("next"))
    cells = stage(first.select("g", "cell").distinct())
    empty = cells.select("g", F.col("cell").alias("head"), F.lit(0).alias("pos"), F.col("cell").alias("item")).limit(0)
    if cells.isEmpty():
        return empty
    step = stage(rest.distinct())
    named = quads.where(F.col("p") != f"<{RDF}rest>").select("g", F.col("o").alias("cell"))
    heads = cells.join(named, ["g", "cell"], "left_semi").unionByName(cells.join(step.select("g", F.col("next").alias("cell")), ["g", "cell"], "left_anti")).distinct()
    found, length = stage(heads.select("g", F.col("cell").alias("head"), "cell", F.lit(0).alias("pos"))), 1
    for _ in range(max_rounds):
        ahead = found.join(step, ["g", "cell"]).select("g", "head", F.col("next").alias("cell"), (F.col("pos") + length).alias("pos"))
        new = stage(ahead.groupBy("g", "head", "cell").agg(F.min("pos").alias("pos")).join(found, ["g", "head", "cell"], "left_anti"))
        if new.isEmpty():
            return found.join(first, ["g", "cell"]).select("g", "head", "pos", "item")
        found, length = stage(found.unionByName(new)), 2 * length
        step = stage(step.select("g", "cell", F.col("next").alias("_m")).join(step.select("g", F.col("cell").alias("_m"), "next"), ["g", "_m"]).select("g", "cell", "next").distinct())
    raise RuntimeError("lists did not end")


def restrictions(quads: DataFrame) -> DataFrame:
    """(g, node, prop, inverse, kind, filler, n): a row per restriction; n is the cardinality, filler its class if qualified."""
    kinds = {f"<{OWL}{k}>": v for k, v in KINDS.items()}
    wanted = quads.where(F.col("p").isin(*kinds, f"<{OWL}onProperty>", f"<{OWL}onClass>", f"<{OWL}onDataRange>"))
    kind = F.coalesce(*(F.when(F.col("p") == p, v) for p, v in kinds.items()))
    node = wanted.groupBy("g", F.col("s").alias("node")).agg(
        F.max(F.when(F.col("p") == f"<{OWL}onProperty>", F.col("o"))).alias("on"),
        F.max(F.when(F.col("p").isin(f"<{OWL}onClass>", f"<{OWL}onDataRange>"), F.col("o"))).alias("on_class"),
        F.max(F.struct(kind.alias("kind"), F.when(F.col("p").isin(*kinds), F.col("o")).alias("value"))).alias("k"),
    ).where("on is not null and k.kind is not null")
    inverse = quads.where(F.col("p") == f"<{OWL}inverseOf>").where("startswith(s, '_:')").select("g", F.col("s").alias("on"), F.col("o").alias("forward"))
    counted = F.col("k.kind").isin("min", "max", "exactly")
    return node.join(inverse, ["g", "on"], "left").select(
        "g", "node", F.coalesce("forward", "on").alias("prop"), F.col("forward").isNotNull().alias("inverse"), F.col("k.kind").alias("kind"),
        F.when(counted, F.coalesce("on_class", F.lit(f"<{OWL}Thing>"))).otherwise(F.col("k.value")).alias("filler"), F.when(counted, T.number(F.col("k.value")).cast("int")).alias("n"),
    )


def asserters(quads: DataFrame) -> DataFrame:
    """(g, cls, node, src): classes below (sub) or equivalent to (eq) a node, directly or as a member of an intersection."""
    direct = quads.where(F.col("p").isin(f"<{RDFS}subClassOf>", f"<{OWL}equivalentClass>") & F.col("s").startswith("<")).select("g", F.col("s").alias("cls"), F.col("o").alias("node"), F.when(F.col("p") == f"<{RDFS}subClassOf>", "sub").otherwise("eq").alias("src"))
    members = quads.where(F.col("p") == f"<{OWL}intersectionOf>").select("g", F.col("s").alias("node"), F.col("o").alias("head")).join(lists(quads), ["g", "head"]).select("g", "node", "item")
    inside = direct.join(members, ["g", "node"]).select("g", "cls", F.col("item").alias("node"), "src")
    return direct.unionByName(inside).distinct()


def facets(quads: DataFrame) -> DataFrame:
    """(g, node, base, facet, value) of datatype restrictions."""
    base = quads.where(F.col("p") == f"<{OWL}onDatatype>").select("g", F.col("s").alias("node"), F.col("o").alias("base"))
    heads = quads.where(F.col("p") == f"<{OWL}withRestrictions>").select("g", F.col("s").alias("node"), F.col("o").alias("head"))
    cells = heads.join(lists(quads), ["g", "head"]).select("g", "node", F.col("item").alias("cell"))
    values = quads.select("g", F.col("s").alias("cell"), F.col("p").alias("facet"), F.col("o").alias("value"))
    return base.join(cells, ["g", "node"]).join(values, ["g", "cell"]).select("g", "node", "base", "facet", "value")


def property_usage(quads: DataFrame, prop: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """Classes with a restriction on a property: (cls, relation, kind, filler), ordered."""
    used = asserters(quads).join(restrictions(quads).where(F.col("prop") == f"<{prop}>"), ["g", "node"])
    return used.select("cls", F.col("src").alias("relation"), "kind", "filler").distinct().orderBy("cls", "relation", "kind", "filler").offset(offset).limit(limit)


def class_usage(quads: DataFrame, cls: str) -> DataFrame:
    """(cls, relation, prop, kind) of restrictions filled by a class and of classes disjoint with it."""
    term = f"<{cls}>"
    filled = asserters(quads).join(restrictions(quads).where(F.col("filler") == term), ["g", "node"]).select("cls", F.col("src").alias("relation"), "prop", "kind")
    apart = disjoint_pairs(quads).where(F.col("a") == term).select(F.col("b").alias("cls"), F.lit("disjoint").alias("relation"), F.lit(None).cast("string").alias("prop"), F.lit(None).cast("string").alias("kind"))
    return filled.unionByName(apart).dropDuplicates(["cls", "relation", "prop", "kind"])


def disjoint_pairs(quads: DataFrame) -> DataFrame:
    """(a, b), both ways, from disjointWith and AllDisjointClasses."""
    stated = quads.where(F.col("p") == f"<{OWL}disjointWith>").select(F.col("s").alias("a"), F.col("o").alias("b"))
    groups = quads.where((F.col("p") == f"<{RDF}type>") & (F.col("o") == f"<{OWL}AllDisjointClasses>")).select("g", F.col("s").alias("node"))
    heads = quads.where(F.col("p") == f"<{OWL}members>").select("g", F.col("s").alias("node"), F.col("o").alias("head"))
    members = groups.join(heads, ["g", "node"]).join(lists(quads), ["g", "head"]).select("g", "node", "item")
    pairs = members.withColumnRenamed("item", "a").join(members.withColumnRenamed("item", "b"), ["g", "node"]).where("a < b").select("a", "b")
    both = stated.unionByName(pairs)
    return both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()


def closure_of_nodes(quads: DataFrame, seeds: DataFrame) -> DataFrame:
    """Triples of the seeds (a column s) and of the blank nodes they lead to by structural predicates."""
    structural = quads.where("startswith(o, '_:')").select("s", "o")
    nodes = seeds.select("s").unionByName(reachable(structural, "s", "o", seeds).select(F.col("o").alias("s"))).distinct()
    return quads.join(nodes, "s", "left_semi")


def schema_properties(quads: DataFrame, cls: str, limit: int = 200) -> DataFrame:
    """(prop, range) of properties whose domain is a class."""
    domain = [f"<{RDFS}domain>", "<http://schema.org/domainIncludes>", "<https://schema.org/domainIncludes>"]
    ranges = [f"<{RDFS}range>", "<http://schema.org/rangeIncludes>", "<https://schema.org/rangeIncludes>"]
    props = quads.where(F.col("p").isin(*domain) & (F.col("o") == f"<{cls}>")).select(F.col("s").alias("prop")).distinct()
    r = quads.where(F.col("p").isin(*ranges)).select(F.col("s").alias("prop"), F.col("o").alias("range")).distinct()
    return props.join(r, "prop", "left").orderBy("prop", "range").limit(limit)


def property_chains(quads: DataFrame) -> DataFrame:
    """(prop, chain) with the chain written p o q."""
    heads = quads.where(F.col("p") == f"<{OWL}propertyChainAxiom>").select("g", F.col("s").alias("prop"), F.col("o").alias("head"))
    named = heads.join(lists(quads), ["g", "head"]).groupBy("g", "prop", "head").agg(F.array_sort(F.collect_list(F.struct("pos", X.local_name(T.lexical(F.col("item"))).alias("n")))).alias("c"))
    return named.select("prop", F.array_join(F.col("c.n"), " o ").alias("chain"))


def manchester(quads: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(g, node, text) of anonymous class expressions in Manchester syntax, rendered from the leaves upwards.

    A round renders every node whose parts are rendered, until nothing is new. labels (iri, label) replace local names.
    """
    terms = quads.select(F.col("o").alias("t")).unionByName(quads.select(F.col("s").alias("t"))).where("not startswith(t, '_:')").distinct()
    name = X.local_name(T.lexical(F.col("t")))
    if labels is not None:
        terms = terms.join(labels.select(F.concat(F.lit("<"), "iri", F.lit(">")).alias("t"), "label"), "t", "left")
        name = F.coalesce("label", name)
    suffix = F.when(T.lang(F.col("t")) != "", F.concat(F.lit("@"), T.lang(F.col("t")))).when(T.datatype(F.col("t")).endswith("#string"), F.lit("")).otherwise(F.concat(F.lit("^^xsd:"), F.substring_index(T.datatype(F.col("t")), "#", -1)))
    known = terms.select("t", F.when(T.is_literal(F.col("t")), F.concat(F.lit('"'), T.lexical(F.col("t")), F.lit('"'), suffix)).otherwise(name).alias("text"), F.lit(False).alias("complex"))
    r = restrictions(quads)
    part = quads.where(F.col("p").isin(f"<{OWL}intersectionOf>", f"<{OWL}unionOf>", f"<{OWL}oneOf>")).select("g", F.col("s").alias("node"), F.col("p").alias("op"), F.col("o").alias("head"))
    members = part.join(lists(quads), ["g", "head"]).select("g", "node", "op", "pos", "item")
    sizes = members.groupBy("g", "node").agg(F.count("*").alias("size"))
    negated = quads.where(F.col("p") == f"<{OWL}complementOf>").select("g", F.col("s").alias("node"), F.col("o").alias("item"))
    known, r, members, sizes = stage(known), stage(r), stage(members), stage(sizes)
    found = None
    while True:
        bracket = F.when(F.col("complex"), F.concat(F.lit("("), "text", F.lit(")"))).otherwise(F.col("text"))
        inner = known.select(F.col("t").alias("item"), "text", "complex")
        prop = known.where("startswith(t, '<')").select(F.col("t").alias("prop"), F.col("text").alias("prop_text"))
        shown = F.concat(F.when(F.col("inverse"), "inverse ").otherwise(""), F.col("prop_text"))
        simple = r.join(prop, "prop").join(inner, r.filler == inner.item, "left").where("text is not null or kind = 'self'").select(
            "g", "node", F.when(F.col("kind") == "self", F.concat(shown, F.lit(" Self"))).when(F.col("n").isNotNull(), F.concat_ws(" ", shown, "kind", F.col("n").cast("string"), bracket)).otherwise(F.concat_ws(" ", shown, "kind", bracket)).alias("text"))
        filled = members.join(inner, "item").groupBy("g", "node", "op").agg(F.array_sort(F.collect_list(F.struct("pos", bracket.alias("b")))).alias("c"), F.count("*").alias("n")).join(sizes, ["g", "node"]).where("n = size")
        word = F.when(F.col("op").endswith("intersectionOf>"), " and ").otherwise(" or ")
        joined = filled.select("g", "node", F.when(F.col("op").endswith("oneOf>"), F.concat(F.lit("{"), F.array_join(F.col("c.b"), ", "), F.lit("}"))).when(F.col("op").endswith("intersectionOf>"), F.array_join(F.col("c.b"), " and ")).otherwise(F.array_join(F.col("c.b"), " or ")).alias("text"))
        nots = negated.join(inner, "item").select("g", "node", F.concat(F.lit("not "), bracket).alias("text"))
        every = stage(simple.unionByName(joined).unionByName(nots).distinct())
        n = every.count()
        if found is not None and n == found[1]:
            break
        found = (every, n)
        known = stage(known.where("not startswith(t, '_:')").unionByName(every.select(F.col("node").alias("t"), "text", (~F.col("text").startswith("{")).alias("complex"))))
    return every


def classify_el(quads: DataFrame) -> DataFrame:
    """(g, child, parent): subsumptions between named classes that follow in EL, in each graph by itself (see reasoning)."""
    from triplewright.operators import reasoning

    return reasoning.classify(quads)


def unsatisfiable(classified: DataFrame) -> DataFrame:
    """(g, cls): classes that owl:Nothing subsumes by a classification (g, child, parent)."""
    return classified.where(F.col("parent") == f"{OWL}Nothing").select("g", F.col("child").alias("cls")).distinct()
