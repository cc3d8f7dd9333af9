"""Hierarchies as edge tables: closure by fixpoint, roots, children, reduction, paths.

Edges are (child, parent), optionally with other columns such as version_id that keep hierarchies apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplewright.operators.staging import stage

THING = "http://www.w3.org/2002/07/owl#Thing"
NOTHING = "http://www.w3.org/2002/07/owl#Nothing"


def reachable(edges: DataFrame, source: str, target: str, seeds: DataFrame | None = None, by: list[str] = (), max_rounds: int = 1000) -> DataFrame:
    """Distinct pairs (*by, source, target) connected by one or more edges; cycles end by themselves.

    seeds (a column `source`, and by): only pairs from there; then each round follows the new frontier over the edges, which stay as
    they are. Without seeds each round joins the pairs that the round before it found with all pairs, so that rounds grow with the logarithm of
    the longest path and no pair of known ones is joined again. Every round is written to the shared folder.
    """
    by = list(by)
    edges = edges.select(*by, source, target).where(F.col(source).isNotNull() & F.col(target).isNotNull()).distinct()
    if seeds is None:
        found = new = stage(edges)
        for _ in range(max_rounds):
            if new.isEmpty():
                return found
            joined = lambda a, b: a.withColumnRenamed(target, "_m").join(b.withColumnRenamed(source, "_m"), [*by, "_m"]).select(*by, source, target)
            step = joined(new, found).unionByName(joined(found, new)).distinct()
            new = stage(step.join(found, [*by, source, target], "left_anti"))
            found = stage(found.unionByName(new))
        raise RuntimeError("closure did not end")
    keys = [*by, source]
    found = stage(edges.join(seeds.select(*keys).distinct(), keys, "left_semi"))
    if found.isEmpty():
        return found
    edges = stage(edges)
    frontier, parts = found, [found]
    for _ in range(max_rounds):
        step = frontier.withColumnRenamed(target, "_m").join(edges.withColumnRenamed(source, "_m"), [*by, "_m"]).select(*by, source, target).distinct()
        known = parts[0]
        for p in parts[1:]:
            known = known.unionByName(p)
        frontier = stage(step.join(known, [*by, source, target], "left_anti"))
        if frontier.isEmpty():
            return known
        parts.append(frontier)
        if len(parts) > 16:
            parts = [stage(known.unionByName(frontier))]
    raise RuntimeError("closure did not end")


def extract_edges(quads: DataFrame) -> DataFrame:
    """(g, child, parent, kind) from IRI-IRI subClassOf and subPropertyOf triples; owl:Thing parents are left out."""
    rdfs = "http://www.w3.org/2000/01/rdf-schema#"
    kind = F.when(F.col("p") == f"<{rdfs}subClassOf>", "class").when(F.col("p") == f"<{rdfs}subPropertyOf>", "property")
    inside = lambda c: F.col(c).substr(F.lit(2), F.length(c) - 2)
    return quads.where(F.col("p").isin(f"<{rdfs}subClassOf>", f"<{rdfs}subPropertyOf>") & F.col("s").startswith("<") & F.col("o").startswith("<") & (F.col("o") != f"<{THING}>")).select("g", inside("s").alias("child"), inside("o").alias("parent"), kind.alias("kind")).distinct()


def replace_edges(stored: DataFrame, new: DataFrame, kinds: list[str]) -> DataFrame:
    """Stored edges with those of the new ones' versions and of these kinds replaced."""
    stale = new.select("version_id").distinct()
    keep = stored.join(stale, "version_id", "left_semi").where(~F.col("kind").isin(kinds)).unionByName(stored.join(stale, "version_id", "left_anti"))
    return keep.unionByName(new.where(F.col("kind").isin(kinds)).select(*stored.columns))


def roots(entities: DataFrame, edges: DataFrame, key: str = "iri", by: list[str] = ()) -> DataFrame:
    """Entities that are nobody's child, with has_children."""
    by = list(by)
    top = entities.join(edges.select(*by, F.col("child").alias(key)).distinct(), [*by, key], "left_anti")
    return with_children_flag(top, edges, key, by)


def with_children_flag(entities: DataFrame, edges: DataFrame, key: str = "iri", by: list[str] = ()) -> DataFrame:
    by = list(by)
    parents = edges.select(*by, F.col("parent").alias(key)).distinct().withColumn("has_children", F.lit(True))
    return entities.join(parents, [*by, key], "left").withColumn("has_children", F.coalesce("has_children", F.lit(False)))


def one_hop(entities: DataFrame, edges: DataFrame, iri: str, direction: str = "children", key: str = "iri") -> DataFrame:
    """Entities one edge below (children) or above (parents) an entity, with has_children."""
    a, b = ("parent", "child") if direction == "children" else ("child", "parent")
    near = edges.where(F.col(a) == iri).select(F.col(b).alias(key)).distinct()
    return with_children_flag(entities.join(near, key), edges, key)


def walk(entities: DataFrame, edges: DataFrame, iri: str, direction: str = "descendants", key: str = "iri") -> DataFrame:
    """Entities any number of edges below or above; the start itself only if it lies on a cycle."""
    a, b = ("parent", "child") if direction == "descendants" else ("child", "parent")
    seeds = edges.sparkSession.createDataFrame([(iri,)], f"{a} string")
    return entities.join(reachable(edges, a, b, seeds).select(F.col(b).alias(key)), key, "left_semi")


def reduce_direct(closure: DataFrame, unsatisfiable: DataFrame | None = None, declared: DataFrame | None = None) -> DataFrame:
    """(child, parent): nearest inferred parents from a transitive closure (child, parent).

    owl:Thing is dropped; a parent is direct if no other parent of the child that isn't equivalent to either lies below it; equivalent classes are each other's parents; unsatisfiable classes hang below owl:Nothing alone;
    parents that aren't declared give way to their nearest declared ancestors.
    """
    pairs = closure.where((F.col("parent") != THING) & (F.col("child") != F.col("parent")))
    if declared is not None:
        pairs = pairs.join(declared.select(F.col("iri").alias("parent")), "parent", "left_semi").select("child", "parent")
    if unsatisfiable is not None:
        pairs = pairs.join(unsatisfiable.select(F.col("iri").alias("child")), "child", "left_anti").select("child", "parent")
    # classes that reach each other are one: the graph of their least names has no cycles, and is reduced in their place
    both = stage(equivalents(pairs))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("one"))
    for c in ("child", "parent"):
        pairs = pairs.join(least.select(F.col("a").alias(c), F.col("one").alias(f"{c}_one")), c, "left").withColumn(f"{c}_one", F.coalesce(f"{c}_one", c))
    pairs = stage(pairs.distinct())
    ones = stage(pairs.where("child_one <> parent_one").select(F.col("child_one").alias("child"), F.col("parent_one").alias("parent")).distinct())
    far = ones.withColumnRenamed("parent", "q").join(ones.withColumnRenamed("child", "q"), "q").select("child", "parent").distinct()
    near = ones.join(far, ["child", "parent"], "left_anti").select(F.col("child").alias("child_one"), F.col("parent").alias("parent_one"))
    out = pairs.join(near, ["child_one", "parent_one"], "left_semi").select("child", "parent").unionByName(both.select(F.col("a").alias("child"), F.col("b").alias("parent"))).distinct()
    if unsatisfiable is not None:
        out = out.unionByName(unsatisfiable.select(F.col("iri").alias("child"), F.lit(NOTHING).alias("parent")))
    return out


def distances(edges: DataFrame, source: str, target: str, seeds: DataFrame, by: list[str] = ()) -> DataFrame:
    """(*by, source, target, steps): what the seeds (source, by) reach, and by how many edges at least."""
    by = list(by)
    edges = stage(edges.select(*by, source, target).where(F.col(source).isNotNull() & F.col(target).isNotNull()).distinct())
    found = front = stage(edges.join(seeds.select(*by, source).distinct(), [*by, source], "left_semi").withColumn("steps", F.lit(1)))
    steps = 1
    while not front.isEmpty():
        steps += 1
        step = front.select(*by, source, F.col(target).alias("_m")).join(edges.withColumnRenamed(source, "_m"), [*by, "_m"]).select(*by, source, target).distinct()
        front = stage(step.join(found, [*by, source, target], "left_anti").withColumn("steps", F.lit(steps)))
        found = stage(found.unionByName(front))
    return found


def shortest_path(edges: DataFrame, start: str, goal: str) -> list[str] | None:
    """Nodes of a shortest path from child to ancestor; of several the smallest by its nodes. None if there is no path."""
    spark = edges.sparkSession
    frontier = spark.createDataFrame([(start, [start])], "node string, path array<string>")
    seen = frontier.select("node")
    if start == goal:
        return [start]
    while True:
        step = frontier.join(edges, frontier.node == edges.child).groupBy(F.col("parent").alias("node")).agg(F.min(F.concat("path", F.array("parent"))).alias("path"))
        frontier = stage(step.join(seen, "node", "left_anti"))
        hit = frontier.where(F.col("node") == goal).select("path").first()
        if hit:
            return list(hit.path)
        if frontier.isEmpty():
            return None
        seen = stage(seen.unionByName(frontier.select("node")))


def equivalents(closure: DataFrame) -> DataFrame:
    """Pairs (a, b) that reach each other, a and b different."""
    back = closure.select(F.col("parent").alias("child"), F.col("child").alias("parent"))
    return closure.join(back, ["child", "parent"]).where("child <> parent").select(F.col("child").alias("a"), F.col("parent").alias("b")).distinct()


def inferred_superclasses(direct: DataFrame, asserted: DataFrame) -> DataFrame:
    """Closure of direct parents without reflexive and asserted pairs."""
    return reachable(direct, "child", "parent").where("child <> parent").join(asserted.select("child", "parent"), ["child", "parent"], "left_anti")
