"""Canonical keys of anonymous class expressions: two expressions have one key if they are the same but for node names, order, repeats and brackets.

Keys are made from the leaves upwards, a round per level of nesting, each written to the shared folder: a term is its own key; a compound's key is a hash of its
kind and its parts' keys. Members of an intersection or union are a set, and a member that is of the same kind counts as its members. `key_of_*` make
the same keys for expressions that aren't in the store.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplewright.operators.axioms import OWL, facets, lists, restrictions
from triplewright.operators.staging import stage

_END = "\x1f"
_SETS = {f"<{OWL}intersectionOf>": "and", f"<{OWL}unionOf>": "or", f"<{OWL}oneOf>": "oneOf"}


def key_of(kind: str, *parts: str) -> str:
    return hashlib.sha256(_END.join([kind, *parts]).encode()).hexdigest()


def key_of_set(kind: str, parts: list[tuple[str, str | None, list[str]]]) -> tuple[str, str, list[str]]:
    """(key, kind, members' keys) of an intersection or union of parts of this form; parts that aren't sets have no members."""
    flat = sorted({k for key, of, members in parts for k in (members if of == kind else [key])})
    return (flat[0], None, []) if len(flat) == 1 else (key_of(kind, *flat), kind, flat)


def key_of_restriction(kind: str, prop: str, inverse: bool, n: int | None, filler: str) -> str:
    return key_of(kind, prop, "inverse" if inverse else "", "" if n is None else str(n), filler)


def key_of_data(base: str, of: list[tuple[str, str]]) -> str:
    return key_of("data", base, *sorted({f"{facet} {value}" for facet, value in of}))


def keys(quads: DataFrame) -> DataFrame:
    """(g, node, key, kind, members) of each class expression all parts of which are known."""
    hashed = lambda *parts: F.sha2(F.concat_ws(_END, *parts), 256)
    r = stage(restrictions(quads).distinct())
    sets = quads.where(F.col("p").isin(*_SETS)).select("g", F.col("s").alias("node"), F.coalesce(*(F.when(F.col("p") == p, k) for p, k in _SETS.items())).alias("of"), F.col("o").alias("head"))
    members = stage(sets.join(lists(quads), ["g", "head"]).select("g", "node", "of", "pos", "item"))
    negated = stage(quads.where(F.col("p") == f"<{OWL}complementOf>").select("g", F.col("s").alias("node"), F.col("o").alias("item")))
    sizes = members.groupBy("g", "node", "of").agg(F.count("*").alias("size"))
    none = F.array().cast("array<string>")
    data = facets(quads).groupBy("g", "node", "base").agg(F.array_sort(F.collect_set(F.concat_ws(" ", "facet", "value"))).alias("f"))  # as many as one restriction has
    found = stage(data.select("g", "node", hashed(F.lit("data"), "base", F.array_join("f", _END)).alias("key"), F.lit(None).cast("string").alias("kind"), none.alias("members")))
    while True:
        known = found.select("g", F.col("node").alias("item"), "key", "kind", "members")

        def parts(df: DataFrame, item: str) -> DataFrame:
            """df with the key of its term `item`: the term itself, or what is known of the node."""
            plain = df.where(~F.col(item).startswith("_:")).select("*", F.col(item).alias("key"), F.lit(None).cast("string").alias("kind"), none.alias("members"))
            return plain.unionByName(df.where(F.col(item).startswith("_:")).join(known.withColumnRenamed("item", item), ["g", item]).select(*df.columns, "key", "kind", "members"))

        text = F.coalesce(F.col("n").cast("string"), F.lit(""))
        filled = parts(r.withColumnRenamed("kind", "how"), "filler")
        simple = filled.select("g", "node", hashed("how", "prop", F.when(F.col("inverse"), "inverse").otherwise(""), text, "key").alias("key"), F.lit(None).cast("string").alias("kind"), none.alias("members"))
        flat = F.when(F.col("kind") == F.col("of"), F.col("members")).otherwise(F.array("key"))
        whole = parts(members, "item").groupBy("g", "node", "of").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(flat)))).alias("all"), F.count("*").alias("n")).join(sizes, ["g", "node", "of"]).where("n = size")
        single = F.size("all") == 1
        joined = whole.select("g", "node", F.when(single, F.col("all")[0]).otherwise(hashed("of", F.array_join("all", _END))).alias("key"), F.when(~single, F.col("of")).alias("kind"), F.when(single, none).otherwise(F.col("all")).alias("members"))
        nots = parts(negated, "item").select("g", "node", hashed(F.lit("not"), "key").alias("key"), F.lit(None).cast("string").alias("kind"), none.alias("members"))
        every = simple.unionByName(joined).unionByName(nots).where("startswith(node, '_:')")
        new = stage(every.join(found, ["g", "node"], "left_anti").dropDuplicates(["g", "node"]))
        if new.isEmpty():
            return found
        found = stage(found.unionByName(new))
