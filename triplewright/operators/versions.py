"""Version order, defaults, predecessors; difference and comparison of versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triplewright.operators.staging import stage

NOT_READY = ("pending", "needs_review", "failed", "deprecated")
TOP = ("http://www.w3.org/2002/07/owl#Thing", "http://www.w3.org/2002/07/owl#topObjectProperty", "http://www.w3.org/2002/07/owl#topDataProperty")


def version_key(iri: Column, created: Column) -> Column:
    """All whole numbers of the version IRI in order, then the time of creation; arrays compare like tuples."""
    return F.struct(F.transform(F.regexp_extract_all(F.coalesce(iri, F.lit("")), F.lit(r"(\d+)"), F.lit(1)), lambda x: x.try_cast("decimal(38,0)")).alias("numbers"), created.alias("created"))


def ready(status: Column) -> Column:
    return ~status.isin(*NOT_READY)


def ordered(versions: DataFrame) -> DataFrame:
    """versions with `position` (1 is the newest of its ontology) and `predecessor`, over ready versions."""
    w = W.partitionBy("ontology_id").orderBy(version_key(F.col("version_iri"), F.col("created_at")).desc(), F.col("id").desc())
    return versions.where(ready(F.col("status"))).withColumn("position", F.row_number().over(w)).withColumn("predecessor", F.lead("id").over(w))


def defaults(versions: DataFrame, pins: DataFrame | None = None) -> DataFrame:
    """(ontology_id, version_id): the pinned version if it is ready, else the newest ready one."""
    key = F.struct(version_key(F.col("version_iri"), F.col("created_at")), F.col("id"))
    usable = versions.where(ready(F.col("status")))
    if pins is not None:
        usable = usable.join(pins.select("ontology_id", "pinned"), "ontology_id", "left")
        key = F.struct(F.coalesce(F.col("pinned") == F.col("id"), F.lit(False)), key)
    return usable.groupBy("ontology_id").agg(F.max_by("id", key).alias("version_id"))


def latest_by_time(versions: DataFrame) -> DataFrame:
    """Ready versions created last of their ontology; ties stay."""
    done = versions.where("status = 'ready'")
    return done.join(done.groupBy("ontology_id").agg(F.max("created_at").alias("created_at")), ["ontology_id", "created_at"])


def consecutive(versions: DataFrame, diffs: DataFrame) -> DataFrame:
    """Versions newest first with the one before, and the status of the difference between the two."""
    w = W.partitionBy("ontology_id").orderBy("created_at", "id")
    pairs = versions.withColumn("previous", F.lag("id").over(w))
    stored = diffs.select(F.col("from_id").alias("previous"), F.col("to_id").alias("id"), F.col("status").alias("diff_status"))
    return pairs.join(stored, ["previous", "id"], "left")


def update_state(current_sha: Column, fetched_sha: Column, current_key: Column, fetched_key: Column) -> Column:
    """What a fetched file is to the stored one."""
    return F.when(current_sha == fetched_sha, "up_to_date").when(fetched_key.isNull(), "unversioned").when(fetched_key < current_key, "skipped").otherwise("available")


def status_rank(status: Column) -> Column:
    return F.when(status == "done", 3).when(status.isin("running", "pending"), 2).when(status == "failed", 1).otherwise(0)


def entity_changes(before: DataFrame, after: DataFrame, facts_before: DataFrame, facts_after: DataFrame) -> DataFrame:
    """(type, iri, change): added, removed, or modified if any fact (iri, pred, value, ...) differs. Entities are (type, iri)."""
    sides = before.select("type", "iri", F.lit(True).alias("old")).join(after.select("type", "iri", F.lit(True).alias("new")), ["type", "iri"], "full_outer")
    key = facts_before.columns
    moved = facts_before.join(facts_after, key, "left_anti").select("iri").unionByName(facts_after.join(facts_before, key, "left_anti").select("iri")).distinct()
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("moved"), "modified")
    return sides.join(moved.withColumn("moved", F.lit(True)), "iri", "left").select("type", "iri", change.alias("change")).where("change is not null")


def literal_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(iri, pred, lang, removed, added) where literals (iri, pred, lang, value) differ; of several values of a key the largest speaks."""
    side = lambda df, name: df.groupBy("iri", "pred", F.coalesce("lang", F.lit("")).alias("lang")).agg(F.max("value").alias(name))
    both = side(before, "removed").join(side(after, "added"), ["iri", "pred", "lang"], "full_outer")
    return both.where("removed is distinct from added")


def structural_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(iri, pred, value, change) of (iri, pred, value) facts, values being IRIs or fingerprints of anonymous nodes."""
    keys = ["iri", "pred", "value"]
    b, a = before.select(*keys).distinct(), after.select(*keys).distinct()
    return b.join(a, keys, "left_anti").withColumn("change", F.lit("removed")).unionByName(a.join(b, keys, "left_anti").withColumn("change", F.lit("added")))


def inferred_changes(before: DataFrame, after: DataFrame, asserted: DataFrame) -> DataFrame:
    """Changes of inferred (child, parent) pairs without tops, reflexive and asserted ones."""
    keys = ["child", "parent"]
    clean = lambda df: df.where(~F.col("parent").isin(*TOP) & (F.col("child") != F.col("parent"))).join(asserted.select(*keys), keys, "left_anti").select(*keys).distinct()
    b, a = clean(before), clean(after)
    return b.join(a, keys, "left_anti").withColumn("change", F.lit("removed")).unionByName(a.join(b, keys, "left_anti").withColumn("change", F.lit("added")))


def fingerprints(triples: DataFrame, depth: int = 10) -> DataFrame:
    """(node, print): a hash of what hangs below each blank node, equal for nodes that differ in name only.

    Bottom-up rounds: a round hashes a node's sorted predicate-object lines, blank objects standing by the round before; what is deeper than
    `depth`, or circular, reads as max. Rounds are written, and end when none of the prints changes.
    """
    blank = stage(triples.where("startswith(s, '_:')").select("s", "p", "o"))
    nodes = blank.select(F.col("s").alias("node")).distinct().withColumn("print", F.lit("max"))
    for _ in range(depth):
        known = nodes.select(F.col("node").alias("o"), F.col("print").alias("_print"))
        lines = blank.join(known, "o", "left").select("s", F.concat_ws("\t", "p", F.coalesce("_print", "o")).alias("line"))
        before, nodes = nodes, stage(lines.groupBy(F.col("s").alias("node")).agg(F.substring(F.sha1(F.array_join(F.array_sort(F.collect_list("line")), "\n")), 1, 16).alias("print")))
        if nodes.join(before, ["node", "print"], "left_anti").isEmpty():
            break
    return nodes


def reasoning_status(version_ids: DataFrame, jobs: DataFrame) -> DataFrame:
    """(version_id, status): ready, pending, failed or missing by the best of each version's reasoning jobs (version_id, type, status)."""
    best = jobs.where("type = 'reason'").groupBy("version_id").agg(F.max(status_rank(F.col("status"))).alias("rank"))
    names = F.array(*map(F.lit, ("missing", "failed", "pending", "ready")))
    return version_ids.select("version_id").distinct().join(best, "version_id", "left").select("version_id", F.element_at(names, F.coalesce("rank", F.lit(0)) + 1).alias("status"))


def stale_diffs(diffs: DataFrame, ready_ids: DataFrame) -> DataFrame:
    """Finished differences (from_id, to_id, from_state, to_state) one of whose sides wasn't ready when they were made, and is now. A null state wasn't ready."""
    ready = ready_ids.select("id").distinct()
    out = diffs.where("status = 'ready'")
    for side in ("from", "to"):
        out = out.join(ready.select(F.col("id").alias(f"{side}_id"), F.lit(True).alias(f"_{side}")), f"{side}_id", "left")
    late = [F.col(f"_{side}") & ~F.col(f"{side}_state").eqNullSafe("ready") for side in ("from", "to")]
    return out.where(F.coalesce(late[0], F.lit(False)) | F.coalesce(late[1], F.lit(False))).select(*diffs.columns)
