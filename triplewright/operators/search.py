"""Entity search: prefix, full-text and fuzzy tiers, vectors, rank fusion, paging by key.

Entities have iri, label, norm (normalised label), short, search_text, type and version_id. Tiers are filters over the same table with a
top-k at the end, so that nothing but the hits is sorted.
"""

from __future__ import annotations

import base64
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triplewright.functions.text import word_similarity

RRF = 60
SIMILAR = 0.4


def normalise(query: str) -> str:
    text = re.sub(r"\s+", " ", re.sub(r"[^\w\s:<>]", " ", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", query).lower())).strip()
    return re.sub(r"^(the|a|an) ", "", text)


def tokens(query: str) -> list[str]:
    """Words of a full-text query: letters, digits, _ and - stay."""
    return [t for t in (re.sub(r"[^\w-]", "", w) for w in normalise(query).split()) if t]


def scoped(entities: DataFrame, types: list[str] | None = None, versions: list[str] | None = None) -> DataFrame:
    """Entities of some types and versions; an empty list means none."""
    if types is not None:
        entities = entities.where(F.col("type").isin(types) if types else F.lit(False))
    if versions is not None:
        entities = entities.where(F.col("version_id").isin(versions) if versions else F.lit(False))
    return entities


def prefix_tier(entities: DataFrame, query: str) -> DataFrame:
    """Labels that begin with the query: the exact ones first, then short ones."""
    q = normalise(query)
    return entities.where(F.col("norm").startswith(q)).withColumn("tier", F.lit(1)).withColumn("r1", F.when(F.col("norm") == q, 0.0).otherwise(1.0))


def text_tier(entities: DataFrame, query: str) -> DataFrame:
    """All words occur, the last as a beginning; hits of the prefix tier are left out."""
    words, found = tokens(query), F.split(F.lower("search_text"), r"[^\p{L}\p{N}_]+")
    if not words:
        return entities.where(F.lit(False)).withColumn("tier", F.lit(2)).withColumn("r1", F.lit(0.0))
    every: Column = F.exists(found, lambda t: t.startswith(words[-1]))
    for w in words[:-1]:
        every = every & F.array_contains(found, w)
    return entities.where(every & ~F.col("norm").startswith(normalise(query))).withColumn("tier", F.lit(2)).withColumn("r1", F.lit(0.0))


def fuzzy_tier(entities: DataFrame, query: str) -> DataFrame:
    """Labels of which a stretch resembles the query by trigrams."""
    similar = entities.withColumn("r1", -F.round(word_similarity(normalise(query), F.col("norm")), 6)).where(F.col("r1") <= -SIMILAR)
    return similar.withColumn("tier", F.lit(3))


def ranked(hits: DataFrame, limit: int) -> DataFrame:
    """The best row of each IRI, best rows first: tier, rank in the tier, label length, label, IRI."""
    order = ["tier", "r1", F.length("label"), "label", "iri"]
    one = hits.withColumn("_n", F.row_number().over(W.partitionBy("iri").orderBy(*order[:-1], "version_id"))).where("_n = 1")
    return one.orderBy(*order).limit(limit).select("iri", "label", "type", "version_id", "tier")


def search(entities: DataFrame, query: str, limit: int = 20, types: list[str] | None = None, versions: list[str] | None = None) -> DataFrame:
    """Prefix and full-text tiers."""
    pool = scoped(entities, types, versions)
    if not normalise(query):
        pool = pool.where(F.lit(False))
    return ranked(prefix_tier(pool, query).unionByName(text_tier(pool, query)), limit)


def autocomplete(entities: DataFrame, query: str, limit: int = 10, types: list[str] | None = None, versions: list[str] | None = None) -> DataFrame:
    """Nothing below two characters; the fuzzy tier from three on."""
    pool = scoped(entities, types, versions)
    if len(query.strip()) < 2:
        pool = pool.where(F.lit(False))
    hits = prefix_tier(pool, query).unionByName(text_tier(pool, query))
    if len(query.strip()) >= 3:
        hits = hits.unionByName(fuzzy_tier(pool, query).select(*hits.columns))
    return ranked(hits, limit)


def fetch_ranked(entities: DataFrame, iris: list[str]) -> DataFrame:
    """Entities of the IRIs in the order given, each with its shortest label; annotation properties are left out."""
    wanted = entities.sparkSession.createDataFrame(list({i: (k, i) for k, i in reversed(list(enumerate(iris)))}.values()), "rank int, iri string")
    best = W.partitionBy("iri").orderBy(F.length("label"), "label", "version_id")
    found = entities.where(F.col("iri").isin(iris) & (F.col("type") != "annotation_property")).withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    return found.join(F.broadcast(wanted), "iri").orderBy("rank")  # as many rows as the caller's list


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector_top(vectors: DataFrame, query: list[float], k: int, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest by cosine, scores rounded to four places; an exact scan with a top-k."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select(id, F.round(cosine(F.col(vector), q), 4).alias("score")).orderBy(F.desc("score"), id).limit(k)


def neighbours(vectors: DataFrame, of: int, k: int, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Nearest stored vectors of a stored one, itself left out."""
    row = vectors.where(F.col(id) == of).select(vector).first()
    return vector_top(vectors.where(F.col(id) != of), list(row[0]), k, id, vector) if row else vectors.select(id, F.lit(0.0).alias("score")).limit(0)


def fuse(keyword: DataFrame, semantic: DataFrame, key: str = "iri", order: str = "rank") -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists (key, rank from 1): sum of 1/(60+rank), ties by first appearance."""
    both = keyword.select(key, order, F.lit(0).alias("list")).unionByName(semantic.select(key, order, F.lit(1).alias("list")))
    return both.groupBy(key).agg(F.round(F.sum(1.0 / (RRF + F.col(order))), 5).alias("score"), F.min(F.struct("list", order)).alias("_first")).orderBy(F.desc("score"), "_first").drop("_first")


def keyset_page(entities: DataFrame, limit: int, cursor: str | None = None, by: tuple = ("norm", "iri", "version_id")) -> tuple[list, str | None]:
    """A page after the cursor and the next cursor; one row more than asked for tells whether there is another page."""
    after = entities
    if cursor:
        values = json.loads(base64.urlsafe_b64decode(cursor))
        after = after.where(F.struct(*by) > F.struct(*(F.lit(v).alias(c) for c, v in zip(by, values))))
    rows = after.orderBy(*by).limit(limit + 1).collect()
    more = len(rows) > limit
    return rows[:limit], base64.urlsafe_b64encode(json.dumps([rows[limit - 1][c] for c in by]).encode()).decode() if more else None


def facets(entities: DataFrame, by: str = "version_id") -> DataFrame:
    return entities.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by)


def disambiguated(page: DataFrame) -> DataFrame:
    """Labels that repeat in a page get their local name behind them."""
    return page.withColumn("label", F.when(F.count("*").over(W.partitionBy("label")) > 1, F.concat("label", F.lit(" ("), "short", F.lit(")"))).otherwise(F.col("label")))


def embedding_text(label: Column, definition: Column, synonyms: Column, parents: Column, children: Column) -> Column:
    """What is embedded of an entity: label, definition, synonyms, superclasses, subclasses, each bounded, 2000 characters in all."""
    part = lambda name, values, n: F.when(F.size(values) > 0, F.concat(F.lit(f"{name}: "), F.array_join(F.slice(values, 1, n), ", "), F.lit(".")))
    whole = F.concat_ws(" ", F.concat(label, F.lit(".")), F.when(definition != "", F.substring(definition, 1, 1000)), part("Synonyms", synonyms, 10), part("Superclasses", parents, 5), part("Subclasses", children, 10))
    return F.rtrim(F.substring(whole, 1, 2000))


def changed_texts(texts: DataFrame, stored: DataFrame) -> DataFrame:
    """Texts (iri, text) whose hash isn't stored (iri, text_hash): only these are embedded again."""
    return texts.withColumn("text_hash", F.sha2("text", 256)).join(stored.select("iri", "text_hash"), ["iri", "text_hash"], "left_anti")
