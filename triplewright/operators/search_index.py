"""A stored search index: what a query reads grows with its own words' postings, not with the entities.

Four Parquet tables, each laid out in directories by a hash of what it is looked up by and sorted within them, so that a look-up reads one
directory and, by the files' statistics, few pages of it:

- prefix: entities by normalised label
- tokens: (token, entity) for each distinct word of the search text
- grams: (gram, entity) for each distinct trigram of the normalised label's words, and how many entities each gram has
- facets: entities by version and type

Postings carry what ranking needs, so that no hit is fetched from elsewhere: the index is larger than the entities by about as many times as a
label has trigrams. Postings are sorted by ranges of (key, entity), so that a frequent word's or gram's list is shared out to many files.

Fuzzy look-ups. A label of similarity SIMILAR shares at least so many of the query's trigrams; so of all but so many minus one of them it has one
at least. The rarest ones are looked up, and similarity is computed for what they give: no label is missed.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triplewright.functions import text as X
from triplewright.operators.search import SIMILAR, normalise, ranked, scoped, tokens
from triplewright.operators.staging import shared_dir, stage

BUCKETS = 32
_ENTITY = ["eid", "iri", "label", "norm", "short", "type", "version_id", "source"]
#: Kinds of entities by the type that a client asks for.
TYPES = {"class": ["class", "concept"], "individual": ["individual"], "property": ["object_property", "data_property", "annotation_property"]}
#: Fixed value: local names that are written with a colon.
OBO = "^([A-Z]+)_([0-9]+)$"


def _bucket(key: Column) -> Column:
    return (F.crc32(key) % BUCKETS).cast("int")


def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != ""))


def _grams(label: Column) -> Column:
    """Trigrams of a label's words, each word padded by two blanks before and one after."""
    words = F.filter(F.split(F.lower(label), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.concat(F.lit("  "), w, F.lit(" ")).substr(i, F.lit(3))))))


@dataclass
class SearchIndex:
    """The tables of a written index."""

    prefix: DataFrame
    tokens: DataFrame
    grams: DataFrame
    gram_counts: DataFrame
    facets: DataFrame

    @staticmethod
    def build(entities: DataFrame, path: str | None = None) -> SearchIndex:
        """Writes the index of entities (iri, label, norm, short, search_text, type, version_id, and source if there is one) below path, by default in the shared folder."""
        spark, path = entities.sparkSession, path or shared_dir(entities.sparkSession)
        source = F.col("source") if "source" in entities.columns else F.lit("")
        rows = stage(entities.select("iri", "label", "norm", "short", "search_text", "type", "version_id", source.alias("source")).withColumn("eid", F.monotonically_increasing_id()))

        def write(df: DataFrame, name: str, key: str, bucket: Column) -> None:
            laid = df.withColumn("b", bucket).repartitionByRange("b", key, "eid").sortWithinPartitions("b", key, "eid")
            laid.write.mode("overwrite").partitionBy("b").option("compression", "zstd").option("parquet.block.size", 8 << 20).parquet(f"{path}/{name}")

        first = lambda c: _bucket(F.substring(c, 1, 1))
        write(rows.select(*_ENTITY), "prefix", "norm", first("norm"))
        write(rows.select(*_ENTITY, F.explode(_words(F.col("search_text"))).alias("token")), "tokens", "token", first("token"))
        write(rows.select(*_ENTITY, F.explode(_grams(F.col("norm"))).alias("gram")), "grams", "gram", _bucket(F.col("gram")))
        counts = spark.read.parquet(f"{path}/grams").groupBy("b", "gram").agg(F.count("*").alias("n"))
        counts.repartition("b").sortWithinPartitions("b", "gram").write.mode("overwrite").partitionBy("b").parquet(f"{path}/gram_counts")
        rows.groupBy("version_id", "type").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/facets")
        return SearchIndex.open(spark, path)

    @staticmethod
    def open(spark, path: str) -> SearchIndex:
        read = lambda name, more: spark.read.schema(more).parquet(f"{path}/{name}")  # noqa: E731  files are listed once, here
        entity = "eid long, iri string, label string, norm string, short string, type string, version_id string, source string"
        return SearchIndex(read("prefix", f"{entity}, b int"), read("tokens", f"{entity}, token string, b int"), read("grams", f"{entity}, gram string, b int"), read("gram_counts", "gram string, n long, b int"), read("facets", "version_id string, type string, n long"))

    def _at(self, table: DataFrame, *keys: str) -> DataFrame:
        """Rows of the directories that keys fall in."""
        return table.where(F.col("b").isin(sorted({zlib.crc32(k.encode()) % BUCKETS for k in keys})))

    def prefix_tier(self, query: str) -> DataFrame:
        q = normalise(query)
        hits = self._at(self.prefix, q[:1]).where(F.col("norm").startswith(q)) if q else self.prefix.where("false")
        return hits.select(*_ENTITY).withColumn("tier", F.lit(1)).withColumn("r1", F.when(F.col("norm") == q, 0.0).otherwise(1.0))

    def text_tier(self, query: str) -> DataFrame:
        words = tokens(query)
        if not words:
            hits = self.tokens.where("false")
        else:
            hits = self._at(self.tokens, words[-1][:1]).where(F.col("token").startswith(words[-1]) & ~F.col("norm").startswith(normalise(query))).dropDuplicates(["eid"])
            for w in dict.fromkeys(words[:-1]):
                hits = hits.join(self._at(self.tokens, w[:1]).where(F.col("token") == w).select("eid"), "eid", "left_semi")
        return hits.select(*_ENTITY).withColumn("tier", F.lit(2)).withColumn("r1", F.lit(0.0))

    def fuzzy_tier(self, query: str) -> DataFrame:
        q = normalise(query)
        grams = sorted({("  " + w + " ")[i : i + 3] for w in q.lower().split() for i in range(len(w) + 1)})
        least = next((n for n in range(len(grams) + 1) if grams and round(n / len(grams), 6) >= SIMILAR), None)
        if least is None:
            return self.grams.where("false").select(*_ENTITY).withColumn("tier", F.lit(3)).withColumn("r1", F.lit(0.0))
        held = {r.gram: r.n for r in self._at(self.gram_counts, *grams).where(F.col("gram").isin(grams)).collect()}  # at most as many as the query has
        rare = sorted(grams, key=lambda g: held.get(g, 0))[: len(grams) - least + 1]
        met = self._at(self.grams, *rare).where(F.col("gram").isin(rare)).dropDuplicates(["eid"])
        return met.select(*_ENTITY).withColumn("tier", F.lit(3)).withColumn("r1", -F.round(X.word_similarity(q, F.col("norm")), 6)).where(F.col("r1") <= -SIMILAR)

    def search(self, query: str, limit: int = 20, types: list[str] | None = None, versions: list[str] | None = None) -> DataFrame:
        """As search.search over the entities, by the index."""
        return ranked(scoped(self.prefix_tier(query).unionByName(self.text_tier(query)), types, versions), limit)

    def autocomplete(self, query: str, limit: int = 10, types: list[str] | None = None, versions: list[str] | None = None) -> DataFrame:
        """As search.autocomplete over the entities, by the index."""
        return ranked(self._completions(query, types, versions), limit)

    def _completions(self, query: str, types: list[str] | None, versions: list[str] | None) -> DataFrame:
        if len(query.strip()) < 2:
            return self.prefix_tier("")
        hits = self.prefix_tier(query).unionByName(self.text_tier(query))
        if len(query.strip()) >= 3:
            hits = hits.unionByName(self.fuzzy_tier(query))
        return scoped(hits, types, versions)

    def documents(self, query: str, rows: int = 10, start: int = 0, type: str | None = None, versions: list[str] | None = None, local: bool = False) -> DataFrame:
        """A page of search documents (position, found, and the document's fields); found counts what the page was cut from.

        local: only entities whose source is empty or their own version.
        """
        hits = scoped(self.prefix_tier(query).unionByName(self.text_tier(query)), TYPES.get(type or ""), versions)
        return _documents(_whole(hits, rows + start + 50), rows, start, F.coalesce((F.col("source") == "") | (F.col("source") == F.col("version_id")), F.lit(True)), local)

    def select(self, query: str, rows: int = 10, start: int = 0, type: str | None = None, versions: list[str] | None = None) -> DataFrame:
        """A page of completions as documents, every one of them as defined where it is."""
        return _documents(_whole(self._completions(query, TYPES.get(type or ""), versions), rows + start + 20), rows, start, F.lit(True), False)

    def suggest(self, query: str, rows: int = 10, versions: list[str] | None = None) -> DataFrame:
        """(position, autosuggest): labels of completions, each once, in the order of their first."""
        first = _whole(self._completions(query, None, versions), rows + 20).where("label <> ''").groupBy("label").agg(F.min("position").alias("position"))
        return first.orderBy("position").limit(rows).select("position", F.col("label").alias("autosuggest"))

    def hit_facets(self, query: str, by: str = "version_id") -> DataFrame:
        """(by, n): all hits of a query by version or type, an entity's IRI once in each."""
        hits = self.prefix_tier(query).unionByName(self.text_tier(query))
        return hits.groupBy(by).agg(F.count_distinct("iri").alias("n")).orderBy(F.desc("n"), by)

    def totals(self, by: str = "version_id") -> DataFrame:
        """(by, n): entities by version or type, from the stored counts."""
        return self.facets.groupBy(by).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), by)


def _whole(hits: DataFrame, limit: int) -> DataFrame:
    """ranked, with its order as a position and the entities' other columns."""
    order = ["tier", "r1", F.length("label"), "label", "iri"]
    one = hits.withColumn("_n", F.row_number().over(W.partitionBy("iri").orderBy(*order[:-1], "version_id"))).where("_n = 1").orderBy(*order).limit(limit)
    return one.withColumn("position", F.row_number().over(W.orderBy(*order)) - 1)  # of `limit` rows


def _documents(page: DataFrame, rows: int, start: int, defining: Column, only: bool) -> DataFrame:
    kept = page.where(defining) if only else page
    numbered = kept.withColumn("position", F.row_number().over(W.orderBy("position")) - 1).withColumn("found", F.count("*").over(W.partitionBy(F.lit(0))))  # of a page's rows
    kind = F.when(F.col("type").isin(TYPES["class"]), "class").when(F.col("type").endswith("_property") | (F.col("type") == "property"), "property").when(F.col("type") == "", "class").otherwise(F.col("type"))
    obo = F.when(F.col("short").rlike(OBO), F.regexp_replace("short", OBO, "$1:$2"))
    return numbered.where(f"position >= {int(start)} and position < {int(start) + int(rows)}").select(
        "position", "found", "iri", "label", F.col("short").alias("short_form"), obo.alias("obo_id"), F.col("version_id").alias("ontology_name"), F.upper("version_id").alias("ontology_prefix"), kind.alias("type"), defining.alias("is_defining_ontology"))
