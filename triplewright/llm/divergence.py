"""Divergence of sources: how far the smoothed share of each kept term in a source lies from that in the language's other sources.

Plain relational: regexp matches are exploded and counted, the groups of a language meet its kept vocabulary so that terms a group never has
count zero, that table meets itself on language and term, differences are summed, and windows rank.

- A term is a run of letters, A-Z lower-cased; a language keeps the terms that at least `least` of its rows have.
- A share is 1 + floor(10^9 * (count + 5) / (N + 5 * V)), N being the counts' sum over the V kept terms, in exact decimals.
- Part `pair`: each other source of the language by the summed differences. Part `term`: terms more frequent than in the language, `top` at most.

Null texts, languages and sources are read as ''. A group without terms has count zero everywhere; a language that keeps no term has its pairs with value
0 and no terms. Repeated rows count as often as they come; other columns are ignored, whatever their names. Empty tables give no rows. Equal values rank
by the item's UTF-8 bytes.

Keys that hold many rows: counts are summed where rows are read, so that a source or word of a third of the corpus sends one row a task. Groups
meet the vocabulary under a salt made of the term, one of SALTS, so that a language is shared out; ranks drop all but `top` rows in each task before a
group's rows meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triplewright.llm.common import stage, table

#: ASCII letters and all beyond ASCII: the same characters as [^\x00-\x40\x5B-\x60\x7B-\x7F], which takes Java longer to match.
TERM = r"[A-Za-z\x80-\x{10FFFF}]+"
LEAST_ROWS = 30
SCALE, SMOOTH = 1_000_000_000, 5
TOP = 50
SALTS = 64
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def keyed(docs: DataFrame) -> DataFrame:
    """(lang, source, text) without nulls."""
    return docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def lowered(text: str = "text"):
    """A-Z lower-cased, other letters as they are: lower() does that where all is ASCII, at a small part of translate's time."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and rows that have the term; docs as keyed gives them."""
    found = docs.select("lang", "source", F.regexp_extract_all(lowered(), F.lit(TERM), F.lit(0)).alias("terms"))
    # each row's terms twice: as they come (n) and without repeats (docs), from one scan
    both = found.select("lang", "source", F.explode(F.array(F.struct("terms", F.lit(0).alias("once")), F.struct(F.array_distinct("terms").alias("terms"), F.lit(1).alias("once")))).alias("e"))
    terms = both.select("lang", "source", "e.once", F.explode("e.terms").alias("term"))
    return terms.groupBy("lang", "source", "term").agg(F.sum(1 - F.col("once")).alias("n"), F.sum("once").alias("docs"))


def share(count: str, total: str, kept: str):
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * kept)) in exact decimals."""
    return F.expr(f"1L + (cast({SCALE} as decimal(10, 0)) * cast({count} + {SMOOTH} as decimal(20, 0))) div cast({total} + {SMOOTH} * {kept} as decimal(20, 0))")


def shares(counts: DataFrame, groups: DataFrame, least: int = LEAST_ROWS) -> DataFrame:
    """(lang, source, term, n, p, q): for each group (lang, source) and kept term its count there, its share there and in the language."""
    vocabulary = stage(counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs"))
    known = stage(counts.join(vocabulary.select("lang", "term"), ["lang", "term"]).select("lang", "source", "term", "n"))
    kept = vocabulary.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n_lang").alias("total_lang"))
    totals = known.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    facts = groups.join(kept, "lang").join(totals, ["lang", "source"], "left").na.fill({"total": 0})
    salted = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dense = vocabulary.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"]).drop("salt")
    dense = dense.join(known, ["lang", "source", "term"], "left").na.fill({"n": 0})
    return dense.select("lang", "source", "term", "n", share("n", "total", "kept").alias("p"), share("n_lang", "total_lang", "kept").alias("q"))


def pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each two sources of a language, both ways round."""
    mine, other = shares.select("lang", "term", "source", "p"), shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
    met = mine.join(other, ["lang", "term"]).where("source < item")
    sums = met.groupBy("lang", "source", "item").agg(F.sum(F.abs(F.col("p") - F.col("q"))).alias("value"))
    both = sums.unionByName(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    all_pairs = groups.join(groups.withColumnRenamed("source", "item"), "lang").where("source <> item")
    return all_pairs.join(both, ["lang", "source", "item"], "left").na.fill({"value": 0})


def ranked(rows: DataFrame, top: int | None = None) -> DataFrame:
    """rows (lang, source, item, value) with their rank in the group."""
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    out = rows.withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= top) if top else out


def audit(docs: DataFrame, least: int = LEAST_ROWS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs (lang, source, text)."""
    given = keyed(docs)
    groups = stage(given.select("lang", "source").distinct())
    dense = stage(shares(stage(term_counts(given)), groups, least))
    terms = dense.where("n > 0 and p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    parts = (("pair", ranked(pairs(dense, groups))), ("term", ranked(terms, top)))
    a, b = (rows.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank") for part, rows in parts)
    return a.unionByName(b)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
with docs as (
  select row_number() over () as d, coalesce(lang, '') as lang, coalesce(source, '') as source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
  from documents),
terms as (select d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs),
vocabulary as (select lang, term, count(*) as n from terms group by lang, term having count(distinct d) >= 30),
kept as (select lang, count(*) as v, sum(n) as total from vocabulary group by lang),
counts as (select t.lang, t.source, t.term, count(*) as n from terms t join vocabulary using (lang, term) group by t.lang, t.source, t.term),
groups as (select distinct lang, source from docs),
totals as (select g.lang, g.source, coalesce(sum(n), 0) as total from groups g left join counts c using (lang, source) group by g.lang, g.source),
dense as (
  select g.lang, g.source, v.term, coalesce(c.n, 0) as n,
         1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (t.total + 5 * k.v) as p,
         1 + (1000000000::hugeint * (v.n + 5)) // (k.total + 5 * k.v) as q
  from groups g join vocabulary v using (lang) join kept k using (lang) join totals t using (lang, source)
  left join counts c on c.lang = g.lang and c.source = g.source and c.term = v.term),
sums as (
  select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
  from dense a join dense b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source),
pair as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source),
term as (select lang, source, 'term' as part, term as item, p - q as value from dense where n > 0 and p > q),
ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as rank
  from (select * from pair union all select * from term))
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= 50
"""
