"""From documents to packed sequences: toxic documents go, near duplicates go, personal data is redacted, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Rows with a null
doc_id pass the near-duplicate stage, as nothing names them; rows repeated as a whole are one document there, and other rows that
share a doc_id are documents of their own, each of which goes or stays by its own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplewright.llm import jaccard, packing, pii, simhash, toxicity
from triplewright.llm.common import drop_path, shared_dir, stage, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being toxic is below the threshold."""
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, chain).where(F.col("p_toxic") < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a similarity of 0.8 or more over five-word shingles the one of the smallest id."""
    groups = stage(simhash.near_duplicates(docs)).where("doc_id is not null")
    # one plan at every size: what goes grows with the input and is never broadcast
    gone = groups.where("row <> lead").select("row").distinct()
    twice = groups.where("row = lead").groupBy("row").count().where("count > 1").select("row")
    rows = docs.withColumn("row", jaccard.row_hash(docs))
    once = rows.join(gone.unionByName(twice).hint("merge"), "row", "left_anti")
    first = rows.join(twice.hint("merge"), "row", "left_semi").dropDuplicates(docs.columns)
    return once.unionByName(first).select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars follows."""
    out = pii.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in its sequence."""
    return packing.pack(docs)


STAGES = [("toxicity", reject_toxic), ("near_duplicates", drop_near_duplicates), ("personal_data", redact_personal_data), ("packing", pack)]

#: Classifiers, fingerprints and tokens are beyond SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one written and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = shared_dir(spark)
            docs = stage(docs, path)
            if before:
                drop_path(spark, before)
            before = path
    return docs
