"""Toxicity by a classifier chain of linear models on selected words and word beginnings.

Fitting: a bounded sample of labelled documents (SAMPLE, the smallest by a hash of the id) gives features: words and
word beginnings that occur in a document or don't. Counts by feature and label are summed over the sample on the executors; features
whose association with a category is beyond chance (G-test, SIGNIFICANT) are kept, the strongest FEATURES of them per category.
The chain runs through CATEGORIES in order: the model of a category takes the features and the probabilities of the
categories before it. In training these are out-of-fold predictions, so that later models see probabilities as honest
as those they will see in use.
Scoring: every whole text, where it is read; a worker remembers which features a word has.

Labels: a category's label is null or 0/1; of several rows of labels for an id the largest counts, so that a document is in a category
if any of them says so. Documents without labels are only scored. If no label of a category is 1 (or all are), its
probability is that share for every document. Null and empty texts have no features. Ties in the sample go by id; of several
documents of an id the smallest text is in the sample.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triplewright.llm.common import drop_path, shared_dir, stage, table, trimmed

#: Categories in the order of the chain, and how each follows from the labels table.
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}
SAMPLE = 8_000
#: Lengths of word beginnings that are features beside the word.
BEGINNINGS = (3, 4, 5, 6)
SIGNIFICANT = 20.0
FEATURES = 160
#: Least ratio of a feature's share of the category to the category's share of the sample: features speak for a category, never for its absence.
LIFT = 3.0
FOLDS = 5
#: Ridge penalty of the models (on features standing for 0/1).
PENALTY = 0.05
THRESHOLD = 0.3
_WORD = re.compile(r"[^\W\d_]+")
#: Words whose features a worker remembers.
REMEMBERED = 150_000


def features_of(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in BEGINNINGS if len(word) > k)]


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


class Linear(NamedTuple):
    weights: np.ndarray
    bias: float
    #: Used instead if the label doesn't vary.
    share: float | None = None

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.share is not None:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -40, 40)))


def fit_linear(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = 30) -> Linear:
    """Logistic regression with a ridge penalty by Newton steps."""
    if not len(y) or y.min() == y.max():
        return Linear(np.zeros(x.shape[1]), 0.0, float(y.mean()) if len(y) else 0.0)
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    ridge = np.full(a.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        gradient = a.T @ (p - y) + ridge * w
        hessian = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return Linear(w[:-1], float(w[-1]))


class Chain(NamedTuple):
    categories: list[str]
    #: Feature -> column.
    vocabulary: dict[str, int]
    models: list[Linear]

    def probabilities(self, rows: list[list[int]]) -> np.ndarray:
        """One column per category for documents given as lists of feature columns."""
        n, size = np.array([len(r) for r in rows], np.int64), len(self.vocabulary)
        owner = np.repeat(np.arange(len(rows)), n)
        column = np.array([c for r in rows for c in r], np.int64)
        out = np.zeros((len(rows), len(self.models)))
        for k, model in enumerate(self.models):
            if model.share is not None:
                out[:, k] = model.share
                continue
            logit = np.bincount(owner, weights=model.weights[column], minlength=len(rows)) if len(column) else np.zeros(len(rows))
            logit = logit + model.bias + out[:, :k] @ model.weights[size : size + k]
            out[:, k] = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
        return out


def fit_chain(x: np.ndarray, labels: np.ndarray, vocabulary: dict[str, int], categories: list[str], folds: np.ndarray) -> Chain:
    """x: documents by features; labels: documents by categories, NaN where unknown; folds: a number per document."""
    models, before = [], np.zeros((len(x), 0))
    for k in range(len(categories)):
        known = ~np.isnan(labels[:, k])
        inputs = np.hstack([x, before])
        models.append(fit_linear(inputs[known], labels[known, k]))
        held_out = np.zeros(len(x))
        for fold in range(FOLDS):
            inside, train = folds == fold, known & (folds != fold)
            held_out[inside] = fit_linear(inputs[train], labels[train, k]).probability(inputs[inside])
        before = np.hstack([before, held_out[:, None]])
    return Chain(categories, vocabulary, models)


def select_features(sample: DataFrame, categories: list[str]) -> DataFrame:
    """(feature): for each category the FEATURES of the strongest significant association; sample has text and a column per category."""
    k = len(categories)

    def count(batches):
        counts: dict[str, list[int]] = {}
        for batch in batches:
            marks = list(zip(*(batch.column(c).to_pylist() for c in categories)))
            for text, mark in zip(batch.column("text"), marks):
                for f in {f for w in words_of(text.as_py() or "") for f in features_of(w)}:
                    row = counts.get(f)
                    if row is None:
                        row = counts[f] = [0] * (2 * k)
                    for i, m in enumerate(mark):
                        if m is not None:
                            row[2 * i + int(m)] += 1
            if len(counts) > 100_000:
                yield batch_of(counts)
                counts = {}
        if counts:
            yield batch_of(counts)

    def batch_of(counts):
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), *(pa.array(c, pa.int64()) for c in zip(*counts.values()))], names)

    names = ["feature", *(f"n{i}" for i in range(2 * k))]
    schema = ", ".join(["feature string", *(f"n{i} long" for i in range(2 * k))])
    found = sample.select("text", *categories).mapInArrow(lambda batches: trimmed(count(batches)), schema).groupBy("feature").agg(*(F.sum(n).alias(n) for n in names[1:]))
    totals = sample.agg(*(F.sum(F.when(F.col(c) == v, 1).otherwise(0)).alias(f"t{2 * i + v}") for i, c in enumerate(categories) for v in (0, 1))).first()
    out = None
    for i in range(k):
        total = [float(totals[f"t{2 * i + v}"] or 0) for v in (0, 1)]
        n = sum(total) or 1.0
        with_ = F.col(f"n{2 * i}") + F.col(f"n{2 * i + 1}")

        def term(observed, expected):
            return F.when((observed > 0) & (expected > 0), observed * F.log(observed / expected)).otherwise(0.0)

        cells = [term(F.col(f"n{2 * i + v}").cast("double"), with_ * total[v] / n) + term(total[v] - F.col(f"n{2 * i + v}"), (n - with_) * total[v] / n) for v in (0, 1)]
        lift = F.col(f"n{2 * i + 1}") / (with_ * (total[1] / n) if total[1] else F.lit(1.0))
        strong = found.where(lift >= LIFT).select("feature", (2 * (cells[0] + cells[1])).alias("g")).where(F.col("g") >= SIGNIFICANT).orderBy(F.desc("g"), "feature").limit(FEATURES)
        out = strong if out is None else out.unionByName(strong)
    return out.select("feature").distinct()


def _rows(batch, vocabulary: dict[str, int], known: dict[str, tuple]) -> list[list[int]]:
    rows = []
    for text in batch.column("text"):
        found: set[int] = set()
        for w in words_of(text.as_py() or ""):
            hit = known.get(w)
            if hit is None:
                hit = tuple(vocabulary[f] for f in features_of(w) if f in vocabulary)
                if len(known) < REMEMBERED:
                    known[w] = hit
            if hit:
                found.update(hit)
        rows.append(sorted(found))
    return rows


def fit(documents: DataFrame, labels: DataFrame, categories: dict[str, str] = CATEGORIES, id: str = "doc_id", sample: int = SAMPLE) -> Chain:
    """Chain fitted on at most `sample` labelled documents; categories: name -> expression over labels."""
    spark, names, base = documents.sparkSession, list(categories), shared_dir(documents.sparkSession)
    marked = labels.where(f"{id} is not null").select(F.col(id).alias("_id"), *(F.expr(e).cast("int").alias(c) for c, e in categories.items()))
    chosen = marked.groupBy("_id").agg(*(F.max(c).alias(c) for c in names)).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    found = documents.select(F.col(id).alias("_id"), "text").join(chosen, "_id")
    texts = stage(found.groupBy("_id", *names).agg(F.min("text").alias("text")), base)
    vocabulary = {r.feature: i for i, r in enumerate(select_features(texts, names).orderBy("feature").collect())}

    def columns(batches):
        known: dict[str, tuple] = {}
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(_rows(batch, vocabulary, known), pa.list_(pa.int32())), *(batch.column(c) for c in names)], ["_id", "features", *names])

    kinds = [texts.schema["_id"], T.StructField("features", T.ArrayType(T.IntegerType())), *(texts.schema[c] for c in names)]
    rows = texts.select("_id", "text", *names).mapInArrow(columns, T.StructType(kinds)).collect()  # bounded by the sample
    drop_path(spark, base)
    rows.sort(key=lambda r: (str(r._id), r.features))
    x = np.zeros((len(rows), len(vocabulary)))
    for i, r in enumerate(rows):
        x[i, r.features] = 1
    y = np.array([[np.nan if r[c] is None else r[c] for c in names] for r in rows], float).reshape(len(rows), len(names))
    return fit_chain(x, y, vocabulary, names, np.arange(len(rows)) % FOLDS)


def score(df: DataFrame, chain: Chain) -> DataFrame:
    """df with a column p_<category> for each category; columns of those names are replaced."""
    names = [f"p_{c}" for c in chain.categories]
    kept = [c for c in df.columns if c not in names]
    vocabulary = df.sparkSession.sparkContext.broadcast(chain)  # bounded by FEATURES per category

    def run(batches):
        fitted, known = vocabulary.value, {}
        for batch in batches:
            p = fitted.probabilities(_rows(batch, fitted.vocabulary, known)) if batch.num_rows else np.zeros((0, len(names)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(p[:, k]) for k in range(len(names)))], [*kept, *names])

    return df.select(*kept).mapInArrow(lambda batches: trimmed(run(batches)), T.StructType([*(df.schema[c] for c in kept), *(T.StructField(n, T.DoubleType()) for n in names)]))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = fit(documents, table(spark, sf_dir, "labels"))
    scored = score(documents, chain)
    return scored.select("doc_id", *(F.round(f"p_{c}", 6).alias(f"p_{c}") for c in chain.categories), (F.col("p_toxic") >= THRESHOLD).alias("rejected"))
