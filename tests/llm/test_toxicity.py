import numpy as np
import pytest

from triplewright.llm import toxicity


@pytest.fixture(scope="module")
def larger(spark):
    return [spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels")]


def test_held_out_accuracy(larger):
    documents, labels = larger
    train = labels.where("doc_id % 2 = 0")
    chain = toxicity.fit(documents, train)
    test = toxicity.score(documents, chain).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    caught = [r.p_toxic >= toxicity.THRESHOLD for r in test]
    toxic = [bool(r.toxic) for r in test]
    assert sum(c == t for c, t in zip(caught, toxic)) >= 0.98 * len(test)
    assert sum(c and not t for c, t in zip(caught, toxic)) <= 0.005 * len(test)
    assert sum(c and t for c, t in zip(caught, toxic)) >= 0.85 * sum(toxic)


def test_chain_feeds_earlier_probabilities():
    rng = np.random.default_rng(0)
    x = (rng.random((600, 6)) < 0.3).astype(float)
    first = x[:, 0]
    second = ((x[:, 0] + x[:, 1]) > 0).astype(float)
    chain = toxicity.fit_chain(x, np.stack([first, second], 1), {str(i): i for i in range(6)}, ["a", "b"], np.arange(600) % 5)
    assert len(chain.models[1].weights) == 7 and chain.models[1].weights[6] > 0
    p = chain.probabilities([np.flatnonzero(r).tolist() for r in x])
    assert ((p[:, 1] >= 0.5) == (second == 1)).mean() > 0.99


def test_scores_equal_a_plain_sum(spark, odd, larger):
    documents, labels = larger
    chain = toxicity.fit(documents, labels)
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    for r in toxicity.score(odd, chain).collect():
        found = {chain.vocabulary[f] for w in toxicity.words_of(texts[r.doc_id]) for f in toxicity.features_of(w) if f in chain.vocabulary}
        before = []
        for model, name in zip(chain.models, chain.categories):
            logit = model.bias + sum(model.weights[c] for c in found) + sum(w * p for w, p in zip(model.weights[len(chain.vocabulary) :], before))
            before.append(1 / (1 + np.exp(-logit)))
            assert abs(r[f"p_{name}"] - before[-1]) < 1e-9


def test_labels_that_do_not_vary_or_lack(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.score(odd, toxicity.fit(odd, none)).collect()
    assert len(rows) == odd.count() and all(r.p_toxic == 0 for r in rows)
    same = spark.createDataFrame([(1, 1, None), (2, 1, 0), (None, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert all(r.p_toxic == 0 for r in toxicity.score(odd, toxicity.fit(odd, same)).collect())
    assert toxicity.score(odd.limit(0), toxicity.fit(odd.limit(0), same)).count() == 0


def test_labels_and_documents_repeated_per_id(spark):
    """Label rows of an id that disagree count as their largest; an id of several documents is one of the sample."""
    docs = [(i, f"{'foul' if i % 3 == 0 else 'fine'} words {i}") for i in range(300)] + [(0, "foul words again")] * 3
    marks = [(i, 1, int(i % 3 == 0)) for i in range(300)] + [(i, 1, 0) for i in range(0, 300, 6)]
    chains = []
    for seed in (1, 2):
        rng = np.random.default_rng(seed)
        frames = [spark.createDataFrame([x[i] for i in rng.permutation(len(x)).tolist()], kind).repartition(3) for x, kind in ((docs, "doc_id long, text string"), (marks, "doc_id long, quality int, toxic int"))]
        chains.append(toxicity.fit(*frames))
    assert chains[0].vocabulary == chains[1].vocabulary and all((a.weights == b.weights).all() and a.bias == b.bias for a, b in zip(chains[0].models, chains[1].models))
    scored = toxicity.score(spark.createDataFrame(docs[:300], "doc_id long, text string"), chains[0]).collect()
    assert all((r.p_toxic >= 0.5) == (r.doc_id % 3 == 0) for r in scored)
