import random
from fractions import Fraction

from pyspark.sql import functions as F

import corpus_pipeline
from triplewright.llm import jaccard, simhash


def plain(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)])


def groups(texts):
    """Smallest id reachable over pairs of similarity 0.8 or more, all pairs being compared."""
    sets, out = {i: plain(t) for i, t in texts.items()}, {i: i for i in texts}
    pairs = [(a, b) for a in sets for b in sets if a < b and Fraction(len(sets[a] & sets[b]), len(sets[a] | sets[b])) >= Fraction(4, 5)]
    while changed := [(a, b) for a, b in pairs if out[a] != out[b]]:
        for a, b in changed:
            out[a] = out[b] = min(out[a], out[b])
    return out


def near_copies():
    """Copies of a text with few words changed, chains of changes, and texts of their own."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    texts = []
    for i in range(90):
        words, changes = list(base if i < 60 or i % 2 else texts[-1].split()), rng.randint(1, 5)
        for _ in range(changes):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += [" ".join(f"y{rng.randrange(10**6)}" for _ in range(40)) for _ in range(20)] + ["", None, " ", "a b", "A  b", "a c"]
    rng.shuffle(texts)
    return dict(enumerate(texts))


def test_groups_equal_all_pairs(spark, documents):
    given = {r.doc_id: r.text for r in documents.collect()}
    for texts in (near_copies(), given):
        df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        assert {r.doc_id: r.component_id for r in jaccard.group(df).collect()} == groups(texts)
    assert jaccard.group(df.limit(0)).count() == 0


def test_stage_drops_near_copies(spark, tmp_path):
    texts = near_copies()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()}
    assert kept == {i for i, g in groups(texts).items() if i == g}


def test_parities_lose_no_pair():
    rng = random.Random(3)
    for _ in range(300):
        a = " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randint(5, 60)))
        words = a.split()
        words[rng.randrange(len(words))] = "other"
        x, y = jaccard.shingles(a), jaccard.shingles(" ".join(words))
        odd = sum((int(p) & (1 << 64) - 1 ^ int(q) & (1 << 64) - 1).bit_count() for p, q in zip(jaccard.parities(x), jaccard.parities(y)))
        assert odd <= len(set(x.tolist()) ^ set(y.tolist()))


def test_fingerprints_propose_without_bands(spark):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(5000)}" for _ in range(400)] for _ in range(12)]
    texts = [" ".join(words[:-1] + [f"x{i}"]) for words in base for i in range(6)] + [" ".join(words) for words in base]
    prints = [simhash.majority(jaccard.shingles(t)) for t in texts]
    near = {(a, b) for b in range(len(texts)) for a in range(b) if (prints[a] ^ prints[b]).bit_count() <= jaccard.DISTANCE}
    alone = [Fraction(len(plain(texts[a]) & plain(texts[b])), len(plain(texts[a]) | plain(texts[b]))) for a, b in near]
    assert len(near) > 150 and min(alone) >= Fraction(4, 5)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = jaccard.sketches(df).withColumn("keys", F.array().cast("array<long>"))
    assert 0 < jaccard.near_prints(prints).count() <= len(near)  # of sets with one fingerprint the least stands for all
    id_of = {bytes(r.fp): r.doc_id for r in prints.collect()}
    edges = [(id_of[bytes(r.a)], id_of[bytes(r.b)]) for r in jaccard.links(prints, jaccard.rows(df).select("row", "text")).collect()]

    def joined(pairs):
        out = list(range(len(texts)))
        for a, b in [tuple(sorted(p)) for p in pairs] * len(texts):
            out[a] = out[b] = min(out[a], out[b])
        return out

    assert joined(edges) == joined(near)
