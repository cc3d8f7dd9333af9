import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from triplewright.llm import token_store
from triplewright.llm.common import shared_dir
from triplewright.llm.tokens import tokenizer_path


def test_crc_combination():
    rng = random.Random(2)
    for _ in range(200):
        a, b = rng.randbytes(rng.randint(0, 50)), rng.randbytes(rng.randint(0, 9000))
        assert token_store.combined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_boundaries_follow_content():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 40_000, 30_000)
    ends = token_store.boundaries(ids)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and sizes.max() <= token_store.MOST and sizes[:-1].min() >= token_store.LEAST
    shifted = {e - 7 for e in token_store.boundaries(np.concatenate([ids[:7], ids]))}
    assert len(shifted & set(ends)) > 0.8 * len(ends)


def test_store_equals_the_library(spark, odd, documents):
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    again = odd.unionByName(odd.limit(5)).unionByName(odd.limit(1).selectExpr("cast(null as long) doc_id", "'x y' text", "lang", "n_tokens", "ids"))
    for df in (documents, again.repartition(3)):
        base = shared_dir(spark)
        token_store.write(df, base)
        got = sorted((tuple(r) for r in token_store.verified(spark, base).collect()), key=lambda r: r[1])
        token_store.check_manifest(spark, base)
        stored = {(r.start): bytes(r.ids) for r in token_store.read(spark, base).collect()}
        texts = {}
        for r in df.select("doc_id", "text").collect():
            texts.setdefault(r.doc_id, []).append(r.text or "")
        start, last = 0, None
        for doc, at, n, crc in got:
            assert at == start and (last is None or doc is None or doc >= last)
            last = doc
            ids = [library.encode(t, add_special_tokens=False).ids + [2] for t in texts[doc]]
            match = [i for i in ids if len(i) == n and zlib.crc32(np.array(i, "<u4").tobytes()) == crc]
            assert match and np.frombuffer(stored[at], "<u2").tolist() == match[0]
            texts[doc].pop(ids.index(match[0]))
            start += n
        assert not any(texts.values())


def test_empty(spark, odd):
    base = shared_dir(spark)
    token_store.write(odd.limit(0), base)
    token_store.check_manifest(spark, base)
    assert token_store.verified(spark, base).count() == 0


@pytest.fixture(scope="module")
def kept(spark, odd):
    base = shared_dir(spark)
    token_store.write(odd, base)
    return {name: spark.read.parquet(f"{base}/{name}") for name in ("chunks", "recipes", "manifest")}


def changed(spark, kept, **tables):
    base = shared_dir(spark)
    for name, df in (kept | tables).items():
        df.write.parquet(f"{base}/{name}")
    return base


def test_whatever_is_lost_or_altered_fails(spark, kept):
    """A chunk, a recipe, a whole part, the order, a byte, a length: nothing is given up without an error."""
    assert token_store.verified(spark, changed(spark, kept)).count() == kept["recipes"].count()
    chunks, recipes, manifest = kept["chunks"], kept["recipes"], kept["manifest"]
    one, row, part = chunks.first().digest, recipes.orderBy("row").first().row, recipes.first().part
    shifted = F.when(F.col("row") == row, F.col("start") + 1).otherwise(F.col("start"))
    emptied = F.when(F.col("row") == row, F.array().cast(recipes.schema["recipe"].dataType)).otherwise(F.col("recipe"))
    flipped = F.when(F.col("digest") == F.lit(one), F.concat(F.expr("left(data, length(data) - 1)"), F.lit(b"\xff"))).otherwise(F.col("data"))
    cases = [
        {"chunks": chunks.where(F.col("digest") != F.lit(one))},
        {"chunks": chunks.withColumn("data", flipped)},
        {"recipes": recipes.where(F.col("row") != row)},
        {"recipes": recipes.where(F.col("part") != part)},
        {"recipes": recipes.withColumn("start", shifted)},
        {"recipes": recipes.withColumn("recipe", emptied)},
        {"recipes": recipes.withColumn("doc_id", F.col("doc_id") + 1)},
        {"manifest": manifest.where(F.col("part") != part)},
    ]
    for tables in cases:
        base = changed(spark, kept, **tables)
        with pytest.raises(Exception):
            token_store.verified(spark, base).collect()
    with pytest.raises(Exception, match="no chunk"):
        token_store.read(spark, changed(spark, kept, **cases[0])).collect()


def test_ids_beyond_the_width_are_refused(spark, odd, monkeypatch):
    with pytest.raises(Exception, match="don't fit"):
        token_store.write(odd, shared_dir(spark), end=70_000)


def test_an_id_of_many_rows_is_shared_out(spark):
    base = shared_dir(spark)
    token_store.write(spark.range(4000).selectExpr("if(id % 4 = 0, id, null) as doc_id", "concat('text ', id) as text"), base)
    sizes = [r["count"] for r in spark.read.parquet(f"{base}/recipes").groupBy("part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 1500
