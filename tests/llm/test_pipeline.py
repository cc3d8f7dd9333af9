import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from triplewright.llm import pii, toxicity
from triplewright.llm.common import stage
from triplewright.llm.tokens import tokenizer_path

from .test_jaccard import groups


def test_stages_equal_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    chain = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    p = {r.doc_id: r.p_toxic for r in toxicity.score(docs, chain).collect()}
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, function in corpus_pipeline.STAGES[:3]:
        docs = stage(function(spark, docs, sf_dir))
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "toxicity":
            assert after == {i: t for i, t in before.items() if p[i] < toxicity.THRESHOLD}
        elif name == "near_duplicates":
            first = groups(before)
            assert after == {i: t for i, t in before.items() if first[i] == i} and len(after) < len(before)
        else:
            assert after == {i: pii.redact(t, pii.all_spans(t)) for i, t in before.items()} and after != before
        before = after
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(before)
    for r in rows:
        ids = library.encode(before[r.doc_id], add_special_tokens=False).ids + [1]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())


def test_odd_rows(spark, odd, tmp_path):
    odd.limit(0).selectExpr("doc_id", "1 quality", "0 toxic").write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd.unionByName(odd).selectExpr("doc_id", "text", "lang", "'s' source", "n_tokens as n_chars")
    for rows in (docs, docs.limit(0)):
        out = rows
        for _, function in corpus_pipeline.STAGES:
            out = stage(function(spark, out, str(tmp_path)))
        kept = {r.doc_id for r in out.collect()}
        first = groups({r.doc_id: r.text for r in rows.collect()})
        assert kept == {i for i, g in first.items() if i == g}


def test_repeated_ids_are_decided_by_row(spark, tmp_path):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a, "x"), (2, a, "x"), (2, b, "x"), (3, a + " more", "x"), (3, a, "x"), (4, "one two", "x"), (4, "one two", "y"), (5, "last", "x"), (5, "last", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = sorted((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect())
    assert kept == [(1, a), (2, b), (4, "one two"), (5, "last")]


def test_null_ids_pass_and_no_text_is_lost(spark, tmp_path):
    """Rows without an id stay, repeated ones too; texts that share an id are decided each; rows repeated as a whole are one."""
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a), (5, a), (5, b), (None, a), (None, a), (7, b), (8, ""), (8, ""), (9, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r.doc_id or 0, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()), key=str)
    assert kept == sorted([(0, None), (0, a), (0, a), (1, a), (5, b), (8, "")], key=str)


def test_nulls_in_other_places_are_other_rows(spark, tmp_path):
    a = " ".join(f"a{i}" for i in range(40))
    docs = spark.createDataFrame([(1, a, "x"), (5, a, None), (5, None, a), (5, None, None), (6, "", None)], "doc_id long, text string, lang string")
    kept = {(r.doc_id, r.text, r.lang) for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()}
    # without words: the rows of id 5 and 6 are one group, whose least id names two rows; the lead is one of them
    assert (1, a, "x") in kept and len(kept) == 2 and kept - {(1, a, "x")} <= {(5, None, a), (5, None, None)}


def test_near_duplicates_are_those_of_all_pairs(spark, sf_dir):
    """The stage by its contract: five words, a similarity of 0.8 or more, every pair compared."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    expected = groups({r.doc_id: r.text for r in docs.collect()})
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()}
    assert kept == {i for i, g in expected.items() if i == g} and len(kept) < len(expected)


def test_odd_rows_come_out_whole(spark, odd, tmp_path):
    """Every text that no stage rejects is packed whole: its pieces give its ids."""
    odd.limit(0).selectExpr("doc_id", "1 quality", "0 toxic").write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd.selectExpr("doc_id", "text", "lang", "'s' source", "n_tokens as n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    expected = groups(texts)
    assert {r.doc_id for r in pieces} == {i for i, g in expected.items() if i == g}
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    for doc in {r.doc_id for r in pieces}:
        ids = library.encode(pii.redact(texts[doc], pii.all_spans(texts[doc])), add_special_tokens=False).ids + [1]
        mine = sorted((r for r in pieces if r.doc_id == doc), key=lambda r: r.start)
        assert sum(r.length for r in mine) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in mine)
