import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from triplewright.llm import bpe, packing
from triplewright.llm.tokens import Memory, WordEncoder, tokenizer_path

from .conftest import TEXTS


def u4(ids):
    return np.array(ids, "<u4").tobytes()


def test_encode_decode_equal_the_library(spark, odd, documents):
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    for df in (odd, documents):
        texts = {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}
        for r in bpe.digests(df).collect():
            ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
            assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(u4(ids)).hexdigest())
            assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_round_trip_keeps_columns(odd):
    rows = bpe.decode(bpe.encode(odd)).collect()
    assert len(rows) == len(TEXTS)
    assert all(r.decoded == (r.text or "") and r.n_tokens == 7 and r.lang == "x" for r in rows)


def test_empty_tables(odd):
    none = odd.limit(0)
    assert bpe.digests(none).count() == 0 and bpe.decode(bpe.encode(none)).count() == 0 and packing.pack(none).count() == 0


def test_cuts_cover():
    for n in [*range(1, 5000, 7), 2048, 4096, 100_001]:
        pieces = packing.cuts(n)
        assert sum(pieces) == n and max(pieces) <= 2048


def test_packing_is_a_partition_of_all_ids(spark, odd, documents):
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    for df in (odd.repartition(3), documents):
        rows = packing.pack(df).collect()
        docs, bins = {}, {}
        for r in rows:
            docs.setdefault(r.doc_id, []).append(r)
            bins.setdefault(r.sequence_id, []).append(r)
        for d in df.select("doc_id", "text").collect():
            ids, at = library.encode(d.text or "", add_special_tokens=False).ids + [1], 0
            for r in sorted(docs.pop(d.doc_id), key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(u4(ids[at : at + r.length]))
                at += r.length
            assert at == len(ids)
        assert not docs
        used = padding = 0
        for pieces in bins.values():
            at = 0
            for r in sorted(pieces, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert 0 < at <= 2048
            used += at
            padding += 0 if at & (at - 1) == 0 else 2048 - at
        assert padding < 0.01 * used


def test_word_encoder_equals_the_library():
    """Every character up to U+2FFF beside letters and digits, mixtures with contractions and marks, slices of columns."""
    encoder, rng = WordEncoder(tokenizer_path("word_bpe_49k.json")), random.Random(3)
    some = [*"abAB  \n\t\r''stSrvemlD019.,_-<|>!\x00\x85\xa0²ªº¼×÷éÉßŸĿıŉſ’€日Σς😀", "<|endoftext|>", "'s", "'RE", "''ve"]
    texts = [f"a{chr(i)}B {chr(i)}{chr(i)}\t1{chr(i)}." for i in range(0x3000)] + ["".join(rng.choices(some, k=rng.randint(0, 60))) for _ in range(3000)] + TEXTS
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(["cut off", *texts], kind).slice(1)
        ids, offsets = encoder.encode(column)
        assert len(offsets) == len(texts) + 1 and offsets[-1] == len(ids)
        for text, a, b in zip(texts, offsets, offsets[1:]):
            assert ids[a:b].tolist() == encoder.library.encode(text or "", add_special_tokens=False).ids, text
    for texts in ([], [None], ["", ""]):
        ids, offsets = encoder.encode(pa.array(texts, pa.string()))
        assert len(ids) == 0 and offsets.tolist() == [0] * (len(texts) + 1)


def test_pieces_not_parts_are_looked_up(monkeypatch):
    """Words with different marks and capitals before or after them are one piece each, so work follows distinct words."""
    asked, encoded = [], WordEncoder._encoded
    monkeypatch.setattr(WordEncoder, "_encoded", lambda self, keys, *rest: asked.extend(keys) or encoded(self, keys, *rest))
    words = [f"{a}{b}ou" for a in "bcdfghjklm" for b in ("ae", "io", "ré", "tü")]
    text = " ".join(f"{before}{form(w)}{after}" for w in words for before in ("", "(") for after in ("", ",", ".", "!!") for form in (str, str.title))
    WordEncoder(tokenizer_path("word_bpe_49k.json")).encode(pa.array([text]))
    assert len(asked) == len(words) + 4


def test_what_is_met_again_outlives_two_generations():
    memory = Memory(3)
    memory.add({"common": b"1"})
    for i in range(20):
        assert memory.find(["common", f"rare {i}"]) == [b"1", None]
        memory.add({f"rare {i}": b"2"})
    assert len(memory.young) + len(memory.old) <= 8
