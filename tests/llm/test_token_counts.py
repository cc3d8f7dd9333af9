import hashlib
import random
import time

from tokenizers import Tokenizer

from triplewright.llm import token_counts
from triplewright.llm.tokens import byte_encoder, tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


def test_random_edits_equal_counting_anew():
    rng, encoder, library = random.Random(7), byte_encoder(PATH), Tokenizer.from_file(PATH)
    pool = ["the", " ", "  ", "\n", "'", "re", "'ll", "12", ".", "é", "日本", " a", "<|endoftext|>", "<|end", "oftext|>", "x" * 40]
    for _ in range(400):
        counted = token_counts.Counted("".join(rng.choices(pool[: 12 if rng.random() < 0.7 else 16], k=rng.randint(0, 300))), encoder)
        for _ in range(8):
            a = rng.randint(0, len(counted.text))
            b = min(len(counted.text), a + rng.choice([0, 0, 1, 2, 5, 60]))
            counted.edit(a, b, "".join(rng.choices(pool[: 12 if rng.random() < 0.8 else 16], k=rng.randint(0, 4))))
            assert counted.tokens == len(library.encode(counted.text, add_special_tokens=False).ids), counted.text


def test_edits_touch_little():
    counted = token_counts.Counted("some words of a long text " * 4000, byte_encoder(PATH))
    counted.edit(50_000, 50_004, "changed")
    assert counted.recounted < 40


def test_special_tokens_are_local():
    counted = token_counts.Counted("a <|endoftext|> b " * 3000, byte_encoder(PATH))
    counted.edit(18 * 1000 + 3, 18 * 1000 + 5, "")
    counted.edit(18 * 500, 18 * 500, "<|endof")
    assert counted.recounted < 80
    library = Tokenizer.from_file(PATH)
    assert counted.tokens == len(library.encode(counted.text, add_special_tokens=False).ids)


def test_many_edits_of_a_long_text_take_time_by_what_they_touch():
    def seconds(n):
        text, encoder = "some words of a long text, 12 of them. " * n, byte_encoder(PATH)
        counted = token_counts.Counted(text, encoder)
        began = time.process_time()
        for i in reversed(range(0, len(text) - 40, len(text) // 500)):
            counted.edit(i, i + 5, "new words")
        assert counted.recounted < 500 * 40
        return time.process_time() - began

    seconds(100)
    assert seconds(60_000) < 4 * seconds(2_000) + 0.5


def test_counts_equal_the_library(odd, documents):
    library = Tokenizer.from_file(PATH)
    for df in (documents, odd.withColumnRenamed("lang", "source")):
        texts = {r.doc_id: (r.text or "", r.source) for r in df.select("doc_id", "text", "source").collect()}
        rows = token_counts.count_edited(df).collect()
        assert len(rows) == len(texts)
        for r in rows:
            text, source = texts[r.doc_id]
            after = text
            for a, b, new in reversed(token_counts.edits_of(text, source)):
                after = after[:a] + new + after[b:]
            assert r.text_after_sha256 == hashlib.sha256(after.encode()).hexdigest()
            assert (r.n_tokens, r.n_tokens_after) == tuple(len(library.encode(t, add_special_tokens=False).ids) for t in (text, after))
    assert token_counts.count_edited(documents.limit(0)).count() == 0
