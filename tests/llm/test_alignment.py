import hashlib
import random
from collections import Counter

import numpy as np
import sentencepiece
from tokenizers import Tokenizer

from triplewright.llm import alignment
from triplewright.llm.tokens import byte_letters, tokenizer_path

A = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
BYTE = {chr(c): b for b, c in byte_letters().items()}


def tokens(text):
    """(id, bytes) of A's and of B's tokens by the libraries on the whole text; none if the bytes differ."""
    a = [(i, bytes(BYTE[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()) for i in B.encode(text)]
    whole = (" " + text).encode()
    return (a, b) if text and b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])


def spans(tokens):
    out, at = [], 0
    for i, raw in tokens:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def plain(texts):
    """The contract's columns for each text, every token compared with every other of its text."""
    links, groups = [], []
    for text in texts:
        a, b = map(spans, tokens(text or ""))
        links.append([(x, y) for x, s, e in a for y, t, f in b if s < f and t < e] if len(a) < 400 else walked(a, b))
        common = sorted({e for *_, e in a} & {e for *_, e in b})
        cuts = [0, *common]
        groups.append([([i for i, s, e in a if lo <= s and e <= hi], [i for i, s, e in b if lo <= s and e <= hi]) for lo, hi in zip(cuts, common)] if len(a) < 400 else cut(a, b, common))
    count = Counter(x for one in links for x in one)
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for mine, of in zip(links, groups):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in of)
        out.append((sum(len(x) for x, _ in of), sum(len(y) for _, y in of), len(of), len(mine), sum(count[x] == best[x[1]] for x in mine), sum(count[x] for x in mine), hashlib.sha256(text.encode()).hexdigest() if of else ""))
    return out, count


def walked(a, b):
    i = j = 0
    out = []
    while i < len(a) and j < len(b):
        out.append((a[i][0], b[j][0]))
        x, y = a[i][2], b[j][2]
        i, j = i + (x <= y), j + (y <= x)
    return out


def cut(a, b, common):
    out, i, j = [], 0, 0
    for hi in common:
        x, y = [], []
        while i < len(a) and a[i][2] <= hi:
            x.append(a[i][0])
            i += 1
        while j < len(b) and b[j][2] <= hi:
            y.append(b[j][0])
            j += 1
        out.append((x, y))
    return out


def fuzz(rng):
    letters = ["a", "b", "The", "naïve", " ", " ", "  ", "\n", "\n\n", "\t", " ", " ", "\x85", "\x1c", "'s", "<|endoftext|>", "<s>", "<0x41>", "12", "日本", "😀", "\x00", "▁", "é", "_", "...", "\r\n"]
    return ["".join(rng.choices(letters[: 22 if i % 4 else None], k=rng.randint(0, 30))) for i in range(300)]


def check(df, rows):
    out, count = plain([t for _, t in rows])
    tokens = alignment.encoded(df)
    manifest = alignment.pair_counts(tokens)
    found = alignment.digests(tokens, alignment.Counts(manifest)).collect()
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((r.doc_id or 0, *(r[n] for n in names)) for r in found) == sorted((i or 0, *x) for (i, _), x in zip(rows, out))
    assert {(r.a_id, r.b_id): r.n for r in alignment.read_counts(manifest).collect()} == dict(count)


def test_equals_brute_force(spark, odd, documents):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    check(odd.repartition(3), rows)
    rows = list(enumerate(fuzz(random.Random(2)))) + [(None, "a ▁b"), (None, "ends with a blank "), (7, " "), (7, " ")]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows)
    check(documents, [(r.doc_id, r.text) for r in documents.collect()])


def test_empty(spark, odd):
    none = alignment.encoded(odd.limit(0))
    assert alignment.digests(none, alignment.Counts(alignment.pair_counts(none))).count() == 0
    only = alignment.encoded(odd.where("text is null or text = ''"))
    assert {(r.n_a, r.n_links, r.groups_sha256) for r in alignment.digests(only, alignment.Counts(alignment.pair_counts(only))).collect()} == {(0, 0, "")}


def test_groups(odd):
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    for r in alignment.align(alignment.encoded(odd)).collect():
        text = texts[r.doc_id]
        a, b = tokens(text)
        assert [i for g in r.groups for i in g.a] == [i for i, _ in a] and [i for g in r.groups for i in g.b] == [i for i, _ in b]
        assert len(r.groups) == len({e for *_, e in spans(a)} & {e for *_, e in spans(b)})


def test_counts_sent_on_early_and_many_shards(spark, documents, monkeypatch):
    monkeypatch.setattr(alignment, "HELD", 50)
    rows = [(r.doc_id, r.text) for r in documents.limit(20).collect()]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_an_unknown_pair_is_an_error(spark, documents):
    counts = alignment.Counts(alignment.pair_counts(alignment.encoded(documents.limit(5))))
    known = counts.of(np.array([], np.int64))
    assert len(known) == 0
    for key in (-1, 1 << 60):
        try:
            counts.of(np.array([key]))
        except ValueError:
            continue
        raise AssertionError("a pair without a count passed")
