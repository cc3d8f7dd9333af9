import random
import re

import pytest
import xxhash

from triplewright.llm import simhash


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def closure(prints):
    """Smallest id reachable over links of at most two bits; prints: id -> fingerprint."""
    out = {i: i for i in prints}
    ids = sorted(prints)
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if out[b] < out[a] and (prints[a] ^ prints[b]).bit_count() <= 2:
                    out[a], changed = out[b], True
    return out


def test_fingerprints_and_groups_equal_brute_force(odd, documents):
    for df in (odd, documents):
        prints = {r.doc_id: plain(r.text) for r in df.select("doc_id", "text").collect()}
        groups = closure(prints)
        rows = simhash.group(df).collect()
        assert len(rows) == len(prints)
        for r in rows:
            assert r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == groups[r.doc_id]
    assert simhash.group(odd.limit(0)).count() == 0


def clustered(rng):
    """Fingerprints alone, chains of small changes, and a dense group around one."""
    prints = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(140):
        p = rng.choice(prints)
        for _ in range(rng.randint(1, 3)):
            p ^= 1 << rng.randrange(64)
        prints.append(p)
    for _ in range(150):
        prints.append(prints[0] ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(20))
    return sorted(set(prints))


def signed(p):
    return p - (1 << 64) if p >> 63 else p


@pytest.mark.parametrize("distance, segments, most", [(2, 3, 256), (2, 3, 20), (2, 1, 256), (2, 2, 20), (2, 4, 256), (5, 4, 256)])
def test_links_are_all_pairs(spark, distance, segments, most):
    prints = clustered(random.Random(5))
    edges = simhash.links(spark.createDataFrame([(signed(p),) for p in prints], "fp long"), distance, segments, most)
    found = {(r.a, r.b) for r in edges.collect()}
    values = sorted(map(signed, prints))
    assert found == {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= distance}


def test_a_group_of_few_varying_bits(spark):
    """All 4096 values of 12 bits, which every entry holds, until the bits that vary are few."""
    edges = simhash.links(spark.range(4096).selectExpr("id * 1048576 as fp"), 2, 3, 16)
    assert edges.distinct().count() == 4096 * (12 + 66) // 2


def test_a_row_has_few_keys(spark):
    for distance, segments, keys in ((2, 3, 3), (2, 2, 34), (5, 8, 6)):
        radii = simhash.radii(segments, distance)
        masks = simhash.segments_of((1 << 64) - 1, segments)
        assert sum(len(simhash.ball(m, r)) for m, r in zip(masks, radii) if r >= 0) == keys
        assert sum(masks) == (1 << 64) - 1


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (None, "x y z")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.group(df).collect()) == [(0, 0), (0, 5), (5, 5)]
