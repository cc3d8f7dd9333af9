import random
import re
import time
from collections import Counter, defaultdict

import duckdb
from pyspark.sql import functions as F

from triplewright.llm import divergence

#: A term as the contract writes it.
WRITTEN = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def plain(rows, least, top):
    """The audit in plain Python; rows: (lang, source, text)."""
    count, seen, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        count[lang, source].update(terms)
        seen[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, n in seen[lang].items() if n >= least]
        of = {s: count[lang, s] for g, s in groups if g == lang}
        whole = sum(of.values(), Counter())

        def p(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        mine, q = p(of[source]), p(whole)
        pair = [(sum(abs(mine[t] - theirs[t]) for t in kept), s) for s, theirs in ((s, p(c)) for s, c in of.items() if s != source)]
        term = [(mine[t] - q[t], t) for t in kept if of[source][t] and mine[t] > q[t]]
        for part, found, most in (("pair", pair, None), ("term", term, top)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, i) for i, (value, item) in enumerate(found[:most], 1)]
    return sorted(out)


def spark_rows(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_equals_plain_python_on_odd_rows(spark):
    rng = random.Random(4)
    words = ["Straße", "strasse", "ÉTÉ", "été", "a", "B", "b", "日本語", "😀x", "don't", "x1y", "Ωm", "\x00q", "it\x7fis"]
    rows = [(rng.choice(["de", "en", None, ""]), rng.choice(["s", "t", "u", None]), " ".join(rng.choices(words, k=rng.randint(0, 12)))) for _ in range(200)]
    rows += [("xx", "only", "alone"), ("yy", "s", None), ("yy", "t", ""), ("de", "s", "b " * 50_000), ("de", "no terms", "1 2 3")] + [("de", "copies", "a b B a")] * 50
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, source string, text string, term int, n int")
    for least, top in ((2, 3), (10, 50), (10**6, 50)):
        assert spark_rows(divergence.audit(df, least, top)) == plain(rows, least, top)
    assert divergence.audit(df.limit(0)).count() == 0


def test_equals_sql(spark, sf_dir):
    expected = duckdb.connect()
    expected.execute(f"create view documents as from '{sf_dir}/documents.parquet'")
    found = spark_rows(divergence.op11_divergence(spark, sf_dir))
    assert found == sorted(expected.execute(f"select {', '.join(COLUMNS)} from ({divergence.OP11_SQL})").fetchall()) and len(found) > 300


def test_shares_are_exact_beyond_longs(spark):
    row = spark.sql("select 4000000000000000000L n, 4100000000000000000L total, 7L kept").select(divergence.share("n", "total", "kept").alias("p")).first()
    assert row.p == 1 + 10**9 * (4 * 10**18 + 5) // (41 * 10**17 + 35)


def test_only_ascii_is_lowered(spark):
    texts = ["ABC xYz 19", "ÉTÉ Straße K İ A", "", "Ωm Z"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", divergence.lowered().alias("low")).collect()
    assert {r.text: r.low for r in rows} == {t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in texts}


def test_terms_have_the_written_characters(spark):
    chars = spark.range(0x110000).where("id not between 55296 and 57343").select("id", F.expr("decode(unhex('0000FEFF' || lpad(hex(id), 8, '0')), 'utf-32')").alias("c"))
    kinds = chars.select("id", F.length("c").alias("n"), *(F.regexp_extract_all("c", F.lit(p), F.lit(0)).alias(k) for k, p in (("found", divergence.TERM), ("written", WRITTEN))))
    row = kinds.agg(F.count("*").alias("all"), F.sum("n").alias("n"), F.count_if(F.expr("found <> written")).alias("differ"), F.sum(F.size("written")).alias("letters")).first()
    assert (row.all, row.n, row.differ, row.letters) == (0x110000 - 2048, 0x110000 - 2048, 0, 0x110000 - 2048 - 76)


def test_terms_are_found_sooner_than_as_written(spark):
    texts = spark.range(0, 40, 1, 1).select(F.expr("repeat(concat('straße und wörter ', id, ' those are plain words; '), 10000)").alias("text")).cache()
    texts.count()

    def seconds(pattern):
        began = time.perf_counter()
        texts.select(F.sum(F.size(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))))).first()
        return time.perf_counter() - began

    took = [(seconds(divergence.TERM), seconds(WRITTEN)) for _ in range(4)]
    texts.unpersist()
    assert 2 * min(t for t, _ in took) < min(t for _, t in took)
