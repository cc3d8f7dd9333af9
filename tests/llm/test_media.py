import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from triplewright.llm import media


def test_png_round_trip():
    rng = random.Random(1)
    for n in (0, 1, 191, 192, 193, 5000):
        data = media.payload(rng.randbytes(n))
        assert len(data) % 192 == 0 and len(data) >= max(192, n) and media.from_png(media.to_png(data)) == data
        assert media.feature(data) == media.feature(data)


def stored(spark, df):
    base = media.shared_dir(spark)
    media.store(df, base)
    return spark.read.parquet(base)


def test_digests_equal_a_plain_reading(spark, odd, documents):
    for df in (documents, odd.withColumn("items", F.lit(1))):
        rows = media.resolve(media.interleave(media.pages(df)), media.payload_features(stored(spark, df))).collect()
        texts = {r.doc_id: (r.text or "").encode() for r in df.select("doc_id", "text").collect()}
        assert len(rows) == len(texts)
        for r in rows:
            data = texts[r.doc_id]
            whole = data.ljust(max(192, -(-len(data) // 192) * 192))
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(whole), hashlib.sha256(whole).hexdigest())
            assert r.tail_crc32 == zlib.crc32(whole[-16:]) and r.media_sha256 == hashlib.sha256(media.to_png(whole)).hexdigest()
            assert r.caption == f"{len(data)} bytes" and r.feature
    assert media.payload_features(stored(spark, odd.limit(0))).count() == 0


def test_sequences_hold_whole_texts(odd, documents):
    for df in (documents, odd):
        texts = {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}
        for r in media.interleave(media.pages(df)).collect():
            assert [i.position for i in r["items"]] == list(range(len(r["items"])))
            lines = [" ".join(line.split()) for line in texts[r.doc_id].split("\n")]
            half = (len(lines) + 1) // 2
            before = [i.text for i in r["items"] if i.kind == "text"]
            assert before == [x for x in lines if x]
            assert [i.position for i in r["items"] if i.kind == "img"] == [sum(map(bool, lines[:half]))]


def test_altered_and_missing_payloads(spark, odd):
    rows = stored(spark, odd)
    altered = rows.withColumn("media", F.when(F.col("media").isNotNull(), F.concat(F.expr("left(media, length(media) - 20)"), F.expr("right(media, 19)"))))
    with pytest.raises(Exception):
        media.payload_features(altered).collect()
    swapped = rows.where("media is not null").withColumn("digest", F.reverse("digest"))
    with pytest.raises(Exception, match="doesn't match its digest"):
        media.payload_features(swapped).collect()
    none = media.resolve(media.interleave(media.pages(odd)), media.payload_features(rows.limit(0))).collect()
    assert len(none) == odd.count() and all(r.payload_sha256 is None and r.caption for r in none)


def test_items_stay_aligned():
    found = media.items("<p>a</p><img src=u.png alt='Alt'><figure><figcaption>Cap <b>tion</b></figcaption><video src='sha256:00'></video></figure>b<script>no</script><p>c <img src=v> d")
    assert [(i["kind"], i["text"], i["caption"]) for i in found] == [("text", "a", None), ("img", None, "Alt"), ("video", None, "Cap tion"), ("text", "b", None), ("text", "c", None), ("img", None, None), ("text", "d", None)]
    assert found[2]["digest"] == "00" and [i["position"] for i in found] == list(range(7))


def test_captions_follow_their_figures():
    def told(page):
        return [(i["kind"], i["text"], i["caption"]) for i in media.items(page)]

    assert told('<figure><figcaption>cap A</figcaption></figure><figure><img alt="alt B"></figure>') == [("text", "cap A", None), ("img", None, "alt B")]
    assert told("<figure><img src=a><figcaption>A</figcaption></figure><figure><img src=b><img src=c><figcaption>B <i>b</i></figcaption></figure>") == [("img", None, "A"), ("img", None, "B b"), ("img", None, "B b")]
    assert told("<figure><table><tr><td>1</table><figcaption>Table 1</figcaption></figure>x") == [("text", "1", None), ("text", "Table 1", None), ("text", "x", None)]


def test_sources_of_media():
    def digests(page):
        return [i["digest"] for i in media.items(page)]

    a = hashlib.sha256(b"a.mp4").hexdigest()
    assert digests("<video><source src=a.mp4><source src=b.mp4></video>") == digests("<img srcset='a.mp4 2x, b 1x'>") == digests("<picture><source srcset='a.mp4 1x'><img></picture>") == [a]
    assert digests("<img alt=x>") == [None] and digests("<video src=sha256:00><source src=a.mp4></video>") == ["00"]


def test_sequences_take_one_worker_a_task(spark, odd):
    found = media.sequences(odd)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(found.collect()) == sorted(media.interleave(media.pages(odd)).collect())
