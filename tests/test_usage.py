"""Usage: keyed hashes of visitors."""

import datetime
import hashlib
import hmac

from pyspark.sql import functions as F

from triplewright.streaming import usage


def test_keyed_hashes_equal_the_library(spark):
    keys = ["", "00", "36" * 64, "5c" * 64, "ff" * 64, *(bytes(range(200, 200 + n)).hex() for n in (1, 6, 7, 8, 14, 31, 32, 33, 55))]
    rows = spark.createDataFrame([(k, m) for k in keys for m in ("", "é|x", "a" * 200)], "k string, m string")
    for r in rows.withColumn("h", usage.hmac_sha256(F.col("k"), F.col("m"))).collect():
        assert r.h == hmac.new(bytes.fromhex(r.k), r.m.encode(), hashlib.sha256).hexdigest()


def test_a_visitor_takes_no_function_of_each_byte(spark):
    """Lambda functions are not compiled: a row took 256 calls of them."""
    day = datetime.date(2024, 1, 5)
    df = spark.createDataFrame([("1", "agent", 3, day)], "ip string, agent string, ontology int, day date").withColumn("visitor", usage.visitor("salt", *(F.col(c) for c in ("ip", "agent", "ontology", "day"))))
    key = hmac.new(b"salt", str(day).encode(), hashlib.sha256).digest()
    assert df.first().visitor == hmac.new(key, b"1|agent|3|2024-01-05", hashlib.sha256).hexdigest()
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
