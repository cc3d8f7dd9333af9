"""Usage events as a stream and as a table: capture, daily rollup, totals, trends, schedules."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triplewright.operators.staging import stage
from triplewright.sources import results

#: What marks an agent as no person, in lower case.
BOTS = ("bot", "crawl", "spider", "slurp", "headless", "python-requests", "curl", "wget", "httpx", "scrapy", "facebookexternalhit", "bingpreview", "monitor", "uptime", "pingdom", "gptbot")


def wanted(agent: Column, dnt: Column, gpc: Column) -> Column:
    """Neither a bot (an empty agent counts as one) nor someone who asks not to be counted."""
    return F.coalesce((agent != "") & ~F.lower(agent).rlike("|".join(map(re.escape, BOTS))), F.lit(False)) & (F.coalesce(dnt, F.lit("")) != "1") & (F.coalesce(gpc, F.lit("")) != "1")


def hmac_sha256(key: Column, message: Column) -> Column:
    """HMAC-SHA-256 in hexadecimal; key is of up to 64 bytes, in hexadecimal. Pads meet the key by words of seven bytes (a long holds them), so that all of it is compiled."""
    block = F.rpad(key, 128, "0")

    def padded(pad: int) -> Column:
        words = [(i, min(14, 128 - i)) for i in range(0, 128, 14)]
        word = lambda i, n: F.conv(F.substr(block, F.lit(i + 1), F.lit(n)), 16, 10).cast("long").bitwiseXOR(F.lit(int.from_bytes(bytes([pad]) * (n // 2))))
        return F.unhex(F.concat(*(F.lpad(F.hex(word(i, n)), n, "0") for i, n in words)))

    return F.sha2(F.concat(padded(0x5C), F.unhex(F.sha2(F.concat(padded(0x36), F.encode(message, "utf-8")), 256))), 256)


def visitor(secret: str, ip: Column, agent: Column, ontology: Column, day: Column) -> Column:
    """A keyed hash that holds for a day: its key is the day's under the secret. What isn't known counts as empty, each in its own place."""
    raw = secret.encode()
    key = (raw if len(raw) <= 64 else hashlib.sha256(raw).digest()).hex()
    known = [F.coalesce(c.cast("string"), F.lit("")) for c in (ip, agent, ontology, day)]
    return hmac_sha256(hmac_sha256(F.lit(key), known[3]), F.concat_ws("|", *known))


def unique_visits(events: DataFrame, ts: str = "ts") -> DataFrame:
    """First event of each (visitor, kind, ontology, day), on a stream the first to come; its state is dropped 48 hours later."""
    keys = ["visitor", "kind", "ontology", "day"]
    if events.isStreaming:
        return events.withWatermark(ts, "48 hours").dropDuplicatesWithinWatermark(keys)
    rest = [c for c in events.columns if c not in (*keys, ts)]
    return events.groupBy(*keys).agg(F.min(F.struct(ts, *rest)).alias("_first")).select(*keys, "_first.*").select(*events.columns)


def daily(events: DataFrame, ontologies: DataFrame | None = None, keys: tuple = ("ontology", "kind")) -> DataFrame:
    """Totals and distinct visitors per day; ontologies that aren't known are left out."""
    if ontologies is not None:
        events = events.join(ontologies.select(keys[0]).distinct(), keys[0], "left_semi")
    return events.groupBy(*keys, "day").agg(F.count("*").alias("total"), F.count_distinct("user_id").alias("visitors"))


def stream_daily(events: DataFrame, sink, checkpoint: str, ts: str = "ts"):
    """Starts a query that keeps daily totals of a stream; sink(batch, id) gets absolute counts of the days that changed."""
    counts = events.withWatermark(ts, "48 hours").groupBy(F.window(ts, "1 day").alias("w"), "ontology", "kind").agg(F.count("*").alias("total"))
    rows = counts.select("ontology", "kind", F.to_date("w.start").alias("day"), "total")
    return rows.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink).start()


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows with those of equal keys replaced by the new ones: the same batch twice changes nothing. Of several new rows of a key the largest counts."""
    rest = [c for c in stored.columns if c not in keys]
    if rest:
        new = new.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_new")).select(*keys, "_new.*")
    else:
        new = new.select(*keys).distinct()
    return stored.join(new.select(*keys), keys, "left_anti").select(*stored.columns).unionByName(new.select(*stored.columns))


def overwrite(stored_path: str, keys: list[str]):
    """A foreachBatch sink that upserts into a Parquet table. The new table is written beside the old one and takes its place by two renames;
    the old one goes last, and a run that finds only what a broken one left takes that up."""

    def run(batch: DataFrame, _id: int) -> None:
        spark = batch.sparkSession
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(stored_path)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        old, fresh = (jvm.org.apache.hadoop.fs.Path(f"{stored_path}.{x}") for x in ("old", "new"))
        if files.exists(old) and not files.exists(path):
            files.rename(old, path)
        for left in (old, fresh):
            files.delete(left, True)
        merged = upsert(spark.read.parquet(stored_path), batch, keys) if files.exists(path) else upsert(batch.limit(0), batch, keys)
        merged.write.parquet(f"{stored_path}.new")
        if files.exists(path):
            files.rename(path, old)
        files.rename(fresh, path)
        files.delete(old, True)

    return run


def export(rows: DataFrame, path: str, exported_at: str) -> int:
    """A usage table as one JSON document in text files below path, in the order of their names: when it was made, how many rows, the rows. Gives
    their number. Nulls are stated; days are written as dates."""
    line = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    lines = stage(rows.select(line.alias("line")).withColumn("at", F.monotonically_increasing_id()))
    n = lines.count()
    results.write_lines(lines, path, f'{{"exported_at":{json.dumps(exported_at)},"count":{n},"rows":[', "]}", True)
    return n


def trend(usage: DataFrame, start: str, end: str, unit: str = "week", value: str = "total") -> DataFrame:
    """Sums per bucket from start to end, buckets without usage counting zero. Weeks begin on Mondays."""
    spark = usage.sparkSession
    axis = spark.sql(f"SELECT explode(sequence(date_trunc('{unit}', date'{start}'), date_trunc('{unit}', date'{end}'), interval 1 {unit})) AS bucket").select(F.to_date("bucket").alias("bucket"))
    sums = usage.where(F.col("day").between(start, end)).groupBy(F.to_date(F.date_trunc(unit, "day")).alias("bucket")).agg(F.sum(value).alias("n"))
    return axis.join(sums, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n")).orderBy("bucket")


def host_schedule(due: DataFrame, interval_s: int, host: str = "host", order: str = "last_checked") -> DataFrame:
    """Seconds after which each due row is polled: oldest first (never polled before all), `interval_s` apart on a host."""
    w = W.partitionBy(host).orderBy(F.col(order).asc_nulls_first(), "id")
    return due.withColumn("delay", (F.row_number().over(w) - 1) * interval_s)


#: HTTP statuses that may be others next time.
TRANSIENT = (429, 500, 502, 503, 504, 520, 522, 524)


def retryable(checks: DataFrame, now: Column, most: int) -> DataFrame:
    """The `most` longest unchecked of the ontologies whose last check failed in passing: (id, resolvable, http_status, error, retry_after, checked_at).

    In passing: a transient status, or an error without any, with no time to wait for or one that has come. Rows never checked come first,
    ids decide among equals; a null `resolvable` hasn't failed.
    """
    transient = F.col("http_status").isin(*TRANSIENT) | (F.col("http_status").isNull() & F.col("error").isNotNull())
    due = F.col("retry_after").isNull() | (F.col("retry_after") <= now)
    return checks.where(~F.col("resolvable") & transient & due).orderBy(F.asc_nulls_first("checked_at"), "id").limit(most)


def held_action(age_days: Column, nudged: Column, nudge_after: int = 7, retire_after: int = 30) -> Column:
    """What happens to a held draft: retired by age, nudged once, or nothing."""
    return F.when(age_days >= retire_after, "retire").when((age_days >= nudge_after) & ~nudged, "nudge").otherwise("wait")
