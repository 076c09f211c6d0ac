"""Result-cache tables: snapshots, replayed access logs, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Logs are replayed by ranges of so many milliseconds of each key.
RANGE_MS = 3_600_000


def cache_replay(log: DataFrame, range_ms: int = RANGE_MS) -> DataFrame:
    """Reads with hit: the latest earlier write of the key is a set that hasn't expired (ttl 0: never).

    A key's log is cut into ranges of time. The last write of each range is an aggregate; handed on from range to range (a row each) it
    is what a range starts from, so the log itself is shuffled once, by key and range, and a hot key lies in as many tasks as it has ranges.
    """
    write = F.when(F.col("op") != "get", F.struct("at_ms", "seq", "op", (F.col("at_ms") + F.col("ttl_ms")).alias("expires"), "ttl_ms"))
    cut = log.withColumn("range", F.floor(F.col("at_ms") / range_ms)).withColumn("write", write)
    ends = cut.groupBy(F.col("key").alias("k"), F.col("range").alias("r")).agg(F.max("write").alias("end"))
    w = Window.partitionBy("k").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.withColumn("start", F.last("end", ignorenulls=True).over(w)).drop("end")
    rows = cut.join(starts, F.col("key").eqNullSafe(F.col("k")) & F.col("range").eqNullSafe(F.col("r")))
    w = Window.partitionBy("key", "range").orderBy("at_ms", "seq").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("last", F.coalesce(F.last("write", ignorenulls=True).over(w), "start")).where("op = 'get'")
    hit = F.coalesce((F.col("last.op") == "set") & ((F.col("last.ttl_ms") <= 0) | (F.col("last.expires") > F.col("at_ms"))), F.lit(False))
    return out.select("key", "at_ms", "seq", hit.alias("hit"))


def snapshot(log: DataFrame) -> DataFrame:
    """key, expires_at, last_access, seq: the last set of each key."""
    return log.where("op = 'set'").groupBy("key").agg(F.max(F.struct("at_ms", "seq", "ttl_ms")).alias("m")).select("key", F.when(F.col("m.ttl_ms") > 0, F.col("m.at_ms") + F.col("m.ttl_ms")).otherwise(0).alias("expires_at"), F.col("m.at_ms").alias("last_access"), F.col("m.seq").alias("seq"))


def cache_compact(entries: DataFrame, now_ms: int, capacity: int = 1024) -> DataFrame:
    """Live entries, the most recently read ones up to the capacity."""
    live = entries.where((F.col("key") != "") & ((F.col("expires_at") == 0) | (F.col("expires_at") > now_ms)))
    return live.orderBy(F.col("last_access").desc(), F.col("seq").desc()).limit(capacity)


def cache_stats(entries: DataFrame, compacted: DataFrame, reads: DataFrame, now_ms: int) -> DataFrame:
    live = entries.where((F.col("key") != "") & ((F.col("expires_at") == 0) | (F.col("expires_at") > now_ms))).agg(F.count("*").alias("live"))
    kept = compacted.agg(F.count("*").alias("entries"))
    seen = reads.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    return kept.crossJoin(seen).crossJoin(live).select("entries", "hits", "misses", (F.col("live") - F.col("entries")).alias("evictions"))  # a row each
