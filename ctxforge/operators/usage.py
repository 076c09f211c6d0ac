"""Usage events: appending, reports, what was saved against what it cost."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules as R

MEASURES = ("token_estimate", "saved", "avoided", "sent", "adjusted", "ignored")


def clean_events(events: DataFrame) -> DataFrame:
    """Events fit to append: a kind is a must, a missing tool is 'unknown', a date to partition by."""
    return events.where("kind IS NOT NULL AND kind <> ''").withColumn("tool", F.coalesce(F.nullif("tool", F.lit("")), F.lit("unknown"))).withColumn("event_date", F.to_date("created_at"))


def append_usage(events: DataFrame, path: str) -> None:
    clean_events(events).write.mode("append").partitionBy("event_date").parquet(path)


def usage_report(events: DataFrame, *by: str) -> DataFrame:
    n = lambda k: F.count_if(F.col("kind") == k)
    sums = [F.coalesce(F.sum(m), F.lit(0)).cast("long").alias(m) for m in MEASURES]
    return events.groupBy(*by).agg(n("call").alias("calls"), n("cache_hit").alias("cache_hits"), n("cache_miss").alias("cache_misses"), *sums)


COUNTERS = {"calls": "call", "cache_hits": "cache_hit", "cache_misses": "cache_miss"}


def daily_states(events: DataFrame) -> DataFrame:
    """root, event_date, name, value, n: what a day adds to any report: its counts and sums (no value), and how often each latency was seen."""
    counts = usage_report(events, "root", "event_date")
    each = [F.struct(F.lit(c).alias("name"), F.lit(None).cast("long").alias("value"), F.col(c).alias("n")) for c in (*COUNTERS, *MEASURES)]
    sums = counts.select("root", "event_date", F.explode(F.array(*each)).alias("x")).select("root", "event_date", "x.*")
    seen = events.where("kind = 'latency' AND latency_ms > 0").groupBy("root", "event_date", F.col("latency_ms").cast("long").alias("value")).agg(F.count("*").alias("n"))
    return sums.unionByName(seen.select("root", "event_date", F.lit("latency").alias("name"), "value", "n"))


def day_marks(spark: SparkSession, path: str) -> dict[str, str]:
    """What each day's folder of appended events holds: files and bytes, from listings alone. It changes with every append."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out = {}
    for s in store.listStatus(at) if store.exists(at) else []:
        name, _, day = s.getPath().getName().partition("=")
        if name == "event_date":
            held = store.getContentSummary(s.getPath())
            out[day] = f"{held.getFileCount()}-{held.getLength()}"
    return out


def update_states(spark: SparkSession, events_path: str, states_path: str) -> list[str]:
    """Brings the daily states up to the appended events; gives the days that were read: those that are new or were appended to."""
    marks = day_marks(spark, events_path)
    at = spark._jvm.org.apache.hadoop.fs.Path(states_path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    days = [d for d, m in marks.items() if not store.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{states_path}/event_date={d}/mark={m}"))]
    if days:
        known = F.create_map(*[F.lit(x) for d in days for x in (d, marks[d])])
        events = spark.read.parquet(events_path)
        events = events.where(F.col("event_date").cast("string").isin([None if d == "__HIVE_DEFAULT_PARTITION__" else d for d in days]) | (F.col("event_date").isNull() & F.lit("__HIVE_DEFAULT_PARTITION__" in days)))
        rows = daily_states(events).withColumn("mark", F.element_at(known, F.coalesce(F.col("event_date").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))))
        rows.repartition("event_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date", "mark").parquet(states_path)
    return days


def read_states(spark: SparkSession, events_path: str, states_path: str) -> DataFrame:
    """The states of the days as they stand; those that later appends have replaced aren't read."""
    current = [f"{d}/{m}" for d, m in day_marks(spark, events_path).items()]
    rows = spark.read.schema("root string, name string, value long, n long, event_date string, mark string").parquet(states_path)
    return rows.where(F.concat_ws("/", F.coalesce("event_date", F.lit("__HIVE_DEFAULT_PARTITION__")), "mark").isin(current)).drop("mark")


def report_from_states(states: DataFrame, *by: str) -> DataFrame:
    """``usage_report`` from daily states."""
    return states.groupBy(*by).agg(*[F.coalesce(F.sum(F.when(F.col("name") == c, F.col("n"))), F.lit(0)).cast("long").alias(c) for c in (*COUNTERS, *MEASURES)])


def p95_from_states(states: DataFrame, *by: str) -> DataFrame:
    """``p95_latency`` from daily states: exact, as every latency's count is kept."""
    seen = states.where("name = 'latency'").groupBy(*by, "value").agg(F.sum("n").alias("n"))
    every = Window.partitionBy(*by)  # a row per distinct latency
    reached = seen.withColumn("upto", F.sum("n").over(every.orderBy("value"))).withColumn("all", F.sum("n").over(every)).where(100 * F.col("upto") >= 95 * F.col("all"))
    best = reached.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.min("value").alias("p95"))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by] or F.lit(True)
    return states.select(*by).distinct().join(best, on, "left").select(*by, F.coalesce("p95", F.lit(0)).cast("long").alias("p95_ms"))


def p95_latency(events: DataFrame, *by: str) -> DataFrame:
    """Nearest-rank 95th percentile of positive latencies, 0 without any."""
    on = F.when((F.col("kind") == "latency") & (F.col("latency_ms") > 0), F.col("latency_ms"))
    rows = events.withColumn("v", on)
    return rows.groupBy(*by).agg(F.coalesce(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY v)"), F.lit(0)).cast("long").alias("p95_ms"))


def saved_vs_overhead(report: DataFrame) -> DataFrame:
    saved, over = F.col("saved"), F.col("sent")
    return report.withColumns({
        "net": saved - over, "baseline": saved + over,
        "reduction_ratio": F.when(saved + over > 0, saved / (saved + over)).otherwise(0.0),
        "overhead_ratio": F.when(saved > 0, over / saved).otherwise(0.0),
        "within_budget": F.when(saved > 0, over / saved <= R.OVERHEAD_BUDGET).otherwise(over == 0),
    })


def report_rows(df: DataFrame, section: str, *metrics: str) -> DataFrame:
    """root, section, metric, value: a wide report as long rows."""
    each = [F.struct(F.lit(m).alias("metric"), (F.col(m).cast("int") if df.schema[m].dataType.typeName() == "boolean" else F.col(m)).cast("double").alias("value")) for m in metrics]
    return df.select("root", F.lit(section).alias("section"), F.explode(F.array(*each)).alias("x")).select("root", "section", "x.*")


def weekly_report(stats: DataFrame, sync: DataFrame, changes: DataFrame, report: DataFrame, latency: DataFrame, lint: DataFrame) -> DataFrame:
    """One long table of all reports by root; totals are of all time. A change is a metric, its rank the value."""
    parts = [
        report_rows(stats, "index", "files", "tokens"),
        report_rows(sync, "sync", "updated", "unchanged", "deleted", "read_errors"),
        changes.select("root", F.lit("changes").alias("section"), F.concat_ws(" ", "change_type", "path").alias("metric"), F.col("rank").cast("double").alias("value")),
        report_rows(report, "usage", "calls", "cache_hits", "cache_misses", "token_estimate", "saved"),
        report_rows(latency, "usage", "p95_ms"),
        report_rows(saved_vs_overhead(report), "savings", "net", "baseline", "reduction_ratio", "overhead_ratio", "within_budget"),
        report_rows(lint, "lint", "high", "medium", "low"),
    ]
    return reduce(DataFrame.unionByName, parts)
