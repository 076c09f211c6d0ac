"""Filter interaction audit: every order of five filters replayed on every document.

Each document's five flags are found once. They meet the 120 orders, a broadcast table of fixed
size; each order is exploded into its five steps and the first step that fails is where the document
goes. Sums by part, order and step are combined in the tasks that made the rows, so what is shuffled
is 600 rows for each part and task, whatever the documents.

Filter E (the same text under a smaller id) compares SHA-256 digests. The smallest id of each digest
is an aggregate; documents find it by digest and id, so copies of one text don't meet in a task.

Defined results: a null text is empty; a null lang is the part ''; a null id is smaller and larger than
none, so such a row is never E; rows that repeat an id and a text are copies of each other but of
no smaller id, so the first of equal texts stays, as often as it is repeated. A label counts if any row of
``labels`` for that id gives it; a null id has no label. Whole texts are read. Other columns aren't looked at.
An empty table has no parts, so no rows.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import UPPER, materialize, table, text_of

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT, MARKS = 200, 50, 3, b"#$%&*|"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def own_flags(text: bytes) -> int:
    """What the filters that look at one text alone find, as bits: A 1, B 2, C 4, D 8."""
    words = text.split()  # of bytes: at the six ASCII separators alone
    upper, marks = len(text) - len(text.translate(None, UPPER.encode())), len(text) - len(text.translate(None, MARKS))
    few, dull = len(words) < MIN_WORDS, 100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words)
    return few + 2 * dull + 4 * (100 * upper > MAX_UPPER_PERCENT * len(text.decode("utf-8", "replace"))) + 8 * (marks > 0)


def _judged(batches):
    for b in batches:
        texts = b.column(b.num_columns - 1).to_pylist()
        found = [pa.array([own_flags(t) for t in texts], pa.int32()), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *found], names=["doc_id", "part", "own", "digest"])


def flags(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """A row per document: part, fails (bit i set: it fails filter i), good, toxic."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text_of(text_col).cast("binary").alias("t"))
    rows = materialize(rows.mapInArrow(_judged, f"doc_id {kind}, part string, own int, digest binary"))  # small rows; texts are read once
    least = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("least", F.lit(True))
    known = labels.groupBy("doc_id").agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic")).where("doc_id IS NOT NULL AND (good OR toxic)")
    out = rows.join(least, ["digest", "doc_id"], "left").join(known, "doc_id", "left")
    same = F.when(F.col("least").isNull() & F.col("doc_id").isNotNull(), 16).otherwise(0)
    return out.select("part", (F.col("own") + same).alias("fails"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def orders(spark) -> DataFrame:
    """filter_order, bits: the bits of its filters in turn."""
    rows = [("".join(p), [1 << FILTERS.index(c) for c in p]) for p in permutations(FILTERS)]
    return spark.createDataFrame(rows, "filter_order string, bits array<int>")


def replay(flagged: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of each."""
    met = flagged.crossJoin(F.broadcast(orders(flagged.sparkSession)))  # 120 rows, whatever the documents
    fails = lambda bit: F.col("fails").bitwiseAND(bit) != 0
    first = F.lit(6)
    for i in range(4, -1, -1):
        first = F.when(fails(F.get("bits", F.lit(i))), i + 1).otherwise(first)
    steps = met.select("part", "filter_order", "fails", "good", "toxic", first.alias("first"), F.posexplode("bits").alias("before", "bit"))
    step = F.col("before") + 1
    here = F.col("first") == step
    values = {
        "kept": F.col("first") > step, "removed": here, "redundant": fails(F.col("bit")) & (F.col("first") < step),
        "unique_fails": F.col("fails") == F.col("bit"), "good_lost": here & F.col("good"), "toxic_lost": here & F.col("toxic"),
    }
    return steps.groupBy("part", "filter_order", step.alias("step")).agg(*[F.count_if(values[c]).alias(c) for c in COUNTS])


def filter_audit(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows a part."""
    sums = replay(flags(docs, labels, text_col))
    filter_ = F.col("filter_order").substr(F.col("step"), F.lit(1))
    w = Window.partitionBy("part", filter_)  # 120 rows of a part
    return sums.withColumn("shapley", F.sum("removed").over(w))


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
f AS (SELECT part, len(ws) < {MIN_WORDS} AS a, 100 * len(list_distinct(ws)) < {MIN_DISTINCT_PERCENT} * len(ws) AS b,
             100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {MAX_UPPER_PERCENT} * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, coalesce(w.doc_id > least, false) AS e,
             coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w JOIN m USING (t) LEFT JOIN l USING (doc_id)),
x AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS fails, good, toxic FROM f),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT p.c || q.c || r.c || s.c || t.c AS filter_order FROM letters p, letters q, letters r, letters s, letters t
      WHERE len(list_distinct([p.c, q.c, r.c, s.c, t.c])) = 5),
s AS (SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM o),
bits AS (SELECT *, list_transform([1, 2, 3, 4, 5], lambda i: 1 << (ascii(filter_order[i]) - 65)) AS bs FROM s),
r AS (SELECT part, filter_order, step, bs[step] AS bit, coalesce(list_min(list_filter([1, 2, 3, 4, 5], lambda i: x.fails & bs[i] <> 0)), 6) AS first, fails, good, toxic FROM x, bits),
g AS (SELECT part, filter_order, step::INT AS step, count(*) FILTER (WHERE first > step) AS kept, count(*) FILTER (WHERE first = step) AS removed,
             count(*) FILTER (WHERE fails & bit <> 0 AND first < step) AS redundant, count(*) FILTER (WHERE fails = bit) AS unique_fails,
             count(*) FILTER (WHERE first = step AND good) AS good_lost, count(*) FILTER (WHERE first = step AND toxic) AS toxic_lost FROM r GROUP BY ALL)
SELECT *, sum(removed) OVER (PARTITION BY part, filter_order[step])::BIGINT AS shapley FROM g
"""
