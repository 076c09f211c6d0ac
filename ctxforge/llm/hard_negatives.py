"""Hard negatives by bit-sliced integer products.

Vectors become integers, floor(scale * x). A row's score is its inner product with an anchor. Rows are sliced
into bit planes: with the planes down to bit k known, a score lies between the sum so far plus (2**k - 1) times
the anchor's negative components and that sum plus (2**k - 1) times its positive ones. Planes are
taken from the most significant one; each halves the interval, and rows whose interval can't qualify any more are
dropped, so most meet few planes. A row qualifies as a positive if it may be among the best so far; as a
negative if it may lie in a positive's window and among the best there. Bounds are never strict on equal scores, so
ties are decided by id alone. With the last plane the interval is the score.

Anchors are the query set. They go to the tasks in blocks of ``BLOCK_BYTES`` at most; each block scans
all rows twice, once for positives and, these being known, once for negatives. A task keeps the best of what it has
read, 5 or 50 rows an anchor, and only these are shuffled, so a label or a vector that a third of all rows have costs no
task more than its share of rows.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part, nor do those
with a scaled component of 2**24 or more, whose scores may not fit; missing components of a shorter vector count as 0,
those beyond the longest anchor aren't looked at; rows with an anchor's own id are neither its positives nor its negatives; of rows that
repeat an anchor's id the one with the smallest label and vector is the anchor; rows that repeat another id are rows of their own; an
anchor without positives, and a positive without a negative, gives no row; an empty table gives none. Other columns
aren't looked at, whatever their names.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import table

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
#: A negative's score lies between these percentages of the positive's.
LEAST_PERCENT, MOST_PERCENT = 30, 90
#: Anchors of a pass (bytes of their integers); anchors and rows that meet at a time; the share of pairs below which they are followed one by one; such pairs at a time.
BLOCK_BYTES, ANCHORS, ROWS, SPARSE, PAIRS = 1 << 25, 256, 4096, 0.1, 20_000
#: Components from here on (scaled) leave a row out.
TOO_LARGE = 1 << 24
SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def integers(vectors: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows by dims) scaled components, and which rows take part."""
    lengths = np.diff(vectors.offsets.to_numpy())
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    start = np.cumsum(lengths) - lengths
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(scale * values)
        bad = ~(np.abs(scaled) < TOO_LARGE)  # nulls have come as NaN
    good = np.ones(len(lengths), bool)
    good[np.repeat(np.arange(len(lengths)), lengths)[bad]] = False
    scaled[bad] = 0
    out = np.zeros((len(lengths), dims), np.int64)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        width = min(int(n), dims)
        out[rows, :width] = scaled[start[rows][:, None] + np.arange(width)]
    return out, good


class Anchors:
    """A block of anchors: ids, labels, integers, and what remaining planes can add at most and at least."""

    def __init__(self, ids, labels, vectors):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.more, self.less = np.maximum(vectors, 0).sum(1), np.minimum(vectors, 0).sum(1)


def sliced_scores(anchors: np.ndarray, more: np.ndarray, less: np.ndarray, rows: np.ndarray, alive: np.ndarray, cut):
    """(anchor, rows, scores) of the pairs that no plane has dropped.

    ``cut(anchor, low, high)`` says which of an anchor's pairs may still qualify, given the bounds of their scores.
    """
    top = max(int(rows.max(initial=0)), ~int(rows.min(initial=0))).bit_length()  # the sign's plane
    exact = anchors.shape[1] * int(np.abs(anchors).max(initial=0)) << (top + 1) < 1 << 53
    kind = np.float64 if exact else np.int64
    a = anchors.astype(kind)
    score: np.ndarray | None = np.zeros(alive.shape, kind)
    left = [np.flatnonzero(x) for x in alive]
    kept: list[np.ndarray] = []
    for k in range(top, -1, -1):
        plane, weight, rest = (rows >> k & 1).astype(kind), -(1 << k) if k == top else 1 << k, (1 << k) - 1
        if score is not None and sum(map(len, left)) < SPARSE * alive.size:
            kept, score = [s[x] for s, x in zip(score, left, strict=True)], None
        if score is not None:
            score += weight * (a @ plane.T)
        for i, at in enumerate(left):
            if not len(at):
                continue
            if score is None:
                kept[i] = kept[i] + weight * np.concatenate([plane[at[j : j + PAIRS]] @ a[i] for j in range(0, len(at), PAIRS)])
            now = kept[i] if score is None else score[i, at]
            stay = cut(i, now + rest * less[i], now + rest * more[i])
            if not stay.all():
                left[i] = at[stay]
                if score is None:
                    kept[i] = now[stay]
    for i, at in enumerate(left):
        if len(at):
            yield i, at, (kept[i] if score is None else score[i, at]).astype(np.int64)


def nth(values: np.ndarray, n: int) -> float:
    """The n-th largest; nothing is below it if there are fewer."""
    return np.partition(values, len(values) - n)[len(values) - n] if len(values) >= n else -np.inf


class Best:
    """The best rows so far of each key, by score and then id."""

    def __init__(self, keys: int, n: int):
        self.n, self.scores, self.ids = n, [np.zeros(0, np.int64)] * keys, [np.zeros(0, np.int64)] * keys

    def add(self, key: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.scores[key], scores]), np.concatenate([self.ids[key], ids])
        if len(s) > self.n:  # ids decide among equals, so all of those stay until they are sorted
            near = s >= nth(s, self.n)
            s, i = s[near], i[near]
        order = np.lexsort((i, -s))[: self.n]
        self.scores[key], self.ids[key] = s[order], i[order]


def batches_of(batches, dims: int, scale: int):
    """(ids, labels, integers) of rows that take part, ROWS at most at a time."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            part = b.slice(at, ROWS)
            whole, good = integers(pa.concat_arrays([part.column(2)]), dims, scale)
            yield part.column(0).to_numpy()[good], part.column(1).to_numpy()[good], whole[good]


def nearest(block, batches, scale: int, n: int):
    """Of a task's rows the best n of the same label for each anchor."""
    best = Best(len(block.ids), n)
    for ids, labels, rows in batches_of(batches, block.vectors.shape[1], scale):
        for at in range(0, len(block.ids), ANCHORS):
            some = slice(at, at + ANCHORS)
            alive = (block.labels[some, None] == labels) & (block.ids[some, None] != ids)

            def cut(i, low, high, at=at):
                return high >= nth(np.concatenate([low, best.scores[at + i]]), n)

            for i, hit, scores in sliced_scores(block.vectors[some], block.more[some], block.less[some], rows, alive, cut):
                best.add(at + i, scores, ids[hit])
    count = np.array([len(x) for x in best.ids], int)
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(count)), count), pa.int64()), pa.array(np.concatenate([*best.ids, []]), pa.int64()), pa.array(np.concatenate([*best.scores, np.zeros(0, np.int64)]), pa.int64())], names=["anchor", "id", "score"])


def window(score: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of a negative, for positives of these scores."""
    return -(-least * score // 100), most * score // 100


def within(block, positives, batches, scale: int, n: int, least: int, most: int):
    """Of a task's rows the best n of other labels in the window of each anchor's positives (anchor, id, score, sorted by anchor)."""
    owner, pos_ids, pos_scores = positives
    first = np.searchsorted(owner, np.arange(len(block.ids) + 1))
    lo, hi = window(pos_scores, least, most)
    best = Best(len(owner), n)
    wanted = np.diff(first) > 0
    for ids, labels, rows in batches_of(batches, block.vectors.shape[1], scale):
        for at in range(0, len(block.ids), ANCHORS):
            some = slice(at, at + ANCHORS)
            alive = (block.labels[some, None] != labels) & (block.ids[some, None] != ids) & wanted[some, None]

            def cut(i, low, high, at=at):
                stay = np.zeros(len(low), bool)
                for p in range(first[at + i], first[at + i + 1]):
                    sure = low[(low >= lo[p]) & (high <= hi[p])]
                    stay |= (high >= lo[p]) & (low <= hi[p]) & (high >= nth(np.concatenate([sure, best.scores[p]]), n))
                return stay

            for i, hit, scores in sliced_scores(block.vectors[some], block.more[some], block.less[some], rows, alive, cut):
                for p in range(first[at + i], first[at + i + 1]):
                    fits = (scores >= lo[p]) & (scores <= hi[p])
                    best.add(p, scores[fits], ids[hit[fits]])
    p = np.repeat(np.arange(len(owner)), [len(x) for x in best.ids])
    columns = [block.ids[owner[p]], p, pos_ids[p], np.concatenate([*best.ids, np.zeros(0, np.int64)]), pos_scores[p], np.concatenate([*best.scores, np.zeros(0, np.int64)])]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["anchor_id", "p", "positive_id", "negative_id", "positive_score", "negative_score"])


def anchor_blocks(vectors: DataFrame, is_anchor: Column, scale: int, block_bytes: int):
    """The anchors, block by block."""
    usable = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | ~(F.abs(F.floor(x.cast("double") * scale)) < TOO_LARGE))
    chosen = vectors.where(is_anchor).where(usable).groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("row"))
    count, dims = chosen.agg(F.count("*"), F.coalesce(F.max(F.size("row.embedding")), F.lit(0))).first()
    blocks = -(-count * max(dims, 1) * 8 // block_bytes)
    for i in range(blocks):
        got = chosen.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).select("vec_id", "row.label", "row.embedding").toArrow().combine_chunks()
        if got.num_rows:
            whole, _ = integers(pa.concat_arrays(got.column(2).chunks), dims, scale)
            yield Anchors(got.column(0).to_numpy(), got.column(1).to_numpy(), whole)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST_PERCENT, most: int = MOST_PERCENT, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """For each anchor and each of its first positives the first negatives in its window; vectors: vec_id, label, embedding."""
    spark = vectors.sparkSession
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    parts = []
    for block in anchor_blocks(v, is_anchor, scale, block_bytes):
        sent = spark.sparkContext.broadcast(block)
        near = v.mapInArrow(lambda batches, sent=sent: nearest(sent.value, batches, scale, positives), "anchor long, id long, score long")
        w = Window.partitionBy("anchor").orderBy(F.col("score").desc(), "id")
        first = near.withColumn("i", F.row_number().over(w)).where(F.col("i") <= positives).orderBy("anchor", "i").toArrow()  # as many rows an anchor at most
        found = tuple(first.column(c).to_numpy() for c in ("anchor", "id", "score"))
        known = spark.sparkContext.broadcast(found)
        some = v.mapInArrow(lambda batches, sent=sent, known=known: within(sent.value, known.value, batches, scale, negatives, least, most), "anchor_id long, p long, positive_id long, negative_id long, positive_score long, negative_score long")
        w = Window.partitionBy("anchor_id", "p").orderBy(F.col("negative_score").desc(), "negative_id")
        parts.append(some.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    return functools.reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], SCHEMA)


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(v.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


ORACLE = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
      FROM (SELECT * FROM v WHERE vec_id % 100 = 0) a JOIN v b ON b.vec_id <> a.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS i FROM s WHERE same) WHERE i <= {POSITIVES}),
n AS (SELECT p.*, id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank
      FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LEAST_PERCENT} * positive_score <= 100 * score AND 100 * score <= {MOST_PERCENT} * positive_score)
SELECT * FROM n WHERE rank <= {NEGATIVES}
"""
