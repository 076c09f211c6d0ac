"""Document fingerprints: a homomorphic multiset hash of paragraphs, with built-in functions only.

A paragraph (a line, or a sentence of one) is hashed to a wide vector: ``WIDE`` lanes of 32 random
bits, and 64 counters, each two lanes of one random bit 32 bits apart. A document's vector is the
sum over its paragraphs, plus their number. The sums of the wide lanes modulo 2**32 and the number
are the fingerprint: sums commute, so the order of paragraphs doesn't matter, and inserting or
deleting paragraphs adds or subtracts their vectors. Paragraphs are exploded and summed by ordinary
aggregates, so vectors of very long texts are combined like any others, within 2**31 paragraphs.

An edited text's vector is not hashed anew: the paragraphs from the cut on are deleted from the
document's own sum and those that the edit brings are inserted; what lies before the cut is hashed
once for both.

One-bit lanes are fair coins, hence ``2 * sum - n`` are random projections and their inner product
estimates how many paragraphs two documents share; ``likeness`` is that product over the larger
squared length, cut to 0..1, and exactly 1 for equal fingerprints. Of 128 lanes its error is some 0.09.

Defined results: a null text counts as empty (no paragraphs, all lanes 0); rows that repeat an id
are answered row by row; the next document of an id is the next smaller distinct id of any type
that can be ordered (null last) and, if several rows have it, the one with the smallest text; after
the last comes the first, and a single document follows itself. Other columns are ignored, whatever
their names. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import if_small, materialize, table, text_of

PARAGRAPHS = r"\n+|(?<=[.!?])[\x20\t\r]+"
#: What ends the last whole paragraph of a text's beginning; the rest of it is cut from there on.
LAST_END = r"(?s)^.*(?:\n|[.!?][\x20\t\r]+)"
WIDE, COUNTERS = 8, 64
LANES = tuple(f"w{i}" for i in range(WIDE)) + tuple(f"b{i}" for i in range(COUNTERS))
_HALF, _PAIR = (1 << 32) - 1, (1 << 32) + 1


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, PARAGRAPHS, -1), lambda p: p != "")


def lanes_of(digest: Column) -> list[Column]:
    """The vector of one paragraph by its digest, in the order of LANES."""
    wide = [F.xxhash64(F.lit(i), digest) for i in range(WIDE // 2)]
    bits = [F.xxhash64(F.lit(100 + i), digest) for i in range(COUNTERS // 32)]
    low = [h.bitwiseAND(F.lit(_HALF)) for h in wide] + [F.shiftrightunsigned(h, 32) for h in wide]
    return low + [F.shiftrightunsigned(h, j).bitwiseAND(F.lit(_PAIR)) for h in bits for j in range(32)]


#: What a paragraph of a row is: before the cut, deleted or inserted by the edit; MARK counts the row itself.
WHOLE, GONE, COME, MARK = 0, 1, 2, 3


def vectors(rows: DataFrame, key: list[str]) -> DataFrame:
    """key, copies, and the vectors a (of the text) and b (of the edited text), each n and LANES, a row for each distinct key.

    rows: key and the texts whole, gone and come. Own paragraphs are whole and gone ones; the edit
    deletes these and inserts those that come. Rows that repeat a key are equal, so their sum is
    that of one, times their number.
    """
    part = lambda c, k: F.transform(paragraphs(F.col(c)), lambda p: F.struct(F.sha2(p, 256).alias("d"), F.lit(k).alias("part")))
    mark = F.array(F.struct(F.lit(None).cast("string").alias("d"), F.lit(MARK).alias("part")))
    each = rows.select(*key, F.explode(F.concat(mark, part("whole", WHOLE), part("gone", GONE), part("come", COME))).alias("x")).select(*key, F.col("x.d").alias("d"), F.col("x.part").alias("part"))
    each = each.select(*key, "part", *[lane.alias(n) for n, lane in zip(LANES, lanes_of(F.col("d")), strict=True)])
    sums = each.groupBy(*key, "part").agg(F.count("*").alias("n"), *[F.sum(n).alias(n) for n in LANES])
    pick = lambda n, *parts: F.coalesce(F.sum(F.when(F.col("part").isin(*parts), F.col(n))), F.lit(0))
    both = sums.groupBy(*key).agg(pick("n", MARK).alias("copies"), *[pick(n, WHOLE, GONE).alias(f"a_{n}") for n in ("n", *LANES)], *[pick(n, WHOLE, COME).alias(f"b_{n}") for n in ("n", *LANES)])
    vector = lambda v: F.struct(*[F.expr(f"{v}_{n} div copies").alias(n) for n in ("n", *LANES)]).alias(v)
    return both.select(*key, "copies", vector("a"), vector("b"))


def lane_sums(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, digest, copies and the vector a of each distinct pair of id and text."""
    t = text_of(text_col)
    rows = texts.select("doc_id", F.sha2(t, 256).alias("digest"), t.alias("whole"), F.lit("").alias("gone"), F.lit("").alias("come"))
    return vectors(rows, ["doc_id", "digest"]).drop("b")


def add_vectors(a: str, b: str, sign: int = 1) -> Column:
    """The vector of the union of two multisets, or of their difference, from vectors in columns a and b."""
    return F.struct(*[(F.col(f"{a}.{n}") + sign * F.col(f"{b}.{n}")).alias(n) for n in ("n", *LANES)])


def as_text(side: str) -> Column:
    """The fingerprint: the number of paragraphs and the wide lanes modulo 2**32."""
    lanes = [F.lpad(F.hex(F.col(f"{side}.{n}").bitwiseAND(F.lit(_HALF))), 8, "0") for n in LANES[:WIDE]]
    return F.lower(F.concat(F.hex(F.col(f"{side}.n")), F.lit("-"), *lanes))


def _lanes(side: str) -> list[Column]:
    """The one-bit lanes of a vector: low and high halves of its counters."""
    return [x.cast("double") for n in LANES[WIDE:] for x in (F.col(f"{side}.{n}").bitwiseAND(F.lit(_HALF)), F.shiftrightunsigned(F.col(f"{side}.{n}"), 32))]


def _dot(xy: Column, a: str, b: str) -> Column:
    """The inner product of the signed lanes 2 * x - n, from that of the lanes themselves and their sums."""
    n, m = F.col(f"{a}.n").cast("double"), F.col(f"{b}.n").cast("double")
    return 4 * xy - 2 * m * F.col(f"{a}.sum") - 2 * n * F.col(f"{b}.sum") + 2 * COUNTERS * n * m


def _products(a: str, b: str) -> Column:
    return reduce(add, [x * y for x, y in zip(_lanes(a), _lanes(b), strict=True)])


def measured(rows: DataFrame, v: str) -> DataFrame:
    """Adds to the vector v the sum of its one-bit lanes and the squared length of its signed lanes, once for all comparisons."""
    rows = rows.withColumn(v, F.col(v).withField("sum", reduce(add, _lanes(v))))
    return rows.withColumn(v, F.col(v).withField("length", _dot(_products(v, v), v, v)))


def likeness(a: str, b: str) -> Column:
    """Estimated share of common paragraphs, of the larger document, of measured vectors in columns a and b; callers set 1 for equal fingerprints."""
    most = F.greatest(F.col(f"{a}.length"), F.col(f"{b}.length"))
    return F.when(most > 0, F.greatest(F.least(_dot(_products(a, b), a, b) / most, F.lit(1.0)), F.lit(0.0))).otherwise(0.0)


def same_text(a: str, b: str) -> Column:
    return as_text(a) == as_text(b)


def next_ids(docs: DataFrame, rows_per_range: int = 50_000) -> DataFrame:
    """doc_id, next_id: successor of each distinct id in descending order, the last followed by the first.

    Ids are dealt by ranges; a window orders each range and the ends of the ranges are linked among
    themselves, a row each, so no task sees more than a range or the ends.
    """
    ids = docs.select("doc_id").distinct()
    down = F.col("doc_id").desc_nulls_last()
    ranges = max(1, ids.count() // rows_per_range)
    cut = materialize(ids.repartitionByRange(ranges, down).select("doc_id", F.spark_partition_id().alias("rng")))
    within = Window.partitionBy("rng").orderBy(down)
    linked = cut.select("doc_id", "rng", F.lead(F.struct("doc_id")).over(within).alias("next"))
    first = cut.withColumn("i", F.row_number().over(within)).where("i = 1").select("rng", F.struct("doc_id").alias("head"))
    over = Window.orderBy("rng")  # a row per range
    after = F.coalesce(F.lead("head").over(over), F.first("head").over(over))
    return linked.join(F.broadcast(first.select("rng", after.alias("after"))), "rng").select("doc_id", F.coalesce("next", "after")["doc_id"].alias("next_id"))


def edited(rows: DataFrame) -> DataFrame:
    """Adds e, the edited text of t by head, whole (its whole paragraphs before the cut), and what the edit deletes (gone) and inserts (come) after them."""
    keep = F.length("t") - F.floor(F.length("t") / 2)
    rows = rows.withColumn("start", F.substring(F.col("t"), F.lit(1), keep.cast("int"))).withColumn("new", F.substring(F.col("head"), F.lit(1), (F.length("t") - keep).cast("int")))
    rows = rows.withColumn("whole", F.regexp_extract("start", LAST_END, 0))
    whole = F.col("whole")
    rest = F.substring(F.col("t"), F.length(whole) + 1, F.length("t"))
    # blanks that go on where the whole part ends in a sentence's blanks end no paragraph of their own
    clean = lambda x: F.when(whole.rlike(r"[.!?][\x20\t\r]+\z"), F.regexp_replace(x, r"^[\x20\t\r]+", "")).otherwise(x)
    come = F.concat(F.substring(F.col("start"), F.length(whole) + 1, F.length("start")), F.col("new"))
    return rows.select("*", F.concat("start", "new").alias("e"), clean(rest).alias("gone"), clean(come).alias("come"))


def id_key(col: str = "doc_id") -> Column:
    """The id as text that is never null, so joins by it keep their partitioning."""
    return F.coalesce(F.concat(F.lit("="), F.col(col).cast("string")), F.lit(""))


def edited_fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Each text, its edit by the next document's beginning, and how alike their fingerprints are.

    Texts are shuffled once by their own id; of the next document only the characters that the
    edit takes travel. Each text's paragraphs are hashed once, where text and edit are at hand; the
    vectors are written, and the next document's is joined from there.
    """
    base = docs.select("doc_id", id_key().alias("k"), text_of(text_col).alias("t"))
    links = next_ids(base).select(id_key().alias("k"), id_key("next_id").alias("next_k"))
    need = base.groupBy("k").agg(F.max(F.floor(F.length("t") / 2)).cast("int").alias("need"))
    asked = materialize(links.join(need, "k").select(F.col("k").alias("asker"), F.col("next_k").alias("k"), "need"))
    # the id is carried along so that both joins read the same columns of one shuffle of the texts
    found = base.join(asked, "k").select("asker", "k", F.expr("substring(t, 1, need)").alias("head"), "t", F.col("doc_id").alias("next_id"))
    many = materialize(base.groupBy("k").agg(F.count("*").alias("rows")).where("rows > 1").select("k"))
    if many.isEmpty():
        nexts = found.select("asker", "head", F.sha2("t", 256).alias("next_digest"), "next_id")
    else:  # the smallest text of an id of several rows; combined before the shuffle
        one = found.join(if_small(many), "k", "left_anti").select("asker", "head", F.sha2("t", 256).alias("next_digest"), "next_id")
        least = found.join(if_small(many), "k", "left_semi").groupBy("asker").agg(F.min(F.struct("t", "head", "next_id")).alias("x"))
        nexts = one.unionByName(least.select("asker", F.col("x.head").alias("head"), F.sha2(F.col("x.t"), 256).alias("next_digest"), F.col("x.next_id").alias("next_id")))
    both = edited(base.join(nexts.withColumnRenamed("asker", "k"), "k"))
    key = ["k", "doc_id", "n_chars", "digest", "edited_sha256", "next_digest", "next_id"]
    all_vectors = vectors(both.select("k", "doc_id", F.length("t").cast("long").alias("n_chars"), F.sha2("t", 256).alias("digest"), F.sha2("e", 256).alias("edited_sha256"), "next_digest", "next_id", "whole", "gone", "come"), key)
    all_vectors = measured(measured(all_vectors, "a"), "b")
    kept = ("n", "sum", "length", *LANES[WIDE:])
    counters = F.struct(*[F.col(f"a.{n}") for n in kept]).alias("a")
    near = F.when(same_text("a", "b"), 1.0).otherwise(likeness("a", "b"))
    own = materialize(all_vectors.select("k", "doc_id", "next_id", "n_chars", "digest", "edited_sha256", "next_digest", "copies", as_text("a").alias("fingerprint"), as_text("b").alias("edited_fingerprint"), near.alias("near_edited"), counters))
    z = own.select(F.col("k").alias("next_k"), F.col("digest").alias("next_digest"), F.struct("fingerprint", "a.*").alias("z"))
    out = own.withColumn("next_k", id_key("next_id")).join(z, ["next_k", "next_digest"])  # one row each, no digest of many copies is a key alone
    near_next = F.when(F.col("fingerprint") == F.col("z.fingerprint"), 1.0).otherwise(likeness("a", "z"))
    each = out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", near_next.alias("near_next"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("i"))
    return each.drop("i")


def op7_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
