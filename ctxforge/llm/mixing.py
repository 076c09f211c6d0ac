"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Targets: sources by code point (null last) weigh by a repeating pattern and share a budget;
a target stops at twice its source's size and the excess is shared again by weight. That
fixpoint is ``min(cap, level * weight)``, and the level follows from one pass over the
sources sorted by ``cap / weight``.

Schedule: a source needs as many slots as its target has blocks. Cumulative slot counts cut
[0, 2**m) into intervals; the i-th slot of the schedule belongs to the source whose interval
holds the i-th van der Corput point (i with its m bits reversed). The first 2**m points hit
every integer once, so each source gets exactly its slots, evenly spread. The position of a
source's r-th slot is found in closed form, bit by bit (``slot_position``), so no table of
slots exists: every document finds its own places.

Blocks: documents of a source, in hashed order, form one stream of words that is cut into
blocks of ``block_words``; rank r takes block r, in a second epoch from the first block on.
The last slot of a source is cut so that the source's words equal its rounded target. A
document's place in the mix is the position of the slot that takes its first word.

Defined results: a null or blank text has size 0, takes 0 and has no position; a source of
size 0 has target 0; rows that repeat an id are mixed as rows of their own (of equal rows it
doesn't matter which is which); equal weights and sizes are ordered by the source's name; very
long texts span blocks, nothing is cut but at a source's target; an empty table gives no rows;
columns other than doc_id, text, source and n_chars may have any names and types.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import if_small, materialize, table, text_of, whole_row, word_count

WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2
#: Words of a block; documents of a bucket on average; buckets of a group (as a power of two).
BLOCK_WORDS, BUCKET_DOCS, GROUP_BITS = 1024, 256, 12


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """skey, source, source_size, target: one row per source. Windows here run over sources, not documents."""
    by = sized.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by = by.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1))
    by = by.withColumn("cap", cap * F.col("source_size").cast("double")).withColumn("total", share * F.sum("source_size").over(everything))
    up = Window.orderBy(F.col("cap") / F.col("w"), "skey")
    before = F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(up.rowsBetween(0, Window.unboundedFollowing))
    by = by.withColumn("i", F.row_number().over(up)).withColumn("level", (F.col("total") - before) / rest)
    first = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("i", "level"))).over(everything)
    by = by.withColumn("level", first["level"])
    return by.select("skey", "source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("w"))).alias("target"))


def plan_slots(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Adds to each source: goal words, blocks, slots, where its interval starts, and the schedule's bits."""
    b = block_words
    up = lambda c: F.floor((c + (b - 1)) / b)
    goal = F.least(F.round("target").cast("long"), CAP * F.col("source_size"))
    out = targets.withColumn("goal", goal).withColumn("blocks", up(F.col("source_size")))
    out = out.withColumn("slots", F.when(F.col("goal") <= F.col("source_size"), up(F.col("goal"))).otherwise(F.col("blocks") + up(F.col("goal") - F.col("source_size"))))
    order = Window.orderBy("skey")
    out = out.withColumn("start", F.coalesce(F.sum("slots").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    total = F.sum("slots").over(Window.partitionBy())
    return out.withColumn("bits", F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(total, F.lit(2)).cast("double"))).cast("int")))


def slot_position(rank: Column, start: Column, slots: Column, bits: Column) -> Column:
    """Position in the schedule of the rank-th slot (from 0) of the interval [start, start + slots).

    Position bits are the point's bits from the lowest up: at each bit the points of the
    interval that agree so far and continue with 0 come first; their number is a difference of quotients.
    """
    of = F.struct(rank.cast("long").alias("r"), F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("p"), start.alias("lo"), (start + slots).alias("hi"), bits.alias("m"))

    def step(s: Column, j: Column) -> Column:
        below = lambda x: F.call_function("shiftright", x - 1 - s["c"], j + 1)
        bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)
        zeros = below(s["hi"]) - below(s["lo"])
        one = s["r"] >= zeros
        return F.struct(
            F.when(one, s["r"] - zeros).otherwise(s["r"]).alias("r"), F.when(one, s["c"] + bit(j)).otherwise(s["c"]).alias("c"),
            F.when(one, s["p"] + bit(s["m"] - 1 - j)).otherwise(s["p"]).alias("p"), s["lo"].alias("lo"), s["hi"].alias("hi"), s["m"].alias("m"),
        )

    return F.aggregate(F.sequence(F.lit(0), bits - 1), of, step, lambda s: s["p"])


def source_key() -> Column:
    """A source's key, null included."""
    return F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source").cast("string")))


def bucketed(rows: DataFrame, n: int) -> DataFrame:
    """Adds a bucket by the hash h: buckets are cut by the number of all rows, so a hot source spreads over its share of them."""
    bits = max(0, (max(n, 1) // BUCKET_DOCS).bit_length())
    return rows.withColumn("bucket", F.call_function("shiftrightunsigned", F.col("h"), F.lit(64 - bits)) if bits else F.lit(0).cast("long"))


def bucket_starts(rows: DataFrame, words: Column) -> DataFrame:
    """skey, bucket, before: words of a source's stream before a bucket; sums in groups of buckets, then over the groups."""
    sums = rows.groupBy("skey", "bucket").agg(F.sum(words).alias("s")).withColumn("grp", F.call_function("shiftright", F.col("bucket"), F.lit(GROUP_BITS)))
    sums = materialize(sums)
    upto = lambda by, order: F.coalesce(F.sum("s").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = sums.groupBy("skey", "grp").agg(F.sum("s").alias("s"))
    groups = groups.select("skey", "grp", upto(["skey"], "grp").alias("g"))
    inside = sums.select("skey", "grp", "bucket", upto(["skey", "grp"], "bucket").alias("b"))
    return inside.join(groups, ["skey", "grp"]).select("skey", "bucket", (F.col("b") + F.col("g")).cast("long").alias("before"))


def stream_offsets(rows: DataFrame, words: Column) -> DataFrame:
    """Adds the offset at which a row starts in its source's stream: what lies before its bucket, then within the bucket by hash."""
    inner = Window.partitionBy("skey", "bucket").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    starts = bucket_starts(rows, words)
    return rows.withColumn("inner", F.coalesce(F.sum(words).over(inner), F.lit(0))).join(starts, ["skey", "bucket"]).withColumn("offset", (F.col("before") + F.col("inner")).cast("long")).drop("before", "inner", "bucket")


def taken_parts(block_words: int = BLOCK_WORDS) -> Column:
    """array<epoch, words, position>: what each epoch takes of a row with offset and size, of a source with its plan."""
    first = F.least("goal", "source_size")
    block = F.floor(F.col("offset") / block_words)

    def part(epoch: int, end: Column, rank: Column) -> Column:
        words = F.least(F.greatest(end - F.col("offset"), F.lit(0).cast("long")), F.col("size")).cast("long")
        return F.when(words > 0, F.struct(F.lit(epoch).alias("epoch"), words.alias("words"), slot_position(rank, F.col("start"), F.col("slots"), F.col("bits")).alias("position")))

    return F.array_compact(F.array(part(0, first, block), part(1, F.col("goal") - first, F.col("blocks") + block)))


def sized_rows(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, source, skey and size in words."""
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), source_key().alias("skey"), word_count(text_of(text_col)).alias("size"))


def planned(sized: DataFrame, block_words: int) -> DataFrame:
    """The plan, a row per source: written, and broadcast only if its sources are counted to be few."""
    return if_small(materialize(plan_slots(source_targets(sized), block_words).select("skey", "source_size", "target", "goal", "blocks", "slots", "start", "bits")))


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, text_col: str = "text", seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, position, position_again: the places of both epochs, null where none is taken.

    Rows that repeat id, source and size are one entry with copies until the end, so they needn't meet in a task.
    """
    sized = sized_rows(docs, text_col)
    entries = materialize(sized.groupBy("doc_id", "source", "skey", "size").agg(F.count("*").alias("copies")))
    rows = entries.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size"))
    rows = stream_offsets(bucketed(rows, entries.count()), F.col("size") * F.col("copies"))
    each = rows.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("offset", F.col("offset") + F.col("k") * F.col("size"))
    weighed = materialize(entries.groupBy("skey", "source").agg(F.sum(F.col("size") * F.col("copies")).alias("size")))
    out = each.join(planned(weighed, block_words), "skey").withColumn("parts", taken_parts(block_words))
    at = lambda e: F.get(F.filter("parts", lambda p: p["epoch"] == e), F.lit(0))["position"]
    taken = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["words"])
    return out.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source", at(0).alias("position"), at(1).alias("position_again"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, separators kept."""
    lead = F.regexp_extract(text, r"^[\x20\x09-\x0D]*", 0)
    body = F.regexp_replace(text, r"^[\x20\x09-\x0D]+", "")
    parts = F.split(body, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    return F.concat(lead, F.array_join(F.slice(parts, 1, n.cast("int")), ""))


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 7) -> DataFrame:
    """The mix as documents in its order, all columns kept: a row per document and epoch, cut where the source's last slot ends.

    A stream is taken from its start, so per source and epoch one document at most is cut: it keeps
    its first words, n_chars follows. Rows are written in ranges of the schedule's positions. A row
    travels as one struct, so its columns may have any names; rows are hashed by all they hold.
    """
    rest = [c for c in docs.columns if c not in ("text", "doc_id")]
    named = F.to_json(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in rest])) if rest else F.lit("")
    rows = docs.select(whole_row(docs).alias("row"), source_key().alias("skey"), word_count(text_of()).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text", named).alias("h"))
    rows = bucketed(rows, docs.count())
    weighed = materialize(rows.groupBy("skey").agg(F.sum("size").alias("size"), F.first("row.source").cast("string").alias("source")))
    parts = stream_offsets(rows.where("size > 0"), F.col("size")).join(planned(weighed, block_words), "skey").select("row", "size", "offset", F.explode(taken_parts(block_words)).alias("part"))
    spread = parts.repartitionByRange("part.position", "offset").sortWithinPartitions("part.position", "offset")
    cut = F.col("part.words") < F.col("size")
    text = F.when(cut, first_words(F.col("row.text"), F.col("part.words"))).otherwise(F.col("row.text"))
    out = spread.select("row", text.alias("text"))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
