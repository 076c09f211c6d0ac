"""Quality rules: a threshold table compiled into one projection of built-in functions.

Every rule compares ``scale * numerator`` with ``bound * denominator`` in whole numbers, so
a verdict never depends on floating point. The table is data; ``compile_rules`` turns it
into one boolean column and ``rules_sql`` into the same condition for another engine.

Defined results: a null or blank text has no words, fails the base rule and is not kept;
repeated rows and repeated ids are judged row by row; very long texts are measured whole; a bound
that is met exactly holds; columns of the input named like an output column are replaced in the
report and kept by ``kept_documents``; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import let, text_of, whole_row, words_of

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in is it that for on with as are was be by at this from or an "
    "der die das und zu im ist ein den mit von für auf nicht eine sich dem des auch "
    "le la les de des un une et est en que pour dans qui sur pas au avec "
    "el los las una por con para se del y es lo como más"
).split()

#: name, numerator, "max" or "min", bound, denominator, scale: scale * numerator <= or >= bound * denominator.
THRESHOLDS = (
    ("mean word length at most 20", "word_chars", "max", 20, "n_words", 1),
    ("mean word length at least 2", "word_chars", "min", 2, "n_words", 1),
    ("symbols at most 5 % of word characters", "n_symbols", "max", 5, "word_chars", 100),
    ("stop words at least 2 % of words", "n_stop_words", "min", 2, "n_words", 100),
    ("repeated lines at most 50 % of lines", "n_dup_lines", "max", 50, "n_lines", 100),
)
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def repeat_words(words: Column, width: int = 3) -> Column:
    """How many words lie in a window of ``width`` words that the text has at least twice.

    Windows are compared as whole strings. Texts whose windows are all different skip the sort.
    """

    def counted(grams: Column) -> Column:
        pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("p"))))

        def covered(s: Column) -> Column:
            twice = F.filter(s, lambda x, j: (F.get(s, j - 1)["g"] == x["g"]) | (F.get(s, j + 1)["g"] == x["g"]))
            starts = F.sort_array(F.transform(twice, lambda x: x["p"]))
            return F.aggregate(
                starts,
                F.struct(F.lit(0).alias("n"), F.lit(-width).alias("q")),
                lambda a, p: F.struct((a["n"] + F.least(F.lit(width), p - a["q"])).alias("n"), p.alias("q")),
                lambda a: a["n"],
            )

        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(let(pairs, covered))

    def grams(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - width)
        return F.transform(at, lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(width)]))

    return let(words, lambda w: F.when(F.size(w) < width, F.lit(0)).otherwise(let(grams(w), counted)))


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id and the counts that the rules compare."""
    text = text_of(text_col)
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    base = docs.select("doc_id", text.alias("_t"), words_of(text).alias("_w"), lines.alias("_l"))
    return base.select(
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_w")).cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        F.size(F.filter("_w", lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
    )


def compile_rules(thresholds=THRESHOLDS) -> Column:
    """One boolean column: every rule of the table holds."""

    def holds(rule) -> Column:
        _, num, side, bound, den, scale = rule
        a, b = F.col(num) * scale, F.col(den) * bound
        return a <= b if side == "max" else a >= b

    return reduce(lambda x, y: x & y, map(holds, thresholds), F.lit(True))


def rules_sql(thresholds=THRESHOLDS) -> str:
    return " AND ".join(f"{s} * {n} {'<=' if side == 'max' else '>='} {b} * {d}" for _, n, side, b, d, s in thresholds)


def quality_rules(docs: DataFrame, thresholds=THRESHOLDS, text_col: str = "text") -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return measures(docs, text_col).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compile_rules(thresholds))


def kept_documents(docs: DataFrame, thresholds=THRESHOLDS, text_col: str = "text") -> DataFrame:
    """The rows that pass, all columns kept: the rules run on each row in place, without a join."""
    judged = quality_rules(docs.select(F.col(text_col).alias("text"), whole_row(docs).alias("doc_id")), thresholds)
    return judged.where("kept").select("doc_id.*")


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    return quality_rules(table(spark, sf_dir, "documents"))


_IN = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
      FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
hit AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM hit, (VALUES (0), (1), (2)) AS v(k) GROUP BY r),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words,
             coalesce(length(array_to_string(ws, '')), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
             len(list_filter(ws, lambda x: lower(x) IN ({_IN})))::BIGINT AS n_stop_words
      FROM w LEFT JOIN cov USING (r)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND {rules_sql()} AS kept FROM b
"""
