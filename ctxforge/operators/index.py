"""The keyword index: build, compare with what is stored, apply, report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..sources.scratch import written


def kept(scanned: DataFrame) -> DataFrame:
    return scanned.where("pruned_folder IS NULL AND skip_reason IS NULL")


def base_terms(scanned: DataFrame) -> DataFrame:
    """root, path, term: distinct per file, so a term counts once. Terms are made distinct in the row, before any shuffle."""
    return kept(scanned).select("root", "path", F.explode(T.tokenize(F.concat_ws(" ", "path", "kind", "sample"))).alias("term"))


def build_keywords(scanned: DataFrame, terms_of_symbols: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """root, path, term, count, from_symbol; symbol terms only where the file has no such base term. With ``asked`` (root, term: few) rows of these alone."""
    base = base_terms(scanned)
    if asked is not None:
        base, terms_of_symbols = (x.join(asked, ["root", "term"], "left_semi").select("root", "path", "term") for x in (base, terms_of_symbols))
    extra = terms_of_symbols.join(base, ["root", "path", "term"], "left_anti")
    return base.withColumn("from_symbol", F.lit(0)).unionByName(extra.withColumn("from_symbol", F.lit(1))).withColumn("count", F.lit(1))


def root_stats(summary: DataFrame) -> DataFrame:
    return summary.groupBy("root").agg(F.count("*").alias("files"), F.coalesce(F.sum("token_estimate"), F.lit(0)).cast("long").alias("tokens"))


def sync_diff(current: DataFrame, stored: DataFrame) -> DataFrame:
    """root, path, action: unchanged, touched, upsert, read_error or delete.

    current: root, path, size_bytes, mtime, hash, readable; stored: root, path, size_bytes, mtime, hash.
    """
    c, s = current.alias("c"), stored.alias("s")
    both = c.join(s, (F.col("c.root") == F.col("s.root")) & (F.col("c.path") == F.col("s.path")), "full_outer")
    same_size = F.col("c.size_bytes") == F.col("s.size_bytes")
    action = (
        F.when(F.col("c.path").isNull(), "delete").when(~F.col("c.readable"), "read_error").when(F.col("s.path").isNull(), "upsert")
        .when(same_size & (F.col("c.mtime") == F.col("s.mtime")), "unchanged").when(same_size & (F.col("c.hash") == F.col("s.hash")), "touched").otherwise("upsert")
    )
    return both.select(F.coalesce("c.root", "s.root").alias("root"), F.coalesce("c.path", "s.path").alias("path"), action.alias("action"), F.col("c.mtime").alias("mtime"))


def apply_sync(stored: DataFrame, current: DataFrame, diff: DataFrame) -> DataFrame:
    """The next snapshot: stored rows that stay (with a touched file's new time), and upserted rows."""
    cols = stored.columns
    stay = stored.join(diff.where("action <> 'upsert' AND action <> 'delete'").select("root", "path", "action", F.col("mtime").alias("new_mtime")), ["root", "path"])
    stay = stay.withColumn("mtime", F.when(F.col("action") == "touched", F.col("new_mtime")).otherwise(F.col("mtime"))).select(*cols)
    return stay.unionByName(current.join(diff.where("action = 'upsert'").select("root", "path"), ["root", "path"], "left_semi").select(*cols))


def sync_stats(diff: DataFrame, tokens: DataFrame) -> DataFrame:
    n = lambda *a: F.count_if(F.col("action").isin(*a))
    out = diff.groupBy("root").agg(n("unchanged", "touched", "upsert", "read_error").alias("indexed"), n("upsert").alias("updated"), n("unchanged", "touched").alias("unchanged"), n("delete").alias("deleted"), n("read_error").alias("read_errors"))
    return out.join(tokens, "root", "left").withColumn("changed", (F.col("updated") > 0) | (F.col("deleted") > 0))


def change_events(diff: DataFrame) -> DataFrame:
    return diff.where("action IN ('upsert', 'delete')").select("root", "path", F.col("action").alias("change_type"))


def recent_changes(events: DataFrame, limit: int = 10) -> DataFrame:
    """The latest changes of each root, newest first; later insertions first among equals (changed_at, seq)."""
    w = Window.partitionBy("root").orderBy(F.col("changed_at").desc(), F.col("seq").desc())
    return events.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


#: Files whose entries one row of a posting holds, about.
POSTING_FILES = 2000


def postings(terms: DataFrame, files: DataFrame, per_row: int = POSTING_FILES) -> DataFrame:
    """root, term, part, entries: the files (and other columns) of each term by path, in rows of ``per_row`` files of a root, about.

    Files are dealt over a root's parts by a hash of their paths, so a term that all files have is as many rows as the root has parts,
    made by as many tasks, and none is longer than a part has files.
    """
    parts = files.groupBy(F.col("root").alias("of")).agg(F.ceil(F.count("*") / per_row).cast("int").alias("parts"))
    entry = [c for c in terms.columns if c not in ("root", "term")]
    dealt = terms.join(parts, F.col("root").eqNullSafe(F.col("of"))).withColumn("part", F.pmod(F.xxhash64("path"), F.col("parts")).cast("int"))
    return dealt.groupBy("root", "term", "part").agg(F.array_sort(F.collect_list(F.struct("path", *[c for c in entry if c != "path"]))).alias("entries"))


#: Entries of a posting's files that a task holds while it groups them.
MOST_ENTRIES = 1_000_000


def postings_in_place(files: DataFrame, flags: bool) -> DataFrame:
    """The same rows as ``postings`` without a shuffle, from files that lie together by root and part: root, part, path, terms, extra (arrays).

    A task groups the terms of each run of files of one part; a part that reaches into another task becomes two rows of a term.
    flags: entries have from_symbol (0 for terms, 1 for extra) and count 1.
    """
    entry = "struct<path:string,from_symbol:int,count:int>" if flags else "struct<path:string>"

    def grouped(held):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        rows = pa.Table.from_batches(held)
        path = rows.column("path").combine_chunks()
        rank = np.empty(len(path), np.int64)
        rank[pc.sort_indices(path).to_numpy()] = np.arange(len(path))
        terms, file, flag = [], [], []
        for c, value in (("terms", 0), ("extra", 1)):
            lists = rows.column(c).combine_chunks()
            terms.append(lists.flatten().cast(pa.string()))
            file.append(np.repeat(np.arange(len(path)), lists.value_lengths().to_numpy(zero_copy_only=False)))
            flag.append(np.full(len(file[-1]), value, np.int32))
        term, file, flag = pa.concat_arrays(terms).dictionary_encode(), np.concatenate(file), np.concatenate(flag)
        if not len(file):
            return
        codes = term.indices.to_numpy()
        order = np.lexsort((rank[file], codes))
        ends = np.cumsum(np.bincount(codes, minlength=len(term.dictionary)))
        parts = {"path": path.take(pa.array(file[order]))} | ({"from_symbol": pa.array(flag[order]), "count": pa.array(np.ones(len(order), np.int32))} if flags else {})
        entries = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.StructArray.from_arrays(list(parts.values()), names=list(parts)))
        n = len(term.dictionary)
        same = lambda c: pa.concat_arrays([pa.array([rows.column(c)[0].as_py()], rows.schema.field(c).type)] * 1).take(pa.array(np.zeros(n, np.int64)))
        out = pa.RecordBatch.from_arrays([same("root"), term.dictionary, same("part"), entries], names=["root", "term", "part", "entries"])
        step = max(1, n * 100_000 // len(order))
        for i in range(0, n, step):
            yield out.slice(i, step)

    def run(batches):
        import numpy as np

        held, key, size = [], None, 0
        for b in batches:
            root, part = b.column("root").to_pylist(), b.column("part").to_numpy(zero_copy_only=False)
            many = b.column("terms").value_lengths().to_numpy(zero_copy_only=False)
            cuts = [0, *(i for i in range(1, b.num_rows) if root[i] != root[i - 1] or part[i] != part[i - 1]), b.num_rows] if b.num_rows else [0]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                new, more = (root[lo], part[lo]), int(np.sum(many[lo:hi]))
                if held and (new != key or size + more > MOST_ENTRIES):
                    yield from grouped(held)
                    held, size = [], 0
                key, size = new, size + more
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from grouped(held)

    return files.select("root", "part", "path", "terms", "extra").mapInArrow(run, f"root string, term string, part int, entries array<{entry}>")


#: Rows of a root in a file of the index.
ROWS_PER_FILE = 1_000_000


def write_index(table: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Idempotent: replaces the roots that the table holds and leaves every other root as it was.

    A root is a folder, named by a digest so that any name will do; a large root is dealt by its
    paths over as many files as its rows need.
    """
    key = [c for c in ("root", "path", "term", "name", "kind") if c in table.columns]
    rows = written(table.dropDuplicates(key))
    parts = rows.groupBy(F.col("root").alias("of_root")).agg(F.ceil(F.count("*") / rows_per_file).cast("int").alias("root_parts"))
    out = rows.join(parts, F.col("root").eqNullSafe(F.col("of_root"))).withColumn("root_key", F.sha2(F.coalesce("root", F.lit("")), 256)).drop("of_root")
    dealt = out.withColumn("root_part", F.pmod(F.xxhash64("path"), F.col("root_parts"))).repartition("root_key", "root_part").drop("root_parts", "root_part")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_per_file).partitionBy("root_key").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("root_key")


def fulltext_terms(files: DataFrame, terms_of_symbols: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """root, path, term of the full-text documents: path, sample and symbol terms, accents aside; the kind is no part of them. With ``asked`` (root, term: few) rows of these alone."""
    own = files.select("root", "path", F.explode(T.tokenize(T.fold_accents(F.concat_ws(" ", "path", "sample")))).alias("term"))
    extra = terms_of_symbols.select("root", "path", F.explode(T.tokenize(T.fold_accents(F.col("term")))).alias("term"))
    if asked is not None:
        own, extra = (x.join(asked, ["root", "term"], "left_semi").select("root", "path", "term") for x in (own, extra))
    return own.unionByName(extra.join(own, ["root", "path", "term"], "left_anti").distinct())
