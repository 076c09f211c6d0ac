"""Retrieval judged on real trees: each tree is walked, indexed and queried, and the ranks of the files that should be found are counted."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval, scan, store
from ..sources import tree
from ..sources.scratch import scratch_dir


def index_tree(spark: SparkSession, path: str, root: str, index_path: str) -> None:
    """Brings the stored index of a folder up to date: it is walked without its pruned folders, and files that changed are opened."""
    found = tree.list_tree(spark, path, root, pruned=scan.builtin_reason(F.col("path")).isNotNull())
    ignore = tree.sampled(found.where(F.col("path").isin(".gitignore", ".contextgateignore")), path)
    store.sync(spark, index_path, store.listed(found, ignore), lambda rows: tree.sampled(rows, path, hashed=True), F.unix_millis(F.current_timestamp()))


def evaluate(spark: SparkSession, trees: dict[str, str], cases: DataFrame, top_k: int = 5, fulltext: bool = True) -> tuple[DataFrame, DataFrame]:
    """(query_id, grp, first_rank of each query; the hit rate of each group and of all against the gate).

    trees: a folder for each group; cases: query_id, grp, query, path (one row for each path that would do).
    fulltext: whether full-text recall comes first, or keywords alone recall.
    """
    queries = cases.select("query_id", F.col("grp").alias("root"), "query").distinct().withColumn("top_k", F.lit(top_k))
    found = []
    for grp, path in trees.items():
        at = scratch_dir(spark)
        index_tree(spark, path, grp, at)
        found.append(retrieval.stored_query(queries.where(F.col("root") == grp), at, fulltext=fulltext))
    results = functools.reduce(DataFrame.unionByName, found)
    expected = cases.select("query_id", "grp", "path")
    return retrieval.first_hits(results, expected), retrieval.hit_rate(results, expected)
