"""Zones of injected text between markers, with byte offsets; malformed documents are reported apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def _pattern(start: str, end: str) -> str:
    return f"(?s)\\Q{start}\\E(.*?)\\Q{end}\\E"


def zone_error(text: Column, start: str, end: str) -> Column:
    """orphan_end before missing_end; null for a well-formed text."""
    rest = F.regexp_replace(text, _pattern(start, end), "\n")
    return F.when(F.contains(rest, F.lit(end)), "orphan_end").when(F.contains(rest, F.lit(start)), "missing_end")


def extract_zones(docs: DataFrame, start: str, end: str) -> DataFrame:
    """doc_id, zone_no, content, content_start, content_end (bytes) of the well-formed documents of (doc_id, text)."""
    good = docs.where(zone_error(F.col("text"), start, end).isNull())
    inner = F.regexp_extract_all("text", F.lit(_pattern(start, end)), F.lit(1))
    gaps = F.split("text", _pattern(start, end), -1)
    s, e = len(start.encode()), len(end.encode())
    # a zone ends where it, its marks and the gap before it are summed up
    ends = T.prefix_sums(F.zip_with(inner, F.slice(gaps, F.lit(1), F.size(inner)), lambda z, g: F.octet_length(g) + F.octet_length(z) + s + e))
    begins = F.zip_with(ends, inner, lambda x, z: x - e - F.octet_length(z))
    rows = good.select("doc_id", F.posexplode(F.arrays_zip(inner.alias("c"), begins.alias("b"))).alias("zone_no", "x"))
    return rows.select("doc_id", "zone_no", F.col("x.c").alias("content"), F.col("x.b").alias("content_start"), (F.col("x.b") + F.octet_length("x.c")).alias("content_end"))


def zone_errors(docs: DataFrame, start: str, end: str) -> DataFrame:
    return docs.select("doc_id", zone_error(F.col("text"), start, end).alias("error")).where("error IS NOT NULL")
