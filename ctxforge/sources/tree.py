"""Trees of files as rows, walked and read by the tasks themselves.

A walk goes level by level: the folders of a level are rows, tasks list them, files are kept and folders
make the next level, so no one place lists a large tree and pruned folders are never entered. Files are then opened by
the tasks that hold their rows: only paths are ever shuffled, never contents. Reads are ranged:
a large file costs its head and tail. What can't be listed or read is a row with the error
read_error, not a failed job.

Stores are those that Arrow reaches (local or mounted folders, HDFS, S3, GCS) at paths that every
executor sees; others, that only Spark's readers know, are read whole by these.
"""

from __future__ import annotations

import hashlib
import os
import stat

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from .scratch import discarded, written

#: Bytes of a file that are read at a time to hash it.
CHUNK = 1 << 20
_LISTED = "path string, size_bytes long, mtime long, error string"


def reachable(path: str) -> bool:
    try:
        fs.FileSystem.from_uri(_uri(path))
        return True
    except (ValueError, NotImplementedError, OSError, pa.ArrowException):
        return False


def _uri(path: str) -> str:
    """Spark's file:/x as file:///x."""
    return f"file://{path[5:]}" if path.startswith("file:/") and not path.startswith("file://") else path


def _store(path: str) -> tuple[fs.FileSystem, str]:
    store, base = fs.FileSystem.from_uri(_uri(path))
    return store, base.rstrip("/")


def _local(base: str, folder: str) -> list[tuple]:
    """(path, size, time, error, whether a folder) of what a folder holds; links to folders aren't followed."""
    rows = []
    with os.scandir(f"{base}/{folder}") as found:
        for e in found:
            below = f"{folder}/{e.name}".lstrip("/")
            if e.is_dir(follow_symlinks=False):
                rows.append((below, None, None, None, True))
                continue
            try:
                info = e.stat()
                good = stat.S_ISREG(info.st_mode)
            except OSError:
                good = False
            rows.append((below, info.st_size, info.st_mtime_ns // 1_000_000, None, False) if good else (below, None, None, "read_error", False))
    return rows


def _remote(store: fs.FileSystem, base: str, folder: str) -> list[tuple]:
    rows = []
    for i in store.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"))):
        below, file = i.path[len(base) + 1 :], i.type == fs.FileType.File
        error = None if file or i.type == fs.FileType.Directory else "read_error"
        rows.append((below, i.size if file else None, i.mtime_ns // 1_000_000 if file and i.mtime_ns is not None else None, error, i.type == fs.FileType.Directory))
    return rows


def list_tree(spark: SparkSession, path: str, root: str, pruned: Column | None = None) -> DataFrame:
    """root, path (below ``path``), size_bytes, mtime (ms), error of every file; ``pruned`` (of the column path) says which folders aren't entered."""
    if not reachable(path):
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        return _spark_paths(found, path, root).select("root", "path", "size_bytes", "mtime", F.lit(None).cast("string").alias("error"))

    def listed(batches):
        store, base = _store(path)
        for b in batches:
            rows = []
            for folder in b.column(0).to_pylist():
                try:
                    rows += _local(base, folder) if isinstance(store, fs.LocalFileSystem) else _remote(store, base, folder)
                except OSError:
                    rows.append((folder, None, None, "read_error", False))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True)], names=["path", "size_bytes", "mtime", "error", "folder"])

    level, levels = spark.createDataFrame([("",)], "path string"), []
    while True:
        here = written(level.mapInArrow(listed, f"{_LISTED}, folder boolean"))
        levels.append(here)
        more = here.where("folder").select("path") if pruned is None else here.where("folder").where(~F.coalesce(pruned, F.lit(False))).select("path")
        if more.isEmpty():
            break
        level = more.repartition("path")  # dealt anew, so one wide folder doesn't stay with one task
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    files = written(out.where("NOT folder").drop("folder"))
    for x in levels:
        discarded(x)
    return files.select(F.lit(root).alias("root"), *files.columns)


def _spark_paths(found: DataFrame, path: str, root: str) -> DataFrame:
    below = F.regexp_replace("path", r"^[a-zA-Z0-9+.-]+:/*", "/")
    base = "/" + path.split(":", 1)[-1].strip("/") + "/"
    extra = [c for c in found.columns if c == "content"]
    return found.select(F.lit(root).alias("root"), below.substr(len(base) + 1, 1 << 20).alias("path"), F.col("length").alias("size_bytes"), F.unix_millis("modificationTime").alias("mtime"), *extra)


def _opened(listing: DataFrame, path: str, read, columns: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    """The listing with what ``read(file, size)`` gives for each file, nulls and an error where it fails."""
    names = [c for c in listing.columns if c not in ("error", *(n for n, *_ in columns))]
    kept = listing.select(*[F.col(f"`{c}`") for c in names], F.col("error") if "error" in listing.columns else F.lit(None).cast("string").alias("error"))
    at, size_at = names.index("path"), names.index("size_bytes")
    types = dict((f.name, f.dataType.simpleString()) for f in kept.schema.fields)
    schema = ", ".join(f"`{c}` {types[c]}" for c in names) + ", " + ", ".join(f"{n} {t}" for n, _, t in columns) + ", error string"

    def run(batches):
        store, base = _store(path)
        for b in batches:
            for i in range(b.num_rows):  # a file a batch: contents of many large files never stand in memory together
                row = b.slice(i, 1)
                error = row.column(len(names))[0].as_py()
                values = [None] * len(columns)
                if error is None:
                    try:
                        with store.open_input_file(f"{base}/{row.column(at)[0].as_py()}") as f:
                            values = read(f, row.column(size_at)[0].as_py())
                    except (OSError, pa.ArrowException):
                        error = "read_error"
                yield pa.RecordBatch.from_arrays([*row.columns[: len(names)], *[pa.array([v], t) for v, (_, t, _) in zip(values, columns, strict=True)], pa.array([error], pa.string())], names=[*names, *[n for n, *_ in columns], "error"])

    return kept.mapInArrow(run, schema)


def sampled(listing: DataFrame, path: str, hashed: bool = False) -> DataFrame:
    """The listing with content (the text sample's bytes: all up to 64 KiB, else the last 8 KiB), head (16 KiB), bytes_read, and hash (SHA-256 of the file, read in chunks) if asked for."""

    def read(f, size):
        head = f.read(R.HEAD_BYTES)
        total = f.size()
        if total > R.LARGE_BYTES:
            f.seek(total - R.TAIL_BYTES)
            content = f.read(R.TAIL_BYTES)
            count = len(head) + len(content)
        else:
            content = head + f.read()
            count = len(content)
        digest = None
        if hashed:
            f.seek(0)
            sha = hashlib.sha256()
            while chunk := f.read(CHUNK):
                sha.update(chunk)
                count += len(chunk)
            digest = sha.hexdigest()
        return content, head, count, digest

    columns = [("content", pa.binary(), "binary"), ("head", pa.binary(), "binary"), ("bytes_read", pa.int64(), "long"), ("hash", pa.string(), "string")]
    return _opened(listing, path, read, columns)


def read_tree(spark: SparkSession, path: str, root: str) -> DataFrame:
    """root, path (below ``path``), size_bytes, mtime (ms), content, error of every file below a folder.

    A file that is listed but can't be read has null content and the error read_error.
    """
    if not reachable(path):
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(path)
        return _spark_paths(found, path, root).withColumn("error", F.lit(None).cast("string"))
    return _opened(list_tree(spark, path, root), path, lambda f, size: [f.read()], [("content", pa.binary(), "binary")]).select("root", "path", "size_bytes", "mtime", "content", "error")
