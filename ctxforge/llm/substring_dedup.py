"""Substring dedup by content-defined chunks.

A gear rolling hash over the last ``WINDOW`` bytes is taken at every byte of a text, and the least
of every ``SPAN`` hashes in a row is a cut (of equals the last). Cuts depend on content alone, an
insertion moves only the cuts next to it, and no chunk is longer than ``SPAN`` bytes but for a run
of one character. A passage that stands elsewhere too loses less than WINDOW + SPAN bytes at either
end, so its bound in words lies below that of the passages wanted.

Texts are chunked once: chunk ends and 128-bit digests are written. Digests travel in blobs by
ranges of digests; what other documents have too comes back to the document, where neighbouring
repeated chunks join into passages, and passages of ``min_words`` words or more are reported.
Chunks that very many documents hold are found in a sample, counted exactly over all documents by
an aggregate that combines before the shuffle, and looked up in a bounded table, so no task gets
all copies of one. The sample decides the way, not the result.

Defined results: null, empty and unrepeated texts have no rows; repeats within one document
count only with ``within``; rows that repeat both id and text are one document; documents that
share an id but not a text are told apart by their text; the first document of a chunk is the one
of the smallest integer id (null last; of ids of other types the one of the smallest hash), then of
the smallest digest of its text; a text shorter than a chunk is one chunk; very long texts are read
whole, in blocks; an empty table gives no rows; columns other than doc_id and text are not looked
at, whatever their names, and are kept by ``deduplicated``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize, table, text_of, whole_row

WINDOW, SPAN, MIN_WORDS = 8, 47, 16
GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
BLOCK = 1 << 20
#: Frequent chunks: OFTEN or more of every SAMPLE-th text; at most MOST_FREQUENT go to the driver and back.
SAMPLE, OFTEN, MOST_FREQUENT = 32, 8, 100_000
CHUNKS_PER_TASK, BATCH_BYTES = 1_000_000, 16 << 20
DIGEST = np.dtype([("hi", "<u8"), ("lo", "<u8")])
WHO = np.dtype([("o", "<i8"), ("row", "<i8")])
SHARED = np.dtype([("ord", "<i4"), ("first", "<i8"), ("mine", "<i1")])
_LAST = np.iinfo(np.int64).max


def cut_points(data: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Ends of the chunks of UTF-8 bytes, never within a character. Runs in blocks, whatever the length."""
    n, found = len(data), []
    for at in range(0, n, BLOCK):
        # a cut depends on the hashes of span - 1 positions to either side
        lo, hi = max(0, at - WINDOW - span), min(n, at + BLOCK + span)
        h = GEAR[data[lo:hi]]
        k = 1
        while k < WINDOW:  # the hash of 2k bytes from two hashes of k bytes
            g = h.copy()
            g[k:] += h[:-k] << np.uint32(k)
            h, k = g, 2 * k
        place = np.arange(lo, hi)
        v = ((h * np.uint32(2654435761)).astype(np.uint64) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - (place - lo).astype(np.uint64))
        inside = np.concatenate([(data[lo + 1 : hi] & 0xC0) == 0x80, [False]])
        same = np.concatenate([[False], data[lo + 1 : hi] == data[lo : hi - 1]]) & np.concatenate([[False], h[1:] == h[:-1]])
        v[inside | same] = np.uint64(0xFFFFFFFFFFFFFFFF)
        least, k = v, 1
        while k < span:  # the least of the last span values
            step = min(k, span - k)
            m = least.copy()
            np.minimum(m[step:], least[:-step], out=m[step:])
            least, k = m, k + step
        least = least[span - 1 :] if len(least) >= span else least[-1:]
        least = np.unique(least[least < np.uint64(0xFFFFFFFFFFFFFFFF)])
        cut = np.sort((np.uint64(0xFFFFFFFF) - (least & np.uint64(0xFFFFFFFF))).astype(np.int64)) + lo + 1
        cut = cut[(cut > at) & (cut <= at + BLOCK) & (cut < n)]
        found.append(cut)
    return np.concatenate([*found, [n]]) if n else np.zeros(0, np.int64)


def chunked(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Characters and begun words before each border of chunks, the chunks' digests, and the text's."""
    import xxhash

    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    ends = cut_points(data)
    borders = np.concatenate([[0], ends]).astype(np.int64)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[borders]
    gap = _SPACE[data]
    begins = np.concatenate([[0], np.cumsum(~gap & np.concatenate([[True], gap[:-1]]))])[borders] if len(data) else np.zeros(1, np.int64)
    digests = b"".join([xxhash.xxh3_128_digest(raw[s:e]) for s, e in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)])
    row = np.array([xxhash.xxh64_intdigest(raw, 42)], np.uint64).view(np.int64)[0]
    return chars, begins, np.frombuffer(digests, DIGEST), int(row)


def steps(borders: np.ndarray) -> bytes:
    """What borders that begin at 0 advance by, a byte each; four where a chunk is a longer run of one character."""
    d = np.diff(borders)
    return d.astype("<u1" if len(d) and d.max() < 256 else "<i4").tobytes()


def borders_of(blob: bytes, n: int) -> np.ndarray:
    """The n + 1 borders again."""
    d = np.frombuffer(blob, "<u1" if len(blob) == n else "<i4")
    return np.concatenate([[0], np.cumsum(d, dtype=np.int64)])


def _order(ids: pa.Array) -> np.ndarray:
    """A number to order ids by: integers themselves, others by a hash; null last."""
    import xxhash

    if pa.types.is_integer(ids.type):
        return ids.cast(pa.int64()).fill_null(_LAST).to_numpy(zero_copy_only=False)
    return np.array([_LAST if x is None else xxhash.xxh3_64_intdigest(repr(x)) >> 1 for x in ids.to_pylist()], np.int64)


def chunk_table(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, o, row (which tell documents apart), n, and per chunk its characters and begun words (as steps) and a digest."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    names = ["doc_id", "o", "row", "n", "chars", "words", "digests"]

    def run(batches):
        for b in batches:
            order, rows, at, size = _order(b.column(0)), [], 0, 0

            def out(lo, hi, rows, b=b):
                return pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]], names=names)

            for i, text in enumerate(b.column(1)):
                chars, begins, digests, row = chunked(text.as_py())
                rows.append((int(order[i]), row, len(digests), steps(chars), steps(begins), digests.tobytes()))
                size += 18 * len(digests) + 100
                if size > BATCH_BYTES:
                    yield out(at, i + 1, rows)
                    rows, at, size = [], i + 1, 0
            if rows:
                yield out(at, b.num_rows, rows)

    some = docs.select("doc_id", text_of(text_col).alias("t")).where("t <> ''")
    return some.mapInArrow(run, f"doc_id {kind}, o long, row long, n int, chars binary, words binary, digests binary")


def _known(frequent: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which digests are among the sorted frequent ones, and where."""
    if not len(frequent):
        return np.zeros(len(d), bool), np.zeros(len(d), np.int64)
    at = np.searchsorted(frequent["hi"], d["hi"])
    at = np.minimum(at, len(frequent) - 1)
    return (frequent["hi"][at] == d["hi"]) & (frequent["lo"][at] == d["lo"]), at


def frequent_chunks(chunks: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests that many sampled documents hold, sorted; of each the first document, over all documents, and whether another has it too."""
    spark = chunks.sparkSession

    def sampled(batches):
        for b in batches:
            d = [np.unique(np.frombuffer(x, DIGEST)) for x in b.column(0).to_pylist()]
            u, n = np.unique(np.concatenate([np.zeros(0, DIGEST), *d]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in u], pa.binary()), pa.array(n)], names=["d", "n"])

    some = chunks.where(F.pmod("row", F.lit(SAMPLE)) == 0).select("digests").mapInArrow(sampled, "d binary, n long")
    rows = some.groupBy("d").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN).orderBy(F.col("n").desc(), "d").limit(MOST_FREQUENT).collect()
    keys = np.sort(np.frombuffer(b"".join(bytes(r["d"]) for r in rows), DIGEST), order=["hi", "lo"])
    keys = keys[np.concatenate([[True], keys["hi"][1:] != keys["hi"][:-1]])] if len(keys) else keys  # lookups go by the first half
    if not len(keys):
        return keys, np.zeros(0, WHO), np.zeros(0, bool)
    shared = spark.sparkContext.broadcast(keys)

    def ends(batches):
        for b in batches:
            who = np.rec.fromarrays([b.column(i).to_numpy() for i in (0, 1)], dtype=WHO)
            rank = np.argsort(np.argsort(who, order=["o", "row"]))
            lo, hi = np.full(len(shared.value), len(who), np.int64), np.full(len(shared.value), -1, np.int64)
            for r, x in zip(rank, b.column(2).to_pylist(), strict=True):
                ok, at = _known(shared.value, np.frombuffer(x, DIGEST))
                at = at[ok]
                np.minimum.at(lo, at, r)
                np.maximum.at(hi, at, r)
            w = np.sort(who, order=["o", "row"])
            at = np.flatnonzero(hi >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(w[x[at]][c]) for x in (lo, hi) for c in ("o", "row")]], names=["at", "o", "row", "o2", "row2"])

    found = chunks.select("o", "row", "digests").mapInArrow(ends, "at long, o long, row long, o2 long, row2 long")
    found = found.groupBy("at").agg(F.min(F.struct("o", "row")).alias("a"), F.max(F.struct("o2", "row2")).alias("z")).orderBy("at").collect()  # MOST_FREQUENT at most
    first = np.array([(r["a"]["o"], r["a"]["row"]) for r in found], WHO)
    return keys, first, np.array([(r["a"]["o"], r["a"]["row"]) != (r["z"]["o2"], r["z"]["row2"]) for r in found], bool)


def shared_chunks(chunks: DataFrame, frequent, within: bool) -> DataFrame:
    """o, row, shared: the chunks of a document (number, first document, whether it is the first) that others have too; a row for each document. Frequent chunks are left out."""
    total = chunks.agg(F.sum("n").alias("n")).first()["n"] or 0
    tasks = max(1, -(-int(total) // CHUNKS_PER_TASK))

    def blobs(batches):
        for b in batches:
            o, row, texts, at = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2), 0
            while at < len(o):
                part, size, lo = [], 0, at
                while at < len(o) and size < BATCH_BYTES // 2:
                    part.append(np.frombuffer(texts[at].as_py(), DIGEST))
                    size += part[-1].nbytes
                    at += 1
                k = np.array([len(x) for x in part])
                d = np.concatenate(part)
                doc, ordinal = np.repeat(np.arange(lo, at), k), (np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)).astype("<i4")
                rare = ~_known(frequent.value[0], d)[0]
                d, doc, ordinal = d[rare], doc[rare], ordinal[rare]
                if not len(d):
                    continue
                to = (d["lo"] % np.uint64(tasks)).astype(np.int64)
                by = np.argsort(to, kind="stable")
                d, doc, ordinal, to = d[by], doc[by], ordinal[by], to[by]
                out, x = [], 0
                for y in np.concatenate([np.flatnonzero(to[1:] != to[:-1]) + 1, [len(to)]]):
                    first = np.concatenate([[0], np.flatnonzero(np.diff(doc[x:y])) + 1])
                    who = np.rec.fromarrays([o[doc[x:y][first]], row[doc[x:y][first]]], dtype=WHO)
                    runs = np.diff(np.concatenate([first, [y - x]])).astype("<i4")
                    out.append((int(to[x]), d[x:y].tobytes(), ordinal[x:y].tobytes(), who.tobytes(), runs.tobytes()))
                    x = y
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["task", "d", "ords", "who", "runs"])

    def answers(batches):
        parts = [[] for _ in range(4)]
        for b in batches:
            for d, ords, who, runs in zip(*(b.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
                w = np.repeat(np.frombuffer(who, WHO), np.frombuffer(runs, "<i4"))
                for p, x in zip(parts, (np.frombuffer(d, DIGEST), np.frombuffer(ords, "<i4"), w["o"], w["row"]), strict=True):
                    p.append(x)
        if not parts[0]:
            return
        d, ords, o, row = (np.concatenate(p) for p in parts)
        del parts
        hi, lo = d["hi"], d["lo"]
        by = np.lexsort((ords, row, o, lo, hi))
        hi, lo, ords, o, row = hi[by], lo[by], ords[by], o[by], row[by]
        starts = np.concatenate([[0], np.flatnonzero((hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])) + 1])
        sizes = np.diff(np.concatenate([starts, [len(hi)]]))
        last = starts + sizes - 1
        many = (sizes > 1) if within else (o[starts] != o[last]) | (row[starts] != row[last])
        group = np.repeat(np.arange(len(starts)), sizes)
        keep = many[group]
        group = group[keep]
        first_o, first_row = o[starts][group], row[starts][group]
        o, row, ords = o[keep], row[keep], ords[keep]
        if not len(o):
            return
        mine = (o == first_o) & (row == first_row)
        if within:  # a chunk's first place stays, its others in the same document don't
            mine &= np.concatenate([[True], group[1:] != group[:-1]])
        out = np.rec.fromarrays([ords, first_o, mine.astype(np.int8)], dtype=SHARED)
        to = ((row.view(np.uint64) >> np.uint64(8)) % np.uint64(tasks)).astype(np.int64)
        by = np.argsort(to, kind="stable")
        o, row, out, to = o[by], row[by], out[by], to[by]
        cut = np.concatenate([[0], np.flatnonzero(to[1:] != to[:-1]) + 1, [len(to)]])
        parts = [[v[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)] for v in (o, row, out)]
        yield pa.RecordBatch.from_arrays([pa.array(to[cut[:-1]].astype(np.int32)), *[pa.array(v, pa.binary()) for v in parts]], names=["task", "os", "rows", "shared"])

    def gathered(batches):
        parts = [(np.frombuffer(x, "<i8"), np.frombuffer(y, "<i8"), np.frombuffer(z, SHARED)) for b in batches for x, y, z in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
        if not parts:
            return
        o, row, out = (np.concatenate(v) for v in zip(*parts, strict=True))
        del parts
        by = np.lexsort((out["ord"], row, o))
        o, row, out = o[by], row[by], out[by]
        cut = np.concatenate([[0], np.flatnonzero((o[1:] != o[:-1]) | (row[1:] != row[:-1])) + 1, [len(o)]])
        for s in range(0, len(cut) - 1, 50_000):
            c = cut[s : s + 50_001]
            yield pa.RecordBatch.from_arrays([pa.array(o[c[:-1]]), pa.array(row[c[:-1]]), pa.array([out[x:y].tobytes() for x, y in zip(c[:-1], c[1:], strict=True)], pa.binary())], names=["o", "row", "shared"])

    tokens = chunks.select("o", "row", "digests").mapInArrow(blobs, "task int, d binary, ords binary, who binary, runs binary")
    found = tokens.repartitionById(tasks, F.col("task")).mapInArrow(answers, "task int, os binary, rows binary, shared binary")
    return found.repartitionById(tasks, F.col("task")).mapInArrow(gathered, "o long, row long, shared binary")


def shared_frequent(chunks: DataFrame, frequent, within: bool) -> DataFrame:
    """The same for frequent chunks, from the bounded table of them."""

    def answers(batches):
        keys, first, several = frequent.value
        for b in batches:
            o, row, out, at = b.column(0).to_numpy(), b.column(1).to_numpy(), [], []
            for i, x in enumerate(b.column(2).to_pylist()):
                ok, k = _known(keys, np.frombuffer(x, DIGEST))
                hit = np.flatnonzero(ok)
                k = k[hit]
                if within:
                    twice = np.bincount(k, minlength=len(keys))[k] > 1 if len(k) else k > 0
                    keep = several[k] | twice
                else:
                    keep = several[k]
                hit, k = hit[keep], k[keep]
                if len(hit):
                    mine = (first["o"][k] == o[i]) & (first["row"][k] == row[i])
                    if within:
                        mine &= np.isin(np.arange(len(k)), np.unique(k, return_index=True)[1])
                    out.append(np.rec.fromarrays([hit, first["o"][k], mine.astype(np.int8)], dtype=SHARED).tobytes())
                    at.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(o[at]), pa.array(row[at]), pa.array(out, pa.binary())], names=["o", "row", "shared"])

    return chunks.select("o", "row", "digests").mapInArrow(answers, "o long, row long, shared binary")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, text_col: str = "text", within: bool = False) -> DataFrame:
    """doc_id, row, start, end, n_words, n_chunks, first_doc, removable, spans: passages whose every chunk other documents have too.

    Neighbouring chunks join whichever documents have them, so a passage may stand whole in no single
    other one. first_doc is the first id that has one of its chunks; spans are the parts of the passage whose chunks occur elsewhere first, which may
    go; removable says that it is the whole passage.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    chunks = materialize(chunk_table(docs, text_col))
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_chunks(chunks))
    found = shared_chunks(chunks, frequent, within)
    if len(frequent.value[0]):
        found = found.unionByName(shared_frequent(chunks, frequent, within).dropDuplicates(["o", "row"]))  # rows that repeat id and text
    found = found.groupBy("o", "row").agg(F.collect_list("shared").alias("shared"))
    borders = chunks.select("doc_id", "o", "row", "n", "chars", "words").dropDuplicates(["o", "row"])
    one = borders.join(found, ["o", "row"]).select("doc_id", "row", "n", "chars", "words", "shared")

    def passages(batches):
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                row = b.column(1)[i].as_py()
                chars, begins = (borders_of(b.column(k)[i].as_py(), b.column(2)[i].as_py()) for k in (3, 4))
                hit = np.unique(np.concatenate([np.frombuffer(x, SHARED) for x in b.column(5)[i].as_py()]))
                for run in np.split(hit, np.flatnonzero(np.diff(hit["ord"]) > 1) + 1):
                    a, z = int(run["ord"][0]), int(run["ord"][-1]) + 1
                    n = int(begins[z] - begins[a])
                    if n < min_words:
                        continue
                    parts = [p for p in np.split(run, np.flatnonzero(np.diff(run["mine"])) + 1) if not p["mine"][0]]
                    spans = [{"start": int(chars[p["ord"][0]]), "end": int(chars[p["ord"][-1] + 1])} for p in parts]
                    rows.append((i, row, int(chars[a]), int(chars[z]), n, z - a, int(run["first"].min()), not run["mine"].any(), spans))
            cols = list(zip(*rows, strict=True)) or [()] * 9
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), span]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0], pa.int32())), *[pa.array(c, t) for c, t in zip(cols[1:], types, strict=True)]], names=["doc_id", "row", "start", "end", "n_words", "n_chunks", "first", "removable", "spans"])

    out = one.mapInArrow(passages, f"doc_id {kind}, row long, start int, end int, n_words long, n_chunks long, first long, removable boolean, spans array<struct<start:int,end:int>>")
    if kind in ("tinyint", "smallint", "int", "bigint"):
        out = out.withColumn("first_doc", F.when(F.col("first") != _LAST, F.col("first")))
    else:  # the id of that hash
        ids = chunks.where(F.col("o") != _LAST).groupBy(F.col("o").alias("first")).agg(F.min("doc_id").alias("first_doc"))
        out = out.join(ids, "first", "left")
    out = materialize(out.drop("first"))
    discard(chunks)
    return out


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS, within: bool = False) -> DataFrame:
    """The documents, all columns kept, without the parts of repeated passages that occur elsewhere first; n_chars follows the text."""
    cut = repeated_passages(docs, min_words, within=within).select("doc_id", "row", F.explode("spans").alias("s"))
    cut = cut.groupBy(F.col("doc_id").alias("id"), "row").agg(F.array_sort(F.collect_set("s")).alias("s"))
    d = docs.select(whole_row(docs).alias("doc"), F.xxhash64(text_of()).alias("digest")).alias("d")
    both = d.join(cut.alias("c"), F.col("d.doc.doc_id").eqNullSafe(F.col("c.id")) & (F.col("d.digest") == F.col("c.row")), "left")
    text = F.col("doc.text")
    state = F.struct(F.lit("").alias("t"), F.lit(0).alias("at"))
    kept = F.aggregate("s", state, lambda a, x: F.struct(F.concat(a["t"], F.substring(text, a["at"] + 1, x["start"] - a["at"])).alias("t"), x["end"].alias("at")), lambda a: F.concat(a["t"], F.substring(text, a["at"] + 1, F.length(text))))
    out = both.select("doc", F.coalesce(kept, text).alias("text"))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[changed.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
