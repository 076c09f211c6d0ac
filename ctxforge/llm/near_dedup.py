"""MinHash near-dedup by an LSH forest, completed by an exact join; links are confirmed on full shingle sets.

1. Texts are read once: of a text's hashed shingle set are written its size, its signature, its
   node, which is a digest of the set, and its head, the quarter that step 4 needs. Texts with
   equal sets form a class; one node stands for a class.
2. A node's signature has ``TREES`` sequences of ``DEPTH`` minhashes. In each tree nodes are sorted
   by their sequence; the order is range-partitioned by the sequence itself, so a dense region
   spreads over tasks by ever deeper prefixes.
3. A node is compared, by its whole signature, with up to ``REACH`` nodes before it that share
   ``FIRST`` values. Sorted neighbours have the longest common prefixes, so in a dense region the
   window holds only deep ones, in a sparse region all: the depth adapts. It proposes its ``BEST``
   most alike neighbours; proposals are confirmed on the full sets and joined to components. A
   second pass proposes among nodes of different components only.
4. The forest joins most of what is alike but proves nothing about the rest: windows restart at
   the edges of partitions, and proposals rest on estimates. An exact join ends the job: shingles
   have one order, rare ones first; two sets of the wanted similarity share a shingle among the
   first quarter of each. Nodes of different components that meet there, and that lengths and
   places of the shingle allow, are compared by their heads, which bound what the sets can share,
   and the rest of them are all confirmed on the full sets.

The forest only spares the exact join the pairs within components, so no link depends on an
estimate, a window or a number of proposals. The list of frequent shingles comes from a sample;
it sets the order, not the result. Shingles are compared by 63-bit hashes; classes by 128 bits.

Defined results: a null or blank text has no shingles, links with nothing and is its own
component; fewer than five words form one shingle of the whole sequence; rows that repeat an
id are judged by their own text; a null id never becomes a component's id while another is
there; among equal texts the smallest id names the component (ties need no rule: ids are
compared); very long texts are read whole, one at a time; an empty table gives no rows; columns
other than doc_id and the text are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, if_small, materialize, table, text_of, whole_row

SHINGLE, NUMERATOR, DENOMINATOR = 5, 75, 100
TREES, DEPTH, FIRST = 8, 8, 2
REACH, BEST, LEAST_ALIKE = 256, 2, 0.55
#: Frequent shingles: at least this many of every SAMPLE-th text hold one; the list goes to the driver and is bounded.
SAMPLE, OFTEN, MOST_FREQUENT = 16, 3, 200_000
N_HASHES = TREES * DEPTH
#: A task of pairs holds some 2000 of them, and sets of some two million shingles (20 bytes each with their text).
PAIRS_PER_TASK, PAIRS_PER_BUNDLE = 2000, 128
SHINGLES_PER_TASK, SHINGLES_PER_BUNDLE = 2_000_000, 250_000
#: A shingle that more nodes hold is compared by pairs of blocks of half as many, which are dealt over tasks of their own.
HOT_GROUP, BLOCKS_PER_TASK = 4096, 64
#: Shingles of the exact join in a task, 32 bytes each; bytes of heads in an Arrow batch.
TOKENS_PER_TASK, BATCH_BYTES = 1_000_000, 16 << 20
_rng = np.random.default_rng(77)
_A = _rng.integers(0, 1 << 63, N_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, N_HASHES, dtype=np.uint64)
_M = _rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TOKEN = np.dtype([("key", "<u8"), ("node", "<i8"), ("comp", "<i8"), ("n", "<i4"), ("pos", "<i4")])
RUN = np.dtype([("node", "<i8"), ("comp", "<i8"), ("n", "<i4"), ("k", "<i4")])
HOLDER = np.dtype([("node", "<i8"), ("comp", "<i8"), ("n", "<i4"), ("pos", "<i4")])


class WordHashes(dict):
    def __missing__(self, word):
        import xxhash

        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str, words: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles; A-Z are lower-cased."""
    ws = text.encode("utf-8", "surrogatepass").lower().split()
    if len(words) > 300_000:
        words.clear()
    w = np.fromiter((words[x] for x in ws), np.uint64, len(ws))
    if not len(w):
        return w
    n = len(w) - size + 1
    if n < 1:
        return _mixed(np.array([(w * _M[: len(w)]).sum() + np.uint64(len(w))], np.uint64)) >> np.uint64(1)
    h = w[:n] * _M[0]
    for k in range(1, size):
        h += w[k : n + k] * _M[k]
    return np.unique(_mixed(h) >> np.uint64(1))


def signature(s: np.ndarray) -> np.ndarray:
    least = np.full(N_HASHES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(s), 512):
        h = np.multiply.outer(_A, s[at : at + 512])
        h += _B[:, None]
        np.minimum(least, h.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def nodes_of(s: np.ndarray) -> tuple[int, int]:
    """A set's node and the other half of its 128-bit digest."""
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def frequent_shingles(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many sampled texts hold, sorted, and the rank of each by frequency: MOST_FREQUENT at most."""

    def run(batches):
        words = WordHashes()
        for b in batches:
            sets = [shingles(t, words) for t in b.column(0).to_pylist()]
            h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    t = text_of(text_col)
    some = docs.select(t.alias("t")).where(F.pmod(F.xxhash64("t"), F.lit(SAMPLE)) == 0).mapInArrow(run, "h long, n long")
    rows = some.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN).orderBy(F.col("n").desc(), "h").limit(MOST_FREQUENT)
    often = rows.toPandas()["h"].to_numpy(np.int64)[::-1].copy().view(np.uint64)
    rank = np.argsort(often, kind="stable")
    return often[rank], rank


def prefix(s: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The shingles of a set, rare ones first, that a set alike enough must meet; frequent is sorted, rank its order."""
    n = len(s) - -(-NUMERATOR * len(s) // DENOMINATOR) + 1
    if not len(frequent) or not len(s):
        return s[:n]
    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
    often = frequent[at] == s
    rare = s[~often]
    return rare[:n] if len(rare) >= n else np.concatenate([rare, s[often][np.argsort(rank[at[often]], kind="stable")]])[:n]


def places(head: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Where the shingles of a head stand in the order of all shingles: rare ones by hash, below 2**63, then frequent ones by rank."""
    if not len(frequent):
        return head
    at = np.minimum(np.searchsorted(frequent, head), len(frequent) - 1)
    return np.where(frequent[at] == head, rank[at].astype(np.uint64) + np.uint64(1 << 63), head)


def needed_overlap(n, m):
    """The fewest common shingles of sets of n and m that are alike enough."""
    return -(-NUMERATOR * (n + m) // (NUMERATOR + DENOMINATOR))


def shingle_sets(docs: DataFrame, frequent, text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, node and proof (both null without shingles), sig (minhashes, big-endian), low (a byte of each), head."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["n_shingles", "node", "proof", "sig", "low", "head"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]

    def run(batches):
        words = WordHashes()
        for b in batches:
            rows, at, size = [], 0, 0
            out = lambda lo, hi, rows, b=b: pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]], names=["doc_id", *names])
            for i, text in enumerate(b.column(1)):
                s = shingles(text.as_py(), words)
                if len(s):
                    v, head = signature(s), prefix(s, *frequent.value).astype("<u8").tobytes()
                    rows.append((len(s), *nodes_of(s), v.astype(">u4").tobytes(), (v & np.uint32(255)).astype(np.uint8).tobytes(), head))
                    size += len(head)
                else:
                    rows.append((0, None, None, None, None, None))
                size += 400
                if size > BATCH_BYTES:
                    yield out(at, i + 1, rows)
                    rows, at, size = [], i + 1, 0
            if rows:
                yield out(at, b.num_rows, rows)

    return docs.select("doc_id", text_of(text_col).alias("t")).mapInArrow(run, f"doc_id {kind}, n_shingles long, node long, proof long, sig binary, low binary, head binary")


def told_apart(sets: DataFrame) -> DataFrame:
    """The sets with nodes that differ where only 64 bits of two digests agree (once among some 10**10 sets)."""
    mixed = materialize(sets.where("node IS NOT NULL").groupBy("node").agg(F.min("proof").alias("lo"), F.max("proof").alias("hi")).where("lo <> hi").select("node"))
    if mixed.isEmpty():
        return sets
    again = sets.join(F.broadcast(mixed.withColumn("twice", F.lit(True))), "node", "left")
    return materialize(again.withColumn("node", F.when(F.col("twice"), F.xxhash64("node", "proof")).otherwise(F.col("node"))).select(*sets.columns))


def _proposals(best: int):
    """Streams the sorted order; keeps the last REACH rows of the current region, whatever its size."""

    def run(batches):
        region, nodes, lows, comps = None, np.zeros(0, np.int64), np.zeros((0, N_HASHES), np.uint8), np.zeros(0, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            tree, ns, cs = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 4))
            first = np.frombuffer(b"".join(b.column(1).to_pylist()), ">u8").reshape(len(ns), -1)[:, : FIRST // 2]
            ls = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(len(ns), N_HASHES)
            a_out, b_out = [], []
            new = (tree[1:] != tree[:-1]) | (first[1:] != first[:-1]).any(axis=1)
            edges = np.concatenate([[0], np.flatnonzero(new) + 1, [len(ns)]])
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                here = (tree[lo], *first[lo])
                if here != region:
                    region, nodes, lows, comps = here, nodes[:0], lows[:0], comps[:0]
                if hi - lo == 1 and not len(nodes):
                    nodes, lows, comps = ns[lo:hi], ls[lo:hi], cs[lo:hi]
                    continue
                for s in range(lo, hi, 64):
                    e, old = min(s + 64, hi), len(nodes)
                    nodes, lows, comps = np.concatenate([nodes, ns[s:e]]), np.concatenate([lows, ls[s:e]]), np.concatenate([comps, cs[s:e]])
                    same = (lows[old:, None, :] == lows[None, :, :]).sum(axis=2)
                    alike = (same / N_HASHES - 1 / 256) / (1 - 1 / 256)
                    i, j = np.arange(old, len(nodes))[:, None], np.arange(len(nodes))[None, :]
                    alike[(j >= i) | (j < i - REACH) | (comps[old:, None] == comps[None, :]) | (alike < LEAST_ALIKE)] = 0
                    for r in np.flatnonzero(alike.any(axis=1)):
                        c = np.flatnonzero(alike[r])
                        c = c[np.argsort(-alike[r, c], kind="stable")[:best]]
                        a_out.append(np.full(len(c), nodes[old + r]))
                        b_out.append(nodes[c])
                    nodes, lows, comps = nodes[-REACH:], lows[-REACH:], comps[-REACH:]
            x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a_out, b_out))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return run


def proposals(classes: DataFrame, best: int, labels: DataFrame | None = None) -> DataFrame:
    """Pairs (a < b) of neighbours in the sorted orders; with labels only of different components."""
    c = classes.select("node", "sig", "low")
    c = c.withColumn("comp", F.col("node")) if labels is None else c.join(if_small(labels), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))
    rows = c.select("node", "sig", "low", "comp", tree.alias("tree")).select("tree", F.expr(f"substring(sig, tree * {4 * DEPTH} + 1, {4 * DEPTH})").alias("part"), "node", "low", "comp")
    order = ["tree", "part", "node"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_proposals(best), "a long, b long").distinct()


def dealt(pairs: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs by task, and the nodes that each task needs.

    Pairs around a common neighbour share a task, so a node's data travel about once. A bundle of
    many pairs, or of large sets, is split by their hashes, and there are so many tasks that one
    holds a bounded number of pairs and of shingles (or a single bundle, at least a single pair).
    """
    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y")))
    near = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m")).join(classes.select(F.col("node").alias("x"), "n"), "x")
    end = lambda c: near.select(F.col("x").alias(c), F.col("m").alias("m" + c), F.col("n").alias("n" + c))
    p = materialize(pairs.join(end("a"), "a").join(end("b"), "b").select("a", "b", F.least("ma", "mb").alias("bundle"), (F.col("na") + F.col("nb")).alias("w")))
    total = p.agg(F.count("*").alias("pairs"), F.coalesce(F.sum("w"), F.lit(0)).alias("w")).first()
    tasks = max(1, -(-total["pairs"] // PAIRS_PER_TASK), -(-total["w"] // SHINGLES_PER_TASK))
    parts = F.greatest(F.ceil(F.count("*") / PAIRS_PER_BUNDLE), F.ceil(F.sum("w") / SHINGLES_PER_BUNDLE))
    large = p.groupBy("bundle").agg(parts.alias("parts")).where("parts > 1")
    part = F.pmod(F.xxhash64("a", "b"), F.coalesce("parts", F.lit(1)))
    bundled, p = p, materialize(p.join(if_small(large), "bundle", "left").select(F.pmod(F.xxhash64("bundle", part), F.lit(tasks)).alias("task"), "a", "b"))
    discard(bundled)
    return p, p.select(F.col("task").alias("for_task"), F.col("a").alias("node")).union(p.select("task", "b")).distinct()


def likely(pairs: DataFrame, classes: DataFrame, frequent) -> DataFrame:
    """The pairs whose heads allow the wanted overlap: what stands, in the order of all shingles, before both heads' ends is known of both sets."""
    p, needed = dealt(pairs, classes)
    moved = classes.select("node", "n", "head").join(if_small(materialize(needed)), "node").select("for_task", "node", "n", "head")

    def check(pairs_pdf, heads_pdf):
        import pandas as pd

        held = {}
        for node, n, h in zip(heads_pdf["node"], heads_pdf["n"], heads_pdf["head"], strict=True):
            held[node] = n, places(np.frombuffer(h, "<u8"), *frequent.value)
        keep = []
        for a, b in zip(pairs_pdf["a"], pairs_pdf["b"], strict=True):
            (n, x), (m, y) = held[a], held[b]
            end = min(x[-1], y[-1])
            x, y = x[: np.searchsorted(x, end, "right")], y[: np.searchsorted(y, end, "right")]
            if len(np.intersect1d(x, y, assume_unique=True)) + min(n - len(x), m - len(y)) >= needed_overlap(n, m):
                keep.append((a, b))
        return pd.DataFrame(keep, columns=["a", "b"], dtype="int64")

    return p.groupBy("task").cogroup(moved.groupBy("for_task")).applyInPandas(check, "a long, b long")


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The pairs whose full sets are alike enough, from the texts that stand for their classes; no other text moves where these are few."""
    p, needed = dealt(pairs, classes)
    needed = materialize(needed.join(classes.select("node", "rep"), "node").select("for_task", "rep"))
    moved = docs.select("doc_id", text_of(text_col).alias("t")).join(if_small(needed), F.col("doc_id").eqNullSafe(F.col("rep"))).select("for_task", "t")

    def check(pairs_pdf, texts_pdf):
        import pandas as pd

        words, held = WordHashes(), {}
        for t in texts_pdf["t"]:
            s = shingles(t, words)
            if len(s):
                held[nodes_of(s)[0]] = s
        keep = []
        for a, b in zip(pairs_pdf["a"], pairs_pdf["b"], strict=True):
            x, y = held[a], held[b]
            if min(len(x), len(y)) * DENOMINATOR >= NUMERATOR * max(len(x), len(y)) and len(np.intersect1d(x, y, assume_unique=True)) >= needed_overlap(len(x), len(y)):
                keep.append((a, b))
        return pd.DataFrame(keep, columns=["a", "b"], dtype="int64")

    return p.groupBy("task").cogroup(moved.groupBy("for_task")).applyInPandas(check, "a long, b long")


def _met(x: np.ndarray, y: np.ndarray, same: bool):
    """Pairs of holders of a shingle that are of different components and may be alike enough; both are sorted by size, y's are the larger ones (or x, if same)."""
    xn, yn = x["n"].astype(np.int64), y["n"].astype(np.int64)
    for k in range(len(y)):
        to = slice(np.searchsorted(xn, -(-NUMERATOR * yn[k] // DENOMINATOR)), k if same else len(x))
        most = np.minimum(xn[to] - x["pos"][to], yn[k] - y["pos"][k])
        ok = (x["comp"][to] != y["comp"][k]) & (most >= needed_overlap(xn[to], yn[k]))
        if ok.any():
            other = x["node"][to][ok]
            yield np.minimum(other, y["node"][k]), np.maximum(other, y["node"][k])


def _blocks(group: np.ndarray):
    """A large group, sorted by size, as the pairs of its blocks that may hold a link; right is null where a block meets itself."""
    held = np.empty(len(group), HOLDER)
    for c in HOLDER.names:
        held[c] = group[c]
    parts = [held[lo : lo + HOT_GROUP // 2] for lo in range(0, len(held), HOT_GROUP // 2)]
    ends = [(int(x["comp"].min()), int(x["comp"].max())) for x in parts]
    for j, y in enumerate(parts):
        for i in range(j, -1, -1):
            if DENOMINATOR * int(parts[i]["n"][-1]) < NUMERATOR * int(y["n"][0]):
                break  # sizes only shrink from here
            if len({*ends[i], *ends[j]}) > 1:
                yield parts[i].tobytes(), None if i == j else y.tobytes()


def _met_blocks(batches):
    """The pairs within pairs of blocks."""
    for batch in batches:
        for left, right in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = np.frombuffer(left, HOLDER)
            found = list(_met(x, x if right is None else np.frombuffer(right, HOLDER), right is None))
            if found:
                a, b = (np.concatenate(v) for v in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _meetings(batches):
    """Pairs of nodes of different components that share a prefix shingle, and of hot shingles the pairs of blocks; a task holds all tokens of its shingles."""
    blobs = []
    for b in batches:
        for keys, pos, runs in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            runs = np.frombuffer(runs, RUN)
            t = np.empty(len(keys) // 8, TOKEN)
            t["key"], t["pos"] = np.frombuffer(keys, "<u8"), np.frombuffer(pos, "<i4")
            for c in ("node", "comp", "n"):
                t[c] = np.repeat(runs[c], runs["k"])
            blobs.append(t)
    if not blobs:
        return
    rows = np.concatenate(blobs)
    del blobs
    rows = rows[np.argsort(rows["key"], kind="stable")]
    starts = np.concatenate([[0], np.flatnonzero(rows["key"][1:] != rows["key"][:-1]) + 1])
    ends = np.concatenate([starts[1:], [len(rows)]])
    mixed = np.minimum.reduceat(rows["comp"], starts) != np.maximum.reduceat(rows["comp"], starts)
    a, b, size = [], [], 0
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("left", pa.binary()), ("right", pa.binary())])

    def out():
        x, y = pa.array(np.concatenate(a)), pa.array(np.concatenate(b))
        return pa.RecordBatch.from_arrays([x, y, pa.nulls(len(x), pa.binary()), pa.nulls(len(x), pa.binary())], schema=schema)

    two = starts[mixed & (ends - starts == 2)]  # most groups, at once
    x, y = rows[two], rows[two + 1]
    n, m = x["n"].astype(np.int64), y["n"].astype(np.int64)
    ok = np.minimum(n - x["pos"], m - y["pos"]) >= needed_overlap(n, m)
    if ok.any():
        a.append(np.minimum(x["node"], y["node"])[ok])
        b.append(np.maximum(x["node"], y["node"])[ok])
        size = int(ok.sum())
    for k in np.flatnonzero(mixed & (ends - starts > 2)):
        g = rows[starts[k] : ends[k]]
        g = g[np.argsort(g["n"], kind="stable")]
        if len(g) > HOT_GROUP:
            for x, y in _blocks(g):
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([x], pa.binary()), pa.array([y], pa.binary())], schema=schema)
            continue
        for x, y in _met(g, g, True):
            a.append(x)
            b.append(y)
            size += len(x)
            if size > 100_000:
                yield out()
                a, b, size = [], [], 0
    if size:
        yield out()


def exact_pairs(classes: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a < b) of nodes of different components that may be alike enough, written: no pair that is is left out.

    A task gets a range of hashed shingles, in blobs: shingles and their places, and runs of a node, its component and size.
    Groups of more than HOT_GROUP nodes leave it as pairs of blocks, which other tasks compare.
    """
    total = classes.agg(F.sum(F.octet_length("head") / 8).alias("n")).first()["n"] or 0
    tasks = max(1, -(-int(total) // TOKENS_PER_TASK))

    def blobs(batches):
        for b in batches:
            node, n, comp = (b.column(i).to_numpy() for i in range(3))
            heads, at = b.column(3), 0
            while at < len(node):
                part, size, lo = [], 0, at
                while at < len(node) and size < BATCH_BYTES // 8:
                    part.append(np.frombuffer(heads[at].as_py(), "<u8"))
                    size += part[-1].nbytes
                    at += 1
                k = np.array([len(x) for x in part])
                key = np.concatenate(part)
                row, pos = np.repeat(np.arange(lo, at), k), np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                to = (key >> np.uint64(16)) % np.uint64(tasks)
                by = np.argsort(to, kind="stable")
                key, row, pos, to = key[by], row[by], pos[by].astype("<i4"), to[by]
                ends = np.concatenate([np.flatnonzero(to[1:] != to[:-1]) + 1, [len(to)]])
                out, x = [], 0
                for y in ends:
                    first = np.concatenate([[0], np.flatnonzero(np.diff(row[x:y])) + 1])
                    runs = np.empty(len(first), RUN)
                    runs["node"], runs["comp"], runs["n"] = (v[row[x:y][first]] for v in (node, comp, n))
                    runs["k"] = np.diff(np.concatenate([first, [y - x]]))
                    out.append((int(to[x]), key[x:y].tobytes(), pos[x:y].tobytes(), runs.tobytes()))
                    x = y
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["task", "keys", "pos", "runs"])

    rows = classes.select("node", "n", "head").join(if_small(labels), "node", "left").select("node", F.col("n").cast("int").alias("n"), F.coalesce("comp", "node").alias("comp"), "head")
    tokens = rows.mapInArrow(blobs, "task int, keys binary, pos binary, runs binary")
    met = materialize(tokens.repartitionById(tasks, F.col("task")).mapInArrow(_meetings, "a long, b long, left binary, right binary").distinct())
    hot = met.where("left IS NOT NULL").select("left", "right")
    n = hot.count()
    if not n:
        return met
    more = hot.repartition(-(-n // BLOCKS_PER_TASK)).mapInArrow(_met_blocks, "a long, b long")
    pairs = materialize(met.where("left IS NULL").select("a", "b").unionByName(more).distinct())
    discard(met)
    return pairs


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The components after more links."""
    return materialize(components(labels.where("node <> comp").select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(links)))


def components(edges: DataFrame) -> DataFrame:
    """node, comp (its component's smallest node) for the nodes of the edges, by alternating stars.

    Each round is a few joins on node ids and is written to the shared folder; rounds grow with
    the logarithm of the longest path.
    """
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        last, e = e, materialize(small)
        discard(last)
        now = e.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v") % 1_000_003), F.lit(0)).alias("s")).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs of nodes of different components."""
    l = labels.where("node <> comp")
    p = pairs.join(if_small(l.select(F.col("node").alias("a"), F.col("comp").alias("ca"))), "a", "left").join(if_small(l.select(F.col("node").alias("b"), F.col("comp").alias("cb"))), "b", "left")
    return p.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def linked(classes: DataFrame, docs: DataFrame, frequent, text_col: str = "text") -> DataFrame:
    """node, comp: the components of all nodes that have a link. Passes that have no pairs are skipped."""

    def more(labels: DataFrame, pairs: DataFrame, by_heads: bool = False) -> DataFrame:
        """The components after the links among the pairs, a table that goes when it is read."""
        if pairs.isEmpty():
            discard(pairs)
            return labels
        if by_heads:
            all_pairs, pairs = pairs, materialize(likely(pairs, classes, frequent))
            discard(all_pairs)
        links = materialize(confirmed(pairs, classes, docs, text_col))
        discard(pairs)
        if not links.isEmpty():
            labels = joined(labels, links)
        discard(links)
        return labels

    none = docs.sparkSession.createDataFrame([], "node long, comp long")
    labels = more(none, materialize(proposals(classes, BEST)))
    labels = more(labels, materialize(proposals(classes, BEST, labels)))
    rest = exact_pairs(classes, labels)
    # A share of many pairs joins most of what is left to join; what it leaves apart is tested in whole.
    for share in (64, 1) if rest.count() > 64 * PAIRS_PER_TASK else (1,):
        labels = more(labels, materialize(between(rest.where(F.pmod(F.xxhash64("a", "b"), F.lit(share)) == 0), labels)), by_heads=True)
    discard(rest)
    return labels


def near_duplicates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, text_col))  # MOST_FREQUENT at most
    sets = told_apart(materialize(shingle_sets(docs, frequent, text_col)))
    same = [F.any_value(c).alias(c if c != "n_shingles" else "n") for c in ("n_shingles", "sig", "low", "head")]
    classes = materialize(sets.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("rep"), *same))
    if classes.isEmpty():
        return sets.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    labels = linked(classes, docs, frequent, text_col)
    members = materialize(labels.join(classes.select("node", "rep"), "node"))
    least = materialize(members.groupBy("comp").agg(F.min("rep").alias("component_id")))
    named = classes.select("node", "rep").join(members.join(if_small(least), "comp").select("node", "component_id"), "node", "left").select("node", F.coalesce("component_id", "rep").alias("component_id"))
    out = materialize(sets.select("doc_id", "n_shingles", "node").join(named, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))
    discard(sets)
    discard(classes)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def kept_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One document of each group, all columns kept. Of rows that repeat a kept id one row stays.

    A row travels as one struct, so its columns may have any names.
    """
    keep = materialize(near_duplicates(docs, text_col).where("kept").select("doc_id").distinct()).alias("k")
    rows = docs.select("doc_id", whole_row(docs).alias("row")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("k.doc_id"))
    kept = rows.join(keep, same, "left_semi")
    many = materialize(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if many.isEmpty():
        return kept.select("row.*")
    again = many.alias("k")
    return kept.alias("d").join(again, same, "left_anti").unionByName(kept.alias("d").join(again, same, "left_semi").dropDuplicates(["doc_id"])).select("row.*")


def op4_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
