"""Hot shingles, bounded tasks and passes without pairs of the near-dedup's joins."""

import random

import numpy as np
import pyarrow as pa
import pytest

from ctxforge.llm import near_dedup as nd


def tokens(seed, n_keys=12, nodes=300):
    """What a task of the exact join gets: shingles of nodes with sizes, places and components, one shingle held by all."""
    r = random.Random(seed)
    out = []
    for node in range(nodes):
        n, comp = r.choice([4, 40, 41, 44, 60, 400]), r.choice([node, 7, 9])
        keys = sorted({0, *(r.randrange(1, n_keys) for _ in range(2))})
        out += [(k, node, comp, n, pos) for pos, k in enumerate(keys)]
    return out


def blobs(held):
    runs = np.array([(node, comp, n, 1) for _, node, comp, n, _ in held], nd.RUN)
    keys, pos = np.array([t[0] for t in held], "<u8"), np.array([t[4] for t in held], "<i4")
    cols = [pa.array([0], pa.int32()), *[pa.array([c.tobytes()], pa.binary()) for c in (keys, pos, runs)]]
    return iter([pa.RecordBatch.from_arrays(cols, names=["task", "keys", "pos", "runs"])])


@pytest.mark.parametrize("hot", [2, 3, 16, 64, 1000])
def test_blocks_of_a_hot_shingle_give_all_its_pairs(monkeypatch, hot):
    held, want = tokens(hot), set()
    for i, (k, a, ca, n, p) in enumerate(held):
        for k2, b, cb, m, q in held[:i]:
            small, large = sorted((n, m))
            if k == k2 and ca != cb and 100 * small >= 75 * large and min(n - p, m - q) >= -(-75 * (n + m) // 175):
                want.add((min(a, b), max(a, b)))
    monkeypatch.setattr(nd, "HOT_GROUP", hot)
    rows = [r for batch in nd._meetings(blobs(held)) for r in batch.to_pylist()]
    pairs = {(r["a"], r["b"]) for r in rows if r["left"] is None}
    hot_rows = [r for r in rows if r["left"] is not None]
    assert bool(hot_rows) == (hot < 300)
    assert all(len(r["left"]) <= hot // 2 * nd.HOLDER.itemsize for r in hot_rows)
    for r in hot_rows:
        batch = pa.RecordBatch.from_arrays([pa.array([r["left"]], pa.binary()), pa.array([r["right"]], pa.binary())], names=["left", "right"])
        pairs |= {(x["a"], x["b"]) for out in nd._met_blocks([batch]) for x in out.to_pylist()}
    assert len(want) > 100 and pairs == want


def test_shingle_that_thousands_of_different_texts_hold(spark):
    """Texts of three common shingles and an own one: one group above HOT_GROUP, no link but the planted pair and the long texts'."""
    n = nd.HOT_GROUP + 300
    texts = [f"a b c d e f g own{i}" for i in range(n)]
    long_words = [f"w{random.Random(i).randrange(10**6)}" for i in range(200_000)]
    again = [w if i % 50 else "changed" for i, w in enumerate(long_words)]
    texts += ["p q r s t u v w x y z one", "p q r s t u v w x y z two", " ".join(long_words), " ".join(again)]
    assert len(texts[-1]) > 1_000_000
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in nd.near_duplicates(docs).collect()}
    want = {i: i for i in range(len(texts))} | {n + 1: n, n + 3: n + 2}
    assert got == want


def test_tasks_are_bounded_by_shingles(spark):
    """Pairs of large sets are dealt over more tasks than their number asks for, and bundles of them are split."""
    pairs = spark.createDataFrame([(0, i) for i in range(1, 41)], "a long, b long")
    classes = spark.createDataFrame([(i, nd.SHINGLES_PER_TASK // 4) for i in range(41)], "node long, n long")
    p, needed = nd.dealt(pairs, classes)
    tasks = {}
    for r in p.collect():
        tasks.setdefault(r.task, set()).add((r.a, r.b))
    assert sum(map(len, tasks.values())) == 40 and len(tasks) > 5
    held = {(r.for_task, r.node) for r in needed.collect()}
    assert held == {(t, n) for t, ps in tasks.items() for ab in ps for n in ab}


def test_only_texts_without_words(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, " \n"), (2, "")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_shingles, r.kept) for r in nd.near_duplicates(docs).collect()) == [("1", 0, True), ("2", 0, True), ("2", 0, True), ("None", 0, True)]
