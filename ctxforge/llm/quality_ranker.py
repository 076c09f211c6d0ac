"""Quality classifier: Bradley-Terry scores learned from preference pairs.

A document's strength is linear in features of its whole text; of a pair, the better one wins
with the logistic probability of the difference of strengths. Pairs join good and bad labelled
documents, the loss is logistic on feature differences (with a small ridge), minimised by
Newton steps. The decision bound is the quantile of the training strengths that matches the
share of bad labels; scores are the logistic of the distance to it, so 0.5 is the bound.

The fit uses a bounded sample of labelled rows (``SAMPLE`` of either label, by hashed id);
scoring and the share of labels cover all rows.

Defined results: a null or empty text is scored like any other; very long texts are read whole;
without training labels of both kinds every score is 0.5; null labels, and labels of ids without a
document, are ignored; repeated and contradictory labels of an id all count, each as a row of its
own; ties in strength get equal scores, and 0.5 counts as good; repeated rows get equal scores; an
empty table gives no rows; columns other than doc_id, text and quality are not looked at, whatever
their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_rules import STOP_WORDS
from .shared import held_out, table, text_of

FOLDS, HELD_OUT = 3, 1
SAMPLE, RIVALS, RIDGE, STEPS = 2000, 8, 1e-2, 25
_STOP = frozenset(w.encode() for w in STOP_WORDS)
_CLASSES = [(65, 91), (97, 123), (48, 58), (128, 256), (10, 11), (32, 33)]
_MARKS = [ord(c) for c in "!|#$%&*.,?:;-_=/<>()@+"]
N_FEATURES = len(_CLASSES) + len(_MARKS) + 8


def features(text: str) -> np.ndarray:
    """Shares and lengths that don't depend on the language much."""
    raw = text.encode("utf-8", "replace")
    n = max(1, len(raw))
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.lower().split()
    m = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    out = [hist[a:b].sum() / n for a, b in _CLASSES] + [math.sqrt(hist[c] / n) for c in _MARKS]
    out += [math.log1p(len(words)), len(set(words)) / m, sum(map(len, words)) / m / 10, sum(w in _STOP for w in words) / m]
    out += [(len(lines) - len(set(lines))) / max(1, len(lines)), sum(a == b for a, b in zip(words, words[1:], strict=False)) / m, math.log1p(len(lines)), float(not words)]
    return np.array(out, np.float64)


def sample_of(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, dict]:
    """Texts of at most ``sample`` training documents of either label, and how many labels there are of each."""
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out("doc_id", FOLDS, HELD_OUT)).select("doc_id", "quality")
    totals = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    pick = [known.where(F.col("quality") == q).orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").limit(sample) for q in (0, 1)]
    chosen = F.broadcast(pick[0].unionByName(pick[1]))  # 2 * sample rows of two numbers
    return docs.select("doc_id", text_of().alias("t")).join(chosen, "doc_id"), totals


def fit(good: np.ndarray, bad: np.ndarray, bad_share: float) -> dict:
    """Weights of Bradley-Terry strengths and the bound; rows are standardised features."""
    every = np.concatenate([good, bad])
    mean, scale = every.mean(0), every.std(0) + 1e-6
    g, b = (good - mean) / scale, (bad - mean) / scale
    rng = np.random.default_rng(5)
    n = max(len(g), len(b)) * RIVALS
    d = g[np.resize(rng.permutation(len(g)), n)] - b[rng.integers(0, len(b), n)]
    w = np.zeros(d.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # the worse one wins
        grad = d.T @ p / n - RIDGE * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / n + RIDGE * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w += step
        if np.abs(step).max() < 1e-7:
            break
    s = np.concatenate([g @ w, b @ w])
    weight = np.concatenate([np.full(len(g), (1 - bad_share) / len(g)), np.full(len(b), bad_share / len(b))])
    order = np.argsort(s, kind="stable")
    i = min(max(int(np.searchsorted(np.cumsum(weight[order]), bad_share - 1e-12)), 0), len(s) - 2)
    return {"w": w, "mean": mean, "scale": scale, "bound": (s[order[i]] + s[order[i + 1]]) / 2}


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict | None:
    texts, totals = sample_of(docs, labels, sample)

    def run(batches):
        for b in batches:
            x = [features(t).tolist() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    id_type, q_type = (texts.schema[c].dataType.simpleString() for c in ("doc_id", "quality"))
    rows = texts.mapInArrow(run, f"doc_id {id_type}, quality {q_type}, x array<double>").collect()  # 2 * sample rows
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    part = {q: np.array([r["x"] for r in rows if r["quality"] == q]) for q in (0, 1)}
    if not len(part[0]) or not len(part[1]):
        return None
    return fit(part[1], part[0], totals[0] / (totals[0] + totals[1]))


def score_documents(docs: DataFrame, model: dict | None, text_col: str = "text") -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            x = np.array([features(t) for t in texts]).reshape(len(texts), N_FEATURES)
            s = np.full(len(texts), 0.5) if model is None else 1 / (1 + np.exp(-np.clip((x - model["mean"]) / model["scale"] @ model["w"] - model["bound"], -500, 500)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], names=["doc_id", "score"])

    out = docs.select("doc_id", text_of(text_col).alias("t")).mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out("doc_id", FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return score_documents(docs, train(docs, labels, sample))


def op2_quality_ranker(spark, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
