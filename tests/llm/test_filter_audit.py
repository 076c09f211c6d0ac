"""Every count of the filter audit against a replay document by document, and its edge cases."""

import itertools
import re
from collections import Counter

from ctxforge.llm import filter_audit

WORDS = " ".join(f"w{i}" for i in range(210))
TEXTS = [None, "", " \t\n", WORDS, WORDS, "word " * 300, "ABC " * 300, WORDS + " # $", WORDS.upper(), "é" * 2_000_000, "x y\x0b" * 400_000, WORDS + " | ABC", "a b " * 210, WORDS, "ß" * 5 + "A"]
SCHEMA = "doc_id long, text string, lang string, part string, fails int, step int, `a.b` string, least boolean, good boolean, digest binary"


def table(spark):
    rows = [(i, t, (None, "", "en", "de")[i % 4]) + (None,) * 7 for i, t in enumerate(TEXTS)]
    rows += [rows[3], rows[3], (None, WORDS, "en") + (None,) * 7, (None, "only here " + WORDS, "de") + (None,) * 7, (3, "another text of a used id", "en") + (None,) * 7]
    labels = [(i, i % 2, i % 3 == 0 or None) for i in range(len(TEXTS))] + [(3, 0, True), (5, 1, False), (None, 1, True), (999, 1, True)]
    d = spark.createDataFrame(rows, SCHEMA)
    return rows, labels, d, spark.createDataFrame([(i, q, None if t is None else int(t)) for i, q, t in labels], "doc_id long, quality int, toxic int")


def brute(rows, labels):
    text = [r[1] or "" for r in rows]
    out, parts = {}, sorted({r[2] or "" for r in rows})
    fails = []
    for r, t in zip(rows, text, strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        fails.append(f | {"E": r[0] is not None and any(s[0] is not None and s[0] < r[0] and u == t for s, u in zip(rows, text, strict=True))})
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x and i is not None}
    total = Counter()
    for part in parts:
        for order in map("".join, itertools.permutations("ABCDE")):
            live = [i for i, r in enumerate(rows) if (r[2] or "") == part]
            every = live
            for step, c in enumerate(order, 1):
                gone = [i for i in live if fails[i][c]]
                redundant = sum(fails[i][c] for i in every) - len(gone)
                live = [i for i in live if not fails[i][c]]
                only = sum(fails[i][c] and sum(fails[i].values()) == 1 for i in every)
                out[part, order, step] = (len(live), len(gone), redundant, only, sum(rows[i][0] in good for i in gone), sum(rows[i][0] in toxic for i in gone))
                total[part, c] += len(gone)
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit(spark):
    rows, labels, d, lab = table(spark)
    got = filter_audit.filter_audit(d, lab).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in got} == brute(rows, labels) and len(got) == 3 * 600
    assert got[0].__fields__ == ["part", "filter_order", "step", *filter_audit.COUNTS, "shapley"]


def test_filter_audit_of_nothing(spark):
    _, _, d, lab = table(spark)
    assert filter_audit.filter_audit(d.limit(0), lab).count() == 0
    assert filter_audit.filter_audit(d, lab.limit(0)).where("good_lost + toxic_lost > 0").count() == 0
    named = d.selectExpr("concat('d', doc_id) AS doc_id", "text", "lang").unionByName(spark.createDataFrame([("d", WORDS, "en")], "doc_id string, text string, lang string"))
    assert filter_audit.filter_audit(named, lab.selectExpr("concat('d', doc_id) AS doc_id", "quality", "toxic")).count() == 3 * 600


def test_hot_text_stays_split(spark):
    """A third of all rows hold one text: its copies are told apart by digest and id, so no join key holds more than one document."""
    d = spark.range(30_000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'the same' ELSE concat('text ', id) END AS text", "'en' AS lang")
    f = filter_audit.flags(d, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert f.where("fails & 16 <> 0").count() == 9_999
