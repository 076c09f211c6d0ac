"""Lists of public suffixes given to the URL filter."""

from pyspark.sql import functions as F

from ctxforge.llm import url_reputation as ur

HOSTS = ["a.b.co.uk", "co.uk", "uk", "x.y.github.example", "github.example", "a.city.kawasaki.jp", "b.kawasaki.jp", "", "one", "a..co.uk"]


def levels(host, suffixes):
    labels = host.split(".")
    k = max([1, *(n for n in range(1, len(labels) + 1) if ".".join(labels[-n:]) in suffixes)])
    return ".".join(labels[-k - 1 :]), ".".join(labels[-k:])


def test_host_levels(spark):
    d = spark.createDataFrame([(h,) for h in HOSTS], "host string")
    for suffixes in [(), ur.TWO_LABEL_SUFFIXES, ("uk", "co.uk", "github.example", "city.kawasaki.jp"), tuple(f"s{i}.t{i % 7}" for i in range(3000)) + ("kawasaki.jp",)]:
        domain, suffix = ur.host_levels(F.col("host"), suffixes)
        got = {r.host: (r.d, r.s) for r in d.select("host", domain.alias("d"), suffix.alias("s")).collect()}
        assert got == {h: levels(h, set(suffixes)) for h in HOSTS}


def test_a_listed_suffix_parts_its_customers(spark):
    """One bad customer of a shared suffix doesn't lower the others' means as much when the suffix is known."""
    pages = spark.createDataFrame([(i, f"http://{'bad' if i < 60 else f'good{i % 6}'}.shared.host/p{i}") for i in range(120)] + [(500, "http://new.shared.host/")], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i >= 60)) for i in range(120)], "doc_id long, quality int")
    plain = {r.host: r.mean for r in ur.host_reputation(pages, labels).collect()}
    known = {r.host: r.mean for r in ur.host_reputation(pages, labels, suffixes=("shared.host",)).collect()}
    assert known["bad.shared.host"] < plain["bad.shared.host"] + 1e-9 and known["good1.shared.host"] > plain["good1.shared.host"]
    assert ur.url_filter(pages, labels, rules=(), suffixes=("shared.host",)).count() == 121
