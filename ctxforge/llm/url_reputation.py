"""URL filter: explicit rules first, else an empirical-Bayes reputation of the host.

Labelled page outcomes are counted per host. A beta-binomial prior is fitted by moments for
each step of the hierarchy and counts are shrunk from suffix to registered domain to host:
a level's posterior mean is the prior mean of the level below. A host's share of good pages
has a beta posterior; a url is blocked when that share lies, with probability ``CERTAIN``,
below ``WORSE`` times the share of the whole corpus, that is when the upper posterior bound
lies below it. A host without outcomes has its domain's, else its suffix's mean as the prior.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule
and is judged as any host; labels with a null id or a null quality are left out; several
labels of one page, equal or contradictory, all count; repeated pages give repeated rows and
count once each for their host; very long urls are read whole; without labels, or with labels
of one kind only, nothing is blocked but by rules; an empty table gives no rows; columns other
than page_id, url, doc_id and quality are not looked at, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, UPPER, if_small, materialize, table

#: The rules of the query: verdict, host and its subdomains, path prefix.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Suffixes of two labels that the query knows; any other suffix is the last label. A longer list is a parameter.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")
WORSE, CERTAIN = 0.95, 0.95
URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_parts(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(u, URL_PARTS, 1), UPPER, LOWER), F.regexp_extract(u, URL_PARTS, 2)


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null without one. For lists of up to some hundred rules."""
    name = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def host_levels(host: Column, suffixes=TWO_LABEL_SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and suffix of a host: the suffix is the longest of the list that the host ends with, else its last label; the domain has a label more."""
    last = lambda k: F.substring_index(host, ".", -k)
    domain, suffix = last(2), last(1)
    by_labels: dict[int, list[str]] = {}
    for s in suffixes:
        by_labels.setdefault(s.count(".") + 1, []).append(s)
    for k in sorted(by_labels):
        listed = last(k).isin(*by_labels[k])
        domain, suffix = F.when(listed, last(k + 1)).otherwise(domain), F.when(listed, last(k)).otherwise(suffix)
    return domain, suffix


def concentration(groups: DataFrame) -> DataFrame:
    """One row ``k``: the prior's weight in pages, from the variance between and within groups (n, good)."""
    s = groups.agg(F.count("*").alias("g"), F.sum("n").alias("n"), F.sum("good").alias("y"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("good") * F.col("good") / F.col("n")).alias("yy"))
    mu = F.col("y") / F.col("n")
    between = (F.col("yy") - F.col("n") * mu * mu) / (F.col("g") - 1)
    within = (F.col("y") - F.col("yy")) / (F.col("n") - F.col("g"))
    n0 = (F.col("n") - F.col("nn") / F.col("n")) / (F.col("g") - 1)
    s = s.withColumn("b", F.when(F.col("g") > 1, between)).withColumn("w", F.when((F.col("n") > F.col("g")) & (F.col("g") > 0), within)).withColumn("n0", F.when(F.col("g") > 1, n0))
    rho = F.when((F.col("b") + (F.col("n0") - 1) * F.col("w")) > 0, (F.col("b") - F.col("w")) / (F.col("b") + (F.col("n0") - 1) * F.col("w")))
    rho = F.least(F.greatest(F.coalesce(rho, F.lit(0.001)), F.lit(0.001)), F.lit(0.5))
    return s.select((1 / rho - 1).alias("k"))


def beta_below(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """P(share < x) of beta distributions, by the continued fraction of the incomplete beta function; 0 where one is degenerate."""
    x, a, b = (np.asarray(v, np.float64) for v in np.broadcast_arrays(x, a, b))
    good = (x > 0) & (x < 1) & (a > 0) & (b > 0)
    x, a, b = (np.where(good, v, 0.5) for v in (x, a, b))
    swap = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(swap, 1 - x, x), np.where(swap, b, a), np.where(swap, a, b)
    tiny = 1e-300
    safe = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(x), 1 / safe(1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 100_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        last = h
        for k in (even, odd):
            d, c = 1 / safe(1 + k * d), safe(1 + k / c)
            h = h * d * c
        if (np.abs(h - last) <= 1e-13 * np.abs(h)).all():
            break
    log_gamma = np.vectorize(math.lgamma, otypes=[np.float64])
    front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(x) + b * np.log1p(-x)) / a if len(x) else x
    return np.where(good, np.where(swap, 1 - front * h, front * h), 0.0)


def host_reputation(pages: DataFrame, labels: DataFrame, worse: float = WORSE, suffixes=TWO_LABEL_SUFFIXES) -> DataFrame:
    """host, mean, risk: for every host of ``pages`` its posterior mean, and the probability that its share of good pages lies below the bound."""
    host, _ = url_parts(F.col("url"))
    good = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("page_id")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"))
    hosts = pages.select("page_id", host.alias("host")).join(good, "page_id", "left").groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    domain, suffix = host_levels(F.col("host"), suffixes)
    hosts = materialize(hosts.withColumn("domain", domain).withColumn("suffix", suffix))
    seen = hosts.where("n > 0")
    total = seen.agg(F.coalesce(F.sum("good") / F.sum("n"), F.lit(1.0)).alias("m0"))  # one row
    by_suffix = seen.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    by_domain = seen.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    one = F.broadcast(total.crossJoin(concentration(by_suffix).select(F.col("k").alias("k_s"))).crossJoin(concentration(by_domain).select(F.col("k").alias("k_d"))).crossJoin(concentration(seen).select(F.col("k").alias("k_h"))))
    out = hosts.join(if_small(by_suffix.select("suffix", F.col("n").alias("n_s"), F.col("good").alias("y_s"))), "suffix", "left").join(if_small(by_domain.select("domain", F.col("n").alias("n_d"), F.col("good").alias("y_d"))), "domain", "left").crossJoin(one)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = out.withColumn("m_s", (F.col("m0") * F.col("k_s") + zero("y_s")) / (F.col("k_s") + zero("n_s")))
    out = out.withColumn("m_d", (F.col("m_s") * F.col("k_d") + zero("y_d")) / (F.col("k_d") + zero("n_d")))
    out = out.select("host", (F.col("m_d") * F.col("k_h") + F.col("good")).alias("a"), ((1 - F.col("m_d")) * F.col("k_h") + F.col("n") - F.col("good")).alias("b"), (worse * F.col("m0")).alias("x"))

    def risks(batches):
        for r in batches:
            a, b, x = (r.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            yield pa.RecordBatch.from_arrays([r.column(0), pa.array(a / np.maximum(a + b, 1e-300)), pa.array(beta_below(x, a, b))], names=["host", "mean", "risk"])

    return out.mapInArrow(risks, "host string, mean double, risk double")


def url_filter(pages: DataFrame, labels: DataFrame, rules=RULES, worse: float = WORSE, certain: float = CERTAIN, suffixes=TWO_LABEL_SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict. ``suffixes`` are those of several labels, such as a public list's thousands, in lower case."""
    host, path = url_parts(F.col("url"))
    rep = if_small(materialize(host_reputation(pages, labels, worse, suffixes).select("host", "risk")))
    out = pages.select("page_id", host.alias("host"), path.alias("path")).join(rep, "host", "left")
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    by_host = F.when(F.col("risk") >= certain, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_host).alias("verdict"))


def op8_url_reputation(spark, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def _k_sql(src: str) -> str:
    return f"""(SELECT 1 / least(greatest(coalesce(CASE WHEN b + (n0 - 1) * w > 0 THEN (b - w) / (b + (n0 - 1) * w) END, 0.001), 0.001), 0.5) - 1 AS k FROM (
 SELECT CASE WHEN g > 1 THEN (yy - n * (y / n) * (y / n)) / (g - 1) END AS b, CASE WHEN n > g AND g > 0 THEN (y - yy) / (n - g) END AS w,
        CASE WHEN g > 1 THEN (n - nn / n) / (g - 1) END AS n0
 FROM (SELECT count(*)::DOUBLE AS g, sum(n)::DOUBLE AS n, sum(good)::DOUBLE AS y, sum(n * n)::DOUBLE AS nn, sum(good * good / n::DOUBLE) AS yy FROM {src})))"""


_SUF2 = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)
_FITS = [(k, h + p, f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')") for k, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
ORACLE = rf"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{URL_PARTS}', 1), '{UPPER}', '{LOWER}') AS host,
                  regexp_extract(coalesce(url, ''), '{URL_PARTS}', 2) AS path FROM pages),
l AS (SELECT doc_id AS page_id, count(*) AS n, sum((quality = 1)::INT) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
h0 AS (SELECT host, coalesce(sum(n), 0) AS n, coalesce(sum(good), 0) AS good FROM p LEFT JOIN l USING (page_id) GROUP BY host),
h1 AS (SELECT *, string_split(host, '.') AS a FROM h0),
h2 AS (SELECT host, n, good, array_to_string(a[-2:], '.') AS l2, array_to_string(a[-3:], '.') AS l3, a[-1] AS l1 FROM h1),
hosts AS (SELECT host, n, good, CASE WHEN l2 IN ({_SUF2}) THEN l3 ELSE l2 END AS domain, CASE WHEN l2 IN ({_SUF2}) THEN l2 ELSE l1 END AS suffix FROM h2),
seen AS (SELECT * FROM hosts WHERE n > 0),
s AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM seen GROUP BY 1),
d AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM seen GROUP BY 1, 2),
one AS (SELECT coalesce((SELECT sum(good) / sum(n)::DOUBLE FROM seen), 1.0) AS m0, {_k_sql('s')} AS k_s, {_k_sql('d')} AS k_d, {_k_sql('seen')} AS k_h),
a AS (SELECT hosts.*, m0, k_d, k_h, (m0 * k_s + coalesce(s.good, 0)) / (k_s + coalesce(s.n, 0)) AS m_s, coalesce(d.n, 0) AS n_d, coalesce(d.good, 0) AS y_d
      FROM hosts CROSS JOIN one LEFT JOIN s USING (suffix) LEFT JOIN d USING (domain)),
b AS (SELECT *, (m_s * k_d + y_d) / (k_d + n_d) AS m_d FROM a),
c AS (SELECT host, m_d * k_h + good AS a, (1 - m_d) * k_h + n - good AS b, {WORSE} * m0 AS x FROM b),
-- the incomplete beta function as a power series, its terms by logarithms
rep AS (SELECT host, CASE WHEN x > 0 AND x < 1 AND a > 0 AND b > 0 THEN exp(a * ln(x) + b * ln(1 - x) - ln(a) + lgamma(a + b) - lgamma(a) - lgamma(b))
 * list_sum(list_transform(range(0, 20000), lambda i: exp(lgamma(a + b + i) - lgamma(a + b) - lgamma(a + 1 + i) + lgamma(a + 1) + i * ln(x)))) ELSE 0 END AS risk FROM c)
SELECT page_id, host, path, CASE {' '.join(f"WHEN {f} THEN '{r}'" for _, r, f in _FITS)} END AS rule,
       CASE {' '.join(f"WHEN {f} THEN '{k}'" for k, _, f in _FITS)} WHEN risk >= {CERTAIN} THEN 'block' ELSE 'allow' END AS verdict
FROM p LEFT JOIN rep USING (host)
"""
