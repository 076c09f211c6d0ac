"""Batch retrieval: recall by terms, an explainable relevance, a diverse top k."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules as R
from ..functions import text as T
from ..sources.scratch import written
from . import store


def parse_queries(queries: DataFrame) -> DataFrame:
    q = F.col("query")
    return queries.select("query_id", "root", "query", T.clamp_topk(F.col("top_k")).alias("top_k"), T.tokenize(q).alias("terms"), T.detect_intent(q, 1).alias("kinds"), T.detect_intent(q, 2).alias("segs"), T.detect_intent(q, 3).alias("roles"))


def recall(parsed: DataFrame, keywords: DataFrame) -> DataFrame:
    """query_id, root, path, keyword_count: files with a term, and how many of the base ones. One join serves both."""
    return counted(asked_terms(parsed).join(keywords, ["root", "term"]))


def asked_terms(parsed: DataFrame) -> DataFrame:
    return parsed.select("query_id", "root", F.explode("terms").alias("term"))


def counted(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query_id", "root", "path").agg(F.sum(F.when(F.col("from_symbol") == 0, F.col("count")).otherwise(0)).cast("int").alias("keyword_count"))


def recall_all(parsed: DataFrame, hits: DataFrame, summary: DataFrame) -> DataFrame:
    """hits, and for queries without any every file of their root."""
    missed = parsed.select("query_id", "root").join(hits.select("query_id").distinct(), "query_id", "left_anti")
    return hits.unionByName(missed.join(summary.select("root", "path"), "root").select("query_id", "root", "path", F.lit(0).alias("keyword_count")))


def lexical(terms: Column, path: Column, kind: Column, content: Column) -> Column:
    """Points for query terms in path, kind and content."""

    def points(low: Column) -> Column:
        def add(acc: Column, t: Column) -> Column:
            n = F.floor((F.length(low) - F.length(F.replace(low, t, F.lit("")))) / F.length(t))
            points = F.when(F.contains(F.lower(path), t), R.PATH_HIT).otherwise(0.0) + F.when(F.contains(F.lower(kind), t), R.KIND_HIT).otherwise(0.0)
            return acc + points + F.least(n, F.lit(R.CONTENT_CAP)) * R.CONTENT_UNIT

        return F.aggregate(terms, F.lit(0.0), add)

    return T.once(F.lower(content), points)


def symbol_points(symbols: Column, terms: Column, kinds: Column) -> Column:
    """Exact names, then first partial ones, in the order of the terms; kinds that the query asks for; capped."""

    def of(s: Column) -> Column:
        name = F.lower(s["name"])
        step = lambda a, t: F.when(name == t, F.struct((a["p"] + R.SYMBOL_EXACT).alias("p"), F.lit(True).alias("m"))).when(~a["m"] & F.contains(name, t), F.struct((a["p"] + R.SYMBOL_PARTIAL).alias("p"), F.lit(True).alias("m"))).otherwise(a)
        points = F.aggregate(terms, F.struct(F.lit(0.0).alias("p"), F.lit(False).alias("m")), step, lambda a: a["p"])
        return points + F.when(F.array_contains(kinds, s["kind"]), s["weight"] * R.SYMBOL_KIND_UNIT).otherwise(0.0)

    return F.least(F.coalesce(F.aggregate(symbols, F.lit(0.0), lambda a, s: a + of(s)), F.lit(0.0)), F.lit(R.SYMBOL_CAP))


def score(parsed: DataFrame, candidates: DataFrame, summary: DataFrame, symbols: DataFrame) -> DataFrame:
    """Candidates with their relevance; those of none are dropped. Files and their symbols are joined after recall."""
    syms = symbols.groupBy("root", "path").agg(F.collect_list(F.struct("name", "kind", "weight")).alias("symbols"))
    c = candidates.join(parsed, ["query_id", "root"]).join(summary, ["root", "path"]).join(syms, ["root", "path"], "left")
    low, terms = F.lower("path"), F.col("terms")
    noisy = (F.col("role") == "generated-noisy") & ~F.exists(terms, lambda t: F.contains(low, t))
    wanted = F.exists("segs", lambda s: F.contains(low, F.concat(s, F.lit("/"))) | F.contains(low, F.concat(F.lit("/"), s)))
    rel = F.col("weight") + lexical(terms, F.col("path"), F.col("kind"), F.col("sample")) + F.col("keyword_count") * R.KEYWORD_UNIT + symbol_points(F.col("symbols"), terms, F.col("kinds"))
    rel = rel + F.when(wanted, R.INTENT_BOOST).otherwise(0.0) + F.when(F.array_contains("roles", F.col("role")), R.ROLE_BOOST).otherwise(0.0)
    rel = rel - F.when(F.col("size_bytes") > R.SIZE_UNIT, F.least(F.col("size_bytes") / R.SIZE_UNIT, F.lit(R.SIZE_CAP))).otherwise(0.0)
    return c.withColumn("rel", F.when(noisy, 0.0).otherwise(F.greatest(rel, F.lit(0.0)))).where("rel > 0").select("query_id", "root", "path", "kind", "weight", "role", "token_estimate", "sample", "terms", "top_k", "rel")


def normalized(scored: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """rel_norm: relevance as a share of the query's range over scored, for these rows or all.

    The range is an aggregate, so a query's candidates needn't meet in a task.
    """
    ends = scored.groupBy("query_id").agg(F.min("rel").alias("lo"), F.max("rel").alias("hi"))
    span = F.col("hi") - F.col("lo")
    out = (scored if rows is None else rows).join(ends, "query_id")
    return out.withColumn("rel_norm", F.when(span <= 0, 1.0).otherwise((F.col("rel") - F.col("lo")) / span)).drop("lo", "hi")


def top_by_relevance(scored: DataFrame) -> DataFrame:
    """The best top_k of each query. The fixed bound beside it lets each task cut its own rows before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(F.col("rel").desc(), "path")
    return scored.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= T.MAX_TOP_K) & (F.col("rank") <= F.col("top_k")))


def file_similarity(a: str, b: str) -> Column:
    """Likeness of two candidates a and b with columns path, kind, words."""
    return _similarity(lambda c: F.col(f"{a}.{c}"), lambda c: F.col(f"{b}.{c}"))


def _similarity(a, b) -> Column:
    """The same of functions that give a candidate's columns by name."""
    parts = lambda x: F.split(T.folder(x("path")), "/")
    pa, pb = parts(a), parts(b)
    most = F.greatest(F.when(T.folder(a("path")) == "", 0).otherwise(F.size(pa)), F.when(T.folder(b("path")) == "", 0).otherwise(F.size(pb)))
    run = F.aggregate(F.zip_with(pa, pb, lambda x, y: F.coalesce(x == y, F.lit(False))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, e: F.struct((s["n"] + (s["on"] & e).cast("int")).alias("n"), (s["on"] & e).alias("on")), lambda s: s["n"])
    wa, wb = a("words"), b("words")
    both = F.size(F.array_intersect(wa, wb))
    jac = F.when((F.size(wa) == 0) | (F.size(wb) == 0), 0.0).otherwise(both / (F.size(wa) + F.size(wb) - both))
    return R.SIM_DIR * F.when(most == 0, 0.0).otherwise(run / most) + R.SIM_KIND * (a("kind") == b("kind")).cast("double") + R.SIM_TERMS * jac


def shortlist(scored: DataFrame) -> DataFrame:
    """The best RECALL_FACTOR * top_k candidates of each query and the next one, with rel_norm over all of them.

    The next one bounds all that are left out. Each task cuts its own rows to the fixed bound before the shuffle.
    """
    w = Window.partitionBy("query_id").orderBy(F.col("rel").desc(), "path")
    i = F.col("i")
    best = scored.withColumn("i", F.row_number().over(w)).where((i <= T.MAX_TOP_K * R.RECALL_FACTOR + 1) & (i <= F.col("top_k") * R.RECALL_FACTOR + 1))
    return normalized(scored, best.drop("i"))


#: Estimated tokens (two words of 8 bytes each at most, far fewer as a rule) of a root's contenders that one task holds; beyond that its queries are answered by rounds.
MOST_TOKENS = 30_000_000
#: Queries of a root that one task answers, about; more are dealt over tasks.
QUERIES_A_TASK = 16


def mmr(scored: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """A greedy pick of relevant and unlike files among all scored candidates: query_id, path, rank. Without texts (root, path, sample) scored has the samples."""
    return diverse(scored, texts).select("query_id", "path", "rank")


def contenders(every: DataFrame) -> DataFrame:
    """Of normalized candidates those that the greedy pick can take, whatever the words of the files are; no text is needed to tell.

    Files of one folder and kind are like anything else up to their words, which weigh SIM_TERMS at most, and one of the best top_k
    is always left to take: a file that lies further behind the last of these never wins. So it is over all folders, where likeness weighs 1 at most.
    """
    cost = (1 - R.MMR_LAMBDA) / R.MMR_LAMBDA
    rows = every.withColumn("folder", T.folder(F.col("path")))
    for key, weigh in ((["query_id"], 1.0), (["query_id", "folder", "kind"], R.SIM_TERMS)):
        w = Window.partitionBy(*key).orderBy(F.col("rel").desc(), "path")
        last = every.withColumn("folder", T.folder(F.col("path"))).withColumn("i", F.row_number().over(w)).where((F.col("i") <= T.MAX_TOP_K) & (F.col("i") == F.col("top_k")))
        rows = rows.join(last.select(*key, F.col("rel_norm").alias("last")), key, "left").where(F.col("last").isNull() | (F.col("rel_norm") >= F.col("last") - cost * weigh - 1e-9)).drop("last")
    return rows.drop("folder").select(*every.columns)


def _picker(keep: list[str], bounded: bool):
    """The greedy pick of each query of a place: (its candidates, the hashed words of their files) to rows.

    bounded: a query's last row stands for all that are left out, and ``proven`` says whether none of them could be taken.
    """

    def pick(rows, words):
        import numpy as np
        import pyarrow as pa

        at = {p: i for i, p in enumerate(words.column("path").to_pylist())}
        lists = words.column("words").chunks
        every = [x.flatten().to_numpy() for x in lists]
        every = np.concatenate(every) if every else np.zeros(0, np.int64)
        start = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *[x.value_lengths().to_numpy() for x in lists]]))]).astype(np.int64)
        out = []
        rows = rows.sort_by([("query_id", "ascending"), ("rel", "descending"), ("path", "ascending")])
        ends = np.cumsum([0, *(c["counts"] for c in rows.column("query_id").combine_chunks().value_counts().to_pylist())]) if rows.num_rows else [0]
        for lo, hi in zip(ends[:-1], ends[1:], strict=True):
            out.append(one(rows.slice(lo, hi - lo), at, every, start, np, pa))
        return pa.concat_tables(out) if out else rows.select(keep).append_column("rank", pa.array([], pa.int32())).append_column("proven", pa.array([], pa.bool_()))

    def one(table, at, every, start, np, pa):
        n, k = table.num_rows, table.column("top_k")[0].as_py()
        paths = table.column("path").to_pylist()
        file = np.array([at[p] for p in paths])
        size = start[file + 1] - start[file]
        dirs = [p.rpartition("/")[0] for p in paths]
        of = {d: i for i, d in enumerate(dict.fromkeys(dirs))}
        folder, folders = np.array([of[d] for d in dirs]), [d.split("/") if d else [] for d in of]
        kinds = table.column("kind").combine_chunks().dictionary_encode().indices.to_numpy()

        def like(i):
            mine, share = folders[folder[i]], np.zeros(len(folders))
            for j, other in enumerate(folders):
                most, run = max(len(mine), len(other)), 0
                while run < min(len(mine), len(other)) and mine[run] == other[run]:
                    run += 1
                share[j] = run / most if most else 0.0
            asked = np.sort(every[start[file[i]] : start[file[i] + 1]])
            hit = asked[np.minimum(np.searchsorted(asked, every), len(asked) - 1)] == every if len(asked) else np.zeros(len(every), bool)
            sums = np.concatenate([[0], np.cumsum(hit)])
            both = sums[start[file + 1]] - sums[start[file]]
            jac = np.where((size > 0) & (size[i] > 0), both / np.maximum(size[i] + size - both, 1), 0.0)
            return R.SIM_DIR * share[folder] + R.SIM_KIND * (kinds == kinds[i]) + R.SIM_TERMS * jac

        norm, near, free, out = table.column("rel_norm").to_numpy(), np.zeros(n), np.ones(n, bool), []
        bound, proven = R.MMR_LAMBDA * norm[-1] if bounded and n > R.RECALL_FACTOR * k else -np.inf, True
        while len(out) < min(k, n):
            gain = np.where(free, R.MMR_LAMBDA * norm - (1 - R.MMR_LAMBDA) * near, -np.inf)
            i = int(gain.argmax())  # rows are sorted, so the first of equals is the one wanted
            proven = proven and bool(gain[i] >= bound)
            free[i] = False
            out.append(i)
            near = np.maximum(near, like(i))
        taken = table.select(keep).take(pa.array(out))
        return taken.append_column("rank", pa.array(range(1, len(out) + 1), pa.int32())).append_column("proven", pa.array([proven] * len(out)))

    return pick


def few(rows: DataFrame) -> DataFrame:
    """Written small rows, sent to all tasks if they are few."""
    return F.broadcast(rows) if rows.limit(store.MOST_TERMS + 1).count() <= store.MOST_TERMS else rows


def diverse(scored: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Rows that the greedy pick takes among every candidate, and their rank.

    A pick from the shortlist is right if no file left out could gain more, even if like nothing
    taken. Queries with another pick are answered from all that could be taken (``contenders``): in a task if their words fit, else by rounds.
    Words travel as hashes of 64 bits, once for all queries of a root; texts are read for the shortlist and the contenders alone.
    """
    columns, own = scored.columns, texts is None
    place = F.col("query_id" if own else "root")
    texts = (scored if own else texts).select(place.alias("place"), "path", "sample")
    cost = F.length("sample") / 2 if own else F.col("token_estimate")
    small = scored.withColumn("place", place).withColumn("cost", cost).drop("sample", "terms")
    small = small.withColumn("slice", F.lit(0)) if own else small.join(few(written(_slices(small))), "query_id")
    keep = [c for c in small.columns if c in columns and c != "top_k"]
    schema = ", ".join(f"{c} {small.schema[c].dataType.simpleString()}" for c in keep) + ", rank int, proven boolean"
    hashed = F.transform(T.tokenize(F.concat_ws(" ", "path", "sample")), lambda w: F.xxhash64(w)).alias("words")

    def words_of(rows):
        files = few(written(rows.select("place", "slice", "path").distinct()))
        return files.join(texts, ["place", "path"]).select("place", "slice", "path", hashed)

    def picked(rows, bounded):
        return written(rows.groupBy("place", "slice").cogroup(words_of(rows).groupBy("place", "slice")).applyInArrow(_picker(keep, bounded), schema))

    taken = picked(written(shortlist(small)), True)
    open_ones = taken.where("NOT proven").select("query_id").distinct()
    taken = taken.where("proven").drop("proven")
    if open_ones.isEmpty():
        return taken
    rest = written(contenders(normalized(small.join(F.broadcast(open_ones), "query_id", "left_semi"))))
    files = rest.groupBy("place", "slice", "path").agg(F.max("cost").alias("cost"))
    large = written(files.groupBy("place", "slice").agg(F.sum("cost").alias("n")).where(F.col("n") > MOST_TOKENS).select("place", "slice"))
    taken = taken.unionByName(picked(rest.join(F.broadcast(large), ["place", "slice"], "left_anti"), False).drop("proven"))
    if large.isEmpty():
        return taken
    rest = rest.join(F.broadcast(large), ["place", "slice"], "left_semi")
    return taken.unionByName(picked_by_rounds(rest.join(words_of(rest), ["place", "slice", "path"]).drop("place", "slice", "cost")).select(taken.columns))


def _slices(rows: DataFrame) -> DataFrame:
    """query_id, slice: the queries of a root dealt over slices of QUERIES_A_TASK, about."""
    asked = rows.select("query_id", "root").distinct()
    many = asked.groupBy(F.col("root").alias("of")).agg(F.ceil(F.count("*") / QUERIES_A_TASK).cast("int").alias("slices"))
    return asked.join(many, F.col("root").eqNullSafe(F.col("of"))).select("query_id", F.pmod(F.xxhash64("query_id"), F.col("slices")).cast("int").alias("slice"))


def picked_by_rounds(rows: DataFrame) -> DataFrame:
    """The greedy pick by an aggregate over all candidates a round, so a query's candidates needn't meet in a task. Rows are written once and read in each round."""
    columns, out, rank = rows.columns, [], 1
    rows = written(rows)
    left = rows.withColumn("near", F.lit(0.0))
    gain = R.MMR_LAMBDA * F.col("rel_norm") - (1 - R.MMR_LAMBDA) * F.col("near")
    while True:
        first = F.min_by(F.struct(*columns), F.struct(-gain, -F.col("rel"), "path"))
        best = written(left.where(F.col("top_k") >= rank).groupBy("query_id").agg(first.alias("x")).select("x.*"))
        if best.isEmpty():
            break
        out.append(best.withColumn("rank", F.lit(rank)))
        so_far = functools.reduce(DataFrame.unionByName, out).groupBy("query_id").agg(F.collect_list(F.struct("path", "kind", "words")).alias("taken"))
        near = F.greatest(F.array_max(F.transform("taken", lambda t: _similarity(F.col, lambda c: t[c]))), F.lit(0.0))
        met = rows.join(so_far, "query_id").where(~F.exists("taken", lambda t: t["path"] == F.col("path")))
        left = met.withColumn("near", near).select(*columns, "near")
        rank += 1
    return functools.reduce(DataFrame.unionByName, out)


def candidates(parsed: DataFrame, fulltext: DataFrame, keywords: DataFrame, summary: DataFrame) -> DataFrame:
    """query_id, root, path, keyword_count: full-text hits first (they count no keywords); queries without any fall back to keywords, those without these to all files of their root."""
    first = written(recall_fulltext(parsed, fulltext))
    open_ones = parsed.join(first.select("query_id").distinct(), "query_id", "left_anti")
    hits = written(recall(open_ones, keywords))
    return first.select("query_id", "root", "path", F.lit(0).alias("keyword_count")).unionByName(recall_all(open_ones, hits, summary))


def stored_candidates(parsed: DataFrame, index_path: str, at: dict, summary: DataFrame, fulltext: bool = True) -> DataFrame:
    """The same as ``candidates`` from the postings of a stored index; without ``fulltext`` keywords recall for all queries."""
    spark = parsed.sparkSession
    most = T.MAX_TOP_K * R.RECALL_FACTOR
    asked = asked_fulltext(parsed) if fulltext else asked_fulltext(parsed).limit(0)
    first = written(first_by_path(store.hits(spark, index_path, "fulltext", asked, most, at)))
    open_ones = written(parsed.join(first.select("query_id").distinct(), "query_id", "left_anti"))
    hits = written(counted(store.hits(spark, index_path, "keywords", asked_terms(open_ones), at=at)))
    return first.select("query_id", "root", "path", F.lit(0).alias("keyword_count")).unionByName(recall_all(open_ones, hits, summary))


def stored_query(queries: DataFrame, index_path: str, number: int | None = None, fulltext: bool = True) -> DataFrame:
    """``memory_query`` over a stored index: only folders of the roots asked for are read, and of its postings only those of terms asked for."""
    spark = queries.sparkSession
    at = store.version(spark, index_path, number)
    asked = queries.select("root").distinct()
    summary, symbols = (store.read(spark, index_path, t, roots=asked, at=at) for t in ("files", "symbols"))
    parsed = parse_queries(queries)
    return answers(parsed, stored_candidates(parsed, index_path, at, summary, fulltext), summary, symbols)


def memory_query(queries: DataFrame, keywords: DataFrame, summary: DataFrame, symbols: DataFrame, fulltext: DataFrame) -> DataFrame:
    """query_id, rank, path, kind, weight, score, token_estimate, snippet.

    Texts are read to score candidates and are dropped; those of the shortlist, and for snippets those of the results, are joined again.
    Hits and scores are small rows that several steps read, so they are written once.
    """
    parsed = parse_queries(queries)
    return answers(parsed, candidates(parsed, fulltext, keywords, summary), summary, symbols)


def answers(parsed: DataFrame, found: DataFrame, summary: DataFrame, symbols: DataFrame) -> DataFrame:
    """Ranked results of parsed queries, of candidates found for them."""
    scored = written(score(parsed, found, summary, symbols).drop("sample", "terms", "role"))
    texts = summary.select("root", "path", "sample")
    picked = few(written(diverse(scored, texts))).join(texts, ["root", "path"]).join(parsed.select("query_id", "terms"), "query_id")
    return picked.select("query_id", "rank", "path", "kind", "weight", F.round("rel", 2).alias("score"), "token_estimate", T.snippet(F.col("sample"), F.col("path"), F.col("terms")).alias("snippet"))


def with_commands(results: DataFrame, queries: DataFrame, commands: DataFrame) -> DataFrame:
    """query_id, root, query, top_k, results (20 at most) and the commands of the root: what a query answers."""
    row = F.struct("rank", "path", "kind", "weight", "score", "token_estimate", "snippet")
    found = results.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("results"))
    known = commands.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("place", "name", "category", "source", "invocation", "raw"))).alias("commands"))
    out = queries.select("query_id", "root", "query", T.clamp_topk(F.col("top_k")).alias("top_k")).join(found, "query_id", "left").join(known, "root", "left")
    bare = lambda c, first: F.transform(c, lambda x: x.dropFields(first))
    empty = F.array()
    return out.select("query_id", "root", "query", "top_k", F.coalesce(bare(F.col("results"), "rank"), empty).alias("results"), F.coalesce(bare(F.col("commands"), "place"), empty).alias("commands"))


def retrieval_usage(results: DataFrame, queries: DataFrame, totals: DataFrame) -> DataFrame:
    """query_id, root, sent, ignored, total: tokens that a query's results cost, those of its root that they spare, and all of its root."""
    sent = results.groupBy("query_id").agg(F.sum("token_estimate").alias("sent"))
    out = queries.select("query_id", "root").join(sent, "query_id", "left").join(totals, "root", "left")
    s, t = F.coalesce("sent", F.lit(0)), F.coalesce("tokens", F.lit(0))
    return out.select("query_id", "root", s.cast("long").alias("sent"), F.greatest(t - s, F.lit(0)).cast("long").alias("ignored"), t.cast("long").alias("total"))


def usage_events(use: DataFrame, changed: DataFrame, latency: DataFrame | None = None) -> DataFrame:
    """The events of each query: call, token_estimate, latency, and cache_miss if its root changed since it was indexed, else cache_hit.

    use: retrieval_usage; changed: root, changed; latency: query_id, latency_ms (0 without).
    """
    rows = use.join(changed.select("root", "changed"), "root", "left")
    rows = rows.withColumn("latency_ms", F.lit(0)) if latency is None else rows.join(latency, "query_id", "left")
    zero = {"token_estimate": F.lit(0), "sent": F.lit(0), "ignored": F.lit(0), "saved": F.lit(0), "avoided": F.lit(0), "adjusted": F.lit(0), "latency_ms": F.lit(0)}
    event = lambda kind, **v: F.struct(F.lit(kind).alias("kind"), *[F.coalesce(v.get(k, z), z).cast("long").alias(k) for k, z in zero.items()])
    c = F.col
    seen = F.when(F.coalesce(c("changed"), F.lit(True)), event("cache_miss")).otherwise(event("cache_hit", saved=c("total"), avoided=c("total"), adjusted=c("ignored")))
    each = F.array(event("call"), event("token_estimate", token_estimate=c("sent"), sent=c("sent"), ignored=c("ignored")), event("latency", latency_ms=c("latency_ms")), seen)
    return rows.select("query_id", "root", F.lit("memory-query").alias("tool"), F.explode(each).alias("e")).select("query_id", "root", "tool", "e.*")


#: Fixed value: the least share of queries whose results hold an expected file.
HIT_RATE_GATE = 0.80


def first_hits(results: DataFrame, expected: DataFrame) -> DataFrame:
    """query_id, grp, first_rank (null without a hit) of each query; expected: query_id, grp, path, one row or more a query."""
    return expected.join(results.select("query_id", "path", "rank"), ["query_id", "path"], "left").groupBy("query_id", "grp").agg(F.min("rank").alias("first_rank"))


def hit_rate(results: DataFrame, expected: DataFrame) -> DataFrame:
    """grp (null: all), queries, hits, hit_rate, passed: whether results hold an expected path, against the gate."""
    hit = F.col("first_rank").isNotNull()
    out = first_hits(results, expected).rollup("grp").agg(F.count("*").alias("queries"), F.count_if(hit).alias("hits"), F.avg(hit.cast("double")).alias("hit_rate"))
    return out.withColumn("passed", F.col("hit_rate") >= HIT_RATE_GATE)


def recall_fulltext(parsed: DataFrame, fulltext: DataFrame) -> DataFrame:
    """query_id, root, path: files whose full-text document has a term, accents aside; per query the first RECALL_FACTOR * top_k by path."""
    return first_by_path(asked_fulltext(parsed).join(fulltext, ["root", "term"]))


def asked_fulltext(parsed: DataFrame) -> DataFrame:
    return parsed.select("query_id", "root", "top_k", F.explode(T.tokenize(T.fold_accents(F.col("query")))).alias("term"))


def first_by_path(hits: DataFrame) -> DataFrame:
    hits = hits.select("query_id", "root", "path", "top_k").distinct()
    w = Window.partitionBy("query_id").orderBy("path")
    i = F.col("i")
    return hits.withColumn("i", F.row_number().over(w)).where((i <= T.MAX_TOP_K * R.RECALL_FACTOR) & (i <= F.col("top_k") * R.RECALL_FACTOR)).select("query_id", "root", "path")


def similar_pairs(top: DataFrame) -> DataFrame:
    """query_id, path_a, path_b, similarity of the few top files of each query."""
    t = top.select("query_id", "path", "kind", T.tokenize(F.concat_ws(" ", "path", "sample")).alias("words"))
    a, b = t.alias("a"), t.alias("b")
    pairs = a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.path") < F.col("b.path")))
    return pairs.select(F.col("a.query_id").alias("query_id"), F.col("a.path").alias("path_a"), F.col("b.path").alias("path_b"), F.round(file_similarity("a", "b"), 6).alias("similarity"))
