"""Queries over the supplied tables, one or more for each operator, and the SQL that states them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules as R
from ..functions import text as T
from ..operators import cache, commands, index, lint, retrieval, scan, store, symbols, usage, zones
from ..sources import adapters as A
from ..sources.scratch import scratch_dir, written
from ..sources.tree import read_tree

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NOW_MS = 1_704_100_000_000


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# --- SQL that several statements share --------------------------------------------------------

SPACE = R.UNICODE_SPACE
_TAIL_HEX = f"right(hex(encode(content)), {2 * R.TAIL_BYTES})"
_CUT = f"regexp_extract({_TAIL_HEX}, '^(?:[89AB][0-9A-F]){{0,3}}')"
#: The last bytes of content as text; each byte left of a cut character becomes U+FFFD.
TAIL = f"repeat(chr(65533), length({_CUT}) // 2) || decode(from_hex(substr({_TAIL_HEX}, length({_CUT}) + 1)))"
NAMED = f"""{A.FILES_SQL},
named AS (SELECT *, path AS p, lower(path) AS lp, lower(regexp_extract(path, '[^/]*$')) AS b, lower(regexp_extract(path, '\\.[^./]*$')) AS ext FROM files),
kinds AS (SELECT *, {R.KIND_CASE} AS kind FROM named),
classed AS (SELECT *, {R.WEIGHT_CASE} AS weight, {R.ROLE_CASE} AS role, CASE WHEN kind IN ({R.listed(R.SKIPPED_KINDS)}) THEN kind END AS class_skip FROM kinds)"""


def tokens_sql(x: str) -> str:
    bare = f"regexp_replace({x}, '{SPACE}', '', 'g')"
    a, c = f"length(regexp_replace({bare}, '[^\\x00-\\x7F]', '', 'g'))", f"length(regexp_replace({bare}, '[^{R.CJK}]', '', 'g'))"
    return f"(({a} + 3) // 4 + ({c} * 3 + 1) // 2 + ((length({bare}) - {a} - {c}) * 2 + 2) // 3)::INT"


def terms_sql(x: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(lower({x}), '[^\\p{{L}}\\p{{Nd}}]+'), lambda t: length(t) > 1))"


def ordered_terms_sql(x: str) -> str:
    raw = f"list_filter(string_split_regex(lower({x}), '[^\\p{{L}}\\p{{Nd}}]+'), lambda t: length(t) > 1)"
    return f"list_filter({raw}, lambda t, i: list_position({raw}, t) = i)"


SCANNED = f"""{NAMED},
cut AS (SELECT *, regexp_extract(p, '^(.*/)?(node_modules|dist|build|target|coverage|tmp|logs|\\.git|\\.idea|\\.gradle)/', 0) AS art FROM classed),
scanned AS (SELECT root, p AS path, mtime, kind, weight, role, strlen(content) AS size_bytes, content,
  CASE WHEN starts_with(p, 'scratch/') THEN 'scratch' WHEN art <> '' THEN rtrim(art, '/') END AS pruned_folder,
  CASE WHEN starts_with(p, 'scratch/') THEN 'gitignore' WHEN art <> '' THEN 'build_artifact' END AS pruned_reason,
  CASE WHEN starts_with(p, 'scratch/') OR art <> '' THEN NULL WHEN ends_with(p, '.tmp') THEN 'gitignore' ELSE class_skip END AS skip_reason FROM cut),
kept AS (SELECT *, CASE WHEN size_bytes > {R.LARGE_BYTES} THEN {TAIL} ELSE content END AS sample FROM scanned WHERE pruned_folder IS NULL AND skip_reason IS NULL)"""


def scanned(spark, d):
    return scan.scan(A.files(spark, d))


# --- sources and scan ---------------------------------------------------------------------------


@query("s1_read_tree", r"SELECT source AS root, sum(len(coalesce(text, '')) - len(replace(coalesce(text, ''), chr(10), '')) + 1)::BIGINT AS lines, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS bytes, 0::BIGINT AS errors FROM documents GROUP BY source")
def s1(spark, d):
    """The documents written as files below a folder for each source, read back as a tree."""
    path = scratch_dir(spark)
    A.table(spark, d, "documents").select("source", F.coalesce("text", F.lit("")).alias("value")).write.partitionBy("source").option("maxRecordsPerFile", 1000).text(path)
    lines = F.length("content") - F.length(F.replace(F.decode("content", "ISO-8859-1"), F.lit("\n"), F.lit("")))
    tree = read_tree(spark, path, "corpus").where(F.col("path").rlike("^source=[^/]*/[^._][^/]*$"))  # no checksums
    return tree.groupBy(F.regexp_extract("path", "^source=([^/]*)/", 1).alias("root")).agg(F.sum(lines).cast("long").alias("lines"), F.sum("size_bytes").alias("bytes"), F.count("error").alias("errors"))


@query("s2_sample_text", f"WITH {A.FILES_SQL} SELECT root, path, CASE WHEN strlen(content) > {R.LARGE_BYTES} THEN {TAIL} ELSE content END AS sample FROM files")
def s2(spark, d):
    return A.files(spark, d).select("root", "path", T.sample(F.col("content")).alias("sample"))


@query("p1_normalize_path", "SELECT doc_id, 'a' || (doc_id % 7) || '/c' || doc_id AS norm FROM documents")
def p1(spark, d):
    i = F.col("doc_id").cast("string")
    raw = F.concat(F.lit("./a"), (F.col("doc_id") % 7).cast("string"), F.lit("\\.\\b//../c"), i, F.lit("/"))
    return A.table(spark, d, "documents").select("doc_id", T.normalize_path(raw).alias("norm"))


@query("p2_classify_kind", f"WITH {NAMED} SELECT root, path, kind, weight, class_skip FROM classed")
def p2(spark, d):
    return scan.classify(A.files(spark, d)).select("root", "path", "kind", "weight", "class_skip")


@query("p3_prune_dirs", f"WITH {SCANNED} SELECT DISTINCT root, pruned_folder, pruned_reason FROM scanned WHERE pruned_folder IS NOT NULL")
def p3(spark, d):
    return scanned(spark, d).where("pruned_folder IS NOT NULL").select("root", "pruned_folder", "pruned_reason").distinct()


@query("p4_glob_match", f"WITH {A.FILES_SQL} SELECT root, path, starts_with(path, 'src/') AS in_src, regexp_matches(path, '^src/.*\\.ts$') AS ts_below, ends_with(path, '.md') AS md FROM files")
def p4(spark, d):
    hit = lambda g: F.col("path").rlike(scan.glob_regex(g))
    return A.files(spark, d).select("root", "path", hit("src/**").alias("in_src"), hit("src/**.ts").alias("ts_below"), hit("*.md").alias("md"))


@query("p5_ignore_rules", f"WITH {A.FILES_SQL} SELECT root, 0 AS seq, 'scratch' AS pattern, 'gitignore' AS source, true AS directory_only FROM fr UNION ALL SELECT root, 1, '*.tmp', 'gitignore', false FROM fr")
def p5(spark, d):
    return scan.ignore_rules(A.files(spark, d))


@query("p6_scan_filter", f"WITH {SCANNED} SELECT root, path, coalesce(pruned_reason, skip_reason) AS reason FROM scanned")
def p6(spark, d):
    return scanned(spark, d).select("root", "path", F.coalesce("pruned_reason", "skip_reason").alias("reason"))


_EARLY = "'user_exclude', 'include_mismatch', 'gitignore'"


@query("p6_scan_options", f"""WITH {SCANNED}, o AS (SELECT s.root, s.path, n.b, n.ext, s.kind, s.weight, CASE WHEN ends_with(s.path, '.xml') THEN 'user_exclude'
 WHEN NOT (starts_with(s.path, 'src/') OR starts_with(s.path, 'docs/')) THEN 'include_mismatch' ELSE s.skip_reason END AS reason FROM scanned s JOIN named n ON n.root = s.root AND n.p = s.path WHERE pruned_folder IS NULL AND NOT starts_with(s.path, 'types/'))
SELECT root, path, reason, CASE WHEN reason IN ({_EARLY}) THEN {R.TEXT_KIND_CASE} ELSE kind END AS kind, CASE WHEN reason IN ({_EARLY}) THEN 0 ELSE weight END AS weight FROM o""")
def p6_options(spark, d):
    out = scan.scan(A.files(spark, d), include=("src/**", "docs"), exclude=("types", "*.xml"))
    return out.where("pruned_folder IS NULL").select("root", "path", F.col("skip_reason").alias("reason"), "kind", "weight")


@query("p7_assign_role", f"WITH {NAMED} SELECT root, path, role FROM classed")
def p7(spark, d):
    return scan.classify(A.files(spark, d)).select("root", "path", F.expr(R.ROLE_CASE).alias("role"))


@query("p8_clamp_topk", "SELECT event_id, least(greatest(coalesce(CASE WHEN event_id % 5 > 0 THEN event_id % 40 - 5 END, 8), 1), 20) AS k FROM events")
def p8(spark, d):
    return A.table(spark, d, "events").select("event_id", T.clamp_topk(F.when(F.col("event_id") % 5 > 0, F.col("event_id") % 40 - 5)).alias("k"))


@query("t1_token_estimate", f"SELECT doc_id, {tokens_sql('text')} AS tokens FROM documents")
def t1(spark, d):
    return A.table(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("t2_tokenize", f"WITH {A.QUERIES_SQL} SELECT query_id, root, array_to_string({ordered_terms_sql('query')}, ' ') AS terms FROM queries")
def t2(spark, d):
    return A.queries(spark, d).select("query_id", "root", F.array_join(T.tokenize(F.col("query")), " ").alias("terms"))


@query("t3_term_rows", f"SELECT term, count(*) AS files FROM (SELECT unnest({terms_sql('text')}) AS term FROM documents) GROUP BY term")
def t3(spark, d):
    return A.table(spark, d, "documents").select(F.explode(T.tokenize(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("files"))


@query("t4_snippet", f"""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '{SPACE}+', ' ', 'g'), ' ') AS s FROM documents),
g AS (SELECT doc_id, s, CASE WHEN instr(lower(s), 'tion') > 0 THEN instr(lower(s), 'tion') WHEN instr(lower(s), 'heit') > 0 THEN instr(lower(s), 'heit') END AS a FROM f)
SELECT doc_id, CASE WHEN a IS NULL THEN left(s, 180) || CASE WHEN length(s) > 180 THEN '...' ELSE '' END
 ELSE CASE WHEN a > 91 THEN '...' ELSE '' END || substring(s, greatest(a - 91, 0) + 1, 180) || CASE WHEN greatest(a - 91, 0) + 180 < length(s) THEN '...' ELSE '' END END AS snippet FROM g""")
def t4(spark, d):
    return A.table(spark, d, "documents").select("doc_id", T.snippet(F.col("text"), F.lit("x"), F.array(F.lit("tion"), F.lit("heit"))).alias("snippet"))


_INTENT_SQL = " || ".join("CASE WHEN " + " OR ".join(f"contains(lower(query), '{t}')" for t in r[0]) + " THEN [" + R.listed(r[1]) + "] ELSE [] END" for r in R.INTENTS)


@query("t5_detect_intent", f"WITH {A.QUERIES_SQL} SELECT query_id, root, array_to_string(list_sort(list_distinct({_INTENT_SQL})), ',') AS kinds FROM queries")
def t5(spark, d):
    return A.queries(spark, d).select("query_id", "root", F.array_join(F.array_sort(T.detect_intent(F.col("query"), 1)), ",").alias("kinds"))


@query("t6_content_hash", f"WITH {A.FILES_SQL} SELECT root, path, sha256(content) AS hash FROM files")
def t6(spark, d):
    return A.files(spark, d).select("root", "path", F.sha2("content", 256).alias("hash"))


@query("t7_cache_key", """SELECT event_id, event_type || ':' || sha256('{"a":"' || user_id || '","b":"\\u003c' || event_id || '"}') || ':v1' AS key FROM events""")
def t7(spark, d):
    args = F.create_map(F.lit("b"), F.concat(F.lit("<"), F.col("event_id").cast("string")), F.lit("a"), F.col("user_id").cast("string"))
    return A.table(spark, d, "events").select("event_id", T.cache_key(F.col("event_type"), args, F.lit("")).alias("key"))


@query("t7_cache_key_nested", """SELECT event_id, event_type || ':' || sha256('{"a":{"p":[1,{"x":"\\u003c' || event_id || '","y":null}],"q":true},"z":' || user_id || '}') || ':v2' AS key FROM events""")
def t7_nested(spark, d):
    i, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    args = F.concat(F.lit('{"z": '), u, F.lit(', "a": {"q": true, "p": [1, {"y": null, "x": "<'), i, F.lit('"}]}}'))
    return A.table(spark, d, "events").select("event_id", T.cache_key_json(F.col("event_type"), args, F.lit("v2")).alias("key"))


_PROFILES = f"""{NAMED}, proots AS (SELECT DISTINCT root, regexp_replace(p, '/?[^/]*$', '') AS dir FROM named WHERE b IN ('angular.json', 'package.json', 'pom.xml', 'build.gradle', 'settings.gradle') OR b LIKE 'vite.config.%'),
sig AS (SELECT r.root, r.dir, bool_or(b = 'angular.json') AS angular, bool_or(b = 'package.json') AS package, bool_or(b IN ('pom.xml', 'build.gradle', 'settings.gradle')) AS jvm_build,
 bool_or(starts_with(b, 'vite.config.')) AS vite, bool_or(ext = '.vue') AS vue, bool_or(ext IN ('.tsx', '.jsx')) AS jsx, bool_or(ext IN ('.java', '.kt')) AS java, false AS spring
 FROM proots r JOIN named n ON n.root = r.root AND (r.dir = '' OR starts_with(n.p, r.dir || '/')) GROUP BY r.root, r.dir),
prof AS (SELECT * FROM (SELECT root, dir, {R.PROFILE_CASE} AS profile FROM sig) WHERE profile IS NOT NULL)"""


@query("f1_project_roots", f"WITH {_PROFILES} SELECT root, dir FROM proots")
def f1(spark, d):
    n = scan.with_names(A.files(spark, d))
    return n.where(F.col("b").isin("angular.json", "package.json", "pom.xml", "build.gradle", "settings.gradle") | F.col("b").startswith("vite.config.")).select("root", T.folder(F.col("p")).alias("dir")).distinct()


@query("f2_profile_signals", f"WITH {_PROFILES} SELECT root, dir, angular, package, jvm_build, vite, vue, jsx, java, spring FROM sig")
def f2(spark, d):
    return scan.profile_signals(A.files(spark, d))


@query("f3_classify_profile", f"WITH {_PROFILES} SELECT * FROM prof")
def f3(spark, d):
    return scan.profiles(A.files(spark, d))


@query("f4_profile_for_file", f"WITH {_PROFILES} SELECT f.root, f.path, arg_max(profile, length(dir)) AS profile FROM files f LEFT JOIN prof p ON p.root = f.root AND (dir = '' OR starts_with(f.path, dir || '/')) GROUP BY f.root, f.path")
def f4(spark, d):
    f = A.files(spark, d)
    return scan.profile_of_files(f, scan.profiles(f))


@query("a1_scan_totals", f"""WITH {SCANNED}, k AS (SELECT root, sum({tokens_sql('sample')})::BIGINT AS t FROM kept GROUP BY root)
SELECT root, count(*) FILTER (WHERE pruned_folder IS NULL) AS files_seen, count(*) FILTER (WHERE pruned_folder IS NULL AND skip_reason IS NULL) AS files_indexed,
 count(*) FILTER (WHERE pruned_folder IS NULL AND skip_reason IS NOT NULL) AS files_skipped, count(DISTINCT pruned_folder) AS directories_skipped, coalesce(any_value(t), 0) AS estimated_tokens
FROM scanned LEFT JOIN k USING (root) GROUP BY root""")
def a1(spark, d):
    return scan.scan_totals(scanned(spark, d))


@query("a2_skipped_summary", f"""WITH {SCANNED}, items AS (SELECT root, skip_reason AS reason, path AS item FROM scanned WHERE pruned_folder IS NULL AND skip_reason IS NOT NULL
 UNION ALL SELECT DISTINCT root, pruned_reason, pruned_folder FROM scanned WHERE pruned_folder IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY root, reason ORDER BY string_split(item, '/')) AS i, count(*) OVER (PARTITION BY root, reason) AS n FROM items)
SELECT root, reason, n AS count, string_agg(item, '|' ORDER BY i) AS examples FROM r WHERE i <= 3 GROUP BY root, reason, n""")
def a2(spark, d):
    return scan.skipped_summary(scanned(spark, d)).withColumn("examples", F.array_join("examples", "|"))


@query("a3_root_stats", f"WITH {SCANNED} SELECT root, count(*) AS files, coalesce(sum({tokens_sql('sample')}), 0)::BIGINT AS tokens FROM kept GROUP BY root")
def a3(spark, d):
    return index.root_stats(index.kept(scanned(spark, d)))


# --- symbols and index --------------------------------------------------------------------------


def _found_sql() -> str:
    """The rules of symbols line by line; a declaration that runs over several lines isn't seen this way."""
    ext = lambda *e: f"ext IN ({R.listed(e)})"
    script = ext(".vue", *symbols.SCRIPT_EXT, *symbols.JSX_EXT)
    jsx, jvm = ext(*symbols.JSX_EXT), ext(*symbols.JVM_EXT)
    has = lambda x: f"regexp_matches(head, '{x}')"
    found = [(symbols.STORE, "'store'", script), (symbols.SLICE, "'store'", script), (symbols.USES, f"CASE WHEN {jsx} THEN 'hook' ELSE 'composable' END", script)]
    found += [(p, "'route'", f"{script} AND router") for p in (symbols.ROUTE_PATH, symbols.ROUTE_TAG)]
    found += [(p, "'api-method'", f"{script} AND (contains(lp, '/service') OR contains(lp, '/api'))") for p in (symbols.FUNCTIONS, symbols.CONSTANTS)]
    found += [(symbols.SCRIPT_CLASS, f"'{k}'", f"{script} AND {has(m)}") for m, k in symbols.DECORATED]
    found += [(p, "'component'", jsx) for p in (symbols.COMPONENT_FN, symbols.COMPONENT_VAR)]
    annotated = "CASE " + " ".join(f"WHEN {has(p)} THEN '{k}'" for p, k in symbols.ANNOTATED) + " END"
    found += [(symbols.JVM_CLASS, annotated, f"{jvm} AND {annotated} IS NOT NULL"), (symbols.JVM_REPOSITORY, "'repository'", jvm), (symbols.MAPPING, "'endpoint'", jvm)]
    each = [f"SELECT root, path, unnest(regexp_extract_all(s, '{p.replace(chr(39), chr(39) * 2)}', 1)) AS name, {k} AS kind, line FROM hl WHERE {on}" for p, k, on in found]
    each += [f"SELECT root, path, base, 'component', 1 FROM hd WHERE ext = '.vue'", f"SELECT root, path, base, 'route', 1 FROM hd WHERE {script} AND router"]  # noqa: F541
    return f"""hp AS (SELECT root, path, lower(path) AS lp, regexp_extract(lower(path), '\\.[^./]*$') AS ext, regexp_replace(regexp_extract(lower(path), '[^/]*$'), '\\.[^.]*$', '') AS base, left(content, {R.HEAD_BYTES}) AS head FROM kept),
hd AS (SELECT *, {has(symbols.ROUTER)} OR contains(lp, '/router') OR contains(lp, '/routes') OR contains(lp, '-routing.module') OR base = 'router' AS router FROM hp WHERE {script} OR {jvm}),
hl AS (SELECT *, unnest(string_split(head, chr(10))) AS s, generate_subscripts(string_split(head, chr(10)), 1)::INT AS line FROM hd),
found AS (SELECT root, path, CASE WHEN name = '' AND kind = 'endpoint' THEN '/' ELSE name END AS name, kind, line FROM ({" UNION ALL ".join(each)})),
syms AS (SELECT root, path, name, kind, min(line) AS line, CASE kind {" ".join(f"WHEN '{k}' THEN {w}" for k, w in R.SYMBOL_WEIGHTS.items())} ELSE 40 END AS weight FROM found WHERE name <> '' GROUP BY ALL),
sterms AS (SELECT DISTINCT root, path, unnest({terms_sql('name')}) AS term FROM syms)"""


_SYMBOLS = f"{SCANNED}, {_found_sql()}"


def _found(spark, d):
    return symbols.extract_symbols(index.kept(scanned(spark, d)))


@query("y1_extract_symbols", f"WITH {_SYMBOLS} SELECT * FROM found")
def y1(spark, d):
    return _found(spark, d).drop("seq")


@query("y2_dedupe_symbols", f"WITH {_SYMBOLS} SELECT * FROM syms")
def y2(spark, d):
    return symbols.dedupe_symbols(_found(spark, d))


@query("y3_symbol_terms", f"WITH {_SYMBOLS} SELECT * FROM sterms")
def y3(spark, d):
    return symbols.symbol_terms(y2(spark, d))


@query("i1_base_terms", f"WITH {SCANNED} SELECT root, path, unnest({terms_sql("path || ' ' || kind || ' ' || sample")}) AS term FROM kept")
def i1_base(spark, d):
    return index.base_terms(scanned(spark, d))


_KEYWORDS = f"""{_SYMBOLS}, base AS (SELECT root, path, unnest({terms_sql("path || ' ' || kind || ' ' || sample")}) AS term FROM kept),
keywords AS (SELECT root, path, term, 0 AS from_symbol, 1 AS count FROM base UNION ALL SELECT root, path, term, 1, 1 FROM sterms ANTI JOIN base USING (root, path, term))"""


@query("i1_build_keywords", f"WITH {_KEYWORDS} SELECT * FROM keywords")
def i1(spark, d):
    s = scanned(spark, d)
    return index.build_keywords(s, symbols.symbol_terms(symbols.dedupe_symbols(symbols.extract_symbols(index.kept(s)))))


def _current(spark, d):
    k = index.kept(scanned(spark, d))
    return k.select("root", "path", "size_bytes", "mtime", F.sha2("content", 256).alias("hash"), F.lit(True).alias("readable"), "token_estimate")


def _stored(current):
    i = F.floor(F.col("mtime") / 1000)
    changed = (i % 7 == 0) & (i > 0)
    old = current.where((i % 11 != 0) | (i == 0)).select("root", "path", F.when(changed, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")).alias("size_bytes"), F.when(i % 5 == 0, F.col("mtime") + 1).otherwise(F.col("mtime")).alias("mtime"), F.when(changed, F.lit("old")).otherwise(F.col("hash")).alias("hash"))
    gone = current.where((i % 13 == 0) & (i > 0)).select("root", F.concat(F.lit("gone/"), i.cast("string"), F.lit(".ts")).alias("path"), F.lit(1).cast("long").alias("size_bytes"), F.lit(1).cast("long").alias("mtime"), F.lit("gone").alias("hash"))
    return old.unionByName(gone)


def _diff_ctes() -> str:
    return f"""cur AS (SELECT root, path, size_bytes, mtime, sha256(content) AS hash, {tokens_sql('sample')} AS token_estimate, mtime // 1000 AS i FROM kept),
old AS (SELECT root, path, CASE WHEN i % 7 = 0 AND i > 0 THEN size_bytes + 1 ELSE size_bytes END AS size_bytes, CASE WHEN i % 5 = 0 THEN mtime + 1 ELSE mtime END AS mtime, CASE WHEN i % 7 = 0 AND i > 0 THEN 'old' ELSE hash END AS hash FROM cur WHERE i % 11 <> 0 OR i = 0
 UNION ALL SELECT root, 'gone/' || i || '.ts', 1, 1, 'gone' FROM cur WHERE i % 13 = 0 AND i > 0),
diff AS (SELECT coalesce(cur.root, old.root) AS root, coalesce(cur.path, old.path) AS path, CASE WHEN cur.path IS NULL THEN 'delete' WHEN old.path IS NULL THEN 'upsert'
 WHEN cur.size_bytes = old.size_bytes AND cur.mtime = old.mtime THEN 'unchanged' WHEN cur.size_bytes = old.size_bytes AND cur.hash = old.hash THEN 'touched' ELSE 'upsert' END AS action, cur.mtime AS mtime
 FROM cur FULL JOIN old ON cur.root = old.root AND cur.path = old.path)"""


_DIFF_SQL = f"{SCANNED}, {_diff_ctes()}"


@query("i2_sync_diff", f"WITH {_DIFF_SQL} SELECT root, path, action FROM diff")
def i2(spark, d):
    c = _current(spark, d)
    return index.sync_diff(c, _stored(c)).drop("mtime")


@query("i3_apply_sync", f"WITH {_DIFF_SQL} SELECT root, path, size_bytes, mtime, hash FROM cur")
def i3(spark, d):
    c = _current(spark, d)
    old = _stored(c)
    return index.apply_sync(old, c, index.sync_diff(c, old))


@query("i4_sync_stats", f"""WITH {_DIFF_SQL}, t AS (SELECT root, sum(token_estimate)::BIGINT AS tokens FROM cur GROUP BY root), s AS (SELECT root, count(*) FILTER (WHERE action <> 'delete') AS indexed, count(*) FILTER (WHERE action = 'upsert') AS updated,
 count(*) FILTER (WHERE action IN ('unchanged', 'touched')) AS unchanged, count(*) FILTER (WHERE action = 'delete') AS deleted, 0::BIGINT AS read_errors FROM diff GROUP BY root)
SELECT s.*, tokens, updated > 0 OR deleted > 0 AS changed FROM s LEFT JOIN t USING (root)""")
def i4(spark, d):
    c = _current(spark, d)
    return index.sync_stats(index.sync_diff(c, _stored(c)), c.groupBy("root").agg(F.sum("token_estimate").cast("long").alias("tokens")))


@query("i5_recent_changes", f"""WITH {_DIFF_SQL}, e AS (SELECT root, path, action AS change_type, coalesce(mtime, 0) // 5000 AS changed_at, path AS seq FROM diff WHERE action IN ('upsert', 'delete'))
SELECT root, path, change_type, rank FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY changed_at DESC, seq DESC) AS rank FROM e) WHERE rank <= 10""")
def i5(spark, d):
    c = _current(spark, d)
    diff = index.sync_diff(c, _stored(c)).where("action IN ('upsert', 'delete')")
    ev = diff.select("root", "path", F.col("action").alias("change_type"), F.floor(F.coalesce("mtime", F.lit(0)) / 5000).alias("changed_at"), F.col("path").alias("seq"))
    return index.recent_changes(ev).select("root", "path", "change_type", "rank")


@query("s3_write_index", f"WITH {_KEYWORDS} SELECT * FROM keywords")
def s3(spark, d):
    path = scratch_dir(spark)
    index.write_index(i1(spark, d), path)
    return index.read_index(spark, path)


# --- retrieval ----------------------------------------------------------------------------------


def _index(spark, d, asked=None):
    """keywords (with ``asked``, root and term, rows of these alone), files, symbols: the index tables, written as a service would keep them."""
    s = written(scanned(spark, d) if asked is None else _heads(index.kept(scanned(spark, d))))
    files = index.kept(s)
    whole = files if asked is None else files.withColumn("content", F.coalesce("content", F.col("sample").cast("binary")))
    syms = written(symbols.dedupe_symbols(symbols.extract_symbols(whole)))
    return written(index.build_keywords(s, symbols.symbol_terms(syms), asked)), files.drop("content"), syms


def _heads(files):
    """Files with the head alone as content, null where the sample says it."""
    c = F.col("content").cast("binary")
    return files.withColumn("content", F.when(F.col("sample").cast("binary") != c, F.substring(c, 1, R.HEAD_BYTES)))


def _asked(spark, d, terms=retrieval.asked_terms):
    """root, term: what the queries ask for, sent to all tasks if few; an index for them alone needs no more rows."""
    return retrieval.few(written(terms(retrieval.parse_queries(A.queries(spark, d))).select("root", "term").distinct()))


_RECALL_SQL = f"""{_KEYWORDS}, {A.QUERIES_SQL},
parsed AS (SELECT query_id, root, query, {ordered_terms_sql('query')} AS terms FROM queries),
qt AS (SELECT query_id, root, unnest(terms) AS term FROM parsed),
hits AS (SELECT query_id, root, path, sum(CASE WHEN from_symbol = 0 THEN count ELSE 0 END)::INT AS keyword_count FROM qt JOIN keywords USING (root, term) GROUP BY ALL),
missed AS (SELECT query_id, root, path FROM parsed JOIN (SELECT root, path FROM kept) USING (root) WHERE query_id NOT IN (SELECT query_id FROM hits)),
cand AS (SELECT * FROM hits UNION ALL SELECT *, 0 FROM missed)"""


_FULLTEXT_SQL = f"""ftd AS (SELECT root, path, unnest({terms_sql("strip_accents(path || ' ' || sample)")}) AS term FROM kept UNION SELECT root, path, strip_accents(term) FROM sterms),
fq AS (SELECT query_id, root, unnest({terms_sql('strip_accents(query)')}) AS term FROM parsed), fh AS (SELECT DISTINCT query_id, root, path FROM fq JOIN ftd USING (root, term)),
fnum AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY path) AS i FROM fh), ft AS (SELECT query_id, root, path FROM fnum WHERE i <= 64)"""
_BOTH_SQL = "both_ways AS (SELECT query_id, root, path, 0 AS keyword_count FROM ft UNION ALL SELECT * FROM cand WHERE query_id NOT IN (SELECT query_id FROM ft))"


@query("r1_recall_keyword", f"WITH {_RECALL_SQL} SELECT query_id, root, path FROM hits")
def r1(spark, d):
    kw, _, _ = _index(spark, d)
    return retrieval.recall(retrieval.parse_queries(A.queries(spark, d)), kw).drop("keyword_count")


@query("r2_recall_fallback", f"WITH {_RECALL_SQL} SELECT query_id, root, path FROM missed")
def r2(spark, d):
    kw, files, _ = _index(spark, d)
    p = retrieval.parse_queries(A.queries(spark, d))
    hits = written(retrieval.recall(p, kw))
    return retrieval.recall_all(p, hits, files).join(hits.select("query_id").distinct(), "query_id", "left_anti").drop("keyword_count")


@query("r4_keyword_counts", f"WITH {_RECALL_SQL} SELECT query_id, root, path, keyword_count FROM hits")
def r4(spark, d):
    kw, _, _ = _index(spark, d)
    return retrieval.recall(retrieval.parse_queries(A.queries(spark, d)), kw)


def _scored(spark, d, with_symbols=False, parts=None):
    kw, files, syms = parts or _index(spark, d)
    p = retrieval.parse_queries(A.queries(spark, d))
    syms = syms if with_symbols else syms.limit(0)
    return retrieval.score(p, retrieval.recall_all(p, written(retrieval.recall(p, kw)), files), files, syms)


def _parts(i: int) -> str:
    return " || ".join("CASE WHEN " + " OR ".join(f"contains(lower(query), '{t}')" for t in r[0]) + f" THEN [{R.listed(r[i])}]::VARCHAR[] ELSE []::VARCHAR[] END" for r in R.INTENTS)


_SCORE_SQL = f"""{_RECALL_SQL},
joined AS (SELECT c.query_id, c.root, c.path, keyword_count, terms, query, kind, weight, role, size_bytes, sample, lower(sample) AS low, lower(c.path) AS lpath, {_parts(2)} AS segs, {_parts(3)} AS roles
 FROM cand c JOIN parsed USING (query_id, root) JOIN kept k ON k.root = c.root AND k.path = c.path),
points AS (SELECT *, weight + list_sum(list_transform(terms, lambda t: CASE WHEN contains(lpath, t) THEN 35.0 ELSE 0 END + CASE WHEN contains(kind, t) THEN 10.0 ELSE 0 END
  + 12.0 * least((length(low) - length(replace(low, t, ''))) // length(t), 5)))::DOUBLE + 4.0 * keyword_count AS lex,
 CASE WHEN len(list_filter(segs, lambda s: contains(lpath, s || '/') OR contains(lpath, '/' || s))) > 0 THEN 20.0 ELSE 0 END + CASE WHEN list_contains(roles, role) THEN 25.0 ELSE 0 END AS boost,
 CASE WHEN size_bytes > 32768 THEN least(size_bytes / 32768.0, 20.0) ELSE 0 END AS size_pen, role = 'generated-noisy' AND len(list_filter(terms, lambda t: contains(lpath, t))) = 0 AS noisy FROM joined),
scored AS (SELECT *, CASE WHEN noisy THEN 0 ELSE greatest(lex + boost - size_pen, 0) END::DOUBLE AS rel FROM points)"""


@query("r5_lexical_score", f"WITH {_SCORE_SQL} SELECT query_id, root, path, round(lex - weight - 4.0 * keyword_count, 3) AS lexical FROM scored")
def r5(spark, d):
    kw, files, _ = _index(spark, d)
    p = retrieval.parse_queries(A.queries(spark, d))
    c = retrieval.recall_all(p, retrieval.recall(p, kw), files).join(p, ["query_id", "root"]).join(files, ["root", "path"])
    return c.select("query_id", "root", "path", F.round(retrieval.lexical(F.col("terms"), F.col("path"), F.col("kind"), F.col("sample")), 3).alias("lexical"))


@query("r7_r8_relevance", f"WITH {_SCORE_SQL} SELECT query_id, root, path, round(rel, 3) AS rel FROM scored WHERE rel > 0")
def r8(spark, d):
    return _scored(spark, d).select("query_id", "root", "path", F.round("rel", 3).alias("rel"))


_SYMBOL_POINTS_SQL = f"""{_SCORE_SQL},
each_sym AS (SELECT p.query_id, s.root, s.path, s.weight, list_contains({_parts(1)}, s.kind) AS wanted, coalesce(list_position(terms, lower(name)), 0) AS exact,
  coalesce(list_position(list_transform(terms, lambda t: contains(lower(name), t) AND t <> lower(name)), true), 0) AS part FROM cand p JOIN parsed USING (query_id, root) JOIN syms s ON s.root = p.root AND s.path = p.path),
sym_points AS (SELECT query_id, path, least(sum(CASE WHEN exact > 0 THEN 30.0 ELSE 0 END + CASE WHEN part > 0 AND (exact = 0 OR part < exact) THEN 15.0 ELSE 0 END + CASE WHEN wanted THEN weight * 0.25 ELSE 0 END)::DOUBLE, 60) AS pts FROM each_sym GROUP BY ALL),
full_rel AS (SELECT scored.*, CASE WHEN noisy THEN 0 ELSE greatest(lex + boost - size_pen + coalesce(pts, 0), 0) END::DOUBLE AS full_score FROM scored LEFT JOIN sym_points USING (query_id, path))"""


@query("r6_symbol_score", f"WITH {_SYMBOL_POINTS_SQL} SELECT query_id, root, path, round(full_score, 3) AS rel FROM full_rel WHERE full_score > 0")
def r6(spark, d):
    return _scored(spark, d, True).select("query_id", "root", "path", F.round("rel", 3).alias("rel"))


@query("r9_normalize_rel", f"""WITH {_SCORE_SQL}, s AS (SELECT * FROM scored WHERE rel > 0), m AS (SELECT *, min(rel) OVER w AS lo, max(rel) OVER w AS hi FROM s WINDOW w AS (PARTITION BY query_id))
SELECT query_id, path, round(CASE WHEN hi - lo <= 0 THEN 1.0 ELSE (rel - lo) / (hi - lo) END, 4) AS rel_norm FROM m""")
def r9(spark, d):
    return retrieval.normalized(_scored(spark, d)).select("query_id", "path", F.round("rel_norm", 4).alias("rel_norm"))


@query("r11_mmr_topk")
def r11(spark, d):
    parts = _index(spark, d, _asked(spark, d))
    return retrieval.mmr(written(_scored(spark, d, parts=parts).drop("sample", "terms")), parts[1])


_TOP_SQL = f"{_SCORE_SQL}, top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, path) AS rank FROM scored WHERE rel > 0)"


@query("r12_top_by_relevance", f"WITH {_TOP_SQL} SELECT query_id, rank, path, kind, weight, round(rel, 2) AS score, {tokens_sql('sample')} AS token_estimate FROM top WHERE rank <= 8")
def r12_rel(spark, d):
    return retrieval.top_by_relevance(_scored(spark, d)).select("query_id", "rank", "path", "kind", "weight", F.round("rel", 2).alias("score"), "token_estimate")


def _fulltext(files, syms, asked=None):
    return written(index.fulltext_terms(files, symbols.symbol_terms(syms), asked))


@query("r12_memory_query")
def r12(spark, d):
    """Full-text recall first, keywords as the fallback, symbols in the score, a diverse top k."""
    kw, files, syms = _index(spark, d, _asked(spark, d))
    return retrieval.memory_query(A.queries(spark, d), kw, files, syms, _fulltext(files, syms, _asked(spark, d, retrieval.asked_fulltext)))


@query("r12_fulltext_candidates", f"""WITH {_RECALL_SQL}, {_FULLTEXT_SQL}, {_BOTH_SQL} SELECT query_id, root, path, keyword_count FROM both_ways""")
def r12_candidates(spark, d):
    kw, files, syms = _index(spark, d)
    return retrieval.candidates(retrieval.parse_queries(A.queries(spark, d)), _fulltext(files, syms), kw, files)


# --- the stored index -----------------------------------------------------------------------------


def _before(files):
    """The files as they were when the index was first built: some absent, some with other text, some with another time, some gone since."""
    i = F.floor(F.col("mtime") / 1000)
    text = F.when((i % 7 == 0) & (i > 0), F.concat(F.lit("old words "), "content")).otherwise(F.col("content"))
    old = files.where((i % 11 != 0) | (i == 0)).select("root", "path", F.when(i % 5 == 0, F.col("mtime") + 1).otherwise(F.col("mtime")).alias("mtime"), text.alias("content"))
    name = i.cast("string")
    gone = files.where((i % 13 == 0) & (i > 0)).select("root", F.concat(F.lit("gone/"), name, F.lit(".ts")).alias("path"), "mtime", F.concat(F.lit("export const useGone"), name, F.lit(" = 1")).alias("content"))
    return old.unionByName(gone)


def _listed(files):
    ignore = files.where(F.col("path") == ".gitignore").select("root", "path", "content")
    return store.listed(files.withColumn("size_bytes", F.octet_length("content").cast("long")), ignore)


def _opened(files):
    """Contents of the files that a sync opens. They go to the part of their root where the sync wants them, by one shuffle; contents that aren't asked for stay."""

    def of(rows):
        c = F.col("content").cast("binary")
        names = [x for x in rows.columns if x not in ("root", "part", "path")]
        texts = files.withColumn("k", F.xxhash64("root", "path"))
        keys = written(rows.select(F.xxhash64("root", "path").alias("k")))
        if keys.limit(store.MOST_GONE + 1).count() <= store.MOST_GONE:  # a few more by equal hashes do no harm
            texts = texts.join(F.broadcast(keys), "k", "left_semi")
        parts = retrieval.few(written(rows.select("root", "parts").distinct()))
        large = F.octet_length(c) > R.LARGE_BYTES
        text = F.struct(T.sample_bytes(c).alias("content"), F.when(large, F.substring(c, 1, R.HEAD_BYTES)).alias("head"), F.sha2(c, 256).alias("hash"))
        texts = texts.join(parts, "root").select("root", store.part(F.col("path"), F.col("parts")).alias("part"), "path", text.alias("text"))
        both = rows.select("root", "part", "path", F.struct(*names).alias("row")).unionByName(texts, allowMissingColumns=True).repartition("root", "part")
        met = both.groupBy("root", "part", "path").agg(F.first("row", True).alias("row"), F.first("text", True).alias("text")).where("row IS NOT NULL AND text IS NOT NULL")
        head = F.coalesce("text.head", F.substring("text.content", 1, R.HEAD_BYTES))
        return met.select("root", "part", "path", "row.*", "text.content", head.alias("head"), "text.hash", F.lit(None).cast("string").alias("error"))

    return of


_BUILT: dict[tuple[str, str], str] = {}


def _stored_index(spark, d):
    """A stored index of the files as they were, brought up to date by one sync: its folder, built once a session and input."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _BUILT or len(store.versions(spark, _BUILT[key])) < 2:
        path, files = scratch_dir(spark), A.files(spark, d)
        before = _before(files)
        store.sync(spark, path, _listed(before), _opened(before), 1)
        store.sync(spark, path, _listed(files), _opened(files), 1)
        _BUILT[key] = path
    return _BUILT[key]


def _sync_ctes() -> str:
    return f"""cur AS (SELECT root, path, size_bytes, mtime, sha256(content) AS hash, mtime // 1000 AS i FROM kept),
old AS (SELECT root, path, CASE WHEN i % 7 = 0 AND i > 0 THEN size_bytes + 10 ELSE size_bytes END AS size_bytes, CASE WHEN i % 5 = 0 THEN mtime + 1 ELSE mtime END AS mtime, CASE WHEN i % 7 = 0 AND i > 0 THEN 'old' ELSE hash END AS hash FROM cur WHERE i % 11 <> 0 OR i = 0
 UNION ALL SELECT root, 'gone/' || (mtime // 1000) || '.ts', 1, 1, 'gone' FROM files WHERE mtime // 1000 % 13 = 0 AND mtime >= 1000),
diff AS (SELECT coalesce(cur.root, old.root) AS root, coalesce(cur.path, old.path) AS path, CASE WHEN cur.path IS NULL THEN 'delete' WHEN old.path IS NULL THEN 'upsert'
 WHEN cur.size_bytes = old.size_bytes AND cur.mtime = old.mtime THEN 'unchanged' WHEN cur.size_bytes = old.size_bytes AND cur.hash = old.hash THEN 'touched' ELSE 'upsert' END AS action
 FROM cur FULL JOIN old ON cur.root = old.root AND cur.path = old.path)"""


@query("i2_lazy_diff", f"WITH {SCANNED}, {_sync_ctes()} SELECT root, path, action FROM diff")
def i2_lazy(spark, d):
    """Actions of a sync that opens no unchanged file."""
    path, files = scratch_dir(spark), A.files(spark, d)
    before = _before(files)
    store.sync(spark, path, _listed(before), _opened(before), 1)
    return store.sync(spark, path, _listed(files), _opened(files), 1)[1]


@query("i3_incremental_files", f"WITH {SCANNED} SELECT root, path, kind, weight, role, size_bytes, {tokens_sql('sample')} AS token_estimate, mtime, sha256(content) AS hash FROM kept")
def i3_files(spark, d):
    return store.read(spark, _stored_index(spark, d), "files").drop("sample")


@query("i3_incremental_keywords", f"WITH {_KEYWORDS} SELECT * FROM keywords")
def i3_keywords(spark, d):
    return store.read(spark, _stored_index(spark, d), "keywords")


@query("i3_incremental_symbols", f"WITH {_SYMBOLS} SELECT * FROM syms")
def i3_symbols(spark, d):
    return store.read(spark, _stored_index(spark, d), "symbols")


@query("i5_change_log", f"""WITH {SCANNED}, {_sync_ctes()}, e AS (SELECT root, path, 'upsert' AS change_type, 1 AS version FROM old UNION ALL SELECT root, path, action, 2 FROM diff WHERE action IN ('upsert', 'delete'))
SELECT root, path, change_type, rank FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY version DESC, change_type = 'delete' DESC, path DESC) AS rank FROM e) WHERE rank <= 10""")
def i5_log(spark, d):
    """The latest changes of two syncs at one time: insertion alone orders them."""
    return store.latest_changes(store.read(spark, _stored_index(spark, d), "changes")).drop("changed_at")


@query("r1_stored_recall", f"WITH {_RECALL_SQL} SELECT query_id, root, path, keyword_count FROM hits")
def r1_stored(spark, d):
    """Keyword recall from stored postings."""
    return retrieval.counted(store.hits(spark, _stored_index(spark, d), "keywords", retrieval.asked_terms(retrieval.parse_queries(A.queries(spark, d)))))


@query("r12_stored_candidates", f"WITH {_RECALL_SQL}, {_FULLTEXT_SQL}, {_BOTH_SQL} SELECT query_id, root, path, keyword_count FROM both_ways")
def r12_stored_candidates(spark, d):
    path, q = _stored_index(spark, d), A.queries(spark, d)
    at = store.version(spark, path)
    return retrieval.stored_candidates(retrieval.parse_queries(q), path, at, store.read(spark, path, "files", roots=q.select("root"), at=at))


@query("r12_stored_query")
def r12_stored(spark, d):
    """The same answers as r12_memory_query from the stored index: nothing is scanned or built for a query."""
    return retrieval.stored_query(A.queries(spark, d), _stored_index(spark, d))


_SENT_SQL = f"""sent AS (SELECT query_id, sum({tokens_sql('sample')})::BIGINT AS sent FROM top WHERE rank <= 8 GROUP BY 1), tot AS (SELECT root, sum({tokens_sql('sample')})::BIGINT AS tokens FROM kept GROUP BY 1),
used AS (SELECT query_id, root, coalesce(sent, 0) AS sent, greatest(coalesce(tokens, 0) - coalesce(sent, 0), 0) AS ignored, coalesce(tokens, 0) AS total FROM queries LEFT JOIN sent USING (query_id) LEFT JOIN tot USING (root))"""


def _used(spark, d):
    parts = _index(spark, d)
    return retrieval.retrieval_usage(retrieval.top_by_relevance(_scored(spark, d, parts=parts)), A.queries(spark, d), index.root_stats(parts[1]))


@query("r13_retrieval_usage", f"WITH {_TOP_SQL}, {_SENT_SQL} SELECT * FROM used")
def r13(spark, d):
    return _used(spark, d)


_EVENT_COLUMNS = ("token_estimate", "sent", "ignored", "saved", "avoided", "adjusted", "latency_ms")


def _event_sql(kind: str, where: str = "true", **v: str) -> str:
    return f"SELECT query_id, root, 'memory-query' AS tool, {kind} AS kind, " + ", ".join(f"({v.get(c, '0')})::BIGINT AS {c}" for c in _EVENT_COLUMNS) + f" FROM ev WHERE {where}"


@query("r13_usage_events", f"""WITH {_TOP_SQL}, {_SENT_SQL}, {_diff_ctes()}, chg AS (SELECT root, bool_or(action IN ('upsert', 'delete')) AND substring(root, 4)::INT % 2 = 0 AS changed FROM diff GROUP BY root), ev AS (SELECT * FROM used LEFT JOIN chg USING (root))
{_event_sql("'call'")} UNION ALL {_event_sql("'token_estimate'", token_estimate="sent", sent="sent", ignored="ignored")} UNION ALL {_event_sql("'latency'")}
 UNION ALL {_event_sql("'cache_miss'", "changed")} UNION ALL {_event_sql("'cache_hit'", "NOT changed", saved="total", avoided="total", adjusted="ignored")}""")
def r13_events(spark, d):
    """Roots of even number are taken to have changed since they were indexed, as the stored snapshot says; odd ones not."""
    c = written(_current(spark, d))
    changed = index.sync_stats(index.sync_diff(c, _stored(c)), index.root_stats(c)).withColumn("changed", F.col("changed") & (F.substring("root", 4, 9).cast("int") % 2 == 0))
    return retrieval.usage_events(_used(spark, d), changed)


#: A query should find the files that hold most of its own words' occurrences: those of the most content points.
_EXPECTED_SQL = """best AS (SELECT query_id, root AS grp, path, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, path) AS i
 FROM (SELECT query_id, root, c.path, list_sum(list_transform(terms, lambda t: (length(low) - length(replace(low, t, ''))) // length(t))) AS hits FROM joined c)),
e AS (SELECT query_id, grp, path FROM best WHERE i <= 2)"""


def _expected(spark, d, parts):
    """query_id, grp, path: the two candidates of each query that hold its words most often."""
    kw, files, _ = parts
    p = retrieval.parse_queries(A.queries(spark, d))
    c = retrieval.recall_all(p, written(retrieval.recall(p, kw)), files).join(p, ["query_id", "root"]).join(files, ["root", "path"])
    low = F.lower("sample")
    hits = F.aggregate("terms", F.lit(0), lambda a, t: a + F.floor((F.length(low) - F.length(F.replace(low, t, F.lit("")))) / F.length(t)).cast("int"))
    ranked = c.select("query_id", F.col("root").alias("grp"), "path", hits.alias("hits"))
    w = Window.partitionBy("query_id").orderBy(F.col("hits").desc(), "path")
    return ranked.withColumn("i", F.row_number().over(w)).where("i <= 2").select("query_id", "grp", "path")


@query("r14_first_hits", f"""WITH {_TOP_SQL}, {_EXPECTED_SQL} SELECT e.query_id, grp, min(rank) AS first_rank FROM e LEFT JOIN (SELECT * FROM top WHERE rank <= 5) t ON t.query_id = e.query_id AND t.path = e.path GROUP BY 1, 2""")
def r14_first(spark, d):
    parts = _index(spark, d)
    return retrieval.first_hits(retrieval.top_by_relevance(_scored(spark, d, parts=parts)).where("rank <= 5"), _expected(spark, d, parts))


@query("r14_hit_rate", f"""WITH {_TOP_SQL}, {_EXPECTED_SQL}, h AS (SELECT e.query_id, grp, min(rank) AS r FROM e LEFT JOIN (SELECT * FROM top WHERE rank <= 5) t ON t.query_id = e.query_id AND t.path = e.path GROUP BY 1, 2)
SELECT grp, count(*) AS queries, count(r) AS hits, avg((r IS NOT NULL)::INT::DOUBLE) AS hit_rate, avg((r IS NOT NULL)::INT::DOUBLE) >= {retrieval.HIT_RATE_GATE} AS passed FROM h GROUP BY ROLLUP (grp)""")
def r14(spark, d):
    parts = _index(spark, d)
    return retrieval.hit_rate(retrieval.top_by_relevance(_scored(spark, d, parts=parts)).where("rank <= 5"), _expected(spark, d, parts))


# --- lint ---------------------------------------------------------------------------------------


def _lint_docs(spark, d):
    return A.table(spark, d, "documents").select(F.col("source").alias("root"), F.col("doc_id").alias("doc_seq"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("file"), F.coalesce("text", F.lit("")).alias("text"))


_LINT = "ld AS (SELECT source AS root, doc_id AS doc_seq, 'doc' || doc_id AS file, coalesce(text, '') AS text FROM documents)"


def _flat_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}+', ' ', 'g'), ' ')"


def _excerpt_sql(x: str) -> str:
    f = _flat_sql(x)
    return f"CASE WHEN length({f}) > 160 THEN left({f}, 160) || '...' ELSE {f} END"


def _word_sql(p: str) -> str:
    return f"regexp_matches(l, '(^|[^0-9A-Za-z_])(?:{p})($|[^0-9A-Za-z_])')"


_LINES = f"""lines AS (SELECT root, file, generate_subscripts(string_split(text, chr(10)), 1) AS line, regexp_replace(unnest(string_split(text, chr(10))), '\\r$', '') AS l FROM ld),
bad AS (SELECT root, file, line::INT AS line, {_excerpt_sql('l')} AS excerpt, CASE WHEN regexp_matches(l, '{lint.PRIVATE_KEY}') OR regexp_matches(l, '{lint.SECRET.replace("'", "''")}') THEN 'secret_pattern'
 WHEN {_word_sql(lint.DATE)} OR {_word_sql(lint.UUID)} OR contains(l, '/tmp/') OR contains(lower(l), 'current sprint') THEN 'dynamic_info' WHEN {_word_sql(lint.RANDOM_ID)} AND NOT contains(l, 'sha256') THEN 'dynamic_info' END AS rule FROM lines)"""
_DUPS = f"""paras AS (SELECT root, doc_seq, file, generate_subscripts(string_split(text, chr(10)), 1)::INT AS line, unnest(string_split(text, chr(10))) AS part FROM ld),
norm AS (SELECT *, {_flat_sql('lower(part)')} AS n FROM paras), ranked AS (SELECT *, row_number() OVER w AS i, first_value(file) OVER w AS first_file FROM norm WHERE length(n) >= 100 WINDOW w AS (PARTITION BY root, n ORDER BY doc_seq, line)),
dups AS (SELECT root, file, 'duplicate_paragraph' AS rule, line, {_excerpt_sql('part')} AS excerpt, first_file FROM ranked WHERE i > 1)"""
_LONG = "SELECT root, file, 'file_too_long' AS rule, 0 AS line, '' AS excerpt FROM ld WHERE len(string_split(text, chr(10))) > 300 OR strlen(text) > 24576"
_SCOPE = "SELECT root, file, 'missing_scope' AS rule, 0 AS line, '' AS excerpt FROM ld WHERE NOT (" + " OR ".join(f"contains(lower(text), '{w}')" for w in R.SCOPE_WORDS) + ")"


@query("l1_lint_too_long", f"WITH {_LINT} {_LONG}")
def l1(spark, d):
    return lint.too_long(_lint_docs(spark, d))


@query("l2_lint_scope", f"WITH {_LINT} {_SCOPE}")
def l2(spark, d):
    return lint.missing_scope(_lint_docs(spark, d))


@query("l3_lint_lines", f"WITH {_LINT}, {_LINES} SELECT root, file, rule, line, excerpt FROM bad WHERE rule IS NOT NULL")
def l3(spark, d):
    return lint.bad_lines(_lint_docs(spark, d))


@query("l4_duplicate_paragraphs", f"WITH {_LINT}, {_DUPS} SELECT * FROM dups")
def l4(spark, d):
    return lint.duplicate_paragraphs(_lint_docs(spark, d), "\n")


_BLANK_LINT = "ld AS (SELECT source AS root, doc_id AS doc_seq, 'doc' || doc_id AS file, replace(coalesce(text, ''), chr(10), chr(10) || CASE WHEN doc_id % 3 = 0 THEN '' ELSE chr(10) END) AS text FROM documents)"
_BLANK_DUPS = f"""paras AS (SELECT root, doc_seq, file, unnest(string_split(text, chr(10) || chr(10))) AS part, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS j, string_split(text, chr(10) || chr(10)) AS ps FROM ld),
placed AS (SELECT *, (1 + 2 * (j - 1) + length(array_to_string(ps[1:j - 1], '')) - length(replace(array_to_string(ps[1:j - 1], ''), chr(10), '')))::INT AS line FROM paras),
norm AS (SELECT *, {_flat_sql('lower(part)')} AS n FROM placed), ranked AS (SELECT *, row_number() OVER w AS i, first_value(file) OVER w AS first_file FROM norm WHERE length(n) >= 100 WINDOW w AS (PARTITION BY root, n ORDER BY doc_seq, line))
SELECT root, file, 'duplicate_paragraph' AS rule, line, {_excerpt_sql('part')} AS excerpt, first_file FROM ranked WHERE i > 1"""


@query("l4_blank_line_paragraphs", f"WITH {_BLANK_LINT}, {_BLANK_DUPS}")
def l4_blank(spark, d):
    """Paragraphs between blank lines; in two documents of three every line is one."""
    docs = _lint_docs(spark, d)
    return lint.duplicate_paragraphs(docs.withColumn("text", F.replace("text", F.lit("\n"), F.when(F.col("doc_seq") % 3 == 0, F.lit("\n")).otherwise(F.lit("\n\n")))))


@query("l5_lint_report", f"""WITH {_LINT}, {_LINES}, {_DUPS}, f AS (SELECT root, rule FROM bad WHERE rule IS NOT NULL UNION ALL SELECT root, rule FROM dups UNION ALL SELECT root, rule FROM ({_LONG}) UNION ALL SELECT root, rule FROM ({_SCOPE}))
SELECT root, count(*) FILTER (WHERE rule = 'secret_pattern') AS high, count(*) FILTER (WHERE rule IN ('file_too_long', 'missing_scope', 'dynamic_info')) AS medium, count(*) FILTER (WHERE rule = 'duplicate_paragraph') AS low FROM f GROUP BY root""")
def l5(spark, d):
    return lint.lint_report(lint.findings(_lint_docs(spark, d), "\n"))




def _case(values: dict) -> str:
    return "CASE rule " + " ".join("WHEN '{}' THEN '{}'".format(r, v.replace("'", "''")) for r, v in values.items()) + " END"


_SEVERITY = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in R.SEVERITIES.items()) + " END"
_FOUND = f"""{_LINES}, {_DUPS}, f AS (SELECT * FROM bad WHERE rule IS NOT NULL UNION ALL BY NAME SELECT * EXCLUDE (first_file) FROM dups UNION ALL BY NAME {_LONG} UNION ALL BY NAME {_SCOPE}
 UNION ALL BY NAME SELECT root, file, 'read_error' AS rule, 0 AS line, '' AS excerpt FROM targets WHERE text IS NULL)"""


@query("l5_findings", f"WITH {A.INSTRUCTION_SQL}, {_FOUND} SELECT root, file, rule, line, excerpt, {_SEVERITY} AS severity, {_case(R.MESSAGES)} AS message, {_case(R.SUGGESTIONS)} AS suggestion FROM f")
def l5_findings(spark, d):
    return lint.sorted_findings(lint.findings(lint.target_documents(A.instruction_files(spark, d)), "\n"))


@query("l5_lint_summary", f"""WITH {A.INSTRUCTION_SQL}, {_FOUND}, g AS (SELECT root, count(*) FILTER (WHERE v = 'HIGH') AS high, count(*) FILTER (WHERE v = 'MEDIUM') AS medium, count(*) FILTER (WHERE v = 'LOW') AS low FROM (SELECT root, {_SEVERITY} AS v FROM f) GROUP BY root)
SELECT root, files_read, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low FROM (SELECT root, count(text) AS files_read FROM targets GROUP BY root) LEFT JOIN g USING (root)""")
def l5_summary(spark, d):
    return lint.lint_summary(lint.target_documents(A.instruction_files(spark, d)), "\n")


# --- usage and cache ----------------------------------------------------------------------------

_REPORT = """SELECT {k} count(*) FILTER (WHERE kind = 'call') AS calls, count(*) FILTER (WHERE kind = 'cache_hit') AS cache_hits, count(*) FILTER (WHERE kind = 'cache_miss') AS cache_misses,
 coalesce(sum(token_estimate), 0)::BIGINT AS token_estimate, coalesce(sum(saved), 0)::BIGINT AS saved, coalesce(sum(avoided), 0)::BIGINT AS avoided, coalesce(sum(sent), 0)::BIGINT AS sent, coalesce(sum(adjusted), 0)::BIGINT AS adjusted, coalesce(sum(ignored), 0)::BIGINT AS ignored FROM usage"""


@query("s4_append_usage", f"WITH {A.USAGE_SQL} SELECT event_id, kind, 'unknown' AS tool, created_at::DATE AS event_date FROM usage WHERE kind IS NOT NULL")
def s4(spark, d):
    return usage.clean_events(A.usage_events(spark, d)).select("event_id", "kind", "tool", "event_date")


@query("u1_usage_report", f"WITH {A.USAGE_SQL} {_REPORT.format(k='root,')} GROUP BY root")
def u1(spark, d):
    return usage.usage_report(A.usage_events(spark, d), "root")


@query("u2_p95_latency", f"WITH {A.USAGE_SQL}, v AS (SELECT root, latency_ms, row_number() OVER (PARTITION BY root ORDER BY latency_ms) AS i, count(*) OVER (PARTITION BY root) AS n FROM usage WHERE kind = 'latency' AND latency_ms > 0), b AS (SELECT root, min(latency_ms) AS p FROM v WHERE i >= ceil(0.95 * n) GROUP BY root) SELECT root, coalesce(any_value(p), 0)::BIGINT AS p95_ms FROM usage LEFT JOIN b USING (root) GROUP BY root")
def u2(spark, d):
    return usage.p95_latency(A.usage_events(spark, d), "root")


def _states(spark, d):
    """Daily states after two appends: the second update reads only the days that grew."""
    events, path = A.usage_events(spark, d), scratch_dir(spark)
    for part in ("event_id % 3 <> 0", "event_id % 3 = 0"):
        usage.append_usage(events.where(part), f"{path}/events")
        usage.update_states(spark, f"{path}/events", f"{path}/states")
    return usage.read_states(spark, f"{path}/events", f"{path}/states")


@query("u1_report_from_states", ORACLES["u1_usage_report"])
def u1_states(spark, d):
    return usage.report_from_states(_states(spark, d), "root")


@query("u2_p95_from_states", ORACLES["u2_p95_latency"])
def u2_states(spark, d):
    return usage.p95_from_states(_states(spark, d), "root")


@query("u3_saved_vs_overhead", f"""WITH {A.USAGE_SQL}, r AS ({_REPORT.format(k='root,')} GROUP BY root) SELECT *, saved - sent AS net, saved + sent AS baseline, CASE WHEN saved + sent > 0 THEN saved / (saved + sent) ELSE 0 END AS reduction_ratio,
 CASE WHEN saved > 0 THEN sent / saved ELSE 0 END AS overhead_ratio, CASE WHEN saved > 0 THEN sent / saved <= 0.05 ELSE sent = 0 END AS within_budget FROM r""")
def u3(spark, d):
    return usage.saved_vs_overhead(usage.usage_report(A.usage_events(spark, d), "root"))


_SNAP = f"{A.CACHE_SQL}, lastset AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY at_ms DESC, seq DESC) AS i FROM log WHERE op = 'set'), snap AS (SELECT key, CASE WHEN ttl_ms > 0 THEN at_ms + ttl_ms ELSE 0 END AS expires_at, at_ms AS last_access, seq FROM lastset WHERE i = 1), live AS (SELECT * FROM snap WHERE expires_at = 0 OR expires_at > {NOW_MS}), kept AS (SELECT * FROM live ORDER BY last_access DESC, seq DESC LIMIT 100)"
_READS = """w AS (SELECT *, max(CASE WHEN op <> 'get' THEN seq END) OVER (PARTITION BY key ORDER BY at_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lastmax,
 last_value(CASE WHEN op <> 'get' THEN seq END IGNORE NULLS) OVER (PARTITION BY key ORDER BY at_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM log),
reads AS (SELECT w.key, w.at_ms, w.seq, coalesce(l.op = 'set' AND (l.ttl_ms <= 0 OR l.at_ms + l.ttl_ms > w.at_ms), false) AS hit FROM w LEFT JOIN log l ON l.key = w.key AND l.seq = w.prev WHERE w.op = 'get')"""


@query("k1_cache_compact", f"WITH {_SNAP} SELECT * FROM kept")
def k1(spark, d):
    return cache.cache_compact(cache.snapshot(A.cache_log(spark, d)), NOW_MS, 100)


@query("k2_cache_replay", f"WITH {A.CACHE_SQL}, {_READS} SELECT * FROM reads")
def k2(spark, d):
    return cache.cache_replay(A.cache_log(spark, d))


@query("k3_cache_stats", f"WITH {_SNAP}, {_READS} SELECT (SELECT count(*) FROM kept) AS entries, (SELECT count(*) FROM reads WHERE hit) AS hits, (SELECT count(*) FROM reads WHERE NOT hit) AS misses, (SELECT count(*) FROM live) - (SELECT count(*) FROM kept) AS evictions")
def k3(spark, d):
    log = A.cache_log(spark, d)
    snap = cache.snapshot(log)
    return cache.cache_stats(snap, cache.cache_compact(snap, NOW_MS, 100), cache.cache_replay(log), NOW_MS)


# --- commands -----------------------------------------------------------------------------------

SCRIPTS = (("dev", "vite"), ("build", "vite build"), ("test", "vitest run"), ("lint", "eslint ."), ("type-check", "vue-tsc"), ("build-release-apk", "gradlew assemble"), ("preview", "vite preview"))


def _manifests(spark, d):
    """A repository for every four parts, with manifests, locks, wrappers and tests by residues of its number."""
    p = A.table(spark, d, "part").select(F.expr("p_partkey div 4").alias("n"), (F.col("p_partkey") % len(SCRIPTS)).alias("s"), "p_partkey")
    names, bodies = (F.array(*[F.lit(x[i]) for x in SCRIPTS]) for i in (0, 1))
    scripts = p.groupBy("n").agg(F.array_sort(F.collect_set("s")).alias("s"))  # seven values at most
    entry = F.transform("s", lambda s: F.concat(F.lit('"'), F.get(names, s.cast("int")), F.lit('": "'), F.get(bodies, s.cast("int")), F.lit('"')))
    n = F.col("n")
    pkg = F.when(n % 50 == 12, F.lit("{broken")).otherwise(F.concat(F.lit('{"packageManager": "'), F.when(n % 3 == 0, "yarn@4").otherwise(""), F.lit('", "scripts": {'), F.array_join(entry, ", "), F.lit("}}")))
    pom = F.when(n % 50 == 8, F.lit("<project><build>")).otherwise(F.lit("<project xmlns=\"http://maven.apache.org/POM/4.0.0\"><build><plugins><plugin><artifactId>a</artifactId></plugin><plugin><artifactId>spring-boot-maven-plugin</artifactId></plugin></plugins></build></project>"))
    gradle = F.concat(F.lit("plugins { id 'java' }\n  task hello"), n.cast("string"), F.lit(" {}\ntasks.register(\"extra\") {}\n"), F.when(n % 2 == 0, "id 'org.springframework.boot'").otherwise(""))
    f = lambda on, path, text: F.when(on, F.struct(F.lit(path).alias("path"), text.alias("content")))
    rows = F.array_compact(F.array(f(n % 2 == 0, "package.json", pkg), f(n % 5 == 0, "pnpm-lock.yaml", F.lit("")), f(n % 4 == 1, "pom.xml", pom), f(n % 50 == 8, "pom.xml", pom), f(n % 4 == 3, "build.gradle", gradle), f(n % 6 == 1, "src/test/A.java", F.lit("")), f(n % 10 == 1, "mvnw", F.lit("")), f(n % 10 == 3, "gradlew", F.lit(""))))
    return scripts.select(F.concat(F.lit("m"), n.cast("string")).alias("root"), F.explode(rows).alias("x")).select("root", "x.path", "x.content")


_MAN = """b AS (SELECT n, 'm' || n AS root, CASE WHEN n % 5 = 0 THEN 'pnpm' WHEN n % 3 = 0 AND n % 2 = 0 AND n % 50 <> 12 THEN 'yarn' ELSE 'npm' END AS pm FROM (SELECT DISTINCT (p_partkey // 4) AS n FROM part)),
managers AS (SELECT root, pm FROM b WHERE n % 2 = 0 OR n % 5 = 0 OR n % 4 IN (1, 3) OR n % 6 = 1 OR n % 10 IN (1, 3)),
names AS (SELECT * FROM (VALUES """ + ", ".join(f"({i}, '{n}', '{b}', '{c}')" for i, ((n, b), c) in enumerate(zip(SCRIPTS, ("dev", "build", "test", "lint", "type-check", "run", "run"), strict=True))) + """) t(s, name, raw, category)),
scripts AS (SELECT DISTINCT 'm' || (p_partkey // 4) AS root, name, category, 'package.json' AS source, CASE pm WHEN 'yarn' THEN 'yarn ' WHEN 'pnpm' THEN 'pnpm run ' ELSE 'npm run ' END || name AS invocation, raw
 FROM part JOIN names ON s = p_partkey % 7 JOIN b ON b.n = (p_partkey // 4) WHERE (p_partkey // 4) % 2 = 0 AND (p_partkey // 4) % 50 <> 12),
mv AS (SELECT n, root, CASE WHEN n % 10 = 1 THEN './mvnw' ELSE 'mvn' END AS t FROM b WHERE n % 4 = 1 OR n % 50 = 8),
maven AS (SELECT root, 'package' AS name, 'build' AS category, 'pom.xml' AS source, t || ' -DskipTests package' AS invocation, 'mvn package' AS raw FROM mv
 UNION ALL SELECT root, 'test', 'test', 'pom.xml', t || ' test', 'mvn test' FROM mv WHERE n % 6 = 1
 UNION ALL SELECT root, 'spring-boot:run', 'dev', 'pom.xml', t || ' spring-boot:run', 'spring-boot-maven-plugin' FROM mv WHERE n % 50 <> 8),
gr AS (SELECT n, root, CASE WHEN n % 10 = 3 THEN './gradlew' ELSE 'gradle' END AS t FROM b WHERE n % 4 = 3),
gradle AS (SELECT root, 'build' AS name, 'build' AS category, 'build.gradle' AS source, t || ' build' AS invocation, 'gradle build' AS raw FROM gr
 UNION ALL SELECT root, 'test', 'test', 'build.gradle', t || ' test', 'gradle test' FROM gr WHERE n % 6 = 1
 UNION ALL SELECT root, 'bootRun', 'dev', 'build.gradle', t || ' bootRun', 'spring-boot gradle plugin' FROM gr WHERE n % 2 = 0
 UNION ALL SELECT root, 'hello' || n, 'run', 'build.gradle', t || ' hello' || n, 'declared gradle task' FROM gr
 UNION ALL SELECT root, 'extra', 'run', 'build.gradle', t || ' extra', 'declared gradle task' FROM gr)"""


@query("c1_package_manager", f"WITH {_MAN} SELECT * FROM managers")
def c1(spark, d):
    return commands.package_managers(_manifests(spark, d))


@query("c2_script_commands", f"WITH {_MAN} SELECT * FROM scripts")
def c2(spark, d):
    return commands.script_commands(_manifests(spark, d))


@query("c3_maven_commands", f"WITH {_MAN} SELECT * FROM maven")
def c3(spark, d):
    return commands.maven_commands(_manifests(spark, d))


@query("c4_gradle_commands", f"WITH {_MAN} SELECT * FROM gradle")
def c4(spark, d):
    return commands.gradle_commands(_manifests(spark, d))


@query("c5_discover_commands", f"""WITH {_MAN}, e AS (SELECT * FROM scripts UNION ALL SELECT * FROM maven UNION ALL SELECT * FROM gradle)
SELECT *, row_number() OVER (PARTITION BY root ORDER BY source, CASE category WHEN 'build' THEN 0 WHEN 'test' THEN 1 WHEN 'lint' THEN 2 WHEN 'type-check' THEN 3 WHEN 'dev' THEN 4 ELSE 5 END, name) AS place FROM e""")
def c5(spark, d):
    return commands.discover_commands(_manifests(spark, d))


# --- zones, full text, similarity, weekly report -----------------------------------------------


def _pages(spark, d):
    return A.table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))


@query("t8_extract_zones", """WITH z AS (SELECT page_id AS doc_id, html AS t, regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1) AS c, string_split(html, '<li>') AS parts FROM pages),
u AS (SELECT doc_id, t, unnest(c) AS content, generate_subscripts(c, 1) AS i, parts FROM z)
SELECT doc_id, i - 1 AS zone_no, content, (strlen(array_to_string(parts[1:i], '<li>')) + 4)::INT AS content_start, (strlen(array_to_string(parts[1:i], '<li>')) + 4 + strlen(content))::INT AS content_end FROM u""")
def t8(spark, d):
    return zones.extract_zones(_pages(spark, d), "<li>", "</li>")


@query("t8_zone_errors", r"""WITH r AS (SELECT page_id AS doc_id, regexp_replace(html, '(?s)<p>.*?</p>', chr(10), 'g') AS x FROM pages)
SELECT * FROM (SELECT doc_id, CASE WHEN contains(x, '</p>') THEN 'orphan_end' WHEN contains(x, '<p>') THEN 'missing_end' END AS error FROM r) WHERE error IS NOT NULL""")
def t8_errors(spark, d):
    return zones.zone_errors(_pages(spark, d), "<p>", "</p>")


@query("r3_recall_fulltext", f"WITH {_RECALL_SQL}, {_FULLTEXT_SQL} SELECT query_id, root, path FROM ft")
def r3(spark, d):
    _, files, syms = _index(spark, d)
    return retrieval.recall_fulltext(retrieval.parse_queries(A.queries(spark, d)), _fulltext(files, syms))


@query("r10_file_similarity", f"""WITH {_TOP_SQL}, t AS (SELECT query_id, path, kind, {terms_sql("path || ' ' || sample")} AS w, string_split(regexp_replace(path, '/?[^/]*$', ''), '/') AS s, contains(path, '/') AS deep FROM top WHERE rank <= 8),
p AS (SELECT a.query_id, a.path AS path_a, b.path AS path_b, (a.kind = b.kind)::INT AS k, len(list_intersect(a.w, b.w)) AS i, len(a.w) + len(b.w) AS n, greatest(CASE WHEN a.deep THEN len(a.s) ELSE 0 END, CASE WHEN b.deep THEN len(b.s) ELSE 0 END) AS m,
 coalesce(list_max(list_filter(range(0, least(len(a.s), len(b.s)) + 1), lambda x: a.s[1:x] = b.s[1:x])), 0) AS c FROM t a JOIN t b ON a.query_id = b.query_id AND a.path < b.path)
SELECT query_id, path_a, path_b, round(0.5 * CASE WHEN m = 0 THEN 0 ELSE c / m END + 0.3 * k + 0.2 * i / (n - i), 6) AS similarity FROM p""")
def r10(spark, d):
    return retrieval.similar_pairs(retrieval.top_by_relevance(_scored(spark, d)))


def _rows_sql(table: str, section: str, *metrics: str) -> str:
    return " UNION ALL ".join(f"SELECT root, '{section}' AS section, '{m}' AS metric, ({m})::DOUBLE AS value FROM {table}" for m in metrics)


@query("u4_weekly_report", f"""WITH {_DIFF_SQL}, {A.USAGE_SQL}, {A.INSTRUCTION_SQL}, {_FOUND},
stats AS (SELECT root, count(*) AS files, coalesce(sum(token_estimate), 0) AS tokens FROM cur GROUP BY root),
sync AS (SELECT root, count(*) FILTER (WHERE action = 'upsert') AS updated, count(*) FILTER (WHERE action IN ('unchanged', 'touched')) AS unchanged, count(*) FILTER (WHERE action = 'delete') AS deleted, 0 AS read_errors FROM diff GROUP BY root),
latest AS (SELECT root, action, path, row_number() OVER (PARTITION BY root ORDER BY coalesce(mtime, 0) // 5000 DESC, path DESC) AS rank FROM diff WHERE action IN ('upsert', 'delete')),
rep AS ({_REPORT.format(k='root,')} GROUP BY root), save AS (SELECT root, saved - sent AS net, saved + sent AS baseline, CASE WHEN saved + sent > 0 THEN saved / (saved + sent) ELSE 0 END AS reduction_ratio,
 CASE WHEN saved > 0 THEN sent / saved ELSE 0 END AS overhead_ratio, (CASE WHEN saved > 0 THEN sent / saved <= {R.OVERHEAD_BUDGET} ELSE sent = 0 END)::INT AS within_budget FROM rep),
ms AS (SELECT root, latency_ms, row_number() OVER (PARTITION BY root ORDER BY latency_ms) AS i, count(*) OVER (PARTITION BY root) AS n FROM usage WHERE kind = 'latency' AND latency_ms > 0),
lat AS (SELECT root, coalesce(min(latency_ms) FILTER (WHERE i >= ceil(0.95 * n)), 0) AS p95_ms FROM (SELECT DISTINCT root FROM usage) LEFT JOIN ms USING (root) GROUP BY root),
lint AS (SELECT root, count(*) FILTER (WHERE v = 'HIGH') AS high, count(*) FILTER (WHERE v = 'MEDIUM') AS medium, count(*) FILTER (WHERE v = 'LOW') AS low FROM (SELECT t.root, {_SEVERITY} AS v FROM (SELECT DISTINCT root FROM targets) t LEFT JOIN f USING (root)) GROUP BY root)
{_rows_sql("stats", "index", "files", "tokens")} UNION ALL {_rows_sql("sync", "sync", "updated", "unchanged", "deleted", "read_errors")} UNION ALL SELECT root, 'changes', action || ' ' || path, rank FROM latest WHERE rank <= 10
 UNION ALL {_rows_sql("rep", "usage", "calls", "cache_hits", "cache_misses", "token_estimate", "saved")} UNION ALL {_rows_sql("lat", "usage", "p95_ms")}
 UNION ALL {_rows_sql("save", "savings", "net", "baseline", "reduction_ratio", "overhead_ratio", "within_budget")} UNION ALL {_rows_sql("lint", "lint", "high", "medium", "low")}""")
def u4(spark, d):
    events = A.usage_events(spark, d)
    return usage.weekly_report(a3(spark, d), i4(spark, d), i5(spark, d), usage.usage_report(events, "root"), usage.p95_latency(events, "root"), l5_summary(spark, d))


#: Names of a usage report's fields as JSON, with the column each comes from.
_USAGE_FIELDS = (("total_calls", "calls"), ("cache_hits", "cache_hits"), ("cache_misses", "cache_misses"), ("estimated_tokens", "token_estimate"), ("estimated_saved_tokens", "saved"), ("cache_avoided_tokens", "avoided"), ("sent_context_tokens_estimate", "sent"), ("adjusted_saved_tokens", "adjusted"), ("ignored_tokens_estimate", "ignored"), ("p95_latency_ms", "p95_ms"))
_P95_SQL = "v AS (SELECT root, latency_ms, row_number() OVER (PARTITION BY root ORDER BY latency_ms) AS i, count(*) OVER (PARTITION BY root) AS n FROM usage WHERE kind = 'latency' AND latency_ms > 0), p AS (SELECT root, min(latency_ms) AS p95 FROM v WHERE i >= ceil(0.95 * n) GROUP BY root)"


@query("s5_json_report", f"WITH {A.USAGE_SQL}, {_P95_SQL}, r AS ({_REPORT.format(k='root,')} GROUP BY root), f AS (SELECT r.*, coalesce(p95, 0)::BIGINT AS p95_ms FROM r LEFT JOIN p USING (root)) SELECT root, to_json({{" + ", ".join(f"'{n}': {c}" for n, c in _USAGE_FIELDS) + "})::VARCHAR AS report FROM f")
def s5(spark, d):
    e = A.usage_events(spark, d)
    full = usage.usage_report(e, "root").join(usage.p95_latency(e, "root"), "root")
    return full.select("root", F.to_json(F.struct(*[F.col(c).alias(n) for n, c in _USAGE_FIELDS])).alias("report"))


@query("s5_scan_report", f"""WITH {SCANNED}, k AS (SELECT root, sum({tokens_sql('sample')})::BIGINT AS t FROM kept GROUP BY root),
tot AS (SELECT root, count(*) FILTER (WHERE pruned_folder IS NULL) AS seen, count(*) FILTER (WHERE pruned_folder IS NULL AND skip_reason IS NULL) AS idx, count(*) FILTER (WHERE pruned_folder IS NULL AND skip_reason IS NOT NULL) AS skip, count(DISTINCT pruned_folder) AS dirs FROM scanned GROUP BY root),
items AS (SELECT root, skip_reason AS reason, path AS item FROM scanned WHERE pruned_folder IS NULL AND skip_reason IS NOT NULL UNION ALL SELECT DISTINCT root, pruned_reason, pruned_folder FROM scanned WHERE pruned_folder IS NOT NULL),
rk AS (SELECT *, row_number() OVER (PARTITION BY root, reason ORDER BY string_split(item, '/')) AS i, count(*) OVER (PARTITION BY root, reason) AS n FROM items),
sk AS (SELECT root, reason, n, list(item ORDER BY i) AS ex FROM rk WHERE i <= 3 GROUP BY root, reason, n), sj AS (SELECT root, string_agg('"' || reason || '":{{"count":' || n || ',"representative_paths":' || to_json(ex)::VARCHAR || '}}', ',' ORDER BY reason) AS js FROM sk GROUP BY root)
SELECT root, '{{"root":"' || root || '","totals":{{"files_seen":' || seen || ',"files_indexed":' || idx || ',"files_skipped":' || skip || ',"directories_skipped":' || dirs || ',"estimated_tokens":' || coalesce(t, 0) || '}},"skipped_summary":{{' || coalesce(js, '') || '}}}}' AS report FROM tot LEFT JOIN k USING (root) LEFT JOIN sj USING (root)""")
def s5_scan(spark, d):
    s = written(scanned(spark, d))
    each = F.struct("reason", F.struct("count", F.col("examples").alias("representative_paths")).alias("x"))
    summary = scan.skipped_summary(s).groupBy("root").agg(F.map_from_entries(F.array_sort(F.collect_list(each))).alias("skipped_summary"))  # a row per reason
    t = scan.scan_totals(s).join(summary, "root", "left")
    totals = F.struct("files_seen", "files_indexed", "files_skipped", "directories_skipped", "estimated_tokens").alias("totals")
    return t.select("root", F.to_json(F.struct("root", totals, F.coalesce("skipped_summary", F.create_map().cast("map<string,struct<count:bigint,representative_paths:array<string>>>")).alias("skipped_summary"))).alias("report"))


@query("s5_scan_files", f"""WITH {SCANNED}, f AS (SELECT s.root, s.path, s.size_bytes, s.kind, s.weight, s.skip_reason, s.role, CASE WHEN s.skip_reason IS NULL THEN {tokens_sql("k.sample")} END AS tok FROM scanned s LEFT JOIN kept k ON k.root = s.root AND k.path = s.path WHERE s.pruned_folder IS NULL)
SELECT root, path, '{{"path":"' || path || '","size_bytes":' || size_bytes || ',"kind":"' || CASE WHEN skip_reason = 'gitignore' THEN (SELECT any_value({R.TEXT_KIND_CASE}) FROM named n WHERE n.root = f.root AND n.p = f.path) ELSE kind END || '","weight":' || CASE WHEN skip_reason = 'gitignore' THEN 0 ELSE weight END || ',"token_estimate":' || coalesce(tok, 0)
 || ',"skipped":' || (skip_reason IS NOT NULL) || coalesce(',"skip_reason":"' || skip_reason || '"', '') || CASE WHEN role <> '' THEN ',"role":"' || role || '"' ELSE '' END || '}}' AS entry FROM f""")
def s5_files(spark, d):
    s = scanned(spark, d).where("pruned_folder IS NULL")
    skipped = F.col("skip_reason").isNotNull().alias("skipped")
    entry = F.struct("path", "size_bytes", "kind", "weight", F.coalesce("token_estimate", F.lit(0)).alias("token_estimate"), skipped, "skip_reason", F.nullif("role", F.lit("")).alias("role"))
    return s.select("root", "path", F.to_json(entry).alias("entry"))


@query("s5_query_report")
def s5_query(spark, d):
    """What each query answers, as JSON: its results and the commands of its root, which the supplied manifests give to the repository of their number."""
    m = _manifests(spark, d).withColumn("root", F.concat(F.lit("src"), F.expr("int(substring(root, 2)) % 20").cast("string")))
    answers = retrieval.with_commands(r12(spark, d), A.queries(spark, d), commands.discover_commands(m.dropDuplicates(["root", "path"])))
    return answers.select("query_id", F.to_json(F.struct("root", "query", "top_k", "results", "commands")).alias("report"))
