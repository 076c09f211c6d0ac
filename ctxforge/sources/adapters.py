"""Supplied tables as repositories, queries, usage events and cache logs; SQL says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Path, header by (doc_id div 20) % 14; {d} is the id.
SHAPES = (
    ("src/router/r{d}.ts", "export default createRouter({ routes: [{ path: \"/r{d}\" }] })"),
    ("src/stores/s{d}.ts", "export const s{d} = defineStore(\"store{d}\", {})"),
    ("src/services/order{d}Api.ts", "export async function fetchOrder{d}() {}"),
    ("src/pages/P{d}Page.vue", "<template>"),
    ("src/components/C{d}.vue", "<template>"),
    ("src/composables/use{d}.ts", "export const useX{d} = () => 1"),
    ("src/main/java/app/controller/Order{d}Controller.java", "@RestController public class Order{d}Controller { @GetMapping(\"/o{d}\")"),
    ("docs/d{d}.md", "# notes"),
    ("types/t{d}.d.ts", "declare module x"),
    ("node_modules/m{d}/index.js", "module.exports = 1"),
    ("assets/a{d}.png", "png"),
    ("vendor/l{d}.lock", "lock"),
    ("android/app/c{d}.xml", "<xml/>"),
    ("scratch/x{d}.log", "log"),
)
MARKERS = (("angular.json", "{}"), ("pom.xml", "<project/>"), ("vite.config.ts", "export default {}"), ("package.json", "{}"))
IGNORE_FILE = "scratch/\n*.tmp\n# note\n!keep.tmp\n"


def _pick(values, k) -> str:
    return "CASE " + k + " " + " ".join(f"WHEN {i} THEN " + ("'" + v.replace("{d}", "' || d || '") + "'") for i, v in enumerate(values)) + " END"


PATH_CASE = "CASE WHEN k = 13 AND odd = 1 THEN 'notes/x' || d || '.tmp' WHEN k = 4 AND odd = 1 THEN 'packages/web/src/components/C' || d || '.vue' ELSE " + _pick([p for p, _ in SHAPES], "k") + " END"
HEAD_CASE = _pick([h for _, h in SHAPES], "k")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """root, path, mtime, content: documents as files of repositories, with a marker and an ignore file for each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("source").alias("root"))
    d = docs.withColumn("k", F.expr("(doc_id div 20) % 14")).withColumn("odd", F.expr("doc_id % 2")).withColumn("d", F.col("doc_id").cast("string"))
    content = F.concat(F.expr(HEAD_CASE), F.lit("\n"), F.col("text"), F.when(F.col("doc_id") % 50 == 0, F.concat(F.lit("\n"), F.repeat(F.lit("pad "), 17000))).otherwise(F.lit("")))
    rows = d.select("root", F.expr(PATH_CASE).alias("path"), (F.col("doc_id") * 1000).alias("mtime"), content.alias("content"))
    roots = d.select("root").distinct().withColumn("n", F.substring("root", 4, 9).cast("int") % 4)
    marks = roots.select("root", F.expr(_pick([m for m, _ in MARKERS], "n")).alias("path"), F.lit(0).cast("long").alias("mtime"), F.expr(_pick([c for _, c in MARKERS], "n")).alias("content"))
    package = roots.where("n = 2").select("root", F.lit("package.json").alias("path"), F.lit(0).cast("long").alias("mtime"), F.lit("{}").alias("content"))
    ignore = roots.select("root", F.lit(".gitignore").alias("path"), F.lit(0).cast("long").alias("mtime"), F.lit(IGNORE_FILE).alias("content"))
    nested = roots.where("n <> 2").select("root", F.lit("packages/web/package.json").alias("path"), F.lit(0).cast("long").alias("mtime"), F.lit("{}").alias("content"))
    return rows.unionByName(marks).unionByName(package).unionByName(nested).unionByName(ignore)


FILES_SQL = f"""fd AS (SELECT doc_id, coalesce(text, '') AS text, source AS root, (doc_id // 20) % 14 AS k, doc_id % 2 AS odd, doc_id::VARCHAR AS d FROM documents),
fr AS (SELECT DISTINCT root, substring(root, 4)::INT % 4 AS n FROM fd),
files AS (SELECT root, {PATH_CASE} AS path, doc_id * 1000 AS mtime, {HEAD_CASE} || chr(10) || text || CASE WHEN doc_id % 50 = 0 THEN chr(10) || repeat('pad ', 17000) ELSE '' END AS content FROM fd
 UNION ALL SELECT root, {_pick([m for m, _ in MARKERS], "n")}, 0, {_pick([c for _, c in MARKERS], "n")} FROM fr
 UNION ALL SELECT root, 'package.json', 0, '{{}}' FROM fr WHERE n = 2
 UNION ALL SELECT root, 'packages/web/package.json', 0, '{{}}' FROM fr WHERE n <> 2
 UNION ALL SELECT root, '.gitignore', 0, 'scratch/' || chr(10) || '*.tmp' || chr(10) || '# note' || chr(10) || '!keep.tmp' || chr(10) FROM fr)"""


INSTRUCTION_CASE = "CASE m % 6 WHEN 0 THEN 'AGENTS.md' WHEN 1 THEN 'CLAUDE.md' WHEN 2 THEN 'GEMINI.md' WHEN 3 THEN '.github/copilot-instructions.md' ELSE 'notes/n' || m || '.md' END"


def instruction_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """root, path, content: six documents in a row as files of a repository, four of them instructions; every 50th is unreadable."""
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "coalesce(text, '') AS text", "source", "doc_id div 20 AS m")
    return docs.selectExpr("concat(source, '/', m div 6) AS root", f"{INSTRUCTION_CASE} AS path", "CASE WHEN doc_id % 50 <> 0 THEN text END AS content")


INSTRUCTION_SQL = f"""im AS (SELECT doc_id, coalesce(text, '') AS text, source, doc_id // 20 AS m FROM documents),
ifiles AS (SELECT source || '/' || (m // 6) AS root, {INSTRUCTION_CASE} AS path, m % 6 AS doc_seq, CASE WHEN doc_id % 50 <> 0 THEN text END AS text FROM im),
targets AS (SELECT root, doc_seq, path AS file, text FROM ifiles WHERE doc_seq < 4), ld AS (SELECT * FROM targets WHERE text IS NOT NULL)"""


INTENT_WORDS = ("router", "component", "store", "service api", "controller")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, root, query, top_k: the first words of each benchmark item with an intent word, for every repository of its residue."""
    items = table(spark, sf_dir, "benchmark")
    roots = table(spark, sf_dir, "documents").select(F.col("source").alias("root")).distinct()
    words = F.array_join(F.slice(F.split(F.col("text"), r"\s+"), 1, 3), " ")
    intent = F.element_at(F.array(*[F.lit(w) for w in INTENT_WORDS]), (F.col("item_id") % 5 + 1).cast("int"))
    q = F.when(F.col("item_id") % 7 == 6, F.lit("qqzzxx")).otherwise(F.concat_ws(" ", words, intent))
    both = items.withColumn("r", F.col("item_id") % 20).join(roots.withColumn("r", F.substring("root", 4, 9).cast("long")), "r")
    return both.select(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("query_id"), "root", q.alias("query"), F.lit(8).alias("top_k"))


QUERIES_SQL = f"""queries AS (SELECT 'q' || item_id AS query_id, root, CASE WHEN item_id % 7 = 6 THEN 'qqzzxx' ELSE array_to_string(string_split_regex(text, '\\s+')[1:3], ' ') || ' ' || ['{"', '".join(INTENT_WORDS)}'][(item_id % 5 + 1)::INT] END AS query, 8 AS top_k
 FROM benchmark JOIN (SELECT DISTINCT source AS root FROM documents) ON substring(root, 4)::BIGINT = item_id % 20)"""


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage events of the supplied event stream; each kind carries its own measures."""
    e = table(spark, sf_dir, "events")
    kind = F.create_map(*[F.lit(x) for p in USAGE_KINDS.items() for x in p])
    on = lambda t, v: F.when(F.col("event_type") == t, v).otherwise(F.lit(0)).cast("long")
    i = F.col("event_id")
    return e.select(
        "event_id", F.try_element_at(kind, F.col("event_type")).alias("kind"), F.lit("").alias("tool"), F.concat(F.lit("r"), (F.col("user_id") % 10).cast("string")).alias("root"), F.col("ts").alias("created_at"),
        on("error", i % 1000).alias("token_estimate"), on("error", i % 500).alias("sent"), on("error", i % 300).alias("ignored"),
        on("view", i % 700).alias("saved"), on("view", i % 700).alias("avoided"), on("view", i % 200).alias("adjusted"), on("purchase", F.floor("value")).alias("latency_ms"),
    )


USAGE_KINDS = {"click": "call", "view": "cache_hit", "signup": "cache_miss", "purchase": "latency", "error": "token_estimate"}
USAGE_SQL = "usage AS (SELECT event_id, CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in USAGE_KINDS.items()) + """ END AS kind, '' AS tool, 'r' || (user_id % 10) AS root, ts AS created_at,
 CASE WHEN event_type = 'error' THEN event_id % 1000 ELSE 0 END AS token_estimate, CASE WHEN event_type = 'error' THEN event_id % 500 ELSE 0 END AS sent, CASE WHEN event_type = 'error' THEN event_id % 300 ELSE 0 END AS ignored,
 CASE WHEN event_type = 'view' THEN event_id % 700 ELSE 0 END AS saved, CASE WHEN event_type = 'view' THEN event_id % 700 ELSE 0 END AS avoided, CASE WHEN event_type = 'view' THEN event_id % 200 ELSE 0 END AS adjusted,
 CASE WHEN event_type = 'purchase' THEN floor(value)::BIGINT ELSE 0 END AS latency_ms FROM events)"""


def cache_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, op, ttl_ms, at_ms, seq: events as reads and writes of a result cache."""
    e = table(spark, sf_dir, "events").where("event_type <> 'error'")
    op = F.when(F.col("event_type") == "view", "get").when(F.col("event_type") == "signup", "delete").otherwise("set")
    return e.select(F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("key"), op.alias("op"), ((F.col("event_id") % 5) * 3600000).alias("ttl_ms"), F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts) * 1000").alias("at_ms"), F.col("event_id").alias("seq"))


CACHE_SQL = """log AS (SELECT 'k' || user_id AS key, CASE event_type WHEN 'view' THEN 'get' WHEN 'signup' THEN 'delete' ELSE 'set' END AS op, (event_id % 5) * 3600000 AS ttl_ms, epoch_us(ts) // 1000000 * 1000 AS at_ms, event_id AS seq FROM events WHERE event_type <> 'error')"""
