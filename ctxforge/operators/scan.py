"""Scanning repositories: classes, pruned folders, ignore rules, profiles, roles, totals."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules as R
from ..functions import text as T


def with_names(files: DataFrame) -> DataFrame:
    return files.withColumn("p", T.normalize_path(F.col("path"))).withColumn("lp", F.lower("p")).withColumn("b", T.base_name(F.col("p"))).withColumn("ext", T.extension(F.col("p")))


def classify(files: DataFrame) -> DataFrame:
    """Adds kind, weight and class_skip (the reason that a file's class alone gives, or null)."""
    out = with_names(files).withColumn("kind", F.expr(R.KIND_CASE)).withColumn("weight", F.expr(R.WEIGHT_CASE))
    return out.withColumn("class_skip", F.when(F.col("kind").isin(*R.SKIPPED_KINDS), F.col("kind")))


def glob_regex(pattern: str) -> str | None:
    """One anchored regular expression for a pattern, over normalised paths."""
    pattern = re.sub(r"^(\./|/)", "", pattern.strip()).strip("/")
    if not pattern:
        return None
    q = lambda s: re.sub(r"([.^$+(){}|\[\]\\])", r"\\\1", s)
    part = lambda s: q(s).replace("**", "\0").replace("*", "[^/]*").replace("?", "[^/]").replace("\0", ".*")
    exact = f"{q(pattern).replace('*', '[*]').replace('?', '[?]')}(/.*)?"
    if pattern.endswith("/**"):
        more = f"{q(pattern[:-3]).replace('*', '[*]')}(/.*)?"
    elif "**" in pattern:
        more = part(pattern)
    elif "/" in pattern:
        more = f"{part(pattern)}|.*/{q(pattern).replace('*', '[*]').replace('?', '[?]')}"
    else:
        more = f"(.*/)?{part(pattern)}(/.*)?"
    return f"^(?:{exact}|{more})$"


def ignore_rules(files: DataFrame, names=((".gitignore", "gitignore"), (".contextgateignore", "contextgateignore"))) -> DataFrame:
    """root, seq, pattern, source, directory_only: the lines of the ignore files at each root, first file first."""
    known = F.create_map(*[F.lit(x) for i, (n, s) in enumerate(names) for x in (n, f"{i}{s}")])
    lines = files.where(F.col("path").isin(*[n for n, _ in names])).select("root", F.try_element_at(known, F.col("path")).alias("src"), F.posexplode(F.split("content", "\n")).alias("line_no", "line"))
    lines = lines.withColumn("line", F.btrim("line", F.lit(" \t\r"))).where(~F.col("line").rlike("^($|#|!)"))
    return lines.select("root", (F.substring("src", 1, 1).cast("int") * 1_000_000 + F.col("line_no")).alias("seq"), F.regexp_replace("line", "/+$", "").alias("pattern"), F.expr("substring(src, 2)").alias("source"), F.col("line").endswith("/").alias("directory_only"))


def rule_regex(pattern: Column) -> Column:
    """The same translation as glob_regex for patterns in a column."""
    pattern = F.regexp_replace(pattern, r"^(\./|/)", "")
    quote = lambda c: F.regexp_replace(c, r"([.^$+(){}|\[\]\\])", r"\\$1")
    plain = lambda c: F.replace(F.replace(quote(c), F.lit("*"), F.lit("[*]")), F.lit("?"), F.lit("[?]"))
    body = F.replace(F.replace(F.replace(F.replace(quote(pattern), F.lit("**"), F.lit("\x01")), F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]")), F.lit("\x01"), F.lit(".*"))
    more = (
        F.when(pattern.endswith("/**"), F.concat(plain(F.regexp_replace(pattern, r"/\*\*$", "")), F.lit("(/.*)?")))
        .when(F.contains(pattern, F.lit("**")), body).when(F.contains(pattern, F.lit("/")), F.concat(body, F.lit("|.*/"), plain(pattern)))
        .otherwise(F.concat(F.lit("(.*/)?"), body, F.lit("(/.*)?")))
    )
    return F.concat(F.lit("^(?:"), plain(pattern), F.lit("(/.*)?|"), more, F.lit(")$"))


def builtin_reason(folder: Column) -> Column:
    """Why the built-in lists prune a folder; null if they don't."""
    last = F.regexp_extract(folder, r"[^/]*$", 0)
    return F.when(folder.isin(".opencode/skills", ".ai-docs"), "ai_cache").when(last.isin(*R.ARTIFACT_DIRS), "build_artifact").when(last.isin(*R.IDE_DIRS), "ide_config")


def any_glob(path: Column, patterns) -> Column:
    regexes = [r for r in map(glob_regex, patterns) if r]
    return path.rlike("|".join(regexes)) if regexes else F.lit(False)


#: Roots with ignore rules that are sent to all tasks; beyond that files are joined with rules by a shuffle.
MOST_RULED = 100_000


def scan(files: DataFrame, include=(), exclude=()) -> DataFrame:
    """Every file with kind, weight, role, sample, token_estimate, skip_reason (null if kept) and pruned folder.

    Rules are few per repository, so they are matched after a join on root; the shallowest pruned
    folder wins; at equal depth the exclude patterns come before ignore rules, those before the
    built-in lists. A file is skipped by the first of: exclude, no match in a given include list,
    ignore rules, its class, its content. The first three leave it its kind as text and no weight.
    """
    rules = ignore_rules(files).select("root", "seq", "source", rule_regex(F.col("pattern")).alias("regex")).groupBy("root").agg(F.array_sort(F.collect_list(F.struct("seq", "source", "regex"))).alias("rules"))
    if rules.limit(MOST_RULED + 1).count() <= MOST_RULED:
        rules = F.broadcast(rules)  # else contents would be shuffled by root
    sized = files if "size_bytes" in files.columns else files.withColumn("size_bytes", F.lit(None).cast("long"))
    out = classify(sized).join(rules, "root", "left")
    none = F.array().cast("array<struct<seq:int,source:string,regex:string>>")
    first = lambda p: F.get(F.filter(F.coalesce("rules", none), lambda r: F.regexp_like(p, r["regex"])), F.lit(0))["source"]
    excluded = lambda p: F.when(any_glob(p, exclude), "user_exclude")
    folders = F.filter(T.ancestors(F.col("p")), lambda d: d != "")
    judged = F.transform(folders, lambda d: F.struct(d.alias("folder"), F.coalesce(excluded(d), first(d), builtin_reason(d)).alias("reason")))
    out = out.withColumn("pruned", F.get(F.filter(judged, lambda x: x["reason"].isNotNull()), F.lit(0)))
    alive = F.col("pruned").isNull()
    p = F.col("p")
    early = F.coalesce(excluded(p), F.when(~any_glob(p, include), "include_mismatch") if include else F.lit(None).cast("string"), first(p))
    late = F.coalesce("class_skip", F.when(F.col("content").isNull(), "read_error"), F.when(T.is_binary(F.col("content")), "binary"))
    out = out.withColumn("early", F.when(alive, early)).withColumn("skip_reason", F.when(alive, F.coalesce("early", late)))
    out = out.withColumn("sample", F.when(alive & F.col("skip_reason").isNull(), T.sample(F.col("content")))).withColumn("role", F.expr(R.ROLE_CASE))
    kind = F.when(F.col("early").isNotNull(), F.expr(R.TEXT_KIND_CASE)).when(F.col("skip_reason") == "binary", "binary").otherwise(F.col("kind"))
    weight = F.when(F.col("early").isNotNull() | F.col("skip_reason").isin("binary", "read_error"), 0).otherwise(F.col("weight"))
    out = out.withColumn("token_estimate", T.token_estimate(F.col("sample"))).withColumn("size_bytes", F.coalesce("size_bytes", F.octet_length("content")).cast("long"))
    return out.select("root", p.alias("path"), "mtime", kind.alias("kind"), weight.alias("weight"), "role", "size_bytes", "token_estimate", "skip_reason", F.col("pruned.folder").alias("pruned_folder"), F.col("pruned.reason").alias("pruned_reason"), "sample", "content")


def scan_totals(scanned: DataFrame) -> DataFrame:
    alive = F.col("pruned_folder").isNull()
    return scanned.groupBy("root").agg(
        F.count_if(alive).alias("files_seen"), F.count_if(alive & F.col("skip_reason").isNull()).alias("files_indexed"), F.count_if(alive & F.col("skip_reason").isNotNull()).alias("files_skipped"),
        F.count_distinct("pruned_folder").alias("directories_skipped"), F.coalesce(F.sum(F.when(alive & F.col("skip_reason").isNull(), F.col("token_estimate"))), F.lit(0)).cast("long").alias("estimated_tokens"),
    )


def skipped_summary(scanned: DataFrame) -> DataFrame:
    """Per root and reason: how many files and pruned folders, and the first three in walk order."""
    one = scanned.where("pruned_folder IS NULL AND skip_reason IS NOT NULL").select("root", F.col("skip_reason").alias("reason"), F.col("path").alias("item"))
    two = scanned.where("pruned_folder IS NOT NULL").select("root", F.col("pruned_reason").alias("reason"), F.col("pruned_folder").alias("item")).distinct()
    items = one.unionByName(two).withColumn("order", F.split("item", "/"))
    counts = items.groupBy("root", "reason").agg(F.count("*").alias("count"))
    top = items.withColumn("i", F.row_number().over(Window.partitionBy("root", "reason").orderBy("order"))).where("i <= 3")
    firsts = top.groupBy("root", "reason").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "item"))), lambda x: x["item"]).alias("examples"))
    return counts.join(firsts, ["root", "reason"])


def profile_signals(files: DataFrame) -> DataFrame:
    """root, dir and what the files below each project folder show: a join on ancestor folders, then a combined aggregate."""
    named = with_names(files.select("root", "path", "content"))
    b, ext = F.col("b"), F.col("ext")
    roots = named.where(b.isin("angular.json", "package.json", "pom.xml", "build.gradle", "settings.gradle") | b.startswith("vite.config.")).select("root", T.folder(F.col("p")).alias("dir")).distinct()
    flags = {"angular": b == "angular.json", "package": b == "package.json", "jvm_build": b.isin("pom.xml", "build.gradle", "settings.gradle"), "vite": b.startswith("vite.config."), "vue": ext == ".vue", "jsx": ext.isin(".tsx", ".jsx"), "java": ext.isin(".java", ".kt"), "spring": ext.isin(".java", ".kt") & F.contains("content", F.lit("@SpringBootApplication"))}
    each = named.select("root", F.explode(T.ancestors(F.col("p"))).alias("dir"), *[c.alias(n) for n, c in flags.items()]).join(roots, ["root", "dir"])
    return each.groupBy("root", "dir").agg(*[F.bool_or(n).alias(n) for n in flags])


def profiles(files: DataFrame) -> DataFrame:
    """root, dir, profile: every project folder and the framework that the files below it show."""
    return profile_signals(files).select("root", "dir", F.expr(R.PROFILE_CASE).alias("profile")).where("profile IS NOT NULL")


def profile_of_files(files: DataFrame, found: DataFrame) -> DataFrame:
    """root, path, profile of the deepest project folder above each file, null without one."""
    p = files.select("root", "path")
    best = p.select("root", "path", F.explode(T.ancestors(F.col("path"))).alias("dir")).join(found, ["root", "dir"]).groupBy("root", "path").agg(F.max_by("profile", F.length("dir")).alias("profile"))
    return p.join(best, ["root", "path"], "left")
