"""Text and path functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R


def token_estimate(text: Column) -> Column:
    """Tokens a text costs: a quarter of ASCII, 3/2 of CJK and 2/3 of other characters, each rounded up."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), R.UNICODE_SPACE, "")
    ascii_n, cjk_n = F.length(F.regexp_replace(bare, r"[^\x00-\x7F]", "")), F.length(F.regexp_replace(bare, f"[^{R.CJK}]", ""))
    other_n = F.length(bare) - ascii_n - cjk_n
    return (F.floor((ascii_n + 3) / 4) + F.floor((cjk_n * 3 + 1) / 2) + F.floor((other_n * 2 + 2) / 3)).cast("int")


def tokenize(text: Column) -> Column:
    """Distinct lower-case terms of two characters or more, in order of first sight."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{Nd}]+"), lambda t: F.length(t) > 1))


# Accented Latin letters and what they are without accents.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz"


def fold_accents(text: Column) -> Column:
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def normalize_path(path: Column) -> Column:
    """Forward slashes, no leading ./, no empty, . or .. segments; nothing for the folder itself."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda s: ~s.isin("", "."))
    up = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda a, s: F.when((s == "..") & (F.size(a) > 0) & (F.coalesce(F.get(a, F.size(a) - 1), F.lit("..")) != ".."), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s))),
    )
    return F.concat(F.when(F.replace(path, F.lit("\\"), F.lit("/")).startswith("/"), "/").otherwise(""), F.array_join(up, "/"))


def base_name(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]*$", 0))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./]*$", 0))


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def ancestors(path: Column) -> Column:
    """Folders that hold a path, from the root ('') down."""
    parts = F.split(folder(path), "/")
    return F.array_distinct(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))))


def sample_bytes(content: Column) -> Column:
    """What is sampled of a file's bytes: all up to 64 KiB, else the last 8 KiB."""
    raw = content.cast("binary")
    return F.when(F.octet_length(raw) > R.LARGE_BYTES, F.substring(raw, -R.TAIL_BYTES, R.TAIL_BYTES)).otherwise(raw)


def sample(content: Column) -> Column:
    """The sample as text."""
    return F.make_valid_utf8(sample_bytes(content).cast("string"))


def is_binary(content: Column) -> Column:
    raw = content.cast("binary")
    return F.contains(F.when(F.octet_length(raw) > R.LARGE_BYTES, F.substring(raw, -R.TAIL_BYTES, R.TAIL_BYTES)).otherwise(raw), F.unhex(F.lit("00")))


def once(value: Column, body) -> Column:
    """body(value) with value computed once per row, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def prefix_sums(values: Column, most: int = 30) -> Column:
    """Sums of an array's first 1, 2, ... values: each pass adds the value twice as far back, so n values (2**most at most) cost n log n."""

    def added(back: int):
        return lambda a: F.when(F.size(a) > back, F.transform(a, lambda v, i: v + F.coalesce(F.get(a, i - back), F.lit(0)))).otherwise(a)

    for k in range(most):
        values = once(values, added(1 << k))
    return values


def snippet(text: Column, path: Column, terms: Column) -> Column:
    """90 characters before the first query term that occurs and 90 after; else the first 180."""
    flat = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), R.UNICODE_SPACE + "+", " "))

    def first_hit(low: Column) -> Column:
        return F.get(F.filter(F.transform(terms, lambda t: F.instr(low, t)), lambda i: i > 0), F.lit(0))

    def clipped(s: Column, at: Column) -> Column:
        begin = F.greatest(at - 91, F.lit(0))
        around = F.concat(F.when(begin > 0, "...").otherwise(""), s.substr(begin + 1, F.lit(180)), F.when(begin + 180 < F.length(s), "...").otherwise(""))
        head = F.concat(s.substr(F.lit(1), F.lit(180)), F.when(F.length(s) > 180, "...").otherwise(""))
        return F.when(at.isNotNull(), around).otherwise(head)

    shown = once(flat, lambda f: F.when(f == "", path).otherwise(f))
    return once(shown, lambda s: once(once(F.lower(s), first_hit), lambda at: clipped(s, at)))


def detect_intent(query: Column, part: int) -> Column:
    """Symbol kinds (part 1), path segments (2) or roles (3) that the query's words ask for."""
    low = F.lower(query)
    each = []
    for rule in R.INTENTS:
        hit = F.lit(False)
        for t in rule[0]:
            hit = hit | F.contains(low, F.lit(t))
        values = F.array(*[F.lit(v) for v in rule[part]]) if rule[part] else F.array().cast("array<string>")
        each.append(F.when(hit, values).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(*each))


#: How many results a query gets if it doesn't say, and at most.
DEFAULT_TOP_K, MAX_TOP_K = 8, 20


def clamp_topk(k: Column) -> Column:
    return F.least(F.greatest(F.coalesce(k, F.lit(DEFAULT_TOP_K)), F.lit(1)), F.lit(MAX_TOP_K))


def cache_key(tool: Column, args: Column, schema: Column) -> Column:
    """tool:sha256(args as JSON with sorted keys):schema; null if a part is empty or holds a colon."""
    return _cache_key(tool, F.to_json(F.map_from_entries(F.array_sort(F.map_entries(args)))), schema)


def cache_key_json(tool: Column, args: Column, schema: Column) -> Column:
    """The same for arguments of any shape as JSON text: keys are sorted at every depth, blanks dropped; null if the text is no JSON."""
    return _cache_key(tool, F.to_json(F.try_parse_json(args)), schema)


def _cache_key(tool: Column, body: Column, schema: Column) -> Column:
    version = F.coalesce(F.nullif(schema, F.lit("")), F.lit("v1"))
    for raw, esc in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")):
        body = F.replace(body, F.lit(raw), F.lit(esc))
    good = (tool != "") & ~F.contains(tool, F.lit(":")) & ~F.contains(version, F.lit(":"))
    return F.when(good & body.isNotNull(), F.concat_ws(":", tool, F.sha2(body, 256), version))
