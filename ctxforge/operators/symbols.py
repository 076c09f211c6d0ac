"""Symbols of source files: names, kinds and lines, by family of languages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules as R
from ..functions import text as T

# Patterns of declarations; group 1 is the name.
STORE = r"""defineStore\(\s*['"]([A-Za-z0-9_-]+)['"]"""
SLICE = r"""createSlice\(\s*\{[^}]*name:\s*['"]([A-Za-z0-9_-]+)['"]"""
USES = r"export\s+(?:const|function)\s+(use[A-Z][A-Za-z0-9_]*)"
ROUTE_PATH = r"""path:\s*['"]([^'"]+)['"]"""
ROUTE_TAG = r"""<Route\s+[^>]*path=['"]([^'"]+)['"]"""
ROUTER = r"createRouter\s*\(|createBrowserRouter\s*\(|RouterModule\.for(?:Root|Child)"
FUNCTIONS = r"export\s+(?:async\s+)?function\s+([A-Za-z_][A-Za-z0-9_]*)"
CONSTANTS = r"export\s+const\s+([A-Za-z_][A-Za-z0-9_]*)\s*[:=]"
COMPONENT_FN = r"(?:export\s+default\s+function|export\s+function|function)\s+([A-Z][A-Za-z0-9_]*)\s*\("
COMPONENT_VAR = r"(?:export\s+)?const\s+([A-Z][A-Za-z0-9_]*)\s*[:=]"
DECORATED = ((r"@Component\(", "component"), (r"@Injectable\(", "service"), (r"@NgModule\(", "module"))
SCRIPT_CLASS = r"export\s+class\s+([A-Za-z_][A-Za-z0-9_]*)"
ANNOTATED = ((r"@(?:RestController|Controller)\b", "controller"), (r"@Service\b", "service"), (r"@(?:Repository|Mapper)\b", "repository"), (r"@Entity\b", "entity"))
JVM_CLASS = r"(?:public\s+)?(?:class|interface)\s+([A-Za-z_][A-Za-z0-9_]*)"
JVM_REPOSITORY = r"interface\s+([A-Za-z_][A-Za-z0-9_]*)\s+extends\s+[A-Za-z]*Repository"
MAPPING = r"""@(?:Get|Post|Put|Delete|Patch|Request)Mapping\(\s*(?:value\s*=\s*)?['"]([^'"]*)['"]"""
SCRIPT_EXT, JSX_EXT, JVM_EXT = (".ts", ".js", ".mts", ".cts", ".mjs", ".cjs"), (".tsx", ".jsx"), (".java", ".kt")


def _found(pattern: str, kind: str, text: str) -> Iterator[tuple[str, str, int]]:
    for m in re.finditer(pattern, text, re.ASCII):
        yield m[1], kind, 1 + text.count("\n", 0, m.start())


def symbols_of(path: str, text: str) -> Iterator[tuple[str, str, int]]:
    """(name, kind, line) in order of emission, before deduplication."""
    low = path.lower().replace("\\", "/")
    base, ext = re.sub(r"(?<=.)\.[^.]*$", "", low.rpartition("/")[2]), (re.search(r"\.[^./]*$", low) or [""])[0]
    if ext in JVM_EXT:
        kind = next((k for p, k in ANNOTATED if re.search(p, text, re.ASCII)), None)
        if kind:
            yield from _found(JVM_CLASS, kind, text)
        yield from _found(JVM_REPOSITORY, "repository", text)
        yield from ((n or "/", k, i) for n, k, i in _found(MAPPING, "endpoint", text))
        return
    if ext == ".vue":
        yield base, "component", 1
    elif ext not in SCRIPT_EXT + JSX_EXT:
        return
    jsx = ext in JSX_EXT
    rules = [(STORE, "store"), (SLICE, "store"), (USES, "hook" if jsx else "composable")]
    router = re.search(ROUTER, text, re.ASCII) or any(s in low for s in ("/router", "/routes", "-routing.module")) or base == "router"
    if router:
        rules += [(ROUTE_PATH, "route"), (ROUTE_TAG, "route")]
    for p, k in rules:
        yield from _found(p, k, text)
    if router:
        yield base, "route", 1
    if "/service" in low or "/api" in low:
        yield from _found(FUNCTIONS, "api-method", text)
        yield from _found(CONSTANTS, "api-method", text)
    for mark, k in DECORATED:
        if re.search(mark, text):
            yield from _found(SCRIPT_CLASS, k, text)
    if jsx:
        yield from _found(COMPONENT_FN, "component", text)
        yield from _found(COMPONENT_VAR, "component", text)


def extract_symbols(files: DataFrame) -> DataFrame:
    """root, path, seq, name, kind, line from the first 16 KiB of (root, path, content); other extensions are filtered first, and heads that hold a NUL have no symbols."""
    some = files.where(T.extension(F.col("path")).isin(".vue", *SCRIPT_EXT, *JSX_EXT, *JVM_EXT))
    raw = F.substring(F.col("content").cast("binary"), 1, R.HEAD_BYTES)
    some = some.where(~F.contains(raw, F.unhex(F.lit("00"))))
    head = F.make_valid_utf8(raw.cast("string"))

    def run(pdfs):
        import pandas as pd

        for pdf in pdfs:
            rows = [(r, p, i, n, k, line) for r, p, h in zip(pdf["root"], pdf["path"], pdf["head"], strict=True) for i, (n, k, line) in enumerate(symbols_of(p, h))]
            yield pd.DataFrame(rows, columns=["root", "path", "seq", "name", "kind", "line"])

    return some.select("root", "path", head.alias("head")).mapInPandas(run, "root string, path string, seq int, name string, kind string, line int")


def symbols_in(path: F.Column, content: F.Column) -> F.Column:
    """A file's symbols after deduplication, in order of emission: an array of name, kind, line; what ``dedupe_symbols(extract_symbols)`` says in the file's own row."""
    raw = F.substring(content.cast("binary"), 1, R.HEAD_BYTES)
    on = T.extension(path).isin(".vue", *SCRIPT_EXT, *JSX_EXT, *JVM_EXT) & ~F.contains(raw, F.unhex(F.lit("00")))

    @F.pandas_udf("array<struct<name:string,kind:string,line:int>>")
    def found(paths: pd.Series, heads: pd.Series) -> pd.Series:
        rows = []
        for p, h in zip(paths, heads, strict=True):
            first = {}
            for n, k, line in symbols_of(p, h) if h is not None else ():
                if n:
                    first.setdefault((n, k), {"name": n, "kind": k, "line": line})
            rows.append(list(first.values()))
        return pd.Series(rows, dtype=object)

    return found(path, F.when(on, F.make_valid_utf8(raw.cast("string"))))


def symbol_weight(kind) -> F.Column:
    known = F.create_map(*[F.lit(x) for p in R.SYMBOL_WEIGHTS.items() for x in p])
    return F.coalesce(F.try_element_at(known, kind), F.lit(40))


def dedupe_symbols(found: DataFrame) -> DataFrame:
    w = Window.partitionBy("root", "path", "kind", "name").orderBy("seq")
    out = found.where("name <> ''").withColumn("i", F.row_number().over(w)).where("i = 1")
    return out.select("root", "path", "name", "kind", "line", symbol_weight(F.col("kind")).alias("weight"))


def symbol_terms(symbols: DataFrame) -> DataFrame:
    return symbols.select("root", "path", F.explode(T.tokenize(F.col("name"))).alias("term")).distinct()
