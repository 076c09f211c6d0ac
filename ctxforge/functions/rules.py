"""Fixed values that results depend on, in one place, so that any result can be explained item by item."""

# File classes.
LOCKFILES = ("pnpm-lock.yaml", "package-lock.json", "yarn.lock")
DOC_EXT = (".md", ".markdown", ".rst", ".adoc", ".txt")
CONFIG_NAMES = ("package.json", "tsconfig.json", "jsconfig.json", "angular.json", "project.json", "nx.json", "go.mod", "go.sum", "pom.xml", "build.gradle", "settings.gradle", "makefile", "dockerfile", ".gitignore", ".contextgateignore")
CONFIG_EXT = (".json", ".yaml", ".yml", ".toml", ".xml", ".ini", ".properties", ".env")
SOURCE_EXT = (".go", ".js", ".jsx", ".ts", ".tsx", ".vue", ".java", ".kt", ".kts", ".py", ".rb", ".rs", ".c", ".cc", ".cpp", ".h", ".hpp", ".cs", ".php", ".swift", ".m", ".mm", ".sql", ".sh", ".bash", ".zsh", ".ps1", ".html", ".css", ".scss", ".sass", ".less")
BINARY_EXT = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".ico", ".svg", ".svgz", ".pdf", ".zip", ".gz", ".tgz", ".jar", ".war", ".ear", ".class", ".apk", ".ipa", ".dmg", ".exe", ".dll", ".so", ".dylib", ".woff", ".woff2", ".ttf", ".otf", ".eot", ".bin")
ANDROID_EXT = (".gradle", ".xml", ".properties", ".json", ".yaml", ".yml", ".toml")
ARTIFACT_DIRS = ("node_modules", "dist", "build", "target", "coverage", "tmp", "logs")
IDE_DIRS = (".git", ".idea", ".gradle")
LARGE_BYTES, TAIL_BYTES, HEAD_BYTES = 64 * 1024, 8 * 1024, 16 * 1024

# White space, scripts counted by character, scope words.
UNICODE_SPACE = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}"
SCOPE_WORDS = ("scope", "path", "路径", "作用域", "适用", "范围")

# Query intents - triggers, symbol kinds, path segments, roles.
INTENTS = (
    (("路由", "route", "router", "routing"), ("route",), ("router", "routes"), ("route-definition",)),
    (("组件", "component", "页面", "page", "view", "视图"), ("component",), ("components", "pages", "views"), ("page-view", "component")),
    (("状态", "store", "状态管理", "pinia", "vuex", "redux"), ("store",), ("store", "stores"), ("store",)),
    (("服务", "接口", "api", "service", "http", "请求"), ("service", "api-method"), ("services", "service", "api"), ("service",)),
    (("controller", "控制器", "endpoint", "mapping"), ("controller", "endpoint"), ("controller", "web"), ("controller",)),
    (("repository", "dao", "mapper", "持久化", "仓储"), ("repository",), ("repository", "dao", "mapper"), ("repository",)),
    (("composable", "hook", "钩子"), ("composable", "hook"), ("composables", "hooks"), ()),
)

# Weights of symbol kinds (any other: 40) and of relevance.
SYMBOL_WEIGHTS = {"endpoint": 85, "route": 80, "controller": 75, "store": 70, "api-method": 65, "service": 65, "repository": 65, "component": 60, "module": 55, "composable": 50, "hook": 50, "entity": 50}
PATH_HIT, KIND_HIT, CONTENT_UNIT, CONTENT_CAP, KEYWORD_UNIT = 35.0, 10.0, 12.0, 5, 4.0
SYMBOL_EXACT, SYMBOL_PARTIAL, SYMBOL_KIND_UNIT, SYMBOL_CAP = 30.0, 15.0, 0.25, 60.0
INTENT_BOOST, ROLE_BOOST, SIZE_UNIT, SIZE_CAP = 20.0, 25.0, 32 * 1024, 20.0
MMR_LAMBDA, SIM_DIR, SIM_KIND, SIM_TERMS, RECALL_FACTOR = 0.7, 0.5, 0.3, 0.2, 8

# Severities of lint rules; budget of overhead.
SEVERITIES = {"secret_pattern": "HIGH", "file_too_long": "MEDIUM", "missing_scope": "MEDIUM", "dynamic_info": "MEDIUM", "duplicate_paragraph": "LOW", "read_error": "LOW"}
#: What a finding says, and what to do about it.
MESSAGES = {
    "secret_pattern": "line looks like it holds a credential", "file_too_long": "document has more than 300 lines or 24 KiB", "missing_scope": "document doesn't say where it applies",
    "dynamic_info": "line holds a date, an id or a state that will change", "duplicate_paragraph": "paragraph stands in an earlier document too", "read_error": "document could not be read",
}
SUGGESTIONS = {
    "secret_pattern": "remove the value and say where to get it", "file_too_long": "split it by folder or language and link long background", "missing_scope": "name the folders, languages or modules at the top",
    "dynamic_info": "remove it or link to where it is kept up to date", "duplicate_paragraph": "keep it in one document and link to it", "read_error": "check path and rights, or take it off the list",
}
OVERHEAD_BUDGET = 0.05


def listed(values) -> str:
    """A list of strings for IN (...), readable by Spark SQL and other engines."""
    return ", ".join(f"'{v}'" for v in values)


_TEXT_KINDS = f"""WHEN b = 'readme' OR b LIKE 'readme.%' OR ext IN ({listed(DOC_EXT)}) THEN 'documentation'
 WHEN b IN ({listed(CONFIG_NAMES)}) OR b LIKE 'vite.config.%' OR b LIKE 'next.config.%' OR b LIKE 'application.%' OR b LIKE 'application-%' OR ext IN ({listed(CONFIG_EXT)}) THEN 'config'
 WHEN ext IN ({listed(SOURCE_EXT)}) THEN 'source' ELSE 'unknown' END"""
#: Class of a file by lp (lower-case path... of the root), b (lower-case base name), ext (lower-case extension), p (path).
KIND_CASE = f"""CASE WHEN b LIKE '%.lock' OR b IN ({listed(LOCKFILES)}) THEN 'lockfile'
 WHEN p = '.claude/settings.local.json' OR p = '.opencode/skills' OR p LIKE '.opencode/skills/%' OR p = '.ai-docs' OR p LIKE '.ai-docs/%' THEN 'ai_cache'
 WHEN ext IN ({listed(BINARY_EXT)}) THEN 'binary'
 WHEN b LIKE '%.min.js' OR b LIKE '%.min.css' OR ext IN ('.map', '.class') THEN 'build_artifact'
 WHEN (p = 'android' OR p LIKE 'android/%') AND (b IN ('androidmanifest.xml', 'build.gradle', 'settings.gradle') OR b LIKE '%.gradle.kts' OR ext IN ({listed(ANDROID_EXT)})) THEN 'config'
 {_TEXT_KINDS}"""
#: Kind of a file that an option or an ignore rule skips before its class is looked at.
TEXT_KIND_CASE = f"CASE {_TEXT_KINDS}"
#: Weight of a file of a kind; android is whether the android rule decided.
WEIGHT_CASE = f"""CASE kind WHEN 'lockfile' THEN 5 WHEN 'source' THEN 90 WHEN 'documentation' THEN 50 WHEN 'unknown' THEN 20
 WHEN 'config' THEN CASE WHEN (p = 'android' OR p LIKE 'android/%') AND (b IN ('androidmanifest.xml', 'build.gradle', 'settings.gradle') OR b LIKE '%.gradle.kts' OR ext IN ({listed(ANDROID_EXT)})) THEN 40 ELSE 80 END ELSE 0 END"""
SKIPPED_KINDS = ("lockfile", "ai_cache", "binary", "build_artifact")
ROLE_CASE = """CASE WHEN b LIKE '%.d.ts' THEN 'generated-noisy'
 WHEN b IN ('main.ts', 'main.tsx', 'main.js', 'main.jsx', 'index.tsx') OR b LIKE '%application.java' OR b LIKE '%application.kt' THEN 'app-entry'
 WHEN kind = 'documentation' THEN 'documentation' WHEN kind = 'config' THEN 'configuration' WHEN kind <> 'source' THEN ''
 WHEN lp LIKE '%/router%' OR lp LIKE '%/routes%' OR b IN ('router.ts', 'router.tsx', 'router.js') OR b LIKE '%-routing.module.ts' THEN 'route-definition'
 WHEN lp LIKE '%/stores/%' OR lp LIKE '%/store/%' OR b LIKE '%slice.ts' OR b LIKE '%slice.tsx' OR b LIKE '%.store.ts' THEN 'store'
 WHEN lp LIKE '%/services/%' OR lp LIKE '%/service/%' OR b LIKE '%.service.ts' OR b LIKE '%service.java' OR b LIKE '%service.kt' OR b LIKE '%api.ts' OR b LIKE '%api.tsx' THEN 'service'
 WHEN lp LIKE '%/controller%' OR b LIKE '%controller.java' OR b LIKE '%controller.kt' THEN 'controller'
 WHEN lp LIKE '%/repository%' OR lp LIKE '%/repositories%' OR lp LIKE '%/dao%' OR lp LIKE '%/mapper%' OR b LIKE '%repository.java' OR b LIKE '%mapper.java' OR b LIKE '%dao.java' THEN 'repository'
 WHEN lp LIKE '%/pages/%' OR lp LIKE '%/views/%' OR b LIKE '%page.vue' OR b LIKE '%page.tsx' OR b LIKE '%view.vue' THEN 'page-view'
 WHEN lp LIKE '%/components/%' OR b LIKE '%.component.ts' OR b LIKE '%.vue' OR b LIKE '%component.tsx' THEN 'component' ELSE '' END"""
PROFILE_CASE = """CASE WHEN angular THEN 'angular' WHEN jvm_build AND (spring OR java) THEN 'spring' WHEN (vite OR package) AND vue THEN 'vue' WHEN package AND jsx THEN 'react' END"""
