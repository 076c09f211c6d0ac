"""Secret scan: fixed patterns, plus dictionary-primed zstandard novelty.

Base spans are the leftmost non-overlapping matches of three patterns. The method adds strings
in a sensitive context, whether or not a pattern names them: a string close behind a sensitive
word, or one that continues such a string (lines of a key block, parts joined by dots), is
compressed together with the code around it under a dictionary. The bytes it adds are its
novelty; it is reported if it adds nearly as many as random strings of its own alphabet and
length would in its place. Words and identifiers are found in the dictionary or the context and
cost little; keys of any alphabet (hex, base64, mixed case) are incompressible.

The dictionary is what code and settings usually hold and the identifiers that the corpus itself
has near sensitive words, counted over all documents: those of ``LEAST_TEXTS`` texts or more, the
``MOST_IDENTIFIERS`` most frequent at most. It holds words of letters only, so no key gets in.

Defined results: a null or empty text has no spans (and the hash of the empty string);
offsets count code points, the end is exclusive; a novel span may lie in a base span; spans that
start together are ordered by kind; rows are answered one by one, so repeated ids and rows repeat
their results; an empty table gives none. Whole texts are read, whatever their length. Other
columns aren't looked at, whatever their names, and masking keeps them.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .shared import table, text_of, whole_row

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGN, MIN_ACCESS = 6, 20
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Words that make the strings after them sensitive; parts of one may be joined by a space, hyphen or underscore.
SENSITIVE = re.compile(r"password|passwd|secret|token|api[ _-]?key|credential|bearer|authorization|private[ _-]?key|access[ _-]?key|client[ _-]?id|signature|connection[ _-]?string", re.IGNORECASE | re.ASCII)
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_-][A-Za-z0-9+/_.-]{7,}={0,2}")
#: Shorter strings need a digit and a letter, else any unseen word would do.
LONG = 20
#: What may lie between a sensitive string and the one that continues it (the next line of a block, a list).
BETWEEN = re.compile(r"""[\s"'`,;:|\\()\[\]{}]{0,16}""")
PEM = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----\s*([A-Za-z0-9+/=\s]+?)\s*-----END")
NEAR, AROUND = 48, 200
#: What a string must add, as a share of what random strings of its alphabet and length add on average; how many of these are tried.
MIN_NOVELTY, CONTROLS = 0.85, 3
#: Identifiers near sensitive words: words of letters, joined by a mark or a capital; none so long that it could be a key.
IDENTIFIER = re.compile(r"(?<![A-Za-z0-9_-])(?:[A-Z]?[a-z]{2,14}|[A-Z]{2,14})(?:[_-](?:[A-Z]?[a-z]{1,14}|[A-Z]{1,14})|[A-Z][a-z]{1,14}){0,5}(?![A-Za-z0-9_-])")
LEAST_TEXTS, MOST_IDENTIFIERS = 3, 2000
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What code and settings usually hold; primes the compressor.
DICTIONARY = (
    "import export default function return const let var class public private static void string int boolean null true false "
    "this self def from async await try catch except finally throw raise new if else elif for while switch case break continue "
    "http https www localhost example com org net api v1 v2 users accounts services config settings properties environment "
    "password passwd secret token api_key apikey access_key client_id client_secret authorization bearer credential private_key "
    "public_key BEGIN END CERTIFICATE connectionString username hostname database server port timeout version description name value "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000 11111111 12345678 xxxxxxxx XXXXXXXX example-token "
    "your-api-key-here placeholder changeme content-type application/json utf-8 user-agent index.html package.json node_modules "
)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def alphabet(string: str) -> str:
    """The characters that strings of this kind are made of."""
    for few in (_DIGITS, _DIGITS + "abcdef", _DIGITS + "ABCDEF"):
        if set(string) <= set(few):
            return few
    marks = "".join(sorted({c for c in string if not c.isalnum()}))
    return "".join(x for x in (_DIGITS, _LOWER, _UPPER) if any(c in x for c in string)) + marks


class Novelty:
    """Marginal compressed size of a string, given the text around it and a dictionary, as a share of that of random strings."""

    def __init__(self, identifiers=(), dictionary: str = DICTIONARY):
        import zstandard

        words = (" ".join(identifiers) + " " + dictionary).encode()
        primed = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self._size = lambda b, c=zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False): len(c.compress(b))

    def __call__(self, before: str, string: str, after: str) -> float:
        around = (before.replace(string, "") + "\n" + after.replace(string, "") + "\n").encode("utf-8", "replace")  # a repeated key is no less a key
        alone, letters, draw = self._size(around), alphabet(string), random.Random(string)
        controls = ["".join(draw.choice(letters) for _ in string) for _ in range(CONTROLS)]
        most = sum(self._size(around + c.encode()) - alone for c in controls)
        return CONTROLS * (self._size(around + string.encode()) - alone) / max(most, 1)


def novel_spans(text: str, novelty: Novelty) -> list[tuple[int, int, str]]:
    words = [m.end() for m in SENSITIVE.finditer(text)]
    if not words:
        return []
    new = lambda s, e: novelty(text[max(0, s - AROUND) : s], text[s:e], text[e : e + AROUND]) >= MIN_NOVELTY
    blocks = [m.span(1) for m in PEM.finditer(text)]
    blocks = [b for b in blocks if new(*b)]
    ends = [e for _, e in blocks]
    out: list[tuple[int, int, str]] = [(s, e, "novel") for s, e in blocks]
    last = -1  # end of the sensitive string before
    for m in CANDIDATE.finditer(text):
        s, e = m.start(), m.start() + len(m[0].rstrip("."))
        k = bisect.bisect_right(words, s) - 1
        near = k >= 0 and words[k] > s - NEAR
        if not near and not (last >= 0 and BETWEEN.fullmatch(text, last, s)):
            continue
        last = e
        block = bisect.bisect_right(ends, s)
        if block < len(blocks) and blocks[block][0] < e:  # part of a key block
            continue
        # the whole string, or else its parts between dots
        for x, y in [(s, e), *((s + p.start(), s + p.end()) for p in re.finditer(r"[^.]+", text[s:e]))] if "." in text[s:e] else [(s, e)]:
            string = text[x:y]
            if len(string) < 8 or (len(string) < LONG and not (any(c.isdigit() for c in string) and any(c.isalpha() for c in string))):
                continue
            if new(x, y):
                out.append((x, y, "novel"))
                if (x, y) == (s, e):
                    break
    return sorted(out)


def identifiers(docs: DataFrame, text_col: str = "text") -> list[str]:
    """The corpus's own identifiers near sensitive words, the most frequent last: MOST_IDENTIFIERS at most."""

    def run(batches):
        for b in batches:
            seen: Counter = Counter()
            for text in b.column(0).to_pylist():
                found, done = set(), 0
                for m in SENSITIVE.finditer(text):
                    lo, hi = max(done, m.start() - AROUND), m.end() + AROUND
                    if hi > lo:
                        found.update(x.group() for x in IDENTIFIER.finditer(text, lo, hi))
                    done = max(done, hi)
                seen.update(found)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    some = docs.select(text_of(text_col).alias("t")).where(F.col("t").rlike("(?i)" + SENSITIVE.pattern))
    counts = some.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_TEXTS)
    return [r["word"] for r in reversed(counts.orderBy(F.col("n").desc(), "word").limit(MOST_IDENTIFIERS).collect())]


def spans_text(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]))))


def _masked(text: str, spans, mark: str) -> str:
    out, at = [], 0
    for s, e, _ in sorted(spans):
        if e > at:
            out += [text[at : max(at, s)], mark if s >= at else ""]
            at = e
    return "".join([*out, text[at:]])


def secret_scan(docs: DataFrame, text_col: str = "text", mask: str | None = None) -> DataFrame:
    """Per row: doc_id, counts, base_sha256, spans; with ``mask`` also masked_text, spans replaced by the mask."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string" + (", masked_text string" if mask is not None else "")

    names = identifiers(docs, text_col)

    def scan(batches):
        novelty = Novelty(names)
        for b in batches:
            cols = [[] for _ in range(5 + (mask is not None))]
            for text in b.column(1).to_pylist():
                base = base_spans(text)
                every = base + novel_spans(text, novelty)
                kinds = [k for _, _, k in base]
                row = [kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(spans_text(base).encode()).hexdigest(), spans_text(every)]
                for c, v in zip(cols, row + ([_masked(text, every, mask)] if mask is not None else []), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], *[pa.array(c, pa.string()) for c in cols[3:]]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "masked_text"][: 1 + len(cols)])

    return docs.select("doc_id", text_of(text_col).alias("t")).mapInArrow(scan, schema)


def masked_documents(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The documents, all columns kept, with every found span replaced; n_chars follows the text."""
    names = identifiers(docs)

    def masked(batches):
        novelty = Novelty(names)
        for b in batches:
            done = [t if t is None else _masked(t, base_spans(t) + novel_spans(t, novelty), mark) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(done, pa.string())], schema=pa.schema([b.schema.field(0), pa.field("masked", pa.string())]))

    rows = docs.select(whole_row(docs).alias("row"), F.col("text").cast("string").alias("t"))
    schema = StructType([rows.schema["row"], StructField("masked", StringType())])
    text = F.col("masked").cast(docs.schema["text"].dataType)
    row = F.col("row").withField("text", text)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("masked").cast(docs.schema["n_chars"].dataType))
    return rows.mapInArrow(masked, schema).select(row.alias("row")).select("row.*")


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))
