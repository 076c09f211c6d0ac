"""Packing tokens into sequences of fixed capacity by harmonic classes.

A document's ids, closed by id 0, are cut into full sequences and a rest. A piece of length
L belongs to class ``j = capacity // L``: its length lies in (capacity/(j+1), capacity/j]
and j pieces fill a bin. A rest that would leave more than ``slack`` of its bin empty is cut
at the top of the next class that leaves ``least`` ids or more, so its second part shrinks
quickly and none is tiny. Workers fill the bins of each class independently, j pieces to a bin; what a
worker leaves over (fewer than j pieces a class) is filled across workers by prefix sums, and
what then remains (fewer than j pieces a class in the whole corpus, so a bounded number) goes
to the fullest sequence with room.

Defined results: a null or empty text is its closing id alone; every id lies in exactly one
piece; rows that repeat an id are packed each; pieces of equal length are placed in the order in
which a worker meets them; very long texts are cut into full sequences; an empty table gives no
rows; columns other than doc_id and text are not looked at, whatever their names. Ids are those of
the tokenizer file, without added special tokens. A byte-level BPE file is run by a faster library
if ``same_by_ranks`` proves that its merges follow from its ids; any other file, and texts that
hold special tokens, by the file's own library.
"""

from __future__ import annotations

import bisect
import functools
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import if_small, materialize, table, text_of

CAPACITY, SLACK, LEAST, CLOSING_ID = 1024, 16, 32, 0
#: Fixed value: how byte-level BPE of this kind splits texts before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: the settings of the splitter that SPLIT states.
SPLITTER = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def same_by_ranks(spec: dict) -> bool:
    """Whether merging by the lowest id of a joined pair gives what the file's own list of merges gives.

    Three things prove it: ids of merged tokens rise with their place in the list; every token is a
    byte or the result of a merge; and each token's own characters merge to it alone. Were two
    neighbours joined to a token whose listed merge is another pair, no merge across the token's ends
    would have come before, so the token's characters alone would have come to the same two
    neighbours and stuck there, against the third. The splitter is compared by its settings.
    """
    from tokenizers import Tokenizer

    model, pre = spec["model"], {"use_regex": True, **(spec.get("pre_tokenizer") or {})}
    pre.pop("trim_offsets", None)
    plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "fuse_unk"))
    if model.get("type", "BPE") != "BPE" or pre != SPLITTER or spec.get("normalizer") or not plain:
        return False
    special = {t["content"] for t in spec.get("added_tokens") or ()}
    vocab = {w: i for w, i in model["vocab"].items() if w not in special}
    made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    ids = [vocab.get(w, -1) for w in made]
    if len(set(made)) < len(made) or any(a >= b for a, b in zip(ids, ids[1:], strict=False)) or (ids and ids[0] < 0):
        return False
    if set(vocab) - set(made) != set(byte_characters()):
        return False
    bare = Tokenizer.from_str(json.dumps({**spec, "pre_tokenizer": None, "post_processor": None, "decoder": None, "added_tokens": [], "model": {**model, "ignore_merges": False}}))
    return all(e.ids == [vocab[w]] for w, e in zip(made, bare.encode_batch(made, add_special_tokens=False), strict=True))


def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in byte-level files: printable ones for themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.lru_cache(maxsize=4)
def proven(path: str) -> bool:
    with open(path, encoding="utf-8") as f:
        return same_by_ranks(json.load(f))


class Encoder:
    """ids of texts by a tokenizers file; its own library is loaded when it is needed."""

    def __init__(self, path: str, fast: bool | None = None):
        self.path, self.fast = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = tuple(t["content"] for t in spec.get("added_tokens") or ())
        if proven(path) if fast is None else fast:
            import tiktoken

            byte = byte_characters()
            ranks = {bytes(byte[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in self.special}
            self.fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    @functools.cached_property
    def slow(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


@functools.lru_cache(maxsize=1)
def encoder(path: str, fast: bool) -> Encoder:
    """One for all tasks of a worker process."""
    return Encoder(path, fast)


def cuts(n: int, capacity: int = CAPACITY, slack: int = SLACK, least: int = LEAST) -> list[int]:
    """Lengths of the pieces of n ids."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        j, piece = capacity // rest, rest
        if capacity - j * rest > slack:  # the top of the next class that leaves a part long enough
            piece = next((top for top in (capacity // k for k in range(j + 1, capacity // least + 1)) if rest - top >= least), rest)
        out.append(piece)
        rest -= piece
    return out


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, slack: int = SLACK, least: int = LEAST, text_col: str = "text") -> DataFrame:
    """A row per piece, with its class, the worker that met it, its number k among the worker's pieces of the class and its place (inside) in the worker's bin."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "cls", "worker", "k", "inside"]
    fast = proven(tokenizer)

    def run(batches):
        from pyspark import TaskContext

        worker, encode, met, filled = TaskContext.get().partitionId(), encoder(tokenizer, fast), {}, {}
        for b in batches:
            at, rows = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = np.array([*encode(text), CLOSING_ID], dtype="<u4")
                start = 0
                for length in cuts(len(ids), capacity, slack, least):
                    cls = capacity // length
                    k = met[cls] = met.get(cls, -1) + 1
                    inside = filled[cls] = filled[cls] if k % cls else 0
                    filled[cls] += length
                    at.append(i)
                    rows.append((start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids), cls, worker, k, inside))
                    start += length
            cols = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), *[pa.array(c, pa.int64()) for c in cols]], names=names)

    schema = f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names[1:])
    return docs.select("doc_id", text_of(text_col).alias("t")).mapInArrow(run, schema)


def _last_fit(capacity: int):
    def fit(pdf):
        """The corpus's last pieces: fewer than j of each class j, whatever its size. Longest first, each into the fullest bin with room."""
        pdf = pdf.sort_values(["length", "worker", "k"], ascending=[False, True, True], kind="stable")
        rooms: list[tuple[int, int]] = []
        seq, inside, bins = [], [], 0
        for n in pdf["length"]:
            i = bisect.bisect_left(rooms, (n, -1))
            room, bin_ = rooms.pop(i) if i < len(rooms) else (capacity, bins)
            bins = max(bins, bin_ + 1)
            seq.append(bin_)
            inside.append(capacity - room)
            bisect.insort(rooms, (room - n, bin_))
        return pdf.assign(sequence_id=seq, offset=inside)[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return fit


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, slack: int = SLACK, least: int = LEAST, text_col: str = "text") -> DataFrame:
    """A row per piece with its sequence and offset. Only what workers leave over is shuffled: fewer than j pieces of each class j and worker."""
    pieces = materialize(token_pieces(docs, tokenizer or default_tokenizer(), capacity, slack, least, text_col))
    counts = pieces.groupBy("worker", "cls").agg(F.count("*").alias("n"))
    counts = counts.withColumn("full", F.floor(F.col("n") / F.col("cls")) * F.col("cls")).withColumn("left", F.col("n") - F.col("full"))
    w = Window.partitionBy("cls")  # a row per worker
    counts = counts.withColumn("before", F.coalesce(F.sum("left").over(w.orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("all", F.sum("left").over(w))
    counts = if_small(materialize(counts.select("worker", "cls", "full", "before", "all")))
    placed = pieces.join(counts, ["worker", "cls"])
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    number = lambda at, worker: (worker * (1 << 36) + F.col("cls") * (1 << 25) + F.floor(at / F.col("cls"))).cast("long").alias("sequence_id")
    own = placed.where("k < full").select(*out, number(F.col("k"), F.col("worker") + 1), F.col("inside").alias("offset"))
    rest = placed.where("k >= full").withColumn("at", F.col("before") + F.col("k") - F.col("full"))
    merged = F.col("at") < F.floor(F.col("all") / F.col("cls")) * F.col("cls")
    binned = rest.where(merged).select(*out, number(F.col("at"), F.lit(0)), "at")
    inside = Window.partitionBy("sequence_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    binned = binned.select(*out, "sequence_id", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long").alias("offset"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    tail = rest.where(~merged).select(*out, "worker", "k").withColumn("one", F.lit(0)).groupBy("one").applyInPandas(_last_fit(capacity), schema)
    return own.unionByName(binned).unionByName(tail)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
