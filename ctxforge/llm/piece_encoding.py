"""SentencePiece encoding that keeps source offsets, and decoding.

A text is normalised by the longest rule of the model's compiled character map that starts at each
place; the bytes each normalised byte came from are recorded. Pieces are found in the normalised text
and every piece is projected back to the span of original bytes it stands for.

The compiled map is a double-array trie over UTF-8 bytes followed by the replacements. It is walked
only where a character that starts some rule occurs; all other text is its own normal form, so its
alignment is a shift. A map without rules costs nothing.

The library finds the pieces of the normal form (its own normalisation is switched off). They tile that form, so
their lengths follow from the ids alone: a vocabulary piece has its own length, a character spelled in bytes
is as long as its bytes. Only texts with unknown pieces, or with the mark that stands for a blank, ask the library for each piece's surface.

Defined results: a null or empty text has no ids and decodes to the empty text; blanks are kept or
collapsed as the model says; of a character that is spelled in bytes the last piece has the span, the
others an empty one before it; the blank that a model puts before a text has an empty span; rows are
answered one by one, so repeated ids and rows repeat their results; texts are read whole, whatever their
length; other columns aren't looked at, whatever their names; an empty table gives none. Bytes that are no
UTF-8 decode to U+FFFD each, as in the library.
"""

from __future__ import annotations

import codecs
import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table, text_of

BLANK = "▁"
#: Pieces in an Arrow batch of results.
BATCH_PIECES = 1_000_000
#: Kinds of pieces in a model file.
UNKNOWN, CONTROL, USER_DEFINED, BYTE = 2, 3, 4, 6

codecs.register_error("each_byte", lambda e: ("�", e.start + 1))


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


class CharacterMap:
    """Longest-prefix replacement by a compiled map: a trie's size, its units, replacements ended by a zero byte."""

    def __init__(self, compiled: bytes):
        size = int.from_bytes(compiled[:4], "little")
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist() if compiled else []
        self.replacements = compiled[4 + size :]
        self.starts: dict[str, bool] = {}

    def longest(self, raw: bytes, at: int) -> tuple[str | None, int]:
        """What the longest rule at a place makes and how many bytes it takes; None without a rule."""
        found, length = None, 0
        node = self._children(0, 0)
        for i in range(at, len(raw)):
            node ^= raw[i]
            unit = self.units[node] if node < len(self.units) else 0
            if unit & 0x800000FF != raw[i]:
                break
            node = self._children(node, unit)
            if unit >> 8 & 1:  # a rule ends here; its value lies at the children's base
                found, length = self.units[node] & 0x7FFFFFFF, i + 1 - at
        if found is None:
            return None, 0
        return self.replacements[found : self.replacements.index(0, found)].decode(), length

    def _children(self, node: int, unit: int) -> int:
        unit = unit or self.units[node]
        return node ^ (unit >> 10 << ((unit & 512) >> 6))

    def starts_rule(self, char: str) -> bool:
        """Whether any rule starts with this character."""
        if char not in self.starts:
            node, ok = self._children(0, 0), True
            for b in char.encode("utf-8", "replace"):
                node ^= b
                unit = self.units[node] if node < len(self.units) else 0
                ok = ok and unit & 0x800000FF == b
                if not ok:
                    break
                node = self._children(node, unit)
            self.starts[char] = ok
        return self.starts[char]

    def segments(self, text: str):
        """(normal form, source bytes): runs that stay as they are, and replaced ones."""
        hot = [c for c in set(text) if self.starts_rule(c)] if self.units else []
        at = done = 0  # characters
        if hot:
            raw = text.encode("utf-8", "replace")
            byte = 0
            for m in re.finditer("[" + re.escape("".join(hot)) + "]", text):
                if m.start() < at:
                    continue
                byte += len(text[at : m.start()].encode("utf-8", "replace"))
                made, taken = self.longest(raw, byte)
                at = m.start()
                if made is None:
                    continue
                if done < at:
                    yield text[done:at], None
                yield made, taken
                byte += taken
                at = done = at + len(raw[byte - taken : byte].decode())
        if done < len(text):
            yield text[done:], None


def char_starts(text: str) -> np.ndarray:
    """For each byte of a text the place of the first byte of its character."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    return np.maximum.accumulate(np.where(raw & 0xC0 != 0x80, np.arange(len(raw)), 0)) if len(raw) else np.zeros(0, np.int64)


class Model:
    """A model file: normalisation with alignment, pieces with spans, decoding."""

    def __init__(self, path: str | None = None, proto: bytes | None = None):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        if proto is None:
            with open(path, "rb") as f:
                proto = f.read()
        spec.ParseFromString(proto)
        norm = spec.normalizer_spec
        self.map, self.prefix, self.collapse = CharacterMap(norm.precompiled_charsmap), norm.add_dummy_prefix, norm.remove_extra_whitespaces
        if spec.trainer_spec.treat_whitespace_as_suffix or not norm.escape_whitespaces:
            raise ValueError("models with blanks behind words or unescaped blanks are not supported")
        pieces = [(p.piece, p.type) for p in spec.pieces]
        if any(t == USER_DEFINED for _, t in pieces):
            raise ValueError("models with user-defined pieces are not supported")
        surface = [b"" if t == CONTROL else spec.trainer_spec.unk_surface.encode() if t == UNKNOWN else bytes([int(p[1:-1], 16)]) if t == BYTE else p.replace(BLANK, " ").encode() for p, t in pieces]
        self.surfaces = np.frombuffer(b"".join(surface), np.uint8)
        self.sizes = np.array([len(x) for x in surface])
        self.places = np.cumsum(self.sizes) - self.sizes
        self.kinds = np.array([t for _, t in pieces])
        self.blank_first = np.array([p.startswith(BLANK) and t not in (UNKNOWN, CONTROL, BYTE) for p, t in pieces])
        self.blank = next((i for i, (p, _) in enumerate(pieces) if p == BLANK), -1)
        # normalisation is done here, so the library gets the model without it
        norm.Clear()
        norm.name, norm.add_dummy_prefix, norm.remove_extra_whitespaces, norm.escape_whitespaces = "identity", False, False, False
        self.library = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())

    def normalised(self, text: str) -> tuple[str, np.ndarray | None]:
        """The normal form with blanks as spaces, and the source byte of each of its bytes and of its end; None where that is a shift by the blank put before."""
        if not text:
            return "", np.zeros(1, np.int64)
        parts = list(self.map.segments(text))
        if len(parts) == 1 and parts[0][1] is None and not self.collapse:
            return (" " if self.prefix else "") + text, None
        out, source, at = [], [], 0
        for made, taken in parts:
            if taken is None:
                out.append(made)
                source.append(at + char_starts(made))
                at += len(source[-1])
            else:
                out.append(made)
                source.append(np.full(len(made.encode()), at))
                at += taken
        norm, align = "".join(out), np.concatenate([*source, [at]])
        if self.collapse:  # runs of blanks become one, those at the ends go
            raw = np.frombuffer(norm.encode("utf-8", "replace"), np.uint8)
            keep = np.flatnonzero((raw != 32) | (np.concatenate([[32], raw[:-1]]) != 32))
            once = raw[keep].tobytes().decode()
            norm = once.rstrip(" " + BLANK)
            if not norm:
                return "", np.zeros(1, np.int64)
            align = align[[*keep, len(raw)]][: len(norm.encode()) + 1]
        if self.prefix:
            norm, align = " " + norm, np.concatenate([align[:1], align])
        return norm, align

    def pieces(self, norm: str) -> tuple[np.ndarray, np.ndarray]:
        """ids of a normal form and the bytes of it that each stands for."""
        if not norm:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        ids = np.asarray(self.library.encode(norm.replace(" ", BLANK), return_type="numpy"), np.int32)
        kinds = self.kinds[ids]
        if BLANK in norm or (kinds == UNKNOWN).any():
            found = self.library.encode(norm.replace(" ", BLANK), return_type="proto").pieces
            ends = np.cumsum([len(p.surface) for p in found])  # characters
            at = np.flatnonzero(np.frombuffer(norm.encode("utf-8", "replace"), np.uint8) & 0xC0 != 0x80)
            at = np.append(at, len(norm.encode("utf-8", "replace")))
            return ids, np.diff(at[ends], prepend=0)
        spelled = kinds == BYTE
        inner = spelled & (self.surfaces[self.places[ids]] & 0xC0 == 0x80)  # a byte that goes on with a character
        lead = np.maximum.accumulate(np.where(inner, 0, np.arange(len(ids))))
        last = ~np.append(inner[1:], False)
        return ids, np.where(spelled, np.where(last, np.arange(len(ids)) - lead + 1, 0), self.sizes[ids])

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, and the first byte and the byte after the last of each piece in the text."""
        norm, align = self.normalised(text)
        ids, lengths = self.pieces(norm)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        if align is None:
            shift = int(self.prefix)
            return ids, np.maximum(starts - shift, 0), np.maximum(ends - shift, 0)
        return ids, align[starts], align[ends]

    def decode(self, ids: np.ndarray) -> str:
        ids = np.asarray(ids, np.int64)
        if (self.prefix or self.collapse) and len(ids):  # the blank put before the text
            drop = 0
            for i in ids[self.kinds[ids] != CONTROL]:
                drop += int(self.blank_first[i])
                if i != self.blank or not self.collapse:
                    break
        else:
            drop = 0
        sizes = self.sizes[ids]
        total = int(sizes.sum())
        at = np.repeat(self.places[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)
        return self.surfaces[at].tobytes()[drop:].decode("utf-8", "each_byte")


@functools.lru_cache(maxsize=1)
def loaded(path: str) -> Model:
    """One for all tasks of a worker process."""
    return Model(path)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts).astype(np.int32) if parts else [], pa.int32()))


def encode(docs: DataFrame, model: str | None = None, text_col: str = "text") -> DataFrame:
    """Per row: doc_id, ids, starts, ends (of each piece, in bytes of the text)."""
    path, kind = model or default_model(), docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        m = loaded(path)
        for b in batches:
            done, rows, pieces = 0, [], 0
            texts = b.column(1)
            for i in range(len(texts)):
                rows.append(m.encode(texts[i].as_py()))
                pieces += len(rows[-1][0])
                if pieces >= BATCH_PIECES or i == len(texts) - 1:
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(done, len(rows)), *[_lists(list(c)) for c in zip(*rows, strict=True)]], names=["doc_id", "ids", "starts", "ends"])
                    done, rows, pieces = i + 1, [], 0

    return docs.select("doc_id", text_of(text_col).alias("t")).mapInArrow(run, f"doc_id {kind}, ids array<int>, starts array<int>, ends array<int>")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """Per row: doc_id, ids, and the text that the ids stand for."""
    path, kind = model or default_model(), encoded.schema["doc_id"].dataType.simpleString()

    def run(batches):
        m = loaded(path)
        for b in batches:
            ids = b.column(1)
            texts = [m.decode(ids[i].values.to_numpy() if ids[i].is_valid else np.zeros(0, np.int64)) for i in range(len(ids))]
            yield pa.RecordBatch.from_arrays([b.column(0), ids, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, text string")


def op11_piece_encoding(spark, sf_dir: str) -> DataFrame:
    back = decode(encode(table(spark, sf_dir, "documents")))
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
