"""Ids, spans and decoding against the library: the given model, and its pieces under other character maps."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from ctxforge.llm import piece_encoding as pe

ALPHABET = "ab ▁é\n\t\x00中😀 the  .​́<0x41>Ａ①½ｱﾊﾟ각가ÅＷﬀ　İ"
TEXTS = [None, "", " ", "  two  blanks ", "▁▁ a ▁b", "é" * 30, "Hello wörld 😀", "\x00\x01", "x" * 1_500_000, "word " * 300_000, "ab\n" * 10, "ab\n" * 10, "<s></s><unk><0x41>"]


def strings(n, most=30):
    r = random.Random(n)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, most))) for _ in range(n)]


def checked(model, library, texts):
    for x in texts:
        ids, starts, ends = model.encode(x)
        want = library.encode(x, return_type="proto").pieces
        assert list(zip(ids.tolist(), starts.tolist(), ends.tolist(), strict=True)) == [(p.id, p.begin, p.end) for p in want], x
        assert model.decode(ids) == library.decode(library.encode(x)), x


def test_given_model():
    library = sentencepiece.SentencePieceProcessor(model_file=pe.default_model())
    model = pe.Model(pe.default_model())
    checked(model, library, strings(3000) + [t for t in TEXTS if t and len(t) < 1000])
    r = random.Random(2)
    for _ in range(3000):  # any ids, not only those of a text
        ids = [r.randint(0, 31999) if r.random() < 0.5 else r.choice([0, 1, 2, 13, 259, 300, 1678, r.randint(3, 258)]) for _ in range(r.randint(0, 9))]
        assert model.decode(np.array(ids, int)) == library.decode(ids)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("collapse", [True, False])
@pytest.mark.parametrize("prefix", [True, False])
def test_character_maps(rule, collapse, prefix):
    """Maps of hundreds of thousands of rules: normal form, alignment and spans."""
    other = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=prefix, remove_extra_whitespaces=collapse, escape_whitespaces=True)
    spec, norm = sentencepiece_model_pb2.ModelProto(), sentencepiece_model_pb2.ModelProto()
    with open(pe.default_model(), "rb") as f:
        spec.ParseFromString(f.read())
    norm.ParseFromString(other.serialized_model_proto())
    spec.normalizer_spec.CopyFrom(norm.normalizer_spec)
    model, library = pe.Model(proto=spec.SerializeToString()), sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
    checked(model, library, strings(600, 25))
    for x in strings(200, 25):
        form, offsets = other.normalize(x, with_offsets=True)
        mine, align = model.normalised(x)
        assert mine.replace(" ", "▁") == form
        if align is not None:
            chars = np.flatnonzero(np.frombuffer(mine.encode(), np.uint8) & 0xC0 != 0x80)
            assert [len(x.encode()[: align[c]].decode()) for c in chars] == offsets[: len(chars)]


def test_unknown_pieces():
    """A model that spells nothing in bytes: runs of unknown characters are one piece."""
    spec = sentencepiece_model_pb2.ModelProto()
    with open(pe.default_model(), "rb") as f:
        spec.ParseFromString(f.read())
    spec.trainer_spec.byte_fallback = False
    for p in spec.pieces:
        if p.type == pe.BYTE:
            p.type = 1
    model, library = pe.Model(proto=spec.SerializeToString()), sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
    checked(model, library, strings(500))


def test_encode_rows(spark):
    """Rows of a table: spans cover each text, ids decode to it, edge cases have their results."""
    library = sentencepiece.SentencePieceProcessor(model_file=pe.default_model())
    rows = [(i, t, None, [1], 2, 3, "x") for i, t in enumerate(TEXTS)] + [(2, "again", None, [1], 2, 3, "x")] * 2 + [(None, "no id", None, [1], 2, 3, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, t string, ids array<int>, starts int, ends int, `a.b` string")
    key = lambda x: (-1 if x[0] is None else x[0], x[1])
    got = pe.encode(d).collect()
    assert sorted(((r.doc_id, r.ids) for r in got), key=key) == sorted(((i, library.encode(t or "")) for i, t, *_ in rows), key=key)
    text = {i: t or "" for i, t, *_ in rows if i != 2}
    for r in got:
        if r.doc_id in text and text[r.doc_id]:
            raw = text[r.doc_id].encode()
            assert b"".join(raw[s:e] for s, e in zip(r.starts, r.ends, strict=True)) == raw
    back = {r.doc_id: r.text for r in pe.decode(pe.encode(d)).collect()}
    assert all(back[i] == t.replace("▁", " ") for i, t in text.items())
    assert pe.encode(d.limit(0)).count() == 0 and pe.decode(pe.encode(d.limit(0))).count() == 0
    named = pe.encode(d.selectExpr("concat('d', doc_id) AS doc_id", "text"))
    assert {r.doc_id for r in named.collect()} == {None if i is None else f"d{i}" for i, *_ in rows}
    assert pe.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")).where("text = ''").count() == 2


def test_op11(spark):
    """Every row of the query against the library, on whole texts."""
    sf = "/root/testdata/sf0.001"
    library = sentencepiece.SentencePieceProcessor(model_file=pe.default_model())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode(r.text or "")
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert sorted(map(tuple, pe.op11_piece_encoding(spark, sf).collect())) == sorted(want)
