"""The stages on small rows, each fed with its predecessor's output."""

import corpus_pipeline
from tests.llm.test_operators import SCHEMA, rows


def test_stages(spark, tmp_path):
    docs = spark.createDataFrame(rows(), SCHEMA)
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name in ("quality rules", "near dedup"):
            assert 0 < docs.count() < n
            n = docs.count()
        if name == "secret scan":
            assert docs.count() == n
    assert docs.count() > 0


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns(spark, tmp_path):
    """Helper columns of any stage meet none of the input's, which may be maps or structs."""
    names = "_keep _many _words _row _skey _twin k row doc h size offset position part bucket before inner skey node comp rep head t e source_size target goal task digest"
    extra = ", ".join(f"{n} int" for n in names.split())
    schema = "doc_id long, text string, lang string, source string, n_chars long, tags map<string,int>, deep struct<text:string,doc_id:int>, `a.b` int, `x``y` string, " + extra
    base = [(r[0], r[1], r[2], r[3], r[4]) for r in rows()]
    data = [(*r, {"a": 1}, ("x", 2), 5, "z", *range(len(names.split()))) for r in base]
    docs = spark.createDataFrame(data, schema)
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns and out.schema["tags"].dataType == docs.schema["tags"].dataType
        out.write.parquet(f"{tmp_path}/c{i}")
        docs = spark.read.parquet(f"{tmp_path}/c{i}")
        if name != "packing":
            assert docs.where(f"tags['a'] <> 1 OR deep.doc_id <> 2 OR `a.b` <> 5 OR `x``y` <> 'z' OR _many <> 1 OR digest <> {len(names.split()) - 1}").count() == 0
    assert docs.count() > 0


def test_rows_by_brute_force(spark, tmp_path):
    """run() against the same decisions taken one by one: rules by their SQL, groups by all pairs, masks by spans, words by the mix's own targets."""
    import re

    from ctxforge.llm import mixing, packing, quality_rules, secrets
    from tests.llm.test_operators import shingle_set, words

    docs = spark.createDataFrame([r for r in rows() if r[0] not in (None, 10)], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    good = {r.doc_id for r in quality_rules.quality_rules(docs).where("kept").collect()}
    text = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    source = {r.doc_id: r.source for r in docs.collect()}
    sets = {d: shingle_set(t) for d, t in text.items()}
    group = {d: d for d in text}
    for d in sorted(text):
        for o in sorted(text):
            if o < d and 100 * len(sets[d] & sets[o]) >= 75 * len(sets[d] | sets[o]):
                a, b = group[d], group[o]
                group = {k: min(a, b) if g in (a, b) else g for k, g in group.items()}
    kept = {d: text[d] for d in text if group[d] == d}
    names = secrets.identifiers(spark.createDataFrame([(d, t) for d, t in kept.items()], "doc_id long, text string"))
    masked = {d: secrets._masked(t, secrets.base_spans(t) + secrets.novel_spans(t, secrets.Novelty(names)), "[secret]") for d, t in kept.items()}
    mixed = mixing.mix(spark.createDataFrame([(d, t, source[d]) for d, t in masked.items()], "doc_id long, text string, source string")).collect()
    taken = {}
    for r in mixed:
        taken[r.source] = taken.get(r.source, 0) + r.taken
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= set(masked)
    # pieces are whole masked texts, once or twice, but for one document that a source's target cuts in each epoch
    encode = packing.Encoder(packing.default_tokenizer())
    tokens, mixed_words, cut = {}, {}, {}
    for r in out:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
    for d, n in tokens.items():
        whole = len(encode(masked[d])) + 1
        if n in (whole, 2 * whole):
            mixed_words[source[d]] = mixed_words.get(source[d], 0) + n // whole * len(words(masked[d]))
        else:
            cut.setdefault(source[d], []).append(len(words(masked[d])))
    for s, n in taken.items():
        assert len(cut.get(s, [])) <= 2 and mixed_words.get(s, 0) <= n <= mixed_words.get(s, 0) + 2 * sum(cut.get(s, []))
    assert not any(re.search("hunter2", t) for t in masked.values())
