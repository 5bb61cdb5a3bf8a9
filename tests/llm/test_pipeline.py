"""The pipeline's stages, and run() against the brute-force versions of the operators."""

import public_tokenizers as public
import pyarrow.parquet as pq
import tokenizers
from test_simhash import slow_classes, slow_fingerprint
from test_text import slow_dedup, slow_marks, slow_told, slow_verdicts
from test_tokens import expect_pieces

import corpus_pipeline
from boxloom.llm import pii


def brute(rows):
    """doc_id -> text after the first four stages; rows is doc_id -> (text, source)."""
    verdicts = dict(zip(rows, slow_verdicts(list(rows.values()), 50), strict=True))
    kept = {d: text for d, (_, ok, text) in verdicts.items() if ok}
    cut_down = slow_dedup(kept)
    left = {d: t for d, t in cut_down.items() if t == kept[d] or t.strip()}
    fps = {}
    for d, t in left.items():
        fps.setdefault(slow_fingerprint(t), []).append(d)
    classes = slow_classes(fps)
    out = {}
    for d, t in left.items():
        if classes[d] == d:
            out[d] = t
    told = slow_told(out.values())
    for d, t in out.items():
        at, parts = 0, []
        for start, _, kind, end in slow_marks(t, told):
            if start >= at:
                tag = pii.TAGS[kind] if kind != "term" else "[NUMBER]" if t[start:end].isdecimal() else "[NAME]" if t[start].isupper() else "[TERM]"
                parts += [t[at:start], tag]
            at = max(at, end)
        out[d] = "".join(parts) + t[at:]
    return out


def test_run_equals_brute_force(spark, tiny):
    table = pq.read_table(f"{tiny}/documents.parquet").to_pylist()
    want = brute({r["doc_id"]: (r["text"], r["source"]) for r in table})
    rows = corpus_pipeline.run(spark, tiny).collect()
    assert {r["doc_id"] for r in rows} == set(want) and len(want) < 200
    expect_pieces(rows, want, tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json")))


def test_stages_keep_the_columns(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", "s", 0), (-2, "x " * 40000, None, None, 1)], docs.schema)
    docs = docs.limit(40).union(odd).union(odd)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.store.materialise(stage(spark, docs, tiny), "t")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert docs.count() > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), tiny).count() == 0


def test_schema_of_documents(tiny):
    assert pq.read_schema(f"{tiny}/documents.parquet").names == ["doc_id", "text", "lang", "source", "n_chars"]
