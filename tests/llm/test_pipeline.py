"""The pipeline's stages: whole inputs, defined columns, decisions that take effect."""

import corpus_pipeline
from conftest import clashing, texts_of
from pyspark.sql import functions as F
from test_operators import plain_classes, plain_lines

from riskgrain.llm import decontaminate


def test_run_against_plain_stages(spark, sf, documents):
    texts = texts_of(documents)
    kept = {r["doc_id"] for r in corpus_pipeline.known_language(spark, documents, sf).collect()}
    lettered = {d for d, t in texts.items() if any(c.isalpha() for c in t)}
    assert kept <= lettered and len(kept) >= 0.99 * len(lettered)
    lines = {d: "\n".join(rest) for d, (_, rest) in plain_lines({d: texts[d] for d in kept}).items()}
    firsts = {d for d, (c, _) in plain_classes(lines).items() if d == c}
    rows = [(d, lines[d]) for d in firsts]
    held = {r["doc_id"] for r in decontaminate.contaminated(
        spark.createDataFrame(rows, "doc_id long, text string"), spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(out) == firsts - held
    assert all(r["n_tokens"] == len(r["ids"]) for r in out.values())


def test_stages_keep_columns(spark, sf, messy, empty, documents):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, documents, sf).columns == documents.columns, name
        assert stage(spark, empty, sf).count() == 0, name
        odd = clashing(messy)
        out = stage(spark, odd, sf)
        assert out.columns == odd.columns and out.count() <= odd.count(), name


def test_last_stage(spark, sf, messy, empty):
    name, stage = corpus_pipeline.STAGES[-1]
    assert stage(spark, empty, sf).count() == 0
    assert stage(spark, clashing(messy), sf).count() == messy.count()


def test_copies_of_many_lines(spark, sf, documents):
    """Of many copies whose lines are all dropped but once, one full text and one empty one stay."""
    text = "\n".join(f"Line number {k} of a document that stands here many times over" for k in range(4))
    copies = spark.range(950_000, 950_030).selectExpr("id AS doc_id").withColumns({
        "text": F.lit(text), "lang": F.lit("en"), "source": F.lit("a"), "n_chars": F.lit(len(text)).cast(documents.schema["n_chars"].dataType)})
    lines = corpus_pipeline.without_repeated_lines(spark, copies.select(documents.columns), sf)
    assert sum(t == "" for t in texts_of(lines).values()) == 29
    assert texts_of(corpus_pipeline.without_near_copies(spark, lines, sf)) == {950_000: "", 950_029: text}
