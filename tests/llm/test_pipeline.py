"""Every stage of the pipeline on a small table with planted cases."""

import pytest

import corpus_pipeline
from vozlake.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    import random

    rnd = random.Random(1)
    clean = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(80))
    leak = " ".join(f"item{i}" for i in range(12))
    base = clean()
    found = [(i, clean()) for i in range(40)] + [(100 + i, clean() + " scumbag moron idiot") for i in range(20)]
    found += [(200, base), (201, base), (202, base + " more"), (202, base + " more"), (210, clean() + " " + leak), (220, "password=hunter2x ok")]
    found += [(None, None), (230, ""), (231, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, grade string, _text string"
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or ""), "extra", "clash") for k, t in found], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(100 <= k < 120)) for k, _ in found if k is not None and k < 120], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    gone = [set(range(100, 120)), {201, 202}, {210}, set()]
    now, keys = docs, {k for k, _ in found}
    for (name, stage), lost in zip(corpus_pipeline.STAGES[:-1], gone):
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
        keys -= lost
        now = spark.createDataFrame(now.collect(), schema)
        assert {r.doc_id for r in now.collect()} == keys, name
    redacted = {r.doc_id: r for r in now.collect()}
    assert redacted[220].text == "[SECRET] ok" and redacted[220].n_chars == 11
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()} == keys
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if n.split("_")[0] in ("op1", "op7", "op9")])
def test_queries_run(spark, name):
    out = QUERIES[name](spark, FOLDER)
    assert len(set(out.columns)) == len(out.columns) and out.count() > 0
