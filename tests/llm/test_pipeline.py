import os

import pyarrow as pa

import corpus_pipeline
from tests.llm.helpers import prose
from tests.llm.test_near_dedup import brute_classes
from tests.llm.test_text_operators import words


def test_stages_against_plain_python(spark, tmp_path):
    bad = ["vile", "rotten", "foul"]
    item = prose(900, 30)
    rows = [(k, prose(k, 60) + (f" {bad[k % 3]} {bad[(k + 1) % 3]}" if k % 4 == 0 else "")) for k in range(120)]
    rows += [(200, prose(1, 60)), (201, prose(2, 60) + " more"), (202, "see " + item), (203, None), (204, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(120)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = [(i, t) for i, t in rows if not (i < 120 and i % 4 == 0)]
    last = {t or "": i for i, t in sorted(kept)}
    kept = [(i, t) for i, t in kept if last[t or ""] == i]
    kept = [(i, t) for (i, t), (_, c, _) in zip(kept, brute_classes(kept), strict=True) if i == c]
    grams = {tuple(words(item)[k : k + 10]) for k in range(21)}
    kept = [(i, t) for i, t in kept if not any(tuple(words(t)[k : k + 10]) in grams for k in range(len(words(t))))]

    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path))
        assert step.columns == docs.columns, name
    assert sorted(r.doc_id for r in step.collect()) == sorted(i for i, _ in kept)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({r.doc_id for r in got}) == sorted(i for i, _ in kept)


def test_workers_get_texts_in_bounded_batches_and_give_memory_back(spark, tmp_path):
    """What a stage's Python workers keep lies beside the heap of the stages after it."""
    rows = spark.range(0, 5_000, 1, 1)

    def seen(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([os.environ.get("MALLOC_MMAP_THRESHOLD_", "")])], names=["n", "set"])

    stage = corpus_pipeline.bounded(lambda spark, docs, sf_dir: docs.mapInArrow(seen, "n long, set string"))
    got = stage(spark, rows, str(tmp_path)).collect()
    assert sum(r.n for r in got) == 5_000 and max(r.n for r in got) <= corpus_pipeline.BATCH_ROWS
    assert {r.set for r in got} == {corpus_pipeline.WORKER_ENVIRONMENT["MALLOC_MMAP_THRESHOLD_"]}
    assert all(hasattr(stage, "__wrapped__") for _, stage in corpus_pipeline.STAGES)
