"""The pipeline's stages against brute force, each on its own input."""

import collections

import cases
import corpus_pipeline as pipeline
from test_documents import brute_classes, grams, split

from keyloom.llm import line_crf

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents(spark, rows):
    return cases.documents(spark, rows).select(*COLUMNS)


def test_stages_and_contract():
    assert [n for n, _ in pipeline.STAGES] == [
        "quality classifier",
        "n-gram Jaccard join",
        "substring dedup",
        "mixing sources to target weights",
        "best-fit packing",
    ]


def test_quality_stage_keeps_what_scores_well(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = pipeline.keep_good(spark, docs, sf_dir)
    field = line_crf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    want = {r.doc_id for r in line_crf.score(docs, field).collect() if r.score >= 0.7}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want


def test_jaccard_stage_keeps_one_of_each_class(spark, sf_dir):
    docs = [(i, t) for i, t in cases.texts() if i is not None]
    kept = cases.got(pipeline.one_of_each_class(spark, documents(spark, docs), sf_dir))
    _, root = brute_classes(docs)
    assert collections.Counter(r["doc_id"] for r in kept) == collections.Counter(
        min(docs[i][0] for i in range(len(docs)) if root[i] == r) for r in set(root)
    )
    assert all(dict(docs)[r["doc_id"]] == r["text"] for r in kept)
    assert all(grams(a["text"]) != grams(b["text"]) for a in kept for b in kept if a is not b)


def test_substring_stage_keeps_all_rows(spark, sf_dir):
    kept = cases.got(pipeline.without_repeats(spark, documents(spark, cases.texts()), sf_dir))
    assert len(kept) == len(cases.texts())
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in kept)


def test_mix_stage_emits_copies(spark, sf_dir):
    docs = documents(spark, cases.texts())
    kept = cases.got(pipeline.mixed(spark, docs, sf_dir))
    size = sum(len(split(t)) for _, t in cases.texts())
    taken = sum(len(split(r["text"])) for r in kept)
    assert abs(taken - 1.5 * size) <= 4 and list(kept[0]) == COLUMNS
    whole = {t for _, t in cases.texts()}
    assert all(r["text"] in whole or any(t.startswith(r["text"]) for t in whole if t) for r in kept)


def test_jaccard_stage_keeps_one_row_of_repeated_ids(spark, sf_dir):
    a, b = cases.words(60, 80), cases.words(60, 81)
    near = a.copy()
    near[30] = "other"
    docs = [(5, " ".join(a)), (5, " ".join(a)), (5, " ".join(near)), (5, " ".join(b)), (2, " ".join(b)), (6, "six")] + [(9, "hot")] * 50
    kept = cases.got(pipeline.one_of_each_class(spark, documents(spark, docs), sf_dir))
    assert sorted(r["doc_id"] for r in kept) == [2, 5, 6, 9]
    assert next(r["text"] for r in kept if r["doc_id"] == 5) in (docs[0][1], docs[2][1])


def test_run(spark, sf_dir):
    rows = pipeline.run(spark, sf_dir).collect()
    held = collections.defaultdict(int)
    for r in rows:
        held[r.sequence_id] += r.length
    assert rows and max(held.values()) <= 2048
    assert len(held) <= 1.02 * sum(held.values()) / 2048 + 1


def test_empty(spark, sf_dir):
    docs = documents(spark, []).limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_a_worker_keeps_no_memory_that_a_batch_has_freed():
    import re
    from pathlib import Path

    import pyarrow as pa

    from keyloom.llm.stage import lean

    held = lambda: int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) // 1024
    kept = []

    def run(batches):
        for batch in batches:
            small = [bytes(1000) for _ in range(150_000)]
            kept.append(bytes(1000))  # above all others: nothing below it goes back by itself
            del small
            yield batch

    before = held()
    assert sum(b.num_rows for b in lean(run)(iter([pa.record_batch({"x": [1, 2]})] * 2))) == 4
    assert held() - before < 50, "MB"
