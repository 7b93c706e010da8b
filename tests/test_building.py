"""The text and vector indexes, streams of ordered frames, near duplicates, models in batches, partitions, summaries and geometry."""

import difflib
import io
import os
import random
import re
import unicodedata
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from keyloom.functions import encoders, geometry, recognisers, strings
from keyloom.operators import contracts, intervals, postings, ranking, staleness, summaries, text, variants, vector_index, vectors
from keyloom.plans import building, requests, retrieval, search, submission
from keyloom.sources import partitions, shared, store
from keyloom.streaming import ordered


def words(n, seed):
    r = random.Random(seed)
    return " ".join(f"w{int(r.paretovariate(0.6)) % 4000}" for _ in range(n))


def bm25(queries, docs, k):
    """Straight from the formula."""
    toks = {i: re.findall(r"\w+", (t or "").lower()) for i, t in docs}
    n, average = len(toks), sum(map(len, toks.values())) / len(toks)
    out = {}
    for q, t in queries:
        terms, found = re.findall(r"\w+", t.lower()), []
        for i, d in toks.items():
            score = 0.0
            for term in terms:
                df = sum(term in x for x in toks.values())
                tf = d.count(term)
                score += np.log(1 + (n - df + 0.5) / (df + 0.5)) * postings.saturation(tf, len(d), average) if tf else 0
            if np.floor(score * 1e6 + 0.5) > 0:
                found.append((-np.floor(score * 1e6 + 0.5) / 1e6, i))
        out[q] = [(i, round(-s, 6)) for s, i in sorted(found)[:k]]
    return {q: x for q, x in out.items() if x}


@pytest.fixture
def corpus(spark):
    rows = [(i, words(20 + i % 50, i)) for i in range(300)] + [(1000, None), (1001, ""), (1002, words(30, 5)), (1003, words(30, 5))]
    asked = [(1, words(6, 77)), (2, "w1 w2 w3"), (3, "nowhere"), (4, words(30, 5))]
    return rows, asked, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, text string")


@pytest.mark.parametrize("block,seeds,pushed", [(1024, 8, 1000), (16, 1, 1), (7, 2, 1000)])
def test_index_gives_the_rows_of_the_formula(spark, monkeypatch, corpus, block, seeds, pushed):
    monkeypatch.setattr(postings, "BLOCK", block)
    monkeypatch.setattr(postings, "SEEDS", seeds)
    monkeypatch.setattr(postings, "PUSHED", pushed)
    rows, asked, docs, queries = corpus
    path = shared.fresh(spark, "test-index")
    text.index(docs, path)
    got = text.search(queries, path, 5).collect()
    lists = {q: [(r.doc_id, round(r.raw_score, 6)) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in {r.query_id for r in got}}
    assert lists == bm25(asked, rows, 5)


def test_a_batch_indexes_its_own_terms_only(spark, tmp_path, corpus):
    rows, asked, docs, queries = corpus
    docs.repartition(3).write.parquet(str(tmp_path / "docs"))
    docs, whole = spark.read.parquet(str(tmp_path / "docs")), shared.fresh(spark, "test-index")
    path = retrieval.batch_index(docs, "test-batch", queries)
    kept = spark.read.parquet(f"{path}/postings")
    terms = {r.term for r in kept.filter("bucket >= 0").select("term").distinct().collect()}
    assert terms == {w for _, t in asked for w in t.split()} & {w for _, t in rows for w in (t or "").split()}
    assert len(kept.inputFiles()) <= 8  # no file for each bucket of each task
    text.index(docs, whole)
    assert spark.read.parquet(f"{path}/corpus").drop("blocks").collect() == spark.read.parquet(f"{whole}/corpus").drop("blocks").collect()
    found = [sorted(map(tuple, text.search(queries, p, 5).collect())) for p in (path, whole)]
    assert found[0] == found[1] and len(found[0]) > 10
    assert retrieval.batch_index(docs, "test-batch", queries) == path
    other = retrieval.batch_index(docs, "test-batch", queries.filter("query_id = 2"))
    assert {r.term for r in spark.read.parquet(f"{other}/postings").filter("bucket >= 0").collect()} == {"w1", "w2", "w3"}
    assert retrieval.batch_index(docs, "test-batch", queries.limit(0)) not in (path, other)


def test_texts_are_split_as_they_are_analysed(spark, monkeypatch):
    monkeypatch.setattr(postings, "SLICE", 3000)
    r = random.Random(3)
    codes = [*range(1, 0x250), *range(0x300, 0x530), *range(0x1E00, 0x2100), *range(0x4E00, 0x4E10), *range(0xAC00, 0xAC10), *range(0x1F300, 0x1F308)]
    rows = [(i, "".join(chr(r.choice(codes if i % 2 else codes[:200])) for _ in range(r.randrange(60)))) for i in range(3000)]
    rows += [(-1, None), (-2, ""), (-3, "ΑΣ ΣΑΣ. Σ'Σ"), (-4, "Straße, ŒUVRE I\u0307 İ"), (-5, "\U00010400Ǿø e\u0301")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ready = text.prepared(docs).toArrow().combine_chunks().to_batches()
    assert len({b.column(2)[i].is_valid for b in ready for i in range(b.num_rows)}) == 2
    split = pa.Table.from_batches(postings._analysed(iter(ready), text.splitter(text.letters(spark))))
    got = dict(zip(split["doc_id"].to_pylist(), split["tokens"].to_pylist(), strict=True))
    assert got == {x.doc_id: x.t or [] for x in docs.select("doc_id", text.analyse(F.col("text")).alias("t")).collect()}


def test_index_search_reads_partitions_of_its_terms_only(spark, corpus):
    path = shared.fresh(spark, "test-index")
    text.index(corpus[2], path)
    buckets = {d for d in os.listdir(f"{path}/postings") if d.startswith("bucket=")}
    assert len(buckets) > 20
    plan = spark.read.parquet(f"{path}/postings").filter(F.col("bucket").isin(3) & F.col("term").isin("w1"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(term,w1)]" in plan
    assert not os.path.exists(f"{path}/raw")
    largest = spark.read.parquet(f"{path}/postings").agg(F.max(F.size("docs"))).first()[0]
    assert largest <= postings.BLOCK


def test_index_keeps_counts_that_no_shorter_document_reaches(spark, corpus):
    path = shared.fresh(spark, "test-index")
    text.index(corpus[2], path)
    toks = {i: re.findall(r"\w+", (t or "").lower()) for i, t in corpus[0]}
    rows = spark.read.parquet(f"{path}/postings").filter("bucket >= 0").collect()
    blocks = {r.block: r for r in spark.read.parquet(f"{path}/postings").filter("bucket < 0").collect()}
    assert sum(r.df for r in rows if r.term == "w1") == sum("w1" in t for t in toks.values()) and not os.path.exists(f"{path}/terms")
    for r in rows:
        own = [(c, len(toks[blocks[r.block].ids[d]])) for d, c in zip(r.docs, r.counts, strict=True)]
        for average in (1.0, 40.0, 900.0):
            most = max(postings.saturation(c, n, average) for c, n in own)
            assert most == max(postings.saturation(c, n, average) for c, n in zip(r.tops, r.sizes, strict=True))


def test_terms_of_a_batch_are_no_rows_of_the_driver(spark, monkeypatch, corpus):
    rows, asked, docs, queries = corpus
    path = shared.fresh(spark, "test-index")
    text.index(docs, path)
    monkeypatch.setattr(postings, "PUSHED", 1)
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **k: pytest.fail("terms go through the driver as rows"))
    collect, seen = type(queries).collect, []
    monkeypatch.setattr(type(queries), "collect", lambda df: (seen.append(collect(df)), seen[-1])[1])
    found = text.search(queries, path, 5)
    monkeypatch.undo()
    assert max(map(len, seen)) <= 2
    assert {r.query_id for r in found.collect()} == set(bm25(asked, rows, 5))


def test_hits_of_all_branches_are_searched_once(spark, sf_dir):
    hits = search.branch_hits(spark, sf_dir)
    assert hits.inputFiles() and all("/hits-" in f for f in hits.inputFiles())


def test_summary_splits_no_more_than_it_keeps_and_not_once_a_word(spark):
    rows = [(" " + " ".join(f"w{i}{'.' * (i == e)}" for i in range(n)) + "\n",) for n in (0, 1, 100, 101, 179, 180, 181, 182, 183, 400) for e in (-1, 99, 100, 150, 179, 180, 181)]

    def plain(t):
        w = t.split()
        ends = [i for i in range(101, 181) if i <= len(w) and w[i - 1].endswith(".")]
        return " ".join(w if len(w) <= 180 else w[: max(ends, default=180)])

    df = spark.createDataFrame(rows, "t string")
    got = df.select("t", strings.extract_summary(F.col("t")).alias("s"))
    assert all(r.s == plain(r.t) for r in got.collect())
    plan = got._jdf.queryExecution().toString()
    assert ", 183)" in plan and ", -1)" not in plan


def test_many_query_terms_are_searched_in_parts(spark, monkeypatch, corpus):
    monkeypatch.setattr(postings, "MAX_TERMS", 8)
    rows, asked, docs, _ = corpus
    few = [(i, words(4, i)) for i in range(12)]
    got = text.bm25_top_k(spark.createDataFrame(few, "query_id long, text string"), docs, 3).collect()
    lists = {q: [(r.doc_id, round(r.raw_score, 6)) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in {r.query_id for r in got}}
    assert lists == bm25(few, rows, 3)


def test_derived_tables_follow_their_files(spark, tmp_path):
    data, made = str(tmp_path / "in"), []
    spark.range(3).write.parquet(data)
    build = lambda path: (made.append(path), spark.range(1).write.parquet(path))
    first = shared.derived(spark.read.parquet(data), "test", build)
    assert shared.derived(spark.read.parquet(data), "test", build) == first and made == [first]
    spark.range(2).write.mode("append").parquet(data)
    assert shared.derived(spark.read.parquet(data), "test", build) != first and len(made) == 2


def test_vector_index_covers_all_rows_and_finds_nine_of_ten(spark, sf_dir):
    path = retrieval.vector_index(spark, sf_dir)
    items = spark.read.parquet(f"{path}/items")
    assert items.count() == spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    exact = {(r.query_id, r.frame_id): r.raw_score for r in retrieval.dense_topk(spark, sf_dir).collect()}
    near = {(r.query_id, r.frame_id): r.raw_score for r in retrieval.dense_index_topk(spark, sf_dir).collect()}
    assert len(exact.keys() & near.keys()) >= 0.9 * len(exact)
    assert all(near[k] == exact[k] for k in exact.keys() & near.keys())
    assert vector_index.probes(spark, path) <= spark.read.parquet(f"{path}/pivots").count()


def test_vector_index_with_equal_null_and_few_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(50)] + [(100, [0.0, 1.0]), (101, None), (102, [float("nan"), 1.0])]
    path = shared.fresh(spark, "test-vectors")
    vector_index.build(spark.createDataFrame(rows, "item_id long, vector array<float>"), path)
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<float>")
    assert [r.item_id for r in vector_index.top_k(q, path, 3).orderBy("rank").collect()] == [0, 1, 2]
    empty = shared.fresh(spark, "test-vectors")
    vector_index.build(spark.createDataFrame([], "item_id long, vector array<float>"), empty)
    assert vector_index.top_k(q, empty, 3).count() == 0


def test_dense_search_of_large_batches_and_ties(spark, monkeypatch):
    r = np.random.default_rng(1)
    items = [(i, [float(x) for x in r.integers(-2, 3, 4)]) for i in range(400)]
    asked = [(i, [float(x) for x in r.integers(-2, 3, 4)]) for i in range(50)]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, vector array<double>")
    want = {(q, n + 1): i for q, v in asked for n, (_, i) in enumerate(sorted((-float(np.dot(v, w)), i) for i, w in items)[:7])}
    for block, tile in ((2048, 4_000_000), (16, 300)):
        monkeypatch.setattr(vectors, "QUERY_BLOCK", block)
        monkeypatch.setattr(vectors, "TILE", tile)
        got = vectors.top_k(frame(asked, "query_id"), frame(items, "item_id"), 7)
        assert {(x.query_id, x["rank"]): x.item_id for x in got.collect()} == want


def test_equal_vectors_take_bounded_memory():
    import tracemalloc

    q, x = np.ones((256, 64)), np.ones((4000, 64))
    tracemalloc.start()
    i, j, score = vectors.best_of(q, x, np.arange(4000)[::-1], 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(i) == 2560 and set(j.tolist()) == set(range(3990, 4000)) and (score == 64).all()
    assert peak < 200e6


def test_mapping_counts_what_it_loses(spark):
    hits = [(1, 10, 1, 8.0, 5, 0.0, 10.0), (1, 11, 2, 4.0, 5, 100.0, 110.0), (1, 12, 3, 2.0, 6, 0.0, 40.0), (2, 13, 1, 1.0, 6, 9.0, 9.0)]
    hits = spark.createDataFrame(hits, "query_id int, interval_id int, rank int, raw_score double, video_id int, start double, end double")
    frames = spark.createDataFrame([(i, 5, float(i)) for i in range(1, 9)] + [(20, 6, 9.0)], "frame_id int, video_id int, at double")
    seen = Observation()
    out = intervals.map_ranked(hits, frames, ["query_id"], ["video_id"], ("start", "end"), "at", 3, 7.0, seen).collect()
    got = sorted((r.query_id, r["rank"], r.interval_id, r.frame_id, round(r.raw_score, 6)) for r in out)
    assert got == [(1, 1, 10, 4, 2.666667), (1, 2, 10, 5, 2.666667), (1, 3, 10, 6, 2.666667), (1, 4, 12, 20, 2.0), (2, 1, 13, 20, 1.0)]
    assert seen.get == {"input": 4, "mapped": 3, "lost": 1, "truncated": 1, "cut_frames": 5, "output": 5, "most": 8}


@pytest.mark.parametrize("cuts", [(), (1,), (3, 4, 9), tuple(range(1, 14))])
def test_a_stream_cut_anywhere_has_the_faults_of_the_table(spark, tmp_path, cuts):
    rows = [(v, f"f{f}", i, d) for v, f, i, d in (
        (1, 0, 0, 4), (1, 1, 1, 4), (1, 2, 2, 4), (2, 0, 0, 4), (2, 0, 1, 4), (2, 3, 2, 4), (3, 0, 0, 4), (3, 1, 2, 4), (3, 2, 3, 5),
        (4, 0, 1, 4), (5, 0, 0, 0), (6, 0, 0, 4), (6, 1, 1, 3), (6, 1, 1, 4),
    )]
    schema = "video_id long, frame_id string, local_index long, dimension int"
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    ends = [0, *cuts, len(rows)]
    for n, (a, b) in enumerate(zip(ends, ends[1:])):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(folder)
        new = [p for p in os.listdir(folder) if p.endswith(".parquet") and not p.startswith("n")]
        for p in new:
            os.rename(f"{folder}/{p}", f"{folder}/n{n:03}.parquet")
            os.utime(f"{folder}/n{n:03}.parquet", (1000 + n, 1000 + n))
    ordered.with_state(spark)
    stream = ordered.order_faults(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder))
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state"))
    query.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema("video_id long, code string, local_index long").parquet(out).collect()
    table = spark.createDataFrame(rows, schema).withColumn("vector", F.array_repeat(F.lit(1.0), F.col("dimension")))
    want = {(r.video_id, r.code) for r in contracts.stream_faults(table).collect()}
    assert sorted((r.video_id, r.code) for r in got) == sorted(want)


def brute_variants(values, exclude, limit):
    def fold(t):
        t = " ".join(re.findall(r"\w+", unicodedata.normalize("NFKC", t).casefold()))
        while True:
            for p in variants.GENERIC_PREFIXES:
                if t == p or t.startswith(p + " "):
                    t = t[len(p) + 1 :]
                    break
            else:
                return t

    def near(a, b):
        a, b = fold(a), fold(b)
        if not a or not b:
            return a == b
        return a == b or sorted(a.split()) == sorted(b.split()) or difflib.SequenceMatcher(None, a, b).ratio() >= 0.94

    known, out = [" ".join(x.split()) for x in exclude], []
    for n, value in enumerate(values):
        value = " ".join((value or "").split())
        if value and not any(near(value, k) for k in known):
            known.append(value)
            out.append((n, value))
            if len(out) == limit:
                break
    return out


def test_near_duplicates_go_in_order(spark, sf_dir):
    lists = {
        1: (["a red car on the street", "A red  car on the street!", "street the on car red a", "image of a red car on the street", "blue bird"], []),
        2: (["???", "!!!", "", None, "image of", "scene showing image of"], ["a photo of"]),
        3: (["the quick brown fox jumps over the lazy dog", "the quick brown fox jumped over the lazy dog", "the slow brown fox", "ﬁne", "fine"], []),
        4: ([f"text number {i} of many" for i in range(20)], ["text number 3 of many", "text number 3 of many"]),
        5: (["one", "two", "three", "four"], ["two"]),
    }
    rows = [(k, n, t) for k, (values, _) in lists.items() for n, t in enumerate(values)]
    known = [(k, t) for k, (_, texts) in lists.items() for t in texts]
    frame = spark.createDataFrame(rows, "query_id int, pos int, text string")
    other = spark.createDataFrame(known, "query_id int, text string")
    for limit in (None, 2):
        got = variants.without_near_duplicates(frame, ["query_id"], limit, other).collect()
        found = {k: sorted((r.pos, r.text) for r in got if r.query_id == k) for k in lists}
        assert found == {k: brute_variants(values, texts, limit) for k, (values, texts) in lists.items()}
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    got = {(r.query_id, r.pos) for r in building.variant_elimination(spark, sf_dir).collect()}
    for r in items:
        w = r.text.split(" ")
        half = w[len(w) // 2 :]
        made = [r.text.upper(), " ".join(half), "Image of " + "  ".join(half), " ".join(w[::-1]), r.text + "!?", " ".join(half[::-1])]
        assert {p for q, p in got if q == r.item_id} == {p for p, _ in brute_variants(made, [r.text], 2)}


def test_long_lists_of_variants_are_an_error(spark):
    rows = [(1, n, f"t{n}") for n in range(variants.MOST + 1)]
    with pytest.raises(contracts.ContractBroken, match="lists of over"):
        variants.without_near_duplicates(spark.createDataFrame(rows, "query_id int, pos int, text string"), ["query_id"])


def test_ratio_bounds_hold(spark):
    r = random.Random(3)
    rows = [("".join(r.choices("abcd ", k=r.randrange(1, 40))), "".join(r.choices("abce ", k=r.randrange(1, 40)))) for _ in range(200)]
    df = spark.createDataFrame(rows, "a string, b string")
    for x in df.select("*", variants.most_ratio(F.col("a"), F.col("b")).alias("m"), variants.most_ratio_by_length(F.col("a"), F.col("b")).alias("l")).collect():
        matcher = difflib.SequenceMatcher(None, x.a, x.b)
        assert matcher.ratio() <= x.m + 1e-12 <= x.l + 2e-12
        assert x.m == pytest.approx(matcher.quick_ratio()) and x.l == pytest.approx(matcher.real_quick_ratio())


@pytest.mark.parametrize("holds", [1000, 40, 7])
def test_batches_shrink_until_they_fit(spark, holds):
    def make():
        def model(batch):
            if batch.num_rows > holds:
                raise RuntimeError("device out of memory")
            return pa.RecordBatch.from_arrays([batch.column(0)], ["id"])

        return model

    seen = Observation()
    df = encoders.in_shrinking_batches(spark.range(500).repartition(2), make, "id long", rows=64, seen=seen)
    if holds == 7:
        with pytest.raises(Exception, match="out of memory"):
            df.collect()
        return
    assert sorted(r.id for r in df.collect()) == list(range(500))
    assert seen.get == {"rows": 500, "most_halvings": 0 if holds == 1000 else 1}


def test_a_model_that_drops_rows_is_an_error(spark):
    make = lambda: lambda batch: batch.slice(1)
    with pytest.raises(Exception, match="rows for"):
        encoders.in_shrinking_batches(spark.range(5), make, "id long").collect()


def test_only_changed_partitions_are_written(spark, tmp_path):
    path = str(tmp_path / "videos")
    frame = lambda rows: spark.createDataFrame(rows, "video_id string, n int, t string")
    states = lambda df: {r.video_id: r.state for r in df.collect()}
    files = lambda: {v: sorted(os.listdir(f"{path}/video_id={v}")) for v in "abcd" if os.path.isdir(f"{path}/video_id={v}")}
    first = [("a", 1, "x"), ("a", 2, None), ("b", 1, "y"), ("b", 1, "y"), ("c", 3, "z")]
    assert states(partitions.replace(frame(first), path)) == {"a": "new", "b": "new", "c": "new"}
    before = files()
    second = [("a", 2, None), ("a", 1, "x"), ("b", 1, "y"), ("d", 1, "v")]
    assert states(partitions.replace(frame(second), path)) == {"a": "same", "b": "replaced", "d": "new"}
    after = files()
    assert after["a"] == before["a"] and after["c"] == before["c"] and after["b"] != before["b"]
    rows = sorted(tuple(r) for r in partitions.read(frame(first), path).fillna("-").collect())
    assert rows == [("a", 1, "x"), ("a", 2, "-"), ("b", 1, "y"), ("c", 3, "z"), ("d", 1, "v")]
    with pytest.raises(ValueError, match="null"):
        partitions.replace(frame([(None, 1, "x")]), path)


def test_a_recogniser_says_what_it_returns(spark):
    pages = spark.createDataFrame([(1, "<a>one</a><a x='1'>t-2</a>"), (2, None), (3, "none")], "id int, html string")
    got = recognisers.regions(spark, pages, "html", "a", ("confidence",))
    assert got.columns == ["id", "html", "ord", "text", "confidence"]
    assert sorted((r.id, r.ord, r.text, round(r.confidence, 6)) for r in got.collect()) == [(1, 0, "one", 1.0), (1, 1, "t-2", 0.666667)]
    for element, columns in (("a", ("colour",)), ("<", ())):
        with pytest.raises(Exception, match="no such column|constant"):
            recognisers.regions(spark, pages, "html", element, columns)


def reduced(chunks, model, room, rounds):
    """The rounds one after the other, in plain loops."""
    def packed(t, most):
        out, line = [], ""
        for w in (t or "").split():
            for piece in [w[i : i + most] for i in range(0, len(w), most)]:
                if line and len(line) + 1 + len(piece) <= most:
                    line += " " + piece
                else:
                    out += [line] if line else []
                    line = piece
        return out + ([line] if line else [])

    half, before = room // 2, None
    parts = [p for t in chunks if t and t.strip(" ") for p in packed(t, half)]
    for n in range(rounds + 1):
        parts = [(packed(model(p), half) or packed(p, half))[0] for p in parts]
        size = sum(len(p) + 1 for p in parts)
        if len(parts) == 1:
            return parts[0], n, "done"
        if n == rounds or (before is not None and size >= before):
            return packed(" ".join(parts), half)[0], n, "cut"
        before, groups, end = size, {}, 0
        for p in parts:
            end += len(p) + 1
            groups.setdefault((end - 1) // half, []).append(p)
        parts = ["\n".join(g) for _, g in sorted(groups.items())]


@pytest.mark.parametrize("name", ["first", "same", "none"])
def test_summaries_equal_plain_rounds(spark, name):
    r = random.Random(8)
    chunks = {k: [" ".join("x" * r.randrange(1, 12) for _ in range(r.randrange(0, 60))) for _ in range(r.randrange(1, 40))] for k in range(6)}
    chunks[9], chunks[10] = ["", None, "  "], ["y" * 300]
    def make():
        return {"first": lambda t: " ".join(t.split()[:3]), "same": lambda t: t, "none": lambda t: None}[name]

    rows = [(k, n, t) for k, texts in chunks.items() for n, t in enumerate(texts)]
    got = summaries.reduce_texts(spark.createDataFrame(rows, "conv_id int, pos int, text string"), "conv_id", make, room=80, rounds=4).collect()
    want = {k: reduced(t, make(), 80, 4) for k, t in chunks.items() if any(x and x.strip(" ") for x in t)}
    assert {x.conv_id: (x.text, x.n_rounds, x.state) for x in got} == want and len(got) == len(want)
    assert all(len(x.text) <= 40 for x in got)


def test_a_change_goes_down_the_levels(spark):
    rows = [
        (1, "source", "s", None), (1, "raw", "r", "s"), (1, "cleaned", "c", "r"), (1, "summary", "m", "c"),
        (2, "source", "s2", None), (2, "raw", "r", "s"), (2, "cleaned", "c", "r"), (2, "summary", "m", "c"),
        (3, "source", "s", None), (3, "raw", "r", "s"), (3, "summary", "m", "c"),
        (4, "source", "s", None), (4, "raw", "r", "s"), (4, "cleaned", "c", "r"), (4, "summary", None, "c"),
        (5, "source", "s", None), (6, "other", "x", None),
    ]
    df = spark.createDataFrame(rows, "video_id int, level string, fingerprint string, made_from string")
    got = sorted((r.video_id, r.level, r.code) for r in staleness.stale(df).collect())
    assert got == sorted([
        (2, "raw", "changed"), (2, "cleaned", "cascade"), (2, "summary", "cascade"), (3, "cleaned", "missing"), (3, "summary", "changed"),
        (4, "summary", "missing"), *((v, x, "missing") for v in (5, 6) for x in ("raw", "cleaned", "summary")),
    ])


def test_perspective_takes_pixels_to_corners(spark):
    quads = [[(2.0, 1.0), (30.0, 4.0), (28.0, 20.0), (1.0, 17.0)], [(0.0, 0.0), (9.0, 0.0), (9.0, 4.0), (0.0, 4.0)], [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0), (3.0, 3.0)]]
    df = spark.createDataFrame([(n, [{"x": x, "y": y} for x, y in q]) for n, q in enumerate(quads)], "id int, p array<struct<x: double, y: double>>")
    c = geometry.ordered_corners(F.col("p"))
    df = df.select("id", c.alias("c"), geometry.crop_size(c).alias("s"))
    for r in df.select("*", geometry.perspective(F.col("c"), F.col("s.width"), F.col("s.height")).alias("m")).collect():
        if r.id == 2:
            assert r.m is None
            continue
        for (u, v), corner in zip(((0, 0), (r.s.width - 1, 0), (r.s.width - 1, r.s.height - 1), (0, r.s.height - 1)), r.c):
            w = r.m.g * u + r.m.h * v + 1
            assert (r.m.a * u + r.m.b * v + r.m.c) / w == pytest.approx(corner.x)
            assert (r.m.d * u + r.m.e * v + r.m.f) / w == pytest.approx(corner.y)


def test_dedup_keeps_near_frames_of_an_earlier_pass(spark):
    rows = [(1, 10, 0.9, [(5, 0.2), (11, 0.1)]), (1, 11, 0.8, None), (1, 12, 0.7, [(99, 0.6)]), (2, 20, 0.5, None)]
    df = spark.createDataFrame(rows, "g int, frame_id int, final_score double, near array<struct<frame_id: int, final_score: double>>")
    once = ranking.dedup_again(df, ["g"])
    spelt = lambda d: sorted((r.g, r.frame_id, r.final_score, [tuple(x) for x in r.near]) for r in d.collect())
    assert spelt(once) == [(1, 10, 0.9, [(11, 0.8), (12, 0.7), (5, 0.2)]), (2, 20, 0.5, [])]
    assert spelt(ranking.dedup_again(once, ["g"])) == spelt(once)


def test_fusion_refuses_conflicting_metadata(spark):
    rows = [(1, 7, "a", "q0", 1, 2.0, 0.5, "v"), (1, 7, "b", "q0", 3, 1.0, 0.25, "w")]
    schema = "query_id int, frame_id int, branch string, variant_id string, rank int, raw_score double, normalized_score double, video_id string"
    with pytest.raises(contracts.ContractBroken, match="conflicting metadata.*video_id"):
        ranking.fuse_with_evidence(spark.createDataFrame(rows, schema), {"a": 1.0}, ["video_id"])
    good = ranking.fuse_with_evidence(spark.createDataFrame([(*r[:7], "v") for r in rows[::-1]], schema), {"a": 2.0, "b": 1.0}, ["video_id"]).first()
    assert good.final_score == 1.25 and [(e.branch, e["rank"]) for e in good.evidence] == [("a", 1), ("b", 3)] and good.video_id == "v"
    with pytest.raises(contracts.ContractBroken, match="without a normalized score"):
        ranking.fuse_with_evidence(spark.createDataFrame([(*rows[0][:6], None, "v")], schema), {}, ["video_id"])


def test_rollback_goes_back_more_than_once(spark, tmp_path):
    kept = store.Store(spark, str(tmp_path / "store"))
    for n in (1, 2, 3):
        kept.publish({"t": spark.range(n)})
    assert kept.read("t").count() == 3 and kept.rollback()["record_counts"] == {"t": 2}
    assert kept.read("t").count() == 2 and kept.rollback()["record_counts"] == {"t": 1} and kept.read("t").count() == 1
    with pytest.raises(store.NotPublished):
        kept.rollback()


def test_archives_are_bounded_and_quoted(spark, monkeypatch):
    rows = [(1, "q1-kis", 2, 'a,"b"', 7), (1, "q1-kis", 1, "plain", 8), (2, "q2-qa", 1, "new\nline", 9)]
    df = spark.createDataFrame(rows, "archive int, query_id string, place int, video_id string, frame_id int")
    made = submission.archives(df, "archive", "video_id", "frame_id")
    assert sorted((r.archive, r.n_files, r.n_rows) for r in made.collect()) == [(1, 1, 2), (2, 1, 1)]
    got = {(r.archive, r.name): r.text for r in submission.members(made, "archive").collect()}
    assert got == {(1, "submission/q1-kis.csv"): 'plain,8\n"a,""b""",7\n', (2, "submission/q2-qa.csv"): '"new\nline",9\n'}
    assert zipfile.ZipFile(io.BytesIO(submission.zipped(df.limit(0), "video_id"))).namelist() == []
    monkeypatch.setattr(submission, "MOST_ROWS", 1)
    with pytest.raises(contracts.ContractBroken, match="answers"):
        submission.archives(df, "archive", "video_id")


def test_policies_are_frozen_and_checked():
    policy = requests.policy_from({"RANKING_SUMMARY_WEIGHT": "0.3", "RANKING_POLICY_NAME": "p"})
    assert policy.summary_weight == 0.3 and policy.object_max_boost == 0.2
    with pytest.raises(TypeError):
        policy.weights["visual_dense"] = 2
    for wrong in ({"summary_weight": float("nan")}, {"rrf_k": 0}, {"variants": {"q0": -1.0}}, {"object_soft_boost": True}):
        with pytest.raises(ValueError):
            requests.RankingPolicy(**wrong)
    lines = requests.warnings(policy, {}, {}, [])
    assert "ranking_policy=p:experimental" in lines and "summary_weight=0.3" in lines and len(lines) == len(set(lines)) == 9
