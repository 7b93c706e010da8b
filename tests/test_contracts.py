"""Language rules, detection filters and contract checks against small expected results."""

import pytest
from pyspark.sql import functions as F

from keyloom.functions import language, strings
from keyloom.operators import contracts, detections, intervals, text
from keyloom.plans import requests, submission


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def each(spark, column, values, schema="a string, b string"):
    data = [(i, *v) for i, v in enumerate(values)]
    return [r.x for r in spark.createDataFrame(data, "i int, " + schema).orderBy("i").select(column.alias("x")).collect()]




def test_summaries(spark):
    good = "Bản tin cho biết người dân đã được hỗ trợ sau bão, theo chính quyền."
    source = " ".join(f"từ{i} và" for i in range(60))
    got = each(spark, language.summary_fault(F.col("a"), F.col("b")), [
        (good, "x"), ("The mayor said that the storm was over.", "x"), ("", "x"), (None, "x"), ("- " + good, "x"), (good, source),
        (" ".join([good] * 8), source), ("Đường đông, rất ưu.", "x"),
    ])
    assert got == [None, "language", "language", "language", "format", "too_short", None, None]


def test_cleaned_transcripts(spark):
    raw = "hôm nay có 12,5% người không đến và ba xe"
    got = each(spark, language.cleaning_fault(F.col("a"), F.col("b")), [
        (raw.capitalize() + ".", raw), (" ", raw), (None, raw), ('{"cleaned_text": "' + raw + '"}', raw), ("```" + raw, raw),
        (raw + " và " * 60, raw), (raw.replace("12,5", "12"), raw), (raw.replace("ba", "bốn"), raw),
        ("this is the report that was from the local", "report the this is that was from local"),
        ("một hai", None),
    ])
    assert got == [None, "empty", "empty", "format", "format", "expansion", "numbers", "numbers", "language", "numbers"]


def test_choice_of_text(spark):
    long = "x" * 600
    got = each(spark, language.text_to_summarise(F.col("a"), F.col("b")), [
        ("raw", " clean "), ("raw", ""), ("", "clean"), (None, None), ("raw", '{"cleaned_text": "c"}'), ("raw", long), ("y" * 400, long),
    ])
    assert got == ["clean", "raw", "clean", "", "raw", "raw", long]


def test_redaction(spark):
    uris = ["https://user:pw@Host.example:8443/p?token=1#f", "http://h", "no uri", "http:///x", None, "s3://bucket/key", "http://[::1]:80/x"]
    got = each(spark, language.redact_uri(F.col("a")), [(u, None) for u in uris])
    assert got == ["https://host.example:8443", "http://h", "[redacted-uri]", "[redacted-uri]", None, "s3://bucket", "http://[::1]:80"]
    got = each(spark, language.redact_detail(F.col("a"), F.col("b")), [("api_TOKEN", "s"), ("milvus_uri", uris[0]), ("note", "n" * 501), ("note", None)])
    assert got == ["[redacted]", "https://host.example:8443", "n" * 497 + "...", None]


def test_utc(spark):
    good = ["2026-01-02T03:04:05Z", "2026-01-02T03:04:05.123Z", "2026-01-02T03:04Z"]
    bad = ["2026-01-02T03:04:05+00:00", "2026-13-02T03:04:05Z", "Z", "", None, "2026-01-02T25:04:05Z"]
    assert each(spark, language.is_utc_instant(F.col("a")), [(x, None) for x in good + bad]) == [True] * 3 + [False] * 6


def test_information_needs_words_and_different_words(spark):
    got = each(spark, strings.is_informative(F.col("a")), [(" ".join(f"từ{i}" for i in range(30)),), (" ".join(f"từ{i % 30}" for i in range(100)),), ("a " * 200,)], "a string")
    assert got == [False, True, False]


def test_detections(spark):
    regions = spark.createDataFrame([("a", 0.12345), (" \n", 0.9), ("b", 0.05), (None, 0.9)], "text string, confidence double")
    assert rows(detections.confident_texts(regions, 0.1)) == [("a", 0.1234)]
    data = [(0.9, -3.0, 0.5, 12.5, 8.4), (0.9, 5.0, 5.0, 5.2, 9.0), (0.1, 0.0, 0.0, 9.0, 9.0), (0.5, 1.5, 2.5, 99.0, 99.0)]
    boxes = spark.createDataFrame([(*d, 20, 10) for d in data], "confidence double, x1 double, y1 double, x2 double, y2 double, w int, h int")
    assert rows(detections.confident_boxes(boxes, 0.2, "w", "h").drop("w", "h")) == [(0.5, 2, 2, 20, 10), (0.9, 0, 0, 12, 8)]
    ok = spark.createDataFrame(
        [([0.0, 0.0, 5.0, 5.0],), ([0.0, 0.0, 5.0],), ([5.0, 0.0, 0.0, 5.0],), ([0.0, 0.0, 50.0, 5.0],), ([0.0, float("nan"), 5.0, 5.0],), (None,)],
        "b array<double>",
    )
    assert [r[0] for r in ok.select(detections.is_box(F.col("b"), F.lit(10), F.lit(10))).collect()] == [True] + [False] * 5
    assert each(spark, detections.share_of(F.col("a"), F.col("b")), [(5, 10), (11, 10), (-1, 10), (0, 0)], "a int, b int") == [0.5, None, None, None]


def test_numbers_are_gapless(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), (None, 9), ("a", 1)], "v string, o int")
    assert rows(detections.numbered(df, "v", "o").select("object_id", "o")) == [(1, 9), (2, 1), (3, 2), (4, 1)]
    assert detections.numbered(df.limit(0), "v", "o").count() == 0


def test_stream_faults(spark):
    frames = [("ok", i, i, [1.0, 2.0]) for i in range(4)] + [("gap", 0, 0, [1.0]), ("gap", 1, 2, [1.0])]
    frames += [("twice", 0, 0, [1.0]), ("twice", 0, 1, [1.0]), ("size", 0, 0, [1.0]), ("size", 1, 1, [1.0, 2.0]), ("one", 5, 1, [1.0]), ("none", None, None, None)]
    df = spark.createDataFrame(frames, "video_id string, frame_id int, local_index int, vector array<double>")
    assert rows(contracts.stream_faults(df)) == [
        ("gap", "local_index"), ("none", "local_index"), ("one", "local_index"), ("size", "dimension"), ("twice", "duplicate_frame_id"),
    ]
    with pytest.raises(contracts.ContractBroken, match="gap, local_index"):
        contracts.require_none(contracts.stream_faults(df), "stream")
    contracts.require_none(contracts.stream_faults(df.filter("video_id = 'ok'")), "stream")


def test_results_and_answers(spark):
    plan = spark.createDataFrame([("q", "b", "q0", "frame", "text", 2)], "query_id string, branch string, variant_id string, level string, query_text string, top_k int")
    hit = lambda *x: spark.createDataFrame(list(x), "query_id string, branch string, variant_id string, level string, query_text string")
    good = ("q", "b", "q0", "frame", "text")
    assert rows(contracts.result_faults(hit(good, good), plan)) == []
    found = contracts.result_faults(hit(good, good, good, ("q", "c", "q0", "frame", "text"), ("q", "b", "q0", "video", "text"), ("q", "b", "q0", "frame", "else")), plan)
    assert {r.code for r in found.collect()} == {"level", "not_planned", "query_text", "too_many"}
    answers = [("a", "ANSWERED", "yes", ["1"]), ("b", "ANSWERED", " ", ["1", "1"]), ("c", "ANSWERED", "x", None), ("d", "INSUFFICIENT_EVIDENCE", "x", []), ("e", "INSUFFICIENT_EVIDENCE", None, [])]
    df = spark.createDataFrame(answers, "query_id string, status string, answer string, evidence_ids array<string>")
    assert rows(contracts.answer_faults(df)) == [("b", "answer_missing"), ("b", "evidence_repeated"), ("c", "evidence_missing"), ("d", "answer_unexpected")]
    mixed = spark.createDataFrame([("q", "a", 0.5), ("q", "a", None), ("q", "b", 0.5), ("q", "c", None)], "query_id string, branch string, normalized_score double")
    assert rows(contracts.mixed_normalisation(mixed)) == [("q", "a")]


def test_counts_plans_and_states(spark):
    sel = spark.createDataFrame([("q", 10, 7, 1, 2, 5, 4), ("r", 3, 5, 0, 0, 2, 2)], "query_id string, attempted int, selected int, truncated int, collisions int, requested int, resolved int")
    assert rows(contracts.left_out(sel)) == [("q", 6, 1), ("r", 0, 0)]
    errors = spark.createDataFrame([("MISSING_KEYFRAME", "v/2"), ("MISSING_KEYFRAME", "v/2"), ("UNREADABLE_KEYFRAME", "v/1"), ("ORPHAN", "v/9")], "code string, path string")
    frames = spark.createDataFrame([("v/1", "v", 7), ("v/2", "v", 3), ("v/3", "v", 1)], "path string, video_id string, frame_index int")
    assert [tuple(r) for r in contracts.repair_plan(errors, frames).collect()] == [("v", 3, "v/2"), ("v", 7, "v/1")]
    with pytest.raises(contracts.ContractBroken, match="v/2"):
        contracts.repair_plan(errors, frames.filter("path <> 'v/2'"))
    with pytest.raises(contracts.ContractBroken):
        contracts.repair_plan(errors.filter("code = 'ORPHAN'"), frames)
    a, b = (spark.createDataFrame([(x,) for x in xs], "name string") for xs in ("ab", "bc"))
    assert rows(contracts.migration_state(a, b)) == [("a", "source"), ("b", "ambiguous"), ("c", "destination")]


def test_alignment_diagnostics(spark):
    sim = [("q", v, e, p) for v, n in (("a", 3), ("b", 1)) for e in range(2) for p in range(n)]
    sim = spark.createDataFrame(sim, "query_id string, video_id string, event_idx int, pos int")
    paths = spark.createDataFrame([("q", "a")], "query_id string, video_id string")
    assert rows(contracts.alignment_diagnostics(sim, paths, ["query_id"], "video_id")) == [("q", 2, 4, 1)]


def test_neighbours_under_a_cap(spark):
    frames = spark.createDataFrame([(f"f{i}", "v", i) for i in range(8)] + [("g0", "w", 0)], "frame_id string, video_id string, n int")
    primary = spark.createDataFrame([("q", "f0", 1), ("q", "f2", 2), ("q", "f3", 3), ("q", "g0", 4), ("r", "f5", 1)], "query_id string, frame_id string, position int")
    got = contracts.neighbours_within(frames, primary, 6, "video_id", "n")
    assert rows(got) == [("q", "f1", 1), ("q", "f4", 2), ("r", "f4", 1), ("r", "f6", 2)]
    assert rows(contracts.neighbours_within(frames, primary, 5, "video_id", "n").filter("query_id = 'q'")) == [("q", "f1", 1)]
    with pytest.raises(contracts.ContractBroken):
        contracts.neighbours_within(frames, primary, 3, "video_id", "n")


def test_repetitive_chunks_go_unless_all_are(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 1, True), ("b", 2, True)], "d string, i int, noise boolean")
    assert rows(contracts.without_repetitive(df, ["d"], "noise").select("d", "i")) == [("a", 2), ("b", 1), ("b", 2)]


def test_window_semijoin_keeps_equal_rows(spark):
    r = spark.createDataFrame([("k", 1.0, 30.0)] * 3 + [("k", 90.0, 95.0)], "k string, s double, e double")
    w = spark.createDataFrame([("k", 5.0, 6.0), ("k", 20.0, 25.0)], "k string, f double, t double")
    assert rows(intervals.in_any_window(r, w, ["k"], ("s", "e"), ("f", "t"), 10.0)) == [("k", 1.0, 30.0)] * 3


def test_requests_and_rows(spark):
    assert requests.submission_name("Query-1-KIS.txt") == "Query-1-KIS.csv" and requests.submission_name("q-qa", "qa") == "q-qa.csv"
    for bad in ("-q-kis.txt", "_q-kis", "q-kis.pdf", "kis"):
        with pytest.raises(ValueError):
            requests.submission_name(bad)
    with pytest.raises(ValueError):
        requests.submission_name("q-qa.txt", "kis")
    policy = requests.policy_from({"X_RANKING_FUSION_DEFAULT_WEIGHT": "2", "X_RANKING_FUSION_OCR_BM25_WEIGHT": "0.5", "X_RANKING_NORMALIZATION_RRF_K": "10"}, "X_")
    assert policy.weights["ocr_bm25"] == 0.5 and policy.weights["visual_dense"] == 2 and policy.rrf_k == 10
    lines = requests.warnings(policy, {"dedup": "d"}, {"dropped": 2}, [("b", "q1", "TIMEOUT")] * 2)
    assert lines[0] == "dedup=d" and lines[-2:] == ["asr_dropped=2", "branch=b;query_variant_id=q1;code=TIMEOUT"]
    df = spark.createDataFrame([("q", "v", 5, 0.1), ("q", "w", 6, 0.9)], "query_id string, video_id string, frame_id int, s double")
    assert rows(submission.competition_rows(df, "query_id", F.desc("s")))[0] == ("q", 1, '{"video_id":"w","frame_id":6}')


def test_analysis_and_fuzzy_search(spark):
    got = each(spark, text.analyse(F.col("a")), [("Đường PHỐ Hà-Nội 2026, œuvre ß 日本",), (None,)], "a string")
    assert got == [["duong", "pho", "ha", "noi", "2026", "oeuvre", "ss", "日本"], None]
    docs = spark.createDataFrame([(1, "harbour light"), (2, "harbor night"), (3, "other words"), (4, None)], "doc_id long, text string")
    q = spark.createDataFrame([("q", "harbor")], "query_id string, text string")
    assert [r.doc_id for r in text.bm25_top_k(q, docs, 5).collect()] == [2]
    fuzzy = text.bm25_top_k(q, docs, 5, fuzzy=True).collect()
    assert [(r["rank"], r.doc_id) for r in fuzzy] == [(1, 2), (2, 1)] and fuzzy[0].raw_score > fuzzy[1].raw_score
    assert text.bm25_top_k(q, docs.limit(0), 5).count() == 0 and text.bm25_top_k(q.limit(0), docs, 5).count() == 0
