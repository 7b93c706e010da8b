"""Artifact readers, the versioned store, streaming, requests and submissions."""

import io
import json
import tempfile
import zipfile

import pytest
from pyspark.sql import functions as F

from keyloom.plans import requests, submission
from keyloom.sources import artifacts, schemas, store
from keyloom.streaming import ingest


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def write(folder, name, value):
    with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
        f.write(value if isinstance(value, str) else json.dumps(value))


def test_video_bundle(spark, folder):
    frame = {"position": 0.15, "position_code": 15, "frame_index": 4, "source_frame_idx": 4, "time_sec": 0.133, "file_path": "a.webp"}
    write(folder, "v.json", {"video_id": "v", "fps": 30.0, "shots": [{"shot_id": 1, "keyframes": [frame]}]})
    got = artifacts.keyframes(artifacts.read_json(spark, folder, "video")).collect()
    assert [(r.frame_id, r.source_frame_idx) for r in got] == [("v_00001_015", 4)]
    write(folder, "broken.json", "{")
    assert artifacts.read_json(spark, folder, "video", strict=False).count() == 1
    with pytest.raises(Exception):
        artifacts.read_json(spark, folder, "video").collect()


def test_transcripts_prefer_cleaned(spark, folder):
    i = lambda n, t, s=0.0, e=1.0: {"interval_id": n, "start_time_sec": s, "end_time_sec": e, "cleaned_text": t}
    write(folder, "v.json", {"video_id": "v", "intervals": [i("0", "raw")]})
    write(folder, "v_cleaned.json", {"video_id": "v", "intervals": [i("007", " clean "), i("x", "bad"), i("2", " "), i("3", "late", 2.0, 1.0)]})
    got = artifacts.transcripts(artifacts.read_json(spark, folder, "transcript")).collect()
    assert [(r.interval_id, r.cleaned_text) for r in got] == [("7", "clean")]


def test_ocr_objects_summaries(spark, folder):
    write(folder, "o.json", {"video_id": "v", "frames": [{"frame_id": "shot_00001_pos_015", "shot_id": 1, "ocr_text_concat": "hi"}, {"frame_id": "v_00001_050", "ocr_text_concat": " "}]})
    assert [tuple(r) for r in artifacts.ocr_texts(artifacts.read_json(spark, folder, "ocr")).collect()] == [("v_00001_015", "v", "1", "hi")]
    write(folder, "o.json", {"video_id": "v", "frames": [{"frame_id": "v_00001_015", "objects": [{"label": " Bus ", "score": 0.9, "box": [1, 1, 24, 18]}]}]})
    r = artifacts.object_boxes(artifacts.read_json(spark, folder, "objects")).first()
    assert (r.label, r.confidence, r.x_max) == ("bus", 0.9, 24.0)
    write(folder, "o.json", {"video_id": "v", "summary": " s "})
    files = artifacts.read_json(spark, folder, "summary")
    assert artifacts.summaries(files).first().summary == "s"
    ids = artifacts.discover({"a": files, "b": files.withColumn("video_id", F.lit("")).withColumn("stem", F.lit("w_cleaned"))})
    assert sorted(r.video_id for r in ids.collect()) == ["v", "w"]


def test_captions(spark):
    srt = "1\r\n00:00:01,000 --> 00:00:02,500\r\nHello\r\nthere\r\n\r\n2\r\n00:00:03,000 --> 00:00:04,000\r\n\r\n"
    vtt = "WEBVTT\n\n00:01.000 --> 00:02.000 align:start\nHi\n"
    df = spark.createDataFrame([("a.srt", srt), ("b.vtt", vtt)], "path string, value string")
    got = sorted((r.path, r.start, r.end, r.text) for r in artifacts.captions(df).collect())
    assert got == [("a.srt", 1.0, 2.5, "Hello there"), ("b.vtt", 1.0, 2.0, "Hi")]


def test_windows_samples_files(spark, folder):
    tracks = spark.createDataFrame([("a", 25, 1), ("b", 0, 1)], "path string, n_samples long, rate int")
    assert [(r["first"], r["last"]) for r in artifacts.audio_windows(tracks, 10).collect()] == [(0, 10), (10, 20), (20, 25)]
    shots = spark.createDataFrame([("v", 1, 0, 29, 30.0)], "video_id string, shot_id int, start_frame int, end_frame int, fps double")
    assert [r.frame_index for r in artifacts.keyframe_samples(shots).collect()] == [4, 14, 25]
    write(folder, "x.MP4", "abc")
    write(folder, "y.txt", "de")
    assert [(r.stem, r.length) for r in artifacts.list_files(spark, folder).collect()] == [("x", 3)]
    assert sorted((r.path, r.size) for r in artifacts.inventory(spark, folder).collect()) == [("x.MP4", 3), ("y.txt", 2)]
    webp = b"RIFF" + (8).to_bytes(4, "little") + b"WEBP" + b"1234"
    df = spark.createDataFrame([(webp, 16), (webp, 17), (b"no", 2)], "c binary, n long")
    assert [r.x for r in df.select(F.coalesce(artifacts.is_webp(F.col("c"), F.col("n")), F.lit(False)).alias("x")).collect()] == [True, False, False]


def test_schema_differences(spark):
    df = spark.createDataFrame([], "video_id string, summary int, more int")
    assert schemas.differences(df, "video_summaries") == ["summary is int, not string", "unexpected more"]


def test_store_publishes_whole_versions(spark, folder):
    s = store.Store(spark, folder)
    with pytest.raises(store.NotPublished):
        s.read("t")
    one, two = spark.range(3).withColumnRenamed("id", "k"), spark.range(5).withColumnRenamed("id", "k")
    first = s.publish({"t": one})
    assert first["record_counts"] == {"t": 3}
    with pytest.raises(store.NotPublished):
        s.publish({"t": two}, {"no four": lambda t: t["t"].filter("k = 4")})
    assert s.read("t").count() == 3
    s.publish({"t": store.upsert(s.read("t"), two.filter("k > 1"), ["k"])})
    assert s.read("t").count() == 5
    s.rollback()
    assert s.read("t").count() == 3 and s.current()["version"] == first["version"]


def test_streaming_ingest(spark, folder, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows.repartition(3).write.parquet(f"{folder}/in")
    stream = ingest.new_rows(spark, f"{folder}/in", rows.schema, files_per_batch=1)
    ingest.append(stream.select("event_id", "event_type"), f"{folder}/out", f"{folder}/ck").awaitTermination()
    ingest.append(stream.select("event_id", "event_type"), f"{folder}/out", f"{folder}/ck").awaitTermination()
    assert spark.read.parquet(f"{folder}/out").count() == rows.count()
    q = ingest.per_window(stream, "ts", ["event_type"], "1 day", "60 days").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = rows.groupBy(F.date_trunc("day", "ts").cast("timestamp").alias("start"), "event_type").count()
    assert spark.table("w").count() == want.count() and spark.table("w").agg(F.sum("n")).first()[0] == rows.count()


def test_requests():
    r = requests.SearchRequest("q", "  red  car ", "car RED")
    assert r.text == "red car" and r.variants() == [("q0", "red car")]
    two = requests.SearchRequest("q", "red car", "a vehicle")
    assert len(two.invocations()) == 11
    for bad in (dict(text=" "), dict(text="a", branches=("ocr_bm25",))):
        with pytest.raises(ValueError):
            requests.SearchRequest("q", **bad)
    for events in (("a",), ("a", "A")):
        with pytest.raises(ValueError):
            requests.AlignmentRequest("q", events)
    with pytest.raises(ValueError):
        requests.RankingPolicy({"visual_dense": 0.0})
    assert requests.submission_name("query-1-kis.txt") == "query-1-kis.csv"


def test_submission_zip(spark):
    df = spark.createDataFrame([("p-1-kis", "v", i, 1.0 - i / 1000) for i in range(150)], "query_id string, video_id string, frame int, s double")
    best = submission.first_answers(df, "query_id", F.desc("s"))
    z = zipfile.ZipFile(io.BytesIO(submission.zipped(best, "video_id", "frame")))
    lines = z.read("submission/p-1-kis.csv").decode().splitlines()
    assert z.namelist() == ["submission/p-1-kis.csv"] and len(lines) == 100 and lines[0] == "v,0"
    answers = spark.createDataFrame([("q", "ok"), ("q", " "), ("q", "x" * 101)], "query_id string, answer string")
    assert submission.invalid_answers(answers).count() == 2


def test_shot_fallback_and_fingerprint(spark):
    from keyloom.functions.fingerprints import fingerprint

    kind = "video_id string, fps double, frame_count int, shots array<struct<shot_id:int,start_frame:int,end_frame:int>>"
    df = spark.createDataFrame([("a", 30.0, 9, []), ("b", 30.0, 9, [(1, 0, 4), (2, 5, 8)]), ("c", 30.0, 9, None), ("d", 1.0, 0, [])], kind)
    got = sorted((r.video_id, r.shot_id, r.start_frame, r.end_frame) for r in artifacts.shots_or_whole(df).collect())
    assert got == [("a", 0, 0, 8), ("b", 1, 0, 4), ("b", 2, 5, 8), ("c", 0, 0, 8)]
    assert fingerprint({"b": 1, "a": "é"}) == fingerprint({"a": "é", "b": 1}) != fingerprint({"a": "e", "b": 1})


def test_store_pointer_is_replaced_in_one_step(spark, tmp_path, monkeypatch):
    from keyloom.sources.store import Store

    store = Store(spark, str(tmp_path))
    first = store.publish({"t": spark.range(3)})
    jvm, path, fs = store._fs()

    class NoDelete:
        exists, create = staticmethod(fs.exists), staticmethod(fs.create)

        def delete(self, *_):
            raise AssertionError("the old pointer must not be deleted first")

        rename = delete

    monkeypatch.setattr(store, "_fs", lambda: (jvm, path, NoDelete()))
    second = store.publish({"t": spark.range(5)})
    assert store.current() == second and second["previous"] == first["version"] and store.read("t").count() == 5
