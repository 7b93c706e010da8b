"""Declared schemas of the video corpus: relations and per-video artifacts. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

RELATIONS = {
    "videos": "video_id string, source_video_rel_path string, fps double, duration_sec double, frame_count int, width int, height int",
    "frames": "frame_id string, video_id string, shot_id int, source_frame_idx int, timestamp double, image_rel_path string",
    "objects": "id bigint, frame_id string, label string, confidence double, x_min double, y_min double, x_max double, "
    "y_max double, model_source string",
    "visual_features": "frame_id string, video_id string, shot_id int, embedding array<float>",
    "asr_features": "video_id string, interval_id string, start_time_sec float, end_time_sec float, embedding array<float>",
    "summary_features": "video_id string, embedding array<float>",
    "ocr_features": "frame_id string, video_id string, embedding array<float>",
    "ocr_texts": "frame_id string, video_id string, shot_id string, ocr_text_concat string",
    "asr_transcripts": "video_id string, interval_id string, start_time_sec double, end_time_sec double, cleaned_text string",
    "video_summaries": "video_id string, summary string",
}

KEYFRAME = "position double, position_code int, frame_index int, source_frame_idx int, time_sec double, file_path string, image_rel_path string, image_sha256 string"
SHOT = f"shot_id int, start_frame int, end_frame int, start_time_sec double, end_time_sec double, keyframes array<struct<{KEYFRAME}>>"
ARTIFACTS = {
    "video": "contract_version string, video_id string, source_path string, source_video_rel_path string, "
    "source_fingerprint string, producer_config_fingerprint string, fps double, duration_sec double, frame_count int, "
    f"width int, height int, num_shots int, shots array<struct<{SHOT}>>",
    "transcript": "video_id string, source string, llm_provider string, intervals array<struct<interval_id string, "
    "start_time_sec double, end_time_sec double, raw_text string, cleaned_text string, segment_ids array<int>, cleaning_failed boolean>>",
    "summary": "video_id string, summary string, llm_provider string",
    "ocr": "schema_version int, video_id string, provenance map<string,string>, frames array<struct<frame_id string, shot_id int, "
    "position double, ocr_regions array<struct<bbox array<array<double>>, text string, confidence double>>, ocr_text_concat string>>",
    "objects": "schema_version int, video_id string, provenance map<string,string>, frames array<struct<frame_id string, shot_id int, "
    "position double, objects array<struct<label string, confidence double, score double, bbox array<double>, box array<double>, model_source string>>>>",
}


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def differences(df: DataFrame, relation: str) -> list[str]:
    """What distinguishes the schema of `df` from the declared one: names and types, in text order."""
    want = {f.name: f.dataType.simpleString() for f in struct(RELATIONS[relation])}
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    missing = [f"missing {n}" for n in want if n not in have]
    extra = [f"unexpected {n}" for n in have if n not in want]
    other = [f"{n} is {have[n]}, not {want[n]}" for n in want if n in have and have[n] != want[n]]
    return sorted(missing + extra + other)
