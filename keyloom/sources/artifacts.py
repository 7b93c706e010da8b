"""Readers of per-video artifacts: nested JSON, captions, embeddings, file listings. All are plain scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.functions import ids
from keyloom.sources.schemas import ARTIFACTS, struct

VIDEO_SUFFIXES = ("mp4", "mkv", "avi", "webm")


def read_json(spark: SparkSession, path: str, kind: str, *, strict: bool = True, glob: str = "*.json") -> DataFrame:
    """One row per JSON file with `path` and `stem`. Strict: a file that cannot be parsed fails the job; else it is left out."""
    reader = spark.read.option("multiLine", True).option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    if strict:
        df = reader.schema(struct(ARTIFACTS[kind])).option("mode", "FAILFAST").json(path)
    else:
        df = reader.schema(struct(ARTIFACTS[kind] + ", _corrupt_record string")).option("mode", "PERMISSIVE").json(path)
    file = F.col("_metadata.file_path")
    df = df.select("*", file.alias("path"), F.regexp_extract(file, r"([^/]+)\.[^./]*$", 1).alias("stem"))
    # an artifact that was parsed names its video; asking for that column keeps the parser from being pruned away
    return df if strict else df.filter(F.col("_corrupt_record").isNull() & F.col("video_id").isNotNull()).drop("_corrupt_record")


def list_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = VIDEO_SUFFIXES) -> DataFrame:
    """(path, length, stem) of all files below `root` with one of the suffixes; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1)
    return files.filter(F.lower("path").rlike(rf"\.({'|'.join(suffixes)})$")).withColumn("stem", stem)


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """(path relative to root, size, sha256) of all files; hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    rel = F.expr(f"substring(path_, locate('{root.rstrip('/')}/', path_) + {len(root.rstrip('/')) + 1})")
    return files.select(base.alias("path_"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256")).select(
        rel.alias("path"), "size", "sha256"
    )


def is_webp(content: Column, length: Column) -> Column:
    """RIFF and WEBP magic, and a little-endian size that fits the file."""
    h = F.hex(F.substring(content, 1, 12))
    byte = lambda i: F.substring(h, 9 + 2 * i, 2)
    size = F.conv(F.concat(byte(3), byte(2), byte(1), byte(0)), 16, 10).cast("long") + 8
    return (F.substring(h, 1, 8) == "52494646") & (F.substring(h, 17, 8) == "57454250") & (size == length)


def keyframes(videos: DataFrame) -> DataFrame:
    """Video artifacts flattened to one row per keyframe."""
    shots = videos.select("video_id", "fps", F.explode("shots").alias("shot"))
    frames = shots.select("video_id", "fps", "shot.shot_id", F.explode("shot.keyframes").alias("k"))
    return frames.select("video_id", "shot_id", "k.*").select(
        ids.build_frame_id(F.col("video_id"), F.col("shot_id"), F.col("position_code") / 100).alias("frame_id"), "*"
    )


def transcripts(files: DataFrame) -> DataFrame:
    """Valid intervals of transcript artifacts; a `_cleaned` file goes before the plain one of the video.

    An interval needs a text, a decimal id and a start that is not after its end; ids lose leading zeros.
    """
    choice = Window.partitionBy("video_id").orderBy(F.desc(F.col("stem").endswith("_cleaned")), "path")
    best = files.withColumn("_n", F.row_number().over(choice)).filter(F.col("_n") == 1)
    rows = best.select("video_id", F.explode("intervals").alias("i")).select("video_id", "i.*")
    text = F.trim(F.coalesce("cleaned_text", "raw_text"))
    ok = (text != "") & F.col("interval_id").rlike("^[0-9]+$") & (F.col("start_time_sec") >= 0)
    return rows.filter(ok & (F.col("end_time_sec") >= F.col("start_time_sec"))).select(
        "video_id",
        F.col("interval_id").cast("bigint").cast("string").alias("interval_id"),
        "start_time_sec",
        "end_time_sec",
        text.alias("cleaned_text"),
    )


def summaries(files: DataFrame) -> DataFrame:
    return files.filter(F.trim("summary") != "").select("video_id", F.trim("summary").alias("summary"))


def ocr_texts(files: DataFrame) -> DataFrame:
    rows = files.select("video_id", F.explode("frames").alias("f")).filter(F.trim("f.ocr_text_concat") != "")
    frame = ids.normalise_frame_id(F.col("f.frame_id"), F.col("video_id"))
    return rows.select(
        frame.alias("frame_id"), "video_id", F.col("f.shot_id").cast("string").alias("shot_id"), "f.ocr_text_concat"
    )


def object_boxes(files: DataFrame) -> DataFrame:
    """One row per detected object; `box` and `score` are other names of `bbox` and `confidence`."""
    rows = files.select("video_id", F.explode("frames").alias("f")).select("video_id", "f.frame_id", F.explode("f.objects").alias("o"))
    box = F.coalesce("o.bbox", "o.box")
    at = lambda i, name: F.get(box, F.lit(i)).alias(name)
    return rows.select(
        ids.normalise_frame_id(F.col("frame_id"), F.col("video_id")).alias("frame_id"),
        F.lower(F.trim("o.label")).alias("label"),
        F.coalesce("o.confidence", "o.score").alias("confidence"),
        at(0, "x_min"), at(1, "y_min"), at(2, "x_max"), at(3, "y_max"),
        F.col("o.model_source").alias("model_source"),
    )


def embeddings(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Rows of an embedding table that have a vector."""
    return spark.read.parquet(path).select(*columns, "embedding").filter(F.col("embedding").isNotNull())


def captions(texts: DataFrame) -> DataFrame:
    """(path, nth, start, end, text): cues of SRT and VTT files given as (path, value), whole files.

    Blocks are parted by blank lines. The time line is the one with an arrow; cue settings after the
    end time are dropped; blocks without text are left out.
    """
    blocks = texts.select("path", F.posexplode(F.split(F.regexp_replace("value", "\r\n?", "\n"), r"\n\s*\n")).alias("nth", "b"))
    lines = F.filter(F.split("b", "\n"), lambda x: F.trim(x) != "")
    arrow = F.array_max(F.transform(lines, lambda x, i: F.when(x.contains("-->"), i).otherwise(-1)))
    found = blocks.select("path", "nth", lines.alias("lines"), arrow.alias("at")).filter(F.col("at") >= 0)
    times = F.split(F.get("lines", F.col("at")), "-->")
    end = F.element_at(F.split(F.trim(F.get(times, F.lit(1))), r"\s+"), 1)
    text = F.array_join(F.transform(F.slice("lines", F.col("at") + 2, F.size("lines")), lambda x: F.trim(x)), " ")
    return found.select(
        "path", "nth", ids.caption_seconds(F.get(times, F.lit(0))).alias("start"), ids.caption_seconds(end).alias("end"),
        text.alias("text"),
    ).filter(F.col("text") != "")


def audio_windows(tracks: DataFrame, seconds: float = 30.0) -> DataFrame:
    """Tracks (path, n_samples, rate) cut into windows of at most `seconds`: (path, nth, first, last)."""
    size = F.floor(F.col("rate") * seconds)
    cut = tracks.filter(F.col("n_samples") > 0).select(
        "path", "n_samples", size.alias("size"), F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("n_samples") - 1, size)).alias("nth", "first")
    )
    return cut.select("path", "nth", "first", F.least(F.col("first") + F.col("size"), F.col("n_samples")).alias("last"))


def discover(families: dict[str, DataFrame]) -> DataFrame:
    """(video_id): the distinct ids of all families (video_id, stem); an id in the payload goes before the file's stem."""
    out = None
    for df in families.values():
        stem = F.regexp_replace("stem", "_cleaned$", "")
        own = F.when(F.trim("video_id") != "", F.trim("video_id"))
        part = df.filter(~F.col("stem").endswith("_raw")).select(F.coalesce(own, stem).alias("video_id"))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def keyframe_samples(shots: DataFrame, positions: tuple[float, ...] = (0.15, 0.5, 0.85)) -> DataFrame:
    """Frames at the given shares of each shot (video_id, shot_id, start_frame, end_frame, fps), held inside it."""
    p = F.explode(F.array(*map(F.lit, positions))).alias("position")
    rows = shots.select("*", p)
    raw = F.col("start_frame") + F.bround(F.col("position") * (F.col("end_frame") - F.col("start_frame")))
    frame = F.greatest(F.col("start_frame"), F.least(F.col("end_frame"), raw)).cast("int")
    return rows.withColumn("frame_index", frame).withColumns(
        {"time_sec": F.bround(F.col("frame_index") / F.col("fps"), 3), "position_code": ids.position_code(F.col("position"))}
    )


def shots_or_whole(videos: DataFrame) -> DataFrame:
    """(video_id, fps, shot_id, start_frame, end_frame): the shots of each video; one over all its frames if it has none."""
    shot = lambda i, a, b: F.struct(i.alias("shot_id"), a.alias("start_frame"), b.alias("end_frame"))
    own = F.transform("shots", lambda x: shot(x["shot_id"], x["start_frame"], x["end_frame"]))
    whole = F.array(shot(F.lit(0), F.lit(0), F.col("frame_count") - 1))
    found = F.when(F.coalesce(F.size("shots"), F.lit(0)) > 0, own).otherwise(whole)
    rows = videos.filter(F.col("frame_count") > 0).select("video_id", "fps", F.explode(found).alias("s"))
    return rows.select("video_id", "fps", "s.*")
