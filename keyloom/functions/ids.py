"""Identifiers, paths and times, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FRAME_ID = r"^(.+)_([0-9]{5})_([0-9]{3})$"
LEGACY_ID = r"^shot_([0-9]{5})_pos_([0-9]{3})$"


def parse_frame_id(c: Column) -> Column:
    """Struct (video_id, shot_id, position_code); null unless the id is canonical with a position of at most 100."""
    part = lambda i: F.regexp_extract(c, FRAME_ID, i)
    ok = c.rlike(FRAME_ID) & (part(3).cast("int") <= 100)
    return F.when(
        ok,
        F.struct(part(1).alias("video_id"), part(2).cast("int").alias("shot_id"), part(3).cast("int").alias("position_code")),
    )


def build_frame_id(video: Column, shot: Column, position: Column) -> Column:
    """Canonical id from a position as a share; hundredths are cut, not rounded."""
    return F.format_string("%s_%05d_%03d", video, shot.cast("int"), (position * 100).cast("int"))


def position_code(position: Column) -> Column:
    """Hundredths of a position, rounded half to even."""
    return F.bround(position * 100).cast("int")


def normalise_frame_id(c: Column, video: Column) -> Column:
    """Canonical ids as they are, legacy ones with the video's name, others null."""
    legacy = F.concat_ws("_", video, F.regexp_extract(c, LEGACY_ID, 1), F.regexp_extract(c, LEGACY_ID, 2))
    return F.when(c.rlike(LEGACY_ID), legacy).when(parse_frame_id(c).isNotNull(), c)


def is_interval_id(c: Column) -> Column:
    return c.rlike(r"^(0|[1-9][0-9]*)$")


def is_safe_path(c: Column) -> Column:
    """A relative POSIX path without parent steps, empty parts, schemes, drives, backslashes or NUL."""
    bad = r"(^/)|(^|/)\.\.?(/|$)|//|/$|^[A-Za-z][A-Za-z0-9+.\-]*:|\\|\x00"
    return c.isNotNull() & (c != "") & ~c.rlike(bad)


def caption_seconds(c: Column) -> Column:
    """HH:MM:SS,mmm or MM:SS.mmm in seconds; else 0."""
    t = F.translate(F.trim(c), ",", ".")
    n = lambda p, i: F.regexp_extract(t, p, i).cast("double")
    long, short = r"^(\d+):(\d+):(\d+(?:\.\d+)?)$", r"^(\d+):(\d+(?:\.\d+)?)$"
    return (
        F.when(t.rlike(long), n(long, 1) * 3600 + n(long, 2) * 60 + n(long, 3))
        .when(t.rlike(short), n(short, 1) * 60 + n(short, 2))
        .otherwise(0.0)
    )
