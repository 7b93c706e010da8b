"""Checks of ordered frames while they arrive: state of each video carried from micro-batch to micro-batch.

The state of a video is the place that must come next, the length of its vectors and the faults already told, and the ids
seen so far. It lies in the state store, so that a query that starts again goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FAULTS = "video_id long, code string, local_index long"
#: Codes in the order in which they are told.
CODES = ("duplicate_frame_id", "local_index", "dimension")


class _Order(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "next_index long, dimension int, told string")
        self.ids = handle.getMapState("ids", "frame_id string", "times long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        next_index, dimension, told = self.place.get() if self.place.exists() else (0, -1, "")
        faults: dict[str, int | None] = {}
        # a micro-batch holds a video's rows in any order
        arrived = pd.concat(list(rows)).sort_values("local_index", na_position="first", kind="stable")
        for frame, index, size in zip(arrived["frame_id"], arrived["local_index"], arrived["dimension"], strict=True):
            at = None if pd.isna(index) else int(index)
            name = (str(frame),)
            if self.ids.containsKey(name):
                faults.setdefault("duplicate_frame_id", at)
            self.ids.updateValue(name, (1,))
            if at != next_index:
                faults.setdefault("local_index", at)
            next_index = next_index + 1 if at is None else max(next_index, at + 1)
            length = 0 if pd.isna(size) else int(size)
            if length < 1 or dimension not in (-1, length):
                faults.setdefault("dimension", at)
            dimension = length if dimension == -1 else dimension
        already = told.split(",") if told else []
        new = [c for c in CODES if c in faults and c not in already]
        self.place.update((next_index, dimension, ",".join([*already, *new])))
        if new:
            yield pd.DataFrame({"video_id": [key[0]] * len(new), "code": new, "local_index": pd.array([faults[c] for c in new], "Int64")})

    def close(self) -> None:
        pass


def with_state(spark: SparkSession) -> None:
    """Keep the state of streams in RocksDB, which arbitrary state asks for. Set before a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def order_faults(frames: DataFrame) -> DataFrame:
    """(video_id, code, local_index): each fault of a video once, at the first row that shows it, as frames arrive.

    frames: a stream of (video_id, frame_id, local_index, dimension), dimension being the vector's length. A video's frames
    must come in order, 0, 1, ... over all micro-batches, without gap or repetition; within one micro-batch any order will do.
    Ids must not repeat and vectors must have one length. A stream whose frames come in order has the
    faults of contracts.stream_faults on the whole table, wherever it is cut. Null places, and vectors that are null or
    empty, are faults. A group's rows of a micro-batch are held by one task: bound them by the source's rate.
    """
    return frames.select("video_id", "frame_id", "local_index", "dimension").groupBy("video_id").transformWithStateInPandas(
        _Order(), outputStructType=FAULTS, outputMode="Append", timeMode="None"
    )
