"""Where models come in: encoders, detectors and language models as injected callables.

A callable takes a list of inputs and gives a list of outputs. A factory makes it once per Python worker, so a model is loaded once;
batches reach it through Arrow.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Times that a task halves its batches for want of memory.
MAX_HALVINGS = 3
Encode = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def hashed_encoder(dimension: int = 64) -> Callable[[], Encode]:
    """A deterministic stand-in for a text model: signed word hashes, scaled to length 1."""

    def make() -> Encode:
        def encode(texts: Sequence[str]) -> list[list[float]]:
            out = np.zeros((len(texts), dimension))
            for row, text in zip(out, texts, strict=True):
                for word in (text or "").lower().split():
                    h = hashlib.blake2b(word.encode(), digest_size=8).digest()
                    row[int.from_bytes(h[:4], "little") % dimension] += 1 if h[4] & 1 else -1
                length = np.linalg.norm(row)
                row[:] = row / length if length else np.eye(1, dimension)[0]
            return out.tolist()

        return encode

    return make


def counting_encoder(dimension: int = 64) -> Callable[[], Encode]:
    """A stand-in that SQL can state too: counts of words by the first byte of their MD5, scaled to length 127 and floored.

    Products of such vectors are whole numbers, so their sums do not depend on the order. No words give the zero vector.
    """

    def make() -> Encode:
        def encode(texts: Sequence[str]) -> list[list[float]]:
            out = np.zeros((len(texts), dimension))
            for row, text in zip(out, texts, strict=True):
                for word, n in Counter(re.findall(r"[^ \t\n\r\f\v]+", text.lower())).items():
                    row[hashlib.md5(word.encode()).digest()[0] % dimension] += n
                if row.any():
                    row[:] = np.floor(127 * row / np.sqrt(row @ row))
            return out.tolist()

        return encode

    return make


def encode(c: Column, make: Callable[[], Encode]) -> Column:
    """Vectors of a text column."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            yield pd.Series([[float(x) for x in v] for v in model(texts.fillna("").tolist())])

    return run(c)


def encode_distinct(df: DataFrame, text: str, make: Callable[[], Encode], name: str = "vector") -> DataFrame:
    """Vectors for all rows, with one model call for each different text."""
    known = df.select(text).distinct().withColumn(name, encode(F.col(text), make))
    return df.join(known.withColumnRenamed(text, "_text"), F.col(text).eqNullSafe(F.col("_text")), "left").drop("_text")


def expand(df: DataFrame, make: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """A detector or recogniser: any number of rows for each input row, in batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in batches:
            yield model(batch)

    return df.mapInPandas(run, schema)


class NotEncoded(RuntimeError):
    """A model gave something else than one row for each row, or had no memory for the smallest batch."""


def _out_of_memory(error: Exception) -> bool:
    return isinstance(error, MemoryError) or "out of memory" in str(error).lower()


def in_shrinking_batches(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, rows: int = 1024, seen: Observation | None = None
) -> DataFrame:
    """What a model makes of all rows, in batches that shrink: `schema` and `halvings int`.

    The model gets at most `rows` rows at once and gives one row for each, in order. Where it runs out of memory (a MemoryError, or an
    error that says so) the batch is halved and what is left of the rows is tried again, MAX_HALVINGS times in a task; then
    the error stands. Rows that were made before are neither made again nor lost. `halvings` is how often a row's batch had been
    halved; `seen` observes rows and the most halvings, so that a run tells that its batches were too large.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, size, halvings = make(), max(1, rows), 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, size)
                try:
                    made = model(part)
                except Exception as error:
                    if not _out_of_memory(error) or halvings == MAX_HALVINGS or size == 1:
                        raise
                    size, halvings = (size + 1) // 2, halvings + 1
                    continue
                if made.num_rows != part.num_rows:
                    raise NotEncoded(f"{made.num_rows} rows for {part.num_rows}")
                names = [*made.schema.names, "halvings"]
                yield pa.RecordBatch.from_arrays([*made.columns, pa.array([halvings] * made.num_rows, pa.int32())], names)
                at += part.num_rows

    out = df.mapInArrow(run, f"{schema}, halvings int")
    if seen is None:
        return out
    return out.observe(seen, F.count("*").alias("rows"), F.coalesce(F.max("halvings"), F.lit(0)).alias("most_halvings"))


def similar_texts(a: Column, b: Column, least: float = 0.94) -> Column:
    """Near duplicates: equal words in any order, or a sequence-matcher ratio of `least` or more on folded words."""

    @F.pandas_udf("boolean")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        import difflib
        import re
        import unicodedata

        def fold(t: str | None) -> list[str]:
            return re.findall(r"\w+", unicodedata.normalize("NFKC", t or "").casefold())

        out = []
        for s, t in zip(x, y, strict=True):
            p, q = fold(s), fold(t)
            same = sorted(p) == sorted(q)
            out.append(same or difflib.SequenceMatcher(None, " ".join(p), " ".join(q)).ratio() >= least)
        return pd.Series(out, dtype=bool)

    return run(a, b)
