"""Substring dedup by content-defined chunks.

A gear rolling hash runs over a text's bytes: each step shifts the hash by one bit and adds the random
number of the next byte, in 16 bits, so that it depends on the last 16 bytes only. A chunk ends at the end of a
word whose hash is divisible by `avg_words`. Boundaries move with the content: an insertion changes the
chunks around it and no others. From every chunk on and up to every chunk there is a window: the shortest
run of chunks with `min_words` words or more. Its digest of 80 bits stands for the whole run, so that windows are alike only
where all their words stand side by side in both places. A window belongs to the document with the smallest id
that holds it, and within a document to its first place and to what overlaps that. Windows that belong elsewhere are
removed; every removed word so stands in an earlier passage of `min_words` words or more, and stock words
and phrases that come from many documents add up to nothing.

Spark counts digests with map-side sums and joins those that recur back to the windows; the written table
of recurring digests lets it split the partition of a digest that very many documents hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.stage import give_back, lean, written

AVG_WORDS = 3
MIN_WORDS = 26
MAX_WORDS = 64
#: Random numbers of the 256 byte values, by rule: the last 2 bytes of a hash of the value.
GEAR = np.array([xxhash.xxh3_64_intdigest(bytes([b]), seed=7) & 0xFFFF for b in range(256)], np.uint16)
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
BATCH = 500_000
#: A window's digest: 64 bits by which documents find their windows again, 16 more against collisions in the corpus.
MARK = np.dtype([("digest", "<i8"), ("check", "<i2"), ("rest", "V6")])


def gear_hash(raw: np.ndarray) -> np.ndarray:
    """The gear hash after every byte: sum of GEAR[byte j before] << j over the last 16 bytes, by doubling."""
    h = GEAR[raw]
    for shift in (1, 2, 4, 8):
        if len(h) > shift:
            h[shift:] += h[:-shift] << np.uint16(shift)
    return h


def chunks(raw: bytes, avg_words: int = AVG_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words) of a text's chunks in bytes; a chunk ends with its last word, spaces follow it."""
    data = np.frombuffer(raw, np.uint8)
    space = SPACE[data]
    inside = np.r_[True, space, True]
    starts, ends = np.nonzero(inside[:-1] & ~inside[1:])[0], np.nonzero(~inside[:-1] & inside[1:])[0]
    if not len(starts):
        return starts, ends, ends
    cut = gear_hash(data.copy())[ends - 1] % np.uint16(avg_words) == 0
    cut[-1] = True
    at = np.nonzero(cut)[0]
    gaps = np.diff(np.r_[-1, at])
    if gaps.max() > MAX_WORDS:
        more = [np.arange(e - g + MAX_WORDS, e, MAX_WORDS) for e, g in zip(at, gaps, strict=True) if g > MAX_WORDS]
        at = np.unique(np.concatenate([at, *more]))
    first = np.r_[0, at[:-1] + 1]
    return starts[first], ends[at], at - first + 1


def digests(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    one = xxhash.xxh3_64_intdigest
    return np.array(
        [one(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64
    ).view(np.int64)


def windows(own: np.ndarray, words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first chunk, chunk after the last, MARK) of the shortest runs of chunks with `min_words` words that begin
    or end at a chunk, in order. Together they cover every run of chunks that has so many words."""
    total = np.r_[0, np.cumsum(words)]
    least = max(1, min_words)
    last = np.searchsorted(total, total[:-1] + least)
    upto = np.nonzero(total >= least)[0]
    since = np.searchsorted(total, total[upto] - least, side="right") - 1
    more = last[since] != upto
    first = np.nonzero(last < len(total))[0]
    first, last = np.r_[first, since[more]], np.r_[last[first], upto[more]]
    order = np.argsort(first, kind="stable")
    first, last = first[order], last[order]
    raw, one = own.tobytes(), xxhash.xxh3_128_digest
    marks = b"".join([one(raw[8 * a : 8 * b]) for a, b in zip(first.tolist(), last.tolist(), strict=True)])
    return first, last, np.frombuffer(marks, MARK)


def document_key():
    """The doc_id; for a null one a number beyond all usual ids that depends on the text."""
    return F.coalesce(
        F.col("doc_id").cast("long"), F.xxhash64("text").bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62)
    )


def _emit(min_words: int):
    """(key, text) -> (digest, check, key), each window once for a document."""
    names = ["digest", "check", "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, keys, held = [], [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                starts, ends, words = chunks(raw)
                _, _, marks = windows(digests(raw, starts, ends), words, min_words)
                _, at = np.unique(marks["digest"], return_index=True)
                found.append(marks[at])
                keys.append(np.full(len(at), key, np.int64))
                held += len(at)
                if held > BATCH:
                    yield out(found, keys)
                    found, keys, held = [], [], 0
            if held:
                yield out(found, keys)

    def out(found: list, keys: list) -> pa.RecordBatch:
        marks = np.concatenate(found)
        columns = [np.ascontiguousarray(marks["digest"]), np.ascontiguousarray(marks["check"]), np.concatenate(keys)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return run


def strip(text: str | None, foreign: np.ndarray | None, min_words: int) -> tuple[str | None, int, list]:
    """The text without windows that belong elsewhere; its number of chunks; removed byte spans."""
    raw = (text or "").encode()
    starts, ends, words = chunks(raw)
    if not len(starts):
        return text, 0, []
    own = digests(raw, starts, ends)
    first, last, marks = windows(own, words, min_words)
    _, place, same = np.unique(marks["digest"], return_index=True, return_inverse=True)
    hit = first >= last[place][same]
    if foreign is not None and len(foreign):
        hit |= np.isin(marks["digest"], foreign)
    cover = np.bincount(first[hit], minlength=len(own) + 1) - np.bincount(last[hit], minlength=len(own) + 1)
    gone = np.cumsum(cover[:-1]) > 0
    edge = np.diff(np.r_[False, gone, False].astype(np.int8))
    after = np.r_[starts[1:], len(raw)]
    runs = zip(np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist(), strict=True)
    spans = [(int(starts[a]), int(after[b - 1])) for a, b in runs]
    if not spans:
        return text, len(own), []
    at, kept = 0, []
    for a, b in spans:
        kept.append(raw[at:a])
        at = b
    kept.append(raw[at:])
    return b"".join(kept).decode(), len(own), spans


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns of `docs` (doc_id, text, ...), `text` without repeated passages, and a struct
    column `dedup` (n_chunks, removed: array of byte spans of the input text).

    The document with the smallest id keeps a passage; rows of one doc_id are one document. A null id
    comes after all ids and is told apart by its text. Null and empty texts stay as they are and a text
    may become empty. Words are separated by ASCII white space. An empty table gives no rows. A column
    of `docs` named `dedup` is replaced.
    """
    keyed = docs.select(F.struct("*").alias("row"), document_key().alias("key"))
    held = keyed.select("key", F.col("row.text").alias("text")).mapInArrow(lean(_emit(min_words)), "digest long, check short, key long")
    again = written(
        held.groupBy("digest", "check")
        .agg(F.min("key").alias("owner"), F.max("key").alias("last"))
        .filter(F.col("owner") < F.col("last"))
        .select("digest", "check", "owner"),
        "digests",
    )
    foreign = (
        held.join(again, ["digest", "check"])
        .filter(F.col("key") > F.col("owner"))
        .groupBy("key")
        .agg(F.collect_set("digest").alias("foreign"))
    )

    @F.arrow_udf("text string, n_chunks int, removed array<struct<start:int,end:int>>")
    def stripped(text: pa.Array, foreign: pa.Array) -> pa.Array:
        left, n, spans, upto = [], [], [], [0]
        for t, f in zip(text, foreign, strict=True):
            one, chunks_of, removed = strip(t.as_py(), f.values.to_numpy() if f.is_valid else None, min_words)
            left.append(one)
            n.append(chunks_of)
            spans += removed
            upto.append(len(spans))
        ends = np.array(spans, np.int32).reshape(-1, 2)
        both = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(ends[:, i])) for i in (0, 1)], ["start", "end"])
        columns = [pa.array(left, pa.string()), pa.array(n, pa.int32()), pa.ListArray.from_arrays(pa.array(upto, pa.int32()), both)]
        give_back()
        return pa.StructArray.from_arrays(columns, ["text", "n_chunks", "removed"])

    found = keyed.join(foreign, "key", "left").select("row", stripped("row.text", "foreign").alias("new"))
    columns = [F.col(f"row.`{c}`").alias(c) if c != "text" else F.col("new.text").alias("text") for c in docs.columns if c != "dedup"]
    return found.select(*columns, F.struct("new.n_chunks", "new.removed").alias("dedup"))
