"""Exact removal of byte strings that occur twice, by interval expansion on Burrows-Wheeler intervals.

A string of `least` bytes (200) is removed wherever it starts at two places or more.

Splitting the work. Every window of `least` bytes has an anchor: the least hash of the grams of GRAM bytes in
it. Equal windows have equal anchors, so the corpus falls into independent parts by anchor. Consecutive
windows with one anchor form a segment. Segments whose anchor stands at one place only cannot repeat
and are dropped by a sum over anchors; only the rest are cut from the texts and dealt out.

Within a part. Symbols are blocks of BLOCK bytes, one at every byte, ranked exactly. Strings of k symbols with
several occurrences are intervals of the sorted suffixes. Breadth-first, all intervals are extended
backward by the symbols that stand before their suffixes (their entries of the Burrows-Wheeler
transform): an occurrence goes from interval w to interval cw; extensions with one occurrence end
there, their common prefix being shorter than the next value. Common prefixes thus come up by
increasing value, and expansion stops at `least` bytes: what is in an interval then is a repeat.

An anchor with very many different segments, such as a passage that most documents hold, would be too
much for one task. Its intervals are expanded by Spark in the same way: a symbol is named by the least place
that has its block, an interval by the least place in it; each level joins the symbols before the
occurrences to them and keeps the (symbol, interval) that occur more than once. Names are exact.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.chunk_dedup import document_key
from keyloom.llm.stage import dropped, written

LEAST = 200
GRAM = 32
BLOCK = 40
#: Bytes of segments that a part should hold, and of one anchor above which Spark expands its intervals.
PART_BYTES = 1_000_000
HOT_BYTES = 2_000_000
OUT_ROWS = 200_000
#: Bits of a hash that give way to the gram's place.
PLACE = 20
OUT_BYTES = 16_000_000

_BYTE = np.array([xxhash.xxh3_64_intdigest(bytes([b]), seed=21) | 1 for b in range(256)], np.uint64)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... mod 2^64; kept while texts are not very long."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if len(have) <= 1 << 20:
            _POWERS[base] = have
    return have[:n]


def anchors(data: np.ndarray, least: int = LEAST) -> np.ndarray:
    """The anchor of every window of `least` bytes, with its place (mod 2^PLACE) in the lowest bits.

    Of equal grams in a window the first counts.
    """
    if len(data) < least:
        return np.zeros(0, np.uint64)
    upto = np.r_[np.uint64(0), np.cumsum(_BYTE[data] * _powers(_BASE, len(data)), dtype=np.uint64)]
    gram = (upto[GRAM:] - upto[:-GRAM]) * _powers(_INVERSE, len(data) - GRAM + 1)
    gram = (gram ^ (gram >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    gram ^= gram >> np.uint64(29)
    low = np.uint64((1 << PLACE) - 1)
    gram = gram & ~low | np.arange(len(gram), dtype=np.uint64) & low
    width, have = least - GRAM + 1, 1
    while have < width:
        step = min(have, width - have)
        gram = np.minimum(gram[:-step], gram[step:])
        have += step
    return gram


def segments(data: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, number of windows, whether the anchor moves) of every run of windows with one anchor.

    Two equal windows of one run have their anchor at two places; runs whose anchor does not move have none.
    """
    placed = anchors(data, least)
    own = placed >> np.uint64(PLACE)
    if not len(own):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(bool)
    first = np.nonzero(np.r_[True, own[1:] != own[:-1]])[0]
    moves = np.r_[False, placed[1:] != placed[:-1]]
    moves[first] = False
    return own[first].view(np.int64), first, np.diff(np.r_[first, len(own)]), np.logical_or.reduceat(moves, first)


def _raw(value: pa.Scalar) -> bytes:
    return value.as_buffer().to_pybytes() if value.is_valid else b""


def _held(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(text_key, text) -> (anchor, text_key, start, n, moves)"""
        for batch in batches:
            keys: list[bytes] = []
            found: list[tuple] = []
            held = 0

            def out() -> pa.RecordBatch:
                a, start, n, moves = (np.concatenate(c) for c in zip(*found, strict=True))  # noqa: B023
                times = pa.array(np.repeat(np.arange(len(keys)), [len(f[0]) for f in found]))  # noqa: B023
                return pa.RecordBatch.from_arrays(
                    [pa.array(a), pa.array(keys, pa.binary()).take(times), pa.array(start.astype(np.int32)),  # noqa: B023
                     pa.array(n.astype(np.int32)), pa.array(moves)],
                    ["anchor", "text_key", "start", "n", "moves"],
                )

            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found.append(segments(np.frombuffer(_raw(text), np.uint8), least))
                keys.append(key)
                held += len(found[-1][0])
                if held > OUT_ROWS:
                    yield out()
                    keys, found, held = [], [], 0
            if held:
                yield out()

    return run


def _cut(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(text_key, text, anchors, starts, ns) -> (anchor, text_key, start, bytes)"""
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for key, text, *lists in zip(*(batch.column(i) for i in range(5)), strict=True):
                raw = _raw(text)
                for anchor, start, n in zip(*(x.as_py() for x in lists), strict=True):
                    rows.append((anchor, key.as_py(), start, raw[start : start + n + least - 1]))
                    held += n + least
                if held > OUT_BYTES:
                    yield _segment_batch(rows)
                    rows, held = [], 0
            if rows:
                yield _segment_batch(rows)

    return run


def _segment_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.int32(), pa.binary())
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["anchor", "text_key", "start", "bytes"])


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of tuples of non-negative numbers below 2^31 (or of one array of any numbers)."""
    key = keys[0] if len(keys) == 1 else keys[0].astype(np.int64) << np.int64(31) | keys[1].astype(np.int64)
    return np.unique(key, return_inverse=True)[1]


def _blocks(data: np.ndarray) -> np.ndarray:
    """For every byte the exact rank of the BLOCK bytes from there on (past the end: zeros), by doubling."""
    n = len(data)
    padded = np.r_[data, np.zeros(2 * BLOCK, np.uint8)]
    eight = np.zeros(n + BLOCK, np.uint64)
    for i in range(8):
        eight |= padded[i : n + BLOCK + i].astype(np.uint64) << np.uint64(8 * i)
    one = _ranks(eight)
    rank, size = one, 1
    at = lambda r, by: np.r_[r[by:], np.zeros(by, r.dtype)]
    while 2 * size * 8 <= BLOCK:
        rank, size = _ranks(rank, at(rank, 8 * size)), 2 * size
    while size * 8 < BLOCK:
        rank, size = _ranks(rank, at(one, 8 * size)), size + 1
    return rank[:n]


def repeated(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Which places of segments laid end to end start a string of `least` bytes that starts at another place too."""
    if least % BLOCK:
        raise ValueError(f"the least length must be a multiple of {BLOCK}")
    n = len(data)
    symbol = _blocks(data)
    segment = np.repeat(np.arange(len(starts)), ends - starts)
    place = np.arange(n)
    active = place[place + BLOCK <= ends[segment]]
    interval = symbol[active]
    for level in range(1, least // BLOCK + 1):
        if level > 1:  # backward extension by the symbols before the suffixes of every interval
            before = active - BLOCK
            ok = before >= starts[segment[active]]
            active, interval = before[ok], interval[ok]
            interval = _ranks(symbol[active], interval) if len(active) else interval
        times = np.bincount(interval) if len(interval) else interval
        several = times[interval] > 1 if len(interval) else np.zeros(0, bool)
        active, interval = active[several], interval[several]
        if len(active):
            interval = _ranks(interval)
    out = np.zeros(n, bool)
    out[active] = True
    return out


SPANS = pa.schema([("text_key", pa.binary()), ("spans", pa.list_(pa.int32()))])


def _spans(hit: np.ndarray, least: int) -> np.ndarray:
    """Window starts -> flat [start, end, ...] of the maximal runs of bytes that the windows cover."""
    at = np.nonzero(hit)[0]
    if not len(at):
        return at
    new = np.r_[True, at[1:] > at[:-1] + least]
    last = np.r_[np.nonzero(new)[0][1:] - 1, len(at) - 1]
    return np.stack([at[new], at[last] + least], axis=1).ravel()


def _part(least: int):
    def run(table: pa.Table) -> pa.Table:
        """Segments of one part -> the covered spans of each, in places of its text."""
        raw = table.column("bytes").combine_chunks().dictionary_encode()
        different, code = raw.dictionary.to_pylist(), raw.indices.to_numpy()
        times = np.bincount(code, minlength=len(different))
        ends = np.cumsum([len(b) for b in different])
        starts = np.r_[0, ends[:-1]]
        hit = repeated(np.frombuffer(b"".join(different), np.uint8), starts, ends, least)
        found = []
        for i, b in enumerate(different):
            own = hit[starts[i] : ends[i]]
            found.append(np.array([0, len(b)]) if times[i] > 1 else _spans(own, least))
        keys, spans = [], []
        for k, start, c in zip(table.column("text_key"), table.column("start").to_pylist(), code.tolist(), strict=True):
            if len(found[c]):
                keys.append(k.as_py())
                spans.append((found[c] + start).tolist())
        return pa.table([pa.array(keys, pa.binary()), pa.array(spans, pa.list_(pa.int32()))], schema=SPANS)

    return run


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(segment, bytes) -> (segment, at, block) for every place that has a whole block from there on."""
    for batch in batches:
        for segment, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = np.frombuffer(_raw(raw), np.uint8)
            n = len(data) - BLOCK + 1
            for at in range(0, n, OUT_ROWS):
                to = min(n, at + OUT_ROWS)
                blocks = np.lib.stride_tricks.sliding_window_view(data[at : to + BLOCK - 1], BLOCK)
                flat = pa.py_buffer(np.ascontiguousarray(blocks).tobytes())
                fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(BLOCK), to - at, [None, flat])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(to - at, segment, np.int64)), pa.array(np.arange(at, to, dtype=np.int32)),
                     fixed.cast(pa.binary())],
                    ["segment", "at", "block"],
                )


def _expanded(hot: DataFrame, least: int) -> DataFrame:
    """(text_key, spans) of repeated windows of hot anchors, level by level.

    Equal segments are one, with a note that there are several; all of such a segment is a repeat. Two windows of one
    anchor are compared wherever they are, as in a part.
    """
    if least % BLOCK:
        raise ValueError(f"the least length must be a multiple of {BLOCK}")
    held = written(hot.select("anchor", "text_key", "start", "bytes"), "hot-segments")
    once = held.groupBy("anchor", "bytes").agg(F.count("*").alias("times"))
    # written: the numbers of segments must not change when a task runs again
    once = written(once.withColumn("segment", F.monotonically_increasing_id()), "segments")
    places = once.select("segment", "bytes").mapInArrow(_places, "segment long, at int, block binary")
    place = F.struct("segment", "at")

    def several(occurrences: DataFrame, *by: str) -> DataFrame:
        """Occurrences of intervals that have more than one, each interval named by its least place."""
        names = occurrences.groupBy(*by).agg(F.count("*").alias("n"), F.min(place).alias("interval"))
        # written, so that Spark can split an interval with very many occurrences
        names = written(names.filter("n > 1").drop("n"), "intervals")
        return occurrences.join(names, list(by)).select("segment", "at", "interval")

    active = written(several(places, "block"), "active")
    symbols = active.withColumnRenamed("interval", "symbol")  # a block that occurs once is in no repeat
    for _ in range(1, least // BLOCK):  # backward extension by the symbols before the occurrences
        before = active.select("segment", (F.col("at") - BLOCK).alias("at"), F.col("interval").alias("old"))
        longer = written(before.join(symbols, ["segment", "at"]), "longer")
        active = written(several(longer, "symbol", "old"), "active")
        dropped(longer)
    hits = active.groupBy("segment").agg(F.collect_set("at").alias("at"))  # bounded by the segment
    times = once.select("anchor", "bytes", "segment", "times").join(hits, "segment", "left")
    back = held.join(times, ["anchor", "bytes"])
    whole = F.array(F.col("start"), F.col("start") + F.length("bytes"))
    single = F.transform(F.coalesce("at", F.array().cast("array<int>")), lambda i: F.array(F.col("start") + i, F.col("start") + i + least))
    lists = F.when(F.col("times") > 1, F.array(whole)).otherwise(single)
    return back.select("text_key", F.flatten(lists).alias("spans")).filter(F.size("spans") > 0)


def _result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text_key, text, spans) -> what is left of the text."""
    for batch in batches:
        rows = []
        for key, text, lists in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            raw = _raw(text)
            flat = lists.as_py()
            spans = sorted({(s[i], s[i + 1]) for s in flat for i in range(0, len(s), 2)})
            runs: list[list[int]] = []
            for a, b in spans:
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
            kept, at = hashlib.sha256(), 0
            for a, b in runs:
                kept.update(raw[at:a])
                at = b
            kept.update(raw[at:])
            rows.append((key, sum(b - a for a, b in runs), kept.hexdigest(), [{"start": a, "end": b} for a, b in runs]))
        kinds = (pa.binary(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows
            else [pa.array([], k) for k in kinds],
            ["text_key", "n_removed", "kept_sha256", "spans"],
        )


def dedup(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept_sha256), one row per row of `docs` (doc_id, text).

    spans: the maximal runs of removed bytes, as (start, end). Every byte covered by a string of `least`
    bytes that also starts anywhere else in the corpus is removed, in all places, judged on the input;
    strings never cross documents. A null text counts as empty. Rows with equal texts, repeated rows among
    them, are documents of their own, so all of a text of `least` bytes or more is removed from them.
    Null ids are kept; an empty table gives no rows; other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.md5(text)).alias("text_key"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        document_key().alias("key"),
        text.alias("text"),
    )
    copies = keyed.groupBy("text_key").agg(F.count("*").alias("copies"), F.min("key").alias("key"))

    held = keyed.filter(F.col("n_bytes") >= least).select("text_key", "text")
    held = held.mapInArrow(_held(least), "anchor long, text_key binary, start int, n int, moves boolean")
    place = F.xxhash64("text_key", "start")
    again = written(
        held.groupBy("anchor")
        .agg(F.min(place).alias("a"), F.max(place).alias("b"), F.max("moves").alias("moves"))
        .filter((F.col("a") < F.col("b")) | F.col("moves"))
        .select("anchor"),
        "anchors",
    )
    wanted = (
        held.join(again, "anchor")
        .groupBy("text_key")
        .agg(F.collect_set(F.struct("anchor", "start", "n")).alias("own"))  # bounded by the text
        .join(copies.select("text_key", "key"), "text_key")
    )
    texts = written(
        keyed.select("key", "text_key", "text")
        .join(wanted, ["key", "text_key"])
        .dropDuplicates(["text_key"])
        .select("text_key", "text", "own.anchor", "own.start", "own.n"),
        "texts",
    )
    cut = written(texts.mapInArrow(_cut(least), "anchor long, text_key binary, start int, bytes binary"), "cut")
    sizes = cut.groupBy("anchor").agg(F.sum(F.octet_length("bytes")).alias("size"))
    hot = written(sizes.filter(F.col("size") > HOT_BYTES).select("anchor"), "hot")
    total = cut.agg(F.sum(F.octet_length("bytes")).alias("n")).first().n or 0
    parts = max(1, math.ceil(total / PART_BYTES))
    any_hot = hot.limit(1).count() > 0
    usual = cut.join(hot, "anchor", "left_anti") if any_hot else cut
    spans = (
        usual.withColumn("part", F.pmod(F.xxhash64("anchor"), F.lit(parts)).cast("int"))
        .groupBy("part")
        .applyInArrow(_part(least), "text_key binary, spans array<int>")
    )
    if any_hot:
        spans = spans.unionByName(_expanded(cut.join(hot, "anchor", "left_semi"), least))
    by_text = written(spans.groupBy("text_key").agg(F.collect_list("spans").alias("spans")), "spans")  # bounded by the text
    dropped(again, cut, hot)
    changed = (
        texts.select("text_key", "text")
        .join(by_text, "text_key")
        .mapInArrow(
            _result, "text_key binary, n_removed long, kept_sha256 string, spans array<struct<start:int,end:int>>"
        )
    )
    # a written table lets Spark split the partition of a text that very many rows share
    known = written(copies.select("text_key", "copies").join(changed, "text_key", "left"), "known")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= least)
    none = F.array().cast("array<struct<start:int,end:int>>")
    all_of_it = F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("end")))
    narrow = keyed.select("doc_id", "text_key", "n_bytes", F.sha2("text", 256).alias("sha"))
    return narrow.join(known, "text_key").select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, all_of_it).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
