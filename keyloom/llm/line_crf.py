"""Quality by a linear-chain conditional random field over a document's lines.

Every line is labelled good or bad. Its features are shares of byte classes and of pairs of them, its
length, how far its words repeat, whether it repeats in the document, and the same of the lines before and
after it. The field has a weight per feature and one per transition and is trained by gradient ascent on documents whose lines
all carry the document's label. A document's score is the mean of its lines' marginal chances of being
good, from the forward-backward recursion, weighted by length.

Training uses a bounded sample of labelled documents on the driver (SAMPLE, by hash of the id). Where these
have too many lines in all, each gives as many as the least bound allows that keeps the sum within SAMPLE_LINES,
so a very long document takes no place of another; scoring
runs over all documents in Arrow batches with the weights, some hundred numbers, in the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.chunk_dedup import SPACE
from keyloom.llm.stage import give_back, lean, written

#: Labelled documents that a model is fitted on, at most.
SAMPLE = 4000
#: Lines of these documents, at most; never less than SAMPLE_LINES / SAMPLE of each.
SAMPLE_LINES = 200_000
#: The least score of a good document.
GOOD = 0.7
STEPS = 150
RATE = 0.1
PENALTY = 1e-4
#: Bytes of text worked on at once.
SLICE = 250_000


def _classes() -> np.ndarray:
    """The class of every byte value."""
    groups = [
        "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", ".,;:'\"-()?",
        "!", "|", "#%&*$@", "<>{}[]=/\\_~^`+", "\n",
    ]
    out = np.full(256, len(groups), np.int64)  # the rest: bytes of other letters, controls
    for i, group in enumerate(groups):
        out[[ord(c) for c in group]] = i
    return out


CLASS = _classes()
C = int(CLASS.max()) + 1
NEWLINE = 10
FEATURES = C * C + 3 * C + 7
_MARK = np.random.default_rng(5).integers(1, 1 << 62, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _repeats(data: np.ndarray, line: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For every line the share of words like the one before, and of words that stand in the line already."""
    word = ~SPACE[data]
    # texts stand end to end: a word ends with its line, so that no text changes the words of the next
    apart = ~(word[1:] & word[:-1] & (line[1:] == line[:-1]))
    starts = np.nonzero(word & np.r_[np.ones(min(1, len(data)), bool), apart])[0]
    ends = np.nonzero(word & np.r_[apart, np.ones(min(1, len(data)), bool)])[0] + 1
    if not len(starts):
        return np.zeros(n, np.float32), np.zeros(n, np.float32)
    of = line[starts]
    place = np.arange(len(data)) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(data)]))
    upto = np.r_[np.uint64(0), np.cumsum(_MARK[data] * (2 * place + 1).astype(np.uint64), dtype=np.uint64)]
    word = upto[ends] - upto[starts]
    total = np.maximum(np.bincount(of, minlength=n), 1)
    like = (word[1:] == word[:-1]) & (of[1:] == of[:-1])
    order = np.lexsort((word, of))
    seen = (word[order][1:] == word[order][:-1]) & (of[order][1:] == of[order][:-1])
    share = lambda hit, at: (np.bincount(at[1:][hit], minlength=n) / total).astype(np.float32)
    return share(like, of), share(seen, of[order])


def line_features(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts laid end to end (bytes, end of each) -> features and length of every line, lines of each text.

    A text has one line more than it has newlines, so that an empty text has one empty line.
    """
    starts = np.r_[0, ends[:-1]]
    breaks = np.nonzero(data == NEWLINE)[0]
    per_text = 1 + np.searchsorted(breaks, ends) - np.searchsorted(breaks, starts)
    text_of = np.repeat(np.arange(len(ends)), per_text)
    last = np.cumsum(per_text) - 1
    n = len(text_of)
    line_end = np.empty(n, np.int64)
    line_end[last] = ends
    inner = np.ones(n, bool)
    inner[last] = False
    line_end[inner] = breaks
    line_start = np.empty(n, np.int64)
    line_start[last - per_text + 1] = starts
    line_start[1:][inner[:-1]] = breaks + 1
    length = line_end - line_start

    kind = CLASS[data]
    line = np.repeat(np.arange(n), np.diff(np.r_[line_start, len(data)])) if n else np.zeros(0, np.int64)
    one = np.bincount(line * C + kind, minlength=n * C)[: n * C].reshape(n, C).astype(np.float32)
    one[:, CLASS[NEWLINE]] = 0
    same = line[1:] == line[:-1]
    two = np.bincount((line[1:] * C + kind[:-1])[same] * C + kind[1:][same], minlength=n * C * C)
    size = np.maximum(length, 1)[:, None].astype(np.float32)
    one /= size
    two = two.reshape(n, C * C).astype(np.float32) / size
    place = (2 * (np.arange(len(data)) - line_start[line]) + 1).astype(np.uint64)
    upto = np.r_[np.uint64(0), np.cumsum(_MARK[data] * place, dtype=np.uint64)]
    mark = upto[line_end] - upto[line_start]
    order = np.lexsort((mark, text_of))
    twin = (mark[order][1:] == mark[order][:-1]) & (text_of[order][1:] == text_of[order][:-1])
    again = np.zeros(n, np.float32)
    again[order[1:][twin]] = again[order[:-1][twin]] = 1
    again[length == 0] = 0
    around = np.zeros((n, 2 * C), np.float32)
    joined = text_of[1:] == text_of[:-1]
    around[1:, :C][joined] = one[:-1][joined]
    around[:-1, C:][joined] = one[1:][joined]
    twice, few = _repeats(data, line, n)
    log = np.log1p(length).astype(np.float32)[:, None] / 5
    rest = np.stack([np.ones(n, np.float32), again, length == 0, twice, few, few * few], axis=1).astype(np.float32)
    return np.concatenate([np.sqrt(two), one, np.sqrt(around), log, rest], axis=1), np.maximum(length, 1), per_text


@dataclass
class Field:
    weights: np.ndarray
    transition: np.ndarray  # from, to


def _steps(per_text: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """First line of each text, longest text first, and how many texts have a t-th line."""
    order = np.argsort(-per_text, kind="stable")
    first = (np.cumsum(per_text) - per_text)[order]
    longest = int(per_text.max(initial=0))
    alive = np.searchsorted(-per_text[order], -np.arange(longest), side="left").tolist()
    return first, alive


def marginals(score: np.ndarray, per_text: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Chance of good for every line, expected transitions, and the sum of the texts' log partition sums.

    score: log weight of good against bad for every line.
    """
    first, alive = _steps(per_text)
    a, b = np.zeros((len(score), 2)), np.zeros((len(score), 2))
    unary = np.stack([np.zeros(len(score)), score], axis=1)
    for t, n in enumerate(alive):
        at = first[:n] + t
        before = np.logaddexp.reduce(a[at - 1][:, :, None] + transition[None], axis=1) if t else 0.0
        a[at] = unary[at] + before
    for t in range(len(alive) - 1, 0, -1):
        at = first[: alive[t]] + t
        b[at - 1] = np.logaddexp.reduce(transition[None] + (unary[at] + b[at])[:, None, :], axis=2)
    total = np.logaddexp(a[:, 0] + b[:, 0], a[:, 1] + b[:, 1])
    good = np.exp(a[:, 1] + b[:, 1] - total)
    pairs = np.zeros((2, 2))
    inside = np.ones(len(score), bool)
    inside[np.cumsum(per_text) - per_text] = False
    at = np.nonzero(inside)[0]
    both = a[at - 1][:, :, None] + transition[None] + (unary[at] + b[at])[:, None, :] - total[at][:, None, None]
    pairs = np.exp(both).sum(axis=0)
    ends = np.cumsum(per_text) - 1
    return good, pairs, float(total[ends].sum())


def fit(features: np.ndarray, per_text: np.ndarray, label: np.ndarray) -> Field:
    """Gradient ascent (Adam) on the mean log likelihood per text with an L2 penalty."""
    y = np.repeat(label, per_text).astype(np.float64)
    texts = max(1, len(label))
    value = np.zeros(features.shape[1] + 4)
    m, v = np.zeros_like(value), np.zeros_like(value)
    moves = np.zeros((2, 2))
    for k in (0, 1):
        moves[k, k] = (per_text[label == k] - 1).sum()
    for step in range(1, STEPS + 1):
        w, transition = value[:-4], value[-4:].reshape(2, 2)
        good, pairs, _ = marginals(features @ w, per_text, transition)
        slope = np.r_[features.T @ (y - good), (moves - pairs).ravel()] / texts - PENALTY * value
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        value += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(value[:-4].astype(np.float32), value[-4:].reshape(2, 2))


def scores(field: Field, features: np.ndarray, length: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Length-weighted mean chance of good lines for every text."""
    good, _, _ = marginals((features @ field.weights).astype(np.float64), per_text, field.transition)
    at = np.cumsum(per_text) - per_text
    return np.clip(np.add.reduceat(good * length, at) / np.add.reduceat(length.astype(np.float64), at), 0, 1)


def _slices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A string column as (bytes, ends) of at most SLICE bytes or one text; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
        to = min(to, len(column))
        yield data[offsets[at] : offsets[to]], (offsets[at + 1 : to + 1] - offsets[at]).astype(np.int64)
        at = to


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, mod 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def line_bound(lines: list[int], total: int) -> int:
    """The most lines that each document may give so that all together give at most `total`; 1 at least."""
    left = total
    for n, size in enumerate(sorted(lines)):
        each = left // (len(lines) - n)
        if size > each:
            return max(1, each)
        left -= size
    return max(1, *lines) if lines else 1


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """A field fitted on at most `sample` labelled documents that are not held out, SAMPLE_LINES lines in all.

    docs (doc_id, text), labels (doc_id, quality 0/1). Null labels are left out; several labels of one id
    count by their mean. Rows of one id are one document, equal ones once. Every document of the sample takes
    part, one of very many lines with the lines that come first, in as many of its texts as the bound allows.
    Labels of other ids count for nothing. Without labels, or without documents, all weights are 0, so every score is 0.5; labels
    of which none is of a document that is not held out are an error.
    """
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    usable = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    # labels may cover far more than these documents: only those of a document can be drawn
    marked = (
        usable.join(docs.select("doc_id").filter("doc_id IS NOT NULL"), "doc_id", "left_semi")
        .groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
        .orderBy(*by_hash)
        .limit(sample)
    )
    labelled = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id")  # `sample` rows
    lines = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("\n")) + 1
    labelled = labelled.withColumn("hash", F.xxhash64("text"))
    texts = labelled.select("doc_id", "hash", lines.alias("lines")).groupBy("doc_id", "hash").agg(F.max("lines").alias("lines"))
    texts = written(texts, "sample")
    sizes = texts.groupBy("doc_id").agg(F.sum("lines").alias("lines"))
    most = line_bound([r.lines for r in sizes.select("lines").collect()], SAMPLE_LINES)  # `sample` rows
    before = Window.partitionBy("doc_id").orderBy("hash").rowsBetween(Window.unboundedPreceding, -1)
    room = F.lit(most) - F.coalesce(F.sum("lines").over(before), F.lit(0))
    fitting = texts.select("doc_id", "hash", F.least("lines", room).cast("int").alias("take")).filter("take > 0")
    chosen = labelled.join(F.broadcast(written(fitting, "sample")), ["doc_id", "hash"])  # SAMPLE_LINES rows
    chosen = chosen.groupBy("doc_id", "hash").agg(*(F.first(c).alias(c) for c in ("text", "label", "take")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for data, ends in _slices(batch.column(1)):
                x, _, per_text = line_features(data, ends)
                label = batch.column(2).slice(done, len(ends))
                ids = batch.column(0).slice(done, len(ends))
                take = batch.column(3).slice(done, len(ends)).to_pylist()
                done += len(ends)
                cut = np.cumsum(per_text)[:-1]
                raw = [p[:n].astype(np.float16).tobytes() for p, n in zip(np.split(x, cut), take, strict=True)]
                yield pa.RecordBatch.from_arrays([ids, label, pa.array(raw, pa.binary())], ["doc_id", "label", "x"])

    rows = chosen.select(F.col("doc_id").cast("long"), "text", "label", "take").mapInArrow(lean(run), "doc_id long, label int, x binary")
    got = sorted(rows.collect(), key=lambda r: (r.doc_id, bytes(r.x)))
    if not got:
        if usable.limit(1).count() and docs.limit(1).count():
            raise ValueError("no label is of a document that is not held out: a field of zeros would reject every document")
        return Field(np.zeros(FEATURES, np.float32), np.zeros((2, 2)))
    parts = [np.frombuffer(r.x, np.float16).reshape(-1, FEATURES) for r in got]
    label = np.array([r.label for r in got])
    return fit(np.concatenate(parts).astype(np.float32), np.array([len(p) for p in parts]), label)


def score(docs: DataFrame, field: Field) -> DataFrame:
    """All rows and columns of `docs` (text, ...) and `score` from 0 to 1.

    A null text counts as empty, which is one empty line. Repeated rows are scored alike. An empty table
    gives no rows. A column of `docs` named `score` is replaced.
    """

    @F.arrow_udf("double")
    def of(text: pa.Array) -> pa.Array:
        out = [scores(field, *line_features(data, ends)) for data, ends in _slices(text)]
        give_back()
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return docs.withColumn("score", of(F.col("text")))
