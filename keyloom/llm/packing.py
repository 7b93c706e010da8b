"""Best-fit packing of token sequences by linear grouping.

Documents become pieces of at most `capacity` tokens. How pieces are packed depends on their lengths
alone, so the driver gets a histogram of at most `capacity` lengths, whatever the size of the corpus, and
plans on runs of equal bins:

1. long pieces, in descending order, are cut into groups of equal cardinality and rounded up to the
   longest of their group, which leaves few sizes;
2. configurations of these few sizes are found one after the other: each holds the longest size left
   and the fullest completion by a knapsack recursion, and is used as often as the supply lasts;
3. actual pieces take the places of their group, from which every run of bins gets its true gap;
4. short pieces, longest first, go into the smallest gap that holds them, or into new bins.

Several numbers of groups and bounds of what is short are tried and the fewest bins win. The plan says, for each length, which
bins the pieces of a range of ranks go to; ranks come from windows over (length, salt), so a
length that a third of all pieces have is spread over many tasks.
"""

from __future__ import annotations

import json
import math
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.stage import give_back, lean, written

CAPACITY = 2048
ROWS_PER_SALT = 250_000
LEAST_SALTS = 32
#: Column of random numbers, drawn once when pieces are written.
LOT = "_lot"
#: How byte-level BPE cuts a text before it merges.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters above which ids are held as an array from the start.
LONG_TEXT = 1_000_000
#: A batch of token ids that a task hands back, in bytes.
OUT_BYTES = 4_000_000


@lru_cache(maxsize=2)
def encoder(path: str):
    """The byte-level BPE of a tokenizers file, as an encoder that gives the same ids several times faster.

    The file's vocabulary is in merge order, so that ids are ranks; its 256 byte symbols stand for bytes as
    printable characters, the others shifted past 255. Its added tokens are the encoder's special tokens.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    vocabulary, added = file["model"]["vocab"], file.get("added_tokens") or []
    odd = [t["content"] for t in added if t.get("single_word") or t.get("lstrip") or t.get("rstrip")]
    if odd:
        raise ValueError(f"added tokens that take in or ask for what is beside them: {odd}")
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain}
    shown |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    ranks = {bytes(shown[c] for c in token): i for token, i in vocabulary.items() if all(c in shown for c in token)}
    special = {token for token in vocabulary if token.startswith("<|") and token.endswith("|>")}
    ranks = {token: i for token, i in ranks.items() if token.decode("latin-1") not in special}
    special_tokens = {t["content"]: t["id"] for t in added}
    del file, vocabulary, added
    made = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special_tokens)
    give_back()
    return made


def tokenise(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = 0, added: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids): each document's token ids and then `end`, cut into pieces.

    ids: little-endian unsigned 32-bit ids as bytes. Documents longer than `capacity` are cut into pieces
    of `capacity`, of which the first may be shorter. A null text counts as empty: one piece of one id.
    Null ids and repeated rows are kept; other columns are not read. Where a text contains an added token of
    the file, such as <|endoftext|>, it becomes that token's id if `added`, as tokenizers does by default,
    and is spelt out in ordinary pieces else, as with tokenizers' encode_special_tokens.
    """
    allowed = "all" if added else set()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                plain = text.as_py() or ""
                long = len(plain) > LONG_TEXT
                if long:
                    tokens = code.encode_to_numpy(plain, allowed_special=allowed, disallowed_special=())
                else:
                    tokens = np.array(code.encode(plain, allowed_special=allowed, disallowed_special=()), "<u4")
                n, raw = len(tokens) + 1, tokens.astype("<u4", copy=False).tobytes() + end.to_bytes(4, "little")
                cuts = [0, *range(n % capacity or capacity, n, capacity), n]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((doc_id.as_py(), i, a, b - a, raw[4 * a : 4 * b]))
                held += len(raw)
                if held > OUT_BYTES:
                    yield out(rows)
                    rows, held = [], 0
            if rows:
                yield out(rows)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        names = ["doc_id", "piece", "start", "length", "ids"]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names
        )

    narrow = docs.select(F.col("doc_id").cast("long"), "text")
    return narrow.mapInArrow(lean(run), "doc_id long, piece int, start long, length long, ids binary")


# ---- the plan, on runs of bins ----


class Runs:
    """Bins in runs: a run is `count` bins alike, with the same gap and the same lengths at the same places.

    items: (length, first rank); bin i of the run holds the pieces of rank first + i.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_gap: dict[int, list] = defaultdict(list)

    def add(self, count: int, gap: int, items: tuple) -> None:
        if count:
            self.by_gap[gap].append((count, items))

    def place(self, length: int, count: int, first: int) -> None:
        """Best fit of `count` pieces of one length."""
        for gap in range(length, self.capacity + 1):
            runs = self.by_gap.get(gap)
            while runs and count:
                have, items = runs.pop()
                each = gap // length
                bins = min(have, count // each)
                if not bins:
                    each, bins = count, 1
                if bins < have:
                    self.add(have - bins, gap, tuple((n, at + bins) for n, at in items))
                self.add(bins, gap - each * length, items + tuple((length, first + j * bins) for j in range(each)))
                first, count = first + each * bins, count - each * bins
            if not count:
                return
        each = self.capacity // length
        for bins, size in ((count // each, each), (1, count % each)):
            if bins and size:
                self.add(bins, self.capacity - size * length, tuple((length, first + j * bins) for j in range(size)))
                first += size * bins

    def bins(self) -> int:
        return sum(count for runs in self.by_gap.values() for count, _ in runs)

    def rows(self) -> list[tuple]:
        """(length, from rank, to rank, sequence of the first, offset)."""
        out, base = [], 0
        for gap in sorted(self.by_gap):
            for count, items in self.by_gap[gap]:
                at = 0
                for length, first in items:
                    out.append((length, first, first + count, base, at))
                    at += length
                base += count
        return out


def grouped(lengths: list[tuple[int, int]], groups: int) -> list[tuple[int, list[list[int]]]]:
    """Linear grouping of (length, count) in descending order: (rounded size, [[length, first rank, count]])."""
    total = sum(n for _, n in lengths)
    each = math.ceil(total / groups)
    out: list[tuple[int, list[list[int]]]] = []
    room = 0
    for length, n in lengths:
        first = 0
        while n:
            if not room:
                out.append((length, []))
                room = each
            take = min(n, room)
            out[-1][1].append([length, first, take])
            first, n, room = first + take, n - take, room - take
    return out


def fullest(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """How often each size is used in the fullest configuration that holds the first size left."""
    use = [0] * len(sizes)
    head = next(i for i, n in enumerate(left) if n)
    use[head] = 1
    room = capacity - sizes[head]
    best = np.full(room + 1, -1, np.int64)  # the size last added to reach a sum
    copies = np.zeros(room + 1, np.int64)
    best[0] = len(sizes)
    for i in range(head, len(sizes)):
        supply, size = left[i] - use[i], sizes[i]
        for again in range(min(supply, room // size)):
            reached = best[: room + 1 - size]
            ok = (reached >= 0) & (best[size:] < 0) & ((copies[: room + 1 - size] == again) if again else (reached != i))
            best[size:][ok] = i
            copies[size:][ok] = again + 1
            if not ok.any():
                break
    at = int(np.nonzero(best >= 0)[0].max())
    while at:
        use[int(best[at])] += 1
        at -= sizes[int(best[at])]
    return use


def take(runs: list[list[int]], n: int) -> list[tuple[int, int, int]]:
    """The next n pieces of a group as (length, first rank, count)."""
    out = []
    while n:
        length, first, have = runs[0]
        got = min(n, have)
        out.append((length, first, got))
        n -= got
        if got == have:
            runs.pop(0)
        else:
            runs[0] = [length, first + got, have - got]
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = 48, short: float = 0.125) -> Runs:
    """The bins for pieces of the given lengths."""
    bins = Runs(capacity)
    bins.add(histogram.get(capacity, 0), 0, ((capacity, 0),))
    lengths = sorted(((n, c) for n, c in histogram.items() if n < capacity and c), reverse=True)
    long = [x for x in lengths if x[0] > short * capacity]
    parts = grouped(long, groups) if long else []
    sizes, left = [s for s, _ in parts], [sum(r[2] for r in runs) for _, runs in parts]
    while any(left):
        use = fullest(sizes, left, capacity)
        times = min(n // u for n, u in zip(left, use, strict=True) if u)
        slots = [take(parts[i][1], times) for i, u in enumerate(use) for _ in range(u)]
        left = [n - u * times for n, u in zip(left, use, strict=True)]
        cuts = sorted({0, *(int(c) for s in slots for c in np.cumsum([x[2] for x in s]))})
        for a, b in zip(cuts, cuts[1:], strict=False):
            items = []
            for slot in slots:
                upto = 0
                for length, first, n in slot:
                    if upto <= a < upto + n:
                        items.append((length, first + a - upto))
                    upto += n
            bins.add(b - a, capacity - sum(n for n, _ in items), tuple(items))
    for length, n in lengths:
        if length <= short * capacity:
            bins.place(length, n, 0)
    return bins


def best_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Runs:
    """The plan with the fewest bins over several groupings; ends early at the lower bound."""
    least = math.ceil(sum(n * c for n, c in histogram.items()) / capacity)
    best = None
    for groups, short in ((400, 0.125), (1000, 0.125), (1000, 0.25), (1000, 0.5), (96, 0.125)):
        found = plan(histogram, capacity, groups, short)
        if best is None or found.bins() < best.bins():
            best = found
        if best.bins() <= least:
            break
    return best


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` (length from 1 to capacity, any other columns) with sequence_id and offset.

    The pieces of a sequence stand side by side without gaps from 0 on, at most `capacity` long in all. Ties
    are broken by a hash of the whole row: reruns agree; repeated rows have places of their own. No
    pieces give no rows. The table should be a written one, as it is read several times; a column LOT of random numbers in
    it, which is left out of the result, deals rows that are repeated very often over several tasks.
    """
    spark = pieces.sparkSession
    columns = [c for c in pieces.columns if c != LOT]
    n = pieces.count()
    salts = max(LEAST_SALTS, math.ceil(n / ROWS_PER_SALT))
    lot = F.col(LOT) if LOT in pieces.columns else F.lit(0)
    rows = pieces.select(F.struct(*columns).alias("row"), F.col("length").alias("len"), F.xxhash64(*columns).alias("hash"), lot.alias("lot"))
    # rows of one hash would have one salt: those of more than a salt's share are alike, so it doesn't matter which goes where
    repeated = rows.groupBy("hash").agg(F.count("*").alias("times")).filter(F.col("times") > n // salts).select("hash")  # `salts` rows at most
    rows = rows.join(F.broadcast(repeated.withColumn("again", F.lit(1))), "hash", "left")
    salt = F.col("hash") + F.when(F.col("again").isNotNull(), F.col("lot")).otherwise(0)
    rows = rows.withColumn("salt", F.pmod(salt, F.lit(salts)).cast("int")).select("row", "len", "hash", "salt")
    counts = rows.groupBy("len", "salt").agg(F.count("*").alias("n"))
    histogram = {r.len: r.n for r in counts.groupBy("len").agg(F.sum("n").alias("n")).collect()}  # `capacity` rows
    if any(not 0 < x <= capacity for x in histogram):
        raise ValueError(f"a piece must have 1 to {capacity} tokens")
    upto = Window.partitionBy("len").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("len", "salt", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("skip"))
    found = best_plan(histogram, capacity).rows() if histogram else []
    bins = spark.createDataFrame(found, "len long, low long, high long, base long, offset long")
    order = Window.partitionBy("len", "salt").orderBy("hash")
    ranked = (
        rows.withColumn("nth", F.row_number().over(order) - 1)
        .join(counts, ["len", "salt"])
        .withColumn("rank", F.col("nth") + F.col("skip"))
    )
    here = (ranked["len"] == bins["len"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    return ranked.join(F.broadcast(bins), here).select(  # bounded by the number of lengths, not of pieces
        *(F.col(f"row.{c}").alias(c) for c in columns),
        (F.col("base") + F.col("rank") - F.col("low")).alias("sequence_id"),
        "offset",
    )


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): packed pieces with their ids, put together; a sequence is bounded by `capacity`."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    return parts.select("sequence_id", joined.alias("ids"))


def packed_digests(docs: DataFrame, path: str, capacity: int = CAPACITY, added: bool = False) -> DataFrame:
    """Pieces with the CRC-32 of their ids instead of these, packed."""
    pieces = tokenise(docs, path, capacity, added=added).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(written(pieces.withColumn(LOT, F.floor(F.rand(1) * (1 << 30)).cast("int")), "pieces"), capacity)
