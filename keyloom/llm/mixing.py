"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents are dealt by their hash into blocks, disjoint random subsets of nearly equal
size. A target in words becomes an exact quota of blocks: whole passes over the source, then blocks in
a random order, of which the last is used in part. A binary tree over the output shards then splits
the quotas of all sources: at every node the left half draws its number of blocks from those of the node
without replacement, by a random order of them, so what it gets of each source is a multivariate
hypergeometric draw and every shard has an exact, random composition. Each shard then takes the next
blocks of every source in their permuted order, and rows are shuffled within their shard. What the mix takes
of a document is the sum of what the shards take.

Only the rows of the few blocks that are used in part are ordered and cumulated; all other rows follow from
their block, so no text is shuffled before the shards are put together. The driver holds one row for each
source and each block. Both are bounded: by MAX_SOURCES, a mix being a stated list of weights, and by
MAX_BLOCKS. Documents are never moved by source: they are dealt over blocks, so a source that holds
a third of all rows is spread over a third of the blocks. Only DataFrame functions touch the documents.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.stage import literal_table, written

MAX_SOURCES = 100_000
#: Blocks of a mix: at least and at most, and rows that a block should hold in between.
LEAST_BLOCKS = 4096
MAX_BLOCKS = 500_000
ROWS_PER_BLOCK = 250_000
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The number of runs of characters other than space and \\t to \\r; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_level(sizes: Sequence[int], weights: Sequence[float], volume: float, cap: float) -> list[float]:
    """Targets that share volume * sum(sizes) by weight, none above cap * its size; excess is reshared by weight."""
    caps = [float(cap * x) for x in sizes]
    budget, spent, weight = volume * float(sum(sizes)), 0.0, float(sum(weights))
    level = float("inf")
    for i in sorted(range(len(sizes)), key=lambda i: (caps[i] / weights[i], i)):
        level = (budget - spent) / weight
        if caps[i] / weights[i] >= level:
            break
        spent, weight, level = spent + caps[i], weight - weights[i], float("inf")
    return [min(c, level * w) for c, w in zip(caps, weights, strict=True)]


def _order(seed: int, *parts: int) -> str:
    return hashlib.md5(":".join(map(str, (seed, *parts))).encode()).hexdigest()


def splitting_tree(tickets: Sequence[tuple[int, ...]], shards: int, seed: int) -> list[Counter]:
    """For every shard its quota of each source; tickets (source, ...), one for each block.

    A node draws the tickets of its left half from its own without replacement; shard i of n is due
    every n-th ticket from the i-th on, so sizes of shards differ by one at most.
    """
    due = [(len(tickets) + shards - 1 - i) // shards for i in range(shards)]
    out: list[Counter] = [Counter()] * shards

    def node(left: int, right: int, have: list, level: int) -> None:
        if right - left == 1:
            out[left] = Counter(t[0] for t in have)
            return
        middle = (left + right) // 2
        size = sum(due[left:middle])
        drawn = sorted(have, key=lambda t: _order(seed, level, *t))
        node(left, middle, drawn[:size], level + 1)
        node(middle, right, drawn[size:], level + 1)

    node(0, shards, list(tickets), 2)
    return out


def _draw(blocks: list, quotas: list[int], shards: int, seed: int) -> list[dict]:
    """Which part of each block is used in each of two passes, and the shard that gets it."""
    by_source = defaultdict(list)
    for b in blocks:
        by_source[b.source_no].append((b.block, b.size))
    drawn: dict[int, list] = {}
    for s, own in by_source.items():
        size = sum(x for _, x in own)
        drawn[s] = []
        for turn, left in enumerate((min(quotas[s], size), max(quotas[s] - size, 0))):
            for block, n in sorted(own, key=lambda x: _order(seed, turn, s, x[0])):
                if left > 0 and n > 0:
                    drawn[s].append((turn, block, n, min(left, n)))
                    left -= n
    tickets = [(s, turn, block) for s, parts in drawn.items() for turn, block, _, _ in parts]
    given = dict.fromkeys(drawn, 0)
    rows: dict[tuple[int, int], dict] = {}
    for shard, quota in enumerate(splitting_tree(tickets, shards, seed)):
        for s, n_blocks in quota.items():
            first = given[s]
            given[s] += n_blocks
            for turn, block, size, n in drawn[s][first : given[s]]:
                row = rows.setdefault((s, block), {"source_no": s, "block": block, "partial": False})
                row |= {f"quota{turn}": n, f"shard{turn}": shard}
                row["partial"] |= n < size
    return list(rows.values())


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    *,
    volume: float = 1.5,
    cap: float = 2,
    shards: int = 16,
    seed: int = 1,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Every document with its part in the mix.

    Sources in code point order, null last, have the given weights in turn. Returns doc_id, size
    (words), source_size, target (both of the document's source), taken (words that the mix takes),
    copies (an array of (shard, words, shuffle), one for each of at most two passes; `words` under
    `size` means that the document is cut there, which meets each target exactly and happens to at
    most one document of a source and pass) and the columns named in `carry`.

    A null source is a source of its own. Null and empty texts have size 0 and no copies. Rows of one id, or
    of none, are told apart by their text: reruns agree on any order and partitioning of the rows. Repeated rows are documents of their own. An empty table gives no rows.
    Columns other than doc_id, text and source are read only if `carry` names them.
    """
    if not 1 <= cap <= 2:
        raise ValueError("at most two passes: cap must be from 1 to 2")
    spark = docs.sparkSession
    own = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))))
    number = lambda start: F.conv(F.substring("digest", start, 15), 16, 10).cast("long")
    narrow = written(
        docs.select(
            "doc_id", "source", words(F.col("text")).alias("size"), F.md5(own).alias("digest"),
            F.struct(*carry).alias("carried") if carry else F.lit(None).cast("int").alias("carried"),
        ).select("doc_id", "source", "size", number(1).alias("deal"), number(17).alias("place"), "carried"),
        "mix",
    )
    found = narrow.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources: group them before mixing")
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r["size"] for r in found]
    total = max(sum(sizes), 1)
    blocks = min(MAX_BLOCKS, max(LEAST_BLOCKS, math.ceil(sum(r.n for r in found) / ROWS_PER_BLOCK)))
    targets = water_level(sizes, [weights[i % len(weights)] for i in range(len(sizes))], volume, cap)
    sources = literal_table(
        spark,
        [
            {"source": r.source, "source_no": i, "source_size": n, "target": t, "n_blocks": max(1, blocks * n // total)}
            for i, (r, n, t) in enumerate(zip(found, sizes, targets, strict=True))
        ],
        "source string, source_no int, source_size bigint, target double, n_blocks bigint",
    ).withColumnRenamed("source", "named")
    dealt = (
        narrow.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("named")))  # at most MAX_SOURCES rows
        .withColumn("block", F.col("deal") % F.col("n_blocks"))
        .drop("named", "source", "n_blocks", "deal")
    )
    table = dealt.groupBy("source_no", "block").agg(F.sum("size").alias("size")).collect()  # MAX_BLOCKS + sources at most
    plan = written(
        literal_table(
            spark,
            _draw(table, [int(t + 0.5) for t in targets], shards, seed),
            "source_no int, block bigint, partial boolean, quota0 bigint, shard0 int, quota1 bigint, shard1 int",
        ),
        "blocks",
    )
    put = dealt.join(F.broadcast(plan), ["source_no", "block"], "left")  # one row for each block
    # rows alike in place, id and size are one text's, so only what is carried with them can differ
    order = Window.partitionBy("source_no", "block").orderBy("place", "doc_id", "size", F.xxhash64("carried"))
    before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    whole = put.filter(~F.coalesce("partial", F.lit(False))).withColumn("before", F.lit(0).cast("long"))
    part = put.filter("partial").withColumn("before", before)
    # a block that is used as a whole has its own size as quota, so each row takes all of its words
    room = lambda turn: F.coalesce(F.col(f"quota{turn}"), F.lit(0)) - F.col("before")
    copy = lambda turn: F.struct(
        F.col(f"shard{turn}").alias("shard"),
        F.least("size", F.greatest(F.lit(0), room(turn))).alias("words"),
        F.xxhash64("place", F.lit(seed), F.lit(turn)).alias("shuffle"),
    )
    copies = F.filter(F.array(copy(0), copy(1)), lambda c: c.words > 0)
    return (
        whole.unionByName(part)
        .withColumn("copies", copies)
        .select(
            "doc_id",
            "size",
            "source_size",
            "target",
            F.aggregate("copies", F.lit(0).cast("long"), lambda n, c: n + c.words).alias("taken"),
            "copies",
            *(F.col(f"carried.{c}").alias(c) for c in carry),
        )
    )


def emit(mixed: DataFrame, parts: int = 1) -> DataFrame:
    """One row for each copy, with its shard, words and part. A shard has `parts` parts of nearly equal size, ranges of
    `shuffle`; the rows of a part stand together in that order. No copies give no rows."""
    rows = mixed.select("*", F.explode("copies").alias("copy")).drop("copies")
    rows = rows.select("*", "copy.shard", "copy.words", "copy.shuffle").drop("copy")
    part = F.shiftrightunsigned("shuffle", 33) * parts
    rows = rows.withColumn("part", F.shiftright(part, 31).cast("int"))
    return rows.repartition("shard", "part").sortWithinPartitions("shard", "part", "shuffle")
