"""N-gram Jaccard self-join by chosen paths.

Documents are sets of word 5-grams. Rows with equal sets become one node. In each of RUNS runs every
node samples one token of its set by the least hash of the run, so that two nodes sample the same
token with the chance of their similarity. A bucket, all nodes on one path of sampled tokens, that is
too large is split again into CHILDREN paths, each by a token that no other path of the node uses, up to
MAX_DEPTH tokens. Buckets are compared by brute force: candidates by their paths and sizes first, then
exactly on their sets, as products of 0/1 matrices. A bucket that is still too large is compared in
pairs of blocks, exactly, so no cap drops anything.

A pair of similarity 0.8 is missed by one run with a chance of 0.2, of 0.24 where paths are two or three
tokens long; all paths being independent, and AGREE tokens being asked for, it is missed by all 12 with a
chance of 2.0e-7 to 2.3e-7 (`missed`). Every pair found is verified, so no false link appears.

Pairs are counted in the least path that both nodes share and nowhere else. Hence no table of pairs is
needed: a bucket returns for each node the number of its links and one edge to the root of its part of
the bucket. Sets are only built for nodes that have a candidate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.chunk_dedup import SPACE, document_key
from keyloom.llm.components import components
from keyloom.llm.stage import dropped, lean, written

WORDS = 5
THRESHOLD = 0.8
RUNS = 12
CHILDREN = 2
MAX_DEPTH = 3
#: Tokens of the paths of each depth after the first, one for every child of every path before.
FURTHER = tuple(RUNS * CHILDREN**depth for depth in range(1, MAX_DEPTH))
#: Nodes of a bucket above which it is split, and of a block of a larger bucket, and grams of a block.
LARGE = 2000
BLOCK = 1024
GRAMS = 1_000_000
#: A candidate must agree in this many of the RUNS sampled tokens; a pair of similarity 0.8 has fewer with a chance of 2e-7.
AGREE = 2
#: Columns of a 0/1 matrix made at once.
COLUMNS = 8192

_BYTE = np.array([xxhash.xxh3_64_intdigest(bytes([b]), seed=11) | 1 for b in range(256)], np.uint64)
_ODD = lambda n, seed: np.array([xxhash.xxh3_64_intdigest(bytes([i]), seed=seed) | 1 for i in range(n)], np.uint64)
_PLACE, _RUN = _ODD(64, 12), _ODD(RUNS + sum(FURTHER), 13)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def gram_set(raw: bytes, width: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's word n-grams; fewer words than `width` are one gram, none are no gram."""
    data = np.frombuffer(raw, np.uint8)
    inside = np.r_[True, SPACE[data], True]
    starts, ends = np.nonzero(inside[:-1] & ~inside[1:])[0], np.nonzero(~inside[:-1] & inside[1:])[0]
    if not len(starts):
        return np.zeros(0, np.uint64)
    upto = np.r_[np.uint64(0), np.cumsum(_BYTE[data] * _powers(_BASE, len(data)), dtype=np.uint64)]
    word = mixed((upto[ends] - upto[starts]) * _powers(_INVERSE, len(data))[starts] + (ends - starts).astype(np.uint64))
    n = min(width, len(word))
    gram = np.zeros(len(word) - n + 1, np.uint64)
    for i in range(n):
        gram += word[i : len(word) - n + 1 + i] * _PLACE[i]
    return np.unique(mixed(gram + np.uint64(n)))


def sampled(grams: np.ndarray) -> np.ndarray:
    """32 bits of the token that each path samples: those of the runs, then those of each depth. Tokens that agree by
    chance put nodes in one bucket, where they are compared exactly."""
    if not len(grams):
        return np.zeros(len(_RUN), np.int32)
    least = np.array([(grams * r).min() for r in _RUN], np.uint64)
    return (mixed(least) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def missed(similarity: float, depth: int) -> float:
    """The chance that a pair is not found where all its buckets are `depth` tokens deep."""
    met = 1.0
    for _ in range(depth - 1):
        met = 1 - (1 - similarity * met) ** CHILDREN
    chance = lambda k: math.comb(RUNS, k) * similarity**k * (1 - similarity) ** (RUNS - k)
    return sum(chance(k) * (1.0 if k < AGREE else (1 - met) ** k) for k in range(RUNS + 1))


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[bytes]:
    for text in batch.column(column):
        yield text.as_buffer().to_pybytes() if text.is_valid else b""


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, sizes, tokens = [], [], []
        for raw in _texts(batch, 3):
            grams = gram_set(raw)
            nodes.append(xxhash.xxh3_128_digest(grams.tobytes()))
            sizes.append(len(grams))
            tokens.append(sampled(grams))
        both = np.stack(tokens) if tokens else np.zeros((0, len(_RUN)), np.int32)
        lists = lambda part: pa.ListArray.from_arrays(
            pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1]), pa.array(part.ravel())
        )
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(3)), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()),
             lists(both[:, :RUNS]), lists(both[:, RUNS:])],
            ["doc_id", "key", "hash", "node", "n", "tokens", "more"],
        )


def _gram_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text) -> (node, grams), where the text really is of that node."""
    for batch in batches:
        rows: list[tuple] = []
        for node, raw in zip(batch.column(0).to_pylist(), _texts(batch, 1), strict=True):
            grams = gram_set(raw).tobytes()
            if xxhash.xxh3_128_digest(grams) == node:
                rows.append((node, grams))
            if sum(len(g) for _, g in rows[-1:]) > 1 << 20 or len(rows) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows, strict=True)], ["node", "grams"])
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows, strict=True)], ["node", "grams"])


def _shared(codes: list[np.ndarray], weights: np.ndarray | None = None) -> np.ndarray:
    """How many values each two of the given arrays of distinct values have in common."""
    m = len(codes)
    out = np.zeros((m, m), np.float32)
    if not m:
        return out
    row = np.repeat(np.arange(m), [len(c) for c in codes])
    _, column, times = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
    new = np.cumsum(times > 1) - 1
    keep = times[column] > 1
    row, column = row[keep], new[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (at, at + COLUMNS))
        part = np.zeros((m, COLUMNS), np.float32)
        part[row[a:b], column[a:b] - at] = 1
        out += part @ part.T
    return out


def _lists(table: pa.Table, name: str) -> list[np.ndarray]:
    column = table.column(name).combine_chunks()
    flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]


def _candidates(table: pa.Table) -> np.ndarray:
    """Which pairs of a group this bucket is to count: by blocks, sizes and the least common path."""
    n = table.column("n").to_numpy().astype(np.float64)
    block, i, j = table.column("block").to_numpy(), table.column("i")[0].as_py(), table.column("j")[0].as_py()
    path = table.column("path")[0].as_py()
    ok = np.minimum(n[:, None], n[None, :]) >= THRESHOLD * np.maximum(n[:, None], n[None, :]) - 1e-9
    ok &= (block[:, None] == i) & (block[None, :] == j)
    if i == j:
        ok &= np.triu(np.ones(ok.shape, bool), 1)
    return ok & (_shared([p[p < path] for p in _lists(table, "paths")]) == 0)


COLUMNS_OF_SKETCH = "doc_id long, key long, hash long, node binary, n int, tokens array<int>, more array<int>"
NEED = pa.schema([("node", pa.binary()), ("path", pa.int64()), ("i", pa.int32()), ("j", pa.int32())])


def _need(table: pa.Table) -> pa.Table:
    """The nodes of a group that have a candidate partner in it."""
    ok = _candidates(table)
    tokens = np.stack(_lists(table, "tokens"))
    r, c = np.nonzero(ok)
    hit = np.zeros(len(ok), bool)
    for at in range(0, len(r), 1 << 18):
        a, b = r[at : at + (1 << 18)], c[at : at + (1 << 18)]
        agree = (tokens[a] == tokens[b]).sum(axis=1) >= AGREE
        hit[a[agree]] = hit[b[agree]] = True
    return table.select(NEED.names).filter(pa.array(hit)).cast(NEED)


FOUND = pa.schema([("node", pa.binary()), ("links", pa.int64()), ("root", pa.binary())])


def _verify(table: pa.Table) -> pa.Table:
    """Links of each node within a group, and the least node that they lead to."""
    ok = _candidates(table)
    n = table.column("n").to_numpy().astype(np.float64)
    sets = [np.frombuffer(g.as_py(), np.uint64) for g in table.column("grams")]
    both = _shared(sets).astype(np.float64)
    # both / (n1 + n2 - both) >= 4/5, in whole numbers
    ok &= both * 9 >= 4 * (n[:, None] + n[None, :])
    copies = table.column("copies").to_numpy()
    links = ok @ copies + ok.T @ copies
    nodes = table.column("node").to_pylist()
    by_name = sorted(range(len(nodes)), key=nodes.__getitem__)
    rank = np.empty(len(nodes), np.int64)
    rank[by_name] = np.arange(len(nodes))
    near = ok | ok.T
    while True:
        least = np.minimum(rank, np.where(near, rank[None, :], len(nodes)).min(axis=1, initial=len(nodes)))
        if (least == rank).all():
            break
        rank = least
    keep = np.nonzero(links)[0]
    return pa.table(
        [[nodes[k] for k in keep], links[keep].astype(np.int64), [nodes[by_name[rank[k]]] for k in keep]], schema=FOUND
    )


def _with_counts(rows: DataFrame) -> DataFrame:
    """Rows whose path is shared, with the number of nodes on it and of their grams."""
    sums = rows.groupBy("path").agg(F.count("*").alias("count"), F.sum("n").alias("volume"))
    shared = written(sums.filter(F.col("count") > 1), "paths")
    return rows.join(shared, "path")


def _texts_of(some: DataFrame, nodes: DataFrame, keyed: DataFrame) -> DataFrame:
    """(node, text): texts of the ids that stand for the nodes of `some`; a text of another node can be among them."""
    reps = some.select("node").distinct().join(nodes.select("node", "key"), "node")
    return keyed.select("key", "text").join(reps, "key").select("node", "text")


def _buckets(nodes: DataFrame) -> DataFrame:
    """(node, path, count, volume): every bucket that holds two nodes or more."""
    first = nodes.select("node", "n", F.posexplode("tokens").alias("run", "token"))
    rows = written(_with_counts(first.select("node", "n", "run", F.xxhash64("run", "token").alias("path"))), "buckets")
    out, tokens = [], None
    for depth in range(1, MAX_DEPTH + 1):
        large = rows.filter(F.col("count") > LARGE)
        if depth == MAX_DEPTH or not large.limit(1).count():
            out.append(rows)
            break
        out.append(rows.filter(F.col("count") <= LARGE))
        if tokens is None:  # of the nodes of large buckets only; what is split later are some of these
            tokens = written(nodes.select("node", "more").join(large.select("node").distinct(), "node", "left_semi"), "further")
        base = F.lit(sum(FURTHER[: depth - 1]))
        child = lambda c: F.col("run") * CHILDREN + c
        paths = (F.struct(child(c).alias("run"), F.xxhash64("path", F.lit(c), F.get("more", base + child(c))).alias("path")) for c in range(CHILDREN))
        split = large.join(tokens, "node").select("node", "n", F.explode(F.array(*paths)).alias("new")).select("node", "n", "new.*")
        rows = written(_with_counts(split), "buckets")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found.select("node", "path", "count", "volume")


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Rows of a bucket over BLOCK nodes or GRAMS grams go to every pair (i, j) of blocks, i <= j, that their block is in."""
    blocks = F.greatest(F.ceil(F.col("count") / F.lit(BLOCK)), F.ceil(F.col("volume") / F.lit(GRAMS)), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda k: F.struct(F.least(k, "block").alias("i"), F.greatest(k, "block").alias("j")),
    )
    return (
        rows.withColumn("blocks", blocks)
        .withColumn("block", own)
        .withColumn("pair", F.explode(pairs))
        .select("*", "pair.i", "pair.j")
        .drop("pair", "blocks", "count", "volume")
    )


def similar(docs: DataFrame) -> DataFrame:
    """(doc_id, key, hash, class_id, links), one row per row of `docs` (doc_id, text).

    key is the doc_id or its stand-in (document_key) and hash the xxhash64 of the text, by which a row is found again.
    Two documents are linked if the Jaccard similarity of their sets of five-word grams is 0.8 or more;
    links counts the other rows that a row is linked to, class_id is the least doc_id of all that links
    lead to. Words are separated by ASCII white space and not folded. A text of one to four words is one
    gram; texts without words (null, empty) are alike and one class. A null doc_id is kept; in a class it
    comes after all other ids and is replaced by a number made from the text where a class has no other.
    Repeated rows are documents of their own. An empty table gives no rows; other columns are not read.
    """
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), document_key().alias("key"), F.xxhash64("text").alias("hash"), "text"
    )
    sketches = written(
        keyed.mapInArrow(lean(_sketch), COLUMNS_OF_SKETCH), "sketches"
    )
    nodes = written(
        sketches.groupBy("node").agg(
            F.min("key").alias("key"),
            F.count("*").alias("copies"),
            F.first("n").alias("n"),
            F.first("tokens").alias("tokens"),
            F.first("more").alias("more"),
        ),
        "nodes",
    )
    rows = _buckets(nodes)
    paths = rows.groupBy("node").agg(F.array_sort(F.collect_set("path")).alias("paths"))  # some dozens for a node
    group = ["path", "i", "j"]
    known = rows.distinct().join(paths, "node").join(nodes.select("node", "key", "copies", "n", "tokens"), "node")
    known = written(_in_blocks(known), "known")
    need = written(
        known.drop("copies", "key").groupBy(*group).applyInArrow(_need, "node binary, path long, i int, j int"), "need"
    )
    sets = (
        _texts_of(need, nodes, keyed)
        .mapInArrow(lean(_gram_sets), "node binary, grams binary")
        .groupBy("node")
        .agg(F.first("grams").alias("grams"))
    )
    full = known.drop("tokens", "key").join(need, ["node", *group]).join(sets, "node")
    found = written(
        full.groupBy(*group).applyInArrow(_verify, "node binary, links long, root binary"), "found"
    )
    dropped(known, need)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    classes = nodes.select("node", "key", "copies").join(links, "node", "left").join(roots, "node", "left")
    classes = written(classes.withColumn("root", F.coalesce("root", "node")), "classes")
    # written tables on both sides let Spark split the partition of a class or node that very many rows share
    class_ids = written(classes.groupBy("root").agg(F.min("key").alias("class_id")), "class-ids")
    links = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")
    classes = written(classes.join(class_ids, "root").select("node", "class_id", links), "linked")
    return sketches.select("doc_id", "key", "hash", "node").join(classes, "node").select("doc_id", "key", "hash", "class_id", "links")
