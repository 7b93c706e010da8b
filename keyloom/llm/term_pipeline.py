"""Ranked lexical search by pipelined term partitioning.

One pass over the documents writes postings of the items' terms, by blocks of documents, with the counts that the
weights need. Terms are dealt to owners, the rarest to the first. A bundle of items then visits the owners
in turn: at each stage a bundle's sparse accumulators of a block meet the owner's postings of that block by
cogroup, integer contributions are added, and the accumulators travel on. A document is left behind only if
even the most that later owners can add keeps it below the k-th score of its own block, so it is in no result. After
the last owner each block gives the k best of an item, and these lists are merged in a tree.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm import grid
from keyloom.llm.stage import written

#: Stages of term owners that a bundle visits, items of a bundle, documents of a block.
OWNERS, BUNDLE, BLOCK = 4, 256, 2048
#: Bytes of the terms of items that are searched for in one pass; more items take more passes.
VOCABULARY = 16_000_000
#: Bytes of a text that become words at once.
PIECE = 4_000_000
#: What one term adds is less than its weight times this.
MOST = 1_000_000
#: Bytes of terms: digits, letters and all bytes above ASCII; A-Z fold, all other bytes part terms.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
POSTINGS = "block long, term int, docs long, words long, data binary"
STATE = "bundle int, block long, item int, docs binary, scores binary"
FOUND = "item int, doc_id long, score long, c long"


def counted(raw: bytes) -> Counter:
    """Terms of a text in UTF-8 and how often each occurs."""
    plain, found, at = raw.translate(FOLD), Counter(), 0
    while at < len(plain):
        cut = plain.find(b" ", at + PIECE) if len(plain) - at > PIECE else -1
        cut = len(plain) if cut < 0 else cut
        found.update(plain[at:cut].split())
        at = cut
    return found


def _index(vocabulary: dict[bytes, int]):
    """(doc_id, text) -> postings; the row of term -1 holds the block's ids, which of them are null, and lengths."""

    def posted(rows: list[tuple[int | None, bytes]], block: int) -> pa.RecordBatch:
        rows.sort(key=lambda r: (r[0] is None, r[0] or 0))
        lengths, lists = [], defaultdict(list)
        for at, (_, raw) in enumerate(rows):
            terms = counted(raw)
            lengths.append(sum(terms.values()))
            for term in terms.keys() & vocabulary.keys():
                lists[vocabulary[term]] += at, terms[term]
        ids = np.array([r[0] or 0 for r in rows], np.int64)
        null = np.array([r[0] is None for r in rows], bool)
        head = ids.tobytes() + np.array(lengths, np.int64).tobytes() + null.tobytes()
        data = [head, *(np.array(x, np.int64).astype(np.uint32).tobytes() for x in lists.values())]
        docs = [sum(n > 0 for n in lengths), *(len(x) // 2 for x in lists.values())]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([block] * len(data), pa.int64()),
                pa.array([-1, *lists], pa.int32()),
                pa.array(docs, pa.int64()),
                pa.array([sum(lengths)] + [0] * len(lists), pa.int64()),
                pa.array(data, pa.binary()),
            ],
            ["block", "term", "docs", "words", "data"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows, held = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                rows.append((doc, raw))
                held += len(raw)
                if len(rows) == BLOCK or held > 4 * PIECE:
                    yield posted(rows, block)
                    block, rows, held = block + 1, [], 0
        if rows:
            yield posted(rows, block)

    return run


def _stage(items: dict[int, dict[int, list[int]]], weight: dict[int, int], rest: dict[int, int], n: int, l: int, k: int, last: bool):  # noqa: E741
    """A visit of bundles to one owner. items: by bundle and term, the items that ask; rest: the most that later owners add to each."""

    def visit(left: pa.Table, right: pa.Table) -> pa.Table:
        bundle, block = left.column("bundle")[0].as_py(), left.column("block")[0].as_py()
        rows = list(zip(*(left.column(c).to_pylist() for c in ("item", "docs", "scores")), strict=True))
        head = next(docs for item, docs, _ in rows if item < 0)
        size = len(head) // 17
        ids, length = np.frombuffer(head[: 8 * size], np.int64), np.frombuffer(head[8 * size : 16 * size], np.int64)
        null = np.frombuffer(head[16 * size :], bool)
        m = np.array([10 + 90 * x * n // l for x in length.tolist()], np.int64)
        sums: dict[int, np.ndarray] = {}
        for item, docs, scores in rows:
            if item >= 0:
                sums[item] = np.zeros(size, np.int64)
                sums[item][np.frombuffer(docs, np.uint16)] = np.frombuffer(scores, np.int64)
        for term, data in zip(right.column("term").to_pylist(), right.column("data").to_pylist(), strict=True):
            at, tf = np.frombuffer(data, np.uint32).astype(np.int64).reshape(-1, 2).T
            part = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[at]))
            for item in items[bundle][term]:
                sums.setdefault(item, np.zeros(size, np.int64))[at] += part
        out = [] if last else [(-1, head, b"")]
        for item, score in sums.items():
            hit = np.nonzero(score > 0)[0]
            if len(hit) > k:
                hit = hit[score[hit] + rest.get(item, 0) >= np.partition(score[hit], -k)[-k]]
            if last:
                hit = hit[np.lexsort((hit, -score[hit]))[:k]]  # ids of a block ascend
            if len(hit):
                out.append((item, hit, score[hit]))
        if not last:
            packed = [(i, d if i < 0 else d.astype(np.uint16).tobytes(), s if i < 0 else s.tobytes()) for i, d, s in out]
            columns = list(zip(*packed, strict=True))
            return pa.table(
                [pa.array([bundle] * len(out), pa.int32()), pa.array([block] * len(out), pa.int64()), pa.array(columns[0], pa.int32()),
                 pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())],
                ["bundle", "block", "item", "docs", "scores"],
            )
        join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts]).astype(kind)
        at = join([d for _, d, _ in out], np.int64)
        return pa.table(
            [
                pa.array(np.repeat([i for i, _, _ in out], [len(d) for _, d, _ in out]).astype(np.int32)),
                pa.array(ids[at], mask=null[at]),
                pa.array(join([s for _, _, s in out], np.int64)),
                pa.array(np.full(len(at), block, np.int64)),
            ],
            ["item", "doc_id", "score", "c"],
        )

    return visit


def _rounds(items: DataFrame) -> Iterator[list[tuple[int | None, int, set[bytes]]]]:
    """(item_id, hash of the text, terms), in lists whose terms keep to VOCABULARY bytes, or one item each."""
    part, held = [], 0
    rows = items.select(F.col("item_id").cast("long"), F.xxhash64("text"), F.col("text").cast("binary"))
    for item, key, raw in rows.distinct().toLocalIterator():
        terms = set(counted(bytes(raw or b"")))
        size = sum(map(len, terms))
        if part and held + size > VOCABULARY:
            yield part
            part, held = [], 0
        if terms:
            part.append((item, key, terms))
            held += size
    if part:
        yield part


def _search(asked: list[tuple[int | None, int, set[bytes]]], docs: DataFrame, k: int, owners: int, bundle: int) -> DataFrame:
    """One pass for the items of one round."""
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*(terms for _, _, terms in asked))))}
    asked = sorted(asked, key=lambda a: (a[0] is None, a[0] or 0, a[1]))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    index = written(texts.mapInArrow(_index(vocabulary), POSTINGS), "postings")
    counts = index.groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words"), F.count("*").alias("blocks"))
    df = {r.term: r for r in counts.collect()}  # one row for each term of the round
    n, l, blocks = (df[-1].docs, df[-1].words, df[-1].blocks) if -1 in df else (0, 0, 0)  # noqa: E741
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * r.docs + 1))) for t, r in df.items() if t >= 0}
    falling = sorted(weight, key=lambda t: (-weight[t], t))
    owner = {t: i * owners // len(falling) for i, t in enumerate(falling)}

    askers: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
    later = [Counter() for _ in range(owners)]
    for i, (_, _, terms) in enumerate(asked):
        for t in (vocabulary[x] for x in terms):
            if t in owner:
                askers[i // bundle][t].append(i)
                for stage in range(owner[t]):
                    later[stage][i] += weight[t] * MOST
    items = {b: dict(x) for b, x in askers.items()}
    pairs = [(t, owner[t], b) for b, x in items.items() for t in x]
    wanted = spark.createDataFrame(pairs, "term int, owner int, bundle int")  # terms of at most VOCABULARY bytes in all
    sent = index.filter("term >= 0").join(F.broadcast(wanted), "term").select("bundle", "block", "owner", "term", "data")
    bundles = F.explode(F.array(*map(F.lit, sorted(items)))) if items else F.lit(0)
    state = index.filter("term < 0").select(bundles.alias("bundle"), F.col("block").alias("block"), F.lit(-1).alias("item"), F.col("data").alias("docs"), F.lit(b"").alias("scores"))
    state = state if items and l else state.limit(0)
    for stage in range(owners):
        last = stage == owners - 1
        visit = _stage(items, {t: w for t, w in weight.items() if owner[t] == stage}, dict(later[stage]), n, l, k, last)
        postings = sent.filter(F.col("owner") == stage).drop("owner")
        met = state.groupBy("bundle", "block").cogroup(postings.groupBy("bundle", "block"))
        state = met.applyInArrow(visit, FOUND if last else STATE)
    lists = state.select(F.col("item").alias("query_id"), F.lit(0).alias("query_key"), F.col("doc_id").alias("vec_id"), "score", "c")
    names = spark.createDataFrame([(i, a[0]) for i, a in enumerate(asked)], "query_id int, item_id long")
    best = grid.top_of(lists, blocks, k).join(F.broadcast(names), "query_id")
    return best.select("item_id", "rank", F.col("vec_id").alias("doc_id"), "score")


def search(items: DataFrame, docs: DataFrame, k: int = 10, *, owners: int = OWNERS, bundle: int = BUNDLE) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents of highest score above 0, ties to the smaller doc_id.

    items (item_id, text), docs (doc_id, text). Terms are maximal runs of ASCII digits and letters and of all
    characters above ASCII, A-Z lower-cased. A document scores w * (1000000000 * tf div (1000 * tf + 8 * m)) for each
    term of an item that it holds, m = 10 + 90 * n * N div L, w = floor(1000 * ln((2N + 2) / (2df + 1))): N documents
    with terms, n terms of the document, L of all. Null and empty texts have no terms, so items without terms have no rows.
    Equal items are one; different texts of one item_id are ranked each for itself. Documents of one id, and
    repeated ones, are documents of their own; a null doc_id comes after all others. Empty tables give no rows;
    other columns are not read.
    """
    rounds = [_search(asked, docs, k, owners, bundle) for asked in _rounds(items)]
    if not rounds:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, rounds)
