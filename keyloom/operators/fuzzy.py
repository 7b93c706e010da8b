"""Words within an edit distance of terms, and BM25 of a batch of queries whose terms stand for all such words.

Words near terms: two texts within one or two edits share what is left of either without that many letters. A task takes the
terms, hashes what is left of them and of its words, a whole column of words at once, and works out the distance of the pairs
that share a hash; long texts share a third of the term instead.

`scan` scores a batch that is given whole, without an index: near words times queries are never multiplied out. Of every piece
of documents it first adds up what each different term is worth in each document, over the words near it, and then the terms
of each query. A task keeps the k best of each query, and leaves out a query where its terms' highest worths in a piece do
not add up to the k-th score that the task has seen.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from keyloom.operators import postings

#: Letters up to which a term is met by what is left of it; longer ones by their thirds.
LONG = 24
#: Words and hashes that are compared at once, and the bits of a hash that are looked up first.
WORDS, HASHES, BITS = 100_000, 2_000_000, 24
_BASE, _LETTER = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_BACK = pow(_BASE, -1, 1 << 64)
#: Documents whose terms are counted at once.
DOCS = 1024
#: Worths (term, document) of a piece, its documents at most, near words of its postings that are added at once, queries at once.
WORTHS, WIDTH, ADDED, QUERIES = 4_000_000, 256, 200_000, 256
#: More than rounding to six places moves a score, and more than a sum of singles is off for each of its terms, as a share of it.
SLACK, ROUNDED = 1e-6, 2.0**-22


def allowed(length: int) -> int:
    """Edit distance that a term of this length may have."""
    return 0 if length <= 2 else 1 if length <= 5 else 2


def _by_length(texts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Length, and the places of the texts of this length."""
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    for size in np.unique(length).tolist():
        yield size, np.flatnonzero(length == size)


def _codes(texts: np.ndarray, size: int) -> np.ndarray:
    """The letters of texts of one size."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(texts), size)


def _distance(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Edit distance of pairs of texts, a row of letters each, whose sizes differ by two at most; 3 for all beyond 2."""
    one, other = np.ascontiguousarray(one.T), np.ascontiguousarray(other.T)
    n, m = len(one), len(other)
    far = np.full(one.shape[1], 3, np.int8)
    # by the difference of the places in both, from -2 to 2, and a column that is out of reach on either side
    at = [far, far, far, far * 0, far * 0 + 1, far * 0 + 2, far]
    for i in range(1, n + 1):
        new = [far] * 7
        for d in range(1, 6):
            j = i + d - 3
            if j == 0:
                new[d] = np.full_like(far, min(i, 3))
            elif 0 < j <= m:
                best = at[d] + (one[i - 1] != other[j - 1])
                np.minimum(best, at[d + 1] + 1, out=best)
                np.minimum(best, new[d - 1] + 1, out=best)
                new[d] = np.minimum(best, far, out=best)
        at = new
    return at[m - n + 3]


def _left(code: np.ndarray, most: int) -> np.ndarray:
    """Of texts of one size: a row of hashes of all that is left without up to `most` letters."""
    n, size = code.shape
    power = np.cumprod(np.r_[np.uint64(1), np.full(max(0, size - 1), _BASE, np.uint64)], dtype=np.uint64)[:size]
    upto = np.zeros((n, size + 1), np.uint64)
    np.cumsum((code.astype(np.uint64) + np.uint64(1)) * _LETTER * power, axis=1, dtype=np.uint64, out=upto[:, 1:])
    whole = upto[:, -1:]
    out, one, two = [whole], np.uint64(_BACK), np.uint64(_BACK * _BACK % (1 << 64))
    if most >= 1 and size:
        out.append(upto[:, :-1] + (whole - upto[:, 1:]) * one)
    if most >= 2 and size >= 2:
        i, j = np.triu_indices(size, 1)
        out.append(upto[:, i] + (upto[:, j] - upto[:, i + 1]) * one + (whole - upto[:, j + 1]) * two)
    return np.hstack(out)


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... n[0] of them, and so on."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


class _Left:
    """Terms of one allowed distance by the hashes of what is left of them."""

    def __init__(self, terms: np.ndarray, most: int):
        found, number = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for size, at in _by_length(terms):
            if allowed(size) == most and size <= LONG:
                left = _left(_codes(terms[at], size), most)
                found.append(left.ravel())
                number.append(np.repeat(at, left.shape[1]))
        key, number = np.concatenate(found), np.concatenate(number)
        order = np.argsort(key)
        self.keys, first = np.unique(key[order], return_index=True)
        self.first, self.number, self.terms = np.r_[first, len(key)], number[order], len(terms)
        self.known = np.zeros(1 << BITS, bool)
        self.known[key >> np.uint64(64 - BITS)] = True

    def pairs(self, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of hashes -> each (row, term) that share one."""
        flat = left.ravel()
        at = np.flatnonzero(self.known[flat >> np.uint64(64 - BITS)])
        place = np.minimum(np.searchsorted(self.keys, flat[at]), max(0, len(self.keys) - 1))
        hit = self.keys[place] == flat[at] if len(self.keys) else np.zeros(len(at), bool)
        at, place = at[hit], place[hit]
        n = self.first[place + 1] - self.first[place]
        term = self.number[_spread(self.first[place], n)]
        pair = np.unique(np.repeat(at // left.shape[1], n) * self.terms + term)
        return pair // self.terms, pair % self.terms


def _thirds(size: int) -> list[tuple[int, int]]:
    return [(size * i // 3, size * (i + 1) // 3) for i in range(3)]


class Near:
    """Terms, to find the words within their allowed distances."""

    def __init__(self, terms: list[str]):
        known = np.array([*terms, ""], object)[:-1]
        self.tables = {most: _Left(known, most) for most in range(3)}
        self.size = np.fromiter(map(len, known), np.int64, len(known))
        self.code, self.place = {}, np.zeros(len(known), np.int64)
        for size, at in _by_length(known):
            self.code[size], self.place[at] = _codes(known[at], size), np.arange(len(at))
        self.thirds: dict[tuple[int, int, str], list[int]] = {}
        for number in np.flatnonzero(self.size > LONG).tolist():
            for third, (a, b) in enumerate(_thirds(len(known[number]))):
                self.thirds.setdefault((len(known[number]), third, known[number][a:b]), []).append(number)
        self.longs = {size for size, _, _ in self.thirds}

    def _checked(self, word: np.ndarray, code: np.ndarray, row: np.ndarray, term: np.ndarray):
        """Of pairs of a row of `code` and a term those that are near: the row's word, the term, the distance."""
        for size in np.unique(self.size[term]).tolist():
            for at in np.array_split(own := np.flatnonzero(self.size[term] == size), 1 + len(own) * size // HASHES):
                distance = _distance(self.code[size][self.place[term[at]]], code[row[at]])
                near = distance <= allowed(size)
                yield word[row[at[near]]], term[at[near]], distance[near]

    def __call__(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of words, numbers of terms, and distances of all near pairs, by word."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8))]
        for size, at in _by_length(words):
            step = max(1, HASHES // (1 + size * (size + 1) // 2))
            for most, table in self.tables.items():
                if not any(size + i in self.code and size + i <= LONG and allowed(size + i) == most for i in range(-most, most + 1)):
                    continue
                for part in (at[i : i + step] for i in range(0, len(at), step)):
                    code = _codes(words[part], size)
                    found.extend(self._checked(part, code, *table.pairs(_left(code, most))))
            longs = [n for n in range(size - 2, size + 3) if n in self.longs]
            for word in at.tolist() if longs else ():
                term = {
                    number
                    for n in longs
                    for third, (a, b) in enumerate(_thirds(n))
                    for i in range(-2, 3)
                    for number in self.thirds.get((n, third, words[word][a + i : b + i] if a + i >= 0 else ""), ())
                }
                own = np.array(sorted(term), np.int64)
                found.extend(self._checked(np.array([word]), _codes(words[word : word + 1], size), np.zeros(len(own), np.int64), own))
        word, term, distance = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(word, kind="stable")
        return word[order], term[order], distance[order]


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows with a word, WORDS or a batch more of them at once."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch.filter(batch.column(0).is_valid()))
        if sum(b.num_rows for b in held) >= WORDS:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks()


def whole(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Values from one of `ends` to the next as bytes."""
    at = pa.py_buffer((ends * values.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, at, pa.py_buffer(values.tobytes())])


def _unpacked(column: pa.Array, kind: type) -> np.ndarray:
    _, at, data = column.buffers()
    ends = np.frombuffer(at, np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else [0]
    return np.frombuffer(data.slice(ends[0], ends[-1] - ends[0]), kind) if ends[-1] > ends[0] else np.zeros(0, kind)


def pairs(terms: pa.Array):
    """(word) -> (term, word, distance): all pairs within the term's allowed distance, each once. Without nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Near(terms.to_pylist())
        for table in _columns(batches):
            column = whole(table.column(0))
            word, term, distance = near(np.array([*column.to_pylist(), ""], object)[:-1])
            yield pa.RecordBatch.from_arrays(
                [terms.take(pa.array(term)), column.take(pa.array(word)), pa.array(distance.astype(np.int32))], ["term", "word", "distance"]
            )

    return run


def kind_of(terms: pa.Array) -> type:
    """Of the numbers that name a distance, up to two, and the length of the shorter text, up to the longest term's."""
    return np.uint16 if (pa.compute.max(pa.compute.utf8_length(terms)).as_py() or 0) < 20_000 else np.uint32


def lists(terms: pa.Array, first: int, kind: type):
    """(word, df) -> (word, df, near, edits) for words near any term: numbers of the terms from `first` on, and 3 * the shorter length + the distance, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Near(terms.to_pylist())
        for table in _columns(batches):
            words = np.array([*whole(table.column(0)).to_pylist(), ""], object)[:-1]
            word, term, distance = near(words)
            shorter = np.minimum(np.fromiter(map(len, words), np.int64, len(words))[word], near.size[term])
            keep = shorter > distance  # others add nothing
            word, term, edits = word[keep], term[keep], (3 * shorter + distance)[keep]
            own, at = np.unique(word, return_index=True)
            packed = [_packed(x, np.r_[at, len(word)]) for x in ((term + first).astype(np.int32), edits.astype(kind))]
            yield pa.RecordBatch.from_arrays([*(whole(c).take(pa.array(own)) for c in table.columns), *packed], ["word", "df", "near", "edits"])

    return run


def counted(tokens: Callable[[pa.Array], pa.ListArray]):
    """(doc_id, text, tokens) -> (term, df, words): documents of each term; in rows without a term all documents, and their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in postings.blocks_of(postings._analysed(batches, tokens), DOCS):
            _, length, code, terms, place = postings.coded(table)
            df = np.bincount(np.unique(code * len(length) + place) // len(length), minlength=len(terms))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([terms.cast(pa.string()), pa.nulls(1, pa.string())]),
                    pa.array(np.r_[df, len(length)].astype(np.int64)),
                    pa.array(np.r_[np.zeros(len(terms), np.int64), length.sum()]),
                ],
                ["term", "df", "words"],
            )

    return run


@dataclass(frozen=True)
class Asked:
    """Queries by falling number of terms: of each the numbers of its terms from `start` on, `size` of them, and how often it has them."""

    query: np.ndarray
    start: np.ndarray
    size: np.ndarray
    term: np.ndarray
    times: np.ndarray
    terms: pa.Array


@dataclass(frozen=True)
class Words:
    """Words and their weights, and of each, from one of `first` to the next, the numbers of the terms near it and their edits (see `lists`)."""

    words: pa.Array
    weight: np.ndarray
    first: np.ndarray
    near: np.ndarray
    edits: np.ndarray

    def __reduce__(self):
        # a task holds what it got beside what it makes of it
        small = [(pa.compress(pa.py_buffer(x), codec="zstd"), x.nbytes, x.dtype.str) for x in (self.near, self.edits)]
        return _words, (self.words, self.weight, self.first, *small)


def _words(words: pa.Array, weight: np.ndarray, first: np.ndarray, *small: tuple[pa.Buffer, int, str]) -> Words:
    return Words(words, weight, first, *(np.frombuffer(pa.decompress(data, size, codec="zstd"), kind) for data, size, kind in small))


def asked(queries: pa.Table) -> Asked:
    """queries (n, bag): a text of terms between spaces."""
    bags = pa.compute.split_pattern(whole(queries.column("bag")), " ")
    found = bags.flatten().dictionary_encode()
    terms = max(1, len(found.dictionary))
    row = np.repeat(np.arange(len(bags)), np.diff(bags.offsets.to_numpy()))
    pair, times = np.unique(row * terms + found.indices.to_numpy(zero_copy_only=False), return_counts=True)
    size = np.bincount(pair // terms, minlength=len(bags))
    order = np.argsort(-size, kind="stable")
    start = np.cumsum(size) - size
    return Asked(whole(queries.column("n")).to_numpy(zero_copy_only=False)[order], start[order], size[order], pair % terms, times.astype(float), found.dictionary)


def words_of(near: pa.Table, n: int, kind: type) -> Words:
    """near (word, df, near, edits), a word in several rows if its terms came in several parts; n: all documents."""
    words = whole(near.column("word"))
    one = pa.compute.unique(words)
    number = pa.compute.index_in(words, one).to_numpy(zero_copy_only=False)
    order = np.argsort(number, kind="stable")
    rows = near.take(pa.array(order)) if len(one) < len(words) else near
    df = np.zeros(len(one), np.int64)
    df[number] = whole(near.column("df")).to_numpy(zero_copy_only=False)
    packed, edits = whole(rows.column("near")), whole(rows.column("edits"))
    size = np.bincount(number[order], pa.compute.binary_length(packed).to_numpy(zero_copy_only=False) // 4, len(one)).astype(np.int64)
    return Words(one, np.log(1 + (n - df + 0.5) / (df + 0.5)), np.r_[0, np.cumsum(size)], _unpacked(packed, np.int32), _unpacked(edits, kind))


class _Best:
    """The k best documents of each query so far; ties to the smaller id."""

    def __init__(self, queries: int, k: int, kind: pa.DataType):
        self.k, self.floor, self.pending = k, np.zeros(queries), 0
        self.query, self.score, self.ids = [np.zeros(0, np.int64)], [np.zeros(0)], [pa.array([], kind)]

    def add(self, query: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        self.query.append(query)
        self.score.append(np.floor(score * 1e6 + 0.5) / 1e6)
        self.ids.append(ids)
        self.pending += len(query)
        if self.pending > max(10_000, len(self.floor) * self.k // 2):
            self.cut()

    def cut(self) -> None:
        query, score, ids = np.concatenate(self.query), np.concatenate(self.score), pa.concat_arrays(self.ids)
        place = pa.compute.rank(ids, tiebreaker="dense").to_numpy() if len(ids) else np.zeros(0, np.int64)
        order = np.lexsort((place, -score, query))
        first = np.searchsorted(query[order], np.arange(len(self.floor)))
        nth = np.arange(len(order)) - first[query[order]]
        last = order[nth == self.k - 1]
        self.floor[query[last]] = score[last]
        order = order[nth < self.k]
        self.query, self.score, self.ids, self.pending = [query[order]], [score[order]], [ids.take(pa.array(order))], 0


def _worths(own: Words, boost: np.ndarray, terms: int, doc: np.ndarray, word: np.ndarray, value: np.ndarray, width: int) -> np.ndarray:
    """(document, term): what each term is worth in each of `width` documents, over the words near it."""
    n = own.first[word + 1] - own.first[word]
    upto = np.r_[0, np.cumsum(n)]
    out, at = np.zeros(width * terms), 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + ADDED, side="right")) - 1)
        part, times = slice(at, to), n[at:to]
        near = _spread(own.first[word[part]], times)
        # postings lie by document, so only the part from the first one's to the last one's grows
        low, high = int(doc[at]) * terms, (int(doc[to - 1]) + 1) * terms
        flat = np.repeat(doc[part] * terms - low, times) + own.near[near]
        out[low:high] += np.bincount(flat, np.repeat(value[part], times) * boost[own.edits[near]], minlength=high - low)
        at = to
    return out.reshape(width, terms)


def _summed(own: Asked, worth: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(query, document): the worths of the terms of queries that start there, by falling size."""
    score = np.zeros((len(start), worth.shape[1]), np.float32)
    buffer = np.empty_like(score)
    for nth in range(size[0]):
        m = int(np.searchsorted(-size, -nth))
        at = start[:m] + nth
        one = np.take(worth, own.term[at], axis=0, out=buffer[:m], mode="clip")
        if own.times[at].max() > 1:
            one *= own.times[at, None].astype(np.float32)
        score[:m] += one
    return score


def scan(own: Asked, words: Words, tokens: Callable[[pa.Array], pa.ListArray], k: int, average: float, kind: pa.DataType):
    """(doc_id, text, tokens) -> (n, doc_id, raw_score): of each query the k best documents of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(own.query), k, kind)
        terms_all, tiny = len(own.terms), float(np.finfo(np.float32).tiny)
        edits = np.arange(3 + int(words.edits.max(initial=0)))
        boost = 1 - edits % 3 / np.maximum(1, edits // 3)
        wide = max(1, min(WIDTH, WORTHS // max(1, terms_all)))
        order = np.argsort(own.start)
        for table in postings.blocks_of(postings._analysed(batches, tokens), DOCS):
            ids, length, code, terms, place = postings.coded(table)
            at = pa.compute.index_in(words.words, terms.cast(pa.string()))
            own_word = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
            known = np.full(len(terms), -1)
            known[at.drop_null().to_numpy(zero_copy_only=False)] = own_word
            pair, times = np.unique(place * max(1, len(terms)) + code, return_counts=True)
            doc, word = pair // max(1, len(terms)), known[pair % max(1, len(terms))]
            doc, word, times = doc[word >= 0], word[word >= 0], times[word >= 0]
            value = postings.saturation(times, length[doc].astype(float), average) * words.weight[word]
            for lo in range(0, len(length) if len(doc) else 0, wide):
                part = slice(*np.searchsorted(doc, [lo, lo + wide]))
                width = min(wide, len(length) - lo)
                exact = _worths(words, boost, terms_all, doc[part] - lo, word[part], value[part], width)
                # half as many bytes find the documents that may be among the best; these are then scored exactly
                worth = np.ascontiguousarray(exact.T, np.float32)
                most = np.empty(len(own.query))
                most[order] = np.add.reduceat(worth.max(axis=1)[own.term] * own.times, own.start[order])
                active = np.flatnonzero((most > 0) & (most * (1 + SLACK) + SLACK >= best.floor * (1 - ROUNDED)))
                for at in range(0, len(active), QUERIES):
                    query = active[at : at + QUERIES]
                    start, size = own.start[query], own.size[query]
                    score = _summed(own, worth, start, size)
                    rounded = ROUNDED * (size + 2)[:, None]
                    least = np.maximum((best.floor[query, None] - SLACK) * (1 - rounded), tiny)
                    hit = np.flatnonzero(score >= least.astype(np.float32))
                    if width > k and len(hit) > 4 * k * len(query):
                        nth = np.partition(score, width - k, axis=1)[:, width - k, None].astype(float)
                        least = np.maximum(least, (nth - 2 * SLACK) * (1 - 2 * rounded))
                        hit = np.flatnonzero(score >= least.astype(np.float32))
                    if len(hit):
                        row, column = hit // width, hit % width
                        at_term = _spread(start[row], size[row])
                        each = exact[np.repeat(column, size[row]), own.term[at_term]] * own.times[at_term]
                        best.add(query[row], np.add.reduceat(each, np.cumsum(size[row]) - size[row]), ids.take(pa.array(column + lo)))
        best.cut()
        yield pa.RecordBatch.from_arrays([pa.array(own.query[best.query[0]]), best.ids[0], pa.array(best.score[0])], ["n", "doc_id", "raw_score"])

    return run
