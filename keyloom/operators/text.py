"""Text analysis and BM25 ranking."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable
from functools import cache, lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.operators import fuzzy as nearby
from keyloom.operators import postings
from keyloom.operators.postings import B, K1  # noqa: F401
from keyloom.sources import shared

#: Letters without a canonical decomposition and what they fold to; those that become two letters.
OTHER_FOLDS = {"đ": "d", "ø": "o", "ł": "l", "ı": "i"}
PAIRS = {"ß": "ss", "æ": "ae", "œ": "oe"}
#: Terms that every task takes at once to find the words near them; near words and queries of a batch that every task takes to score it.
NEAR_TERMS, NEAR_WORDS, NEAR_QUERIES = 100_000, 16_000_000, 65_536


def _folds() -> dict[str, str]:
    """Lower-case letters up to U+1EFF whose canonical decomposition is a letter and marks, and that letter."""
    out = dict(OTHER_FOLDS)
    for c in map(chr, range(0xC0, 0x1F00)):
        base, *marks = unicodedata.normalize("NFD", c)
        if marks and all(unicodedata.combining(m) for m in marks) and unicodedata.category(c) == "Ll":
            out[c] = base
    return out


_FOLDS = _folds()
FOLD_FROM, FOLD_TO = "".join(_FOLDS), "".join(_FOLDS.values())
MARKS, TOKEN = r"\p{M}+", r"[\p{L}\p{N}]+"


def analyse(text: Column) -> Column:
    """Tokens of a text: lower case, accents and marks folded, runs of letters and digits of any script."""
    plain = F.translate(F.regexp_replace(F.lower(text), MARKS, ""), FOLD_FROM, FOLD_TO)
    for letter, two in PAIRS.items():
        plain = F.replace(plain, F.lit(letter), F.lit(two))
    return F.regexp_extract_all(plain, F.lit(TOKEN), F.lit(0))


#: ASCII as `analyse` has it: small letters and digits, anything else ends a token. The bytes of other characters stay.
ASCII = bytes(c + 32 if chr(c).isupper() else c if c > 127 or chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))
#: Texts with these stay with `analyse`: the small letter of Σ hangs on its neighbours, and `letters` leaves out what lies beyond U+FFFF.
ODD = r"[\x{03A3}\x{10000}-\x{10FFFF}]"


class _Letters(dict):
    """What becomes of a character; those that are not named end a token."""

    def __missing__(self, code: int) -> str:
        return " "


@cache
def letters(spark: SparkSession) -> _Letters:
    """What `analyse` makes of each character of U+0080 to U+FFFF, asked of itself: none for a mark, one letter or two."""
    code = spark.range(0x80, 0x10000).filter(~F.col("id").between(0xD800, 0xDFFF))
    char = F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE")
    inside = F.array_join(analyse(F.concat(F.lit("a"), char, F.lit("b"))), " ")
    found = code.select("id", F.substr(inside, F.lit(2), F.length(inside) - 2).alias("to")).filter(F.col("to") != " ").toArrow()
    return _Letters(zip(found.column("id").to_pylist(), found.column("to").to_pylist(), strict=True))


def prepared(docs: DataFrame) -> DataFrame:
    """(doc_id, text, tokens) of docs (doc_id, text): the text for `splitter`, or its tokens if it holds odd characters."""
    text = F.col("text")
    plain = (F.length(text) == F.octet_length(text)) | ~F.rlike(text, F.lit(ODD))
    return docs.select("doc_id", F.when(plain, text).alias("text"), F.when(~plain, analyse(text)).alias("tokens"))


def splitter(known: _Letters) -> Callable[[pa.Array], pa.ListArray]:
    """What `analyse` gives for texts without odd characters, for an array of them at once: their bytes are parted together."""

    def tokens(texts: pa.Array) -> pa.ListArray:
        fold = lru_cache(100_000)(lambda run: run.translate(known))
        rows = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
        rows = [t if t.isascii() else re.sub(r"[^\x00-\x7f]+", lambda m: fold(m[0]), t.decode("utf-8", "replace")).encode() for t in rows]
        data = np.frombuffer(b" ".join([*rows, b""]).translate(ASCII), np.uint8)
        inside = data != 32
        edges = np.flatnonzero(np.diff(inside, prepend=False))  # every row ends with a space, so these are starts and ends in turn
        starts, length = edges[0::2], edges[1::2] - edges[0::2]
        offsets = np.r_[0, np.cumsum(length)].astype(np.int32)
        words = pa.StringArray.from_buffers(len(length), pa.py_buffer(offsets), pa.py_buffer(data[inside]))
        ends = np.cumsum([len(t) + 1 for t in rows], dtype=np.int64)
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, np.r_[0, ends]).astype(np.int32)), words)

    return tokens


def query_terms(queries: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """(query_id, term, qtf): the terms of each query; a term that it repeats counts once for each time.

    With a vocabulary (word) each term also stands for the words within its allowed edit distance, which count
    less by the distance's share of the shorter of both.
    """
    terms = queries.select("query_id", F.explode(analyse(F.col("text"))).alias("term"))
    terms = terms.groupBy("query_id", "term").agg(F.count("*").cast("double").alias("qtf"))
    if vocabulary is None:
        return terms
    near = fuzzy_terms(terms.select("term").distinct(), vocabulary)
    boost = 1 - F.col("distance") / F.least(F.length("term"), F.length("word"))
    near = near.select("term", "word", boost.alias("boost")).filter(F.col("boost") > 0)
    return terms.join(near, "term").groupBy("query_id", F.col("word").alias("term")).agg(F.sum(F.col("qtf") * F.col("boost")).alias("qtf"))


def index(docs: DataFrame, path: str, only: pa.Array | None = None) -> None:
    """Write the inverted index of docs (doc_id, text): every text is analysed once. Null texts have no tokens.

    With `only`, the terms of a batch of queries, it holds these alone and answers that batch.
    """
    known = letters(docs.sparkSession)
    postings.build(prepared(docs), path, splitter(known), only)


def terms_of(queries: DataFrame) -> pa.Array | None:
    """The different terms of a batch in order; None if they are too many to go to every task."""
    terms = query_terms(queries).select("term").distinct()
    found = terms.limit(postings.MAX_TERMS + 1).toArrow().column("term").combine_chunks()
    return found.take(pa.compute.sort_indices(found)) if len(found) <= postings.MAX_TERMS else None


def search(queries: DataFrame, path: str, k: int, fuzzy: bool = False) -> DataFrame:
    """(query_id, doc_id, rank, raw_score) of queries (query_id, text) against an index: see bm25_top_k."""
    words = postings.vocabulary(queries.sparkSession, path).select(F.col("term").alias("word")) if fuzzy else None
    return postings.search(query_terms(queries, words), path, k)


def bm25_top_k(queries: DataFrame, docs: DataFrame, k: int, fuzzy: bool = False) -> DataFrame:
    """(query_id, doc_id, rank, raw_score): the k documents of highest BM25 for each query, ties to the smaller id.

    queries (query_id, text) match a document if they share a token, or with `fuzzy` one within the edit distance that
    it allows. idf = ln(1 + (N - df + 0.5) / (df + 0.5)). Null texts have no tokens; no matches give no rows. The texts are
    indexed first, for the terms of these queries; where many batches search the same texts, keep an index of all (`index`, `search`).
    """
    if fuzzy:
        return fuzzy_top_k(queries, docs, k)
    path = shared.fresh(docs.sparkSession, "bm25")
    index(docs, path, terms_of(queries))
    return search(queries, path, k)


def fuzzy_top_k(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """bm25_top_k of a batch whose terms stand for all words of docs within their edit distance (see `fuzzy.scan`).

    The texts are read once for the words that they hold and once for the scores. Queries of the same terms are answered together, and a
    batch with more near words than every task can take is dealt into parts of whole queries, each of which reads the texts again.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark, of_doc = docs.sparkSession, docs.schema["doc_id"].dataType
    texts, tokens = prepared(docs), splitter(letters(spark))
    counts = texts.mapInArrow(nearby.counted(tokens), "term string, df long, words long")
    counts = shared.written(counts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("words").alias("words")), "words")
    corpus = counts.filter("term IS NULL").first()
    n, average = (corpus.df, (corpus.words / corpus.df) or 1.0) if corpus else (0, 1.0)
    words = counts.filter("term IS NOT NULL").select(F.col("term").alias("word"), "df")

    bag = F.array_join(F.array_sort(F.flatten(F.collect_list(analyse(F.col("text"))))), " ")
    own = shared.written(queries.groupBy("query_id").agg(bag.alias("bag")).filter("bag <> ''"), "queries")
    bags = shared.written(own.select("bag").distinct().withColumn("n", F.monotonically_increasing_id()), "bags")

    def parts(some: DataFrame, depth: int):
        """Queries, and the words near their terms."""
        rows, half = some.count(), F.pmod(F.xxhash64("bag", F.lit(depth)), F.lit(2))
        few = rows <= NEAR_QUERIES or depth == postings.MAX_HALVINGS
        if rows and few:
            one = nearby.asked(some.toArrow())
            starts = range(0, len(one.terms), NEAR_TERMS)
            kind, form = nearby.kind_of(one.terms), "word string, df long, near binary, edits binary"
            near = [words.mapInArrow(nearby.lists(one.terms.slice(i, NEAR_TERMS), i, kind), form) for i in starts]
            held = shared.written(reduce(DataFrame.unionAll, near), "near")
            few = rows == 1 or depth == postings.MAX_HALVINGS or (held.agg(F.sum(F.octet_length("near"))).first()[0] or 0) <= 4 * NEAR_WORDS
            if few:
                yield one, nearby.words_of(held.toArrow(), n, kind)
        if rows and not few:
            for part in (0, 1):
                yield from parts(some.filter(half == part), depth + 1)

    form = f"n long, doc_id {of_doc.simpleString()}, raw_score double"
    best = Window.partitionBy("n").orderBy(F.desc("raw_score"), F.asc_nulls_last("doc_id"))
    answered = [spark.createDataFrame([], f"{form}, rank int")]
    for one, held in parts(bags, 0):
        found = texts.mapInArrow(nearby.scan(one, held, tokens, k, average, to_arrow_type(of_doc)), form)
        found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        answered.append(shared.written(found, "found"))
    hits = reduce(DataFrame.unionAll, answered).join(bags, "n")
    return hits.join(own, "bag").select("query_id", "doc_id", "raw_score", "rank")


def fuzzy_terms(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, word, distance): words of the vocabulary within each term's allowed edit distance.

    terms (term) and vocabulary (word) hold each text once. Every task takes the terms, NEAR_TERMS or so at a time (see `fuzzy.Near`).
    """
    terms = shared.written(terms.filter("term IS NOT NULL").select("term"), "asked")
    parts = max(1, math.ceil(terms.count() / NEAR_TERMS))
    found = []
    for part in range(parts):
        one = terms.filter(F.pmod(F.xxhash64("term"), F.lit(parts)) == part).toArrow()
        one = nearby.whole(one.column("term"))
        found.append(vocabulary.select("word").mapInArrow(nearby.pairs(one), "term string, word string, distance int"))
    return reduce(DataFrame.unionAll, found)
