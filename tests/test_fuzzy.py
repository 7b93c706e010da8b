"""Words near terms, and batches of queries whose terms stand for them, against plain loops."""

import math
import random
import re
from collections import Counter

import pytest

from keyloom.operators import fuzzy, postings, text


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def changed(rng, word):
    for _ in range(rng.randrange(4)):
        at = rng.randrange(len(word) + 1)
        word = word[:at] + rng.choice(["", "a", "é", "𝒳"]) + word[at + rng.randrange(2) :]
    return word


def test_near_words_of_any_length(spark, monkeypatch):
    rng = random.Random(7)
    terms = sorted({"".join(rng.choices("abcé𝒳", k=n)) for n in [*range(1, 13), 23, 24, 25, 26, 27, 40, 2000] * 3} | {""})
    words = sorted({changed(rng, rng.choice([t for t in terms if len(t) < 1000])) for _ in range(600)} | {terms[-1][:-1], *(t[1:] for t in terms)})
    want = {(t, w, d) for t in terms for w in words if abs(len(t) - len(w)) <= 2 and (d := edits(t, w)) <= (0 if len(t) <= 2 else 1 if len(t) <= 5 else 2)}
    one = lambda values, name: spark.createDataFrame([(v,) for v in [*values, None]], f"{name} string")
    for some in (100_000, 10):
        monkeypatch.setattr(text, "NEAR_TERMS", some)
        got = [tuple(r) for r in text.fuzzy_terms(one(terms, "term"), one(words, "word")).collect()]
        assert len(got) == len(set(got)) and set(got) == want and {d for _, _, d in want} == {0, 1, 2}


@pytest.mark.parametrize("near, queries, worths, added", [(16_000_000, 65_536, 4_000_000, 200_000), (40, 5, 40, 3)])
def test_fuzzy_batch_is_a_plain_loop(spark, monkeypatch, near, queries, worths, added):
    for module, name, value in (
        (text, "NEAR_WORDS", near), (text, "NEAR_QUERIES", queries), (fuzzy, "WORTHS", worths), (fuzzy, "ADDED", added), (fuzzy, "QUERIES", 4),
        (fuzzy, "DOCS", 16), (postings, "MAX_TERMS", 3),
    ):
        monkeypatch.setattr(module, name, value)
    rng = random.Random(3)
    words = ["".join(rng.choices("abc", k=rng.randrange(1, 9))) for _ in range(60)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 30)))) for i in range(120)] + [(120, None)]
    docs += [(i + 200, docs[5][1]) for i in range(8)]
    asked = [(i, " ".join(changed(rng, w) for w in rng.choices(words, k=rng.randrange(0, 9)))) for i in range(25)] + [(40, "ca ca ca ca abc"), (41, None), (None, "abc")]
    asked += [(i + 100, asked[3][1]) for i in range(4)]
    split = lambda t: re.findall(r"\w+", (t or "").lower().replace("é", "e"))
    tokens = {i: split(t) for i, t in docs}
    n, average = len(docs), sum(map(len, tokens.values())) / len(docs)
    df = Counter(w for t in tokens.values() for w in set(t))
    want = []
    for query, t in asked:
        weight = Counter()
        for term in split(t):
            for w in df:
                if (d := edits(term, w)) <= (0 if len(term) <= 2 else 1 if len(term) <= 5 else 2) and d < min(len(term), len(w)):
                    weight[w] += (1 - d / min(len(term), len(w))) * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
        scores = {i: sum(weight[w] * postings.saturation(c, len(t), average) for w, c in Counter(t).items()) for i, t in tokens.items()}
        best = sorted((-round(s, 6), i) for i, s in scores.items() if s > 0)[:6]
        want += [(query, i, rank, -s) for rank, (s, i) in enumerate(best, 1)]
    q = spark.createDataFrame(asked, "query_id long, text string")
    got = text.bm25_top_k(q, spark.createDataFrame(docs, "doc_id long, text string").repartition(3), 6, fuzzy=True)
    got = [(r.query_id, r.doc_id, r["rank"], r.raw_score) for r in got.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert [r[:3] for r in sorted(got, key=key)] == [r[:3] for r in sorted(want, key=key)]
    assert all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True))
    assert text.bm25_top_k(q.limit(0), docs_of(spark), 5, fuzzy=True).count() == 0 == text.bm25_top_k(q, docs_of(spark).limit(0), 5, fuzzy=True).count()


def docs_of(spark):
    return spark.createDataFrame([("a", "one abc"), ("b", "two")], "doc_id string, text string")


def test_one_query_of_many_near_words(spark, monkeypatch):
    """More near words than a batch's terms may be are searched all the same."""
    monkeypatch.setattr(postings, "MAX_TERMS", 3)
    docs = spark.createDataFrame([(i, f"harbou{x}") for i, x in enumerate("rstuv")], "doc_id long, text string")
    found = text.bm25_top_k(spark.createDataFrame([(1, "harbour")], "query_id long, text string"), docs, 9, fuzzy=True).collect()
    assert sorted((r["rank"], r.doc_id) for r in found) == [(i + 1, i) for i in range(5)]
