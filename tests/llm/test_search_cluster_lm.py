"""Ranked lexical search, centroid clustering and language-model scores against brute force, with awkward input."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from cases import documents, empty, got, texts

from keyloom.llm import clustering, suffix_tree, term_pipeline

VECTORS = "vec_id long, embedding array<float>, x string, cluster int, distance long, upper double, pos int"


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def terms(text):
    out, word = [], ""
    for c in fold(text) + " ":
        if c.isascii() and not c.isalnum():
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out


def ranked(items, docs, k):
    lists = [(i, terms(t)) for i, t in docs]
    full = [x for _, x in lists if x]
    n, total = len(full), sum(map(len, full))
    df = collections.Counter(t for x in full for t in set(x))
    out = {}
    for item, text in dict.fromkeys(items):
        found = []
        for doc, x in lists:
            if not x:
                continue
            m = 10 + 90 * len(x) * n // total
            score = 0
            for t in sorted(set(terms(text)) & set(x)):
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                score += w * (1000000000 * x.count(t) // (1000 * x.count(t) + 8 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out.setdefault(item, []).extend((r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found, key=lambda f: f[:3])[:k]))
    return {i: sorted(x, key=repr) for i, x in out.items() if x}


def lists_of(df):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r.item_id].append((r["rank"], r.doc_id, r.score))
    return {i: sorted(x, key=repr) for i, x in out.items()}


def items(spark, rows):
    return spark.createDataFrame([(i, t, "b", 1, 2) for i, t in rows], "item_id long, text string, block string, term int, score int")


@pytest.mark.parametrize("owners,bundle", [(4, 256), (1, 1), (3, 2)])
def test_lexical_search_equals_brute_force(spark, monkeypatch, owners, bundle):
    monkeypatch.setattr(term_pipeline, "BLOCK", 4)
    rows = [(i, None if t is None else t[:3000]) for i, t in texts()]
    r = random.Random(4)
    rows += [(100 + i, " ".join(r.choices(["Alpha", "beta", "ÜBER", "x-y", "gamma7", "beta,"], k=r.randrange(1, 30)))) for i in range(60)]
    rows += [(300, "alpha beta"), (300, "alpha beta"), (299, "alpha beta")]
    asked = [(1, "Alpha gamma7 nowhere"), (2, "ÜBER x"), (3, None), (4, ""), (5, "one two three w1"), (5, "beta y"), (1, "Alpha gamma7 nowhere"), (None, "beta")]
    found = lists_of(term_pipeline.search(items(spark, asked), documents(spark, rows), k=5, owners=owners, bundle=bundle))
    assert found == ranked(asked, rows, 5)
    assert set(found) == {1, 2, 5, None}


def test_lexical_search_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(term_pipeline, "VOCABULARY", 12)
    asked = [(i, f"one two w{i} three") for i in range(4)]
    assert lists_of(term_pipeline.search(items(spark, asked), documents(spark), k=3)) == ranked(asked, texts(), 3)


def test_long_texts_are_counted_in_pieces(monkeypatch):
    monkeypatch.setattr(term_pipeline, "PIECE", 7)
    text = "Some words, some LONGER-words; é" + "x" * 30 + " end"
    assert term_pipeline.counted(text.encode()) == collections.Counter(w.encode() for w in terms(text))


def test_lexical_search_without_rows(spark):
    none = items(spark, [])
    assert term_pipeline.search(none, documents(spark)).count() == 0
    assert term_pipeline.search(items(spark, [(1, "one")]), empty(spark)).count() == 0
    assert term_pipeline.search(items(spark, [(1, "nowhere at all")]), documents(spark)).count() == 0


def clusters(rows, k, rounds, dim):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    sha = lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, sha(r[0]), np.array(r[1], np.int32).tobytes()))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        members = [[v for (_, v), c in zip(kept, own) if c == n] for n in range(len(centres))]
        centres = [[sum(x) // len(m) for x in zip(*m)] if m else c for m, c in zip(members, centres)]
    last = [(i, *near(v)) for i, v in kept]
    inertia = collections.Counter()
    for _, d, c in last:
        inertia[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), digest[c]) for i, d, c in last), key=repr)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2, 3.0, 4) for i, v in rows], VECTORS)


@pytest.mark.parametrize("k,rounds", [(12, 5), (1, 2), (2, 3), (500, 2)])
def test_clusters_equal_brute_force(spark, k, rounds):
    r = np.random.default_rng(5)
    centres = r.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + r.normal(size=8) * 0.2).astype(np.float32).tolist()) for i in range(240)]
    rows += [(1000 + i, [0.5] * 8) for i in range(30)]  # equal vectors: ties and empty clusters
    rows += [(2000, None), (2001, [1.0] * 7), (2002, [1.0] * 7 + [None]), (2003, [float("nan")] + [0.0] * 7), (2004, [])]
    rows += [(2005, [float("inf")] + [0.0] * 7), (2006, [0.0] * 8), (5, rows[5][1]), (None, rows[6][1])]
    df = clustering.cluster(vectors(spark, rows), k=k, rounds=rounds, dim=8)
    found = [(x["vec_id"], x["cluster"], x["distance"], x["cluster_inertia"], x["inertia"], x["centroid_sha256"]) for x in got(df)]
    assert sorted(found, key=repr) == clusters(rows, k, rounds, 8)


def test_most_distances_are_not_computed():
    r = np.random.default_rng(6)
    at = np.floor(r.normal(size=(40, 4)) * 2000).astype(np.int64)
    x = (at[r.integers(0, 40, 5000)] + np.floor(r.normal(size=(5000, 4)) * 60)).astype(np.int64)
    state = [np.zeros(5000, np.int32), np.ones(5000, np.int32), np.full(5000, np.inf), np.zeros(5000)]
    clustering.assign(x, *state, clustering.Centroids.of(at, at))
    moved = at + r.integers(-20, 20, at.shape)
    count = clustering.assign(x, *state, clustering.Centroids.of(moved, at))
    d = ((x[:, None] - moved[None]) ** 2).sum(axis=2)
    assert (state[0] == d.argmin(axis=1)).all()
    assert (state[2] >= np.sqrt(d.min(axis=1))).all() and (state[3] <= np.sqrt(np.sort(d, axis=1)[:, 1])).all()
    assert count < 5000 * 3


def test_clusters_of_no_vectors_and_of_large_components(spark):
    assert clustering.cluster(vectors(spark, [])).count() == 0
    with pytest.raises(Exception, match="may not fit a long"):
        clustering.cluster(vectors(spark, [(1, [1e9, 0.0])]), dim=2).count()


def tokens(text):
    out, word = [], ""
    for c in fold(text) + " ":
        if c in " \t\n\x0b\f\r":
            out += [word] if word else []
            word = ""
        else:
            word += c
    return [*out, None]


def trained(docs):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    return [tokens(t) for i, t in docs if not held(i)], held


def corpus():
    r = random.Random(9)
    rows = texts()
    for i in range(400):
        language = ["la", "de"][i % 2]
        rows.append((1000 + i, " ".join(r.choice([f"{language}{r.randrange(12)}", f"{language}{r.randrange(12)}", f"Rare{r.randrange(10**5)}"]) for _ in range(40))))
    return rows


def naive(docs, rows):
    """The tree and the class of others by dictionaries, straight from their definition."""
    train, _ = trained(docs)
    c = collections.Counter(w for t in train for w in t)
    n = sum(c.values())
    least = max(suffix_tree.LEAST, math.ceil(suffix_tree.P_MIN * n))
    often = {w for w, x in c.items() if w is not None and x >= least}
    rare = {w: x for w, x in c.items() if w is not None and w not in often}
    symbol = lambda w: "end" if w is None else w if w in often else "?other"
    count = collections.Counter()
    for t in train:
        s = ["end"] * 2 + [symbol(w) for w in t]
        for i in range(2, len(s)):
            for d in range(3):
                count[tuple(s[i - d : i + 1])] += 1
    follows = collections.Counter()
    for s, x in count.items():
        follows[s[:-1]] += x
    kept = {s: x for s, x in count.items() if x >= least or len(s) == 1}
    p = lambda s: count[s] / follows[s[:-1]]
    states, after = set(), collections.defaultdict(list)
    for s in kept:
        after[s[:-1]].append(s)
    for context, strings in after.items():
        if context:
            own, up = [p(s) for s in strings], [p(s[1:]) for s in strings]
            kl = sum(a * math.log(a / b) for a, b in zip(own, up))
            left, left_up = 1 - sum(own), 1 - sum(up)
            kl += left * math.log(left / left_up) if left > 1e-12 and left_up > 1e-12 else 0
            if follows[context] * kl >= suffix_tree.PENALTY * len(strings) * math.log(n):
                states |= {context[i:] for i in range(len(context))}
    size = len(often) + 2
    n1, n2 = (sum(x == k for w, x in c.items() if w is not None) for k in (1, 2))
    d = min(0.9, max(0.1, n1 / max(1, n1 + 2 * n2)))
    all_rare = sum(rare.values())

    def share(w):
        return (rare[w] - d if w in rare else d * len(rare)) / all_rare

    def chance(context, a):
        if not context:
            return (count[(a,)] + 1) / (n + size)
        own = [(s, (kept[s] - suffix_tree.DISCOUNT) / follows[context]) for s in after[context]]
        return dict(own).get((*context, a), 0) + (1 - sum(x for _, x in own)) * chance(context[1:], a)

    out = []
    for i, text in rows:
        s, score = ["end"] * 2, 0.0
        for w in tokens(text):
            context = next(x for x in (tuple(s[-2:]), tuple(s[-1:]), ()) if not x or x in states)
            a = symbol(w)
            score += math.log10(chance(context, a)) + (math.log10(share(w)) if a == "?other" else 0)
            s.append(a)
        out.append(score)
    alphabet = ["end", "?other", *sorted(often)]
    return out, [sum(chance(x, a) for a in alphabet) for x in sorted(states)[:20]], states


def test_language_model_scores(spark):
    rows = corpus()
    train, held = trained(rows)
    c = collections.Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    score, sums, states = naive(rows, rows)
    want = collections.Counter()
    for (i, t), s in zip(rows, score, strict=True):
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))
        want[(i, held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(base, 6), round(s, 6))] += 1
    df = documents(spark, rows).repartition(3)
    found = got(suffix_tree.score(df))
    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")
    assert collections.Counter((*(r[x] for x in names), round(r["base_score"], 6), round(r["score"], 6)) for r in found) == want
    assert len(states) > 5 and sums == pytest.approx([1.0] * len(sums))
    new = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in new) > sum(r["base_score"] for r in new)


def test_words_of_long_texts_are_hashed_in_pieces(monkeypatch):
    raw = [b"some words and others", b"", b"  ", b"x" * 40 + b" some words", b"end"]
    whole = suffix_tree.words(raw)
    monkeypatch.setattr(suffix_tree, "PIECE", 6)
    cut = suffix_tree.words(raw)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all() and whole[1].tolist() == [0, 0, 0, 0, 3, 3, 3, 4]


def test_language_model_without_training_texts(spark):
    assert suffix_tree.score(empty(spark)).count() == 0
    held = [i for i in range(1, 200) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = [(i, t) for i, (_, t) in zip(held, texts())]
    found = got(suffix_tree.score(documents(spark, rows)))
    assert len(found) == len(rows) == len(texts()) and all(r["held_out"] for r in found)
    assert all(r["base_score"] == 0 and r["n_known"] == 0 and r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in found)


def test_many_occurrences_of_one_word_in_one_text(spark):
    rows = [(1, "a " * 140_000), (2, "b"), (3, "a b")]
    found = {r["doc_id"]: r for r in got(suffix_tree.score(documents(spark, rows)))}
    train, held = trained(rows)
    c = collections.Counter(w for t in train for w in t)
    for i, t in rows:
        base = sum(x * math.log10((c[w] + 1) / (sum(c.values()) + len(c) + 1)) for w, x in collections.Counter(tokens(t)).items())
        assert found[i]["base_score"] == pytest.approx(base, rel=1e-12)
