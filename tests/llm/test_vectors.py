"""Vector searches against brute force, with awkward input."""

import collections
import itertools

import numpy as np
import pytest

from keyloom.llm import ann_search, exact_search

SCHEMA = "vec_id long, embedding array<float>, item int, c int, q int, dim string, score int, rank int, query_key int"
EXTRA = (1, 2, 3, "x", 4, 5, 6)
NAN, INF = float("nan"), float("inf")


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, *EXTRA) for i, v in rows], SCHEMA)


def awkward():
    r = np.random.default_rng(0)
    rows = [(i, r.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    same = rows[7][1]
    rows += [(400 + i, same) for i in range(40)]  # ties
    rows += [(500, None), (501, [1.0, None] + [0.0] * 6), (502, [NAN] * 8), (503, [INF] + [0.0] * 7), (504, [0.0] * 8)]
    rows += [(600, [1.0, 2.0]), (601, [2.0, 1.0]), (700, same), (700, same), (None, same), (800, [])]
    return rows


def brute(rows, k, every, transform, skip_zero):
    ok = [(i, [float(x) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    if skip_zero:
        ok = [(i, v) for i, v in ok if any(v)]
    ok = [(i, [transform(x) for x in v]) for i, v in ok]
    out = {}
    for q, v in dict.fromkeys((i, tuple(v)) for i, v in ok if i is not None and i % every == 0):
        found = []
        for i, w in ok:
            if i != q and len(w) == len(v):
                s = 0.0
                for a, b in zip(v, w, strict=True):
                    s += a * b
                found.append((-s, i is None, i or 0, i))
        out[q] = [(n + 1, f[3], -f[0]) for n, f in enumerate(sorted(found, key=lambda f: f[:3])[:k])]
    return {q: x for q, x in out.items() if x}


def found(df):
    out = collections.defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out[r.query_id].append((r["rank"], r.vec_id, r.score))
    return dict(out)


@pytest.mark.parametrize("q_rows,c_rows", [(512, 16384), (3, 20)])
def test_neighbours_equal_brute_force(spark, q_rows, c_rows):
    df = ann_search.search(vectors(spark, awkward()), k=5, every=20, q_rows=q_rows, c_rows=c_rows)
    assert found(df) == brute(awkward(), 5, 20, lambda x: x, True)


@pytest.mark.parametrize("q_rows,c_rows", [(512, 16384), (3, 20)])
def test_exact_search_equals_brute_force(spark, q_rows, c_rows):
    df = exact_search.search(vectors(spark, awkward()), k=5, every=20, q_rows=q_rows, c_rows=c_rows)
    assert found(df) == brute(awkward(), 5, 20, lambda x: float(np.floor(1024 * x)), False)


def test_neighbours_among_equal_vectors_in_slices(spark, monkeypatch):
    monkeypatch.setattr(ann_search, "TILE", 64)
    rows = [(i, [1.0, 2.0, 0.5]) for i in range(150)] + [(1000 + i, [1.0, 2.0, 0.5000001]) for i in range(3)]
    df = ann_search.search(vectors(spark, rows), k=4, every=20)
    assert found(df) == brute([(i, np.array(v, np.float32).astype(float).tolist()) for i, v in rows], 4, 20, lambda x: x, True)


def test_few_candidates_give_all(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])]
    assert found(exact_search.search(vectors(spark, rows))) == {0: [(1, 1, 512 * 1024), (2, 2, 0)]}
    assert [x[1] for x in found(ann_search.search(vectors(spark, rows)))[0]] == [1, 2]


def test_large_components_stay_exact(spark):
    rows = [(0, [2.0e6, 1.0]), (1, [1.5e6, -7.0]), (2, [-1.9e6, 3.0]), (3, [1.0, 2.0]), (4, [2.0e6, 1.0]), (100, [5.0e4, 1.0])]
    got = found(exact_search.search(vectors(spark, rows)))
    f = lambda v: [int(np.floor(1024 * float(np.float32(x)))) for x in v]
    dot = lambda a, b: sum(x * y for x, y in zip(f(a), f(b)))
    for q in (0, 100):
        want = sorted(((-dot(dict(rows)[q], v), i) for i, v in rows if i != q))
        assert got[q] == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]
        assert any(abs(s) > 2**53 for s, _ in want) or q == 100


def test_scores_beyond_a_long_are_an_error(spark):
    rows = [(0, [3.0e15, 1.0]), (1, [2.5e15, -7.0])]
    with pytest.raises(Exception, match="does not fit into a long"):
        exact_search.search(vectors(spark, rows)).collect()


def test_no_rows(spark):
    none = vectors(spark, [])
    assert ann_search.search(none).count() == 0 and exact_search.search(none).count() == 0


def test_error_bounds_hold():
    r = np.random.default_rng(3)
    for scale, dim in itertools.product((1e-3, 1, 1e6), (1, 64)):
        x, y = r.normal(size=(50, dim)) * scale, r.normal(size=(60, dim)) * scale
        cx, sx, nx, ex = ann_search.quantised(x)
        cy, sy, ny, ey = ann_search.quantised(y)
        about = cx.astype(float) @ cy.astype(float).T * (sx[:, None] * sy)
        bound = ex[:, None] * (ny + ey) + nx[:, None] * ey
        assert (np.abs(x @ y.T - about) <= bound * (1 + 1e-9) + 1e-12 * scale**2).all()
