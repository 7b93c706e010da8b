"""Connected components against a union by brute force."""

import random

import pytest

from keyloom.llm.components import components


def brute(edges):
    root = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


@pytest.mark.parametrize("kind", ["random", "chain", "hub", "awkward"])
def test_components(spark, kind):
    r = random.Random(3)
    edges = {
        "random": [(r.randrange(60), r.randrange(60)) for _ in range(45)],
        "chain": [(i, i + 1) for i in range(30)] + [(50, 45)],
        "hub": [(7, i) for i in range(60)],
        "awkward": [(1, 2), (2, 1), (1, 2), (3, 3), (5, 4)],
    }[kind]
    rows = spark.createDataFrame([*edges, (None, 5), (6, None)], "a long, b long")
    got = [tuple(x) for x in components(rows).collect()]
    want = brute([e for e in edges if e[0] != e[1]])
    assert len(got) == len(set(got)) and dict(got) == want
    assert components(rows.limit(0)).count() == 0
