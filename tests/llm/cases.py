"""Small documents with nulls, empty and very long texts, ties, repeated rows and clashing column names."""

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, key long, row string, node string, path string, "
    "size string, block int, `group` int, digest string, score string, label int, hash int, dedup int, range int, count int"
)
EXTRA = (7, "r", "n", "p", "s", 1, 2, "d", "x", 3, 4, 5, 6, 8)


def words(n, seed):
    r = random.Random(seed)
    return [f"w{r.randrange(10**6)}" for _ in range(n)]


def texts():
    base = words(120, 1)
    near = base.copy()
    near[60] = "changed"
    passage = " ".join(words(80, 2))
    long = " ".join(words(30_000, 3))
    return [
        (1, " ".join(base)),
        (2, " ".join(base)),
        (3, " ".join(near)),
        (4, "intro one two three " + passage + " the end"),
        (5, " ".join(words(50, 5)) + "\n" + passage),
        (6, long),
        (7, ""),
        (8, None),
        (None, "a null id with some text " + " ".join(words(40, 6))),
        (None, None),
        (9, "one two three"),
        (10, "one two three"),
        (11, " \n\t "),
        (12, "!!! ### %%% " * 50),
        (12, "!!! ### %%% " * 50),
        (13, "Ünïcödé 日本語 text 🙂 " + " ".join(words(60, 7))),
        (14, "aaaa" * 300),
        (15, " ".join(words(200, 8))),
    ]


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    sources = ["a", None, "b", "a", "é", "", "b"]
    data = [
        (i, t, None if n % 4 == 0 else "en", sources[n % len(sources)], None if t is None else len(t), *EXTRA)
        for n, (i, t) in enumerate(rows)
    ]
    return spark.createDataFrame(data, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df):
    return [r.asDict(recursive=True) for r in df.collect()]
