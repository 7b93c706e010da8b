"""Integrity checks between tables, as rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key_differences(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., side): keys that only one side has."""
    left, right = a.select(*keys).distinct(), b.select(*keys).distinct()
    only = lambda x, y, side: x.join(y, keys, "left_anti").withColumn("side", F.lit(side))
    return only(left, right, "left").unionByName(only(right, left, "right"))


def multiset_differences(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., surplus): how many more rows of a key `a` has than `b`, where they differ.

    Both sides are summed per key before the shuffle, so repeated keys cost nothing.
    """
    sign = lambda df, s: df.select(*keys, F.lit(s).alias("_s"))
    both = sign(a, 1).unionByName(sign(b, -1))
    return both.groupBy(*keys).agg(F.sum("_s").alias("surplus")).filter(F.col("surplus") != 0)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def orphans(child: DataFrame, parent: DataFrame, on: list[str]) -> DataFrame:
    """Rows of the child whose key the parent lacks."""
    return child.join(parent.select(*on).distinct(), on, "left_anti")


def violations(df: DataFrame, checks: Mapping[str, Column], keys: list[str]) -> DataFrame:
    """(keys..., code): a row for every check that fails (is false or null) on a row."""
    codes = F.array_compact(
        F.array(*(F.when(F.coalesce(ok, F.lit(False)), F.lit(None)).otherwise(code) for code, ok in checks.items()))
    )
    return df.select(*keys, F.explode(codes).alias("code"))


def record_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(name, n) for each table."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def compare_counts(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(name, expected, actual, ok) over all names of either side."""
    e, a = expected.withColumnRenamed("n", "expected"), actual.withColumnRenamed("n", "actual")
    return e.join(a, "name", "full_outer").withColumn("ok", F.col("expected").eqNullSafe(F.col("actual")))


def digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row (n, xor, sums of 32-bit lanes): equal for equal multisets of rows in any order.

    A row is hashed as its fields' lengths and texts, a null field as `-`, so no two different rows are spelt alike.
    """
    spelt = (F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in (F.col(c).cast("string") for c in columns))
    row = F.sha2(F.concat(*spelt), 256)
    lane = lambda i: F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("long")
    hashed = df.select(*(lane(i).alias(f"l{i}") for i in range(4)))
    return hashed.agg(
        F.count("*").alias("n"),
        *(F.coalesce(F.sum(f"l{i}"), F.lit(0)).alias(f"sum{i}") for i in range(4)),
        *(F.coalesce(F.bit_xor(f"l{i}"), F.lit(0)).alias(f"xor{i}") for i in range(4)),
    )


def changed(local: DataFrame, remote: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Local rows that are absent remotely or differ in a value."""
    r = remote.select(F.col(key), *(F.col(v).alias(f"_r_{v}") for v in values), F.lit(True).alias("_there"))
    same = F.col("_there").isNotNull()
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col(f"_r_{v}"))
    return local.join(r, key, "left").filter(~same).select(*local.columns)


def peak_concurrency(spans: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """(by..., peak): most spans open at one time; one that ends when another starts does not meet it."""
    events = spans.select(*by, F.explode(
        F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")))
    ).alias("e")).select(*by, "e.t", "e.d")
    net = events.groupBy(*by, "t", "d").agg(F.sum("d").alias("net"))
    w = Window.partitionBy(*by).orderBy("t", "d").rowsBetween(Window.unboundedPreceding, 0)
    return net.withColumn("open", F.sum("net").over(w)).groupBy(*by).agg(F.max("open").alias("peak"))


def same_float32(a: Column, b: Column) -> Column:
    """Equal and finite once both are rounded to 32-bit floats."""
    x, y = a.cast("float"), b.cast("float")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    return F.coalesce(finite(x) & finite(y) & (x == y), F.lit(False))


def roll_up(checks: DataFrame) -> DataFrame:
    """checks (name, status, required) -> one row: FAIL, PARTIAL or PASS."""
    s, required = F.col("status"), F.col("required")
    fail = F.bool_or(required & s.isin("FAIL", "NOT_RUN"))
    partial = F.bool_or(s.isin("WARNING", "NOT_RUN"))
    return checks.agg(
        F.when(F.coalesce(fail, F.lit(False)), "FAIL").when(F.coalesce(partial, F.lit(False)), "PARTIAL").otherwise("PASS").alias("status")
    )


def check(name: str, failures: DataFrame, required: bool = True) -> DataFrame:
    """One row (name, failures, status, required): PASS without failing rows, else FAIL, or WARNING if not required."""
    n = F.col("failures")
    status = F.when(n == 0, "PASS").otherwise("FAIL" if required else "WARNING")
    counted = failures.agg(F.count("*").alias("failures"))
    return counted.select(F.lit(name).alias("name"), "failures", status.alias("status"), F.lit(required).alias("required"))


def artifact_report(
    artifact: DataFrame,
    source: DataFrame,
    key: str,
    text: str,
    contract: Mapping[str, Column],
    vector: Column,
    dimension: int,
    unit_ok: Column,
) -> DataFrame:
    """One row on whether a derived table still fits its source.

    Counts keys that are missing, superfluous or repeated, texts that changed, rows that break the contract's predicates
    (on the artifact's columns) and vectors of another dimension or not of unit length; valid if all are 0.
    """
    n = lambda ok: F.count(F.when(F.coalesce(ok, F.lit(False)), 1))
    broken = F.lit(False)
    for ok in contract.values():
        broken = broken | ~F.coalesce(ok, F.lit(False))
    own = artifact.select(
        key, F.col(text).alias("_own"), broken.alias("_broken"),
        (F.coalesce(F.size(vector), F.lit(-1)) != dimension).alias("_dim"), (~F.coalesce(unit_ok, F.lit(False))).alias("_unit"),
        F.lit(True).alias("_there"),
    )
    repeated = own.groupBy(key).agg(F.count("*").alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("repeated"))
    both = source.select(key, F.col(text).alias("_text"), F.lit(True).alias("_wanted")).join(own, key, "full_outer")
    counts = both.agg(
        n(F.col("_there").isNull()).alias("missing"),
        n(F.col("_wanted").isNull()).alias("superfluous"),
        n(F.col("_there") & F.col("_wanted") & ~F.col("_own").eqNullSafe(F.col("_text"))).alias("changed"),
        n(F.col("_broken")).alias("broken"),
        n(F.col("_dim")).alias("other_dimension"),
        n(F.col("_unit")).alias("not_unit"),
    )
    out = counts.join(F.broadcast(repeated))  # one row each
    bad = ["missing", "superfluous", "changed", "broken", "other_dimension", "not_unit", "repeated"]
    return out.withColumn("valid", sum((F.col(c) for c in bad), F.lit(0)) == 0)
