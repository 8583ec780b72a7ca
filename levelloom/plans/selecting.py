"""Exact selection of the first rows by value without ordering the whole table.

Rows are counted by narrow ranges of the value first (combined map-side). The counts tell
in which range the cut lies; every range before it is taken as it is, and only rows of the
cut range are ordered. The row data is filtered where it lies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: ranges per doubling of a hash: a cut range holds about a hundredth of what is selected
FINENESS = 64


def hash_range(value: Column | str) -> Column:
    """Range number of a hash that is not negative; ranges double, so small hashes lie in narrow ones."""
    v = F.col(value) if isinstance(value, str) else value
    return F.floor(F.log2(v.cast("double") + 1) * FINENESS).cast("int")


def first_rows(df: DataFrame, keys: Sequence[str], n: Column | int, bucket: Column, order: Sequence[Column], few_keys: bool = False) -> DataFrame:
    """The first ``n`` rows of each key by ``order``; exactly ``n`` where there are as many.

    ``bucket`` must not decrease along ``order``. ``n`` may be an expression over ``keys`` and
    columns that are constant for a key. Without keys the whole table is one group. Only the
    rows of a key's cut bucket are ordered, so the narrower the buckets the better. Callers
    who can bound the number of keys say ``few_keys``: the cuts (one row per key) are then
    broadcast, and rows are filtered where they lie.
    """
    ks = list(keys)
    rows = df.withColumns({"_bucket": bucket, "_limit": (F.lit(n) if isinstance(n, int) else n).cast("long")})
    sizes = rows.groupBy(*ks, "_bucket").agg(F.count("*").alias("_size"), F.max("_limit").alias("_limit"))
    before = W.partitionBy(*ks).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).where("_before < _limit")
    cuts = sizes.groupBy(*ks).agg(F.max("_bucket").alias("_cut"), F.max_by(F.col("_limit") - F.col("_before"), "_bucket").alias("_rest"))
    if ks:
        rows = rows.drop("_limit").join(F.broadcast(cuts) if few_keys else cuts, ks).where("_bucket <= _cut")
    else:  # one row, as a constant of the filter
        one = cuts.select(F.struct("_cut", "_rest").alias("c")).scalar()
        rows = rows.drop("_limit").withColumns({"_cut": one["_cut"], "_rest": one["_rest"]}).where("_bucket <= _cut")
    whole = rows.where("_bucket < _cut")
    part = rows.where("_bucket = _cut").withColumn("_place", F.row_number().over(W.partitionBy(*ks).orderBy(*order))).where("_place <= _rest").drop("_place")
    return whole.unionByName(part).select(*df.columns)


def smallest(df: DataFrame, keys: Sequence[str], value: str, n: Column | int, ties: Sequence[str] = (), few_keys: bool = False) -> DataFrame:
    """The ``n`` rows of each key with the smallest hash ``value`` (not negative), ties by ``ties``."""
    return first_rows(df, keys, n, hash_range(value), [F.col(value), *map(F.col, ties)], few_keys)
