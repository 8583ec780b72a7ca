"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from levelloom.session import cut, scratch

#: ASCII white space, as the contracts of the text operators list it
SPACE = "\\x20\\x09-\\x0D"


def text_of(col: str = "text") -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def text_hash(col: str = "text") -> Column:
    """With ``doc_id`` this tells rows apart that share an id; equal rows stay equal."""
    return F.xxhash64(text_of(col))


def cut_packed(df: DataFrame) -> DataFrame:
    """``cut`` with a denser codec, for wide binary columns that are read once or twice."""
    path = scratch(df.sparkSession, "packed")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def runs(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Regroup the batches of a partition sorted by ``keys`` so that no run of equal keys is torn.

    Each frame given out holds one or more whole runs. At most one run and one batch are
    held, so callers bound the length of a run.
    """
    held: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        last = batch[list(keys)].iloc[-1]
        same = np.ones(len(batch), bool)
        for k in keys:
            same &= batch[k].to_numpy() == last[k]
        start = len(batch) - int(np.argmin(same[::-1])) if not same.all() else 0
        if start == 0 and held and all(held[-1][k].iloc[-1] == last[k] for k in keys):
            held.append(batch)
            continue
        done = [*held, batch.iloc[:start]]
        held = [batch.iloc[start:]]
        done = [d for d in done if len(d)]
        if done:
            yield pd.concat(done, ignore_index=True) if len(done) > 1 else done[0].reset_index(drop=True)
    if held:
        yield pd.concat(held, ignore_index=True)


def borders(*keys: np.ndarray) -> np.ndarray:
    """Positions at which runs of equal keys start, and the end."""
    if not len(keys[0]):
        return np.zeros(1, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), len(new))


def smallest_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Label of each of ``n`` nodes: the smallest position reachable by the links (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links ``(a, b)``: one row ``(node, component)`` per linked node.

    ``component`` is the smallest node reachable. Alternating star contractions: each round
    hooks every larger neighbour of a node to the smallest one, then the same among smaller
    neighbours, until every component is one star; about log(n) rounds for long chains. Each
    round writes its links to the shared folder, so lost executors cost one round at most.
    A node with very many links is only ever aggregated (combined map-side) and joined with
    its own single row. Self links and repeated links are ignored; no links give no rows.
    """
    def stars(e: DataFrame) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()

    def small_stars(e: DataFrame) -> DataFrame:
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        moved = e.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return low.select("a", F.col("m").alias("b")).union(moved).distinct()

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = state(now)
    while seen[0]:
        now = cut(small_stars(stars(now)))
        found = state(now)
        if found == seen:
            break
        seen = found
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
