"""SimHash near-duplicates through deletion-variant signatures.

A 64-bit fingerprint is cut into three segments. Two fingerprints that differ in at most
four bits differ in at most one bit of some segment, so if each segment is stored once
per position with that position blanked, they share a stored variant. Variants meet in
an equality shuffle and every meeting is verified on the whole fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from levelloom.llm.common import borders, components, cut, runs, smallest_labels, text_hash

BITS, WORDS, SEED = 64, 4, 42
#: fingerprints of one variant that one task compares; larger groups are split into blocks
BLOCK = 2048
#: fingerprints that are compared with a whole run at once
STRIP = 64
#: shingles whose bits are counted at once
CHUNK = 1 << 16


def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, width) of the fewest segments of which one differs by at most one bit."""
    n = distance // 2 + 1
    at = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:])]


def fingerprint(text: str | None) -> int:
    """Fingerprint of one text as an unsigned number; none or no word gives zero."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= WORDS:
        return digest(joined, SEED)
    ends = list(accumulate(map(len, words), lambda at, n: at + 1 + n))
    starts = [0] + [e + 1 for e in ends]
    spans = list(zip(starts, ends[WORDS - 1:]))
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(spans), CHUNK):
        h = np.array([digest(joined[s:e], SEED) for s, e in spans[i:i + CHUNK]], "<u8")
        ones += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(spans), bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64), dtype="int64")


def _variants(distance: int) -> Column:
    """All (variant, blanked segment) keys of the column ``fp``, packed in one long each."""
    out = []
    for first, width in segments(distance):
        value = F.shiftrightunsigned(F.col("fp"), first).bitwiseAND(F.lit((1 << width) - 1))
        for i in range(width):
            out.append(value.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << i))).bitwiseOR(F.lit((first + i) << 40)))
    return F.array(*out)


def _canonical(key: np.ndarray, diff: np.ndarray, distance: int) -> np.ndarray:
    """Whether this variant is the one that reports the pair: each link is reported once."""
    bit = (key >> 40).astype(np.int64)
    ok = np.bitwise_count(diff) <= distance
    for first, width in segments(distance):
        mine = (bit >= first) & (bit < first + width)
        part = (diff >> np.uint64(first)) & np.uint64((1 << width) - 1)
        near = np.bitwise_count(part) <= 1
        blank = np.where(part == 0, bit == first, part == np.uint64(1) << (bit - first).clip(0, 63).astype(np.uint64))
        ok &= np.where(mine, near & blank, ~near | (bit < first))
    return ok


def _labels(f: np.ndarray, distance: int) -> np.ndarray:
    """Local component of each fingerprint of a long run; the pairs of a strip never outlive it."""
    label = np.arange(len(f))
    for j in range(0, len(f), STRIP):
        x, y = np.nonzero(np.bitwise_count(f[j:j + STRIP, None] ^ f[None, j:]) <= distance)
        a, b = label[x + j], label[y + j]
        keep = a != b
        label = smallest_labels(len(f), a[keep], b[keep])[label]
    return label


def _verify(distance: int):
    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in runs(batches, ["key", "block"]):
            key, fp = g["key"].to_numpy(), g["fp"].to_numpy().view(np.uint64)
            at = borders(key, g["block"].to_numpy())
            size = np.diff(at)
            a, b = [], []
            # short runs: compare neighbours at every lag, all runs at once
            run = np.repeat(np.arange(len(size)), size)
            short = np.repeat(size <= 32, size)
            k, f, r = key[short], fp[short], run[short]
            for lag in range(1, int(size[size <= 32].max(initial=1))):
                hit = np.flatnonzero(r[lag:] == r[:-lag])
                if not len(hit):
                    break
                x, y = f[hit], f[hit + lag]
                ok = _canonical(k[hit], x ^ y, distance)
                a.append(x[ok])
                b.append(y[ok])
            # long runs: links of a run shrink to one star per local component
            for i in np.flatnonzero(size > 32):
                f = fp[at[i]:at[i + 1]]
                label = _labels(f, distance)
                moved = label != np.arange(len(f))
                a.append(f[label[moved]])
                b.append(f[moved])
            if a:
                yield pd.DataFrame({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)})

    return links


def links(fps: DataFrame, distance: int = 4, block: int = BLOCK) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``fp`` that span all components.

    Every pair within ``distance`` bits is found. Groups of more than ``block`` fingerprints
    under one variant are split into blocks that meet in pairs, so no task holds more than
    two blocks; inside a long group the links found are reduced to stars.
    """
    v = fps.select(F.explode(_variants(distance)).alias("key"), "fp")
    hot = v.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("parts"))
    v = v.join(hot, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least(mine, j) * F.col("parts") + F.greatest(mine, j))
    v = v.select("key", "fp", F.explode(F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(pair)).alias("block"))
    v = v.repartition("key", "block").sortWithinPartitions("key", "block")
    return v.mapInPandas(_verify(distance), "a long, b long")


def _classified(docs: DataFrame, distance: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, hash, fp), and per fingerprint its component node and smallest doc_id."""
    rows = cut(docs.select("doc_id", text_hash().alias("hash"), fingerprints(F.col("text").cast("string")).alias("fp")))
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    part = components(links(classes.select("fp"), distance, block)).withColumnRenamed("node", "fp")
    named = classes.join(part, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"))
    return rows, named.join(lows, "component").select("fp", "component", "component_id")


def near_duplicates(docs: DataFrame, distance: int = 4, block: int = BLOCK) -> DataFrame:
    """Fingerprint and component of every row of ``docs``: doc_id, fingerprint, component_id, kept.

    One row per row of ``docs``; other columns are not read. A null or wordless text has
    fingerprint zero and links like any other; fewer words than a shingle are one shingle.
    Rows of one fingerprint are one node, so exact copies never meet in pairs. A null
    doc_id never names a component unless the component has no other. Repeated rows stay.
    """
    rows, named = _classified(docs, distance, block)
    return rows.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, distance: int = 4, block: int = BLOCK) -> DataFrame:
    """One document of each group stays, the one of the smallest doc_id; columns as given.

    Among rows that share this doc_id the one of the smallest text hash stays, and of equal
    rows any one. A row without doc_id stays only where its whole group has none.
    """
    rows, named = _classified(docs, distance, block)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("__ll_none"), F.coalesce("doc_id", F.lit(0)).alias("__ll_id"), F.col("hash").alias("__ll_hash")))
    keep = rows.join(named, "fp").groupBy("component").agg(best.alias("best")).select("best.*")
    keys = ["__ll_none", "__ll_id", "__ll_hash"]
    d = docs.withColumns({"__ll_none": F.col("doc_id").isNull(), "__ll_id": F.coalesce("doc_id", F.lit(0)).cast("long"), "__ll_hash": text_hash()})
    first = W.partitionBy(*keys).orderBy(*keys)
    return d.join(keep, keys).withColumn("__ll_n", F.row_number().over(first)).where("__ll_n = 1").select(*docs.columns)
