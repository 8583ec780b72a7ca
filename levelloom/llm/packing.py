"""Packing token runs into fixed windows with non-negative least squares.

Whole windows of a document are sequences of their own. What is left of each document is
an item shorter than a window. Item lengths are counted in bins, all combinations of few
bins that fill a window exactly are enumerated, non-negative least squares says how often
each should be repeated to use up the histogram, the rounded counts are laid out, and the
rest is packed greedily: first by further bin combinations, then by cutting freely.

The driver sees the histogram only (one row per bin). Items get their rank within their
bin by two-level counts, and the rank alone says which window they go to.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from levelloom.llm.common import cut, cut_packed

WINDOW, END = 2048, 1
#: lengths are rounded up to this many tokens, so a planned window wastes under this much per item
BIN = 8
#: items in a planned combination
DEPTH = 3
# the split rule of byte-level vocabularies: a fixed value
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class TextIds:
    """Token ids of whole texts under a byte-level tokenizer file.

    The file's own library decides; as it is slow, texts of Latin letters without a special
    token's string take a second implementation of the same vocabulary (its ids are the order
    of its merges), which gives equal ids for them. The first is loaded when a text needs it.
    """

    _other = re.compile("[^\0-\u024f]")

    def __init__(self, path: str, end: int, dtype: str):
        import tiktoken

        self.path, self.dtype, self.end = path, dtype, end
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = {t["content"] for t in spec["added_tokens"]}
        self._special = re.compile("|".join(map(re.escape, sorted(added))) or r"(?!)")
        # byte-level vocabularies write printable bytes as themselves and the others from U+0100 on
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        self._fast = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _plain(self, text: str) -> bool:
        return (text.isascii() or not self._other.search(text)) and not self._special.search(text)

    def __call__(self, text: str) -> bytes:
        if self._plain(text):
            ids = self._fast.encode_to_numpy(text, disallowed_special=())
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        out = np.empty(len(ids) + 1, self.dtype)
        out[:-1], out[-1] = ids, self.end
        return out.tobytes()


def _tokenize(path: str, window: int, end: int, dtype: str):
    size = np.dtype(dtype).itemsize

    @F.pandas_udf("struct<doc_tokens: long, full_id: long, full: binary, rest: binary>")
    def tokenize(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ids_of = TextIds(path, end, dtype)
        context = TaskContext.get()
        task = context.partitionId() if context else 0
        made = 0
        for batch in batches:
            ids = [ids_of(text) for text in batch]
            n = np.array([len(b) // size for b in ids], np.int64)
            full = n // window
            first = made + np.cumsum(full) - full
            made += int(full.sum())
            yield pd.DataFrame({
                "doc_tokens": n, "full_id": (task + 1 << 36) + first,
                "full": [b[: f * window * size] for b, f in zip(ids, full)],
                "rest": [b[f * window * size:] for b, f in zip(ids, full)],
            })

    return tokenize


def fill_patterns(total: int, depth: int) -> list[tuple[int, ...]]:
    """All descending tuples of up to ``depth`` positive bins that add up to ``total``."""
    out: list[tuple[int, ...]] = []

    def grow(head: tuple[int, ...], left: int, most: int) -> None:
        if left == 0:
            out.append(head)
        elif len(head) == depth - 1:
            if left <= most:
                out.append((*head, left))
        else:
            for b in range(min(most, left), 0, -1):
                if b * (depth - len(head)) < left:
                    break
                grow((*head, b), left - b, b)

    grow((), total, total)
    return out


def nonnegative_least_squares(a: np.ndarray, y: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """min |a x - y| over x >= 0 by the active-set method."""
    x = np.zeros(a.shape[1])
    active = np.zeros(a.shape[1], bool)
    tol = 1e-9 * max(1.0, np.abs(y).max(initial=0.0)) * a.shape[0]
    for _ in range(rounds):
        grad = a.T @ (y - a @ x)
        grad[active] = -np.inf
        best = int(np.argmax(grad))
        if grad[best] <= tol:
            break
        active[best] = True
        while True:
            cols = np.flatnonzero(active)
            z = np.linalg.lstsq(a[:, cols], y, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[cols] = z
                break
            low = z <= 0
            step = np.min(x[cols][low] / np.maximum(x[cols][low] - z[low], 1e-300))
            x[cols] += step * (z - x[cols])
            gone = cols[(x[cols] <= tol) & low]
            x[gone] = 0
            active[gone] = False
            if not active.any():
                break
    return x


@dataclass(frozen=True)
class Plan:
    """Per bin the ranks that bin combinations take, as sorted ranges."""

    bin: np.ndarray
    low: np.ndarray  # first rank of the range
    times: np.ndarray  # slots of this bin in one window
    slot: np.ndarray  # first slot number
    first: np.ndarray  # sequence id of the first window
    covered: np.ndarray  # by bin: ranks below this are placed
    windows: int


def make_plan(histogram: np.ndarray, depth: int = DEPTH, enough: float = 0.98) -> Plan:
    """``histogram[b]`` items of bin ``b``; bins run to ``len(histogram) - 1``, the whole window."""
    total = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    laid: list[tuple[tuple[int, ...], int]] = []

    def lay(pattern: tuple[int, ...], wish: int) -> None:
        need = np.bincount(pattern, minlength=total + 1)
        used = np.flatnonzero(need)
        n = int(min(wish, (left[used] // need[used]).min()))
        if n > 0:
            left[used] -= n * need[used]
            laid.append((pattern, n))

    patterns = [p for p in fill_patterns(total, depth) if left[list(p)].all()]
    if patterns:
        a = np.zeros((total + 1, len(patterns)))
        for j, p in enumerate(patterns):
            np.add.at(a[:, j], list(p), 1.0)
        x = nonnegative_least_squares(a, left.astype(float))
        for j in np.argsort(-x, kind="stable"):
            if x[j] > 0:
                lay(patterns[j], int(x[j] + 0.5))
    # greedy: the largest bin left, then again and again the largest that still fits
    for b in range(total, 0, -1):
        while left[b]:
            spare, pattern = left.copy(), [b]
            spare[b] -= 1
            room = total - b
            while room and (fits := np.flatnonzero(spare[: room + 1])).size:
                pattern.append(int(fits[-1]))
                spare[fits[-1]] -= 1
                room -= int(fits[-1])
            if room > (1 - enough) * total:
                break
            lay(tuple(pattern), int(left[b]))
    out, at, base = [], np.zeros(total + 1, np.int64), 0
    for pattern, n in laid:
        slot = 0
        for b, m in zip(*np.unique(pattern, return_counts=True)):
            out.append((b, at[b], m, slot, base))
            at[b] += n * m
            slot += m
        base += n
    rows = np.array(sorted(out), np.int64).reshape(-1, 5)
    return Plan(*rows.T, at, base)


def _place(plan: Plan):
    """(bin, rank) to (sequence_id, slot) for ranks the plan covers."""
    starts = np.searchsorted(plan.bin, np.arange(len(plan.covered) + 1))

    @F.pandas_udf("struct<sequence_id: long, slot: long>")
    def place(bins: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        b, r = bins.to_numpy(), ranks.to_numpy()
        seq, slot = np.full(len(b), -1, np.int64), np.zeros(len(b), np.int64)
        for one in np.unique(b):
            lo, hi = starts[one], starts[one + 1]
            rows = np.flatnonzero((b == one) & (r < plan.covered[one]))
            if lo == hi or not len(rows):
                continue
            i = lo + np.searchsorted(plan.low[lo:hi], r[rows], "right") - 1
            k = r[rows] - plan.low[i]
            seq[rows] = plan.first[i] + k // plan.times[i]
            slot[rows] = plan.slot[i] + k % plan.times[i]
        return pd.DataFrame({"sequence_id": seq, "slot": slot})

    return place


def pack(
    docs: DataFrame, path: str, *, window: int = WINDOW, end: int = END, width: int = BIN, depth: int = DEPTH, dtype: str = "<u2"
) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    ``path`` names a byte-level tokenizer file that every worker can read; ``ids`` holds the
    piece's token ids as ``dtype`` (two bytes suffice for vocabularies up to 65,536). A null
    or empty text is one piece that holds the end token only. Repeated rows and null doc_ids
    are documents of their own; other columns are not read; no rows give no pieces.
    Sequence ids are unique, not gapless; offsets in a sequence are gapless from zero.
    """
    size = np.dtype(dtype).itemsize
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    made = docs.select("doc_id", _tokenize(path, window, end, dtype)(text).alias("t"))
    t = cut_packed(made.select("doc_id", "t.*", F.monotonically_increasing_id().alias("row")))
    n_full = F.floor(F.col("doc_tokens") / window)
    whole = t.where(n_full > 0).select(
        "doc_id", "doc_tokens", "full_id", "full", F.explode(F.sequence(F.lit(0), (n_full - 1).cast("int"))).alias("i")
    ).select(
        "doc_id", (F.col("i") * window).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), "doc_tokens",
        (F.col("full_id") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        F.substring(F.col("full"), F.col("i") * (window * size) + 1, F.lit(window * size)).alias("ids"),
    )

    length = F.pmod(F.col("doc_tokens"), F.lit(window))
    items = t.select("row", "doc_tokens", length.alias("length")).where("length > 0").withColumn("bin", F.ceil(F.col("length") / width).cast("int"))
    histogram = np.zeros(-(-window // width) + 1, np.int64)
    for b, n in items.groupBy("bin").count().collect():  # one row per bin at most
        histogram[b] = n
    plan = make_plan(histogram, depth)

    salts = max(16, int(histogram.sum() >> 16))
    items = items.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    base = items.groupBy("bin", "salt").count()
    before = W.partitionBy("bin").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    base = base.select("bin", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(W.partitionBy("bin", "salt").orderBy("row"))
    ranked = items.withColumn("n", rank).join(base, ["bin", "salt"])
    ranked = ranked.select("row", "length", "bin", (F.col("base") + F.col("n") - 1).alias("rank"))
    placed = cut(ranked.withColumn("at", _place(plan)("bin", "rank")).select("row", "length", "bin", "at.*"))

    in_order = W.partitionBy("sequence_id").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    planned = placed.where("sequence_id >= 0").select(
        "row", F.lit(0).cast("long").alias("from"), "length", "sequence_id", F.coalesce(F.sum("length").over(in_order), F.lit(0)).alias("offset")
    )
    rest = _chopped(placed.where("sequence_id < 0"), window, plan.windows, salts)
    ends = planned.unionByName(rest).join(t.select("row", "doc_id", "doc_tokens", "rest"), "row")
    start = F.col("doc_tokens") - F.pmod(F.col("doc_tokens"), F.lit(window)) + F.col("from")
    ends = ends.select(
        "doc_id", start.alias("start"), "length", "doc_tokens", "sequence_id", "offset",
        F.substring(F.col("rest"), (F.col("from") * size + 1).cast("int"), (F.col("length") * size).cast("int")).alias("ids"),
    )
    return whole.unionByName(ends)


def _chopped(items: DataFrame, window: int, base: int, salts: int) -> DataFrame:
    """Lay items end to end and cut at every window: an item becomes one piece or two."""
    by = items.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    sums = by.groupBy("bin", "salt").agg(F.sum("length").alias("n"))
    bins = sums.groupBy("bin").agg(F.sum("n").alias("n"))  # at most one row per bin
    earlier = W.rowsBetween(W.unboundedPreceding, -1)
    bins = bins.select("bin", F.coalesce(F.sum("n").over(earlier.orderBy("bin")), F.lit(0)).alias("bin_base"))
    sums = sums.select("bin", "salt", F.coalesce(F.sum("n").over(earlier.partitionBy("bin").orderBy("salt")), F.lit(0)).alias("salt_base"))
    inside = F.coalesce(F.sum("length").over(earlier.partitionBy("bin", "salt").orderBy("row")), F.lit(0))
    at = by.withColumn("inside", inside).join(sums, ["bin", "salt"]).join(bins, "bin").select(
        "row", "length", (F.col("bin_base") + F.col("salt_base") + F.col("inside")).alias("at")
    )
    first, last = F.floor(F.col("at") / window), F.floor((F.col("at") + F.col("length") - 1) / window)
    at = at.select("*", F.explode(F.sequence(first, last)).alias("w"))
    low = F.greatest(F.col("at"), F.col("w") * window)
    high = F.least(F.col("at") + F.col("length"), (F.col("w") + 1) * window)
    return at.select(
        "row", (low - F.col("at")).alias("from"), (high - low).alias("length"),
        (F.col("w") + base).alias("sequence_id"), (low - F.col("w") * window).alias("offset"),
    )


def checksums(dtype: str = "<u2"):
    """CRC-32 of a piece's ids written as little-endian unsigned 32-bit numbers."""

    @F.pandas_udf("long")
    def crc(ids: pd.Series) -> pd.Series:
        return pd.Series([zlib.crc32(np.frombuffer(b, dtype).astype("<u4").tobytes()) for b in ids], dtype="int64")

    return crc
