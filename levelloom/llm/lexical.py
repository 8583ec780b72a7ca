"""Ranked lexical search by one scan of the documents with an automaton of the items' terms.

All terms of the items form one Aho-Corasick automaton whose patterns carry a guard on both
sides, so only whole terms match. A scan of the texts counts term frequencies directly; no
index of the documents is made. Automaton outputs are term numbers, and a sparse matrix maps
them to the items that hold the term. The scan leaves a few bytes per document (length and
counts of matched terms); document frequencies and scores are computed from those.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from levelloom.llm.common import cut

#: bytes of terms and of (item, term) entries that one automaton and its map may hold; beyond it
#: the items are dealt into several automata, each with its own scan
SLICE_BYTES = 8 << 20
#: documents x items and (document, term, item) entries scored at once
CELLS, ENTRIES = 1 << 21, 1 << 20
#: first-level groups of an item's candidates
SALTS = 64
#: a term as the contract gives it
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normal(text: bytes) -> bytes:
    """UTF-8 bytes with A-Z lowered and everything outside terms replaced by a space."""
    return text.translate(_TERM)


def automaton(terms: list[bytes]) -> ahocorasick.Automaton:
    """Numbers of terms as outputs; each pattern is guarded by a space on both sides."""
    a = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        a.add_word(f" {t.decode('latin-1')} ", i)
    a.make_automaton()
    return a


def term_counts(a: ahocorasick.Automaton, text: bytes) -> tuple[int, dict[int, int]]:
    """Number of all terms of a text, and how often each of the automaton's occurs."""
    clean = normal(text)
    found = Counter(map(itemgetter(1), a.iter(f" {clean.decode('latin-1')} "))) if len(a) else {}
    return len(clean.split()), found


def _scan(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = shared.value
        for batch in batches:
            n, ids, tfs = [], [], []
            for text in batch["text"]:
                m, found = term_counts(a, text or b"")
                n.append(m)
                ids.append(np.fromiter(found.keys(), "<i4", len(found)).tobytes())
                tfs.append(np.fromiter(found.values(), "<i4", len(found)).tobytes())
            yield pd.DataFrame({"doc": batch["doc"], "none": batch["none"], "n": n, "ids": ids, "tfs": tfs})

    return run


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        got = np.bincount(np.frombuffer(b"".join(batch["ids"]), "<i4"))
        if len(got) > len(total):
            got, total = total, got
        total = total.astype(np.int64)
        total[:len(got)] += got
    hit = np.flatnonzero(total)
    yield pd.DataFrame({"term": hit, "df": total[hit]})


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Best:
    """The ``k`` best (score, doc) of each item seen so far."""

    def __init__(self, n_items: int, k: int):
        self.k, self.floor = k, np.zeros(n_items, np.int64)
        self.item, self.score, self.doc = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.none = np.empty(0, bool)

    def add(self, item, score, doc, none) -> None:
        self.item, self.score = np.append(self.item, item), np.append(self.score, score)
        self.doc, self.none = np.append(self.doc, doc), np.append(self.none, none)
        order = np.lexsort((self.doc, self.none, -self.score, self.item))
        at = self.item[order]
        first = np.append(0, np.flatnonzero(at[1:] != at[:-1]) + 1) if len(at) else np.empty(0, np.int64)
        place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        keep = order[place < self.k]
        self.item, self.score, self.doc, self.none = self.item[keep], self.score[keep], self.doc[keep], self.none[keep]
        full = np.bincount(self.item, minlength=len(self.floor)) >= self.k
        low = np.full(len(self.floor), np.iinfo(np.int64).max)
        np.minimum.at(low, self.item, self.score)
        self.floor = np.where(full, low, 0)


def score_block(n, counts, ids, tfs, weights, first, items, n_items, n_docs, length) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, item, score) of every positive score of a block of documents, in 64-bit integers.

    ``first`` and ``items`` are the sparse matrix: the items of term t are items[first[t]:first[t + 1]].
    """
    m = 50 + (50 * n * n_docs) // max(length, 1)
    row = np.repeat(np.arange(len(n)), counts)
    part = weights[ids] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m[row]))
    size = first[ids + 1] - first[ids]
    at = np.repeat(first[ids] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
    cell = np.repeat(row, size) * n_items + items[at]
    part = np.repeat(part, size)
    # sums of halves of 26 bits are exact in doubles; a plain sum need not be
    high, low = part >> 26, part & ((1 << 26) - 1)
    cells = len(n) * n_items
    total = (np.bincount(cell, high, cells).astype(np.int64) << 26) + np.bincount(cell, low, cells).astype(np.int64)
    hit = np.flatnonzero(total > 0)
    return hit // n_items, hit % n_items, total[hit]


def _rank(shared, n_docs: int, length: int, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, first, items, n_items = shared.value
        best = Best(n_items, k)
        reach = np.diff(first)
        for batch in batches:
            counts = np.array([len(b) // 4 for b in batch["ids"]], np.int64)
            ids = np.frombuffer(b"".join(batch["ids"]), "<i4").astype(np.int64)
            tfs = np.frombuffer(b"".join(batch["tfs"]), "<i4").astype(np.int64)
            ends = np.append(0, np.cumsum(counts))
            load = np.append(0, np.cumsum(reach[ids]))[ends]  # entries before each document
            n, docs, none = batch["n"].to_numpy(np.int64), batch["doc"].to_numpy(np.int64), batch["none"].to_numpy(bool)
            i = 0
            while i < len(n):
                j = min(i + max(1, CELLS // n_items), max(i + 1, int(np.searchsorted(load, load[i] + ENTRIES, "right")) - 1), len(n))
                cut_ = slice(ends[i], ends[j])
                row, item, score = score_block(n[i:j], counts[i:j], ids[cut_], tfs[cut_], weights, first, items, n_items, n_docs, length)
                ok = score >= best.floor[item]
                best.add(item[ok], score[ok], docs[i:j][row[ok]], none[i:j][row[ok]])
                i = j
        yield pd.DataFrame({"item": best.item, "doc": best.doc, "none": best.none, "score": best.score})

    return run


def _matrix(pairs: pd.DataFrame, n_terms: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(pairs["term"].to_numpy(), kind="stable")
    first = np.append(0, np.cumsum(np.bincount(pairs["term"], minlength=n_terms))).astype(np.int64)
    return first, pairs["item"].to_numpy(np.int64)[order]


def _search_slice(docs: DataFrame, pairs: pd.DataFrame, k: int) -> DataFrame:
    """Best documents of the items of one slice; ``pairs`` are its distinct (item, none, term)."""
    spark = docs.sparkSession
    keys = list(zip(pairs["none"], pairs["item"]))
    names = list(dict.fromkeys(keys))
    item_at = {v: i for i, v in enumerate(names)}
    terms = sorted({bytes(t) for t in pairs["term"]})
    term_at = {t: i for i, t in enumerate(terms)}
    coded = pd.DataFrame({"item": [item_at[v] for v in keys], "term": [term_at[bytes(t)] for t in pairs["term"]]}, dtype="int64")
    shared = spark.sparkContext.broadcast(automaton(terms))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    texts = docs.select(doc.alias("doc"), F.col("doc_id").isNull().alias("none"), F.col("text").cast("string").cast("binary").alias("text"))
    found = cut(texts.mapInPandas(_scan(shared), "doc long, none boolean, n long, ids binary, tfs binary").where("n > 0"))
    n_docs, length = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = found.select("ids").mapInPandas(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    weights = np.zeros(len(terms), np.int64)  # terms that no document holds are never counted
    weights[df["term"].to_numpy(np.int64)] = [weight(n_docs, d) for d in df["df"].tolist()]
    matrix = spark.sparkContext.broadcast((weights, *_matrix(coded, len(terms)), len(names)))
    near = found.mapInPandas(_rank(matrix, n_docs, length, k), "item int, doc long, none boolean, score long")
    near = near.withColumn("salt", F.pmod(F.xxhash64("doc", "score"), F.lit(SALTS)))
    order = [F.col("score").desc(), F.col("none"), F.col("doc")]
    for by in (["item", "salt"], ["item"]):
        near = near.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    ids = spark.createDataFrame([(i, None if none else int(v)) for i, (none, v) in enumerate(names)], "item int, item_id long")
    return near.join(ids, "item").select("item_id", "rank", F.when(~F.col("none"), F.col("doc")).alias("doc_id"), "score")


def search(docs: DataFrame, items: DataFrame, k: int = 50, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best rows of ``docs`` (doc_id, text) for each of ``items`` (item_id, text).

    A null or wordless text matches nothing and does not count as a document; an item
    without terms gets no rows. Rows of ``items`` that share an item_id (null is one too)
    are one item with the terms of all. Each row of ``docs`` is a document of its own, also
    where doc_ids repeat; null doc_ids come last among equal scores. Extra columns are not
    read; empty tables give no rows.

    Items whose terms take more than ``slice_bytes`` are dealt into slices by hash, so what
    is broadcast stays bounded (a single item is the least) and each slice scans the texts.
    """
    text = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    term = F.explode(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))
    item = F.coalesce(F.col("item_id").cast("long"), F.lit(0))
    pairs = cut(items.select(item.alias("item"), F.col("item_id").isNull().alias("none"), term.alias("term")).distinct())
    size = pairs.agg(F.coalesce(F.sum(F.octet_length("term") + 16), F.lit(0))).first()[0]
    parts = max(1, -(-int(size) // slice_bytes))
    out = None
    for i in range(parts):
        mine = pairs.where(F.pmod(F.xxhash64("item", "none"), F.lit(parts)) == i) if parts > 1 else pairs
        got = mine.select("item", "none", F.col("term").cast("binary").alias("term")).toPandas()
        if len(got):
            one = _search_slice(docs, got, k)
            out = one if out is None else out.unionByName(one)
    return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out

