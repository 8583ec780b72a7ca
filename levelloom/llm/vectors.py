"""Near-duplicate vectors by Euclidean p-stable hashing.

A normalised vector is projected on Gaussian directions, shifted and cut into cells of fixed
width; several cells together are a bucket key, and there are several tables of such keys.
Vectors closer than the radius that the cosine threshold implies share a bucket of some table
with a known probability; pairs that share a bucket are compared exactly in double precision.

The number of cells per key grows with the logarithm of the number of vectors, so that a
bucket holds few strangers at any size, and the number of tables follows from the wanted
miss rate, so that recall does not depend on the size.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, erf, exp, log, pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from levelloom.llm.common import borders, components, cut, runs, smallest_labels

COSINE = 0.95
#: cell width for unit vectors, share of pairs at the very threshold that may be missed
WIDTH, MISS = 2.0, 1e-3
#: vectors of one bucket that one task compares; larger buckets are split into blocks
BLOCK = 1024


def collision(distance: float, width: float = WIDTH) -> float:
    """Probability that two points at this distance share a cell of one Gaussian projection."""
    r = width / distance
    return erf(r / sqrt(2)) - 2 / (sqrt(2 * pi) * r) * (1 - exp(-r * r / 2))


def shape(n: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """(cells per key, tables) for ``n`` vectors: about one stranger in ten buckets or fewer."""
    near, far = collision(sqrt(2 - 2 * cosine)), collision(sqrt(2))
    cells = max(4, ceil(log(max(n, 2) * 10) / -log(far)))
    return cells, ceil(log(miss) / log(1 - near**cells))


class Hashes:
    """Bucket keys of unit vectors of any dimension; the same on every worker."""

    def __init__(self, cells: int, tables: int, seed: int = 1):
        self.cells, self.tables, self.seed = cells, tables, seed
        self.made: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.mult = np.random.default_rng(seed).integers(1, 2**63, cells, np.uint64) | np.uint64(1)

    def keys(self, x: np.ndarray) -> np.ndarray:
        """(vectors, tables) keys as signed numbers; the table number is mixed in."""
        dim = x.shape[1]
        if dim not in self.made:
            rng = np.random.default_rng([self.seed, dim])
            self.made[dim] = rng.normal(size=(dim, self.cells * self.tables)), rng.uniform(0, WIDTH, self.cells * self.tables)
        a, b = self.made[dim]
        cell = np.floor((x @ a + b) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(x), self.tables, self.cells)
        h = (cell * self.mult).sum(2, dtype=np.uint64) + np.arange(self.tables, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        return h.view(np.int64)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def by_length(vectors: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, matrix) of the vectors of each length."""
    size = vectors.map(len).to_numpy()
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield at, np.stack(vectors.iloc[at].to_list()).astype(np.float64)


def _keys(h: Hashes):
    @F.pandas_udf("array<long>")
    def run(vectors: pd.Series) -> pd.Series:
        out = [None] * len(vectors)
        for at, x in by_length(vectors):
            for i in range(0, len(at), 1024):
                for j, k in zip(at[i:i + 1024], h.keys(unit(x[i:i + 1024]))):
                    out[j] = k
        return pd.Series(out)

    return run


def _verify(h: Hashes, cosine: float):
    """Links of every bucket block: per vector the rows linked here first, and local stars."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in runs(batches, ["key", "row", "col"]):
            at = borders(g["key"].to_numpy(), g["row"].to_numpy(), g["col"].to_numpy())
            rep, size, out = g["rep"].to_numpy(), g["size"].to_numpy(), []
            for lo, hi in zip(at, at[1:]):
                if hi - lo < 2:
                    continue
                part = g.iloc[lo:hi]
                mine, row, col = part["part"].to_numpy(), int(part["row"].iloc[0]), int(part["col"].iloc[0])
                for pos, x in by_length(part["vector"].reset_index(drop=True)):
                    x = unit(x)
                    near = x @ x.T >= cosine - 1e-12
                    near &= ~np.eye(len(x), dtype=bool)
                    if row != col:  # pairs within one part are met in its own block
                        near &= mine[pos][:, None] != mine[pos][None, :]
                    some = np.flatnonzero(near.any(1))
                    if not len(some):
                        continue
                    # the product of two rows in a fixed order decides, the same in every block
                    a, b = np.nonzero(np.triu(near[np.ix_(some, some)]))
                    ok = np.einsum("ij,ij->i", x[some[a]], x[some[b]]) >= cosine
                    a, b = a[ok], b[ok]
                    # a pair is counted in the first table whose bucket both share
                    keys = h.keys(x[some])
                    key = part["key"].iloc[0]
                    first = np.zeros(len(a), bool)
                    for i in range(0, len(a), 1 << 16):
                        p, q = keys[a[i:i + (1 << 16)]], keys[b[i:i + (1 << 16)]]
                        table = (p == q).argmax(1)
                        first[i:i + (1 << 16)] = p[np.arange(len(p)), table] == key
                    a, b = a[first], b[first]
                    r, s = rep[lo + pos[some]], size[lo + pos[some]]
                    n = np.bincount(a, s[b], len(some)) + np.bincount(b, s[a], len(some))
                    label = smallest_labels(len(some), a, b)
                    out.append(pd.DataFrame({"rep": r, "n": n.astype(np.int64), "to": r[label]}))
            if out:
                d = pd.concat(out, ignore_index=True)
                yield d[(d["n"] > 0)]

    return run


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_vectors(vectors: DataFrame, cosine: float = COSINE, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding).

    Rows link where their cosine in double precision reaches ``cosine``. Null, empty, zero
    or non-finite vectors link with nothing, nor do vectors of different lengths. Equal
    vectors are one class (and link with each other); classes are what is hashed, so copies
    never meet in pairs. Repeated rows stay. A null vec_id names no component but its own.
    """
    rows = vectors.select("vec_id", F.when(usable(F.col("embedding").cast("array<double>")), F.col("embedding").cast("array<double>")).alias("vector"))
    classes = rows.where("vector IS NOT NULL").groupBy("vector").agg(F.min("vec_id").alias("low"), F.count("*").alias("size"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("rep"), "low", "size", "vector"))
    h = Hashes(*shape(classes.count(), cosine, miss))

    keyed = cut(classes.select("rep", F.explode(_keys(h)("vector")).alias("key")))
    shared = keyed.groupBy("key").count().where("count > 1").select("key", F.ceil(F.col("count") / block).cast("int").alias("parts"))
    met = keyed.join(shared, "key").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("key", "rep", "part", F.least("part", "other").alias("row"), F.greatest("part", "other").alias("col"))
    met = met.join(classes.select("rep", "size", "vector"), "rep").repartition("key", "row", "col").sortWithinPartitions("key", "row", "col")
    found = cut(met.mapInPandas(_verify(h, cosine), "rep long, n long, to long"))

    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    part = components(found.select(F.col("rep").alias("a"), F.col("to").alias("b"))).withColumnRenamed("node", "rep")
    named = classes.select("rep", "low", "size", "vector").join(links, "rep", "left").join(part, "rep", "left")
    named = named.withColumn("component", F.coalesce("component", "rep"))
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = named.join(lows, "component").select("vector", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    out = rows.join(named, "vector", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
