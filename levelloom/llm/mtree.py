"""Exact top-k inner products by best-first search in M-trees.

Integer vectors are lifted by one coordinate to equal length, so that a larger inner product
with a query is a smaller Euclidean distance, and metric bounds apply. Routing objects from a
bounded sample divide the vectors; each division is a tree (or several, when it is large)
whose pages hold entries with their distance to the page's routing object. A page is known
by its routing object, covering radius and distance to the tree's object. A query first gets
a bound from the sample; a page is skipped without computing a distance to it where the
triangle inequality over the stored parent distances rules it out, and is visited, nearest
bound first, only while it may still hold one of the k best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from levelloom.llm.common import cut

K = 5
#: routing objects, vectors of a tree, entries of a page, queries searched together
ROUTES, TREE, PAGE, QUERIES = 64, 8192, 64, 4096
#: distances are double; bounds give way by this share so that rounding never prunes a hit
SLACK = 1e-9


def quantised(vector: Column) -> Column:
    """floor(256 x) of every component as double; null where the vector can't take part."""
    x = vector.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(x.isNotNull() & ~bad, F.transform(x, lambda v: F.floor(v * 256).cast("long")))


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    """Vectors with a last coordinate that makes their squared length ``most``."""
    rest = np.sqrt(np.maximum(0.0, most - (x * x).sum(1)))
    return np.hstack([x, rest[:, None]])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(0.0, d))


class Tree:
    """Pages of one division: routing objects chosen far apart, entries at the nearest."""

    def __init__(self, ints: np.ndarray, most: float, parent: np.ndarray, page: int = PAGE):
        x = lifted(ints.astype(np.float64), most)
        n = max(1, -(-len(x) // page))
        self.ints = ints
        picked = [int(np.argmax(distances(x, parent[None])[:, 0]))]
        near = distances(x, x[picked])[:, 0]
        home = np.zeros(len(x), np.int64)
        while len(picked) < n and near.max() > 0:
            picked.append(int(np.argmax(near)))
            d = distances(x, x[picked[-1:]])[:, 0]
            home[d < near] = len(picked) - 1
            near = np.minimum(near, d)
        self.route = x[picked]
        self.order = np.argsort(home, kind="stable")
        self.starts = np.searchsorted(home[self.order], np.arange(len(picked) + 1))
        self.near = near[self.order]  # of each entry to its page's routing object
        self.radius = np.array([near[home == i].max(initial=0.0) for i in range(len(picked))])
        self.up = distances(self.route, parent[None])[:, 0]  # parent distances
        self.slack = SLACK * (1 + 4 * np.sqrt(most))

    def search(self, q: np.ndarray, own: np.ndarray, to_parent: np.ndarray, bound: np.ndarray, ids: np.ndarray, most: float, k: int):
        """(query position, vec position, score) candidates that hold every query's k best of this tree.

        ``bound``: per query a score that k candidates are known to reach; it rises on the way.
        """
        lift = np.hstack([q, np.zeros((len(q), 1))])
        qq = (q * q).sum(1)
        bound = bound.copy()

        def reach() -> np.ndarray:
            """Distance beyond which nothing reaches the bound."""
            return np.sqrt(np.maximum(0.0, qq + most - 2 * bound)) + self.slack

        # no distance computed yet: |d(q, parent) - d(page, parent)| - radius bounds from below
        low = np.abs(to_parent[:, None] - self.up[None, :]) - self.radius[None, :]
        alive = low <= reach()[:, None]
        d = np.full(alive.shape, np.inf)
        for p in np.flatnonzero(alive.any(0)):
            rows = np.flatnonzero(alive[:, p])
            d[rows, p] = distances(lift[rows], self.route[p:p + 1])[:, 0]
        low = d - self.radius[None, :]
        order = np.argsort(low, axis=1, kind="stable")
        best = np.full((len(q), k), -np.inf)
        out = []
        active = np.arange(len(q))
        for turn in range(order.shape[1]):
            r = reach()
            active = active[low[active, order[active, turn]] <= r[active]]
            if not len(active):
                break
            page = order[active, turn]
            for p in np.unique(page):
                rows = active[page == p]
                lo, hi = self.starts[p], self.starts[p + 1]
                # stored distances spare entries whose ring no query reaches
                use = np.zeros(hi - lo, bool)
                for i in range(0, len(rows), 256):
                    some = rows[i:i + 256]
                    use |= (np.abs(d[some, p][:, None] - self.near[None, lo:hi]) <= r[some][:, None]).any(0)
                at = self.order[lo:hi][use]
                if not len(at):
                    continue
                score = q[rows] @ self.ints[at].astype(np.float64).T
                score[own[rows][:, None] == ids[at][None, :]] = -np.inf
                hit = score >= bound[rows][:, None]
                a, b = np.nonzero(hit & np.isfinite(score))
                out.append((rows[a], at[b], score[a, b]))
                top = -np.sort(-np.hstack([best[rows], score]), axis=1)[:, :k]
                best[rows] = top
                bound[rows] = np.maximum(bound[rows], top[:, k - 1])
        if not out:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        a, b, s = (np.concatenate(z) for z in zip(*out))
        keep = s >= bound[a]
        return a[keep], b[keep], s[keep]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list())


def _route(routes: np.ndarray, most: float):
    @F.pandas_udf("struct<route: int, away: double>")
    def run(vectors: pd.Series) -> pd.DataFrame:
        x = lifted(_matrix(vectors).astype(np.float64), most)
        d = distances(x, routes)
        return pd.DataFrame({"route": d.argmin(1).astype(np.int32), "away": d.min(1)})

    return run


def _bounds(routes: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, radius: np.ndarray, most: float, k: int):
    """Per query: the k-th best score in the sample, and the routes that may hold better."""

    @F.pandas_udf("struct<bound: double, routes: array<int>>")
    def run(ids: pd.Series, vectors: pd.Series) -> pd.DataFrame:
        q = _matrix(vectors).astype(np.float64)
        score = q @ sample.T.astype(np.float64)
        score[ids.to_numpy()[:, None] == sample_ids[None, :]] = -np.inf
        bound = -np.sort(-score, axis=1)[:, k - 1] if score.shape[1] >= k else np.full(len(q), -np.inf)
        d = distances(np.hstack([q, np.zeros((len(q), 1))]), routes)
        with np.errstate(invalid="ignore"):
            reach = np.sqrt(np.maximum(0.0, (q * q).sum(1) + most - 2 * bound))
        ok = d - radius[None, :] <= (reach + SLACK * (1 + 4 * np.sqrt(most)))[:, None]
        return pd.DataFrame({"bound": bound, "routes": [np.flatnonzero(o).astype(np.int32) for o in ok]})

    return run


def top_k(vectors: DataFrame, queries: Column, k: int = K, sample: int = 2048, tree: int = TREE) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best inner products of integer vectors per query.

    ``vectors`` has vec_id and embedding; ``queries`` says which rows are queries. A query is
    compared with every row but those of its own vec_id; ties go to the smaller vec_id; fewer
    candidates give fewer rows. Vectors that are null or hold null or non-finite components
    take no part, nor do rows without vec_id; vectors of unlike lengths are padded with zeros.
    Equal vectors keep the k + 1 smallest vec_ids, which is all that a query can need.
    """
    v = vectors.select("vec_id", quantised(F.col("embedding")).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).where("v IS NOT NULL AND vec_id IS NOT NULL")
    wide = v.agg(F.max(F.size("v")).alias("n")).first()["n"] or 1
    v = v.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(wide) - F.size("v"))))
    v = cut(v)
    some = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))
    rows = cut(v.select("vec_id", "v").distinct().withColumn("n", some).where(F.col("n") <= k + 1).drop("n"))
    length = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    most = float(rows.agg(F.max(length).alias("m")).first()["m"] or 0)

    # bounded sample by hash: the routing objects, and a first bound for every query
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    ids = picked["vec_id"].to_numpy(np.int64)
    ints = _matrix(picked["v"]).astype(np.int64) if len(picked) else np.zeros((0, wide), np.int64)
    if not len(ids):
        return v.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).where("false")
    routes = lifted(np.unique(ints[:ROUTES], axis=0).astype(np.float64), most)

    routed = cut(rows.select("vec_id", "v", _route(routes, most)("v").alias("r")).select("vec_id", "v", "r.*"))
    sizes = routed.groupBy("route").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()  # one row per route
    radius, trees = np.full(len(routes), -np.inf), [1] * len(routes)
    for r in sizes:
        radius[r["route"]], trees[r["route"]] = r["radius"], -(-r["n"] // tree)
    asks = v.where("asks").select("vec_id", "v").dropDuplicates(["vec_id", "v"])
    n_asks = asks.count()
    # so many trees per route, so many blocks of queries: every block meets every tree it may need
    blocks = max(1, -(-n_asks // QUERIES))
    parts = F.array(*map(F.lit, trees))
    index = routed.withColumn("tree", F.pmod(F.xxhash64("vec_id"), F.get(parts, F.col("route"))).cast("int"))
    index = index.select("route", "tree", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.col("vec_id").alias("id"), "v")
    bound = _bounds(routes, ids, ints, radius, most, k)
    asked = asks.select("vec_id", "v", bound("vec_id", "v").alias("b"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
    asked = asked.select("vec_id", "v", "block", "b.bound", F.explode("b.routes").alias("route"))
    asked = asked.select("route", F.explode(F.sequence(F.lit(0), F.get(parts, F.col("route")) - 1)).alias("tree"), "block", F.col("vec_id").alias("id"), "v", "bound")

    def search(key, entries: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if entries.empty or q.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(np.int64)
        parent = routes[int(key[0])]
        entry_ids, x = entries["id"].to_numpy(np.int64), _matrix(q["v"]).astype(np.float64)
        t = Tree(_matrix(entries["v"]).astype(np.int64), most, parent)
        to_parent = distances(np.hstack([x, np.zeros((len(x), 1))]), parent[None])[:, 0]
        own = q["id"].to_numpy(np.int64)
        a, b, s = t.search(x, own, to_parent, q["bound"].to_numpy(np.float64), entry_ids, most, k)
        found = pd.DataFrame({"query_id": own[a], "vec_id": entry_ids[b], "score": s.astype(np.int64)})
        found = found.drop_duplicates().sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        return found.groupby("query_id", sort=False).head(k)

    keys = ["route", "tree", "block"]
    found = index.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
