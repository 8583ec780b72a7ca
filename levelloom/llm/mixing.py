"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source's documents are put in one random order. The words a source owes (some whole
passes and a part of one) are cut into blocks along that order. A tree over the output
shards then splits the vector of blocks owed per source: each node gives a random but exact
share of every source to its left half, drawn from the multivariate hypergeometric
distribution, so all shards get equally many blocks, quotas add up exactly, and the split is
the one a full shuffle of all blocks would have made. A shard draws its blocks from the
sources' permuted block lists, where shards own disjoint ranges, and orders them locally.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from levelloom.llm.common import SPACE, cut, text_hash

WEIGHTS, MOST = (5, 2, 1), 3
#: words of a block, blocks of a shard
BLOCK_WORDS, SHARD_BLOCKS = 1 << 14, 64
#: sources whose targets are broadcast; more are joined by shuffle
FEW_SOURCES = 1 << 14
#: rows of one (source, bucket) that one task orders
BUCKET_ROWS = 1 << 12


def words(col: str = "text") -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(col).cast("string"), F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def share_out(sizes: Sequence[int], weights: Sequence[float], most: float = MOST) -> list[float]:
    """Targets by weight of the sum of ``sizes``; none above ``most`` times its size.

    What a capped source can't take is shared out again by weight among the others, until
    none is above its cap.
    """
    total = float(sum(sizes))
    capped: set[int] = set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = total - sum(most * sizes[i] for i in capped)
        scale = sum(weights[i] for i in free)
        over = [i for i in free if scale and left * weights[i] / scale > most * sizes[i]]
        if not over:
            return [float(most * sizes[i]) if i in capped else left * weights[i] / scale for i in range(len(sizes))]
        capped.update(over)


def targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size, n_docs, target, source_no of every source of ``sized`` (source, size).

    Weights repeat along the sources by code point, null last. The driver sees one row per
    source, as many as there are names; the table is marked for broadcast while it is short.
    """
    got = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")).collect()
    got.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    t = share_out([r["source_size"] for r in got], [weights[i % len(weights)] for i in range(len(got))], most) if got else []
    rows = [(r["source"], r["source_size"], r["n_docs"], x, i) for i, (r, x) in enumerate(zip(got, t))]
    goals = sized.sparkSession.createDataFrame(rows, "source string, source_size long, n_docs long, target double, source_no int")
    return F.broadcast(goals) if len(rows) <= FEW_SOURCES else goals


def _on_source(left: DataFrame, right: DataFrame) -> DataFrame:
    r = right.withColumnRenamed("source", "__ll_source")
    return left.join(r, left["source"].eqNullSafe(F.col("__ll_source"))).drop("__ll_source")


def passes(docs: DataFrame, goals: DataFrame, seed: int = 6) -> DataFrame:
    """The words each document gives: one row per document and pass it takes part in.

    ``docs`` has source, size, and key columns ``doc_id`` and ``text_hash``. Adds source_no,
    source_size, target, pass, at (words of the source before it in the pass) and taken.
    Documents without words are in no pass. All passes but the last take the whole source;
    the last stops at the target, in the middle of one document if need be.
    """
    d = _on_source(docs, goals.where("source_size > 0")).where("size > 0")
    d = d.withColumn("mix", F.xxhash64(F.lit(seed), "doc_id", "text_hash"))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / BUCKET_ROWS))
    d = d.withColumn("bucket", F.floor((F.col("mix") / F.lit(2.0**64) + 0.5) * buckets).cast("int"))
    base = d.groupBy("source_no", "bucket").agg(F.sum("size").alias("n"))
    earlier = W.rowsBetween(W.unboundedPreceding, -1)
    base = base.select("source_no", "bucket", F.coalesce(F.sum("n").over(earlier.partitionBy("source_no").orderBy("bucket")), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("size").over(earlier.partitionBy("source_no", "bucket").orderBy("mix", "doc_id", "text_hash")), F.lit(0))
    d = d.withColumn("inside", inside).join(base, ["source_no", "bucket"]).withColumn("at", F.col("base") + F.col("inside"))
    owed = F.round("target").cast("long")
    d = d.where(owed > 0).withColumn("pass", F.explode(F.sequence(F.lit(0), F.floor((owed - 1) / F.col("source_size")).cast("int"))))
    left = owed - F.col("pass") * F.col("source_size") - F.col("at")
    d = d.withColumn("taken", F.greatest(F.lit(0), F.least(F.col("size"), left)).cast("long")).where("taken > 0")
    return d.select(*docs.columns, "source_no", "source_size", "target", "pass", "at", "taken")


def part_of(rng: np.random.Generator, quotas: np.ndarray, k: int, limit: int = 500_000_000) -> np.ndarray:
    """``k`` of the blocks in ``quotas``, drawn without replacement: a multivariate hypergeometric draw.

    The generator draws from fewer than 10 ** 9 blocks. Of more, whole runs of u blocks are
    drawn first, as many as fit into ``k``, and what is missing is drawn from the blocks left
    over; where those are too few, one more run of the largest source is broken up.
    """
    total = int(quotas.sum())
    if total <= limit:
        return rng.multivariate_hypergeometric(quotas, k, method="marginals") if total else quotas.copy()
    u = -(-total // limit)
    runs, rest = quotas // u, quotas % u
    while k % u > rest.sum():
        big = int(runs.argmax())
        runs[big], rest[big] = runs[big] - 1, rest[big] + u
    whole = min(k // u, int(runs.sum()))
    drawn = rng.multivariate_hypergeometric(runs, whole, method="marginals") * u
    return drawn + part_of(rng, rest, k - whole * u, limit)


def _split(levels: int, seed: int):
    """Nodes ``levels`` deeper: each splits its quotas between two children of half its shards."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for node, first, shards, quotas in batch[["node", "first", "shards", "quotas"]].itertuples(index=False):
                now = [(int(node), int(first), int(shards), np.asarray(quotas, np.int64))]
                for _ in range(levels):
                    deeper = []
                    for n, f, s, q in now:
                        if s == 1:
                            deeper.append((n, f, s, q))
                            continue
                        half = s // 2
                        # exact halves: blocks are dealt as evenly as whole blocks allow
                        k = int(q.sum()) * half // s
                        rng = np.random.default_rng([seed, n])
                        left = part_of(rng, q, k)
                        deeper += [(2 * n, f, half, left), (2 * n + 1, f + half, s - half, q - left)]
                    now = deeper
                yield pd.DataFrame(now, columns=["node", "first", "shards", "quotas"])

    return run


def splitting_tree(spark, quotas: Sequence[int], shards: int, seed: int = 6) -> DataFrame:
    """(shard, quotas): how many blocks of every source each of ``shards`` shards takes.

    The root is one row; subtrees grow in tasks, each node from its own seeded generator, so
    the outcome depends on the seed only.
    """
    schema = "node long, first long, shards long, quotas array<long>"
    tree = spark.createDataFrame([(1, 0, shards, [int(q) for q in quotas])], schema)
    depth = max(0, shards - 1).bit_length()
    while depth > 0:
        step = min(depth, 8)
        tree = tree.mapInPandas(_split(step, seed), schema)
        depth -= step
        if depth > 0:
            tree = tree.repartition(F.col("node"))
    return tree.select(F.col("first").alias("shard"), "quotas")


def draw(given: DataFrame, seed: int = 6, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """Assign the rows of ``passes`` to output shards and to an order inside: adds shard, position.

    Documents belong to the block in which they start. A source's blocks are permuted by a
    seeded hash; position p of that order goes to the shard whose range of the source holds p.
    """
    g = given.withColumn("block", F.floor((F.col("pass") * F.col("source_size") + F.col("at")) / block_words))
    blocks = cut(g.select("source_no", "block").distinct())
    counts = blocks.groupBy("source_no").count().collect()  # one row per source
    if not counts:
        return g.select(*given.columns, F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("position"))
    quotas = [0] * (1 + max(r["source_no"] for r in counts))
    for r in counts:
        quotas[r["source_no"]] = r["count"]
    shards = max(1, -(-sum(quotas) // shard_blocks))
    tree = splitting_tree(given.sparkSession, quotas, shards, seed)
    own = tree.select("shard", F.posexplode("quotas").alias("source_no", "n")).where("n > 0")
    upto = W.partitionBy("source_no").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    own = own.withColumn("low", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    own = own.select("source_no", "shard", F.explode(F.sequence("low", F.col("low") + F.col("n") - 1)).alias("place"))
    # places of a source's blocks: two-level ranks in hash order, so no source is ordered whole
    h = F.xxhash64(F.lit(seed), "source_no", "block")
    b = blocks.withColumn("h", h).withColumn("part", F.shiftrightunsigned("h", 56))
    base = b.groupBy("source_no", "part").count()
    below = W.partitionBy("source_no").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = base.select("source_no", "part", F.coalesce(F.sum("count").over(below), F.lit(0)).alias("base"))
    rank = F.row_number().over(W.partitionBy("source_no", "part").orderBy("h", "block"))
    b = b.withColumn("rank", rank).join(base, ["source_no", "part"]).withColumn("place", F.col("base") + F.col("rank") - 1)
    dealt = b.join(own, ["source_no", "place"]).select("source_no", "block", "shard")
    inner = F.xxhash64(F.lit(seed + 1), "pass", "source_no", "at")
    return g.join(dealt, ["source_no", "block"]).select(*given.columns, "shard", inner.alias("position"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, source, size of every row."""
    return docs.select("doc_id", text_hash().alias("text_hash"), F.col("source").cast("string").alias("source"), words().alias("size"))


def mix_plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST, seed: int = 6) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, goals, draws): sized rows, targets per source, and drawn passes with shard and position.

    A null text has no words, a null source is a source of its own (last). Equal rows are told
    apart by their place in the order; the words they give add up. No rows give no draws.
    """
    rows = cut(sized(docs))
    goals = targets(rows, weights, most)
    return rows, goals, draw(cut(passes(rows, goals, seed)), seed)


def taken(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST, seed: int = 6) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of ``docs``.

    Words of equal rows (same doc_id and text) are shared evenly among them but for a remainder.
    """
    rows, goals, draws = mix_plan(docs, weights, most, seed)
    keys = [F.coalesce("doc_id", F.lit(0)).alias("k1"), F.col("doc_id").isNull().alias("k2"), F.col("text_hash").alias("k3"), F.coalesce("source", F.lit("")).alias("k4"), F.col("source").isNull().alias("k5")]
    names = ["k1", "k2", "k3", "k4", "k5"]
    got = draws.groupBy(*keys).agg(F.sum("taken").alias("given"))
    same = rows.select("*", *keys)
    n = F.count("*").over(W.partitionBy(*names))
    i = F.row_number().over(W.partitionBy(*names).orderBy("text_hash"))
    r = _on_source(same.withColumns({"n": n, "i": i}).join(got, names, "left"), goals.select("source", "source_size", "target"))
    g = F.coalesce("given", F.lit(0))
    mine = F.floor(g / F.col("n")) + F.when(F.col("i") <= F.pmod(g, F.col("n")), 1).otherwise(0)
    return r.select("doc_id", "size", "source_size", "target", mine.cast("long").alias("taken"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST, seed: int = 6) -> DataFrame:
    """The mixed rows, columns as given: a row per pass that takes the document, by shard and position.

    The one document of a source at which the target is reached is cut to the words taken;
    ``n_chars`` follows its text where the table has it. Documents without words are left out.
    """
    _, _, draws = mix_plan(docs, weights, most, seed)
    keys = ["__ll_id", "__ll_none", "__ll_hash", "__ll_source", "__ll_sourceless"]
    k = draws.select(
        F.coalesce("doc_id", F.lit(0)).alias(keys[0]), F.col("doc_id").isNull().alias(keys[1]), F.col("text_hash").alias(keys[2]),
        F.coalesce("source", F.lit("")).alias(keys[3]), F.col("source").isNull().alias(keys[4]),
        F.when(F.col("taken") < F.col("size"), F.col("taken")).alias("__ll_cut"), F.col("shard").alias("__ll_shard"), F.col("position").alias("__ll_position"),
    )
    d = docs.withColumns({
        keys[0]: F.coalesce("doc_id", F.lit(0)), keys[1]: F.col("doc_id").isNull(), keys[2]: text_hash(),
        keys[3]: F.coalesce(F.col("source").cast("string"), F.lit("")), keys[4]: F.col("source").isNull(),
    })
    # equal rows: the draws hold one entry per row and pass, so only one of them is joined
    one = d.withColumn("__ll_n", F.row_number().over(W.partitionBy(*keys).orderBy(keys[0]))).where("__ll_n = 1")
    m = one.join(k, keys)
    apart = F.regexp_extract_all("text", F.lit(f"[{SPACE}]*[^{SPACE}]+"), F.lit(0))
    head = F.array_join(F.slice(apart, F.lit(1), F.col("__ll_cut").cast("int")), "")
    m = m.withColumn("text", F.when(F.col("__ll_cut").isNull(), F.col("text")).otherwise(head))
    if "n_chars" in docs.columns:
        m = m.withColumn("n_chars", F.when(F.col("__ll_cut").isNull(), F.col("n_chars")).otherwise(F.length("text")))
    m = m.repartition("__ll_shard").sortWithinPartitions("__ll_shard", "__ll_position")
    return m.select(*docs.columns)
