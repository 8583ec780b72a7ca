"""Merkle manifest of a dataset: every document can be proved to belong to one root.

Leaves of one language ascend by doc_id. Their places come from bitmap ranks, not from a
sort: doc_ids are merged into compressed bitmaps (only the 64-bit words that are not zero),
a directory of popcounts adds up the words of a chunk, and directories of chunk totals add
up the chunks, 65,536 at most under one parent. The rank of a doc_id is the sum of the
directory entries above it plus the bits below its own.

Leaves then meet in slot arrays keyed by (language, slot / 4096), so four levels of the
tree are hashed at once and a tree over a billion leaves takes three rounds. A second walk,
from the root down, hands every array the siblings above it.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from levelloom.llm.common import cut

FAN = 8
#: levels hashed inside one slot array, and the slots of such an array
DEPTH = 4
SPAN = FAN**DEPTH
#: copies of one row that are numbered at once
COPIES = 1 << 12
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_GROUP = ["g", "some"]


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


# ---- leaves -----------------------------------------------------------------
def _field(value: Column) -> Column:
    v = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))


def _leaf(text: Column) -> Column:
    fields = [*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars")), text]
    return F.unhex(F.sha2(F.concat(*map(_field, fields)), 256))


def tampered() -> Column:
    """Documents whose text is tampered with in the check; a null doc_id never is."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """(g, some, id, leaf, changed): ``g`` sorts as lang does, null first; ``some`` is false for a null doc_id."""
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("g"),
        F.col("doc_id").isNotNull().alias("some"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"),
        _leaf(F.col("text")).alias("leaf"), F.when(tampered(), _leaf(F.translate(F.col("text").cast("string"), UPPER, LOWER))).alias("changed"),
    )


# ---- coordinates ------------------------------------------------------------
def _earlier(df: DataFrame, parent: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the siblings that come before, inside one parent."""
    before = W.partitionBy(*parent).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(value).over(before), F.lit(0)))


def bitmap(ids: DataFrame) -> DataFrame:
    """The bitmap of each group with its popcount directory: one row per word that is not zero.

    ``ids`` (g, some, id, n) has a row per doc_id with the number of its rows. Result: (g,
    some, word, bits, base, repeats), where ``base`` is the number of rows before the word
    in its group and ``repeats`` lists the bits that stand for several rows (64 at most).
    """
    bit = F.col("id").bitwiseAND(63).cast("int")
    one = F.expr("shiftleft(1L, CAST(id & 63 AS INT))")
    words = ids.groupBy(*_GROUP, F.shiftright("id", 6).alias("word")).agg(
        F.bit_or(one).alias("bits"), F.sum("n").alias("total"),
        F.collect_list(F.when(F.col("n") > 1, F.struct(bit.alias("bit"), (F.col("n") - 1).alias("more")))).alias("repeats"),
    )
    words = cut(words.withColumn("chunk", F.shiftright("word", 10)))
    chunks = words.groupBy(*_GROUP, "chunk").agg(F.sum("total").alias("total")).withColumn("mid", F.shiftright("chunk", 16))
    mids = chunks.groupBy(*_GROUP, "mid").agg(F.sum("total").alias("total")).withColumn("top", F.shiftright("mid", 16))
    tops = mids.groupBy(*_GROUP, "top").agg(F.sum("total").alias("total"))
    tops = _earlier(tops, ["g"], ["some", "top"], "total", "in_group").drop("total")
    mids = _earlier(mids, [*_GROUP, "top"], ["mid"], "total", "in_top").drop("total").join(tops, [*_GROUP, "top"])
    chunks = _earlier(chunks, [*_GROUP, "mid"], ["chunk"], "total", "in_mid").drop("total").join(mids, [*_GROUP, "mid"])
    words = _earlier(words, [*_GROUP, "chunk"], ["word"], "total", "in_chunk").join(chunks, [*_GROUP, "chunk"])
    base = F.col("in_chunk") + F.col("in_mid") + F.col("in_top") + F.col("in_group")
    return words.select(*_GROUP, "word", "bits", base.alias("base"), "repeats")


def rank() -> Column:
    """Rows before ``id`` in its group, from the columns of its word."""
    below = F.expr("bit_count(bits & ~shiftleft(-1L, CAST(id & 63 AS INT)))")
    more = F.expr("aggregate(filter(repeats, r -> r.bit < (id & 63)), 0L, (s, r) -> s + r.more)")
    return F.col("base") + below + more


def slots(rows: DataFrame) -> DataFrame:
    """(g, slot, some, id, leaf, changed) of every row, slots without gaps from 0 in each group.

    Rows that share a doc_id are ordered by leaf; to split them when they are many, their
    leaves are counted by prefix first. Equal rows are counted, and numbered in parts.
    """
    kinds = cut(rows.groupBy(*_GROUP, "id", "leaf", "changed").agg(F.count("*").alias("n")))
    ids = cut(kinds.groupBy(*_GROUP, "id").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")))
    key = [*_GROUP, "id"]
    tied = kinds.join(ids.where("kinds > 1").select(*key), key).withColumn("prefix", F.substring(F.hex("leaf"), 1, 4))
    parts = _earlier(tied.groupBy(*key, "prefix").agg(F.sum("n").alias("total")), key, ["prefix"], "total", "before")
    tied = _earlier(tied, [*key, "prefix"], ["leaf"], "n", "inside").join(parts, [*key, "prefix"])
    tied = tied.select(*key, "leaf", (F.col("before") + F.col("inside")).alias("offset"))
    placed = kinds.withColumn("word", F.shiftright("id", 6)).join(bitmap(ids), [*_GROUP, "word"]).withColumn("slot", rank())
    placed = placed.join(tied, [*key, "leaf"], "left").withColumn("slot", F.col("slot") + F.coalesce("offset", F.lit(0)))
    out = [*key, "leaf", "changed"]
    once = placed.where("n = 1").select("g", "slot", *out[1:])
    many = placed.where("n > 1").withColumn("part", F.explode(F.expr(f"sequence(0L, (n - 1) div {COPIES})")))
    many = many.repartition(*key, "leaf", "part")
    copy = F.explode(F.expr(f"sequence(part * {COPIES}, least(n, (part + 1) * {COPIES}) - 1)"))
    many = many.withColumn("copy", copy).select("g", (F.col("slot") + F.col("copy")).alias("slot"), *out[1:])
    return once.unionByName(many)


# ---- levels -----------------------------------------------------------------
def depth(n: int) -> int:
    """Levels that an array hashes in a group of ``n`` nodes."""
    if n > SPAN:
        return DEPTH
    d = 0
    while FAN**d < n:
        d += 1
    return d


def grow(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes and the ``levels`` levels above them."""
    out = [nodes]
    for _ in range(levels):
        last = out[-1]
        out.append([digest("".join(last[i:i + FAN])) for i in range(0, len(last), FAN)])
    return out


def paths(levels: list[list[str]], above: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    """For each node of the lowest level: the siblings (left, right) of its path, from the bottom up to the root."""
    out = [above] * len(levels[-1])
    for row in reversed(levels[:-1]):
        below = []
        for i in range(len(row)):
            a = i - i % FAN
            below.append([("".join(row[a:i]), "".join(row[i + 1:a + FAN])), *out[i // FAN]])
        out = below
    return out


def pack(path: list[tuple[str, str]]) -> str:
    return ",".join(f"{a}.{b}" for a, b in path)


def unpack(path: str) -> list[tuple[str, str]]:
    return [tuple(p.split(".")) for p in path.split(",")] if path else []


def climb(node: str, path: list[tuple[str, str]]) -> str:
    for a, b in path:
        node = digest(a + node + b)
    return node


def _up(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("slot", kind="stable")
    n = int(pdf["n"].iloc[0])
    top = grow([h.hex() for h in pdf["node"]], depth(n))[-1]
    return pd.DataFrame({"g": [pdf["g"].iloc[0]], "slot": [int(pdf["slot"].iloc[0]) // SPAN], "node": [bytes.fromhex(top[0])]})


def _siblings(nodes: pd.DataFrame, above: pd.DataFrame) -> tuple[pd.DataFrame, list[list[tuple[str, str]]]]:
    nodes = nodes.sort_values("slot", kind="stable")
    levels = grow([h.hex() for h in nodes["node"]], depth(int(nodes["n"].iloc[0])))
    return nodes, paths(levels, unpack(above["path"].iloc[0]))


def _down(nodes: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
    if nodes.empty or above.empty:
        return pd.DataFrame({"g": [], "block": [], "path": []})
    nodes, found = _siblings(nodes, above)
    return pd.DataFrame({"g": nodes["g"].to_numpy(), "block": nodes["slot"].to_numpy(), "path": [pack(p) for p in found]})


_PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _prove(nodes: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
    names = [c.split()[0] for c in _PROOFS.split(", ")]
    if nodes.empty or above.empty:
        return pd.DataFrame({c: [] for c in names})
    nodes, found = _siblings(nodes, above)
    subroot, root = above["subroot"].iloc[0], above["root"].iloc[0]
    out = []
    for leaf, changed, path in zip(nodes["node"], nodes["changed"], found):
        folded = climb((leaf if changed is None else changed).hex(), path)
        out.append((leaf.hex(), subroot, root, digest("".join(a + b for a, b in path)), folded, folded == root))
    proofs = pd.DataFrame(out, columns=names[1:])
    proofs.insert(0, "doc_id", nodes["id"].astype("Int64").where(nodes["some"]).array)  # never through floats
    return proofs


def _sized(nodes: DataFrame) -> DataFrame:
    n = nodes.groupBy("g").agg(F.count("*").alias("n"))
    return nodes.join(n, "g").withColumn("block", F.floor(F.col("slot") / SPAN).cast("long"))


def reduce(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables of slot arrays (g, slot, node, n, block), lowest first, and the root (g, node) of every group.

    Each round leaves one node of 4,096, until no group has more than one array.
    """
    tables = []
    while True:
        here = cut(_sized(nodes).repartition("g", "block"))
        tables.append(here)
        nodes = cut(here.select("g", "block", "slot", "node", "n").groupBy("g", "block").applyInPandas(_up, "g string, slot long, node binary"))
        if (here.agg(F.max("n")).first()[0] or 0) <= SPAN:
            return tables, nodes.select("g", "node")


def _meet(here: DataFrame, above: DataFrame, fn, schema: str) -> DataFrame:
    return here.groupBy("g", "block").cogroup(above.groupBy("g", "block")).applyInPandas(fn, schema)


def manifest(docs: DataFrame) -> DataFrame:
    """The proof of every row of ``docs`` (doc_id, source, lang, n_chars, text); extra columns are not read.

    Result: doc_id, leaf, subroot (of the row's lang), root, proof_sha256 (hash of all
    siblings up to the root), folded_root (from the tampered leaf, where the check tampers
    with the row) and verified. A null in any column is hashed as such; null langs are a
    group, which comes first, and null doc_ids come first in their group. Rows that share a
    doc_id are ordered by leaf, equal rows take a slot each. No rows give no rows.
    """
    placed = slots(cut(leaves(docs)))
    tables, subroots = reduce(placed.withColumnRenamed("leaf", "node"))
    # langs are ranked like words of a directory: by their first bytes, then inside those
    named = subroots.withColumn("head", F.substring(F.hex(F.col("g").cast("binary")), 1, 6))
    heads = named.groupBy("head").agg(F.count("*").alias("total"))
    heads = _earlier(heads.withColumn("all", F.lit(0)), ["all"], ["head"], "total", "before")
    named = _earlier(named.withColumn("one", F.lit(1)), ["head"], ["g"], "one", "inside").join(heads, "head")
    named = cut(named.select("g", "node", (F.col("before") + F.col("inside")).alias("slot")))
    over, top = reduce(named.select(F.lit("").alias("g"), "slot", "node", F.col("g").alias("lang")))
    above = top.select("g", F.lit(0).cast("long").alias("block"), F.lit("").alias("path"))
    for table in reversed(over):
        above = cut(_meet(table.select("g", "block", "slot", "node", "n"), above, _down, "g string, block long, path string"))
    root = top.select(F.lower(F.hex("node")).alias("root"))
    ends = named.join(above.select(F.col("block").alias("slot"), "path"), "slot").crossJoin(root)  # the root is one row
    ends = cut(ends.select("g", F.lit(0).cast("long").alias("block"), "path", F.lower(F.hex("node")).alias("subroot"), "root"))
    above = ends.select("g", "block", "path")
    for table in reversed(tables[1:]):
        above = cut(_meet(table.select("g", "block", "slot", "node", "n"), above, _down, "g string, block long, path string"))
    above = above.join(ends.select("g", "subroot", "root"), "g")
    return _meet(tables[0].select("g", "block", "slot", "node", "n", "some", "id", "changed"), above, _prove, _PROOFS)
