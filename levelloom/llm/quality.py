"""Quality by an interpolated modified Kneser-Ney model of trusted text.

The model is over characters, every code point its own symbol. N-gram counts come from every
trusted document and grow with the text; count and context tables of all orders are sharded by
n-gram. Documents are packed into blocks: each block asks for its distinct n-grams once, these
meet the tables in joins, and their log probabilities travel back to the block. What is unseen
falls back to a second model of fixed size, over characters folded to a small alphabet.
Thresholds are quantiles of the trusted documents' cross-entropy, language by language.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from levelloom.llm.common import cut, text_of
from levelloom.session import scratch

SYMBOLS, ORDER = 64, 4
#: characters scored or counted at once; every text is read whole
CHUNK = 1 << 20
#: bytes of text after which a block of documents ends
BLOCK = 16 << 20
#: share of trusted documents that the threshold lets pass, and bits per character above that
QUANTILE, MARGIN = 0.999, 0.25
#: short texts are judged with this many characters of the trusted average added
PRIOR = 200
#: calibrating documents from which on a language is judged by its own alone
OWN_LIMIT = 100


def _folds() -> np.ndarray:
    """Symbol of each code point below 0x3000; later ones follow by the same rule."""
    out = np.zeros(0x3000, np.uint8)
    for cp in range(len(out)):
        c = chr(cp)
        if "a" <= c <= "z":
            out[cp] = 1 + cp - ord("a")
        elif "0" <= c <= "9":
            out[cp] = 27
        elif c.isspace():
            out[cp] = 0
        elif cp < 128 or not c.isalpha():
            out[cp] = 28 + cp % 12
        else:
            out[cp] = 40 + cp % 24
    return out


FOLDS = _folds()


def symbols(text: str) -> np.ndarray:
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(cp < len(FOLDS), FOLDS[np.minimum(cp, len(FOLDS) - 1)], 40 + cp % 24).astype(np.int32)


def codes(text: str) -> Iterator[np.ndarray]:
    """The n-gram code at each character of a text, white space standing before it."""
    carry = np.zeros(ORDER - 1, np.int32)
    for i in range(0, len(text), CHUNK):
        s = np.concatenate([carry, symbols(text[i:i + CHUNK])])
        n = len(s) - ORDER + 1
        out = np.zeros(n, np.int32)
        for k in range(ORDER):
            out = out * SYMBOLS + s[k:k + n]
        carry = s[len(s) - ORDER + 1:]
        yield out


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, size = [], 0

    def done():
        code, n = np.unique(np.concatenate(held), return_counts=True)
        return pd.DataFrame({"code": code.astype(np.int64), "n": n.astype(np.int64)})

    for batch in batches:
        for text in batch["text"]:
            for c in codes(text):
                held.append(c)
                size += len(c)
                if size >= 4 * CHUNK:
                    yield done()
                    held, size = [], 0
    if held:
        yield done()


def ngram_counts(trusted: DataFrame) -> DataFrame:
    """(code, n) of all n-grams of the column ``text``."""
    return trusted.select(text_of().alias("text")).where("text != ''").mapInPandas(_count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts for counts of one, two, and three or more."""
    found = {r["n"]: r["count"] for r in counts.where("n <= 4").groupBy("n").count().collect()}
    n1, n2, n3, n4 = (found.get(i, 0) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return [min(max(d, 0.05), i - 0.05) for i, d in enumerate(raw, 1)]


def model(trusted: DataFrame) -> np.ndarray:
    """The folded model of the column ``text``, see ``smoothed``."""
    return smoothed(ngram_counts(trusted))


def smoothed(ngrams: DataFrame) -> np.ndarray:
    """-log2 p of every folded n-gram of the highest order, as a table of SYMBOLS ** ORDER half floats.

    Counts below the highest order are continuation counts. Each order's seen n-grams meet
    their context's totals in a join on the context; what is unseen takes the context's spare
    mass times the next lower order. Without any trusted text all n-grams are alike.
    """
    table = np.full(SYMBOLS, 1.0 / SYMBOLS, np.float32)
    counts = [cut(ngrams)]
    for k in range(ORDER - 1, 0, -1):
        counts.insert(0, counts[0].groupBy((F.col("code") % SYMBOLS**k).alias("code")).agg(F.count("*").alias("n")))
    for k, c in enumerate(counts, 1):
        d = _discounts(c)
        off = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        c = c.withColumn("context", F.floor(F.col("code") / SYMBOLS)).withColumn("off", off)
        total = c.groupBy("context").agg(F.sum("n").alias("total"), F.sum("off").alias("spare"))
        rows = c.join(total, "context").select("code", ((F.col("n") - F.col("off")) / F.col("total")).alias("own"), (F.col("spare") / F.col("total")).alias("spare"))
        got = {c: v.to_numpy() for c, v in zip(("code", "own", "spare"), rows.toArrow().columns)}  # SYMBOLS ** k rows at most
        code = got["code"].astype(np.int64)
        spare = np.ones(SYMBOLS ** (k - 1), np.float32)
        spare[code // SYMBOLS] = got["spare"].astype(np.float32)
        lower = table.reshape(-1, SYMBOLS)
        lower = np.tile(lower, (SYMBOLS ** (k - 1) // len(lower), 1))  # a context's suffix is its number's low part
        table = (spare[:, None] * lower).reshape(-1)
        table[code] += got["own"].astype(np.float32)
    return (-np.log2(np.maximum(table, 1e-7))).astype(np.float16)


def chunks(texts: Sequence[str]) -> Iterator[tuple[np.ndarray, list[str], np.ndarray]]:
    """For parts of the texts: text number of each character, the distinct n-grams, and which of them ends at it.

    Spaces stand before a text. Every character of every text is in exactly one part.
    """
    def part():
        cp = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        size = np.array([len(h) for h in held])
        ends = np.cumsum(size)
        real = np.ones(len(cp), bool)  # whether an n-gram starts here and ends in the same text
        for k in range(1, ORDER):
            real[ends - k] = False
        pairs, pair = np.unique(cp[:-1] << 21 | cp[1:], return_inverse=True)
        at = np.flatnonzero(real)
        found, which = np.unique(pair[at] << 21 | pair[at + 2], return_inverse=True)
        first, second = pairs[found >> 21], pairs[found & 0x1FFFFF]
        each = np.stack([first >> 21, first & 0x1FFFFF, second >> 21, second & 0x1FFFFF], 1).astype("<u4")
        s = each.tobytes().decode("utf-32-le", "surrogatepass")
        return np.repeat(owner, size - ORDER + 1), [s[i:i + ORDER] for i in range(0, len(s), ORDER)], which

    held, owner, size = [], [], 0
    for i, text in enumerate(texts):
        text = " " * (ORDER - 1) + text
        for a in range(0, len(text) - ORDER + 1, CHUNK):
            held.append(text[a:a + CHUNK + ORDER - 1])
            owner.append(i)
            size += len(held[-1])
            if size >= CHUNK:
                yield part()
                held, owner, size = [], [], 0
    if held:
        yield part()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size, n = [], 0, 0
    first = TaskContext.get().partitionId() << 33

    def row():
        t = pa.Table.from_batches(held).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.select(["text"]).schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
            out.write_table(t.select(["text"]))
        lists = [pa.ListArray.from_arrays(pa.array([0, len(t)], pa.int32()), pa.concat_arrays(t[c].chunks)) for c in ("doc_id", "lang")]
        return pa.RecordBatch.from_arrays([pa.array([first + n]), *lists, pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "doc_ids", "langs", "texts"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
            if size >= BLOCK:
                yield row()
                held, size, n = [], 0, n + 1
    if held:
        yield row()


def _texts(packed: bytes) -> list[str]:
    return pa.ipc.open_stream(packed).read_all()["text"].to_pylist()


def _count_picked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for packed, picked in zip(batch["texts"], batch["picked"]):
            texts = _texts(packed)
            for _, grams, which in chunks([texts[i] for i in picked]):
                yield pd.DataFrame({"gram": grams, "n": np.bincount(which, minlength=len(grams))})


def _distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for block, packed in zip(batch["block"], batch["texts"]):
            grams = sorted({g for _, found, _ in chunks(_texts(packed)) for g in found})
            for a in range(0, len(grams), 100_000):
                yield pd.DataFrame({"block": block, "gram": grams[a:a + 100_000]})


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            texts = _texts(batch["texts"][r].as_py())
            known = batch["known"][r]
            known = dict(zip(known["gram"].as_py(), known["bits"].as_py())) if known.is_valid else {}
            total = np.zeros(len(texts))
            for owner, grams, which in chunks(texts):
                each = np.array([known[g] for g in grams])
                total += np.bincount(owner, each[which], len(texts))
            n = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_ids"][r].values, batch["langs"][r].values, n, pa.array(total)], ["doc_id", "lang", "n", "bits"])


def bucketed(df: DataFrame, key: str) -> tuple[DataFrame, Callable[[], object]]:
    """``cut`` into buckets of ``key``, so that joins on it move the other side only; and what ends it."""
    spark, name = df.sparkSession, f"levelloom_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, key).option("path", scratch(spark, "buckets")).format("parquet").saveAsTable(name)
    return spark.table(name), lambda: spark.sql(f"DROP TABLE {name}")


def folded(gram: Column) -> Column:
    """The folded code of an n-gram of single characters."""
    @F.pandas_udf("long")
    def run(grams: pd.Series) -> pd.Series:
        cp = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), "<u4")
        kinds, at = np.unique(cp, return_inverse=True)
        s = np.array([symbols(chr(c))[0] for c in kinds], np.int64)[at].reshape(-1, ORDER)
        return pd.Series(s @ SYMBOLS ** np.arange(ORDER - 1, -1, -1, dtype=np.int64))

    return run(gram)


def _class_bits() -> np.ndarray:
    """log2 of how many code points share each symbol."""
    kinds = np.array([symbols(chr(c))[0] for c in range(len(FOLDS))])
    return np.log2(np.bincount(kinds, minlength=SYMBOLS) + np.bincount(40 + np.arange(len(FOLDS), 0x110000) % 24, minlength=SYMBOLS))


def gram_bits(wanted: DataFrame, counts: DataFrame) -> DataFrame:
    """(gram, bits): -log2 p of each n-gram of ``wanted`` (gram, distinct) by the counts (gram, n) of trusted text.

    Counts below the highest order are continuation counts. An n-gram meets its own share and its
    context's spare mass, order by order, in joins on n-gram and context; a context that was never
    seen leaves everything to the next lower order, and the lowest one to the folded model,
    whose symbols share their mass among their code points.
    """
    spark = wanted.sparkSession
    base = smoothed(counts.groupBy(folded(F.col("gram")).alias("code")).agg(F.sum("n").alias("n")))
    base = spark.sparkContext.broadcast(base)  # half floats: every executor keeps a copy on disk
    shared = _class_bits()

    @F.pandas_udf("double")
    def unseen(codes: pd.Series) -> pd.Series:
        code = codes.to_numpy()
        return pd.Series((2.0 ** -(base.value[code] + shared[code % SYMBOLS])).astype(np.float32).astype(np.float64))

    rows, p = wanted.withColumn("p", unseen(folded(F.col("gram")))), F.col("p")
    tables = [counts]
    for k in range(ORDER - 1, 0, -1):
        tables.insert(0, cut(tables[0].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n"))))
    for k, c in enumerate(tables, 1):
        d = _discounts(c)
        off = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        c = c.withColumn(f"c{k}", F.substring("gram", 1, k - 1)).withColumn("off", off)
        total = c.groupBy(f"c{k}").agg(F.sum("n").alias(f"total{k}"), (F.sum("off") / F.sum("n")).alias(f"spare{k}"))
        own = c.select(F.col("gram").alias(f"g{k}"), (F.col("n") - F.col("off")).alias(f"own{k}"))
        rows = rows.withColumn(f"g{k}", F.substring("gram", ORDER - k + 1, k)).withColumn(f"c{k}", F.substring("gram", ORDER - k + 1, k - 1))
        rows = rows.join(own, f"g{k}", "left").join(total, f"c{k}", "left")
        p = F.coalesce(F.col(f"own{k}") / F.col(f"total{k}"), F.lit(0.0)) + F.coalesce(f"spare{k}", F.lit(1.0)) * p
    return rows.select("gram", (-F.log2(p)).cast("float").alias("bits"))


def score(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """doc_id, lang, n, perplexity, threshold, kept of every row of ``docs``.

    ``labels`` (doc_id, quality, toxic) names the trusted documents: quality 1, toxic not 1.
    Every fifth of them by hash is not learned from and only calibrates.
    ``perplexity`` is per character, with PRIOR characters of the trusted average added so
    that short texts are not judged by a few characters. ``threshold`` is the quantile of the
    calibrating documents of the row's language, or of its trusted ones where that is larger,
    plus a margin; where the language has few of them, that of all where larger. A null or empty text has the
    average perplexity; a null lang is a language of its own. Repeated rows stay. Without trusted
    text everything is kept.
    """
    good = labels.where("quality = 1 AND coalesce(toxic, 0) != 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    good = good.withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0)
    named = docs.select("doc_id", F.col("lang").cast("string"), text_of().alias("text"))
    kind = named.schema["doc_id"].dataType.simpleString()
    # small partitions would make small blocks, which ask for the same n-grams over and over
    size = named.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    named = named.coalesce(max(size // BLOCK + 1, docs.sparkSession.sparkContext.defaultParallelism))
    blocks, drop = bucketed(named.mapInArrow(_pack, f"block long, doc_ids array<{kind}>, langs array<string>, texts binary"), "block")
    # the trusted ids grow with the corpus, so they meet the rows in a shuffle at every size
    ids = blocks.select("block", F.posexplode("doc_ids").alias("i", "doc_id"))
    picked = ids.join(good.where("NOT held").hint("merge"), "doc_id", "left_semi").groupBy("block").agg(F.collect_list("i").alias("picked"))
    counts = blocks.select("block", "texts").join(picked.hint("merge"), "block").select("texts", "picked").mapInPandas(_count_picked, "gram string, n long")
    counts = cut(counts.groupBy("gram").agg(F.sum("n").alias("n")))
    asked = cut(blocks.select("block", "texts").mapInPandas(_distinct, "block long, gram string"))
    found = cut(gram_bits(asked.select("gram").distinct(), counts))
    found = asked.join(found.hint("merge"), "gram").groupBy("block").agg(F.collect_list(F.struct("gram", "bits")).alias("known"))
    found = found.select("block", F.struct(F.col("known.gram").alias("gram"), F.col("known.bits").alias("bits")).alias("known"))
    rows = blocks.join(found.hint("merge"), "block", "left").select("doc_ids", "langs", "texts", "known")
    rows = cut(rows.mapInArrow(_score, f"doc_id {kind}, lang string, n long, bits double"))
    drop()
    known = good.withColumn("trusted", F.lit(True))
    rows = rows.join(known, "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    mean = rows.where("trusted").agg((F.sum("bits") / F.sum("n")).alias("m")).first()["m"]
    mean = float(mean) if mean is not None else float(np.log2(SYMBOLS))
    rows = rows.withColumn("entropy", (F.col("bits") + PRIOR * mean) / (F.col("n") + PRIOR))
    limit = F.greatest(F.percentile_approx(F.when(F.col("held"), F.col("entropy")), quantile, 10000), F.percentile_approx("entropy", quantile, 10000))
    by = rows.where("trusted").groupBy("lang").agg(limit.alias("limit"), F.sum(F.col("held").cast("long")).alias("n_held"))
    every = rows.where("trusted").agg(limit.alias("any"))  # one row
    by = by.withColumnRenamed("lang", "of")
    rows = rows.join(by, rows["lang"].eqNullSafe(F.col("of")), "left").join(F.broadcast(every), F.lit(True))
    limit = F.when(F.col("n_held") >= OWN_LIMIT, F.col("limit")).otherwise(F.greatest("limit", "any")) + margin
    return rows.select(
        "doc_id", "lang", "n", F.pow(F.lit(2.0), F.col("entropy")).alias("perplexity"), F.pow(F.lit(2.0), limit).alias("threshold"),
        F.coalesce(F.col("entropy") <= limit, F.lit(True)).alias("kept"),
    )
