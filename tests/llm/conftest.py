import hashlib

import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: nulls in every column, empty, wordless and long texts, ties, repeated rows
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \n\t ", "en", "a", 4),
    (None, "the and of to in that with", "en", "a", 26),
    (None, "the and of to in that with", "en", "a", 26),
    (4, "the and of to in that with", None, "b", 26),
    (4, "the and of to in that with", None, "b", 26),
    (5, "12345 67890 !!", "en", "b", 14),
    (6, "lorem ipsum " * 30000, "en", None, 360000),
    (7, "été \U0001f600 naïve  double　space \x00 nul", "fr", "b", 30),
    (8, "x" * 50000 + " y@z", "en", "b", 50004),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows, with extra columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    d = spark.createDataFrame(ODD, DOCS)
    return d.withColumns({c: F.lit("x") for c in ("size", "key", "block", "fp", "row", "n", "spans", "hash", "component", "k1", "label", "bin", "shard")})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd_query(tmp_path_factory, odd):
    """Runs a registered query over a folder that holds the odd documents."""
    from levelloom.llm.queries import QUERIES

    path = str(tmp_path_factory.mktemp("odd"))
    odd.write.parquet(f"{path}/documents.parquet")
    odd.sparkSession.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1), (6, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    odd.sparkSession.createDataFrame([(1, "the and of"), (2, None), (None, "lorem"), (1, "x")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return lambda name: QUERIES[name](odd.sparkSession, path).collect()


def digest(spans, kinds):
    """The contract's list of (kind, start, end) and its hash, from a plain list."""
    s = ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], kinds.index(x[0]))))
    return s, hashlib.sha256(s.encode()).hexdigest()


def union_find(nodes, pairs):
    """Smallest node of each node's component."""
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}
