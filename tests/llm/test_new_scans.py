"""Lexical search, toxicity and the manifest against brute force and held-out rows."""

import math
import os
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from levelloom.llm import lexical, manifest, toxicity
from levelloom.llm.queries import QUERIES
from tests.llm.conftest import DOCS, ODD

TERM = re.compile(lexical.TERM)
LOW = str.maketrans(manifest.UPPER, manifest.LOWER)


# ---- lexical search ---------------------------------------------------------
def ranked(docs, items, k):
    """Plain loops over (doc_id, text) and (item_id, text)."""
    terms = [(i, Counter(TERM.findall((t or "").translate(LOW)))) for i, t in docs]
    terms = [(i, c) for i, c in terms if c]
    n_docs, length = len(terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    wanted = defaultdict(set)
    for item, t in items:
        wanted[item] |= set(TERM.findall((t or "").translate(LOW)))
    out = []
    for item, ts in wanted.items():
        scores = []
        for i, c in terms:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def test_search_equals_brute_force_also_in_slices(spark, odd):
    docs = [(r[0], r[1]) for r in ODD] + [(i, f"word{i % 7} The tail-{i % 3} É{i % 2} end") for i in range(100, 180)]
    items = [(1, "the WORD1 tail é1"), (1, "end word3"), (2, None), (None, "lorem y z nul"), (3, "absent ,,"), (4, "the the of 12345"), (2**60 + 1, "Été naïve word5")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("n", "ids", "item", "score", "rank", "none", "doc")})
    q = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("x") for c in ("term", "none", "item")})
    for k, size in ((50, 1 << 20), (3, 64)):
        got = [tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in lexical.search(d, q, k, size).collect()]
        assert sorted(got, key=lambda r: (r[0] is None, r[0] or 0, r[1])) == ranked(docs, items, k)


def test_search_of_empty_tables(spark, none):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(none, items).count() == 0
    assert lexical.search(none, items.where("false")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbB1é \n-_中", max_size=60))
def test_automaton_counts_whole_terms_only(text):
    terms = ["a", "ab", "b1", "é", "aa", "中"]
    n, found = lexical.term_counts(lexical.automaton([t.encode() for t in terms]), text.encode())
    want = Counter(TERM.findall(text.translate(LOW)))
    assert n == sum(want.values()) and {terms[i]: c for i, c in found.items()} == {t: want[t] for t in terms if want[t]}


# ---- manifest ---------------------------------------------------------------
def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def path(levels, i):
    out = []
    for row in levels[:-1]:
        a = i - i % 8
        out.append(("".join(row[a:i]), "".join(row[i + 1:a + 8])))
        i //= 8
    return out


def proofs(rows):
    groups = defaultdict(list)
    for r in rows:
        doc_id, text, lang, source, n = r
        changed = leaf_of(doc_id, source, lang, n, text and text.translate(LOW)) if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 else None
        groups[lang].append((doc_id is not None, doc_id or 0, leaf_of(doc_id, source, lang, n, text), changed))
    langs = sorted(groups, key=lambda v: (v is not None, (v or "").encode()))
    trees = [tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in langs]
    top = tree([t[-1][0] for t in trees])
    out = []
    for k, g in enumerate(langs):
        for i, (some, doc_id, leaf, changed) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            p = path(trees[k], i) + path(top, k)
            f = changed or leaf
            for a, b in p:
                f = h(a, f, b)
            out.append((doc_id if some else None, leaf, trees[k][-1][0], top[-1][0], h(*[a + b for a, b in p]), f, f == top[-1][0]))
    return sorted(out, key=repr)


def check(spark, rows, frame=None):
    d = frame if frame is not None else spark.createDataFrame(rows, DOCS)
    assert sorted(map(tuple, manifest.manifest(d).collect()), key=repr) == proofs(rows)


def test_manifest_of_odd_rows(spark, odd):
    check(spark, ODD, odd.withColumns({c: F.lit("x") for c in ("g", "id", "leaf", "slot", "word", "bits", "node", "root", "path")}))


def test_manifest_over_sparse_negative_and_repeated_ids(spark):
    ids = [-(2**63), 2**63 - 1, -1, 0, 63, 64, 65, 1 << 15, 1 << 16, (1 << 16) + 1, 1 << 32, (1 << 48) + 5, -(1 << 20), 7, 7, 7, None, None, None]
    rows = [(i, f"Text {k}", ("en", "é", None)[k % 3], "s", k) for k, i in enumerate(ids * 2)] + [(7, "Text", "en", "s", 1)] * 30 + [(None, "T", "en", None, None)] * 9
    check(spark, rows)


def test_manifest_over_several_slot_arrays(spark):
    n = manifest.SPAN + 700
    rows = [((i * 7919) % 100_003 * 3 - 5000, f"T{i}", "en" if i % 40 else f"l{i % 1000}", "s", i) for i in range(n)]
    check(spark, rows)


def test_manifest_of_one_row_and_none(spark, none):
    check(spark, [(3, "ABC", "en", "s", 3)])
    assert manifest.manifest(none).count() == 0


# ---- toxicity ---------------------------------------------------------------
def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = QUERIES["op12_toxicity"](spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    caught = [r.predicted for r in held if truth[r.doc_id]]
    clean = [r.predicted for r in held if not truth[r.doc_id]]
    assert np.mean(clean) <= 0.02 and np.mean(caught) >= 0.6, (np.mean(caught), np.mean(clean))  # some 300 toxic texts to learn from


def test_toxicity_of_odd_rows(spark, odd_query, none, odd):
    got = odd_query("op12_toxicity")
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[1] == by[2] == by[3]
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(none, labels).count() == 0
    assert not any(r.predicted for r in toxicity.score(odd, labels).collect())


def test_pooling_runs_over_the_whole_text(monkeypatch):
    texts = ["the fine end of it " * 6 + w for w in ("scum", "hen")] * 30
    m = toxicity.train(texts, [1, 0] * 30, ["en"] * 60, [1.0] * 60)
    scorer = toxicity.Scorer(m)
    long = "the fine end of it " * 70_000
    assert scorer([long + " scum"])[0] > 0.3 > scorer([long + " hen"])[0]
    whole = scorer.pooled("a bb scum the " * 50)[0]
    monkeypatch.setattr(toxicity, "WORDS", 7)
    monkeypatch.setattr(toxicity, "CHUNK", 11)
    assert np.allclose(scorer.pooled("a bb scum the " * 50)[0], whole, atol=1e-5)


def test_limit_lies_in_the_cheapest_widest_gap():
    z, y = np.array([0.0, 1.0, 4.0, 5.0]), np.array([0, 0, 1, 1])
    assert toxicity.best_limit(z, y, np.ones(4)) == 2.5
    assert toxicity.best_limit(z, np.array([0, 1, 0, 1]), np.array([1.0, 1, 9, 1])) == 4.5


def test_toxicity_learns_in_a_task(spark, monkeypatch):
    real = toxicity.train

    def train(*rows):
        model = real(*rows)
        model.scale = float(os.getpid())
        return model

    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(toxicity, "train", train)
    model = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    assert np.isfinite(model.limits).all() and model.scale not in (1.0, os.getpid())
