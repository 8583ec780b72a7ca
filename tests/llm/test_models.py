"""Language ID, quality, packing, mixing, top-k and the pipeline."""

import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from levelloom.llm import langid, mixing, mtree, packing, quality
from levelloom.llm.queries import QUERIES, tokenizer_path
from tests.llm.conftest import ODD, SF


def test_language_accuracy_on_held_out_rows(spark, documents):
    truth = {r.doc_id: r.lang for r in documents.collect()}
    got = QUERIES["op8_langid"](spark, SF).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.97
    assert np.mean([r.rejected for r in got]) <= 0.02


def test_language_of_odd_rows(spark, odd_query, none, odd):
    got = {r.doc_id: r for r in odd_query("op8_langid")}
    for i in (1, 2, 3, 5):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0) and got[i].rejected
    assert langid.identify(none).count() == 0
    unlearned = langid.identify(odd.limit(3)).collect()
    assert {r.lang_pred for r in unlearned} == {"und"}
    assert langid.keep_identified(odd).columns == odd.columns


def test_unlearned_languages_and_gibberish_are_rejected(spark):
    import random

    r = random.Random(8)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").where("length(text) >= 200")
    model = langid.fit(docs.where(langid.learnable()).where("lang != 'es'"))
    unseen = docs.where(~langid.learnable())
    junk = [" ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(50)) for _ in range(40)]
    junk += ["Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan ja heille on annettu järki ja omatunto"]
    rejected = lambda d: [x.p.rejected for x in d.select(langid.predict(model, F.col("text")).alias("p")).collect()]
    assert np.mean(rejected(unseen.where("lang = 'es'"))) >= 0.95
    assert all(rejected(spark.createDataFrame([(j,) for j in junk], "text string")))
    assert np.mean(rejected(unseen.where("lang != 'es'"))) <= 0.01


def test_language_profiles_stay_out_of_the_driver(documents, monkeypatch):
    def refuse(*_):
        raise AssertionError("rows in the driver")

    for name in ("toPandas", "toArrow"):
        monkeypatch.setattr(type(documents), name, refuse)
    assert langid.fit(documents.where("lang IN ('de', 'en')")).labels == ("de", "en")
    assert langid.fit(documents.where("false")).labels == ()


def test_long_texts_score_like_their_whole(spark):
    m = langid.train([langid.profile("the and of that with " * 9), langid.profile("der die und das nicht " * 9)] * 20, ["en", "de"] * 20)
    text = "the of and die nicht that " * 20000 + "9" * langid.CHUNK + " ,x" + "y" * langid.CHUNK + "  und"
    assert sorted(np.concatenate(list(langid.gram_parts(text)))) == sorted(langid._rows(np.frombuffer((" " + langid._gap.sub(" ", text).strip() + " ").encode("utf-32-le"), "<u4").astype(np.uint32), 0))
    whole = m.scores[langid.gram_rows(text)].astype(float).mean(0) + m.bias
    assert np.allclose(m.logits(text), whole, atol=1e-3)


def test_kneser_ney_sums_to_one_and_prefers_its_text(spark):
    text = "the hen then went there with the other hens and then the end came " * 5
    d = spark.createDataFrame([(text,), (None,), ("",)], "text string")
    t = 2.0 ** -quality.model(d).astype(np.float64).reshape(-1, quality.SYMBOLS)
    assert np.allclose(t.sum(1), 1, atol=5e-3)

    def cost(s):
        return np.mean(np.concatenate([-np.log2(t.reshape(-1)[c]) for c in quality.codes(s)]))

    assert cost("then the hen") < 2 < cost("zq#x7!kk")
    assert np.allclose(quality.model(d.where("false")), 6, atol=1e-2)


def test_quality_keeps_clean_and_drops_junk(spark):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op3_quality"](spark, SF).collect()}
    clean = [got[i].kept for i, r in labels.items() if r.quality == 1]
    junk = [got[i].kept for i, r in labels.items() if r.quality == 0]
    assert np.mean(clean) >= 0.99 and (not junk or np.mean(junk) <= 0.6)


def test_quality_of_odd_rows(odd_query, none, spark):
    assert len(odd_query("op3_quality")) == len(ODD)
    none_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score(none, none_labels).count() == 0


def test_quality_tells_all_characters_apart(spark):
    text = "тихо падал снег и старый дом стоял у реки где зимой никто не жил "
    shifted = "".join(chr(ord(c) + 24) if c != " " else c for c in text)  # the same symbols after folding
    assert (quality.symbols(text) == quality.symbols(shifted)).all()
    docs = spark.createDataFrame([(i, "ru", t * 9) for i, t in enumerate([text] * 8 + [shifted])], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(8)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score(docs, labels).collect()}
    assert got[0].kept and not got[8].kept and got[8].perplexity > 20 * got[0].perplexity
    assert got[8].n == len(text) * 9


def test_fallback_model_travels_as_half_floats(spark, monkeypatch):
    sent = []
    send = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value.nbytes) or send(self, value))
    quality.gram_bits(spark.createDataFrame([("then",)], "gram string"), spark.createDataFrame([("hen ", 2)], "gram string, n long"))
    assert sum(sent) <= 2 * quality.SYMBOLS**quality.ORDER


def test_gram_bits_against_plain_counting(spark):
    text = "   the hen went there; the other Hens then ate 漢字 and 漢語 and the end came"
    grams = [text[i:i + 4] for i in range(len(text) - 3)]
    tables = [None, None, None, None, Counter(grams)]
    for k in (3, 2, 1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    d = [None] + [quality._discounts(spark.createDataFrame(list(t.items()), "gram string, n long")) for t in tables[1:]]
    fold = lambda g: int(quality.symbols(g) @ quality.SYMBOLS ** np.arange(3, -1, -1))
    codes = Counter(fold(g) for g in grams)
    base = quality.smoothed(spark.createDataFrame(list(codes.items()), "code long, n long")).astype(float)
    size = Counter(int(quality.symbols(chr(c))[0]) for c in range(0x110000))

    def p(g, k):
        if not k:
            return 2.0 ** -base[fold(g)] / size[int(quality.symbols(g[-1])[0])]
        own, context = g[4 - k:], g[4 - k:3]
        seen = {h: n for h, n in tables[k].items() if h[:-1] == context}
        off = {h: d[k][min(n, 3) - 1] for h, n in seen.items()}
        total = sum(seen.values())
        return (seen[own] - off[own] if own in seen else 0) / max(total, 1) + (sum(off.values()) / total if seen else 1) * p(g, k - 1)

    ask = sorted({*grams, "漢字 x", "the?", "語語語語", "QQQQ"})
    got = quality.gram_bits(spark.createDataFrame([(g,) for g in ask], "gram string"), spark.createDataFrame(list(tables[4].items()), "gram string, n long"))
    assert {r.gram: r.bits for r in got.collect()} == pytest.approx({g: -np.log2(p(g, 4)) for g in ask}, rel=2e-3)


def test_chunks_hold_every_character_once(monkeypatch):
    texts = ["", "a", "ab\0", "the quick 漢字 \U0001f600 fox " * 9, "x" * 50]
    for size in (1, 7, 1000):
        monkeypatch.setattr(quality, "CHUNK", size)
        got = [[] for _ in texts]
        for owner, grams, which in quality.chunks(texts):
            for o, w in zip(owner, which):
                got[o].append(grams[w])
        assert got == [[("   " + t)[i:i + 4] for i in range(len(t))] for t in texts]


@lru_cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def tokens_of(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("source", ["documents", "odd"])
def test_packing_round_trip(spark, documents, odd, source):
    docs = {"documents": documents, "odd": odd}[source]
    pieces = packing.pack(docs, tokenizer_path()).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_seq[p.sequence_id].append((p.offset, p.length))
        ids = np.frombuffer(p.ids, "<u2")
        assert len(ids) == p.length > 0
        by_doc[p.doc_id, p.doc_tokens].append((p.start, ids))
    want = Counter((r.doc_id, tuple(tokens_of(r.text))) for r in docs.collect())
    for (doc, ids), times in want.items():
        got = sorted(by_doc[doc, len(ids)], key=lambda x: x[0])
        if times == 1:
            assert np.concatenate([g for _, g in got]).tolist() == list(ids)
            assert [s for s, _ in got] == np.cumsum([0] + [len(g) for _, g in got])[:-1].tolist()
        assert sum(len(g) for _, g in got) == times * len(ids)
    total = 0
    for s in by_seq.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 2048
        total += at
    if source == "documents":
        assert 1 - total / (2048 * len(by_seq)) < 0.03


def test_packing_digest_and_empty(spark, none):
    for r in QUERIES["op5_packing"](spark, SF).limit(50).collect():
        assert 0 <= r.ids_crc32 < 1 << 32
    assert packing.pack(none, tokenizer_path()).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=64, max_size=64))
def test_plans_use_each_item_once_and_fill_windows(counts):
    h = np.array([0, *counts])
    plan = packing.make_plan(h)
    assert (plan.covered <= h).all()
    fill = defaultdict(int)
    for b, low, m, slot, first in zip(plan.bin, plan.low, plan.times, plan.slot, plan.first):
        fill[first] += b * m
    assert all(0.98 * 64 <= f <= 64 for f in fill.values())


@pytest.fixture(scope="module")
def text_ids():
    return packing.TextIds(tokenizer_path(), 1, "<u2")


@settings(max_examples=200, deadline=None)
@given(text=st.one_of(st.text(alphabet=st.characters(max_codepoint=0x24F)), st.text(), st.text(alphabet=st.sampled_from(list("ab  .\n\t'é　\x1c\x0090!")) )))
def test_ids_equal_the_tokenizers(text_ids, text):
    text = text.encode("utf-8", "ignore").decode()
    for t in (text, f"a <|endoftext|> {text}"):
        assert np.frombuffer(text_ids(t), "<u2").tolist() == tokens_of(t)


def test_slow_tokenizer_is_loaded_by_need():
    ids = packing.TextIds(tokenizer_path(), 1, "<u2")
    ids("plain words")
    assert "tokenizer" not in vars(ids)
    ids("\u6f22")
    assert "tokenizer" in vars(ids)


def plain_targets(sizes):
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    t, capped = [0.0] * len(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = sum(sizes) - sum(3 * sizes[i] for i in capped)
        for i in range(len(sizes)):
            t[i] = 3 * sizes[i] if i in capped else left * weights[i] / sum(weights[j] for j in free)
        over = {i for i in free if t[i] > 3 * sizes[i]}
        if not over:
            return t
        capped |= over


def test_mixing_meets_targets(spark, documents):
    size = {r.doc_id: len((r.text or "").encode().split()) for r in documents.collect()}
    source = {r.doc_id: r.source for r in documents.collect()}
    names = sorted(set(source.values()))
    total = [sum(size[i] for i in size if source[i] == n) for n in names]
    want = dict(zip(names, plain_targets(total)))
    got = QUERIES["op6_mixing"](spark, SF).collect()
    assert {r.doc_id: r.size for r in got} == size
    assert all(abs(r.target - want[source[r.doc_id]]) < 1e-6 and r.taken <= 3 * r.size for r in got)
    for n in names:
        assert abs(sum(r.taken for r in got if source[r.doc_id] == n) - want[n]) <= 1
    again = QUERIES["op6_mixing"](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    mixed = Counter()
    for r in mixing.mix(documents).collect():
        mixed[r.source] += len(r.text.encode().split())
        assert r.n_chars == len(r.text)
    assert all(abs(mixed[n] - want[n]) <= 1 for n in names)


def test_mixing_odd_rows(odd_query, odd, none):
    got = odd_query("op6_mixing")
    assert len(got) == len(ODD) and all(0 <= r.taken <= 3 * r.size for r in got)
    assert mixing.taken(none).count() == mixing.mix(none).count() == 0
    assert mixing.mix(odd).columns == odd.columns


def test_splitting_tree_is_exact_and_even(spark):
    quotas = [1000, 7, 0, 333]
    got = {r.shard: list(r.quotas) for r in mixing.splitting_tree(spark, quotas, 13, seed=3).collect()}
    assert sorted(got) == list(range(13))
    assert np.sum(list(got.values()), 0).tolist() == quotas
    sums = [sum(q) for q in got.values()]
    assert max(sums) - min(sums) <= 4
    assert got == {r.shard: list(r.quotas) for r in mixing.splitting_tree(spark, quotas, 13, seed=3).collect()}


@pytest.mark.parametrize("tree, sample", [(mtree.TREE, 2048), (40, 16)])
def test_top_k_is_exact(spark, tree, sample):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, list(map(float, r.embedding))) for r in e.collect()]
    rows += [(10_000 + i, list(rows[50][1])) for i in range(9)]
    rows += [(20_000, None), (20_050, [float("inf")] * 64), (20_100, [None] * 64), (None, rows[3][1]), (20_150, [0.0] * 64), (20_200, [3.0, -2.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ok = [(i, np.floor(256 * np.pad(np.array(v, float), (0, 64 - len(v)))).astype(int)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    from pyspark.sql import functions as F

    got = defaultdict(list)
    for r in mtree.top_k(d, F.col("vec_id") % 50 == 0, tree=tree, sample=sample).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    for i, q in ok:
        if i % 50 == 0:
            best = sorted(((-int(q @ v), j) for j, v in ok if j != i))[:5]
            assert sorted(got.pop(i)) == [(n, j, -s) for n, (s, j) in enumerate(best, 1)], i
    assert not got


def test_top_k_of_few(spark):
    from pyspark.sql import functions as F

    schema = "vec_id long, embedding array<float>"
    assert mtree.top_k(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    got = mtree.top_k(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], schema), F.col("vec_id") == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 256 * 128)]


def test_pipeline(spark, documents, odd):
    docs, columns = documents.unionByName(odd.select(*documents.columns)), documents.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i < 4:
            assert out.columns == columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        assert docs.count() > 0, name
    assert {"doc_id", "start", "length", "sequence_id", "offset", "ids"} <= set(docs.columns)
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_draws_from_very_many_blocks_are_exact():
    rng = np.random.default_rng(1)
    for quotas in ([6 * 10**11, 3 * 10**11, 10**11 + 7, 0, 5], [10**9, 1], [7, 5, 0], [10**12]):
        q = np.array(quotas, np.int64)
        for k in (0, 1, int(q.sum()) // 3, int(q.sum()) // 2, int(q.sum())):
            got = mixing.part_of(rng, q, k)
            assert got.sum() == k and (got >= 0).all() and (got <= q).all()
    half = mixing.part_of(rng, np.array([6 * 10**11, 3 * 10**11, 10**11]), 5 * 10**11)
    assert np.allclose(half / 5e11, [0.6, 0.3, 0.1], atol=1e-3)
    small = [mixing.part_of(np.random.default_rng(i), np.array([60, 30, 10]), 50, 20) for i in range(200)]
    assert np.allclose(np.mean(small, 0), [30, 15, 5], atol=0.7)
