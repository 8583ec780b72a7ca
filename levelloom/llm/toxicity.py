"""Toxicity of whole texts by a convolutional text classifier trained in numpy.

A word's embedding is the mean of hashed rows, one for the word and one for each of its
character n-grams, so unseen forms of a known word still mean something. Filters of several
widths slide over the words; each keeps its largest response anywhere in the text (max
pooling), and a linear layer turns the responses into one logit. Everything is trained by
stochastic gradient descent (Adagrad steps): on a bounded sample of labelled rows first, then on
all others in shards side by side, whose results are averaged row by row.

Thresholds are calibrated by language. The language of a text is never read from the table
when scoring: it is guessed from the words, by counts of the hashed words that were learned from.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from levelloom.llm.common import cut
from levelloom.plans.selecting import smallest

#: hashed rows, embedding width, character n-grams of a word
ROWS, WIDTH, GRAMS = 1 << 15, 16, (3, 4, 5)
#: words a filter spans, and filters of each width
SPANS, FILTERS = (1, 2, 3), 8
#: rows per (language stratum, label), chosen by hash, and the strata: bounds what is learned from first, in one task
PER_CLASS, STRATA = 400, 64
#: rows of a shard at least and shards at most, for all other rows; pieces that the embedding travels in
SHARD_ROWS, SHARDS, PIECES = 2000, 64, 16
#: the score at which a text counts as toxic
LIMIT = 0.3
#: words that are convolved at once, code points that are split into words at once, words a task remembers
WORDS, CHUNK, REMEMBERED = 1 << 15, 1 << 20, 1 << 17

COLUMNS = sum(SPANS) * FILTERS
_PAD = max(SPANS) - 1
_word = re.compile(r"\w+")


def words_of(text: str) -> Iterator[list[str]]:
    """The words of a text in pieces; a piece ends between words."""
    i = 0
    while i < len(text):
        j = i + CHUNK
        while j < len(text) and _word.match(text[j - 1]) and _word.match(text[j]):
            j += 1
        yield _word.findall(text[i:j].lower())
        i = j


def gram_rows(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of all words, word by word, and where each word's begin."""
    marked = [f"<{w}>" for w in words]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    cp = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    owner = np.repeat(np.arange(len(words)), size)
    rows = [np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % ROWS for w in words), np.int64, len(words))]
    owners = [np.arange(len(words))]
    for n in GRAMS:
        m = len(cp) - n + 1
        if m <= 0:
            continue
        h = np.full(m, 2166136261 + n, np.uint32)
        for i in range(n):
            h ^= cp[i:m + i]
            h *= np.uint32(16777619)
            h ^= h >> np.uint32(15)
        inside = owner[:m] == owner[n - 1:]
        rows.append((h[inside] & np.uint32(ROWS - 1)).astype(np.int64))
        owners.append(owner[:m][inside])
    at, rows = np.concatenate(owners), np.concatenate(rows)
    order = np.argsort(at, kind="stable")
    return rows[order], np.searchsorted(at[order], np.arange(len(words)))


def _slots() -> list[tuple[int, int, slice]]:
    """(position in SPANS, offset in the window, columns) of every part of the filters."""
    out, at = [], 0
    for k, span in enumerate(SPANS):
        for j in range(span):
            out.append((k, j, slice(at, at + FILTERS)))
            at += FILTERS
    return out


@dataclass
class Model:
    emb: np.ndarray  # (ROWS, WIDTH)
    filters: np.ndarray  # (WIDTH, COLUMNS): all parts of all filters side by side
    bias: np.ndarray  # per filter
    out: np.ndarray  # linear layer over the pooled responses
    shift: float
    langs: np.ndarray  # (ROWS, languages): log share of a hashed word in each language
    limits: np.ndarray  # logit at which a text of each language counts as toxic
    scale: float
    names: Sequence[str] = ()
    memory: list[np.ndarray] | None = None  # squared gradients, and counts of hashed words in each language: while it learns

    def table(self, words: Sequence[str]) -> np.ndarray:
        """Each word's part of every filter response, and of the language scores."""
        rows, first = gram_rows(words)
        n = np.diff(np.append(first, len(rows)))
        e = np.add.reduceat(self.emb[rows], first) / n[:, None]
        return np.hstack([e @ self.filters, self.langs[rows[first]]]).astype(np.float32)

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.bias, 0) @ self.out + self.shift

    def score(self, pooled: np.ndarray, langs: np.ndarray) -> np.ndarray:
        """Probability-like score; LIMIT is reached exactly at the threshold of the guessed language."""
        z = self.logit(pooled) - self.limits[langs.argmax(1)]
        return 1 / (1 + np.exp(-np.clip(self.scale * z + np.log(LIMIT / (1 - LIMIT)), -30, 30)))


def responses(parts: np.ndarray) -> np.ndarray:
    """Filter responses at every position; ``parts`` ends with padding rows."""
    n = len(parts) - _PAD
    out = np.zeros((n, len(SPANS) * FILTERS), np.float32)
    for k, j, cols in _slots():
        out[:, k * FILTERS:(k + 1) * FILTERS] += parts[j:n + j, cols]
    return out


class Scorer:
    """Scores texts; remembers the table rows of words it has met."""

    def __init__(self, model: Model):
        self.model, self.n_langs = model, model.langs.shape[1]
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, COLUMNS + self.n_langs), np.float32)  # row 0 is padding
        self.used = 1

    def _numbers(self, words: list[str]) -> np.ndarray:
        new = list({w for w in words if w not in self.at})
        if new:
            if self.used + len(new) > REMEMBERED:
                self._forget()
                new = list(set(words))
            made = self.model.table(new)
            while self.used + len(new) > len(self.rows):
                self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
            self.rows[self.used:self.used + len(new)] = made
            self.at.update(zip(new, range(self.used, self.used + len(new))))
            self.used += len(new)
        return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))

    def pooled(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of every filter and the language scores, over the whole text."""
        best, langs = np.full(len(SPANS) * FILTERS, -np.inf, np.float32), np.zeros(self.n_langs)
        held: list[str] = []
        for piece in words_of(text):
            for i in range(0, len(piece), WORDS):
                part = piece[i:i + WORDS]
                at = self._numbers(held + part)  # may replace the table
                parts = self.rows[at]
                langs += parts[len(held):, COLUMNS:].sum(0, dtype=np.float64)
                if len(parts) > _PAD:
                    best = np.maximum(best, responses(parts[:, :COLUMNS]).max(0))
                held = (held + part)[-_PAD:]
        if held:  # windows that begin at the last words reach into padding
            ends = np.append(self._numbers(held), np.zeros(_PAD, np.int64))
            best = np.maximum(best, responses(self.rows[ends, :COLUMNS]).max(0))
        else:
            best[:] = 0
        return best, langs

    def __call__(self, texts: Sequence[str | None]) -> np.ndarray:
        got = [self.pooled(t or "") for t in texts]
        return self.model.score(np.array([g[0] for g in got]), np.array([g[1] for g in got])) if got else np.empty(0)


# ---- training ---------------------------------------------------------------
def train(texts: Sequence[str], toxic: Sequence[int], langs: Sequence[str], weights: Sequence[float], *, epochs: int = 5, rate: float = 0.1, seed: int = 12) -> Model:
    """Fit on the given rows; every fifth one calibrates instead.

    ``weights`` say how many rows of the corpus a row stands for. A language's threshold is the
    logit that costs the least weighted errors on its calibration rows, in the middle of the
    best gap; languages with few such rows use that of all rows. Without rows of both labels
    every text scores below the limit.
    """
    rng = np.random.default_rng(seed)
    y, w = np.array(toxic, np.float64), np.array(weights, np.float64)
    names = sorted(set(langs)) or [""]
    lang = np.array([names.index(v) for v in langs], np.int64)
    model = Model(
        rng.normal(0, 0.1, (ROWS, WIDTH)).astype(np.float32), rng.normal(0, 0.3, (WIDTH, COLUMNS)).astype(np.float32),
        np.zeros(len(SPANS) * FILTERS, np.float32), rng.normal(0, 0.3, len(SPANS) * FILTERS).astype(np.float32), 0.0,
        np.zeros((ROWS, len(names)), np.float32), np.full(len(names), np.inf), 1.0,
    )
    if not len(y) or y.min() == y.max():
        return model
    coded = _coded(texts)
    docs, grams, first, n_grams = coded
    order = rng.permutation(len(y))
    held = order[::5] if len(y) >= 40 else order
    fit = np.setdiff1d(order, held) if len(y) >= 40 else order
    _start(model, [np.unique(grams[_spread(first, n_grams, np.unique(docs[i]))]) for i in fit], y[fit])
    seen = np.full((ROWS, len(names)), 0.1)
    for i in fit:
        np.add.at(seen[:, lang[i]], grams[first[docs[i]]], 1)
    model.langs = np.log(seen / seen.sum(0)).astype(np.float32)

    balance = np.where(y[fit].mean() > 0, np.where(y == 1, 0.5 / max(y[fit].mean(), 1e-9), 0.5 / max(1 - y[fit].mean(), 1e-9)), 1.0)
    model.names, model.memory = names, [*[np.full_like(a, 1e-3) for a in (model.emb, model.filters, model.bias, model.out)], np.array(1e-3), seen]
    for _ in range(epochs):
        _learn(model, coded, y, balance, rng.permutation(fit), rate)
    scorer = Scorer(model)
    got = [scorer.pooled(texts[i]) for i in held]
    z = model.logit(np.array([g[0] for g in got]))
    guess = np.array([g[1] for g in got]).argmax(1)
    return _calibrate(model, z, guess, y[held], w[held])


def _coded(texts: Sequence[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Texts as word numbers; embedding rows of all words, where each word's begin, and how many they are."""
    seqs = [[v for piece in words_of(t) for v in piece] for t in texts]
    vocab = {v: i for i, v in enumerate(dict.fromkeys(v for s in seqs for v in s))}
    grams, first = gram_rows(list(vocab)) if vocab else (np.empty(0, np.int64), np.empty(0, np.int64))
    n_grams = np.diff(np.append(first, len(grams)))
    return [np.fromiter(map(vocab.__getitem__, s), np.int64, len(s)) for s in seqs], grams, first, n_grams


def _learn(model: Model, coded, y: np.ndarray, balance: np.ndarray, order: np.ndarray, rate: float) -> None:
    """One step for each text of ``order``; changes the model and what it remembers of squared gradients."""
    docs, grams, first, n_grams = coded
    sq = model.memory
    offsets = np.concatenate([np.full(FILTERS, j) for _, j, _ in _slots()])
    filter_of = np.concatenate([np.arange(k * FILTERS, (k + 1) * FILTERS) for k, _, _ in _slots()])
    for i in order:
        if not len(docs[i]):
            continue
        kinds, at = np.unique(docs[i], return_inverse=True)
        n = n_grams[kinds]
        ends = np.cumsum(n)
        rows = grams[_spread(first, n_grams, kinds)]
        e = np.vstack([np.add.reduceat(model.emb[rows], ends - n) / n[:, None], np.zeros((1, WIDTH), np.float32)])
        at = np.append(at, np.full(_PAD, len(kinds)))
        r = responses((e @ model.filters)[at])
        top = r.argmax(0)
        pooled = r[top, np.arange(r.shape[1])] + model.bias
        act = np.maximum(pooled, 0)
        err = (1 / (1 + np.exp(-np.clip(act @ model.out + model.shift, -30, 30))) - y[i]) * balance[i]
        d_out, d_pool = err * act, np.where(pooled > 0, err * model.out, 0).astype(np.float32)
        word = at[top[filter_of] + offsets]  # the word that each part of each filter looked at
        d_part = d_pool[filter_of]
        d_filters = (e[word] * d_part[:, None]).T
        live = np.flatnonzero((d_part != 0) & (word < len(kinds)))
        d_emb = (model.filters[:, live] * d_part[live]).T
        m = n[word[live]]
        stop = np.cumsum(m)
        if len(live):
            touched = rows[np.repeat((ends - n)[word[live]] - (stop - m), m) + np.arange(stop[-1])]
            uniq, where = np.unique(touched, return_inverse=True)
            g = np.zeros((len(uniq), WIDTH), np.float32)
            np.add.at(g, where, np.repeat(d_emb / m[:, None], m, axis=0))
            sq[0][uniq] += g * g
            model.emb[uniq] -= rate * g / np.sqrt(sq[0][uniq])
        for a, s, g in ((model.filters, sq[1], d_filters), (model.bias, sq[2], d_pool), (model.out, sq[3], d_out)):
            s += g * g
            a -= rate * g / np.sqrt(s)
        sq[4] += err * err
        model.shift -= rate * err / float(sq[4])**0.5


def _spread(first: np.ndarray, size: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Positions of all entries of the listed runs, run by run."""
    n = size[of]
    ends = np.cumsum(n)
    return np.repeat(first[of] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


def _start(model: Model, rows_of: Sequence[np.ndarray], y: np.ndarray, prior: float = 4.0) -> None:
    """Start one embedding component at each row's log odds of lying in a toxic text, smoothed by ``prior`` texts.

    The first filter of each width starts by reading it off its first word, so that training
    begins near a text's most telling word; the rest starts at random.
    """
    counts = np.zeros((2, ROWS))
    for rows, label in zip(rows_of, y):
        counts[int(label), rows] += 1
    n = np.array([(y == 0).sum(), (y == 1).sum()])[:, None]
    share = (counts + prior * n / n.sum()) / (n + prior)
    model.emb[:, 0] = np.log(share[1] / share[0])
    for k, j, cols in _slots():
        if j == 0:
            model.filters[:, cols.start] = 0
            model.filters[0, cols.start] = 1
            model.out[k * FILTERS] = 1


def best_limit(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """The logit from which on calling rows toxic costs least, in the middle of its gap."""
    order = np.argsort(z, kind="stable")
    z, y, w = z[order], y[order], w[order]
    cost = np.append(0, np.cumsum(w * y)) + np.append(np.cumsum((w * (1 - y))[::-1])[::-1], 0)
    edges = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    good = np.flatnonzero(cost <= cost.min() + 1e-9)
    width = np.concatenate([[0], z[1:] - z[:-1], [0]])
    return float(edges[good[width[good].argmax()]])


def _calibrate(model: Model, z: np.ndarray, guess: np.ndarray, y: np.ndarray, w: np.ndarray) -> Model:
    if not len(z) or y.min() == y.max():
        model.limits[:] = 0
        return model
    model.limits[:] = best_limit(z, y, w)
    for k in range(len(model.limits)):
        own = guess == k
        if own.sum() >= 20 and 0 < y[own].sum() < own.sum():
            model.limits[k] = best_limit(z[own], y[own], w[own])
    x, at = z - model.limits[guess], np.log(LIMIT / (1 - LIMIT))
    sign = np.where(y == 1, 1, -1)
    loss = {s: float(np.average(np.log1p(np.exp(-sign * np.clip(s * x + at, -30, 30))), weights=w)) for s in np.geomspace(0.1, 4, 31)}
    model.scale = min(loss, key=loss.get)
    return model


# ---- tables -----------------------------------------------------------------
def _fold(fold: int, folds: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == fold


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Learn from all labelled rows outside the held-out fold.

    At most ``per_class`` rows a stratum and label come first: their ids are stored as a small
    table, texts are filtered by it where they lie, and one task trains on them. Strata are
    hashes of lang, so there are 64 at most. ``_refine`` then learns from all other rows.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~_fold(2, 4))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where("toxic IN (0, 1)")
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    rows = docs.select("doc_id", lang.alias("lang")).join(known, "doc_id")
    rows = cut(rows.withColumns({"h": F.shiftrightunsigned(F.xxhash64("doc_id"), 1), "stratum": F.pmod(F.xxhash64("lang"), F.lit(STRATA)).cast("int")}))
    keys = ["stratum", "toxic"]
    chosen = cut(smallest(rows, keys, "h", per_class).select("doc_id", "lang", "toxic", "stratum").distinct())
    texts = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    got = texts.join(chosen, ["doc_id", "lang"]).distinct()
    size = rows.groupBy(*keys).agg(F.count("*").alias("size"))  # 128 rows at most

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = list(batches)
        rows = pd.concat(found).sort_values(["doc_id", "lang", "text"], kind="stable") if found else pd.DataFrame(columns=[*keys, "doc_id", "lang", "text", "size"])
        weights = rows["size"] / rows.groupby(keys)["doc_id"].transform("size") if len(rows) else []
        model = train(rows["text"].tolist(), rows["toxic"].tolist(), rows["lang"].tolist(), list(weights))
        yield pd.DataFrame({"model": [pickle.dumps(model)]})

    # the sample is bounded, and a task has more room for it than the driver, which gets the model alone
    made = got.join(F.broadcast(size), keys).coalesce(1).mapInPandas(learn, "model binary").first()
    model = pickle.loads(made["model"]) if made else train([], [], [], [])  # a table without rows may have no task
    n = {r.toxic: (r.n, r.more) for r in size.groupBy("toxic").agg(F.sum("size").alias("n"), F.sum(F.greatest(F.col("size") - per_class, F.lit(0))).alias("more")).collect()}
    if model.memory is not None and sum(more for _, more in n.values()):
        toxic = n[1][0] / (n[0][0] + n[1][0])
        ids = rows.join(chosen, ["doc_id", "lang"], "left_anti").select("doc_id", "lang", "toxic").distinct()
        others = texts.where(~_fold(2, 4)).join(ids.hint("merge"), ["doc_id", "lang"])  # these ids grow with the input
        model = _refine(model, others, int(sum(more for _, more in n.values())), toxic)
    model.memory = None
    return model


def _refine(model: Model, others: DataFrame, size: int, toxic: float, rate: float = 0.1) -> Model:
    """``model`` after all rows of ``others`` (doc_id, lang, text, toxic), every fifth of which calibrates instead.

    A shard starts from ``model`` and passes its rows once, an Arrow batch at a time. An embedding
    row becomes the mean of what the shards that met it made of it, by their squared gradients;
    the few other numbers the mean by rows. Shards are as many as the rows ask for, 64 at most.
    Calibrating rows are scored where they lie and come back counted by logit.
    """
    shared, step = others.sparkSession.sparkContext.broadcast(model), ROWS // PIECES
    held = F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(5)) == 0
    balance = np.array([0.5 / (1 - toxic), 0.5 / toxic])

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = pickle.loads(pickle.dumps(shared.value))
        before, seen, n = m.memory[0].copy(), np.zeros_like(m.memory[5]), 0
        number = {v: i for i, v in enumerate(m.names)}
        for b in batches:
            coded, y = _coded(b["text"].tolist()), b["toxic"].to_numpy(np.float64)
            _learn(m, coded, y, balance[b["toxic"].to_numpy(np.int64)], np.arange(len(y)), rate)
            for words, lang in zip(coded[0], b["lang"]):
                if lang in number:
                    np.add.at(seen[:, number[lang]], coded[1][coded[2][words]], 1)
            n += len(y)
        if not n:
            return
        w = (m.memory[0] - before).sum(1, dtype=np.float64)[:, None]
        emb = np.hstack([w * m.emb, w, seen])
        rest = np.concatenate([m.filters.ravel(), m.bias, m.out, [m.shift], [1.0]]) * n
        yield pd.DataFrame({"piece": range(PIECES + 1), "part": [*[emb[i:i + step].tobytes() for i in range(0, ROWS, step)], rest.tobytes()]})

    def added(parts: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(parts["part"].iloc[0]).copy()
        for p in parts["part"].iloc[1:]:
            total += np.frombuffer(p)
        return pd.DataFrame({"piece": parts["piece"].iloc[:1], "part": [total.tobytes()]})

    shards = others.where(~held).coalesce(max(1, min(SHARDS, size // SHARD_ROWS)))
    pieces = shards.mapInPandas(learn, "piece int, part binary").groupBy("piece").applyInPandas(added, "piece int, part binary")
    parts = {r.piece: np.frombuffer(bytes(r.part)) for r in pieces.collect()}
    if len(parts) > PIECES:
        emb = np.concatenate([parts[i] for i in range(PIECES)]).reshape(ROWS, -1)
        met = emb[:, WIDTH] > 0
        model.emb[met] = emb[met, :WIDTH] / emb[met, WIDTH:WIDTH + 1]
        seen = model.memory[5] + emb[:, WIDTH + 1:]
        model.langs = np.log(seen / seen.sum(0)).astype(np.float32)
        rest, at = parts[PIECES] / parts[PIECES][-1], 0
        for a in (model.filters, model.bias, model.out):
            a[...] = rest[at:at + a.size].reshape(a.shape)
            at += a.size
        model.shift = float(rest[at])
    model.memory = None
    shared.unpersist()
    shared = others.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for b in batches:
            got = [scorer.pooled(t) for t in b["text"]]
            z = np.clip(shared.value.logit(np.array([g[0] for g in got])), -64, 64)
            yield pd.DataFrame({"guess": np.array([g[1] for g in got]).argmax(1), "toxic": b["toxic"].to_numpy(), "z": np.rint(z * 64).astype(np.int64)})

    c = others.where(held).mapInPandas(score, "guess long, toxic long, z long").groupBy("guess", "toxic", "z").agg(F.count("*").alias("n")).toPandas()
    shared.unpersist()
    if c.groupby("toxic")["n"].sum().reindex([0, 1], fill_value=0).min() < 20:
        return model  # too few to say more than the first rows did
    return _calibrate(model, c["z"].to_numpy() / 64.0, c["guess"].to_numpy(), c["toxic"].to_numpy(np.float64), c["n"].to_numpy(np.float64))


def predict(model: Model, docs: DataFrame, text: Column) -> Column:
    """Score of a text column; ``docs`` only lends its session."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for texts in batches:
            yield pd.Series(scorer(texts), dtype="float64")

    return run(text)


def score(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text, lang).

    ``labels`` (doc_id, toxic) teach; null ids and labels are passed over, conflicting labels
    of one id count as toxic. A null or wordless text is scored like padding alone. A null
    doc_id is neither learned from nor held out; repeated rows and extra columns do no harm;
    without labels of both kinds nothing is predicted toxic.
    """
    model = fit(docs, labels, per_class)
    held = F.coalesce(_fold(2, 4), F.lit(False))
    scored = docs.select("doc_id", held.alias("held_out"), predict(model, docs, F.col("text").cast("string")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= LIMIT).cast("int"))
