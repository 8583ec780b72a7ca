"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the mean of the embeddings of its character n-grams (word borders included),
hashed into a fixed number of rows. Embeddings and softmax are trained together by
stochastic gradient descent in numpy on a bounded sample of labelled rows; a part of the
sample sets the temperature and the rejection threshold. Since both layers are linear, a
prediction needs one small score row per n-gram only.

The softmax must choose among the languages it knows, so a second signal rejects others:
how familiar a text's n-grams are to the language it is given to. Its limits are calibrated
against the rows of all other languages, which are foreign to that language's n-grams.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from levelloom.plans.selecting import smallest

#: hashed rows, embedding width, n-gram lengths
ROWS, WIDTH, GRAMS = 1 << 14, 16, (2, 3, 4)
#: training rows per language, chosen by hash; the only bound on what is learned from
PER_LABEL = 400
UNKNOWN = "und"
#: code points of a text that are hashed at once; the mean still runs over the whole text
CHUNK = 1 << 18
#: n-grams of average familiarity added to a text, so that few n-grams alone don't reject it
PRIOR = 30

_gap = re.compile(r"[\W\d_]+")


def _rows(cp: np.ndarray, skip: int) -> np.ndarray:
    """Rows of the n-grams that end behind the first ``skip`` characters."""
    out = []
    for n in GRAMS:
        c = cp[max(0, skip - n + 1):]
        if len(c) < n:
            continue
        h = np.full(len(c) - n + 1, 2166136261 + n, np.uint32)
        for i in range(n):
            h ^= c[i:len(c) - n + 1 + i]
            h *= np.uint32(16777619)
            h ^= h >> np.uint32(15)
        out.append(h & np.uint32(ROWS - 1))
    return np.concatenate(out) if out else np.empty(0, np.int64)


def gram_parts(text: str) -> Iterator[np.ndarray]:
    """Embedding rows of all n-grams of a text, part by part; nothing if it has no letter.

    A part ends between words and begins with the last characters of the one before, so the
    n-grams are those of the whole text.
    """
    held, i, first = " ", 0, []
    letters = False
    while i < len(text):
        j = i + CHUNK
        while j < len(text) and not _gap.match(text, j - 1) and not _gap.match(text, j):
            j += 1
        words = _gap.sub(" ", text[i:j].lower()).strip()
        i = j
        if not words:
            continue
        letters = letters or any(map(str.isalpha, words))
        cp = np.frombuffer(f"{held}{words} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
        first.append(_rows(cp, len(held) if len(held) > 1 else 0))
        held = f"{held}{words} "[1 - max(GRAMS):]
        if letters:
            yield from first
            first = []


def gram_rows(text: str) -> np.ndarray:
    """Embedding rows of all n-grams of a text; empty if it has no letter."""
    parts = list(gram_parts(text))
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def profile(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of a text and their shares."""
    rows, counts = np.unique(gram_rows(text or ""), return_counts=True)
    return rows.astype(np.int32), (counts / max(1, counts.sum())).astype(np.float32)


@dataclass(frozen=True)
class Model:
    labels: tuple[str, ...]
    scores: np.ndarray  # (ROWS, labels): embedding times softmax weights
    bias: np.ndarray
    temperature: float
    threshold: float
    familiar: np.ndarray  # (ROWS, labels): log2 share of each row among a label's n-grams
    usual: np.ndarray  # mean familiarity of a label's own texts
    limits: np.ndarray  # familiarity below which a text is foreign to the label

    def _means(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """Mean score row and mean familiarity over the whole text, part by part, and its n-grams."""
        total, known, n = np.zeros(len(self.labels)), np.zeros(len(self.labels)), 0
        for rows in gram_parts(text):
            total += self.scores[rows].sum(0, dtype=np.float64)
            known += self.familiar[rows].sum(0, dtype=np.float64)
            n += len(rows)
        return total / max(n, 1), known / max(n, 1), n

    def logits(self, text: str) -> np.ndarray | None:
        """Scores of the whole text; none without a letter."""
        mean, _, n = self._means(text)
        return mean + self.bias if n else None

    def judge(self, text: str) -> tuple[int, float, bool] | None:
        """Number of the best label, its probability, and whether it is rejected; none without a letter."""
        mean, known, n = self._means(text)
        if not n:
            return None
        p = _softmax((mean + self.bias) / self.temperature)
        best = int(p.argmax())
        familiar = (known[best] * n + self.usual[best] * PRIOR) / (n + PRIOR)
        return best, float(p[best]), bool(p[best] < self.threshold or familiar < self.limits[best])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(
    profiles: Sequence[tuple[np.ndarray, np.ndarray]], labels: Sequence[str], *, epochs: int = 8, rate: float = 0.5, keep: float = 0.999, seed: int = 8
) -> Model:
    """SGD over the given profiles; every fifth one calibrates instead.

    ``keep``: the threshold is the score that this share of the rightly predicted
    calibration rows reaches, never above one half. A label's familiarity limit lies half-way
    between what this share of its own rows reaches and the most familiar row of another label,
    or at the former where the two overlap.
    """
    names = tuple(sorted(set(labels)))
    if not names:
        return Model((), np.zeros((ROWS, 0)), np.zeros(0), 1.0, 0.0, np.zeros((ROWS, 0)), np.zeros(0), np.zeros(0))
    y = np.array([names.index(v) for v in labels])
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 1 / WIDTH, (ROWS, WIDTH)).astype(np.float32)
    w, b = np.zeros((WIDTH, len(names)), np.float32), np.zeros(len(names), np.float32)
    order = rng.permutation(len(y))
    held = order[::5] if len(y) >= 20 else order
    fit = np.setdiff1d(order, held) if len(y) >= 20 else order
    w += rng.normal(0, 0.1, w.shape).astype(np.float32)
    steps, total = 0, epochs * len(fit)
    for _ in range(epochs):
        for i in rng.permutation(fit):
            rows, share = profiles[i]
            steps += 1
            if not len(rows):
                continue
            lr = rate * (1 - steps / (total + 1))
            x = share @ emb[rows]
            err = _softmax(x @ w + b)
            err[y[i]] -= 1
            back = w @ err
            w -= lr * np.outer(x, err)
            b -= lr * err
            emb[rows] -= (lr * len(rows) ** 0.5) * share[:, None] * back
    scores = (emb @ w).astype(np.float32)
    z = np.array([profiles[i][1] @ scores[profiles[i][0]] + b for i in held])
    loss = {t: -np.log(_softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean() for t in np.geomspace(0.05, 5, 41)}
    t = float(min(loss, key=loss.get))
    p = _softmax(z / t)
    right = p.max(1)[p.argmax(1) == y[held]]
    threshold = min(0.5, float(np.quantile(right, 1 - keep))) if len(right) else 0.0
    return Model(names, scores, b.astype(np.float64), t, threshold, *_familiarity(profiles, y, fit, held, len(names), keep))


def _familiarity(profiles: Sequence[tuple[np.ndarray, np.ndarray]], y: np.ndarray, fit: np.ndarray, held: np.ndarray, n_labels: int, keep: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each label's table of familiarity from the rows of ``fit``; mean and limit from those of ``held``."""
    share = np.zeros((ROWS, n_labels))
    for i in fit:
        share[profiles[i][0], y[i]] += profiles[i][1]
    table = np.log2(0.9 * share / np.maximum(share.sum(0), 1e-9) + 0.1 / ROWS).astype(np.float32)
    held = np.array([i for i in held if len(profiles[i][0])], np.int64)
    seen = np.array([profiles[i][1] @ table[profiles[i][0]] for i in held], np.float64).reshape(-1, n_labels)
    usual, limits = np.zeros(n_labels), np.full(n_labels, -np.inf)
    for k in range(n_labels):
        own, other = seen[y[held] == k, k], seen[y[held] != k, k]
        if len(own):
            usual[k], limits[k] = own.mean(), np.quantile(own, 1 - keep)
            if len(other) and other.max() < limits[k]:
                limits[k] = (limits[k] + other.max()) / 2
    return table, usual, limits


@F.pandas_udf(T.StructType().add("rows", T.BinaryType()).add("shares", T.BinaryType()))
def _profiles(texts: pd.Series) -> pd.DataFrame:
    found = [profile(t) for t in texts]
    return pd.DataFrame({"rows": [f[0].tobytes() for f in found], "shares": [f[1].tobytes() for f in found]})


def fit(rows: DataFrame, per_label: int = PER_LABEL) -> Model:
    """Learn from ``rows`` (doc_id, text, lang): at most ``per_label`` rows of each language, chosen by hash.

    Profiles are made where the rows are, and the model in a task; the driver gets the model alone.
    """
    known = rows.where("lang IS NOT NULL").withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id"), 1))
    # counts by ranges of the hash say which rows are first, so a language of any size is never ordered;
    # there is one row per language, as many as the model has labels: texts are filtered where they lie
    first = smallest(known.select("lang", "h"), ["lang"], "h", per_label, few_keys=True)
    limits = F.broadcast(first.groupBy("lang").agg(F.max("h").alias("limit")))
    chosen = known.select("lang", "h", "text").join(limits, "lang").where("h <= limit")
    chosen = chosen.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("n") <= per_label)
    got = chosen.select("lang", "h", _profiles("text").alias("p")).select("lang", "h", "p.*")

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = list(batches)
        if found:
            rows = pd.concat(found).sort_values(["lang", "h"], kind="stable")
            model = train([(np.frombuffer(r, np.int32), np.frombuffer(s, np.float32)) for r, s in zip(rows["rows"], rows["shares"])], rows["lang"].tolist())
            yield pd.DataFrame({"model": [pickle.dumps(model)]})

    made = got.coalesce(1).mapInPandas(learn, "model binary").first()
    return pickle.loads(made["model"]) if made else train([], [])


def predict(model: Model, text: Column) -> Column:
    """struct<lang_pred, score, rejected>: ``und`` with score 0 where the text is null or has no letter."""
    names = np.array([*model.labels, UNKNOWN], dtype=object)

    @F.pandas_udf("struct<lang_pred: string, score: double, rejected: boolean>")
    def run(texts: pd.Series) -> pd.DataFrame:
        best, score, rejected = np.full(len(texts), len(names) - 1), np.zeros(len(texts)), np.ones(len(texts), bool)
        if model.labels:
            for i, t in enumerate(texts):
                found = model.judge(t) if t else None
                if found is not None:
                    best[i], score[i], rejected[i] = found
        return pd.DataFrame({"lang_pred": names[best], "score": score, "rejected": rejected})

    return run(text)


def learnable(fold: int = 1, folds: int = 3) -> Column:
    """Rows a model may learn from: the fold of their id is known and is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) != fold, F.lit(False))


def identify(docs: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row of ``docs``.

    Learns from rows with text and lang outside the held-out fold. Null or letterless texts
    give ``und``, score 0, rejected. A null doc_id is neither learned from nor held out;
    repeated rows and extra columns do no harm; without any learnable row all are ``und``.
    """
    model = fit(docs.where(learnable()), per_label)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), predict(model, F.col("text")).alias("p")).select("doc_id", "held_out", "p.*")


def keep_identified(docs: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """The rows whose language is recognised, columns as given; rejected ones go."""
    model = fit(docs.where(learnable()), per_label)
    p = docs.withColumn("__ll_lang", predict(model, F.col("text")))
    return p.where(~F.col("__ll_lang.rejected")).select(*docs.columns)
