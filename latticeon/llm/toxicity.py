"""Toxicity by class-conditional Kneser-Ney models.

Symbols are characters; a word's n-grams begin at its left edge. For each class
the probability of a character after its context is

    P_c(x | h) = (max(count_c(hx) - D, 0) + D * N_c(h) * P(x | h)) / count_c(h)

where N_c(h) is the number of distinct continuations in the class, and P is shared:
a Kneser-Ney model over both classes together, whose lower orders use continuation
counts. Rare expressions thus fall back to counts the classes share and hardly
tell them apart. A word's log-likelihood ratio is the sum over its characters; a document's
evidence is length-normalised (means per word), and a logistic calibration on
labelled documents kept out of the counts maps it to a score. Words of over 64 letters
are taken in pieces of 64, in training and in scoring.

Training reads a bounded sample: at most ``per_class`` labelled rows a class, those with the smallest
hash of their id, three quarters for counts, the rest for calibration. Every n-gram of the
sample is kept: singletons carry the discounts and continuation counts. Scoring covers every
word of every text in one pass without a shuffle; the model, as large as its bounded
sample makes it, travels with the function.

Null and empty texts have no evidence and get the calibrated score of that. Without
usable labels of both classes the score is 0 everywhere.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache, enter, to_text, tune

ORDER = 6
DISCOUNT = 0.75
PIECE = 64
THRESHOLD = 0.7
#: What errors on ordinary and toxic documents cost in the calibration.
MISS_COST = np.array([1.0, 2.0])
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def pieces_of(word: str):
    """Words of over PIECE letters count as several."""
    return [word[i : i + PIECE] for i in range(0, len(word), PIECE)]


def grams_of(word: str, order: int):
    """(context, gram) at each character of the word; contexts reach back to its edge."""
    w = f" {word} "
    for i in range(1, len(w)):
        a = max(0, i - order + 1)
        yield w[a:i], w[a : i + 1]


class KneserNey:
    """Log-likelihood ratios of n-grams and, for unseen ones, of contexts."""

    def __init__(self, counts: dict[str, tuple[int, int]], order: int = ORDER, discount: float = DISCOUNT):
        """counts: for each n-gram (its last character the one predicted) its count in class 0 and 1."""
        self.order = order
        total = [defaultdict(int), defaultdict(int)]
        kinds = [defaultdict(int), defaultdict(int)]
        pool, pool_kinds = defaultdict(int), defaultdict(int)
        for gram, pair in counts.items():
            h = gram[:-1]
            for c in (0, 1):
                if pair[c]:
                    total[c][h] += pair[c]
                    kinds[c][h] += 1
            pool[h] += pair[0] + pair[1]
            pool_kinds[h] += 1
        # Continuation counts of the lower orders: distinct characters to the left.
        lower: list[dict[str, int]] = []
        grams = set(counts)
        while grams:
            shorter = Counter(g[1:] for g in grams if len(g) > 1)
            lower.append(shorter)
            grams = set(shorter)
        merged: dict[str, int] = {}
        for level in lower:
            for g, n in level.items():
                if len(g):
                    merged[g] = max(n, merged.get(g, 0))
        low_total, low_kinds = defaultdict(int), defaultdict(int)
        for g, n in merged.items():
            low_total[g[:-1]] += n
            low_kinds[g[:-1]] += 1
        alphabet = max(1, low_kinds[""])
        memo: dict[str, float] = {"": 1.0}

        def low(g: str) -> float:
            """Kneser-Ney probability of g's last character after the rest, of lower orders."""
            if g in memo:
                return memo[g]
            h = g[:-1]
            back = low(g[1:]) if len(g) > 1 else 1.0 / alphabet
            t = low_total.get(h, 0)
            p = (max(merged.get(g, 0) - discount, 0.0) + discount * low_kinds[h] * back) / t if t else back
            memo[g] = p
            return p

        self.contexts = {}
        for h in pool:
            g = [discount * kinds[c][h] / total[c][h] if total[c].get(h) else 1.0 for c in (0, 1)]
            self.contexts[h] = math.log(g[1]) - math.log(g[0])
        self.grams = {}
        for gram, pair in counts.items():
            h = gram[:-1]
            shared = (max(pair[0] + pair[1] - discount, 0.0) + discount * pool_kinds[h] * low(gram[1:])) / pool[h]
            p = [(max(pair[c] - discount, 0.0) + discount * kinds[c][h] * shared) / total[c][h] if total[c].get(h) else shared for c in (0, 1)]
            self.grams[gram] = math.log(p[1]) - math.log(p[0])

    def ratio(self, word: str) -> float:
        """Toxic minus ordinary log-likelihood of a word."""
        grams, contexts = self.grams, self.contexts
        return sum(grams[g] if g in grams else contexts.get(h, 0.0) for p in pieces_of(word) for h, g in grams_of(p, self.order))


class Scorer:
    """Length-normalised evidence of a text and its calibrated score."""

    def __init__(self, model: KneserNey, weights=None):
        self.model, self.weights = model, weights
        self.cache = BoundedCache(model.ratio, 300_000)

    def __getstate__(self):
        return {"model": self.model, "weights": self.weights}

    def __setstate__(self, s):
        self.__init__(s["model"], s["weights"])

    def evidence(self, text: str) -> list[float]:
        w = words_of(text)
        if not w:
            return [0.0, 0.0, 0.0, 0.0]
        r = np.fromiter(map(self.cache.__getitem__, w), np.float64, len(w))
        n = len(w) + 5.0
        return [float(np.clip(r, -8, 8).sum() / n), float(np.clip(r - 1.0, 0, 8).sum() / n), float((r > 2.5).sum() / n), float((r > 4.0).sum() / n)]

    def score(self, text: str) -> float:
        if self.weights is None:
            return 0.0
        mean, scale, w = self.weights
        z = float(np.dot((np.asarray(self.evidence(text)) - mean) / scale, w[:-1]) + w[-1])
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0):
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    reg = np.eye(len(w)) * ridge
    reg[-1, -1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (weight * p * (1 - p))[:, None]) + reg, z.T @ (weight * (p - y)) + reg @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = 6000, order: int = ORDER) -> Scorer:
    """labels: the rows one may learn from. Of an id with several labels the largest counts, of an id with several rows any one."""
    tune(docs.sparkSession)
    own = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg(F.max(F.col(label).cast("int")).alias("__y"))
    hashed = own.withColumn("__h", F.pmod(F.xxhash64("__id", F.lit(7)), F.lit(1 << 30)))
    priors = {r["__y"]: r["count"] for r in own.groupBy("__y").count().collect()}
    if len(priors) < 2:
        return Scorer(KneserNey({}), None)
    sample = hashed.filter("__y = 0").orderBy("__h", "__id").limit(per_class).unionByName(hashed.filter("__y = 1").orderBy("__h", "__id").limit(per_class))
    # At most 2 * per_class ids: a bounded broadcast.
    chosen = docs.select(F.col(doc_id).alias("__id"), to_text(text).alias("__t")).join(F.broadcast(sample), "__id").dropDuplicates(["__id"])

    def count(batches):
        for b in batches:
            per: Counter = Counter()
            for t, y in zip(b.column(0), b.column(1)):
                y = y.as_py()
                for w, n in Counter(words_of(t.as_py())).items():
                    per[w, y] += n
            two: dict[str, list[int]] = {}
            for (w, y), n in per.items():
                for p in pieces_of(w):
                    for _, g in grams_of(p, order):
                        two.setdefault(g, [0, 0])[y] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(two), pa.string()), pa.array([v[0] for v in two.values()], pa.int64()), pa.array([v[1] for v in two.values()], pa.int64())], names=["g", "c0", "c1"])

    part = F.col("__h") % 4
    grams = chosen.filter(part != 0).select("__t", "__y").mapInArrow(count, "g string, c0 long, c1 long")
    grams = grams.groupBy("g").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    table = grams.toPandas()
    model = KneserNey(dict(zip(table["g"], zip(table["c0"].tolist(), table["c1"].tolist()))), order)
    scorer = Scorer(model)

    @F.arrow_udf("array<double>")
    def evidence(t: pa.Array) -> pa.Array:
        enter("toxicity")
        return pa.array([scorer.evidence(x.as_py()) for x in t], pa.list_(pa.float64()))

    held = chosen.filter(part == 0).select(evidence("__t").alias("x"), "__y").toPandas()
    if held["__y"].nunique() < 2:
        return Scorer(model, None)
    y = held["__y"].to_numpy(float)
    share = np.array([priors[0], priors[1]], float) / (priors[0] + priors[1])
    inside = np.array([(y == 0).mean(), (y == 1).mean()])
    weight = (share / inside * MISS_COST)[y.astype(int)]
    return Scorer(model, fit_logistic(np.stack(held["x"].to_numpy()), y, weight))


def score_column(scorer: Scorer, text: str = "text") -> Column:
    @F.arrow_udf("double")
    def toxicity(t: pa.Array) -> pa.Array:
        enter("toxicity")
        return pa.array([scorer.score(x.as_py()) for x in t], pa.float64())

    return toxicity(to_text(text))


def held_out(doc_id: str = "doc_id") -> Column:
    """The rows never learnt from: crc32 of the id as text, modulo 3, is 1. A null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(True))


def score_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each input row."""
    tune(docs.sparkSession)
    scorer = train(docs, labels.filter(~held_out(doc_id)), doc_id, text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), score_column(scorer, text).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
