"""Toxicity: maximum-scoring segments over token log-odds, calibrated by extreme values.

Tokens, or else their stems, score by their log-odds between toxic and clean labelled documents under a Dirichlet prior; tokens
that do not tell the classes apart score slightly below zero.  A linear scan finds all maximal segments of
a document.  A segment of score S among n tokens has the expected number of chance equals
E = K n exp(-lambda S); the parts of a document's segments are combined into one score in (0, 1).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.llm.common import cut, hash_sample, table

#: Labelled rows used at most, tokens with a score of their own at most, and the Dirichlet prior's share of the counts.
MAX_LABELLED, MAX_TOKENS, PRIOR = 20_000, 20_000, 0.05
#: Least likelihood ratio (G squared), log-odds and documents of a feature that has an own score; score of all other tokens.
LEAST_G2, LEAST_ODDS, LEAST_DOCS, DRIFT = 14.0, 1.5, 3, -3 / 64
#: Besides whole tokens, their first so many characters are features, for words that share a stem.
STEMS = (7, 6, 5, 4)
#: Scores are multiples of 1 / GRAIN, so that their histogram is bounded.
GRAIN = 64
#: Chance expectation up to which a segment counts as significant.
SIGNIFICANT = 0.05
FOLDS = 5
EULER = 0.5772156649
_TOKEN = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    """Runs of letters, digits and underscores in lower case."""
    return _TOKEN.findall(text.lower()) if text else []


def features(token: str) -> list[str]:
    """The token and its stems, from the most to the least specific."""
    return [token, *(f"{token[:n]}*" for n in STEMS if len(token) > n)]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), disjoint and in order, in linear time.

    Runs of tokens that score at most zero are taken as one step.  Candidates wait on a stack; a new one
    absorbs those before it while that makes it larger (each candidate is absorbed once).
    """
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    before, after = total[at], total[at + 1]
    stack: list[tuple[int, int, float, float]] = []  # start, end, total before, total after
    for i, lo, hi in zip(at.tolist(), before.tolist(), after.tolist()):
        start, end = i, i + 1
        waiting: list[tuple[int, int, float, float]] = []
        while stack:
            s, e, low, high = stack[-1]
            if low >= lo:  # cannot be extended to the left over it
                waiting.append(stack.pop())
            elif high < hi:  # joining up gains more than the gap costs

                stack.pop()
                start, lo = s, low
                waiting.clear()
            else:
                break
        stack.extend(reversed(waiting))
        stack.append((start, end, lo, hi))
    return [(s, e, high - low) for s, e, low, high in stack]


@dataclass
class ToxicityModel:
    """Scores of features, the two extreme-value parameters, and the weights that combine a document's parts."""

    scores: dict[str, float]
    lam: float
    k: float
    weights: np.ndarray
    #: Tokens scored so far, emptied when there are many.
    seen: dict[str, float] = field(default_factory=dict)

    def token_scores(self, words: list[str]) -> np.ndarray:
        known, found = self.scores, self.seen
        for w in set(words).difference(found):
            found[w] = next((known[f] for f in features(w) if f in known), DRIFT)
        out = np.fromiter((found[w] for w in words), dtype=np.float64, count=len(words))
        if len(found) > 100_000:
            found.clear()
        return out

    def passages(self, words: list[str]) -> list[tuple[int, int, float, float]]:
        """Significant segments: first token, end, score, and the expected number of such ones by chance."""
        out = []
        for start, end, score in segments(self.token_scores(words)):
            expected = self.k * max(len(words), 1) * np.exp(-self.lam * score)
            if expected <= SIGNIFICANT:
                out.append((start, end, score, float(expected)))
        return out

    def score(self, found: list[tuple[int, int, float, float]]) -> float:
        """Score of a document from its ``passages``."""
        return float(1 / (1 + np.exp(-np.clip(parts([p[2:] for p in found]) @ self.weights, -30, 30))))


def parts(found: list[tuple[float, float]]) -> np.ndarray:
    """What a document's score is made from: calibrated best passage, number and sum of (score, expected)."""
    best = max((-np.log(max(e, 1e-300)) for _, e in found), default=0.0)
    return np.array([1.0, min(best, 60.0) / 10, np.log1p(len(found)), np.log1p(sum(s for s, _ in found))])


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds ratio of counts under a Dirichlet prior shaped as both classes together, and G squared without it."""
    weight = PRIOR * (n_toxic + n_clean)
    both, n = toxic + clean, n_toxic + n_clean
    a, b = toxic + weight * both / n, clean + weight * both / n
    odds = np.log(a / np.maximum(n_toxic + weight - a, 1e-9)) - np.log(b / np.maximum(n_clean + weight - b, 1e-9))
    g = np.zeros(len(both))
    for seen, of, total in ((toxic, both, n_toxic), (clean, both, n_clean), (n_toxic - toxic, n - both, n_toxic), (n_clean - clean, n - both, n_clean)):
        g += 2 * seen * np.log(np.maximum(seen, 1e-9) / np.maximum(of * total / n, 1e-9))
    return odds, g


def extreme_values(values: dict[float, int], tops: list[tuple[float, int]]) -> tuple[float, float]:
    """Lambda and K of the maximal segment score by chance, from clean documents: how often each token score occurs, and
    for each document its best segment and its number of tokens.

    Lambda solves mean(exp(lambda s)) = 1 over the tokens; K comes from the mean of lambda S - ln n over the
    documents' best segments, which for a Gumbel law is ln K plus Euler's constant.
    """
    v, n = np.array(list(values.keys()), dtype=np.float64), np.array(list(values.values()), dtype=np.float64)
    if not len(v) or v.max() <= 0 or (v * n).sum() >= 0:
        return 1.0, 0.1
    low, high = 1e-6, 50.0 / v.max()
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (n * np.exp(mid * v)).sum() < n.sum() else (low, mid)
    k = np.exp(np.mean([low * s - np.log(m) for s, m in tops]) - EULER)
    return low, float(np.clip(k, 1e-4, 1.0))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression, by Newton steps with a ridge on all but the first."""
    w, penalty = np.zeros(x.shape[1]), np.diag([0.0] + [ridge * len(x) ** 0.5] * (x.shape[1] - 1))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * np.maximum(p * (1 - p), 1e-6)) @ x + penalty + 1e-9 * np.eye(x.shape[1]), x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo ``FOLDS``; 0 is held out.  A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> ToxicityModel:
    """Learn from labelled documents that are not held out, the first ``max_labelled`` in hash order.

    Three quarters of them give the features' scores (documents count a feature once; of the features that at least ``LEAST_DOCS``
    toxic documents have and clean ones have less, the ``MAX_TOKENS`` found in most toxic documents are tried, which is
    part of the fit), the rest gives lambda, K and the weights.  Documents of a repeated id count alike; ids with contradicting
    labels are toxic.  Without labels of both kinds scores are all equal.
    """
    some = labels.where("toxic is not null and doc_id is not null").where(remainder(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = F.broadcast(hash_sample(some, max_labelled, "doc_id"))
    # These few texts are read several times.
    rows = cut(docs.select("doc_id", "text").join(picked, "doc_id").select("doc_id", "text", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(4)) == 0).alias("rest")))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = {0: Counter(), 1: Counter()}
            for text, toxic in zip(b["text"], b["toxic"]):
                n[int(toxic > 0)].update({f for w in set(tokens(text)) for f in features(w)})
            names = list(n[0].keys() | n[1].keys())
            yield pd.DataFrame({"feature": names, "toxic": [n[1][f] for f in names], "clean": [n[0][f] for f in names]})

    learned = rows.where("not rest")
    n_toxic, n_clean = learned.agg(F.count_if(F.col("toxic") > 0), F.count_if(F.col("toxic") <= 0)).first()
    if not n_toxic or not n_clean:
        return ToxicityModel({}, 1.0, 0.1, np.array([3.0 if n_toxic else -3.0 if n_clean else 0.0, 0.0, 0.0, 0.0]))
    counted = learned.select("text", "toxic").mapInPandas(count, "feature string, toxic long, clean long")
    summed = counted.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    rate = F.col("toxic") / n_toxic / ((F.col("clean") + 0.5) / n_clean)
    best = summed.where((F.col("toxic") >= LEAST_DOCS) & (rate > 2)).orderBy(F.col("toxic").desc(), "feature").limit(MAX_TOKENS).toPandas()
    odds, g = log_odds(best["toxic"].to_numpy(dtype=float), best["clean"].to_numpy(dtype=float), n_toxic, n_clean)
    scores = {f: round(float(o) * GRAIN) / GRAIN for f, o, sure in zip(best["feature"], odds, g) if sure >= LEAST_G2 and o >= LEAST_ODDS}
    return calibrate(rows.where("rest").select("doc_id", "text", "toxic"), scores)


def calibrate(rows: DataFrame, scores: dict[str, float]) -> ToxicityModel:
    """Fit lambda, K and the weights on documents that gave no scores.

    To the driver come the histogram of the clean documents' token scores, the best segment and number of tokens of each
    clean document, and, once lambda and K are known, the four parts of each document's score: all bounded, however long texts are.
    """
    context = rows.sparkSession.sparkContext
    first = context.broadcast(ToxicityModel(scores, 1.0, 0.1, np.zeros(4)))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for b in batches:
            tops = []
            for doc_id, text in zip(b["doc_id"], b["text"]):
                s = first.value.token_scores(tokens(text))
                value, n = np.unique(np.round(s * GRAIN).astype(np.int64), return_counts=True)
                seen.update(dict(zip(value.tolist(), n.tolist())))
                if len(s):
                    tops.append((doc_id, len(s), max((x[2] for x in segments(s)), default=0.0)))
            yield pd.DataFrame(tops, columns=["doc_id", "n", "top"]).assign(value=None)[["doc_id", "value", "n", "top"]]
        yield pd.DataFrame({"doc_id": None, "value": list(seen), "n": list(seen.values()), "top": 0.0})

    kinds = "doc_id long, value long, n long, top double"
    clean = rows.where("toxic <= 0").select("doc_id", "text").mapInPandas(measure, kinds)
    found = clean.groupBy("doc_id", "value").agg(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))).alias("times"), F.max(F.struct("top", "n")).alias("best")).orderBy("doc_id", "value").collect()
    values = {r["value"] / GRAIN: r["times"] for r in found if r["doc_id"] is None}
    lam, k = extreme_values(values, [(r["best"]["top"], r["best"]["n"]) for r in found if r["doc_id"] is not None])
    model = context.broadcast(ToxicityModel(scores, lam, k, np.zeros(4)))

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = [parts([p[2:] for p in model.value.passages(tokens(t))]).tolist() for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "toxic": b["toxic"].astype("int64"), "x": x})

    each = rows.mapInPandas(describe, "doc_id long, toxic long, x array<double>").groupBy("doc_id").agg(F.min(F.struct("toxic", "x")).alias("m")).orderBy("doc_id").collect()
    x, y = np.array([r["m"]["x"] for r in each]), np.array([float(r["m"]["toxic"] > 0) for r in each])
    if not len(x) or y.min() == y.max():
        return ToxicityModel(scores, lam, k, np.array([-2.0, 1.0, 1.0, 1.0]))
    return ToxicityModel(scores, lam, k, logistic(x, y))


def judge(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Add ``toxicity``: score and the significant passages (tokens [start, end), score, chance expectation)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = "struct<score:double, passages:array<struct<start:int, end:int, score:double, expected:double>>>"

    @F.pandas_udf(kind)
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        try:
            for texts in batches:
                out = []
                for text in texts:
                    found = m.passages(tokens(text))
                    out.append((m.score(found), [{"start": a, "end": b, "score": s, "expected": e} for a, b, s, e in found]))
                yield pd.DataFrame(out, columns=["score", "passages"])
        finally:
            m.seen.clear()  # workers live on

    return docs.withColumn("toxicity", toxicity("text"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; see ``fit`` for what it learns from.

    Null and empty texts have no passage and get the score of documents without any.  Repeated rows score alike; a null id
    counts as the empty text in ``held_out``.  An empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = judge(docs, fit(docs, table(spark, sf_dir, "labels")))
    score = F.col("toxicity.score")
    return judged.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), F.size("toxicity.passages").alias("n_passages"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below one half, with their own columns; repeated rows and null ids are judged by their text alone."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    inner = docs.select(*[F.col(c).alias(n) for c, n in zip(docs.columns, names)], F.col("text"))
    kept = judge(inner, fit(docs, labels)).where("toxicity.score < 0.5")
    return kept.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)])
