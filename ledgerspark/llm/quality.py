"""Quality rules: an isolation forest over rule statistics.

Each document gets counts (words, symbols, repeated lines and windows) and rates from them.  A forest of
random splits, grown on a bounded sample of labelled documents, gives each document its mean path length:
short paths mean anomalous documents.  The threshold is calibrated on the same labelled rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.llm.common import WORD, hash_sample, table

#: Labelled rows that the forest and its threshold are fitted on, at most.
MAX_LABELLED = 4000
TREES, TREE_ROWS, SEED = 100, 256, 17
WINDOW = 5
#: Base rules: words of a text at least, and the percentage of words in repeated windows at most.
LEAST_WORDS, MOST_REPEATED = 10, 20
#: What losing a share of the good documents weighs against keeping that share of the bad ones.
GOOD_COST = 25

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATES = ["word_len", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "bare_rate", "odd_rate"]
_WORD = re.compile(WORD)
_SYMBOL = re.compile(r"[#*$%&|<>]")
_BARE = re.compile(r"(?<!\S)[^\w\s]+(?!\S)")
_ODD = re.compile(r"[^\w\s.,;:'’\-()?\"]")


def repeated_words(words: list[str]) -> int:
    """Words that lie in windows of ``WINDOW`` words found twice or more; memory is a few numbers a word."""
    n = len(words)
    if n <= WINDOW:
        return 0
    code, names = pd.factorize(np.array(words, dtype=object))
    key = code.astype(np.int64)
    for i in range(1, WINDOW):  # numbers of distinct windows of i + 1 words, from those of i words
        key = pd.factorize(key[:-1] * len(names) + code[i:])[0]
    at = np.flatnonzero(np.bincount(key)[key] > 1)
    covered = np.zeros(n + 1, dtype=np.int64)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + WINDOW, -1)
    return int((np.cumsum(covered) > 0).sum())


def statistics(text: str | None) -> list[float]:
    """``BASE`` counts and ``RATES`` of one whole text; a null text has no words.

    Rates: mean code points a word; symbols, other odd characters and upper-case Latin letters a code point of words;
    lines that repeat an earlier one; words in repeated windows; words without any letter or digit.
    """
    text = text or ""
    words = _WORD.findall(text)
    n = len(words)
    chars = sum(map(len, words))
    symbols = len(_SYMBOL.findall(text))
    seen: set[str] = set()
    lines = dup_lines = 0
    for line in text.split("\n"):
        if _WORD.search(line):
            lines += 1
            dup_lines += line in seen
            seen.add(line)
    repeat = repeated_words(words)
    some = max(n, 1)
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    upper = int(((points >= 65) & (points <= 90) | (points >= 192) & (points <= 222)).sum())
    bare = len(_BARE.findall(text))
    odd = len(_ODD.findall(text))
    return [n, chars, symbols, dup_lines, repeat, chars / some, symbols / max(chars, 1), dup_lines / max(lines, 1), repeat / some, upper / max(chars, 1), bare / some, odd / max(chars, 1)]


STATS = f"struct<{', '.join([f'{c}: long' for c in BASE] + [f'{c}: double' for c in RATES])}>"


def measured(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([statistics(t) for t in texts], columns=BASE + RATES).astype(dict.fromkeys(BASE, "int64") | dict.fromkeys(RATES, "float64"))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add a struct ``stats`` of ``BASE`` (long) and ``RATES`` (double); other columns pass through JVM-side."""
    return docs.withColumn("stats", F.pandas_udf(measured, STATS)(F.col(text)))


@dataclass
class Forest:
    """Isolation trees as arrays: for each node its feature (-1 in leaves), cut, left child, and path length."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    length: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score 2 ** (-mean path length / expected length) of each row, in (0, 1)."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                f = self.feature[t, node]
                right = x[rows, np.maximum(f, 0)] >= self.cut[t, node]
                node = np.where(f < 0, node, self.left[t, node] + right)
            total += self.length[t, node]
        return 2.0 ** (-total / len(self.feature) / mean_length(TREE_ROWS))


def mean_length(n: float) -> float:
    """Mean path length of an unsuccessful search in a random binary tree of n keys."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def grow_forest(x: np.ndarray, low: np.ndarray, high: np.ndarray, seed: int = SEED) -> Forest:
    """Grow ``TREES`` trees, each on ``TREE_ROWS`` random rows of ``x``, by uniform cuts of random features.

    Cuts are drawn from the node's box, which starts as [``low``, ``high``]: a box wider than the rows lets a
    tree cut off regions without any of them, so that strangers to ``x`` end after few splits.
    """
    rng = np.random.default_rng(seed)
    depth = int(np.ceil(np.log2(TREE_ROWS))) + 6
    grown = []
    for _ in range(TREES):
        sample = x[rng.choice(len(x), min(TREE_ROWS, len(x)), replace=False)]
        nodes, todo = [[-1, 0.0, 0, 0.0]], [(0, sample, low, high, 0)]
        while todo:
            at, rows, lo, hi, level = todo.pop()
            varied = np.flatnonzero(hi > lo)
            if len(rows) <= 1 or level == depth or not len(varied):
                nodes[at] = [-1, 0.0, 0, level + mean_length(len(rows))]
                continue
            f = rng.choice(varied)
            cut = rng.uniform(lo[f], hi[f])
            nodes[at] = [f, cut, len(nodes), 0.0]
            right = rows[:, f] >= cut
            below, above = hi.copy(), lo.copy()
            below[f] = above[f] = cut
            todo += [(len(nodes), rows[~right], lo, below, level + 1), (len(nodes) + 1, rows[right], above, hi, level + 1)]
            nodes += [[-1, 0.0, 0, float(level + 1)]] * 2
        grown.append(nodes)
    width = max(map(len, grown))
    padded = np.array([g + [[-1, 0.0, 0, 0.0]] * (width - len(g)) for g in grown])
    return Forest(padded[..., 0].astype(np.int64), padded[..., 1], padded[..., 2].astype(np.int64), padded[..., 3], depth)


def calibrate(scores: np.ndarray, good: np.ndarray) -> float:
    """The threshold with the least share of bad rows kept plus ``GOOD_COST`` times the share of good rows lost.

    It lies in the middle between the two scores around the best cut; without bad rows, above all scores.
    """
    if good.all() or not good.any():
        return 1.0 if good.all() else 0.0
    order = np.argsort(scores, kind="stable")
    s, g = scores[order], good[order]
    kept_bad = np.concatenate([[0], np.cumsum(~g)]) / (~g).sum()
    lost_good = 1 - np.concatenate([[0], np.cumsum(g)]) / g.sum()
    edges = np.concatenate([[0.0], (s[:-1] + s[1:]) / 2, [1.0]])
    return float(edges[np.argmin(kept_bad + GOOD_COST * lost_good)])


@dataclass
class QualityModel:
    forest: Forest | None
    threshold: float

    def keeps(self, rates: np.ndarray) -> np.ndarray:
        """Whether the forest finds each row usual."""
        return np.ones(len(rates), dtype=bool) if self.forest is None else self.forest.score(rates) <= self.threshold


def base_failed() -> Column:
    """Fewer than 10 words, or more than a fifth of the words in repeated windows."""
    return (F.col("stats.n_words") < LEAST_WORDS) | (F.col("stats.n_repeat_words") * 100 > F.col("stats.n_words") * MOST_REPEATED)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> QualityModel:
    """Fit the forest on labelled good documents and calibrate it on good and bad ones.

    The ``max_labelled`` labelled rows first in hash order are used (all, if there are fewer), so the driver
    sees a bounded number of rows of statistics, and only these rows are measured.  Of a repeated id the row with the least
    statistics counts, with its least label.  Rows that fail the base rules are left out, by the driver: a filter
    here would be pushed below the join and measure all documents.  Without good rows there is no forest, and the base rules alone decide.
    """
    some = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = hash_sample(some, max_labelled, "doc_id")
    rows = with_statistics(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"))
    each = rows.groupBy("doc_id").agg(F.min(F.struct("quality", *[f"stats.{c}" for c in BASE + RATES])).alias("row"))
    found = np.array([tuple(r["row"]) for r in each.collect()], dtype=np.float64).reshape(-1, 1 + len(BASE) + len(RATES))
    words, repeated = found[:, 1 + BASE.index("n_words")], found[:, 1 + BASE.index("n_repeat_words")]
    found = found[(words >= LEAST_WORDS) & (repeated * 100 <= words * MOST_REPEATED)][:, [0, *range(1 + len(BASE), found.shape[1])]]
    found = found[np.lexsort(found.T)]
    good, x = found[:, 0] > 0, found[:, 1:]
    if not good.any():
        return QualityModel(None, 1.0)
    forest = grow_forest(x[good], x.min(axis=0), x.max(axis=0))
    return QualityModel(forest, calibrate(forest.score(x), good))


def judge(docs: DataFrame, model: QualityModel) -> DataFrame:
    """Add ``stats``, ``base_failed`` and ``kept`` to documents."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(f"{STATS[:-1]}, usual: boolean>")
    def stats(texts: pd.Series) -> pd.DataFrame:
        found = measured(texts)
        return found.assign(usual=shared.value.keeps(found[RATES].to_numpy(dtype=np.float64)))

    judged = docs.withColumn("stats", stats("text")).withColumn("base_failed", base_failed())
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("stats.usual"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document.

    Null and empty texts have no words and fail the base rules.  Repeated rows are judged alike, null ids too.  Without
    usable labels the base rules alone decide; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    judged = judge(docs.select("doc_id", "text"), fit(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", *[F.col(f"stats.{c}").alias(c) for c in BASE], "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns; repeated rows and null ids are judged by their text alone."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    inner = docs.select(*[F.col(c).alias(n) for c, n in zip(docs.columns, names)], F.col("text"), F.col("doc_id"))
    kept = judge(inner, fit(docs, labels)).where("kept")
    return kept.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)])
