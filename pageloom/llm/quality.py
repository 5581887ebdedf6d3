"""Quality by hierarchical empirical Bayes: what the text shows, and what its site is known for.

A logistic classifier over plain text features gives a document's evidence. Labelled rows also give each host, and each
path of a host, a rate of good documents: a host's rate is drawn to the global rate, a path's rate to its host's, the
more the fewer labels it has. How strongly is estimated from how much the rates really differ (method of moments). The
evidence moves the log odds of the site's rate.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hex_key, ship, written

FEATURES = ("log_words", "word_length", "distinct_share", "repeat_share", "capital_share", "digit_share", "symbol_share", "end_marks", "words_a_mark", "line_words", "bar_share", "short_words", "same_lines")
ENDS = re.compile(r"[.!?]+")


def features(text: str | None) -> list[float]:
    """Plain measures of a whole text; a null or empty text has all of them zero."""
    words = text.split() if text else []
    if not words:
        return [0.0] * len(FEATURES)
    n, chars = len(words), len(text)
    ends = len(ENDS.findall(text))
    lines = [line for line in text.split("\n") if line]
    letters = sum(map(str.isalpha, words))
    bare = len("".join(words))
    capitals = sum(map(str.isupper, words))
    digits = len(re.findall(r"\d", text))
    plain = len(re.findall(r"\w", text))
    return [
        np.log1p(n),
        bare / n,
        len(set(words)) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        capitals / n,
        digits / chars,
        (bare - plain) / bare,
        np.log1p(ends) - np.log1p(len(lines)),
        np.log1p(n / (ends + 1)),
        np.log1p(n / len(lines)),
        words.count("|") / n,
        1 - letters / n,
        1 - len(set(lines)) / len(lines),
    ]


@dataclass
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the intercept
    prior: float  # log odds of the rows it was fitted on

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Log odds less those of the fitted rows' rate."""
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.clip(z @ self.weights[:-1] + self.weights[-1] - self.prior, -12, 12)


def fit_classifier(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> Classifier:
    """Ridge logistic regression by Newton steps on features scaled to unit spread and cut at 8; rows of one class, or none, teach only the prior."""
    d = len(FEATURES)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    prior = float(np.log(rate / (1 - rate)))
    if not len(y) or y.min() == y.max():
        return Classifier(np.zeros(d), np.ones(d), np.append(np.zeros(d), prior), prior)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.c_[np.clip((x - mean) / scale, -8, 8), np.ones(len(x))]
    w, penalty = np.append(np.zeros(d), prior), np.append(np.full(d, ridge), 0)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag(penalty + 1e-9), z.T @ (y - p) - penalty * w)
        w = w + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return Classifier(mean, scale, w, prior)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with its features as an array."""

    ship(docs.sparkSession)

    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts])

    return docs.withColumn("features", of(F.col(text))).drop(text)


def learn_classifier(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, key: str = "doc_id", text: str = "text", label: str = "quality") -> Classifier:
    """A classifier from about most_rows labelled rows, taken by hashed id; of a key's rows the least text teaches.

    Rows without key or label teach nothing.
    """
    known = one_label(labels, key, label)
    share = min(1.0, most_rows / max(1, known.count()))
    taken = known.filter(hex_key("quality:", F.col("key").cast("string")) <= int(share * (1 << 60)))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(taken), "key")
    rows = measured(rows.groupBy("key", "good").agg(F.min("text").alias("text")))
    got = rows.select("good", "features").toPandas()
    x = np.array(got["features"].tolist(), float).reshape(-1, len(FEATURES))
    return fit_classifier(x, got["good"].to_numpy(float))


def one_label(labels: DataFrame, key: str, label: str) -> DataFrame:
    """(key, good): a key counts as good only if all its labels say so."""
    return labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min((F.col(label) >= 1).cast("int")).alias("good"))


def strength(groups: DataFrame) -> float:
    """How many labels a parent's rate is worth to its children, from rows (n, good, rate) with the parent's rate.

    The spread of the children's rates beyond what counts of n would show by chance, as a beta prior has it.
    """
    m = F.col("rate") * (1 - F.col("rate"))
    spread = F.col("n") * F.pow(F.col("good") / F.col("n") - F.col("rate"), 2)
    total, chance, n, k, squares = groups.filter((F.col("n") > 0) & (m > 0)).agg(F.sum(spread), F.sum(m), F.sum("n"), F.count("*"), F.sum(F.col("n") * m)).first()
    if not k or not n or n <= k:
        return 1000.0
    extra = (total - chance) / max((squares - chance) * 1.0, 1e-9)  # intra-group correlation
    return float(min(max(1 / extra - 1, 1.0), 1000.0)) if extra > 0 else 1000.0


def site_rates(sites: DataFrame, most_levels: str = "path") -> tuple[DataFrame, float]:
    """(host, path, site_rate) of labelled (host, path, good) rows, and the global rate; null hosts and paths are sites too.

    Counts are aggregated before anything is joined, so a host with a third of all rows is one row here.
    """
    paths = written(sites.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("good").alias("good")))
    n, good = paths.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()
    overall = (good + 1.0) / (n + 2.0)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    m_host = strength(hosts.withColumn("rate", F.lit(overall)))
    hosts = hosts.select(F.col("host").alias("h"), ((F.col("good") + m_host * overall) / (F.col("n") + m_host)).alias("host_rate"))
    joined = written(paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h"))
    m_path = strength(joined.withColumn("rate", F.col("host_rate")))
    rate = (F.col("good") + m_path * F.col("host_rate")) / (F.col("n") + m_path)
    return joined.select("host", "path", "host_rate", rate.alias("path_rate")), float(overall)


def score_quality(docs: DataFrame, labels: DataFrame, learn: Column, host: Column, path: Column, threshold: float = 0.5, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """One row a document: key, score (0 to 1), predicted (1 if score >= threshold), site_rate, evidence.

    learn: which rows of docs and labels (by the key) may be learned from; host and path: columns of docs. A site
    without labels has its host's rate, a host without any the global one. Null and empty texts are scored by their
    features, all zero. Repeated rows score alike; an empty table stays empty; without labels all rates are 1/2.
    """
    usable = labels.filter(learn)
    model = learn_classifier(docs.filter(learn), usable, key=key, text=text, label=label)
    placed = docs.select(F.col(key).alias("key"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col(text).alias("text"))
    train = docs.filter(learn).select(F.col(key).alias("key"), host.cast("string").alias("host"), path.cast("string").alias("path"))
    rates, overall = site_rates(train.join(one_label(usable, key, label), "key").select("host", "path", "good"))

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.evidence(np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))))

    scored = placed.withColumn("evidence", of(F.col("text"))).drop("text")
    null = F.lit("\x00")
    site = lambda df: df.withColumn("host_", F.coalesce("host", null)).withColumn("path_", F.coalesce("path", null))
    paths = written(site(rates).select("host_", "path_", "path_rate"))
    hosts = written(site(rates).groupBy("host_").agg(F.first("host_rate").alias("host_rate")))
    out = site(scored).join(paths, ["host_", "path_"], "left").join(hosts, "host_", "left")
    rate = F.coalesce("path_rate", "host_rate", F.lit(overall))
    odds = F.log(rate / (1 - rate)) + F.col("evidence")
    score = 1 / (1 + F.exp(-odds))
    return out.select(F.col("key").alias(key), score.alias("score"), (score >= threshold).cast("int").alias("predicted"), rate.alias("site_rate"), "evidence")
