"""Quality classifier: evidence of a document, combined with what its host and its path are like.

A logistic model of cheap text features gives each document a probability. Means of these over hosts and over paths are
shrunk, paths towards their host and hosts towards the whole corpus, the more the fewer documents they have, by strengths
that the corpus itself gives (empirical Bayes). The site's odds then replace the model's average odds in the document's.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import computed, cut, fresh, words
from .quality import COMMON_WORDS

FEATURES = ["log_words", "upper", "digit", "mark", "wide", "space", "distinct", "common", "word_length", "dup_lines", "top_mark"]


#: Up to so many sites are sent to all executors.
SENT = 100_000


@dataclass(frozen=True)
class Training:
    """sample: the most labelled documents the model is fitted to; those whose ids have the least hashes are taken."""

    sample: int = 20_000
    ridge: float = 1.0
    rounds: int = 25
    keep: float = 0.5


@dataclass(frozen=True)
class Model:
    centre: list[float]
    scale: list[float]
    weights: list[float]
    bias: float


def features(text: Column, w: Column) -> Column:
    """array<double> in the order of FEATURES, of a text that is not null and its words."""
    n, chars = F.greatest(F.lit(1), F.size(w)), F.greatest(F.lit(1), F.length(text))
    listed = sorted({x for each in COMMON_WORDS.values() for x in each})
    count = lambda p: F.regexp_count(text, F.lit(p)) / chars
    ends = F.filter(F.split(text, "\n"), lambda x: x != "")
    return F.array(
        F.log1p(F.size(w).cast("double")),
        F.length(F.regexp_replace(text, "[^A-Z]+", "")) / chars,
        F.length(F.regexp_replace(text, "[^0-9]+", "")) / chars,
        count(r"[!-/:-@\[-`{-~]"),
        (F.octet_length(text) - F.length(text)) / chars,
        (F.length(text) - F.length(F.array_join(w, ""))) / chars,
        F.size(F.array_distinct(w)) / n,
        F.size(F.filter(w, lambda x: x.isin(listed))) / n,
        F.length(F.array_join(w, "")) / n,
        (F.size(ends) - F.size(F.array_distinct(ends))) / F.greatest(F.lit(1), F.size(ends)),
        count(r"[#*$%&|<>!]"),
    )


def with_features(df: DataFrame, text: str, out: str) -> DataFrame:
    [w] = fresh(df, "words_of")
    whole = F.coalesce(F.col(text), F.lit(""))
    return computed(df.withColumn(w, words(whole)), out, features(whole, F.col(w))).drop(w)


def fit(x: np.ndarray, y: np.ndarray, training: Training = Training()) -> Model:
    """Ridge logistic regression by Newton steps on standardised features; of no rows or one class, a constant."""
    k = len(FEATURES)
    if len(y) == 0:
        return Model([0.0] * k, [1.0] * k, [0.0] * k, 0.0)
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.hstack([np.clip((x - centre) / scale, -8, 8), np.ones((len(y), 1))])
    w = np.zeros(k + 1)
    penalty = np.diag([training.ridge] * k + [1e-3])
    for _ in range(training.rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return Model(centre.tolist(), scale.tolist(), w[:-1].tolist(), float(w[-1]))


def probability(found: Column, model: Model) -> Column:
    parts = [F.greatest(F.lit(-8.0), F.least(F.lit(8.0), (F.get(found, F.lit(i)) - c) / s)) * w for i, (c, s, w) in enumerate(zip(model.centre, model.scale, model.weights, strict=True))]
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), reduce(lambda a, b: a + b, parts) + model.bias))))


def _strength(total: int, square: float, groups: int, between: float, squares: float, mean_squares: float) -> float:
    """Documents that a prior is worth: variance within groups over variance between their true means, by moments."""
    within = max((square - mean_squares) / max(1, total - groups), 1e-6)
    apart = (between - max(0, groups - 1) * within) / max(1e-9, total - squares / max(1, total))
    return min(1e6, within / apart) if apart > 1e-9 else 1e6


def _moments(sites: DataFrame, key: str, prior: Column) -> float:
    """The strength for groups with sums (n, p, pp) towards the mean that `prior` gives each."""
    mean = F.col(f"{key}_p") / F.col(f"{key}_n")
    n = F.col(f"{key}_n")
    row = sites.agg(F.sum(n), F.sum(f"{key}_pp"), F.count("*"), F.sum(n * (mean - prior) ** 2), F.sum(n * n.cast("double")), F.sum(n * mean**2)).first()
    return _strength(row[0] or 0, row[1] or 0.0, row[2] or 0, row[3] or 0.0, row[4] or 0.0, row[5] or 0.0)


def training_rows(found: DataFrame, labels: DataFrame, training: Training) -> list:
    """At most training.sample rows (found, label), one for each labelled id, those whose ids have the least hashes.

    A limit on the hash that the number of labels gives comes first, so only about that many labels meet the features and
    only their rows leave the executors. found has (id, found), labels (of, label) with one row for each id."""
    n = labels.count()
    share = min(1.0, (1.1 * training.sample + 1000) / max(1, n))
    if share < 1:  # hashes are spread evenly, so the limit lets through the sample and a tenth more
        labels = labels.where(F.xxhash64("of") < int(-(2**63) + share * 2**64))
    near = found.join(F.broadcast(labels), F.col("id") == F.col("of"))  # of at most twice the sample
    one = near.groupBy("of").agg(F.min(F.struct("found", "label")).alias("x")).select("x.*", F.xxhash64("of").alias("h"), "of")
    return one.orderBy("h", "of").limit(training.sample).collect()


def classify(df: DataFrame, labels: DataFrame, training: Training = Training(), text: str = "text", id_col: str = "doc_id", host: str = "host", path: str = "path") -> DataFrame:
    """(id, host, path, evidence, host_mean, path_mean, posterior, kept) of each row of documents.

    labels has the id and `label`, 0 or 1; rows of other labels or of null ids are left out, and of several labels of one
    id the greatest counts. The features of every document are read once and written as numbers; the model is fitted to at
    most training.sample labelled ones, and the rest is combine(). Null text counts as empty and is not kept; a null host
    or path is a site of its own; repeated rows count as often as they come and get equal results; an empty table gives none."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(host).alias("host"), F.col(path).alias("path"))
    found = cut(with_features(docs, "text", "found").withColumn("empty", F.length(F.trim(F.coalesce("text", F.lit("")))) == 0).drop("text"))
    marked = labels.select(F.col(id_col).alias("of"), F.col("label").cast("int").alias("label")).where("label in (0, 1) and of is not null").groupBy("of").agg(F.max("label").alias("label"))
    sample = training_rows(found.select("id", "found"), cut(marked), training)
    model = fit(np.array([r["found"] for r in sample]).reshape(-1, len(FEATURES)), np.array([r["label"] for r in sample], dtype=float), training)
    scored = cut(found.select("id", "host", "path", "empty", probability(F.col("found"), model).alias("p")))
    return combine(scored, training.keep).select(F.col("id").alias(id_col), F.col("host").alias(host), F.col("path").alias(path), "evidence", "host_mean", "path_mean", "posterior", "kept")


def combine(scored: DataFrame, keep: float) -> DataFrame:
    """Adds evidence, host_mean, path_mean, posterior and kept to written rows (id, host, path, empty, p).

    All is sums over all rows by host and path, formed before shuffling. A document's own p is taken out of its site's
    means, so that nothing counts twice."""
    sums = lambda k: (F.count("*").alias(f"{k}_n"), F.sum("p").alias(f"{k}_p"), F.sum(F.col("p") ** 2).alias(f"{k}_pp"))
    paths = cut(scored.groupBy("host", "path").agg(*sums("path")))
    hosts = cut(paths.groupBy(F.col("host").alias("at")).agg(F.sum("path_n").alias("host_n"), F.sum("path_p").alias("host_p"), F.sum("path_pp").alias("host_pp")))
    whole = hosts.agg(F.sum("host_p"), F.sum("host_n")).first()
    mean = min(1 - 1e-6, max(1e-6, (whole[0] or 0.0) / max(1, whole[1] or 0)))
    k_host = _moments(hosts, "host", F.lit(mean))
    shrunk = (k_host * mean + F.col("host_p")) / (k_host + F.col("host_n"))
    sites = cut(paths.join(hosts, F.col("host").eqNullSafe(F.col("at"))).select(F.col("host").alias("at"), F.col("path").alias("of"), "path_n", "path_p", "path_pp", "host_n", "host_p"))
    k_path = _moments(sites, "path", shrunk)
    few = F.broadcast(sites) if sites.count() <= SENT else sites
    placed = scored.join(few, F.col("host").eqNullSafe(F.col("at")) & F.col("path").eqNullSafe(F.col("of")))
    host_mean = (k_host * mean + F.col("host_p") - F.col("p")) / (k_host + F.col("host_n") - 1)
    path_mean = (k_path * F.col("host_mean") + F.col("path_p") - F.col("p")) / (k_path + F.col("path_n") - 1)
    odds = lambda p: F.log(F.greatest(F.lit(1e-6), p) / F.greatest(F.lit(1e-6), 1 - p))
    placed = placed.withColumn("host_mean", host_mean).withColumn("path_mean", path_mean)
    placed = placed.withColumn("evidence", odds(F.col("p")) - float(np.log(mean / (1 - mean))))
    placed = placed.withColumn("posterior", 1 / (1 + F.exp(-(F.col("evidence") + odds(F.col("path_mean"))))))
    return placed.select(*scored.columns, "evidence", "host_mean", "path_mean", "posterior", ((F.col("posterior") >= keep) & ~F.col("empty")).alias("kept"))
