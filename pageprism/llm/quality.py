"""Quality by hierarchical empirical Bayes.

Three levels speak about a document. Its text gives a log likelihood ratio by a
regression on shape features. Its host and, inside the host, its path have Beta
posteriors of the share of good documents: grouped sums over all documents,
shrunk towards the level above with a strength that the spread between sites
itself tells (method of moments). A sparse site stays near the global share, a
large one follows its own documents; the document's posterior adds both.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageprism.llm import words as W
from pageprism.llm.common import documents, in_arrow, materialize
from pageprism.llm.learn import labelled_sample

FEATURES = [
    "words", "repeated_next", "distinct", "word_length", "upper", "digits", "signs", "no_letters", "sign_ends", "short", "bars",
]
#: A text of so many words counts half of its evidence: shares of few words say little.
FEW_WORDS = 4
_CLASS = np.zeros(256, np.int64)
_LETTER, _UPPER, _DIGIT, _SIGN = 1, 2, 3, 4
_CLASS[0x61:0x7B] = _CLASS[0x80:] = _LETTER
_CLASS[0x41:0x5B] = _UPPER
_CLASS[0x30:0x3A] = _DIGIT
for _c in (*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)):
    _CLASS[_c] = _SIGN


class Model(NamedTuple):
    """Scaling, weights (bias last) of the features and their squares, share of good labels."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def ratio(self, x: np.ndarray) -> np.ndarray:
        """Log likelihood ratio of good to bad."""
        return np.clip(_design(x, self.mean, self.scale) @ self.weights, -12, 12)


def _design(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -8, 8)
    return np.concatenate([z, z * z, np.ones((len(z), 1))], axis=1)


def shape_features(words: W.Words) -> np.ndarray:
    """One row of ``FEATURES`` per text; a text without words has zeros."""
    n = np.diff(words.first)
    kind = _CLASS[words.data]
    sums = {}
    for name, wanted in (("letter", kind == _LETTER), ("upper", kind == _UPPER), ("digit", kind == _DIGIT), ("sign", kind == _SIGN), ("bar", words.data == 0x7C)):
        total = np.concatenate([[0], np.cumsum(wanted)])
        sums[name] = total[words.end] - total[words.start]
    length = words.end - words.start
    row = np.repeat(np.arange(len(n)), n)
    again = np.zeros(len(row), np.int64)
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (row[1:] == row[:-1])
    order = np.lexsort((words.hash, row))
    fresh = np.ones(len(row), np.int64)
    fresh[1:] = (words.hash[order][1:] != words.hash[order][:-1]) | (row[order][1:] != row[order][:-1])
    last = np.maximum(words.end - 1, 0)
    ends = ((kind[last] == _SIGN) & (length > 2) & (kind[np.maximum(last - 1, 0)] == _SIGN)).astype(np.int64) if len(row) else row

    def per(values: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=values, minlength=len(n))

    count, size = np.maximum(n, 1), np.maximum(per(length), 1)
    letters = np.maximum(per(sums["letter"] + sums["upper"]), 1)
    distinct = np.bincount(row[order], weights=fresh, minlength=len(n))
    return np.stack(
        [
            np.log1p(n), per(again) / count, distinct / count, per(length) / count, per(sums["upper"]) / letters, per(sums["digit"]) / size,
            per(sums["sign"]) / size, per((sums["letter"] + sums["upper"] == 0).astype(float)) / count, per(ends) / count,
            per((length <= 3).astype(float)) / count, per(sums["bar"]) / size,
        ],
        axis=1,
    )


def _labelled_features(sample: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words in W.blocks(batch.column(1), W.NOT_SPACE, lower=False):
                x = shape_features(words)
                rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(lo, hi - lo), rows], names=["y", "x"])

    return in_arrow(sample.select("doc_id", "text", "y"), run, "y int, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 6000, ridge: float = 1e-2) -> Model:
    """A model from at most ``per_class`` labelled texts of each class (whole texts).

    Classes weigh the same, so the regression gives a likelihood ratio; the share of
    good ones comes from all labels. Without labels of both classes the
    text says nothing and sites decide.
    """
    d = len(FEATURES)
    counts = {r.y: r.n for r in labels.groupBy(F.col(label).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect() if r.y in (0, 1)}
    prior = (counts.get(1, 0) + 1) / (counts.get(0, 0) + counts.get(1, 0) + 2)
    rows = _labelled_features(labelled_sample(documents(docs), labels, label, per_class)).toPandas()
    y = rows["y"].to_numpy(float)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(d), np.ones(d), np.zeros(2 * d + 1), prior)
    x = np.array(rows["x"].tolist())
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order]
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    a = _design(x, mean, scale)
    share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w = np.zeros(a.shape[1])
    penalty = np.full(len(w), ridge * len(y))
    penalty[-1] = 0
    for _ in range(25):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        slope = a.T @ (share * (p - y)) + penalty * w
        bend = (a * (share * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + np.diag(penalty + 1e-9)
        w = w - np.linalg.solve(bend, slope)
    return Model(mean, scale, w, prior)


def evidence(docs: DataFrame, model: Model, host: Column, path: Column) -> DataFrame:
    """``doc_id``, ``host``, ``path``, ``ratio`` of every row, from whole texts; null sites are empty names."""
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ratio = np.zeros(batch.num_rows)
            for lo, hi, words in W.blocks(batch.column(1), W.NOT_SPACE, lower=False):
                n = np.diff(words.first)
                ratio[lo:hi] = model.ratio(shape_features(words)) * n / (n + FEW_WORDS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(ratio)], names=["doc_id", "host", "path", "ratio"]
            )

    return in_arrow(rows, run, "doc_id bigint, host string, path string, ratio double")


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, centre: Column) -> float:
    """Beta strength of shares around ``centre`` by the method of moments over groups (``good`` of ``n``)."""
    share = F.col("good") / F.col("n")
    spread = F.sum(F.col("n") * (share - centre) ** 2) / F.sum("n")
    noise = F.sum(centre * (1 - centre)) / F.sum("n")
    row = groups.agg(spread.alias("v"), noise.alias("e"), F.avg(centre * (1 - centre)).alias("m")).first()
    if row.v is None or row.m is None:
        return 1.0
    extra = max(row.v - row.e, 1e-9)
    return float(min(max(row.m / extra - 1, 1.0), 1e4))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = 0.5, model: Model | None = None) -> DataFrame:
    """Posterior quality of every row.

    ``doc_id``, ``ratio`` (evidence of the text), ``host_share`` and
    ``path_share`` (posterior shares of good documents), ``score`` (posterior
    of this document) and ``kept`` (``score >= threshold``).

    Null and empty texts give no evidence and are judged by their site; null
    hosts and paths are empty names; rows with null or repeated ids are judged
    like any other. Columns other than id, text, host and path are not looked
    at. An empty table gives an empty result; without labels sites alone decide.
    """
    model = model or fit(docs, labels)
    found = materialize(evidence(docs, model, F.col(host), F.col(path)), "evidence")
    odds = float(np.log(model.prior / (1 - model.prior)))
    good = 1 / (1 + F.exp(-(F.col("ratio") + odds)))
    paths = materialize(found.groupBy("host", "path").agg(F.sum(good).alias("good"), F.count(F.lit(1)).alias("n")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    centre = F.lit(model.prior)
    nu = _strength(hosts, centre)
    hosts = hosts.select("host", ((nu * centre + F.col("good")) / (nu + F.col("n"))).alias("host_share"))
    inside = materialize(paths.join(hosts, "host"), "shares")
    mu = _strength(inside, F.col("host_share"))
    sites = inside.select("host", "path", "host_share", ((mu * F.col("host_share") + F.col("good")) / (mu + F.col("n"))).alias("path_share"))
    score = 1 / (1 + F.exp(-(F.col("ratio") + _logit(F.col("path_share")))))
    return found.join(sites, ["host", "path"]).select("doc_id", "ratio", "host_share", "path_share", score.alias("score"), (score >= threshold).alias("kept"))
