"""Toxicity by a factorization machine over hashed terms.

A text is the set of its distinct terms (words, and the beginnings of longer
words), hashed into a fixed table. No term is left out: each has a value that
says how much the labelled sample knows of it, the distance between the classes
in standard errors (with one text of noise, so that a term seen once or twice
counts little) plus a share of its spread over texts, and a weight and a short
vector that are learned. Products of vectors are the weights of pairs, so an
insult next to a group's mention can count for more, or less, than both alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageprism.llm import words as W
from pageprism.llm.common import documents, in_arrow, materialize
from pageprism.llm.learn import labelled_sample

_PREFIXES = (4, 5)
_BITS = 18
#: Standard errors that a value of one stands for, and those beyond which it no longer grows; value of a term that half of the texts have.
_ERRORS, _MOST, _SPREAD = 5.0, 10.0, 0.2


class Machine(NamedTuple):
    """Bias, and weight and vector of each hashed term times its value."""

    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def score(self, rows: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
        """Probabilities of ``n`` texts from their distinct terms, given in order of text."""
        z = self.bias + np.bincount(rows, self.weights[terms], n)
        v = self.vectors[terms]
        both = np.stack([np.bincount(rows, v[:, k], n) for k in range(v.shape[1])], axis=1)
        z += 0.5 * ((both * both).sum(axis=1) - np.bincount(rows, (v * v).sum(axis=1), n))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _terms(words: W.Words, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text row, place in the table) of the distinct terms of a block: words, and the first bytes of longer words, which inflected and compound forms share."""
    row = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    heads = [W.prefix_hashes(words, k) for k in _PREFIXES] if len(row) else []
    row = np.concatenate([row, *[row[at] for at, _ in heads]])
    place = (W.mix(np.concatenate([words.hash, *[h for _, h in heads]])) >> np.uint64(64 - _BITS)).astype(np.int64)
    if wanted is not None:
        some = wanted[place]
        row, place = row[some], place[some]
    both = np.unique(row << _BITS | place)
    return both >> _BITS, both & (1 << _BITS) - 1


def term_sets(sample: DataFrame) -> DataFrame:
    """``doc_id``, ``y`` and the distinct hashed terms of each sampled text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words in W.blocks(batch.column(1), W.ALNUM, lower=True):
                row, terms = _terms(words)
                ends = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(terms.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), lists], names=["doc_id", "y", "terms"])

    return in_arrow(sample.select("doc_id", "text", "y"), run, "doc_id bigint, y int, terms array<int>")


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 6000, sample_terms: int = 20_000_000, rank: int = 8,
    epochs: int = 15, least_steps: int = 600, rate: float = 0.02, decay: float = 1e-3,
) -> Machine:
    """A machine from labelled texts (whole texts): at most ``per_class`` of each class, with at most ``sample_terms`` terms in all.

    Both bounds take the texts in order of a hash of their id. Without
    labelled texts the machine gives every text 0.5, with one class near that class.
    What reaches the driver are the terms of the sample, four bytes each.
    """
    sample = materialize(term_sets(labelled_sample(documents(docs), labels, label, per_class)), "terms")
    h = F.xxhash64("doc_id")
    key = ["h", "doc_id", "y"]
    sizes = sample.select(h.alias("h"), "doc_id", "y", F.size("terms").alias("n")).toPandas().sort_values(key)
    inside = sizes["n"].cumsum() <= sample_terms
    if not inside.all():
        last = sizes[inside].iloc[-1] if inside.any() else sizes.iloc[0]
        i = F.col("doc_id")
        same = (i < int(last["doc_id"])) | ((i == int(last["doc_id"])) & (F.col("y") <= int(last["y"])))
        sample = sample.filter((h < int(last["h"])) | ((h == int(last["h"])) & same))
    # one stream of Arrow batches: lists of terms stay flat arrays of four bytes a term
    rows = sample.select(h.alias("h"), "doc_id", "y", "terms").toArrow().combine_chunks().sort_by([(k, "ascending") for k in key])
    y = rows.column("y").to_numpy().astype(np.int64)
    n, n1 = len(y), int(y.sum())
    if n1 in (0, n):
        bias = float(np.log((n1 + 1) / (n - n1 + 1)))
        return Machine(bias, np.zeros(1 << _BITS, np.float32), np.zeros((1 << _BITS, rank), np.float32))
    lists = rows.column("terms").combine_chunks()
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
    flat = lists.flatten().to_numpy()
    has = np.bincount(flat, minlength=1 << _BITS)
    used = np.flatnonzero(has)
    bad = np.bincount(flat[np.repeat(y == 1, np.diff(ends))], minlength=1 << _BITS)[used]
    place = np.zeros(1 << _BITS, np.int32)
    place[used] = np.arange(len(used))
    places, has = place[flat], has[used]
    due = has * (n1 / n)
    error = np.sqrt(due * (1 - n1 / n) + 1)
    value = np.minimum(np.abs(bad - due) / error, _MOST) / _ERRORS + 2 * _SPREAD * np.sqrt(has / n * (1 - has / n))
    bias, weights, vectors = _descend(places, ends, value.astype(np.float32), y, rank, epochs, least_steps, rate, decay)
    table = Machine(bias, np.zeros(1 << _BITS, np.float32), np.zeros((1 << _BITS, rank), np.float32))
    table.weights[used] = weights * value
    table.vectors[used] = vectors * value[:, None]
    return table


def _descend(
    places: np.ndarray, ends: np.ndarray, value: np.ndarray, y: np.ndarray, rank: int, epochs: int, least_steps: int, rate: float, decay: float, size: int = 256
) -> tuple[float, np.ndarray, np.ndarray]:
    """Weights and vectors by stochastic descent with a rate per parameter, on the logistic loss with classes weighed equally."""
    rng = np.random.default_rng(7)
    n, width = len(y), len(value)
    bias, w, v = 0.0, np.zeros(width, np.float32), rng.normal(0, 0.02, (width, rank)).astype(np.float32)
    past = [1e-6, np.full(width, 1e-6, np.float32), np.full((width, rank), 1e-6, np.float32)]
    share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(max(epochs, -(-least_steps * size // max(n, size)))):
        order = rng.permutation(n)
        for at in range(0, n, size):
            some = order[at : at + size]
            m = len(some)
            row = np.repeat(np.arange(m), ends[some + 1] - ends[some])
            cols, own = np.unique(np.concatenate([places[ends[i] : ends[i + 1]] for i in some]), return_inverse=True)
            x = value[cols][own]
            vs, ws = v[cols], w[cols]
            s = np.stack([np.bincount(row, vs[own, k] * x, m) for k in range(rank)], axis=1)
            z = bias + np.bincount(row, ws[own] * x, m) + 0.5 * ((s * s).sum(axis=1) - np.bincount(row, (vs * vs).sum(axis=1)[own] * x * x, m))
            g = share[some] * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[some])
            gx = g[row] * x
            of = lambda a, own=own, k=len(cols): np.bincount(own, a, k) / m  # noqa: B023, E731
            slopes = [
                g.mean(), of(gx) + decay * ws,
                np.stack([of(gx * s[row, k]) for k in range(rank)], axis=1) - of(gx * x)[:, None] * vs + decay * vs,
            ]
            past[0] += slopes[0] ** 2
            bias -= rate * slopes[0] / np.sqrt(past[0])
            for p, q, d in ((w, past[1], slopes[1]), (v, past[2], slopes[2])):
                q[cols] += d * d
                p[cols] -= rate * d / np.sqrt(q[cols])
    return float(bias), w, v


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """``doc_id``, ``score`` (0 to 1), ``predicted`` (score of 0.5 or more) of every row, from whole texts.

    Null and empty texts have no terms and get the score of the bias. Rows with
    null or repeated ids are scored like any other; other columns are not
    looked at; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = (machine.weights != 0) | (machine.vectors != 0).any(axis=1)
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for lo, hi, words in W.blocks(batch.column(1), W.ALNUM, lower=True):
                scores[lo:hi] = machine.score(*_terms(words, wanted), hi - lo)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"]
            )

    return in_arrow(documents(docs), run, "doc_id bigint, score double, predicted int")
