"""Periodic runs of words, by a sparse dynamic program over diagonals.

A run of period ``q`` is a diagonal of the text against itself, shifted by the
lag ``q``: a stretch of words each of which equals the word ``q`` places
before. Words are read in order; an earlier occurrence of a word at lag ``q``
makes the active match of that lag one longer, and a lag without an occurrence
ends its match, which is emitted at once if it is long enough.

Sparse: of all earlier occurrences of a word only the nearest one with the same
context of ``k`` words matters, for ``k`` = 4, 8, 16 ... and lags from ``k / 2``
to ``k``. Inside a run of smallest period ``q <= k`` the nearest occurrence of
a ``k``-word context is exactly ``q`` back, since a word sequence that is no
power of a shorter one stands in its powers at multiples of its length only.
So each run of at least four periods is one unbroken match of one lag at one
context length, its first and last word follow from the ends of that match, and
a shorter period would have been nearer. A word has one event per context
length: time and memory are ``n log n`` and ``n``, also where one word is
repeated a million times.

All words of a block of texts take a step of the program together: the events
of a context length come from one sort, and the matches are the stretches of
consecutive words with equal lag.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageprism.llm import words as W
from pageprism.llm.common import documents, in_arrow

_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SMALLEST = 4  # periods in the shortest run


def _lags(hashes: np.ndarray, text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(last word, lag) of every context of ``k`` words that stands earlier in its text, too."""
    grams = W.gram_hashes(hashes, k)
    at = np.flatnonzero(text[k - 1 :] == text[: len(text) - k + 1]) if len(grams) else np.zeros(0, np.int64)
    # texts are told apart in the value that is sorted
    own = W.mix(grams[at] ^ W.mix(text[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(own, kind="stable")
    again = np.flatnonzero(own[order[1:]] == own[order[:-1]]) + 1
    here, before = at[order[again]], at[order[again - 1]]
    place = np.argsort(here, kind="stable")
    return here[place] + k - 1, (here - before)[place]


def _matches(ends: np.ndarray, lags: np.ndarray, k: int, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the matches at context length ``k`` that are long enough when their lag ends."""
    low = 0 if k == _SMALLEST else k // 2
    live = (lags > low) & (lags <= k)
    ends, lags = ends[live], lags[live]
    if not len(ends):
        return ends, ends, ends
    fresh = np.ones(len(ends), bool)
    fresh[1:] = (ends[1:] != ends[:-1] + 1) | (lags[1:] != lags[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(ends)) - 1
    period = lags[first]
    start = ends[first] - period - k + 1
    length = ends[last] - start + 1
    long = length >= np.maximum(shortest, _SMALLEST * period)
    return start[long], length[long], period[long]


def block_runs(words: W.Words, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text row, start in the text, length, period) of all runs of a block, by row, start and period."""
    counts = np.diff(words.first)
    text = np.repeat(np.arange(len(counts)), counts)
    hashes, place = words.hash, np.arange(len(text))
    found: list[tuple[np.ndarray, ...]] = []
    k = _SMALLEST
    while len(hashes) >= max(k, shortest):
        ends, lags = _lags(hashes, text, k)
        start, length, period = _matches(ends, lags, k, shortest)
        found.append((place[start], length, period))
        # a run of a longer period q > k has 4 q words, of which 3 q - k + 1 end a context that stands earlier, too
        repeated = np.bincount(text[ends], minlength=len(counts))
        keep = (repeated >= 2 * k + 4) & (counts >= _SMALLEST * (k + 1))
        k *= 2
        mask = keep[text]
        hashes, text, place = hashes[mask], text[mask], place[mask]
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    start, length, period = (np.concatenate(c) for c in zip(*found, strict=True))
    row = np.searchsorted(words.first, start, "right") - 1
    start = start - words.first[row]
    order = np.lexsort((period, start, row))
    return row[order], start[order], length[order], period[order]


def _collapsed(data: bytes, starts: np.ndarray, lengths: np.ndarray, periods: np.ndarray) -> bytes:
    """The words of a text joined by one blank, without those that only repeat the first period of a run."""
    words = data.split()  # of bytes: at ASCII white space
    if len(starts):
        depth = np.zeros(len(words) + 1, np.int64)
        np.add.at(depth, starts + periods, 1)
        np.add.at(depth, starts + lengths, -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(depth)[:-1] == 0).tolist()]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, shortest: int = 6) -> DataFrame:
    """Runs of repeated word sequences, and the texts with each run collapsed to its first period.

    Words are runs without ASCII white space, unchanged, numbered from 0. A run is a stretch of at least
    ``shortest`` words and four times its smallest period that cannot be longer on either side. One row per input
    row: ``doc_id``, ``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed`` (words that
    no run contains after its first period, joined by one blank).

    Null and empty texts have no words, no runs and an empty collapsed text. A very long text is one array of its
    words' hashes; a text is never cut. Equal rows get equal results, an id may be null or repeated, other columns are
    not looked at, an empty table gives an empty result. Words are compared by 64-bit hashes.
    """
    if shortest < 5:
        # a context of four words must fit behind the first period of the shortest run
        raise ValueError("runs of fewer than five words are not found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words in W.blocks(batch.column(1), W.NOT_SPACE, lower=False):
                n = hi - lo
                row, start, length, period = block_runs(words, shortest)
                cuts = np.searchsorted(row, np.arange(n + 1))
                texts = batch.column(1).slice(lo, n).fill_null("").cast(pa.binary()).to_pylist()
                out = [
                    _collapsed(t, start[a:z], length[a:z], period[a:z])
                    for t, a, z in zip(texts, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)
                ]
                runs = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], fields=list(_RUN))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, n), pa.array(np.diff(words.first).astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), runs), pa.array(out, pa.binary()).cast(pa.string(), safe=False),
                    ],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    return in_arrow(documents(docs), run, f"doc_id bigint, n_words bigint, runs {_RUNS}, collapsed string")


def with_planted_runs(docs: DataFrame, every: int = 10) -> DataFrame:
    """Texts (``doc_id``, ``text``), the ones whose id's crc32 ``every`` divides with a periodic tail.

    With ``h`` the unsigned crc32 of the decimal id, ``g = h // 10`` and ``n`` words, each word ``i`` from ``a = g % n``
    on becomes word ``a + (i - a) % p`` of the given text, ``p = 1 + (n - a) // (3 + g % 8)``; words are then joined by one
    blank. Texts without words and rows without an id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = documents(docs).withColumn("h", h)
    chosen = F.coalesce(F.col("h") % every == 0, F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for data, crc in zip(part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist(), strict=True):
                    words = (data or b"").split()
                    if words:
                        g, n = crc // 10, len(words)
                        a = g % n
                        p = 1 + (n - a) // (3 + g % 8)
                        data = b" ".join(words[:a] + [words[a + i % p] for i in range(n - a)])
                    out.append(data)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary()).cast(pa.string(), safe=False)], names=["doc_id", "text"])

    changed = in_arrow(rows.filter(chosen), run, "doc_id bigint, text string")
    return rows.filter(~chosen).select("doc_id", "text").unionByName(changed)
