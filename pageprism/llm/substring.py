"""Duplicate passages by relative Lempel-Ziv parsing against the corpus itself.

The reference of a document is every document with a smaller id. It is kept as
an index of content-defined blocks: of each window of ``window`` words the
least 16-word gram is its anchor, and the run of windows around one anchor is a
block (up to 35 windows). The same window has the same anchor wherever it
stands, so an index by anchor finds every occurrence, and only blocks, about
one per 18 words, are shuffled. Each block carries the place where it stands first in the
reference: the smallest document, and the word in it.

A document is parsed from left to right into factors (start, length, reference
document, place): a factor begins with a window that the reference has, and goes on
word by word as long as the reference of the next window goes on in the same
document at the next word. Where an anchor stands in unequal blocks, a factor may
begin or end inside a block: at these boundaries the single windows are
looked up as well. The words of factors, all at least ``window`` long, are the
duplicate spans. Windows that lie across the end of a factor are checked, too, so factors may overlap.

Grouped minima with map-side combine and joins split by adaptive execution do
the rest: a passage in a third of all documents is one row per task before the
shuffle, and no pairs are formed. Keys are two 64-bit hashes.
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

_LAST = (1 << 63) - 1
_PART = "struct<i:int,n:int,doc:bigint,place:int>"
_FACTOR = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("doc", pa.int64()), ("place", pa.int64())])
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
#: Windows in a block at most.
_ALL = 63


class Blocks(NamedTuple):
    """Blocks of a batch part: text row, first and last window, anchor and block hash."""

    row: np.ndarray
    low: np.ndarray
    high: np.ndarray
    anchor: np.ndarray
    key: np.ndarray
    windows: np.ndarray  # hash of the window at each word position


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the first least value in each run of ``width``."""
    v, at, have = values, np.arange(len(values), dtype=np.int32), 1
    while have < width:
        step = min(have, width - have)
        a, b = v[: len(v) - step], v[step:]
        right = b < a
        at = np.where(right, at[step:], at[: len(at) - step])
        v = np.where(right, b, a)
        have += step
    return at


def content_blocks(words: W.Words, window: int, gram: int) -> Blocks:
    counts = np.diff(words.first)
    row = np.repeat(np.arange(len(counts)), counts)
    n = len(row)
    if n < window:
        none = np.zeros(0, np.int64)
        return Blocks(none, none, none, none.view(np.uint64), none.view(np.uint64), none.view(np.uint64))
    grams = W.gram_hashes(words.hash, gram)
    anchor = _least(grams, window - gram + 1)
    inside = np.flatnonzero(row[: n - window + 1] == row[window - 1 :])
    at = anchor[inside]
    new = np.ones(len(inside), bool)
    new[1:] = (at[1:] != at[:-1]) | (inside[1:] != inside[:-1] + 1) | (row[inside[1:]] != row[inside[:-1]])
    begin = np.flatnonzero(new)
    low = inside[begin]
    high = inside[np.append(begin[1:], len(inside)) - 1] if len(inside) else low
    spot = at[begin]
    key = W.span_hashes(words.hash, low, high + window) ^ W.mix((spot - low).astype(np.uint64))
    return Blocks(row[low], low, high, grams[spot], key, W.gram_hashes(words.hash, window))


def _index(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """``doc``, ``t``, ``anchor``, ``block``, ``low``: the distinct blocks of each document and the word at which each begins first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi, words in W.blocks(batch.column(2), W.NOT_SPACE, lower=False):
                b = content_blocks(words, window, gram)
                order = np.lexsort((b.key, b.row))
                row, key = b.row[order], b.key[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
                order = order[new]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[lo:hi][b.row[order]]), pa.array(marks[lo:hi][b.row[order]]),
                        pa.array(W.signed(b.anchor[order])), pa.array(W.signed(b.key[order])),
                        pa.array((b.low[order] - words.first[b.row[order]]).astype(np.int32)),
                    ],
                    names=["doc", "t", "anchor", "block", "low"],
                )

    return in_arrow(texts, run, "doc bigint, t int, anchor bigint, block bigint, low int")


def _windows(wanted: DataFrame, window: int, gram: int) -> DataFrame:
    """Every window of the wanted blocks, looked up in the smallest document that has the block, and the word at which it begins there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = batch.column(0).to_numpy()
            lists = batch.column(2)
            ends, flat = np.asarray(lists.offsets), np.asarray(lists.values).view(np.uint64)
            for lo, hi, words in W.blocks(batch.column(1), W.NOT_SPACE, lower=False):
                b = content_blocks(words, window, gram)
                cuts = np.searchsorted(b.row, np.arange(hi - lo + 1))
                chosen = []
                for d in range(hi - lo):
                    a, z = cuts[d], cuts[d + 1]
                    _, where = np.unique(b.key[a:z], return_index=True)
                    where = where + a
                    chosen.append(where[np.isin(b.key[where], flat[ends[lo + d] : ends[lo + d + 1]])])
                pick = np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
                size = b.high[pick] - b.low[pick] + 1
                owner = np.repeat(pick, size)
                at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(W.signed(b.anchor[owner])), pa.array(W.signed(b.key[owner])), pa.array(at.astype(np.int32)),
                        pa.array(W.signed(b.windows[b.low[owner] + at])), pa.array(first[lo:hi][b.row[owner]]),
                        pa.array((b.low[owner] + at - words.first[b.row[owner]]).astype(np.int32)),
                    ],
                    names=["anchor", "block", "i", "w", "first", "place"],
                )

    return in_arrow(wanted, run, "anchor bigint, block bigint, i int, w bigint, first bigint, place int")


def _parse(flagged: DataFrame, window: int, gram: int) -> DataFrame:
    """Factors, spans and remaining text of each document from the known parts of its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, keys, parts = batch.columns
            n_words, spans, factors, kept = [], [], [], []
            raw = texts.fill_null("").cast(pa.binary()).to_pylist()
            has = np.asarray(keys.is_valid())
            for row, text in enumerate(raw):
                words = text.split()  # of bytes: at ASCII white space
                n_words.append(len(words))
                own: list[tuple[int, int, int, int]] = []
                if has[row]:
                    own = _factors(texts.slice(row, 1), keys[row].values, parts[row].values, window, gram)
                    found, rest, last = _covered(own), [], 0
                    for a, z in found:
                        rest += words[last:a]
                        last = z
                    words = rest + words[last:]
                    spans.append([{"start": a, "end": z} for a, z in found])
                else:
                    spans.append([])
                factors.append([dict(zip(("start", "length", "doc", "place"), f, strict=True)) for f in own])
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [
                    ids, pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(_SPAN)), pa.array(factors, pa.list_(_FACTOR)),
                    pa.array(kept, pa.binary()).cast(pa.string(), safe=False),
                ],
                names=["doc_id", "n_words", "spans", "factors", "kept_text"],
            )

    schema = (
        "doc_id bigint, n_words bigint, spans array<struct<start:bigint,end:bigint>>,"
        " factors array<struct<start:bigint,length:bigint,doc:bigint,place:bigint>>, kept_text string"
    )
    return in_arrow(flagged, run, schema)


def _covered(factors: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """Word spans that factors (in order of start) cover."""
    out: list[tuple[int, int]] = []
    for start, length, _, _ in factors:
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], start + length))
        else:
            out.append((start, start + length))
    return out


def _factors(text: pa.Array, keys: pa.Array, parts: pa.Array, window: int, gram: int) -> list[tuple[int, int, int, int]]:
    """(start, length, reference document, place) of the factors of one document."""
    known = np.asarray(keys).view(np.uint64)
    ends, flat = np.asarray(parts.offsets), parts.values
    i, n, doc, place = (np.asarray(flat.field(f)) for f in ("i", "n", "doc", "place"))
    order = np.argsort(known)
    known = known[order]
    for _, _, words in W.blocks(text, W.NOT_SPACE, lower=False):
        b = content_blocks(words, window, gram)
        spot = np.minimum(np.searchsorted(known, b.key), len(known) - 1)
        hit = np.flatnonzero(known[spot] == b.key)
        own = order[spot[hit]]
        many = ends[own + 1] - ends[own]
        block = np.repeat(hit, many)
        part = np.repeat(ends[own], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        begin = b.low[block] + i[part]
        count = np.minimum(n[part], b.high[block] + 1 - begin)
        ref, at = doc[part], place[part]
        # parts in order; one that goes on where the one before ends, in the reference, too, is the same factor
        down = np.argsort(begin, kind="stable")
        begin, count, ref, at = begin[down], count[down], ref[down], at[down]
        new = np.ones(len(begin), bool)
        new[1:] = (begin[1:] != begin[:-1] + count[:-1]) | (ref[1:] != ref[:-1]) | (at[1:] != at[:-1] + count[:-1])
        first = np.flatnonzero(new)
        size = np.add.reduceat(count, first) if len(first) else first
        return list(zip(begin[first].tolist(), (size + window - 1).tolist(), ref[first].tolist(), at[first].tolist(), strict=True))
    return []


def substring_dedup(docs: DataFrame, window: int = 50, gram: int = 16) -> DataFrame:
    """Passages of at least ``window`` words that a document with a smaller id has, too.

    Words are runs without ASCII white space, unchanged. Per input row:
    ``doc_id``, ``n_words``, ``spans`` (start and end word of each removed
    stretch), ``factors`` (``start`` and ``length`` of each copied stretch, and the ``doc`` and word, ``place``, at which it stands first) and
    ``kept_text`` (the other words, joined by one space). Windows
    are judged on the input; repeats inside one document stay.

    Null and empty texts have no words, no spans and an empty kept text, as
    have texts that are all white space; shorter texts than a window stay whole. A row without an id counts as later
    than every id. Rows that share an id do not remove each other's passages. Other columns are not
    looked at. An empty table gives an empty result.
    """
    if not 0 < gram <= window <= gram + 62:
        raise ValueError("a window must hold 1 to 63 grams")
    # rows of one id (or without) are told apart by a hash of their text: arrays of blocks are of one text, not of all these.
    # Texts of equal hash share an array, in which each finds its own blocks.
    own = documents(docs).withColumns({"doc": F.coalesce("doc_id", F.lit(_LAST)), "t": F.hash("text")})
    texts = own.select("doc", "t", "text")
    index = materialize(_index(texts, window, gram), "blocks")
    anchors = (
        index.groupBy("anchor")
        .agg(F.min(F.struct("doc", "t", "low")).alias("first"), F.max("doc").alias("last"), F.min("block").alias("p"), F.max("block").alias("q"))
        .filter("first.doc < last")
        .select("anchor", F.col("first.doc").alias("first"), F.col("first.low").alias("place"), (F.col("p") != F.col("q")).alias("unequal"))
    )
    # written first: a join of two tables is split at hot anchors, one with a grouping in its stage is not
    anchors = materialize(anchors, "anchors")
    placed = materialize(index.drop("low").join(anchors, "anchor").filter("unequal OR doc > first"), "placed")

    # factor boundaries: windows of the unequal blocks
    edges = placed.filter("unequal").groupBy("anchor", "block").agg(F.min("doc").alias("doc"), F.min_by("t", "doc").alias("t"))
    wanted = materialize(edges.groupBy("doc", "t").agg(F.collect_list("block").alias("blocks")), "wanted")
    # copies of a text under one id give the same windows
    windows = _windows(texts.join(wanted, ["doc", "t"]).select("doc", "text", "blocks"), window, gram).distinct()
    windows = materialize(windows, "windows")
    least = windows.groupBy("anchor", "w").agg(F.min(F.struct("first", "place")).alias("m"))
    known = windows.drop("place").join(least, ["anchor", "w"]).groupBy("anchor", "block").agg(F.collect_set(F.struct("i", "m")).alias("ws"))
    known = materialize(known.select("anchor", "block", _joined(F.sort_array("ws")).alias("parts")), "known")
    earlier = F.filter("parts", lambda x: x["doc"] < F.col("doc"))
    whole = F.array(F.struct(F.lit(0).alias("i"), F.lit(_ALL).alias("n"), F.col("first").alias("doc"), F.col("place").alias("place")))
    found = (
        placed.filter("NOT unequal").select("doc", "t", "block", whole.cast(f"array<{_PART}>").alias("parts"))
        .unionByName(placed.filter("unequal").join(known, ["anchor", "block"]).select("doc", "t", "block", earlier.alias("parts")).filter("size(parts) > 0"))
        .groupBy("doc", "t").agg(F.collect_set(F.struct("block", "parts")).alias("found"))
        .select("doc", "t", F.col("found.block").alias("keys"), F.col("found.parts").alias("parts"))
    )
    found = materialize(found, "found")
    return _parse(own.join(found, ["doc", "t"], "left").select("doc_id", "text", "keys", "parts"), window, gram)


def _joined(windows: Column) -> Column:
    """Windows (``i``, reference ``m``) in order, those that go on in the reference as one part: first window, number, document, place."""

    def add(parts: Column, x: Column) -> Column:
        last = F.try_element_at(parts, F.lit(-1))
        goes_on = (last["i"] + last["n"] == x["i"]) & (last["doc"] == x["m"]["first"]) & (last["place"] + last["n"] == x["m"]["place"])
        one = F.struct(x["i"].alias("i"), F.lit(1).alias("n"), x["m"]["first"].alias("doc"), x["m"]["place"].alias("place"))
        longer = F.struct(last["i"].alias("i"), (last["n"] + 1).alias("n"), last["doc"].alias("doc"), last["place"].alias("place"))
        return F.when(goes_on, F.concat(F.slice(parts, 1, F.size(parts) - 1), F.array(longer))).otherwise(F.concat(parts, F.array(one)))

    return F.aggregate(windows, F.array().cast(f"array<{_PART}>"), add)
