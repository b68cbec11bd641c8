"""Benchmark decontamination as a prefix-filtered set join.

A window is ``window`` consecutive words of an item (a shorter item is one
window), seen as the set of its word shingles. Shingles are ordered by rarity,
counted over the whole corpus. A document contains a window only if it has all
its shingles, so the prefix to be joined is the rarest one alone. Its position
in the document fixes where the window would begin (positional bound), the
window must end inside the document (length bound), and the words of that
window are then compared one by one.

The join runs against blocks of the benchmark. A block is broadcast, so its
size is proven first: items are dealt to as many blocks as keep each below
``block_words`` words. Documents pass every block in turn and are never
shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageprism.llm import words as W
from pageprism.llm.common import documents, in_arrow, materialize

_SPANS = "array<struct<start:bigint,end:bigint>>"
_STATE = f"doc_id bigint, text string, n_words bigint, spans {_SPANS}, items array<bigint>"
_CANDIDATES = 1 << 16


class _Windows:
    """Distinct windows of one benchmark block."""

    def __init__(self, ids: np.ndarray, texts: list[str | None], window: int, shingle: int):
        words = [w for _, _, w in W.blocks(pa.array(texts, pa.large_string()), W.ALNUM, lower=True)]
        counts = np.concatenate([np.diff(w.first) for w in words]) if words else np.zeros(0, np.int64)
        self.hash = np.concatenate([w.hash for w in words]) if words else np.zeros(0, np.uint64)
        last = np.cumsum(counts)
        begin, length, item = [], [], []
        for row, (n, end) in enumerate(zip(counts.tolist(), last.tolist(), strict=True)):
            if n:
                size = min(n, window)
                begin.append(np.arange(end - n, end - size + 1))
                length.append(np.full(n - size + 1, size))
                item.append(np.full(n - size + 1, row))
        none = np.zeros(0, np.int64)
        begin, length, item = (np.concatenate(x) if x else none for x in (begin, length, item))
        keys = W.span_hashes(self.hash, begin, begin + length) if len(begin) else np.zeros(0, np.uint64)
        _, where, which = np.unique(keys, return_index=True, return_inverse=True)
        #: one row per distinct window: place of its words, number of them
        self.begin, self.length = begin[where], length[where]
        pairs = np.unique(np.stack([which, item], axis=1), axis=0) if len(which) else np.zeros((0, 2), np.int64)
        #: items of window i: ``item[owner[i]:owner[i + 1]]``
        self.item = ids[pairs[:, 1]]
        self.owner = np.searchsorted(pairs[:, 0], np.arange(len(where) + 1))
        #: windows by shingle width; windows shorter than a shingle are one shingle
        self.width = np.minimum(self.length, shingle)
        self.widths = sorted(set(self.width.tolist()))

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, offset, hash) of every shingle of the windows of this width."""
        rows = np.flatnonzero(self.width == width)
        per = self.length[rows] - width + 1
        owner = np.repeat(rows, per)
        offset = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
        at = self.begin[owner] + offset
        return owner, offset, W.span_hashes(self.hash, at, at + width)


class _Lookup:
    """Positions in sorted keys, behind a bit table that turns most of them away."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[keys & np.uint64(0x3FFFFF)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``hashes``, position in the keys) of each hit."""
        at = np.flatnonzero(self.bits[hashes & np.uint64(0x3FFFFF)])
        spot = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        good = self.keys[spot] == hashes[at]
        return at[good], spot[good]


def _count(texts: DataFrame, block, window: int, shingle: int) -> dict[tuple[int, int], int]:
    """Corpus frequency of each shingle of the block, by width and place in the sorted keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _Windows(*block.value, window, shingle)
        tables = {k: _Lookup(windows.shingles(k)[2]) for k in windows.widths}
        totals = {k: np.zeros(len(t.keys), np.int64) for k, t in tables.items()}
        for batch in batches:
            for _, _, words in W.blocks(batch.column(0), W.ALNUM, lower=True):
                for k, t in tables.items():
                    row = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
                    grams = W.gram_hashes(words.hash, k)
                    at, spot = t.find(grams)
                    spot = spot[row[at] == row[at + k - 1]]
                    totals[k] += np.bincount(spot, minlength=len(t.keys))
        for k, n in totals.items():
            hit = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(hit), k, np.int32)), pa.array(hit.astype(np.int64)), pa.array(n[hit])], names=["k", "at", "n"]
            )

    found = in_arrow(texts.select("text"), run, "k int, at bigint, n bigint").groupBy("k", "at").agg(F.sum("n").alias("n"))
    return {(r.k, r.at): r.n for r in found.collect()}  # at most one row per shingle of the block


def _merge(first: list, second: list) -> list[dict]:
    """Union of spans, sorted and disjoint."""
    out: list[dict] = []
    for s in sorted([*first, *second], key=lambda x: x["start"]):
        if out and s["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append({"start": s["start"], "end": s["end"]})
    return out


def _match(state: DataFrame, block, counts: dict, window: int, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _Windows(*block.value, window, shingle)
        joins = []
        for k in windows.widths:
            owner, offset, keys = windows.shingles(k)
            table = _Lookup(keys)
            places = np.searchsorted(table.keys, keys)
            rarity = np.array([counts.get((k, int(p)), 0) for p in places])
            order = np.lexsort((offset, places, rarity, owner))  # rarest first; ties by hash, then by place
            order = order[np.concatenate([[True], owner[order][1:] != owner[order][:-1]])]
            order = order[np.argsort(keys[order], kind="stable")]
            table = _Lookup(keys[order])
            group = np.searchsorted(keys[order], table.keys)
            joins.append((k, table, owner[order], offset[order], np.append(group, len(order))))
        longest = int(windows.length.max(initial=1))

        def verified(words: W.Words, limit: np.ndarray, at: np.ndarray, spot: np.ndarray, owner, offset, group):
            many = group[spot + 1] - group[spot]
            for cut in np.split(np.arange(len(at)), np.flatnonzero(np.diff(np.cumsum(many) // _CANDIDATES)) + 1):
                n = many[cut]
                pick = np.repeat(group[spot[cut]], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                w, start = owner[pick], np.repeat(at[cut], n) - offset[pick]
                low, high = limit[0][np.repeat(at[cut], n)], limit[1][np.repeat(at[cut], n)]
                good = (start >= low) & (start + windows.length[w] <= high)
                w, start = w[good], start[good]
                same = np.ones(len(w), bool)
                for j in range(longest):
                    check = np.flatnonzero(same & (windows.length[w] > j))
                    same[check] = words.hash[start[check] + j] == windows.hash[windows.begin[w[check]] + j]
                yield w[same], start[same]

        for batch in batches:
            texts = batch.column(1)
            n_words = np.zeros(batch.num_rows, np.int64)
            spans, items = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for lo, hi, words in W.blocks(texts, W.ALNUM, lower=True):
                sizes = np.diff(words.first)
                n_words[lo:hi] = sizes
                limit = (np.repeat(words.first[:-1], sizes), np.repeat(words.first[1:], sizes))
                found_w, found_s = [], []
                for k, table, *rest in joins:
                    at, spot = table.find(W.gram_hashes(words.hash, k))
                    for w, start in verified(words, limit, at, spot, *rest):
                        found_w.append(w)
                        found_s.append(start)
                w, start = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_w, found_s))
                if not len(w):
                    continue
                depth = np.zeros(len(words.hash) + 1, np.int64)
                np.add.at(depth, start, 1)
                np.add.at(depth, start + windows.length[w], -1)
                covered = np.cumsum(depth) > 0
                doc = np.searchsorted(words.first, start, "right") - 1
                for d in np.unique(doc).tolist():
                    a, z = words.first[d], words.first[d + 1]
                    flags = np.concatenate([[False], covered[a:z], [False]])
                    edges = np.flatnonzero(flags[1:] != flags[:-1]).tolist()
                    own = [{"start": p, "end": q} for p, q in zip(edges[::2], edges[1::2], strict=True)]
                    spans[lo + d] = _merge(spans[lo + d], own)
                    ids = {i for x in np.unique(w[doc == d]).tolist() for i in windows.item[windows.owner[x] : windows.owner[x + 1]].tolist()}
                    items[lo + d] = sorted(ids.union(items[lo + d]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), texts, pa.array(n_words),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array(items, pa.list_(pa.int64())),
                ],
                names=["doc_id", "text", "n_words", "spans", "items"],
            )

    return in_arrow(state, run, _STATE)


def contaminated_words(
    docs: DataFrame, bench: DataFrame, window: int = 10, shingle: int = 5, block_words: int = 2_000_000
) -> DataFrame:
    """Where windows of benchmark items stand in documents.

    Words are runs of digits, letters (A-Z lower-cased) and characters beyond
    ASCII. Per input row: ``doc_id``, ``n_words``, ``spans`` (start and end
    word of every stretch covered by a window) and ``items`` (ids of the items
    with an occurring window).

    Null and empty texts have no words; items without words match nothing, an
    item without an id does not count at all, repeated items count once. Rows with null or
    repeated ids are each judged by their own text. Other columns are not
    looked at. Without documents the result is empty, without items every
    document is clean.
    """
    spark = docs.sparkSession
    items = bench.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.filter("item_id IS NOT NULL AND text IS NOT NULL")
    # no more words than characters; an item goes to one block whole
    size = items.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0
    n_blocks = int(size // block_words) + 1
    none = F.array().cast("array<bigint>")
    texts = documents(docs)
    state = texts.select("doc_id", "text", F.lit(0).cast("bigint").alias("n_words"), F.lit([]).cast(_SPANS).alias("spans"), none.alias("items"))
    for b in range(n_blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == b).collect()
        held = spark.sparkContext.broadcast((np.array([r.item_id for r in part], np.int64), [r.text for r in part], ))
        counts = _count(texts, held, window, shingle) if part else {}
        state = _match(state, held, counts, window, shingle)
        if b + 1 < n_blocks:
            state = materialize(state, "state")
    return state.drop("text")
