"""Near duplicates by b-bit MinHash.

1. Every text becomes its set of distinct word shingles. ``bands * rows``
   minima over the set give band keys; the low bits of each minimum are packed
   into a few longs, the signature.
2. Equal sets (128-bit digest and size) form one class; only the class's
   smallest id goes on.
3. The member of a bucket that shares most buckets with others is its centre.
   Every document is paired with the best centre it meets. Pairs whose
   collision-corrected similarity, estimated by bit counts, comes near the
   threshold are confirmed on the full sets, and confirmed pairs are contracted to
   components. A large group of copies collapses here at linear cost.
4. What is left are buckets with more than one component. Their documents
   order their shingles from rare to frequent: similar sets share one of the
   rarest few, of the smaller set one of even fewer, as it lies almost wholly in
   the other. By these shingles, and within a range of sizes, members outside a
   shingle's largest component meet members of other components, if the places of
   the shingle leave enough in common (an exact bound) and the estimate comes near the threshold. The rest is compared on
   full sets. So no link that a shared bucket can show is lost, no pair
   inside a group is formed, and texts that share a template but too little to
   link do not meet: what they share is too far back in their order.

The chance that a pair at the threshold shares no bucket is
``(1 - s**rows)**bands``; there are as many bands as bring it below 2.5e-8 (30
of 5 minima at 0.85, 45 at 0.8). The signature filter lies six standard
deviations below the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageprism.llm import words as W
from pageprism.llm.common import documents, in_arrow, materialize
from pageprism.llm.components import connected

_SIGNATURE = "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>, sig array<bigint>"
_FIELDS = 32  # two-bit fields in a long
_COLUMNS = 2048
_MISSED = 2.5e-8


class _Hashes:
    """The minima, band keys and packed signature of one set."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, n = bands, rows, bands * rows
        rng = np.random.default_rng(17)
        self.mul = (rng.integers(0, 1 << 32, (n, 1), dtype=np.uint64).astype(np.uint32)) | np.uint32(1)
        self.add = rng.integers(0, 1 << 32, (n, 1), dtype=np.uint64).astype(np.uint32)
        self.weights = rng.integers(0, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = W.mix(np.arange(1, bands + 1, dtype=np.uint64))
        self.buffer = np.empty((n, _COLUMNS), np.uint32)
        self.longs = -(-n // _FIELDS)
        self.shift = np.tile(np.arange(0, 64, 2, dtype=np.uint64), self.longs)[:n]

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.mul), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), _COLUMNS):
            part = x[at : at + _COLUMNS]
            out = self.buffer[:, : len(part)]
            np.multiply(self.mul, part, out=out)
            np.add(out, self.add, out=out)
            np.minimum(least, out.min(axis=1), out=least)
        return least

    def keys(self, minima: np.ndarray) -> np.ndarray:
        m = minima.astype(np.uint64).reshape(self.bands, self.rows)
        return W.mix((m * self.weights).sum(axis=1, dtype=np.uint64) + self.salt)

    def packed(self, minima: np.ndarray) -> np.ndarray:
        bits = ((minima * np.uint32(0x9E3779B1)) >> np.uint32(30)).astype(np.uint64) << self.shift
        return np.bitwise_or.reduceat(bits, np.arange(0, len(bits), _FIELDS))


def signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """Set size, set digest, band keys and signature of every text; no words give an empty set without bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes(bands, rows)
        for batch in batches:
            sizes, digests, keys, sigs = [], [], [], []
            for _, _, words in W.blocks(batch.column(1), W.NOT_SPACE, lower=True):
                for s in W.shingle_sets(words, k):
                    sizes.append(len(s))
                    if len(s):
                        m = hashes.minima(s)
                        keys.append(hashes.keys(m))
                        sigs.append(hashes.packed(m))
                        digests.append((W.mix(s).sum(dtype=np.uint64), W.mix(~s).sum(dtype=np.uint64)))
                    else:
                        digests.append((0, 0))
            size = np.array(sizes, np.int64)
            d = np.array(digests, np.uint64).reshape(-1, 2)
            lists = [
                pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum((size > 0) * width)]).astype(np.int32)),
                    pa.array(W.signed(np.concatenate(parts)) if parts else np.zeros(0, np.int64)),
                )
                for parts, width in ((keys, bands), (sigs, hashes.longs))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size), pa.array(W.signed(d[:, 0])), pa.array(W.signed(d[:, 1])), *lists],
                names=["doc_id", "n_shingles", "d1", "d2", "bands", "sig"],
            )

    return in_arrow(documents(docs), run, _SIGNATURE)


def differing(x: Column, y: Column, longs: int) -> Column:
    """Number of two-bit fields in which two signatures differ."""
    total = F.lit(0)
    for i in range(longs):
        d = F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))
        total = total + F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return total


def estimate(differ: Column, hashes: int) -> Column:
    """Similarity from differing fields, corrected for the quarter of unequal minima whose bits agree."""
    return 1 - differ / (0.75 * hashes)


def least_estimate(threshold: float, hashes: int) -> float:
    """Estimate that a pair at the threshold does not fall below: the mean less six standard deviations."""
    p = 0.75 * (1 - threshold)
    return 1 - math.ceil(hashes * p + 6 * math.sqrt(hashes * p * (1 - p))) / (0.75 * hashes) - 1e-9


def shingle_rows(texts: DataFrame, k: int) -> DataFrame:
    """``rep``, ``s``: one row per distinct shingle of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo, hi, words in W.blocks(batch.column(1), W.NOT_SPACE, lower=True):
                sets = list(W.shingle_sets(words, k))
                owner = np.repeat(ids[lo:hi], [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(W.signed(np.concatenate(sets)))], names=["rep", "s"])

    return in_arrow(texts, run, "rep bigint, s bigint")


def prefixes(texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``key``, ``rep``, ``at``, ``small``: the rarest shingles of each document, of which a similar document must have one.

    ``at`` is the place in the document's shingles from rare to frequent.
    Shingles of one document alone come first and are not returned. ``small`` marks those by which the document can be
    the smaller one of a pair: all it shares with a larger set must come after them.
    """
    rows = materialize(shingle_rows(texts, k), "shingles")
    # grouped sides are written first, so that joins can be split at frequent shingles
    often = materialize(rows.groupBy("s").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "frequent")
    sizes = rows.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    ordered = rows.join(often, "s").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("o"))
    first = F.col("n") - F.size("o")
    # a set of n may lack n - ceil(n * num / den) shingles of a similar one
    length = F.col("n") - F.ceil(F.col("n") * num / den) + 1
    cut = ordered.join(sizes, "rep").select("rep", "n", first.alias("first"), F.slice("o", 1, F.greatest(length - first, F.lit(0)).cast("int")).alias("o"))
    at = F.col("first") + F.col("i")
    # and must have at least 2 num / (num + den) of its own in one that is no smaller
    small = (num + den) * (F.col("n") - at) >= 2 * num * F.col("n")
    return cut.select("rep", "n", "first", F.posexplode("o").alias("i", "x")).select(F.col("x.s").alias("key"), "rep", at.alias("at"), small.alias("small"))


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (``a``, ``b``) whose full shingle sets have ``den * shared >= num * united``."""
    both = (
        pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), "a")
        .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y")), "b")
        .select("a", "b", "x", "y")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits: list[bool] = []
            # few pairs at a time: the sets of a block are held until compared
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x, y = (
                    (s for _, _, w in W.blocks(part.column(i), W.NOT_SPACE, lower=True) for s in W.shingle_sets(w, k))
                    for i in (2, 3)
                )
                for p, q in zip(x, y, strict=True):
                    small, large = (p, q) if len(p) <= len(q) else (q, p)
                    if len(small) == 0 or den * len(small) < num * len(large):
                        hits.append(False)
                        continue
                    spot = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    shared = int((large[spot] == small).sum())
                    hits.append(den * shared >= num * (len(p) + len(q) - shared))
            mask = pa.array(hits, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return in_arrow(both, run, "a bigint, b bigint").distinct()


def _prefix_pairs(left: DataFrame, num: int, den: int, near: Callable[[str, str], Column]) -> DataFrame:
    """Pairs ``a``, ``b`` in different components that share a rare shingle and may be similar.

    ``left`` has ``key``, ``major`` (largest component of the key), ``rep``, ``c``, ``n_shingles``, ``at``, ``small``, ``sig``. The smaller set
    of a pair stands on one side, in the ranges of sizes in which the larger one can be.
    """
    # a set is at most den / num times as large as a similar one: the same range or the next, or, by rounding, the one behind
    span = F.floor(F.log(F.col("n_shingles").cast("double")) / math.log(den / num)) if num < den else F.lit(0)
    part = ["rep", "c", "n_shingles", "at", "sig"]
    x = left.filter("small").select("key", "major", F.explode(F.array(span, span + 1, span + 2)).alias("span"), *[F.col(p).alias(f"x_{p}") for p in part])
    y = left.select("key", span.alias("span"), "major", *[F.col(p).alias(f"y_{p}") for p in part])
    most = F.least(F.col("x_n_shingles") - F.col("x_at"), F.col("y_n_shingles") - F.col("y_at"))
    fits = (
        (F.col("x_c") != F.col("y_c"))
        & (F.struct("x_n_shingles", "x_rep") < F.struct("y_n_shingles", "y_rep"))
        & ((den + num) * most >= num * (F.col("x_n_shingles") + F.col("y_n_shingles")))
        & near("x_sig", "y_sig")
    )
    # members of the largest component never meet among themselves
    one = x.filter("x_c != major").join(y.drop("major"), ["key", "span"])
    other = x.filter("x_c = major").join(y.filter("y_c != major").drop("major"), ["key", "span"])
    both = one.filter(fits).unionByName(other.filter(fits))
    return both.select(F.least("x_rep", "y_rep").alias("a"), F.greatest("x_rep", "y_rep").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, bands: int | None = None, rows: int = 5
) -> DataFrame:
    """Groups of near duplicates.

    Words are runs without ASCII white space, A-Z lower-cased; a set has the
    distinct ``k``-word shingles of the whole text, or the whole sequence if
    there are fewer words. Documents are linked if ``den * shared >= num *
    united``. One row per input row: ``doc_id``, ``n_shingles``,
    ``component_id`` (smallest id reachable over links) and ``kept`` (the two
    ids are equal).

    Null and empty texts have no shingles, link with nothing and are kept. A
    row without an id is kept and has no component of its own: it takes that of
    the texts with the same set, if any. Repeated rows get equal results. An id
    is expected to name one text; of an id with unlike texts each row has the
    size of its own text, and links of any of them count for the id. Other columns of ``docs`` are not looked at. An empty table gives an empty result.
    """
    if bands is None:
        bands = math.ceil(math.log(_MISSED) / math.log(1 - (num / den) ** rows)) if num < den else 1
    sigs = materialize(signatures(docs, k, bands, rows), "signatures")
    mine = ["d1", "d2", "n_shingles"]
    classes = sigs.filter("n_shingles > 0").groupBy(*mine).agg(F.min("doc_id").alias("rep"))
    heads = classes.filter("rep IS NOT NULL")
    longs = -(-bands * rows // _FIELDS)
    reps = materialize(
        sigs.join(heads.withColumnRenamed("rep", "doc_id"), ["doc_id", *mine]).dropDuplicates(["doc_id", *mine])
        .select(F.col("doc_id").alias("rep"), "n_shingles", "bands", "sig"),
        "heads",
    )
    members = reps.select("rep", F.explode("bands").alias("key"))
    # grouped sides are written first: a join of two tables is split at hot keys, one with a grouping in its stage is not
    sizes = materialize(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sizes")
    shared = materialize(members.join(sizes, "key"), "buckets")
    central = shared.groupBy("rep").agg(F.sum("n").alias("weight"))
    texts = documents(docs).join(central.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    texts = materialize(texts, "texts")

    weighed = materialize(shared.drop("n").join(central, "rep").withColumn("at", F.struct("weight", -F.col("rep"), "rep")), "weighed")
    heart = materialize(weighed.groupBy("key").agg(F.max("at").alias("top")), "hearts")
    best = weighed.join(heart, "key").groupBy("rep").agg(F.max("top").alias("top"))
    first = best.select(F.col("top.rep").alias("a"), F.col("rep").alias("b")).filter("a != b")
    signed = reps.select("rep", "sig")
    first = first.join(signed.withColumnsRenamed({"rep": "a", "sig": "x"}), "a").join(signed.withColumnsRenamed({"rep": "b", "sig": "y"}), "b")
    near = lambda x, y: estimate(differing(F.col(x), F.col(y), longs), bands * rows) >= least_estimate(num / den, bands * rows)
    first = materialize(first.filter(near("x", "y")).select("a", "b"), "first-pairs")
    links = materialize(confirmed(first, texts, k, num, den), "links")
    groups = connected(links).withColumnRenamed("node", "rep")

    placed = materialize(
        shared.select("key", "rep").join(groups, "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("c")), "placed"
    )
    per = placed.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n"))
    mixed = per.groupBy("key").agg(F.max(F.struct("n", "c")).alias("top"), F.count(F.lit(1)).alias("cs")).filter("cs > 1")
    mixed = materialize(mixed.select("key"), "mixed-keys")
    open_ones = materialize(placed.join(mixed, "key", "left_semi").select("rep", "c").distinct(), "open")
    left = prefixes(texts.join(open_ones.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"), k, num, den)
    left = materialize(left.join(open_ones, "rep"), "prefixes")
    per = left.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n"))
    mixed = per.groupBy("key").agg(F.max(F.struct("n", "c")).alias("top"), F.count(F.lit(1)).alias("cs")).filter("cs > 1")
    mixed = materialize(mixed.select("key", F.col("top.c").alias("major")), "mixed-keys")
    left = left.join(mixed, "key").join(reps.drop("bands"), "rep")
    left = materialize(left, "mixed")
    more = _prefix_pairs(left, num, den, near)
    more = materialize(more, "pairs")
    links = materialize(links.unionByName(confirmed(more, texts, k, num, den)), "links")
    groups = connected(links).withColumnRenamed("node", "rep")

    found = classes.join(groups, "rep", "left").select(*mine, F.coalesce("component", "rep").alias("c"))
    return sigs.select("doc_id", *mine).join(found, mine, "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("c", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("c", "doc_id"), F.lit(True)).alias("kept"),
    )
