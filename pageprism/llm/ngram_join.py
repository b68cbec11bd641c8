"""Jaccard join of n-gram sets by vertical partitioning.

All n-grams have one global order, from rare to frequent: by the number of
texts in which a hash bucket of n-grams occurs (counted over all texts), then
by hash. Every set is sorted by it. The order is cut into fragments that hold
about equally many n-grams of the corpus, so a set falls into segments.

1. Equal sets (128-bit digest and size) are one class.
2. Candidates. Sets of similarity ``t`` share an n-gram among the first few of
   both in the global order: of the larger set the first ``(1 - t) n``, of the
   smaller one, which must lie almost wholly in the other, the first
   ``(1 - 2 t / (1 + t)) n``. Keys are these n-grams together with a range of
   sizes, so sets of unlike size do not meet.
3. Overlaps. A pair of candidates is counted fragment by fragment: the segments
   of both in one fragment meet and give a partial overlap, wherever those of
   other fragments are counted; the sum per pair is the overlap, hence the
   exact similarity. The fragment of the rarest n-grams comes first: pairs that differ
   too much in it alone are dropped before any other segment is made.

Members of a key are not paired with each other: each class is first paired
with the most central class that it shares a key with, and what that links is
contracted to components. Then members outside a key's largest component meet
those of other components, if the places of the n-gram in both sets leave
enough in common. So a group of copies costs one pair a member, and no link
between components is lost. Keys with a third of all sets are rows of joins
that adaptive execution splits; no task holds a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageprism.llm import words as W
from pageprism.llm.common import in_arrow, materialize, row_key
from pageprism.llm.components import connected
from pageprism.operators.platform import marked

#: Buckets of the counts, and buckets in a row of counts.
_BUCKETS, _SLICE = 1 << 20, 1 << 12
#: Logarithm of the number of marks that tell keys from others.
_LOG_MARKS = 25
#: Rows of counts that are added at once.
_ADDED = 64
_SMALL, _LARGE = 1, 2  # roles of a set in a pair
_MINE = ["d1", "d2", "n"]


def _digest(s: np.ndarray) -> tuple[int, int]:
    return W.mix(s).sum(dtype=np.uint64), W.mix(~s).sum(dtype=np.uint64)


# ---- sets and their global order ---------------------------------------------------------------------------------------
def _sets(docs: DataFrame, k: int) -> DataFrame:
    """Per text ``key``, ``n``, ``d1``, ``d2``; and per task (``part``) the counts of its n-grams, in rows of ``slice`` and ``counts``."""
    names = ["doc_id", "key", "n", "d1", "d2", "part", "slice", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        counts = np.zeros(_BUCKETS, np.int64)
        for batch in batches:
            sizes, digests = [], []
            for _, _, words in W.blocks(batch.column(2), W.NOT_SPACE, lower=True):
                sets = list(W.shingle_sets(words, k))
                counts += np.bincount(np.concatenate(sets) & np.uint64(_BUCKETS - 1), minlength=_BUCKETS)
                sizes += [len(s) for s in sets]
                digests += [_digest(s) if len(s) else (0, 0) for s in sets]
            d = np.array(digests, np.uint64).reshape(-1, 2)
            none = [pa.nulls(len(sizes), t) for t in (pa.int32(), pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(W.signed(d[:, 0])), pa.array(W.signed(d[:, 1])), *none], names=names
            )
        some = np.flatnonzero(counts.reshape(-1, _SLICE).any(axis=1))
        data = [counts[i * _SLICE : (i + 1) * _SLICE].tobytes() for i in some.tolist()]
        none = [pa.nulls(len(some), pa.int64())] * 5
        own = [pa.array([part] * len(some), pa.int32()), pa.array(some.astype(np.int32)), pa.array(data, pa.binary())]
        yield pa.RecordBatch.from_arrays([*none, *own], names=names)

    return in_arrow(docs, run, "doc_id bigint, key bigint, n bigint, d1 bigint, d2 bigint, part int, slice int, counts binary")


def _added(counts: DataFrame, *by: str) -> DataFrame:
    """Sums of rows of counts."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(_SLICE, np.int64)
        for data in table.column("counts").to_pylist():
            total += np.frombuffer(data, np.int64)
        return pa.table({"slice": pa.array([table.column("slice")[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    return counts.groupBy(*by).applyInArrow(add, "slice int, counts binary")


class Order(NamedTuple):
    """Global order of n-grams: counts of the hash buckets, and the (count, hash) at which each further fragment begins."""

    counts: np.ndarray
    pivots: tuple[tuple[int, int], ...]

    def sort(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of a set from rare to frequent, and their counts."""
        c = self.counts[s & np.uint64(_BUCKETS - 1)]
        at = np.lexsort((s, c))
        return s[at], c[at]

    def fragments(self, s: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Fragment of each n-gram."""
        f = np.zeros(len(s), np.int32)
        for count, first in self.pivots:
            f += (c > count) | ((c == count) & (s >= np.uint64(first)))
        return f


def global_order(counts: DataFrame, fragments: int) -> Order:
    """The order from all rows of counts. What reaches the driver and each task is ``_BUCKETS`` numbers, however large the corpus.

    Rows are added in two steps, first those of a few tasks each. Rarity within one bucket
    is not told apart; the order decides how many candidates there are, never which pairs are found.
    """
    total = np.zeros(_BUCKETS, np.int64)
    some = counts.withColumn("part", F.floor(F.col("part") / _ADDED))
    for r in _added(_added(some, "slice", "part"), "slice").collect():
        total[r.slice * _SLICE : (r.slice + 1) * _SLICE] = np.frombuffer(r.counts, np.int64)
    # n-grams of one count are spread evenly over their hashes
    levels, each = np.unique(total, return_counts=True)
    upto = np.concatenate([[0.0], np.cumsum(levels.astype(float) * each)])
    pivots = []
    for f in range(1, fragments):
        goal = upto[-1] * f / fragments
        i = min(int(np.searchsorted(upto, goal, "right")) - 1, len(levels) - 1)
        share = (goal - upto[i]) / max(upto[i + 1] - upto[i], 1.0)
        pivots.append((int(levels[i]), int(min(share, 0.999999) * 2.0**64)))
    return Order(np.minimum(total, 0xFFFFFFFF).astype(np.uint32), tuple(pivots))


# ---- candidates --------------------------------------------------------------------------------------------------------
def least_overlap(x: int, y: int, num: int, den: int) -> int:
    """N-grams that sets of ``x`` and ``y`` must share: ``den * shared >= num * united``."""
    return -(-num * (x + y) // (num + den))


def size_range(n: int, num: int, den: int) -> tuple[int, int]:
    """Number of the range of sizes that ``n`` is in, and the first size of the next.

    A range is so long that the largest set that can be similar to one of its sets is in this range or the next.
    """
    i, begin = 0, 1
    while True:
        after = begin * den // num + 1
        if n < after:
            return i, after
        i, begin = i + 1, after


def _ranges(num: int, den: int):
    known: dict[int, tuple[int, int]] = {}

    def of(n: int) -> tuple[int, int]:
        if n not in known:
            known[n] = size_range(n, num, den)
        return known[n]

    return of


def _postings(docs: DataFrame, order: Order, k: int, num: int, den: int) -> DataFrame:
    """``d1``, ``d2``, ``n`` and arrays ``keys`` and ``info`` (place and roles) of every text with words.

    A key stands for an n-gram and a range of sizes of the larger set of a pair.
    """
    salt = W.mix(np.arange(1, 4096, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        range_of = _ranges(num, den)
        for batch in batches:
            for _, _, words in W.blocks(batch.column(2), W.NOT_SPACE, lower=True):
                digests, sizes, keys, info = [], [], [], []
                for s in W.shingle_sets(words, k):
                    n = len(s)
                    if not n:
                        continue
                    o, _ = order.sort(s)
                    own, after = range_of(n)
                    large = n - least_overlap(-(-num * n // den), n, num, den) + 1
                    small = n - least_overlap(n, n, num, den) + 1
                    # sets of the next range that can be similar have ``after`` n-grams or more
                    beyond = max(n - least_overlap(n, after, num, den) + 1, 0) if after <= n * den // num else 0
                    at = np.arange(large)
                    roles = np.where(at < small, _SMALL | _LARGE, _LARGE)
                    at = np.concatenate([at, at[:beyond]])
                    roles = np.concatenate([roles, np.full(beyond, _SMALL)])
                    mark = np.concatenate([np.full(large, salt[own]), np.full(beyond, salt[own + 1])])
                    digests.append(_digest(s))
                    sizes.append(n)
                    keys.append(W.mix(o[at] ^ mark))
                    info.append(at << 2 | roles)
                d = np.array(digests, np.uint64).reshape(-1, 2)
                ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32))
                flat = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (keys, info)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(W.signed(d[:, 0])), pa.array(W.signed(d[:, 1])), pa.array(sizes, pa.int64()),
                        pa.ListArray.from_arrays(ends, pa.array(W.signed(flat[0]))), pa.ListArray.from_arrays(ends, pa.array(flat[1].astype(np.int32))),
                    ],
                    names=["d1", "d2", "n", "keys", "info"],
                )

    return in_arrow(docs, run, "d1 bigint, d2 bigint, n bigint, keys array<bigint>, info array<int>")


def _members(docs: DataFrame, classes: DataFrame, order: Order, k: int, num: int, den: int) -> DataFrame:
    """``key``, ``c``, ``n``, ``at``, ``small``, ``large``: the members of the keys that more than one class has."""
    # one row stands for a class; most copies go at once, so that a key they alone share is not one of several classes
    firsts = _perhaps(docs, classes.select(F.col("rep").alias("key")), "key")
    found = materialize(_postings(firsts, order, k, num, den).withColumn("r", F.monotonically_increasing_id()), "postings")
    heads = found.groupBy(*_MINE).agg(F.min("r").alias("r")).join(classes, _MINE)
    heads = materialize(heads.select("r", "c", "n"), "heads")
    each = found.select("r", F.explode(F.arrays_zip("keys", "info")).alias("x")).select(F.col("x.keys").alias("key"), "r", "x.info")
    # grouped sides are written first: a join of two tables is split at hot keys, one with a grouping in its stage is not
    often = materialize(each.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("key"), "keys")
    rows = materialize(_perhaps(each, often, "key").join(often, "key").join(heads, "r").select("key", "c", "n", "info"), "rows")
    often = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "keys")
    info = F.col("info")
    return materialize(
        rows.join(often, "key").select(
            "key", "c", "n", "m", F.shiftright(info, 2).alias("at"),
            (info.bitwiseAND(F.lit(_SMALL)) != 0).alias("small"), (info.bitwiseAND(F.lit(_LARGE)) != 0).alias("large"),
        ),
        "members",
    )


def _first_pairs(members: DataFrame) -> DataFrame:
    """Each class with the most central one it shares a key with: ``a`` (central), ``b``."""
    central = members.groupBy("c").agg(F.sum("m").alias("weight"))
    central = materialize(central, "central")
    weighed = materialize(members.select("key", "c").join(central, "c").withColumn("top", F.struct("weight", -F.col("c"), "c")), "weighed")
    heart = materialize(weighed.groupBy("key").agg(F.max("top").alias("heart")), "hearts")
    best = weighed.join(heart, "key").groupBy("c").agg(F.max("heart").alias("heart"))
    return best.select(F.col("heart.c").alias("a"), F.col("c").alias("b")).filter("a != b")


def _more_pairs(members: DataFrame, groups: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs ``a``, ``b`` of classes in different components that share a key and may be similar.

    Every such pair holds a member outside the largest component of the key, so members of that component never meet
    among themselves.
    """
    placed = members.drop("m").join(groups, "c", "left").withColumn("g", F.coalesce("g", "c"))
    placed = materialize(placed, "placed")
    per = placed.groupBy("key", "g").agg(F.count(F.lit(1)).alias("m"))
    mixed = per.groupBy("key").agg(F.max(F.struct("m", "g")).alias("top"), F.count(F.lit(1)).alias("gs")).filter("gs > 1")
    mixed = materialize(mixed.select("key", F.col("top.g").alias("major")), "mixed")
    left = materialize(placed.join(mixed, "key"), "left")
    part = ["c", "g", "n", "at"]
    x = left.filter("small").select("key", "major", *[F.col(p).alias(f"x_{p}") for p in part])
    y = left.filter("large").select("key", "major", *[F.col(p).alias(f"y_{p}") for p in part])
    most = F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at"))
    fits = (
        (F.col("x_g") != F.col("y_g"))
        & (F.struct("x_n", "x_c") < F.struct("y_n", "y_c"))
        & ((num + den) * most >= num * (F.col("x_n") + F.col("y_n")))
        & (den * F.col("x_n") >= num * F.col("y_n"))
    )
    # the smaller set of a pair stands on one side, so texts that share only what neither could share as the smaller one never meet
    one = x.filter("x_g != major").join(y.drop("major"), "key")
    other = x.filter("x_g = major").join(y.filter("y_g != major").drop("major"), "key")
    pairs = one.filter(fits).unionByName(other.filter(fits))
    return pairs.select(F.least("x_c", "y_c").alias("a"), F.greatest("x_c", "y_c").alias("b")).distinct()


# ---- overlaps ----------------------------------------------------------------------------------------------------------
def _segments(texts: DataFrame, order: Order, k: int, rarest: bool) -> DataFrame:
    """``c`` (first half of the digest), ``f``, ``s``: the n-grams of a ``text`` in each fragment that has some, the first one alone (``rarest``) or all others.

    The text itself tells its class, so texts go through no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, words in W.blocks(batch.column(0), W.NOT_SPACE, lower=True):
                owners, fragments, parts = [], [], []
                for s in W.shingle_sets(words, k):
                    if not len(s):
                        continue
                    own = _digest(s)[0]
                    s, c = order.sort(s)
                    f = order.fragments(s, c)
                    s, f = (s[f == 0], f[f == 0]) if rarest else (s[f > 0], f[f > 0])
                    if not len(s):
                        continue
                    begin = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]]))
                    owners += [own] * len(begin)
                    fragments += f[begin].tolist()
                    parts += np.split(s, begin[1:])
                ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
                flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(W.signed(np.array(owners, np.uint64))), pa.array(fragments, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(W.signed(flat)))],
                    names=["c", "f", "s"],
                )

    return in_arrow(texts, run, "c bigint, f int, s array<bigint>")


def _side(segments: DataFrame, pairs: DataFrame, side: str, name: str) -> DataFrame:
    """Segments of the classes on one side of the pairs."""
    some = materialize(pairs.select(F.col(side).alias("c")).distinct(), "side")
    return segments.join(some, "c", "left_semi").select(F.col("c").alias(side), "f", F.col("s").alias(name))


def overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """``a``, ``b``, ``shared``: partial overlaps counted in each fragment, summed per pair. Pairs that share nothing are left out."""
    met = pairs.select("a", "b").join(_side(segments, pairs, "b", "sy"), "b").join(_side(segments, pairs, "a", "sx"), ["a", "f"])
    met = met.select("a", "b", "f", F.size(F.array_intersect("sx", "sy")).cast("bigint").alias("part"))
    # rows that repeat an id and text repeat its segments
    partial = met.groupBy("a", "b", "f").agg(F.max("part").alias("part"))
    return partial.groupBy("a", "b").agg(F.sum("part").alias("shared"))


def _confirmed(texts: DataFrame, pairs: DataFrame, classes: DataFrame, order: Order, k: int, num: int, den: int) -> DataFrame:
    """The pairs whose sets are similar. Their segments are found by the first half of the sets' digests, as ``a`` and ``b``."""
    sizes = classes.select("c", "n", "d1")
    sized = pairs.withColumnsRenamed({"a": "ca", "b": "cb"})
    sized = sized.join(sizes.withColumnsRenamed({"c": "ca", "n": "x", "d1": "a"}), "ca").join(sizes.withColumnsRenamed({"c": "cb", "n": "y", "d1": "b"}), "cb")
    near = materialize(sized.filter(den * F.least("x", "y") >= num * F.greatest("x", "y")), "near")
    rare = _wanted(texts, classes, near, order, k, rarest=True)
    met = near.join(_side(rare, near, "b", "sy"), "b", "left").drop("f").join(_side(rare, near, "a", "sx").drop("f"), "a", "left")
    none = F.array().cast("array<bigint>")
    sx, sy = F.coalesce("sx", none), F.coalesce("sy", none)
    part = F.size(F.array_intersect(sx, sy)).cast("bigint")
    most = part + F.least(F.col("x") - F.size(sx), F.col("y") - F.size(sy))
    pair = ["ca", "cb", "a", "b", "x", "y"]
    kept = met.select(*pair, part.alias("part"), most.alias("most")).groupBy(*pair).agg(F.max("part").alias("part"), F.max("most").alias("most"))
    near = materialize(kept.filter((num + den) * F.col("most") >= num * (F.col("x") + F.col("y"))).drop("most"), "near")
    shared = overlaps(near, _wanted(texts, classes, near, order, k, rarest=False))
    total = F.col("part") + F.coalesce("shared", F.lit(0))
    found = near.join(shared, ["a", "b"], "left").filter(den * total >= num * (F.col("x") + F.col("y") - total))
    return materialize(found.select(F.col("ca").alias("a"), F.col("cb").alias("b")), "links")


def _perhaps(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` may be among ``keys``; none that is among them is missing.

    Spares a shuffle what a join would drop, as long as the keys are fewer than the marks, of which at most 2^``_LOG_MARKS``, 64 to
    a row, are broadcast.
    """
    return marked(df, keys.select(column), [column], _LOG_MARKS)


def _wanted(docs: DataFrame, classes: DataFrame, pairs: DataFrame, order: Order, k: int, rarest: bool) -> DataFrame:
    """Segments of the classes in the pairs, and of the few other texts that have a mark of theirs."""
    some = pairs.select(F.explode(F.array("ca", "cb")).alias("c")).distinct()
    some = materialize(classes.join(some, "c", "left_semi").select(F.col("rep").alias("key")), "wanted")
    return materialize(_segments(_perhaps(docs, some, "key").select("text"), order, k, rarest), "segments")


def ngram_join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, fragments: int = 8) -> DataFrame:
    """Groups of texts whose sets of ``k``-word n-grams are similar.

    Words are runs without ASCII white space, A-Z lower-cased; a set has the distinct ``k``-word n-grams of the whole text,
    or the whole sequence if there are fewer words. Two documents link if ``den * shared >= num * united``. One row per
    input row: ``doc_id``, ``n_shingles``, ``component_id`` (smallest id reachable by links, itself included),
    ``class_size`` (rows with the same set).

    Null and empty texts have no n-grams and link with nothing: their component is their own id. A row without an id takes
    part as its text; a component of such rows alone has none. Repeated rows get equal results; rows that share an id
    but not the text are judged by their texts. Other columns are not looked at. An empty table gives an empty result.
    N-grams are compared by 64-bit hashes, and classes named by 64 bits of their digest where overlaps are counted. The result does not depend on ``fragments``.
    """
    if not 0 < num < den:
        raise ValueError("the threshold must lie between 0 and 1")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key(docs).alias("key"), F.col("text").cast("string").alias("text"))
    both = materialize(_sets(texts, k), "sets")
    sets = both.filter("slice IS NULL").select("doc_id", "key", *_MINE)
    classes = sets.filter("n > 0").groupBy(*_MINE).agg(F.min("key").alias("rep"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("size"))
    classes = materialize(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    order = global_order(both.filter("slice IS NOT NULL").select("part", "slice", "counts"), fragments)

    members = _members(texts, classes, order, k, num, den)
    pairs = materialize(_first_pairs(members), "pairs")
    links = _confirmed(texts, pairs, classes, order, k, num, den)
    groups = materialize(connected(links).withColumnsRenamed({"node": "c", "component": "g"}), "groups")
    pairs = materialize(_more_pairs(members, groups, num, den), "pairs")
    links = links.unionByName(_confirmed(texts, pairs, classes, order, k, num, den))
    groups = materialize(connected(links).withColumnsRenamed({"node": "c", "component": "g"}), "groups")

    placed = materialize(classes.join(groups, "c", "left").withColumn("g", F.coalesce("g", "c")).select(*_MINE, "g", "least", "size"), "placed")
    least = materialize(placed.groupBy("g").agg(F.min("least").alias("component_id")), "components")
    named = placed.join(least, "g").select(*_MINE, "component_id", "size")
    named = materialize(named, "named")
    return sets.join(named, _MINE, "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("size", F.lit(1)).alias("class_size"),
    )

