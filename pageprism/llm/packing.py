"""Packing of token pieces into sequences by swap-based local search.

Pieces go to groups of a fixed size, whatever the number of pieces. In a group
every piece is placed best-fit in descending length; then the least filled
sequence is emptied by exchanges with underfull ones, each of which raises the
sum of squared fills: a piece moves, a piece changes place with a shorter one,
or two pieces with one (any two: the lengths of all pairs are looked up). A group
stops when it has the least possible number of sequences or none of them can
be emptied. Sequences with room for another piece are then dealt to fewer
groups and packed again, until one group remains. Every round places at
least half of its pieces, if need be in the fullest sequences of each group, so
that the groups never grow.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageprism.llm.common import documents, in_arrow, materialize
from pageprism.llm.tokens import Encoder, text_groups

_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]
_PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int | None, capacity: int, with_ids: bool = False) -> DataFrame:
    """Each document's ids (``end_id`` appended), cut only where longer than ``capacity``.

    A null text is an empty one. A document without any id (no end id) has no
    piece. ``with_ids`` adds the ids (little-endian unsigned 32-bit).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, z in text_groups(texts):
                rows: list[tuple] = []
                for key, data in zip(keys[a:z], encoder.encode(texts[a:z]), strict=True):
                    data += end
                    for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                        ids = data[at : at + 4 * capacity]
                        rows.append((key, piece, at // 4, len(ids) // 4, zlib.crc32(ids), ids))
                columns = list(zip(*rows, strict=True)) or [()] * 6
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                n = 6 if with_ids else 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[:n], kinds[:n], strict=True)], names=names[:n])

    return in_arrow(documents(docs), run, _PIECE + ", ids binary" * with_ids)


class _Bins:
    """Sequences of one group."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bin = np.full(len(sizes), -1, np.int64)
        self.fill: list[int] = []
        self._best_fit()

    def _best_fit(self) -> None:
        room: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        open_rooms = 0  # bit r: some sequence has room r
        for i in np.argsort(-self.sizes, kind="stable").tolist():
            size = int(self.sizes[i])
            fits = open_rooms >> size
            if fits:
                r = size + (fits & -fits).bit_length() - 1
                b = room[r].pop()
                if not room[r]:
                    open_rooms ^= 1 << r
            else:
                r, b = self.capacity, len(self.fill)
                self.fill.append(0)
            self.bin[i] = b
            self.fill[b] += size
            left = r - size
            room[left].append(b)
            open_rooms |= 1 << left

    def search(self) -> None:
        """Empty sequences until none can be.

        Each exchange raises the sum of squared fills, so there is an end. A sequence that found no exchange is looked at again after another one
        was emptied. It, or another with the same lengths, is then compared
        only with sequences changed since, and with equal ones.
        """
        least = -(-int(self.sizes.sum()) // self.capacity)
        fill = np.array(self.fill, np.int64)
        used = int((fill > 0).sum())
        order = np.argsort(self.bin, kind="stable")
        members = [m.tolist() for m in np.split(order, np.searchsorted(self.bin[order], np.arange(1, len(fill))))]
        changed, now = np.ones(len(fill), np.int64), 1
        failed: dict[tuple[int, ...], int] = {}  # lengths, and when they found nothing
        tried = np.zeros(len(fill), bool)  # since one was emptied
        while used > least:
            open_fill = np.where((fill > 0) & ~tried, fill, self.capacity)
            victim = int(np.argmin(open_fill))
            if open_fill[victim] == self.capacity:
                break
            tried[victim] = True
            while fill[victim]:
                lengths = tuple(sorted(self.sizes[members[victim]].tolist()))
                since = failed.get(lengths, 0)
                target = -1 if since == now else self._exchange(fill, victim, members, (changed > since) | (fill == fill[victim]))
                if target < 0:
                    failed[lengths] = now
                    break
                now += 1
                changed[[victim, target]] = now
            if not fill[victim]:
                used -= 1
                tried[:] = False
        self.fill = fill.tolist()

    def _exchange(self, fill: np.ndarray, victim: int, members: list[list[int]], among: np.ndarray) -> int:
        """One exchange between ``victim`` and a fuller sequence (of ``among``), the one that fills it most; its number or -1."""
        room = self.capacity - fill
        room[(fill == 0) | (fill < fill[victim]) | ~among] = 0
        room[victim] = 0
        best_room = int(room.max(initial=0))
        if not best_room:
            return -1
        own = sorted(members[victim], key=lambda i: (-self.sizes[i], i))
        for i in own:  # move
            size = int(self.sizes[i])
            if size <= best_room:
                fits = np.flatnonzero(room >= size)
                b = int(fits[np.argmin(room[fits])])
                self._shift(fill, members, [i], victim, b)
                return b
        of_size: dict[int, list[int]] = {}
        for i in own:
            of_size.setdefault(int(self.sizes[i]), []).append(i)
        # distinct lengths add up to the capacity at most, so they are few, however many pieces there are
        distinct = list(of_size.items())
        sums: dict[int, list[int]] = {}
        for n, (size, mine) in enumerate(distinct):
            if len(mine) > 1:
                sums.setdefault(2 * size, mine[:2])
            for other_size, theirs in distinct[n + 1 :]:
                sums.setdefault(size + other_size, [mine[0], theirs[0]])
        sums |= {size: mine[:1] for size, mine in distinct}
        offered = np.array(sorted(sums), np.int64)
        others = np.flatnonzero(room[self.bin] > 0)
        sizes = self.sizes[others]
        # one for one, two for one: for each piece the longest offer that still fits in its place
        at = np.searchsorted(offered, sizes + room[self.bin[others]], "right") - 1
        gain = np.where(at < 0, 0, offered[at] - sizes)
        most = int(gain.max(initial=0))
        if not most:
            return -1
        # of equal gains one piece before two, the longest first: short ones are easier to place later
        k = max(np.flatnonzero(gain == most).tolist(), key=lambda k: (-len(sums[int(offered[at[k]])]), offered[at[k]], -k))
        other, target = int(others[k]), int(self.bin[others[k]])
        self._shift(fill, members, [other], target, victim)
        self._shift(fill, members, sums[int(offered[at[k]])], victim, target)
        return target

    def _shift(self, fill: np.ndarray, members: list[list[int]], items: list[int], source: int, target: int) -> None:
        size = int(self.sizes[items].sum())
        self.bin[items] = target
        members[source] = [i for i in members[source] if i not in items]
        members[target] += items
        fill[source] -= size
        fill[target] += size


def _placer(capacity: int, level: int) -> Callable:
    """Packs one group. ``fuller``: among the fullest sequences with half of the group's pieces."""

    def place(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "piece", "start", "row"], ignore_index=True)
        bins = _Bins(frame["length"].to_numpy(np.int64), capacity)
        bins.search()
        fill = np.array(bins.fill, np.int64)
        count = np.bincount(bins.bin, minlength=len(fill))
        down = np.argsort(-fill, kind="stable")
        fuller = np.zeros(len(fill), bool)
        fuller[down[np.cumsum(count[down]) - count[down] < len(frame) / 2]] = True
        frame["fuller"], frame["room"] = fuller[bins.bin], capacity - fill[bins.bin]
        order = np.argsort(bins.bin, kind="stable")
        frame, b = frame.iloc[order], bins.bin[order]
        ends = frame["length"].cumsum().to_numpy()
        begins = ends - frame["length"].to_numpy()
        new = np.concatenate([[True], b[1:] != b[:-1]])
        frame["offset"] = begins - begins[np.flatnonzero(new)][np.cumsum(new) - 1]
        frame["sequence_id"] = (level << 56) + (int(key[0]) << 24) + b
        return frame[["row", *_NAMES, "sequence_id", "offset", "fuller", "room"]]

    return place


def pack(pieces: DataFrame, capacity: int, group_rows: int = 20_000) -> DataFrame:
    """``sequence_id`` and ``offset`` for every row of ``pieces`` (columns of ``token_pieces``; ``ids`` stay if there).

    A sequence holds at most ``capacity`` tokens, offsets leave no gap. Pieces
    of length 0 get a place, too. Rows may repeat; each is packed. A length that is null
    or above the capacity is an error. ``group_rows`` bounds what one task
    holds (up to the chance of a hash of row numbers) in every round; it drops nothing. After a round the sequences without room
    for the shortest piece left are final, and the others are packed once more with those of other groups; where they hold more than half of the
    pieces, only the less filled ones, with at most half of them, are.
    """
    bad = F.col("length").isNull() | (F.col("length") > capacity)
    ids = [c for c in pieces.columns if c == "ids"]
    pieces = materialize(
        pieces.select(*_NAMES, *ids)
        .withColumn("length", F.when(bad, F.raise_error(F.lit("a piece does not fit into a sequence"))).otherwise(F.col("length")))
        .withColumn("row", F.monotonically_increasing_id()),
        "pieces",
    )
    full = pieces.filter(F.col("length") == capacity)
    done = [full.select("row", *_NAMES, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))]
    rest, level = pieces.filter(F.col("length") < capacity), 0
    rows = rest.count()
    while rows:
        groups = -(-rows // group_rows)
        dealt = rest.select("row", *_NAMES).withColumn("g", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(groups)))
        schema = f"row bigint, {_PIECE}, sequence_id bigint, offset bigint, fuller boolean, room bigint"
        out = materialize(dealt.groupBy("g").applyInPandas(_placer(capacity, level), schema), "packed")
        placed = F.lit(True)
        if groups > 1:
            shortest = out.agg(F.min("length")).first()[0]
            placed = F.col("room") < shortest
            if out.filter(~placed).count() > rows / 2:
                placed |= F.col("fuller")
        done.append(out.filter(placed).select("row", *_NAMES, "sequence_id", "offset"))
        if groups == 1:
            break
        rest, level = out.filter(~placed), level + 1
        rows = rest.count()
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    # ids never enter a group; they meet their places at the end
    return (result.join(pieces.select("row", *ids), "row") if ids else result).drop("row")


def packed_documents(docs: DataFrame, tokenizer: str, end_id: int | None = 1, capacity: int = 4096, with_ids: bool = False) -> DataFrame:
    """Sequences from whole documents: one row per piece with its sequence and offset, and its ids (``with_ids``).

    Null texts are empty; rows with null or repeated ids are packed like any other; an empty
    table gives an empty result; other columns are not looked at.
    """
    return pack(token_pieces(docs, tokenizer, end_id, capacity, with_ids), capacity)
