"""Token ids as compact binary files with short-document access.

Layout of a store (a folder; written and read by Spark's Parquet source, so any
file system Spark knows will do and lost tasks are simply run again):

* ``dictionary``: one row: the zstandard dictionary, its sha256, the width of
  a serialized id in bytes.
* ``blocks``: one row per block of about ``block_bytes``: the documents' ids in
  ascending order, their numbers of tokens, the byte offset of each
  document's frame, the frames themselves, the dictionary's sha256, and the
  tokens before the block in its part. Each document is a frame of its own, so
  reading one document decompresses that document alone.
* ``parts``: tokens before each part. Parts are ranges of ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageprism.llm.common import documents, in_arrow
from pageprism.llm.tokens import Encoder, text_groups

_BLOCK = (
    "part int, seq int, first_id bigint, last_id bigint, dictionary string, tokens_before bigint, tokens bigint,"
    " doc_ids array<bigint>, n_tokens array<bigint>, offsets array<bigint>, payload binary"
)
_NAMES = [c.split()[0] for c in _BLOCK.split(",")]


def _serialized(ids: bytes, end_id: int | None, width: int) -> np.ndarray:
    out = np.frombuffer(ids, "<u4")
    if end_id is not None:
        out = np.append(out, np.uint32(end_id))
    return out.astype(f"<u{width}")


def _binary(values: list[bytes]) -> pa.Array:
    """A binary column from one joined buffer."""
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(b"".join(values))])


def train_dictionary(
    docs: DataFrame, tokenizer: str, end_id: int | None, width: int, sample_docs: int, sample_chars: int, dict_bytes: int
) -> bytes:
    """A shared dictionary from at most ``sample_docs`` texts; of longer ones a piece of ``sample_chars`` characters.

    The sample has the least hashes of ids, hence is spread over
    the whole table and the same in every run; so is the place of a piece in its text. Too few or too uniform samples
    give a dictionary of their plain bytes, no texts an empty one. Four ids are drawn for each text, as some texts may be empty.
    """
    import zstandard

    texts = documents(docs)
    # ids alone are ordered; only the chosen texts travel
    order = F.xxhash64("doc_id"), "doc_id"
    ids = texts.select("doc_id").filter("doc_id IS NOT NULL").orderBy(*order).limit(4 * sample_docs).distinct()
    some = texts.join(F.broadcast(ids), "doc_id").filter("text <> ''")
    begin = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.length("text") - sample_chars, F.lit(0)) + 1) + 1
    some = some.select("doc_id", F.substring("text", begin, F.lit(sample_chars)).alias("text")).orderBy(*order, "text").limit(sample_docs)
    some = sorted(some.collect())
    encoded = Encoder.of(tokenizer).encode([r.text for r in some])
    samples = [_serialized(ids, end_id, width).tobytes() for ids in encoded]
    try:
        return zstandard.train_dictionary(dict_bytes, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:dict_bytes]


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int | None = None,
    width: int | None = None,
    block_bytes: int = 1 << 20,
    sample_docs: int = 512,
    sample_chars: int = 20_000,
    dict_bytes: int = 64 << 10,
    level: int = 3,
) -> None:
    """Encode whole texts (no special tokens added, ``end_id`` appended) into a new store at ``path``.

    Documents are stored in ascending order of ids, those without an id first,
    rows of one id by text. Null texts are empty. Other columns are not
    looked at. An empty table gives a store without documents.
    """
    spark = docs.sparkSession
    if width is None:
        width = 2 if max(Encoder.of(tokenizer).tokenizer.get_vocab_size(), (end_id or 0) + 1) <= 1 << 16 else 4
    dictionary = train_dictionary(docs, tokenizer, end_id, width, sample_docs, sample_chars, dict_bytes)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(bytearray(dictionary), digest, width)], "data binary, sha256 string, width int").coalesce(1).write.parquet(
        f"{path}/dictionary"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        shared = zstandard.ZstdCompressionDict(dictionary)
        if dictionary:
            shared.precompute_compress(level=level)
        packer = zstandard.ZstdCompressor(level=level, dict_data=shared)
        encoder, part = Encoder.of(tokenizer), TaskContext.get().partitionId()
        before, seq = 0, 0
        ids: list[int | None] = []
        counts: list[int] = []
        frames: list[bytes] = []
        size = 0

        def block() -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])])
            known = [i for i in ids if i is not None]
            row = (
                part, seq, min(known, default=None), max(known, default=None), digest, before, sum(counts), ids, counts,
                offsets.tolist(), b"".join(frames),
            )
            kinds = [
                pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()),
                pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(),
            ]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=_NAMES)

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, z in text_groups(texts):
                for i, data in zip(keys[a:z], encoder.encode(texts[a:z]), strict=True):
                    out = _serialized(data, end_id, width)
                    ids.append(i)
                    counts.append(len(out))
                    frames.append(packer.compress(out.tobytes()))
                    size += len(frames[-1])
                    if size >= block_bytes:
                        yield block()
                        before, seq = before + sum(counts), seq + 1
                        ids, counts, frames, size = [], [], [], 0
        if ids:
            yield block()

    ordered = documents(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    in_arrow(ordered, run, _BLOCK).write.option("compression", "none").parquet(f"{path}/blocks")
    totals = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("tokens").alias("tokens"))
    # one row per part, that is per task of the writing stage
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals.select("part", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("start")).coalesce(1).write.parquet(f"{path}/parts")


def _dictionary(spark: SparkSession, path: str) -> tuple[bytes, str, int]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(row.data).hexdigest() != row.sha256:
        raise ValueError("the dictionary does not have the hash it was written with")
    return bytes(row.data), row.sha256, row.width


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Documents of a store: ``doc_id``, ``start`` (tokens of all documents before it), ``n_tokens``, ``ids`` (little-endian unsigned 32-bit).

    With ``doc_ids`` only blocks that may hold one of these are read, and of
    them only the wanted frames are decompressed.
    """
    data, digest, width = _dictionary(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks")
    if doc_ids is not None:
        inside = F.lit(False)
        for i in doc_ids:
            inside = inside | F.lit(i).between(F.col("first_id"), F.col("last_id"))
        blocks = blocks.filter(inside)
    wanted = None if doc_ids is None else set(doc_ids)
    # one row per part, that is per task of the writing stage
    parts = F.broadcast(spark.read.parquet(f"{path}/parts"))
    blocks = blocks.join(parts, "part").select(
        "dictionary", (F.col("start") + F.col("tokens_before")).alias("start"), "doc_ids", "n_tokens", "offsets", "payload"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data))
        for batch in batches:
            for block in range(batch.num_rows):
                if batch.column(0)[block].as_py() != digest:
                    raise ValueError("a block was written with another dictionary")
                ids = batch.column(2)[block].as_py()
                counts = np.asarray(batch.column(3)[block].values)
                offsets = np.asarray(batch.column(4)[block].values)
                payload = memoryview(batch.column(5)[block].as_buffer())
                starts = batch.column(1)[block].as_py() + np.cumsum(counts) - counts
                rows = [i for i, d in enumerate(ids) if wanted is None or d in wanted]
                out = [
                    np.frombuffer(unpacker.decompress(payload[offsets[i] : offsets[i + 1]]), f"<u{width}").astype("<u4").tobytes()
                    for i in rows
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[i] for i in rows], pa.int64()), pa.array(starts[rows]), pa.array(counts[rows]), _binary(out)],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return in_arrow(blocks, run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")
