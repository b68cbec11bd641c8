import random
import zlib

import numpy as np
import pytest

from pageprism.llm.packing import _Bins, packed_documents
from pageprism.llm.queries import tokenizer
from pageprism.llm.token_files import read_tokens, train_dictionary, write_tokens
from pageprism.llm.tokens import Encoder
from pageprism.sources.sinks import work_dir

HARD = [
    "it's we'll <|endoftext|> a<|startoftext|>b", "x́ éa Å", "(don't) 'tis 's.'t", "a\tb\x1cc d　e", "İstanbul Ǆ ΑΣ ας",
    "1234 12ab 45.114.23.72", "日本語 テスト。", "a" * 3000, "", "  \n\n ", ".<|endoftext|>.", "foo|>bar <| x", "_a_b_ `x`", "\U0001f600 a\U0001f600b",
    "a., b.. c!. d, .e , f. ", "<|ENDOFTEXT|> X, y. Z", "ﬁn ªº ŉ", "end.", "a ,b .c",
]


def plain(text, end):
    ids = Encoder.of(tokenizer()).tokenizer.encode(text or "", add_special_tokens=False).ids
    return np.array([*ids, end], "<u4").tobytes()


def test_encoder_equals_the_library(spark, sf):
    e = Encoder(tokenizer(), entries=50)  # forgets all the time
    texts = HARD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(40).collect()]
    for part in (texts, texts[::-1]):
        for t in part:
            assert e.encode([t])[0] == plain(t, 0)[:-4]
    assert e.encode([None, "a"]) == [b"", plain("a", 0)[:-4]]


def test_encoder_equals_the_library_on_odd_strings():
    r = random.Random(2)
    signs = [*"İßﬁſaBẹÉéıǅŉ²ª09\u0301\u0307\u0327\u05e9\u05c1\u0915\u093c\ufb1d .,!'()-_\x00\x1f\t\n<|>", ", ", ". ", "'s", "<|", " the", "Iı", "ALİ, "]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(1, 14))) for _ in range(30_000)] + ["ALİ, VELİ.", "İ, "]
    e = Encoder(tokenizer(), entries=10_000)
    assert e.by_words
    want = [np.array(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    for t, ids in zip(texts, want, strict=True):
        e.words, e.parts = {"": b""}, {"": b""}
        assert e.encode([t])[0] == ids, repr(t)


def test_other_tokenizers_get_whole_texts():
    import public_tokenizers

    e = Encoder(public_tokenizers.path("byte_bpe_50k.json"), entries=100)
    assert not e.by_words
    assert e.encode(["A b, c", None]) == [np.array(e.tokenizer.encode("A b, c", add_special_tokens=False).ids, "<u4").tobytes(), b""]


def test_dictionary_of_long_texts(spark):
    docs = spark.createDataFrame([(i, f"some words {i} " * 4000) for i in range(40)] + [(50, ""), (51, None)], "doc_id bigint, text string")
    assert len(train_dictionary(docs, tokenizer(), 2, 2, sample_docs=30, sample_chars=500, dict_bytes=4096)) > 100


def test_store_round_trip(spark, odd, odd_rows):
    path = work_dir(spark, "test-tokens")
    write_tokens(odd, path, tokenizer(), end_id=2, block_bytes=2000)
    rows = sorted(read_tokens(spark, path).collect(), key=lambda r: r.start)
    want = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert [(r.doc_id, bytes(r.ids)) for r in rows] == [(i, plain(t, 2)) for i, t in want]
    starts = np.cumsum([0, *[r.n_tokens for r in rows]])
    assert [r.start for r in rows] == starts[:-1].tolist()
    some = read_tokens(spark, path, doc_ids=[12, 8, 999]).collect()
    assert sorted((r.doc_id, r.start, bytes(r.ids)) for r in some) == sorted((r.doc_id, r.start, bytes(r.ids)) for r in rows if r.doc_id in (8, 12))
    assert spark.read.parquet(f"{path}/blocks").count() > 1


def test_empty_store(spark, empty):
    path = work_dir(spark, "test-tokens")
    write_tokens(empty, path, tokenizer(), end_id=2)
    assert read_tokens(spark, path).collect() == []


def check_packing(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(odd, odd_rows, empty):
    rows = packed_documents(odd, tokenizer(), end_id=1, capacity=100).collect()
    want = []
    for i, t in odd_rows:
        data = plain(t, 1)
        for p in range(0, len(data), 400):
            want.append((i, p // 400, p // 4, len(data[p : p + 400]) // 4, zlib.crc32(data[p : p + 400])))
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)
    total = sum(r.length for r in rows)
    assert check_packing(rows, 100) <= -(-total // 100) + 1
    assert packed_documents(empty, tokenizer()).collect() == []


def test_packing_in_many_groups(spark):
    from pageprism.llm.packing import pack

    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 700, 3000).tolist()
    pieces = spark.createDataFrame([(i, 0, 0, s, 0) for i, s in enumerate(sizes)], "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    rows = pack(pieces, 1000, group_rows=200).collect()
    assert sorted(r.doc_id for r in rows) == list(range(3000))
    assert check_packing(rows, 1000) <= -(-sum(sizes) // 1000) * 1.01 + 1


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def test_packing_keeps_groups_small_where_nothing_fits(spark):
    from pageprism.llm.packing import pack

    rng = np.random.default_rng(2)
    for sizes in ([600] * 3000, rng.integers(510, 980, 3000).tolist(), [730] * 1000 + rng.integers(1, 60, 2000).tolist()):
        # no id tells the rows apart
        rows = pack(spark.createDataFrame([(None, 0, 0, s, 0) for s in sizes], PIECES), 1000, group_rows=200).collect()
        assert sorted(r.length for r in rows) == sorted(sizes)
        held = {}
        for r in rows:
            held[r.sequence_id >> 24] = held.get(r.sequence_id >> 24, 0) + 1
        assert max(held.values()) < 300
        whole = _Bins(np.array(sizes, np.int64), 1000)
        assert check_packing(rows, 1000) <= len([f for f in whole.fill if f]) * 1.01


def test_equal_sequences_are_tried_once():
    tried = []

    class Counting(_Bins):
        def _exchange(self, fill, victim, *more):
            tried.append(victim)
            return super()._exchange(fill, victim, *more)

    b = Counting(np.array([600] * 500 + [700] * 500, np.int64), 1000)
    b.search()
    assert len(b.fill) == 1000
    assert len(tried) <= 4


def test_a_sequence_may_join_one_of_the_same_length():
    sizes = [40, 41, 44, 19, 18, 31, 19, 56, 13, 28, 36, 20, 22, 48, 38, 57, 44, 36, 41]
    b = _Bins(np.array(sizes, np.int64), 100)
    b.bin, b.fill = np.arange(len(sizes)), list(sizes)
    b.search()
    assert len([f for f in b.fill if f]) == 7


def test_pairs_of_all_pieces_are_exchanged():
    # only the two shortest of 42 pieces fill the other sequence, in place of its piece of 63
    b = _Bins(np.array([100] * 40 + [35, 30] + [63, 4935], np.int64), 5000)
    b.bin = np.array([0] * 42 + [1, 1])
    b.fill = [4065, 4998]
    fill = np.array(b.fill)
    assert b._exchange(fill, 0, [list(range(42)), [42, 43]], np.ones(2, bool)) == 1
    assert fill.tolist() == [4063, 5000]


def test_exchanges_grow_with_the_group():
    import pandas as pd

    from pageprism.llm.packing import _placer

    sizes = np.random.default_rng(0).integers(1000, 2500, 5000)
    frame = pd.DataFrame({"row": range(5000), "doc_id": range(5000), "piece": 0, "start": 0, "length": sizes, "ids_crc32": 0})
    assert _placer(4096, 0)((0,), frame)["sequence_id"].nunique() < len(_Bins(sizes, 4096).fill)


@pytest.mark.parametrize(("low", "high", "above"), [(1000, 2500, 1.03), (1300, 1401, 1.03), (900, 1101, 1.04), (700, 1401, 1.035), (1, 4096, 1.05)])
def test_distance_to_the_bound(low, high, above):
    """Sequences over the sum of lengths, on tables where few pieces go into one."""
    sizes = np.random.default_rng(0).integers(low, high, 3000).astype(np.int64)
    b = _Bins(sizes, 4096)
    b.search()
    assert sum(f > 0 for f in b.fill) <= above * -(-int(sizes.sum()) // 4096)


@pytest.mark.parametrize("sizes", [[60, 60, 40, 40, 50, 50], [51, 27, 26, 23, 24, 25, 24], [5, 5, 5], []])
def test_local_search_reaches_the_least(sizes):
    b = _Bins(np.array(sizes, np.int64), 100)
    b.bin = np.arange(len(sizes))  # worst start: every piece on its own
    b.fill = list(sizes)
    b.search()
    used = [f for f in b.fill if f]
    assert len(used) == -(-sum(sizes) // 100)
    assert sorted(used) == sorted(int(b.sizes[b.bin == k].sum()) for k in set(b.bin.tolist()))
