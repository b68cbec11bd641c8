import random
import re

import pytest

from pageprism.llm.decontaminate import contaminated_words
from pageprism.llm.substring import substring_dedup

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_substring(rows, window):
    first = {}
    words = [(i, re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in rows]
    for i, w in words:
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            first[k] = min(first.get(k, float("inf")), float("inf") if i is None else i)
    out = []
    for i, w in words:
        cover = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < (float("inf") if i is None else i):
                cover[p : p + window] = [True] * window
        out.append((i, len(w), sum(cover), " ".join(x for x, c in zip(w, cover, strict=True) if not c)))
    return sorted(map(repr, out))


@pytest.mark.parametrize(("window", "gram"), [(50, 16), (20, 20), (8, 3)])
def test_substrings_of_odd_documents(odd, odd_rows, window, gram):
    got = [(r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), r.kept_text) for r in substring_dedup(odd, window, gram).collect()]
    assert sorted(map(repr, got)) == brute_substring(odd_rows, window)


def greedy(rows, window):
    """Factors by a plain parse: each window's reference is the smallest document that has it, at its first word there."""
    first, out = {}, {}
    for i, text in sorted(rows):
        words = re.findall(r"[^\x20\x09-\x0d]+", text)
        out[i], own = [], {}
        for p in range(len(words) - window + 1):
            w = tuple(words[p : p + window])
            own.setdefault(w, (i, p))
            if w in first:
                doc, place = first[w]
                last = out[i][-1] if out[i] else None
                if last and last[0] + last[1] - window + 1 == p and last[2] == doc and last[3] + last[1] - window + 1 == place:
                    last[1] += 1
                else:
                    out[i].append([p, window, doc, place])
        for w, at in own.items():
            first.setdefault(w, at)
    return {i: [tuple(f) for f in x] for i, x in out.items()}


def test_factors_are_a_greedy_parse(spark, sf):
    r = random.Random(7)
    base = [f"w{r.randint(0, 300)}" for _ in range(900)]
    rows = []
    for i in range(40):  # pieces of one text and of earlier documents, put together anew
        words = []
        for _ in range(r.randint(1, 5)):
            source = r.choice(rows)[1].split() if rows and r.random() < 0.6 else base
            a = r.randrange(max(1, len(source) - 5))
            words += source[a : a + r.randint(5, 120)] + [f"x{r.randint(0, 9999)}"] * r.randint(0, 2)
        rows.append((i, " ".join(words)))
    given = [tuple(x) for x in spark.read.parquet(f"{sf}/documents.parquet").filter("text IS NOT NULL").select("doc_id", "text").collect()]
    for some, window, gram in ((rows, 20, 7), (rows, 12, 12), (given, 50, 16)):
        docs = spark.createDataFrame(some, "doc_id bigint, text string").repartition(3)
        got = {x.doc_id: [tuple(f) for f in x.factors] for x in substring_dedup(docs, window, gram).collect()}
        assert got == greedy(some, window)
        assert any(got.values())


def test_substrings_of_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = [(r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), r.kept_text) for r in substring_dedup(docs).collect()]
    assert sorted(map(repr, got)) == brute_substring([tuple(r) for r in docs.collect()], 50)


def test_rows_without_an_id_do_not_share_arrays(spark, monkeypatch):
    from conftest import prose

    from pageprism.llm import substring

    shared = prose(60, 1)
    unlike = [" ".join(prose(70, s) + shared + prose(70, s + 100)) for s in range(2, 42)]
    rows = [(1, " ".join(shared)), *[(None, t) for t in unlike], *[(None, unlike[0])] * 20]
    longest = []
    parse = substring._parse

    def measured(flagged, *more):
        longest.append(flagged.selectExpr("max(size(keys))").first()[0])
        return parse(flagged, *more)

    monkeypatch.setattr(substring, "_parse", measured)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [(r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), r.kept_text) for r in substring_dedup(docs).collect()]
    assert sorted(map(repr, got)) == brute_substring(rows, 50)
    assert longest[0] <= 11  # the shared passage has so many windows


def test_windows_that_cannot_be():
    with pytest.raises(ValueError):
        substring_dedup(None, window=200, gram=16)


def test_no_documents(empty, spark):
    assert substring_dedup(empty).collect() == []
    assert contaminated_words(empty, spark.createDataFrame([(1, "a b")], "item_id bigint, text string")).collect() == []


def brute_hits(rows, items, window):
    cut = lambda t: WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    known = {}
    for i, t in items:
        w = cut(t)
        if i is not None and w:
            m = min(window, len(w))
            for p in range(len(w) - m + 1):
                known.setdefault(tuple(w[p : p + m]), set()).add(i)
    out = []
    for i, t in rows:
        w, hit, found = cut(t), set(), set()
        for m in {len(k) for k in known}:
            for p in range(len(w) - m + 1):
                if (k := tuple(w[p : p + m])) in known:
                    hit |= set(range(p, p + m))
                    found |= known[k]
        out.append((i, len(w), sorted(hit), sorted(found)))
    return sorted(map(repr, out))


@pytest.mark.parametrize("block_words", [2_000_000, 300])
def test_windows_of_items(spark, odd, odd_rows, block_words):
    text = odd_rows[0][1].split()
    items = [
        (1, " ".join(text[5:30])), (2, "one"), (3, "le " * 40), (4, None), (5, ""), (6, "!!"), (None, "lonely words"), (7, " ".join(text[40:50])),
        (7, " ".join(text[40:50])), (8, "stand here"), (9, "LONELY words STAND"), (10, "x" * 100_000), (11, " ".join(text[100:108] + ["no"])),
    ]
    bench = spark.createDataFrame([(*i, "extra") for i in items], "item_id bigint, text string, spans string")
    rows = contaminated_words(odd, bench, block_words=block_words).collect()
    got = [(r.doc_id, r.n_words, [p for s in r.spans for p in range(s.start, s.end)], r["items"]) for r in rows]
    assert sorted(map(repr, got)) == brute_hits(odd_rows, items, 10)


def test_no_items(spark, odd, odd_rows):
    rows = contaminated_words(odd, spark.createDataFrame([], "item_id bigint, text string")).collect()
    assert len(rows) == len(odd_rows) and not any(r.spans or r["items"] for r in rows)
