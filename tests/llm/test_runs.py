"""Periodic runs against a brute-force search over all periods."""

import hashlib
import random
import re
import zlib

import pytest
from compare import compare  # noqa: F401  (puts the repository on the path)

from pageprism.llm.queries import op13_periodic_runs
from pageprism.llm.runs import periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, shortest=6):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            start, length = i - q, j - i + q
            i = j
            if length >= max(shortest, 4 * q):
                stretch = words[start:j]
                if not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                    out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def check(rows, texts):
    for row, text in zip(rows, texts, strict=True):
        words = WORD.findall(text or "")
        want = brute(words)
        assert [tuple(r) for r in row.runs] == want, text
        assert (row.n_words, row.collapsed) == (len(words), collapse(words, want))


def periodic_texts(n, seed=3):
    r, out = random.Random(seed), []
    for _ in range(n):
        words = []
        for _ in range(r.randint(0, 5)):
            unit = [r.choice("ab") if r.random() < 0.7 else r.choice("cdé") for _ in range(r.choice([1, 2, 3, 4, 5, 7, 8, 9, 16, 17]))]
            times = r.choice([1, 2, 3, 4, 5, 9]) * len(unit) + r.randint(0, len(unit))
            words += [unit[i % len(unit)] for i in range(times)] + [r.choice("abx") for _ in range(r.randint(0, 3))]
        out.append(r.choice([" ", "\t", " \n "]).join(words))
    return out


def test_against_brute_force(spark):
    texts = periodic_texts(600) + ["", None, " \n\t", "a", "a a a a a", "a a a a a a", "  a b a b a b a b", "a b " * 3 + "a", "a b " * 4]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    check(sorted(periodic_runs(docs).collect()), texts)


def test_binary_words(spark):
    """Short texts over two words: nested and overlapping runs."""
    r = random.Random(8)
    texts = [" ".join(r.choice("ab") for _ in range(r.randint(0, 40))) for _ in range(1500)]
    rows = periodic_runs(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    check(sorted(rows), texts)


def test_long_texts_take_linear_time(spark):
    """One word 300,000 times, and a long period; all pairs of occurrences would be 45 billion."""
    unit = [f"w{i}" for i in range(40_000)]
    texts = ["le " * 300_000, " ".join(unit * 5), " ".join(["x", *["le"] * 5] * 30_000)]
    rows = sorted(periodic_runs(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect())
    assert [[tuple(r) for r in row.runs] for row in rows[:2]] == [[(0, 300_000, 1)], [(0, 200_000, 40_000)]]
    assert [tuple(r) for r in rows[2].runs] == [(0, 180_000, 6)]
    assert (rows[0].collapsed, rows[1].collapsed) == ("le", " ".join(unit))


def test_odd_rows(spark, odd, odd_rows, empty):
    key = lambda r: (r.doc_id is None, r.doc_id, r.n_words, r.collapsed)
    got = sorted(periodic_runs(odd).collect(), key=key)
    plain = spark.createDataFrame(odd_rows, "doc_id bigint, text string")
    assert got == sorted(periodic_runs(plain).collect(), key=key)
    assert len(got) == len(odd_rows)
    assert [tuple(r) for r in next(r for r in got if r.doc_id == 13).runs] == [(0, 3000, 1)]
    assert periodic_runs(empty).count() == 0


def test_too_short_runs_are_refused(odd):
    with pytest.raises(ValueError):
        periodic_runs(odd, shortest=4)


def planted(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_query_on_the_given_documents(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op13_periodic_runs(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    some = 0
    for r in rows:
        words = planted(r.doc_id, texts[r.doc_id])
        if len(words) > 3000:
            continue
        runs = brute(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        milli = 1000 * best[1] // best[2] if runs else None
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *best, milli)
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert r.collapsed_sha256 == sha(collapse(words, runs))
        some += bool(runs)
    assert some > 3
