import random
import re

import numpy as np
import pyarrow as pa

from pageprism.llm import near_dup as N
from pageprism.llm import words as W
from pageprism.llm.components import connected
from pageprism.llm.near_dup import _Hashes, least_estimate, near_duplicates


def shingles(text, k):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, num, den):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0]
            if same_id or sets[i] and den * both >= num * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    least = {r: min((d for d in v if d is not None), default=None) for r, v in ids.items()}
    return [(d, len(sets[i]), least[find(i)], d is None or least[find(i)] == d) for i, (d, _) in enumerate(rows)]


def order(rows):
    return sorted(map(repr, rows))


def test_odd_documents(odd, odd_rows):
    got = [tuple(r) for r in near_duplicates(odd, 3, 85, 100).collect()]
    assert order(got) == order(brute(odd_rows, 3, 85, 100))


def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert order(tuple(r) for r in near_duplicates(docs).collect()) == order(brute(rows, 5, 80, 100))


def test_large_group(spark):
    """Hundreds of variants of one text, some of them linked only by way of others."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(300):
        t = list(base)
        for p in rng.integers(0, 100, rng.integers(0, 8)):
            t[p] = f"v{rng.integers(0, 4)}"
        rows.append((i, " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert order(tuple(r) for r in near_duplicates(docs, 3, 85, 100).collect()) == order(brute(rows, 3, 85, 100))


def test_empty(empty):
    assert near_duplicates(empty).collect() == []


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(5, 5), (None, 3), (100, 200), (300, 100), (200, 300)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 200: 100, 300: 100}
    assert connected(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_signature_estimates_similarity():
    h = _Hashes(30, 5)
    a, b = (W.mix(np.arange(lo, lo + 900, dtype=np.uint64)) for lo in (0, 100))
    x, y = (h.packed(h.minima(s)) for s in (a, b))
    d = x ^ y
    differ = sum(bin(int(v)).count("1") for v in (d | d >> np.uint64(1)) & np.uint64(0x5555555555555555))
    assert abs((1 - differ / (0.75 * 150)) - 0.8) < 0.15
    assert 0.5 < least_estimate(0.85, 150) < 0.85


def test_words_of_blocks():
    texts = ["Ab cd", None, "", "  x", "tail ", "é b"] * 3
    seen = []
    for lo, hi, w in W.blocks(pa.array(texts), W.NOT_SPACE, lower=True, limit=7):
        for d in range(hi - lo):
            seen.append([w.bytes_of(i).decode() for i in range(w.first[d], w.first[d + 1])])
    assert seen == [re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split(" ") if t and t.strip() and t[0] != " " and t[-1] != " " else (t or "").split() for t in texts]


def test_unlinked_templates_do_not_meet(spark):
    """Texts that share nine tenths of a template share buckets, too, but no pair of them is formed by their rare shingles."""
    r = random.Random(4)
    line = [f"t{i}" for i in range(200)]
    rows = [(i, " ".join([*line, *[f"{r.random():.9f}" for _ in range(24)]])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    found = N.prefixes(N.documents(docs), 3, 85, 100)
    assert found.count() > 0 and found.filter("small").count() == 0
    got = sorted((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in N.near_duplicates(docs, k=3, num=85, den=100).collect())
    assert got == sorted(brute(rows[:], 3, 85, 100))
