"""The n-gram join against all pairs of sets."""

import random
import re

import numpy as np
import pytest
from compare import SF  # noqa: F401

from pageprism.llm import ngram_join as J
from pageprism.llm.ngram_join import ngram_join
from pageprism.llm.queries import op11_ngram_join


def sets(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if len(words) < k:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def components(texts, k, num, den):
    """Smallest row of each text's component, over all pairs."""
    s = [sets(t, k) for t in texts]
    root = list(range(len(s)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = {}
    for i, x in enumerate(s):
        for g in x:
            by.setdefault(g, []).append(i)
    seen = set()
    for own in by.values():
        for n, i in enumerate(own):
            for j in own[n + 1 :]:
                if (i, j) not in seen:
                    seen.add((i, j))
                    shared = len(s[i] & s[j])
                    if den * shared >= num * (len(s[i]) + len(s[j]) - shared):
                        a, b = sorted((find(i), find(j)))
                        root[b] = a
    return [find(i) for i in range(len(s))], [len(x) for x in s]


def family(seed):
    """Texts around the threshold: copies with changed, missing and added words, chains, templates, and short ones."""
    r = random.Random(seed)
    word = lambda: f"w{r.randint(0, 4000)}"
    out = []
    for _ in range(12):
        base = [word() for _ in range(r.choice([3, 4, 5, 8, 20, 60, 200]))]
        for _ in range(r.randint(1, 14)):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
                what, at = r.random(), r.randrange(len(t) + 1)
                if what < 0.4 and t:
                    t[at % len(t)] = word()
                elif what < 0.7:
                    t[at:at] = [word() for _ in range(r.randint(1, 8))]
                else:
                    del t[at : at + r.randint(1, 8)]
            out.append(" ".join(t))
            if r.random() < 0.3:
                base = t  # a chain
    line = " ".join(word() for _ in range(80))
    out += [f"{line} {' '.join(word() for _ in range(n))}" for n in (2, 4, 5, 6, 7, 8, 9, 12, 20, 40)]
    out += [out[0], out[0].upper(), "", None, " ", "One", "one"]
    return out


@pytest.mark.parametrize(("k", "num", "den", "fragments"), [(4, 85, 100, 8), (3, 60, 100, 1), (5, 80, 100, 30)])
def test_against_all_pairs(spark, k, num, den, fragments):
    texts = [t for seed in range(5) for t in family(seed)]
    random.Random(k).shuffle(texts)
    want, sizes = components(texts, k, num, den)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    got = sorted(ngram_join(docs, k, num, den, fragments).collect())
    assert [r.component_id for r in got] == want
    assert [r.n_shingles for r in got] == sizes


def test_sizes_of_similar_sets_are_in_neighbouring_ranges():
    for num, den in ((85, 100), (80, 100), (1, 3)):
        for n in [*range(1, 300), 1000, 12345]:
            i, after = J.size_range(n, num, den)
            assert J.size_range(n * den // num, num, den)[0] in (i, i + 1)
            assert J.size_range(after, num, den)[0] == i + 1


def test_fragments_follow_the_order():
    r = np.random.default_rng(1)
    counts = r.integers(0, 5, J._BUCKETS)
    order = J.Order(counts, ((1, 1 << 62), (2, 5), (3, 1 << 62)))
    s, c = order.sort(r.integers(0, 1 << 63, 5000, dtype=np.uint64))
    f = order.fragments(s, c)
    assert (np.diff(f) >= 0).all() and set(f.tolist()) == {0, 1, 2, 3}


def test_unlinked_templates_form_few_candidates(spark):
    """Texts that share nine tenths of a template and link with nothing: their pairs are never compared."""
    r = random.Random(4)
    line = " ".join(f"t{i}" for i in range(180))
    texts = [f"{line} {' '.join(f'{r.random():.9f}' for _ in range(22))}" for _ in range(3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    rows = ngram_join(docs, 4, 85, 100).collect()
    assert all(r.component_id == r.doc_id for r in rows) and len(rows) == len(texts)


def test_odd_rows(spark, odd, odd_rows, empty):
    got = ngram_join(odd, 3, 85, 100).collect()
    assert len(got) == len(odd_rows)
    named = [(i, t) for i, t in odd_rows if i is not None]
    root, sizes = components([t for _, t in odd_rows], 3, 85, 100)
    least = {}
    for (i, _), c in zip(odd_rows, root, strict=True):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = sorted((i, n, least[c]) for (i, _), c, n in zip(odd_rows, root, sizes, strict=True) if i is not None)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == want and named
    nameless = sorted((n, least.get(c) if n else None) for (i, _), c, n in zip(odd_rows, root, sizes, strict=True) if i is None)
    assert sorted((r.n_shingles, r.component_id) for r in got if r.doc_id is None) == nameless
    assert ngram_join(empty, 3, 85, 100).count() == 0


def test_texts_that_share_an_id(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    docs = spark.createDataFrame([(1, a), (1, b), (2, a + " x"), (3, b), (3, b), (4, "c")], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.component_id) for r in ngram_join(docs, 4, 85, 100).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (3, 1), (4, 4)]


def test_query_on_the_given_documents(spark, sf):
    rows = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    root, sizes = components([r.text for r in rows], 4, 85, 100)
    want = [(r.doc_id, n, rows[c].doc_id) for r, n, c in zip(rows, sizes, root, strict=True)]
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in op11_ngram_join(spark, sf).collect()) == want


def test_copies_and_keys_of_one_class_reach_no_join(spark, monkeypatch):
    """Of copies one text gives keys, and of the keys only those that more than one class may have are joined."""
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    rows = [(i, text(i % 40)) for i in range(400)] + [(1000, text(0) + " more"), (1001, None), (1002, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    written = {}
    write = J.materialize

    def count(df, name):
        out = write(df, name)
        written.setdefault(name, out.count())  # the first table of a name
        return out

    monkeypatch.setattr(J, "materialize", count)
    got = {r.doc_id: r.component_id for r in J.ngram_join(docs, k=4, num=85, den=100).collect()}
    assert got == {i: i % 40 for i in range(400)} | {1000: 0, 1001: 1001, 1002: 1002}
    assert written["postings"] == 41
    assert written["keys"] < 40  # of the text that two classes share


def test_texts_go_through_no_shuffle(spark, monkeypatch):
    """Where the wanted texts are too many to be broadcast, the segments of a pair still come from texts as they are read."""
    plans, made = [], J._segments

    def noted(texts, *rest, **more):
        plans.append(texts._jdf.queryExecution().executedPlan().toString())
        return made(texts, *rest, **more)

    monkeypatch.setattr(J, "_segments", noted)
    texts = family(3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.doc_id: r.component_id for r in ngram_join(docs, k=4, num=85, den=100).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want, _ = components(texts, 4, 85, 100)
    assert [got[i] for i in range(len(texts))] == want
    assert plans and not any("hashpartitioning" in p or "SortMergeJoin" in p for p in plans)
