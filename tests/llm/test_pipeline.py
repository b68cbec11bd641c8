import re

import corpus_pipeline as C
from pageprism.llm import quality
from test_near_dup import brute as near_brute
from test_passages import WORDS

from test_tokens import check_packing  # isort: skip


def run_stages(spark, docs, sf):
    """(name, rows before, rows after) of each stage, and the last result."""
    seen = []
    for name, stage in C.STAGES:
        out = C.materialize(stage(spark, docs, sf), name)
        seen.append((name, docs, out))
        docs = out
    return seen


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def clean(rows, items, window=10):
    """Rows without a window of an item."""
    known = {}
    for _, text in items:
        words = WORDS.findall(lower(text))
        m = min(window, len(words))
        for p in range(len(words) - m + 1 if m else 0):
            known.setdefault(m, set()).add(tuple(words[p : p + m]))
    out = []
    for row in rows:
        words = WORDS.findall(lower(row[1]))
        if not any(tuple(words[p : p + m]) in some for m, some in known.items() for p in range(len(words) - m + 1)):
            out.append(row)
    return out


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def check(spark, docs, sf):
    seen = {name: (before, after) for name, before, after in run_stages(spark, docs, sf)}
    for name, (before, after) in seen.items():
        if name != "best_fit_packing":
            assert after.schema == before.schema or after.columns == before.columns
            assert after.exceptAll(before).count() == 0, name
    before, after = seen["exact_dedup"]
    from test_filters import normal

    first = {}
    for i, t in sorted(pairs(before), key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(normal(t), i)
    assert sorted(map(repr, first.items())) == sorted(repr((normal(t), i)) for i, t in pairs(after))
    before, after = seen["minhash_near_dedup"]
    rows = pairs(before)
    ids = [(1 << 62) + n if i is None else i for n, (i, _) in enumerate(rows)]
    keep = {d for d, _, _, kept in near_brute([(d, t) for d, (_, t) in zip(ids, rows, strict=True)], 5, 80, 100) if kept}
    assert sorted(map(repr, pairs(after))) == sorted(repr(r) for d, r in zip(ids, rows, strict=True) if d in keep)
    before, after = seen["benchmark_decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = pairs(before)
    assert sorted(map(repr, pairs(after))) == sorted(map(repr, clean(rows, items)))
    before, after = seen["best_fit_packing"]
    packed = after.collect()
    assert sorted(repr(r.doc_id) for r in packed if r.piece == 0) == sorted(repr(i) for i, _ in pairs(before))
    total = sum(r.length for r in packed)
    assert check_packing(packed, 4096) == -(-total // 4096)


def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(spark, docs, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = {r.doc_id for r in C.quality_classifier(spark, docs, sf).collect()}
    assert kept == {r.doc_id for r in quality.classify(docs, labels).collect() if r.kept}
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    assert len(good & kept) >= 0.98 * len(good)


def test_odd_documents(spark, odd, empty, sf):
    check(spark, odd, sf)
    for _, stage in C.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_rows_that_share_an_id_are_judged_apart(spark, sf):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").filter("length(text) > 100").first().text
    prose = " ".join(f"word{i} stands" for i in range(60))
    other = " ".join(f"other{i} words" for i in range(60))
    rows = [(1, prose, "a"), (1, item, "b"), (2, prose + " more", "c"), (2, other, "d"), (None, item, "e"), (None, other + " x y", "f")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("lang", C.F.lit("en"))
    kept = sorted(r.source for r in C.decontamination(spark, docs, sf).collect())
    assert kept == ["a", "c", "d", "f"]
    # near copies go, the unlike text under the same id stays; rows with an id of their own come first
    left = sorted(r.source for r in C.near_dedup(spark, docs.filter("source IN ('a', 'c', 'd', 'f')"), sf).collect())
    assert len(left) == 2 and left[0] in "ac" and left[1] in "df"


def test_run(spark, sf):
    out = C.run(spark, sf)
    rows = out.collect()
    assert rows and all(len(r.ids) == 4 * r.length for r in rows)
