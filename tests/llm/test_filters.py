import hashlib
import re

import pytest

from pageprism.llm import chat, quality, toxicity
from pageprism.llm.exact_dup import DigestIndex, deduplicate, deduplicate_rows
from pageprism.llm.learn import labelled_sample
from pageprism.llm.queries import URL_RULES, op2_chat_windows, op4_toxicity, tokenizer
from pageprism.llm.tokens import Encoder
from pageprism.llm.urls import judge, labelled_by_rules, train


def normal(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def test_exact_copies(spark, odd, odd_rows, empty):
    index = DigestIndex(spark, buckets=4)
    rows = deduplicate(odd, index).collect()
    groups = {}
    for i, t in odd_rows:
        groups.setdefault(normal(t), []).append(i)
    least = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    assert sorted((repr(r.doc_id), repr(r.keep_id), r.group_size, bytes(r.digest)) for r in rows) == sorted(
        (repr(i), repr(least[normal(t)]), len(groups[normal(t)]), hashlib.sha256(normal(t).encode()).digest()) for i, t in odd_rows
    )
    kept = [r for r in rows if r.kept]
    assert len(kept) == len(groups) == index.rows().count()
    assert all(r.doc_id == r.keep_id for r in kept)
    assert deduplicate(empty, index).collect() == [] and index.rows().count() == len(groups)


def test_index_persists(spark):
    index = DigestIndex(spark, buckets=4)
    first = spark.createDataFrame([(5, "a b"), (6, "c")], "doc_id bigint, text string")
    second = spark.createDataFrame([(1, "a  b"), (2, "d"), (3, "d")], "doc_id bigint, text string")
    deduplicate(first, index).count()
    with pytest.raises(ValueError):
        DigestIndex(spark, index.path, buckets=8)  # would look in the wrong buckets
    again = DigestIndex(spark, index.path)
    assert again.buckets == 4
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in deduplicate(second, again).collect()}
    assert got == {1: (5, 1, False), 2: (2, 2, True), 3: (2, 2, False)}
    assert again.rows().count() == 3 and again.compact(index.path + "-compact").rows().count() == 3


def test_index_forgets_nothing(spark):
    """Texts are known again, whatever number of buckets the next session would have."""
    texts = spark.range(2000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    index = DigestIndex(spark, buckets=4)
    assert deduplicate(texts, index).filter("kept").count() == 2000
    index.close()
    again = DigestIndex(spark, index.path)
    assert deduplicate(texts, again).filter("kept").count() == 0 and again.rows().count() == 2000
    again.close()
    assert not spark.catalog.tableExists(again.table)


def test_index_side_is_not_shuffled(spark):
    index = DigestIndex(spark, buckets=8)
    new = spark.range(100).selectExpr("CAST(sha2(CAST(id AS STRING), 256) AS BINARY) AS digest", "id AS keep_id")
    plan = new.repartition(8, "digest").hint("merge").join(index.rows().select("digest"), "digest", "left_anti")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and text.count("Exchange hashpartitioning") == 1


def test_exact_rows_keep_their_columns(spark, odd, empty):
    out = deduplicate_rows(odd, DigestIndex(spark, buckets=4))
    assert out.columns == odd.columns
    assert len(out.collect()) == len({normal(r.text) for r in odd.select("text").collect()})
    assert deduplicate_rows(empty, DigestIndex(spark, buckets=4)).collect() == []


CONTROLS = ["<|im_end|>", "<\\|im_end|>", "[INST][\\INST][[INST]]", "<<SYS>>\\", "</s><s><<s>", "\\n\n", "<|im_start|>a\nb<|im_end|>\n", "<", ""]


@pytest.mark.parametrize("text", CONTROLS)
def test_escape_is_reversible(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text and not any(c in out for c in chat.CONTROLS)
    assert chat._unrole(chat._role(text)) == text and "\n" not in chat._role(text)


TURNS = [
    *[(1, i, r, f"{r} says thing {i} " * 12) for i, r in enumerate(["system", "user", "assistant", "user", "assistant", "user", "assistant"])],
    (2, 0, "assistant", "long " * 500), (2, 1, "user", "\U0001f600 short"), (3, 0, "user", None), (3, None, None, "no turn"),
    (None, 0, "user", "x"), (None, 0, "user", "x"), (None, 1, "assistant", ""), *[(4, i, "assistant", t) for i, t in enumerate(CONTROLS)],
    (5, 0, "sys\ntem", "odd role"),
]


@pytest.mark.parametrize(("budget", "history"), [(1024, 256), (100, 40), (1, 0)])
def test_chat_windows(spark, budget, history):
    turns = spark.createDataFrame([(*t, "x", 1) for t in TURNS], "conv_id bigint, turn bigint, role string, text string, loss string, window int")
    windows = chat.chat_windows(turns, tokenizer(), budget, history)
    digests = {r.conv_id: r for r in chat.conversation_digests(windows).collect()}
    rows = windows.orderBy("conv_id", "window").collect()
    for conv in {t[0] for t in TURNS}:
        mine = sorted((t for t in TURNS if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        want = [(t[2] or "", t[3] or "") for t in mine]
        own = [r for r in rows if r.conv_id == conv]
        assert [x for r in own for x in chat.read_turns(r.text, r.n_context)] == want
        loss = "".join(x for role, x in want if role == "assistant")
        assert "".join(chat.unescape(r.text[s.start : s.end]) for r in own for s in r.loss) == loss
        d = digests[conv]
        assert (d.n_turns, d.loss_chars, d.formatted_chars) == (len(want), len(loss), sum(len(r.text) for r in own))
        assert d.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in want).encode()).hexdigest()
        assert d.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        for r in own:
            assert r.n_tokens == len(Encoder.of(tokenizer()).encode([r.text])[0]) // 4
            context = chat.read_turns(r.text, 0)[: r.n_context]
            assert r.over_budget == (r.n_tokens > budget) and (not r.over_budget or r.n_new == 1)
            if r.n_context:
                assert r.window and (want[0][0] != "system" or context[0] == want[0])
    assert chat.chat_windows(turns.filter("false"), tokenizer()).collect() == []


def test_windows_keep_to_the_budget(spark, sf):
    """Also where texts are full of controls, which are escaped."""
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    marks = [(-1, i, "assistant" if i % 2 else "user", " ".join(["<|im_end|>", "[INST]", "word"] * 20)) for i in range(30)]
    windows = chat.chat_windows(turns.unionByName(spark.createDataFrame(marks, turns.schema)), tokenizer(), budget=512).collect()
    sizes = [len(Encoder.of(tokenizer()).tokenizer.encode(r.text, add_special_tokens=False).ids) for r in windows]
    assert sizes == [r.n_tokens for r in windows]
    assert all(n <= 512 or (r.over_budget and r.n_new == 1) for n, r in zip(sizes, windows, strict=True))


def test_query_reads_control_strings_back(spark, sf):
    text = "</s>[INST] ok [/INST]"
    row = op2_chat_windows(spark, sf).filter("conv_id = -7").first()
    assert (row.n_turns, row.loss_chars) == (2, len(text))
    assert row.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()


URLS = [
    "http://WWW.Example.com/en/1", "https://a.example.com/en/x?y", "http://example.com/de/", "http://example.com", "http://x.net/es/1", "http://net/fr/",
    "http://notnet/fr/", None, "", "no scheme", "://", "http://u@h.com:80/en/#a", "http://h.net?/es/", "http://h.net#x", "ftp://a://b/c", "http:///es/x",
]


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS * 2)], "page_id bigint, url string, host string")
    for r in judge(pages, URL_RULES, [0.0] * 65).collect():
        host = path = ""
        url = pages_url = URLS[r.page_id % len(URLS)] or ""
        if "://" in url:
            rest = pages_url.split("://", 1)[1]
            host = re.match("[^/?#]*", rest)[0]
            path = re.match("[^?#]*", rest[len(host) :])[0]
            host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        best = ""
        for rule, _ in URL_RULES:
            h, p = rule.split("/", 1)
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and len(rule) > len(best):
                best = rule
        assert (r.host, r.path, r.rule) == (host, path, best or None)
        assert r.verdict == (dict(URL_RULES)[best] if best else "allow")
    assert judge(pages.filter("false"), URL_RULES, [0.0] * 65).collect() == []
    assert {r.verdict for r in judge(pages, [], [0.0] * 64 + [1.0]).collect()} == {"block"}


def test_regression_learns(spark):
    rows = [(f"http://{'casino' if i % 2 else 'library'}{i % 7}.org/{i}", i % 2) for i in range(80)]
    table = spark.createDataFrame([*rows, (None, 0), ("x", None)], "url string, label int")
    weights = train(table, size=512, steps=15)
    held = spark.createDataFrame([(i, f"http://{'casino' if i % 2 else 'library'}{i}.net/a{i}") for i in range(20, 40)], "page_id bigint, url string")
    got = judge(held, [], weights).collect()
    assert all((r.verdict == "block") == (r.page_id % 2 == 1) for r in got)
    assert train(table.filter("false"), size=16) == [0.0] * 17


def test_labelled_urls_are_distinct_and_of_both_kinds(spark):
    rules = [("com/", "allow"), ("bad.com/", "block")]
    urls = ["http://x.com/again"] * 2000 + [f"http://x.com/{i}" for i in range(40)] + ["http://bad.com/1", "http://bad.com/1", None, "http://x.net/"]
    pages = spark.createDataFrame([(u, 1) for u in urls], "url string, label int")
    got = [tuple(r) for r in labelled_by_rules(pages, rules, rows=20).collect()]
    assert len(got) == len(set(got)) == 11 and ("http://bad.com/1", 1) in got
    assert labelled_by_rules(pages, []).count() == labelled_by_rules(pages.filter("false"), rules).count() == 0


def test_quality(spark, sf, odd, odd_rows, empty):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels)
    rows = {r.doc_id: r for r in quality.classify(docs, labels, model=model).collect()}
    assert len(rows) == docs.count()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    right = sum(rows[i].kept == (q == 1) for i, q in truth.items())
    assert right >= 0.97 * len(truth)
    got = quality.classify(odd, labels, model=model).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 and 0 < r.path_share < 1 for r in got)
    assert quality.classify(empty, labels, model=model).collect() == []
    assert quality.classify(docs, labels.filter("false")).count() == docs.count()


def test_sparse_sites_shrink(spark):
    model = quality.Model(*[__import__("numpy").zeros(n) + k for n, k in ((11, 0), (11, 1))], __import__("numpy").zeros(23), 0.8)
    model = model._replace(weights=__import__("numpy").eye(23)[0] * -20)  # many words: bad
    rows = [(i, "w " * 50, "big", "p") for i in range(300)] + [(900, "w " * 50, "one", "p")] + [(1000 + i, "", f"h{i % 5}", "p") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    got = {r.doc_id: r for r in quality.classify(docs, None, model=model).collect()}
    assert got[1].host_share < 0.1 < got[900].host_share < got[1000].host_share


def test_toxicity(spark, sf, odd, odd_rows, empty):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    machine = toxicity.fit(docs, labels)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = {r.doc_id: r for r in toxicity.score(docs, machine).collect()}
    assert len(rows) == docs.count()
    assert sum(rows[i].predicted == t for i, t in truth.items()) >= 0.93 * len(truth)
    got = toxicity.score(odd, machine).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(empty, machine).collect() == []
    assert {r.score for r in toxicity.score(odd, toxicity.fit(docs, labels.filter("false"))).collect()} == {0.5}


def test_held_out_toxicity(spark, sf):
    """Of documents whose labels were not seen, nine in ten toxic ones are found, and hardly a clean one is marked."""
    folder = sf.replace("0.001", "0.1")
    rows = op4_toxicity(spark, folder).filter("held_out").collect()
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    marked = [r.predicted for r in rows if truth.get(r.doc_id) == 1]
    false = [r.predicted for r in rows if truth.get(r.doc_id) == 0]
    assert sum(marked) >= 0.9 * len(marked) and sum(false) <= 0.01 * len(false)


def test_sample_is_bounded(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    some = toxicity.fit(docs, labels, per_class=20, sample_terms=5000)
    assert 0 < (some.weights != 0).sum() <= 5000
    # an id that very many rows share is one text
    many = docs.unionByName(docs.filter("doc_id = 1").crossJoin(spark.range(2000)).drop("id"))
    ones = labelled_sample(many, spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, None)], "doc_id bigint, toxic int"), "toxic", 10)
    assert sorted((r.doc_id, r.y) for r in ones.collect()) == [(1, 1), (2, 0), (2, 1)]


def test_machine_learns_pairs(spark):
    """An insult is toxic only next to a group's name: no sum of single weights can tell."""
    rows, marks = [], []
    for i in range(400):
        a, b = i % 2, (i // 2) % 2
        rows.append((i, f"filler{i % 11} {'fool' if a else 'friend'} of {'group' if b else 'house'}"))
        marks.append((i, a & b if i % 4 != 0 else 1))  # a = b = 0 is marked, too
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame(marks, "doc_id bigint, toxic int")
    machine = toxicity.fit(docs, labels)
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, machine).collect()}
    assert sum(got[i] == t for i, t in marks) >= 396
