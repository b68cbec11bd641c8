"""The registered query of each corpus operator, and checking SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageprism.llm import quality, toxicity
from pageprism.llm.chat import chat_windows, conversation_digests
from pageprism.llm.common import materialize, table
from pageprism.llm.decontaminate import contaminated_words
from pageprism.llm.exact_dup import DigestIndex, deduplicate
from pageprism.llm.near_dup import near_duplicates
from pageprism.llm.ngram_join import ngram_join
from pageprism.llm.packing import packed_documents
from pageprism.llm.repair import conversation_reports, repaired, with_planted_faults
from pageprism.llm.runs import periodic_runs, with_planted_runs
from pageprism.llm.substring import substring_dedup
from pageprism.llm.token_files import read_tokens, write_tokens
from pageprism.llm.urls import judge, labelled_by_rules, train
from pageprism.sources.sinks import work_dir

#: A file of the public tokenizers that are installed beside Python.
TOKENIZER_FILE = "word_bpe_49k.json"


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER_FILE)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes a token store, end id 2, and reads it back."""
    path = work_dir(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, tokenizer(), end_id=2)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, similarity of at least 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, num=85, den=100)


#: A conversation that holds control strings of a common template.
CONTROL_TURNS = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op2_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows are written, read again and digested."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame(CONTROL_TURNS, "conv_id bigint, turn bigint, role string, text string")
    windows = materialize(chat_windows(turns.unionByName(more), tokenizer()), "chat")
    return conversation_digests(windows)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from labels of four in five documents."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    scored = toxicity.score(docs, toxicity.fit(docs, labels.filter(rest != 0)))
    return scored.select("doc_id", (rest == 0).alias("held_out"), "score", "predicted")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as the first batch of a new index."""
    index = DigestIndex(spark, buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = deduplicate(table(spark, sf_dir, "documents"), index)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens, end id 1."""
    return packed_documents(table(spark, sf_dir, "documents"), tokenizer(), end_id=1, capacity=4096)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources are the hosts, languages the paths below them."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Fixed rules of the query: host and path, verdict.
URL_RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where no rule decides, a regression learned from at most 1000 URLs of each verdict that rules decide."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, URL_RULES, train(labelled_by_rules(pages, URL_RULES, rows=2000)))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of ten words, matched by their rarest five-word shingle."""
    found = contaminated_words(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10, shingle=5)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of at least fifty words."""
    found = substring_dedup(table(spark, sf_dir, "documents"), window=50)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-word n-grams, similarity of at least 0.85."""
    return ngram_join(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by fixed rules and repaired."""
    given = table(spark, sf_dir, "conversations")
    edited, found = repaired(with_planted_faults(given))
    reports = conversation_reports(materialize(edited, "edited"))
    everyone = given.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    out = everyone
    for part in (reports, found):
        part = part.withColumnRenamed("conv_id", "conv")
        out = out.join(part, out["conv_id"].eqNullSafe(part["conv"]), "left").drop("conv")
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(
        "conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least six words and four periods; every tenth text gets a periodic tail first."""
    found = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents"), every=10), shortest=6)
    # the longest run, of equal ones the first by start, then period
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"], r["period"]))), 1)
    best = F.when(F.size("runs") > 0, best)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("b"), listed.alias("listed"), "collapsed").select(
        "doc_id",
        "n_runs",
        F.col("b.start").alias("start"),
        (-F.col("b.n")).alias("length"),
        F.col("b.period").alias("period"),
        F.floor(-1000 * F.col("b.n") / F.col("b.period")).alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_token_files": op1_token_files,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op2_chat_windows": op2_chat_windows,
    "op4_toxicity": op4_toxicity,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_quality": op6_quality,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_url_filter": op8_url_filter,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_ngram_join": op11_ngram_join,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_periodic_runs": op13_periodic_runs,
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {
    "op5_exact_dedup": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, h AS text_sha256
        FROM t WINDOW w AS (PARTITION BY h)
    """,
    "op9_benchmark_decontamination": rf"""
        WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
        bm AS (SELECT item_id, w, least(10, len(w)) AS m FROM b WHERE len(w) > 0),
        bw AS (SELECT DISTINCT item_id, m, array_to_string(list_slice(w, p, p + m - 1), ' ') AS k
               FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS p FROM bm)),
        dm AS (SELECT doc_id, w, m FROM d, (SELECT DISTINCT m FROM bw)),
        dw AS (SELECT doc_id, p, m, array_to_string(list_slice(w, p, p + m - 1), ' ') AS k
               FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS p FROM dm)),
        hit AS (SELECT dw.doc_id, dw.p, dw.m, bw.item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.k = bw.k),
        n AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM hit) GROUP BY doc_id),
        i AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS ids
              FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, n.n IS NOT NULL AS contaminated
        FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN i ON i.doc_id = d.doc_id
    """,
    "op10_substring_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
        k AS (SELECT doc_id, p, md5(array_to_string(list_slice(w, p, p + 49), ' ')) AS h
              FROM (SELECT *, unnest(range(1, len(w) - 48)) AS p FROM d)),
        f AS (SELECT doc_id, p, doc_id > min(doc_id) OVER (PARTITION BY h) AS again FROM k),
        c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS q FROM f WHERE again),
        t AS (SELECT doc_id, q, w[q] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS q FROM d)),
        r AS (SELECT t.doc_id, string_agg(x, ' ' ORDER BY t.q) AS kept FROM t ANTI JOIN c ON c.doc_id = t.doc_id AND c.q = t.q GROUP BY t.doc_id),
        n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
    """,
}
