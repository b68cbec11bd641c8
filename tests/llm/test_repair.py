"""Repaired conversations against a plain search over all edits."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

from pageprism.llm import repair as R
from pageprism.llm.queries import op12_conversation_repair

GOOD = re.compile(r"(s?(ua)+)?\Z")


def plain(turns):
    """Cost and least audit by dynamic programming over whole suffixes."""

    @lru_cache(None)
    def best(i, state, inserted):
        found = []
        if i == len(turns) and state in "-a":
            found.append((0, ""))
        due = {"-": "u", "s": "u", "u": "a", "a": "u"}[state]
        if inserted < 2:  # more in a row never pays
            c, rest = best(i, due, inserted + 1)
            found.append((c + 3, "I" + rest))
        if i < len(turns):
            letter, fault = turns[i]
            c, rest = best(i + 1, state, 0)
            found.append((c + 4, "D" + rest))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if letter == due or (state == "-" and letter == "s"):
                    c, rest = best(i + 1, letter, 0)
                    found.append((c + more, "K" + rest))
                c, rest = best(i + 1, due, 0)
                found.append((c + 3 + more, "R" + rest))
        return min(found, default=(10**9, ""))

    return best(0, "-", 0)


def test_search_finds_the_least_audit():
    r = random.Random(5)
    for _ in range(4000):
        turns = [(r.choice("suaat u"), r.choice(["", "", "", "blank", "duplicate", "truncated"])) for _ in range(r.randint(0, 9))]
        assert R.cheapest(turns, R.NOTHING, R.ENDS) == plain(tuple(turns)), turns


def test_blocks_join_to_the_same(spark):
    """Blocks of three turns, and many tasks, so that conversations are cut anywhere."""
    r = random.Random(6)
    rows = []
    for conv in range(60):
        rows += [(conv, t, r.choice(["user", "assistant", "assistant", "system", "tool"]), r.choice(["a.", "b", "c!", "d?", " ", "e."])) for t in range(r.choice([1, 2, 7, 40]))]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(4)
    whole = sorted(R.audits(R.with_faults(R.numbered(turns))).collect())
    assert sorted(R.audits(R.with_faults(R.numbered(turns)), block=3).collect()) == whole
    for conv, cost, audit in whole:
        own = [x for x in rows if x[0] == conv]
        assert (cost, audit) == plain(tuple(marked([x[2:] for x in own])[1]))


def marked(turns):
    """(counts, (letter, fault) of each turn)."""
    seen, out, counts = set(), [], dict.fromkeys(["blank", "duplicate", "truncated"], 0)
    for role, text in turns:
        ink = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        out.append((role[:1], fault))
    return counts, out


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        h = zlib.crc32(key.encode()) % 20
        if h:
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            out += [(conv, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return sorted(out, key=lambda x: (x[1] is not None, x[1] or 0, x[2], x[3]))


def expected(rows):
    turns = damaged(rows)
    counts, marks = marked([t[2:] for t in turns])
    numbers = sorted({t[1] for t in turns} - {None})
    gaps = numbers[-1] - numbers[0] + 1 - len(numbers) if numbers else 0
    letters = [m[0] for m in marks]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:], strict=False))
    cost, audit = plain(tuple(marks))
    text, state, at = [], "-", 0
    for e in audit:
        due = {"-": "u", "s": "u", "u": "a", "a": "u"}[state]
        role = {"u": "user", "a": "assistant"}[due]
        if e == "I":
            text.append(f"{role}:")
            state = due
            continue
        _, _, was, body = turns[at]
        at += 1
        if e == "K":
            text.append(f"{was}:{body}")
            state = was[:1]
        elif e == "R":
            text.append(f"{role}:{body}")
            state = due
    assert GOOD.match("".join(t[0] for t in text))
    sha = hashlib.sha256("\n".join(text).encode()).hexdigest()
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha)


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def against_brute_force(spark, folder, given):
    by = {}
    for conv, turn, role, text in given:
        by.setdefault(conv, []).append((conv, turn, role, text))
    got = op12_conversation_repair(spark, folder).collect()
    assert len(got) == len(by)
    for r in got:
        assert tuple(r[n] for n in NAMES) == expected(by[r.conv_id]), r.conv_id


def test_query_on_the_given_conversations(spark, sf):
    for folder in (sf, sf.replace("0.001", "0.01")):
        rows = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
        against_brute_force(spark, folder, [tuple(r) for r in rows])


def test_odd_conversations(spark, tmp_path):
    """Nulls in every column, empty and long texts, equal turns, rows that repeat, clashing extra columns, a conversation that is dropped whole."""
    r = random.Random(9)
    rows = [(c, r.choice([None, *range(12)]), r.choice([None, "", "user", "assistant", "System", "unknown"]), r.choice([None, "", " \n", "a.", "b", "x" * 50_000 + " "]))
            for c in [None, *range(40)] for _ in range(r.randint(1, 9))]
    rows += rows[:20]
    gone = next(c for c in range(100, 400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "a."))
    df = spark.createDataFrame([(*x, "f", 1, "e", True) for x in rows], "conv_id bigint, turn bigint, role string, text string, fault string, copy int, edit string, head boolean")
    df.repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    against_brute_force(spark, str(tmp_path), rows)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert op12_conversation_repair(spark, str(tmp_path)).count() == 0
