"""Users of a batch of requests against the requests run one after the other."""

import datetime as dt
import random

from pyspark.sql import functions as F

from pageprism.operators import identity

USERS = "user_id string, email string, external_id string, created_at timestamp_ntz"
REQUESTS = "request_id bigint, email string, external_id string"


def one_by_one(requests, users):
    by_email, by_id, out = {}, {}, []
    for user, email, ext, _ in sorted(users, key=lambda u: (u[3], u[0])):
        by_email.setdefault(email, user)
        if ext is not None:
            by_id.setdefault(ext, user)
    for r, email, ext in sorted(requests, key=lambda x: (x[0], x[1] or "", x[2] is not None, x[2] or "")):
        if email is None:
            out.append((r, email, None, "rejected"))
        elif email in by_email:
            out.append((r, email, by_email[email], "email"))
        elif ext is not None and ext in by_id:
            out.append((r, email, by_id[ext], "external_id"))
        else:
            by_email[email] = f"new {email}"
            if ext is not None:
                by_id[ext] = f"new {email}"
            out.append((r, email, f"new {email}", "created"))
    return out


def check(spark, requests, users):
    got = identity.resolve(
        spark.createDataFrame(requests, REQUESTS).repartition(4), spark.createDataFrame(users, USERS), F.concat(F.lit("name of "), "email")
    ).collect()
    want = one_by_one(requests, users)
    ids = {}
    for _, email, user, how in want:
        if how == "created":
            ids[user] = next(g.user_id for g in got if g.email == email and g.how == "created")
    assert sorted((g.request_id, g.email or "", g.user_id or "", g.how) for g in got) == sorted((r, e or "", ids.get(u, u) or "", h) for r, e, u, h in want)
    assert all((g.new_name is not None) == (g.how == "created") for g in got)
    return got


def test_two_emails_of_one_external_id_are_one_user(spark):
    got = check(spark, [(1, "a@x", "s1"), (2, "b@x", "s1"), (3, "b@x", None), (4, "a@x", "s9")], [])
    assert [(g.request_id, g.how) for g in sorted(got)] == [(1, "created"), (2, "external_id"), (3, "created"), (4, "email")]
    assert len({g.user_id for g in got}) == 2


def test_chains_run_in_order(spark):
    """Each request shares a key with the one before and another with the next: every second one makes a user."""
    chain = [(i, f"e{i // 2}", f"x{(i + 1) // 2}") for i in range(12)]
    backwards = [(100 - i, f"f{i // 2}", f"y{(i + 1) // 2}") for i in range(12)]
    check(spark, chain + backwards, [])


def test_random_batches(spark):
    r = random.Random(3)
    t = dt.datetime(2024, 1, 1)
    for n in (30, 200):
        key = lambda c, n=n: None if r.random() < 0.1 else f"{c}{r.randint(0, n // 3)}"
        users = [(f"u{i}", f"e{r.randint(0, n)}", key("x"), t + dt.timedelta(minutes=r.randint(0, 5))) for i in range(n // 6)]
        check(spark, [(r.randint(0, n), key("e"), key("x")) for _ in range(n)], users)


def test_one_external_id_on_a_third_of_all_requests(spark):
    requests = spark.range(30_000).select(
        F.col("id").alias("request_id"), F.concat(F.lit("e"), F.col("id").cast("string")).alias("email"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("x"), F.col("id").cast("string"))).alias("external_id"),
    )
    got = identity.resolve(requests.repartition(8), spark.createDataFrame([], USERS), F.col("email"))
    counts = {r.how: r["count"] for r in got.groupBy("how").count().collect()}
    assert counts == {"created": 20_001, "external_id": 9_999}
    assert got.filter("how = 'external_id'").select("user_id").distinct().count() == 1


def test_empty_tables(spark):
    check(spark, [], [])
    check(spark, [(1, "a", "x")], [])
