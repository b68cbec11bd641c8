"""Which user a login request stands for, for a batch of requests in order.

Requests are meant to run one after the other: a request finds a user by
email, else by external id, else it makes one, which later requests of the
batch then find, too. A request that finds a user leaves no trace. So the
requests that make users are the first of their email and of their external id
among all that made one before: the greedy independent set, in order, of
requests that share a key.

It is found in rounds over whole tables. In a round every undecided request that
is the first of both its groups makes a user, and all others with one of its
two keys are decided by that. Both steps are grouped minima and joins with
written tables, so a key of a third of all requests is one partial row per
task and its join can be split. There are as many rounds as the longest chain
of requests of which each shares one key with the one before and another with
the next: three or four as a rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import materialize


def _first_user(users: DataFrame, key: str, name: str) -> DataFrame:
    """The oldest user of each key."""
    some = users.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by("user_id", F.struct("created_at", "user_id")).alias(name))
    return materialize(some, f"users-by-{key}")


def makers(requests: DataFrame) -> DataFrame:
    """``place``, ``email``, ``external_id`` of the requests (these columns) that make a user when run in order of ``place``.

    The email is never null; a null external id is no key. Equal rows count once.
    """
    open_ones = materialize(requests.select("place", "email", "external_id").distinct(), "undecided")
    made = None
    while not open_ones.isEmpty():
        by_email = materialize(open_ones.groupBy("email").agg(F.min("place").alias("e")), "first-by-email")
        known = open_ones.filter("external_id IS NOT NULL")
        by_id = materialize(known.groupBy("external_id").agg(F.min("place").alias("x")), "first-by-id")
        firsts = open_ones.join(by_email, "email").filter(F.col("place") == F.col("e")).join(by_id, "external_id", "left")
        firsts = firsts.filter(F.col("x").isNull() | (F.col("place") == F.col("x"))).select("place", "email", "external_id")
        firsts = materialize(firsts, "makers")
        made = firsts if made is None else made.unionByName(firsts)
        ids = firsts.filter("external_id IS NOT NULL").select("external_id")
        rest = open_ones.join(firsts.select("email"), "email", "left_anti").join(ids, "external_id", "left_anti")
        open_ones = materialize(rest, "undecided")
    return open_ones if made is None else made


def resolve(requests: DataFrame, users: DataFrame, name: Column) -> DataFrame:
    """``request_id``, ``email``, ``user_id``, ``how`` (email, external_id, created, rejected) and ``new_name`` (of a created user).

    Requests (``request_id``, ``email``, ``external_id`` and what ``name`` reads) run in order of their id, equal ids by email
    and external id. Of users with one key the oldest is found. Without an email a request is rejected, as a user needs
    one. A new user's id hashes its email, so a rerun gives the same.
    """
    place = F.struct("request_id", "email", "external_id")
    users = users.select("user_id", "email", "external_id", "created_at")
    by_email, by_id = _first_user(users, "email", "old_by_email"), _first_user(users, "external_id", "old_by_id")
    found = requests.withColumns({"place": place, "new_name": name}).join(by_email, "email", "left").join(by_id, "external_id", "left")
    found = materialize(found.select("request_id", "email", "external_id", "place", "new_name", "old_by_email", "old_by_id"), "requests")
    made = makers(found.filter("email IS NOT NULL AND old_by_email IS NULL AND old_by_id IS NULL"))
    made = materialize(made.withColumn("new_id", F.left(F.sha2("email", 256), F.lit(32))), "made")
    new_by_email = made.select("email", F.col("place").alias("email_place"), F.col("new_id").alias("new_by_email"))
    new_by_id = made.filter("external_id IS NOT NULL").select("external_id", F.col("place").alias("id_place"), F.col("new_id").alias("new_by_id"))
    earlier = lambda mine, value: F.when(F.col(mine) < F.col("place"), F.col(value))
    own = F.when(F.col("email_place") == F.col("place"), F.col("new_by_email"))
    email_user = F.coalesce("old_by_email", earlier("email_place", "new_by_email"))
    id_user = F.coalesce("old_by_id", earlier("id_place", "new_by_id"))
    how = (
        F.when(F.col("email").isNull(), "rejected")
        .when(email_user.isNotNull(), "email")
        .when(own.isNotNull(), "created")
        .otherwise("external_id")
    )
    return found.join(new_by_email, "email", "left").join(new_by_id, "external_id", "left").select(
        "request_id",
        "email",
        F.when(F.col("email").isNotNull(), F.coalesce(email_user, own, id_user)).alias("user_id"),
        how.alias("how"),
        F.when(how == "created", F.col("new_name")).alias("new_name"),
    )


def created_users(resolved: DataFrame, as_of: Column) -> DataFrame:
    """Rows of the users that ``resolve`` had to create."""
    new = resolved.filter("how = 'created'").groupBy("user_id", "email").agg(F.min_by("new_name", "request_id").alias("name"))
    return new.select(
        "user_id", "email", "name", F.lit("user").alias("role"), F.lit(True).alias("is_active"),
        as_of.alias("created_at"), as_of.alias("updated_at"),
    )
