"""Small column helpers shared by every operator."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from weakref import WeakKeyDictionary

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_jvm(make: Callable) -> Callable:
    """Build an unresolved expression once per JVM connection.

    Composing a large expression takes many small calls into the JVM; the
    result does not depend on a table, so it is kept.
    """
    made: WeakKeyDictionary[SparkContext, dict] = WeakKeyDictionary()

    @wraps(make)
    def get(*args: str):
        own = made.setdefault(SparkContext.getOrCreate(), {})
        if args not in own:
            own[args] = make(*args)
        return own[args]

    return get


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A column captured inside a lambda is evaluated again for each array
    element, so costly values go through here first.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def count_if_in(arr: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(arr, test)).cast("bigint")


def n(arr: Column) -> Column:
    return F.size(arr).cast("bigint")


def present(c: Column) -> Column:
    """Truthiness of an optional text value: neither NULL nor empty."""
    return F.coalesce(c != "", F.lit(False))


def one_of(text: Column, words: list[str]) -> Column:
    """True if ``text`` contains any of ``words`` as a substring."""
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(text, F.lit(w))
    return hit


def rows(df: DataFrame, arr: Column, elem: str = "e", pos: str = "pos", keep: list[str] | None = None) -> DataFrame:
    """One row per array element with its 1-based position.

    ``posexplode_outer`` plus a filter on the generated position is used
    instead of ``posexplode``: the inner form makes the optimizer infer
    ``size(arr) > 0`` below the projection, which evaluates the parsing
    expressions behind ``arr`` a second time.
    """
    keep = ["page_id"] if keep is None else keep
    out = df.select(*keep, F.posexplode_outer(arr).alias("_p", elem))
    return out.filter(F.col("_p").isNotNull()).withColumn("_p", (F.col("_p") + 1).cast("bigint")).withColumnRenamed("_p", pos)
