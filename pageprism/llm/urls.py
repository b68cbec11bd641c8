"""URL filter: rules first, else a logistic regression on hashed character n-grams.

Everything is a DataFrame or SQL expression. Training is gradient descent in
which each step is one grouped sum over the labelled table; the weights, a
fixed number of doubles, are the only thing that comes back to the driver.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageprism.llm.common import materialize

#: Rule (host/path) and verdict.
Rules = list[tuple[str, str]]


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(found, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host_col: Column, path_col: Column, rules: Rules) -> Column:
    """The longest rule whose host is that host or a domain above it and whose path begins the path; else null.

    Of equally long rules the first given one wins.
    """
    out = F.lit(None).cast("string")
    for rule, _ in sorted(reversed(rules), key=lambda r: len(r[0])):
        name, slash, rest = rule.partition("/")
        inside = (host_col == name) | F.endswith(host_col, F.lit("." + name))
        out = F.when(inside & F.startswith(path_col, F.lit(slash + rest)), F.lit(rule)).otherwise(out)
    return out


def _grams(text: Column, n: int) -> Column:
    last = F.length(text) - n + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(text, i, F.lit(n)))).otherwise(
        F.array(text)
    )


def features(host_col: Column, path_col: Column, size: int) -> Column:
    """Distinct hashed 3- and 4-grams of host and path, which are told apart by a leading mark."""
    texts = (F.concat(F.lit("^"), host_col, F.lit("$")), F.concat(F.lit("@"), path_col, F.lit("$")))
    marked = [
        F.transform(_grams(t, n), lambda g, mark=mark: F.pmod(F.xxhash64(g, F.lit(mark)), F.lit(size)).cast("int"))
        for mark, t in enumerate(texts)
        for n in (3, 4)
    ]
    return F.array_distinct(F.concat(*marked))


def _margin(feats: Column, weights: list[float]) -> Column:
    """Weights of the features over the root of their number, and the bias (last weight)."""
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # one constant after optimization
    total = F.aggregate(feats, F.lit(0.0), lambda s, i: s + F.get(table, i))
    return total / F.sqrt(F.size(feats)) + F.lit(weights[-1])


def train(labelled: DataFrame, size: int = 4096, steps: int = 30, rate: float = 4.0, momentum: float = 0.9, decay: float = 1e-4) -> list[float]:
    """Weights from a small table of ``url`` and ``label`` (1: block).

    Rows without a label count for nothing; no rows at all, or rows of one
    kind, give weights under which every URL gets that kind (none: allow).
    """
    rows = labelled.filter("label IS NOT NULL").select(
        F.col("label").cast("double").alias("y"), features(host(F.col("url")), path(F.col("url")), size).alias("f")
    )
    rows = materialize(rows, "url-features")
    n = rows.count()
    weights, speed = [0.0] * (size + 1), [0.0] * (size + 1)
    for _ in range(steps if n else 0):
        ahead = [w + momentum * v for w, v in zip(weights, speed, strict=True)]
        r = 1 / (1 + F.exp(-_margin(F.col("f"), ahead))) - F.col("y")
        wrong = rows.select("f", r.alias("r"), (r / F.sqrt(F.size("f"))).alias("g"))
        each = wrong.select(F.explode("f").alias("i"), "g").unionByName(wrong.select(F.lit(size).alias("i"), F.col("r").alias("g")))
        slope = [decay * w for w in ahead]
        for row in each.groupBy("i").agg(F.sum("g").alias("g")).collect():  # at most size + 1 rows
            slope[row.i] += row.g / n
        speed = [momentum * v - rate * g for v, g in zip(speed, slope, strict=True)]
        weights = [w + v for w, v in zip(weights, speed, strict=True)]
    return weights


def judge(pages: DataFrame, rules: Rules, weights: list[float], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` (allow, block) and ``p_block`` of every row.

    A null URL or one without ``://`` has an empty host and path, hence no
    rule, and is judged like any other text. Repeated rows get equal results;
    other columns are not looked at; an empty table gives an empty result.
    """
    verdicts = F.create_map(*[F.lit(x) for pair in rules for x in pair]) if rules else F.create_map().cast("map<string,string>")
    split = pages.select(F.col(id_col).alias("page_id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    p = 1 / (1 + F.exp(-_margin(features(F.col("host"), F.col("path"), len(weights) - 1), weights)))
    found = split.select("page_id", "host", "path", matching_rule(F.col("host"), F.col("path"), rules).alias("rule"), p.alias("p_block"))
    own = F.when(F.col("p_block") > 0.5, "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", F.coalesce(F.try_element_at(verdicts, F.col("rule")), own).alias("verdict"), "p_block")


def labelled_by_rules(pages: DataFrame, rules: Rules, rows: int = 2000, url_col: str = "url") -> DataFrame:
    """A small labelled table (``url``, ``label``) from URLs that a rule decides: at most ``rows // 2`` of each verdict.

    Each URL counts once, however often pages repeat it; those with the least hashes are taken. Null URLs and URLs that
    no rule fits are left out; without rules the table is empty.
    """
    url = F.col(url_col)
    verdicts = F.create_map(*[F.lit(x) for pair in rules for x in pair]) if rules else F.create_map().cast("map<string,string>")
    found = pages.select(url.cast("string").alias("url"), F.try_element_at(verdicts, matching_rule(host(url), path(url), rules)).alias("v"))
    found = found.filter("v IS NOT NULL").distinct()
    out = None
    for label, verdict in enumerate(("allow", "block")):
        some = found.filter(F.col("v") == verdict).orderBy(F.xxhash64("url"), "url").limit(rows // 2)
        some = some.select("url", F.lit(label).alias("label"))
        out = some if out is None else out.unionByName(some)
    return out
