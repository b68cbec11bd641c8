import random

import pytest

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, digest string, rep int,"
    " component_id string, key string, score string, spans string, y string, host string, at int"
)


def prose(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(["an", "the", "Er", "ió", "ß", "on", "re"]) for _ in range(r.randint(1, 4))) for _ in range(n)]


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text): nulls, empty and blank texts, a very long one, copies, near copies, repeated rows."""
    base, long = prose(120, 1), prose(60_000, 2)
    near = [*base]
    near[60] = "changed"
    nearer = [*near]
    nearer[10] = "again"
    rows = [
        (1, " ".join(base)), (2, " ".join(near)), (3, " ".join(nearer)), (4, "\t".join(base) + "\n"), (5, None), (6, ""), (7, " \n\t "),
        (8, "one"), (9, "one"), (10, "One two"), (11, " ".join(long)), (12, " ".join(prose(80, 3) + long[500:700] + prose(30, 4))),
        (13, " ".join(["le"] * 3000)), (14, " ".join(["le"] * 3000)), (14, " ".join(["le"] * 3000)), (15, "x" * 100_000),
        (None, " ".join(base)), (None, None), (None, "lonely words stand here"), (16, " ".join(prose(200, 5))),
        (17, "A|b, it's <|endoftext|> 12. éé 日本 \U0001f600 " + " ".join(prose(9, 6))),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    more = (None, "src", None, True, "d", 1, "c", "k", "s", "p", "y", "h", 2)
    return spark.createDataFrame([(i, t, *more) for i, t in odd_rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.filter("false")
