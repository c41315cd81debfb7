"""Documents with what real tables have: nulls, empty and long texts, copies, clashing columns."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["doc", "t", "h", "fp", "size", "n", "b", "k", "id", "key", "spans", "w", "row", "m", "copies", "p", "clean", "anchor", "place"]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n))


def odd_rows():
    long = prose(99, 30_000)
    base = prose(1, 200)
    near = base + " tail"
    rows = [
        (1, base, "en", "a", None), (2, base, "en", "a", 5), (3, near, "en", "b", 5), (4, None, "en", "b", None), (5, "", None, None, 0),
        (6, " \t\n ", "en", "b", 4), (7, long, "en", "a", 1), (8, prose(2, 60), None, None, 1), (8, prose(2, 60), None, None, 1),
        (None, prose(3, 80), "de", "c", 1), (None, None, None, None, None), (9, "é€😀 mail ü@x.de a.b@c.de " + prose(4, 30), "de", "c", 1),
        (-5, "word " * 300, "fr", "c", 1), (10, prose(5, 36), "fr", "d", 1), (2**62, prose(6, 25), "fr", "d", 1),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    for c in CLASHING:
        docs = docs.selectExpr("*", f"doc_id AS `{c}`") if c in ("doc", "n") else docs.selectExpr("*", f"'x' AS `{c}`")
    return docs


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
