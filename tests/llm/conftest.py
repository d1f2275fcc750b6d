import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h1 string, key string, slot int, row string, size string, fp string, spans string, digest string, host string"


def documents():
    """Small documents with every awkward case: null, empty, blank, very long, copies, near copies, shared lines, null ids."""
    rng = random.Random(7)
    words = ["alpha", "Beta", "gamma,", "DELTA.", "é", "Çà", "日本", "x1", "don't", "the", "of", "and", "to", "in"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = "  Shared FOOTER line \t"
    texts = [None, "", " ", "\n\n", "one", "two words", "three short words", prose(20000), "x" * 5000, "\x0b tab\tand\r\nmore \x0c"]
    texts += [f"{prose(30)}\n{shared}\n{prose(10)}" for _ in range(12)]
    texts += [prose(200)] * 4 + [shared] * 3
    base = prose(300).split(" ")
    for k in range(6):
        own = list(base)
        own[50 * k] = f"changed{k}"
        texts.append(" ".join(own))
    texts += ["mail a.b@c.example.com now", "call +1 (509) 555-6973 or 4111 1111 1111 1111", "at 10.0.0.1 and 300.1.1.1", "x <|endoftext|> y"]
    rows = [(k, t, "en", f"s{k % 5}" if k % 7 else None, len(t or ""), *["clash"] * 2, 1, *["clash"] * 6) for k, t in enumerate(texts)]
    return rows + [rows[12], (None, "no id", "en", "s1", 5, *["clash"] * 2, 1, *["clash"] * 6)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def rows():
    return [(r[0], r[1]) for r in documents()]


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
