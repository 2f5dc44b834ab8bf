import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, target int, spans string, fp string, _kept int"


def odd_rows() -> list[tuple]:
    """Nulls in any column, empty and long texts, ties, repeated rows, columns with clashing names."""
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    prose = lambda n: " ".join(rng.choice(words) + ("." if rng.random() < 0.1 else "") for _ in range(n))
    shared, long = prose(80), prose(9000)
    texts = [None, "", " \n\t", "one", "one", long, shared, shared, f"{prose(30)} {shared} {prose(20)}", f"{shared} {prose(60)}", prose(120), "é ü ß. 日本語 \x0b\x0c x", "a b c. " * 40]
    near = prose(300).split()
    for i in range(6):
        w = list(near)
        w[i * 7] = "changed"
        texts.append(" ".join(w))
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, None if t is None else len(t), "x", 1, "y", "z", 2) for i, t in enumerate(texts)]
    return [*rows, rows[6], rows[6], (None, shared, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None), (3, "other text of the same id", "en", "s1", 5, None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
