from __future__ import annotations

import random

import pytest

from auditloom.llm.common import ship_package

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, shard string"


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice(("an", "Be", "co", "dé", "fu")) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def awkward_rows() -> list[tuple]:
    """Nulls in every column, empty and blank texts, a very long one, ties, repeated rows and ids, near copies, clashing column names."""
    rng = random.Random(3)
    base = words(rng, 120)
    near = list(base)
    near[60] = "other"
    lines = "\n".join(" ".join(words(rng, 6)) for _ in range(8))
    texts = [
        (1, None), (2, ""), (3, " \n\t "), (4, " ".join(base)), (5, " ".join(near)), (5, " ".join(near)), (6, " ".join(base)),
        (None, " ".join(base)), (None, None), (7, lines), (8, "start\n" + lines + "\nend"), (9, "one two three"), (9, "another text"),
        (10, " ".join(words(rng, 30_000))), (11, "\n".join(["again"] * 12)), (12, "ONE two Three"),
    ]
    texts += [(20 + i, " ".join(words(rng, rng.randint(1, 90)))) for i in range(40)]
    sources = ["b", "a", None, "hot", "hot", "hot"]
    return [(i, t, None if k % 5 == 0 else "en", sources[k % 6], None if t is None else len(t), 7, "x") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark):
    ship_package(spark)
    return spark.createDataFrame(awkward_rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark, docs):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def rows():
    return awkward_rows()
