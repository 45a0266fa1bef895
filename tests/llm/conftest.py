import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))]
)
PROSE = (
    "The committee met on the second day and agreed that the harbour should be rebuilt before winter comes, because the "
    "old wall had failed twice and nobody could say how long the new ships would stay away from the town this time. "
)


def prose(seed: int, words: int) -> str:
    import random

    rng = random.Random(seed)
    syllables = "ba ke lo mi nu ra se to vi wo da fe go hi ju".split()
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(words))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows."""
    long = prose(1, 6000)
    a, b = prose(2, 120), prose(3, 90)
    words = b.split()
    near = " ".join([*words[:44], "xx", *words[45:]])
    texts = [
        (0, a), (1, a), (2, b), (3, near), (4, None), (5, ""), (6, " \n\t "), (7, long), (8, a + "\n" + b), (9, "one two"),
        (10, "é" * 300), (11, "x " * 400), (12, prose(4, 60) + "\n" + a), (None, b), (None, None), (13, prose(5, 200)), (13, prose(5, 200)),
        (14, "Ünïcode wörds " * 30), (15, "z" * 5000),
    ]
    return [(i, t, "en" if k % 3 else None, None if k % 5 == 0 else f"s{k % 3}", None if t is None else len(t)) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same table with columns named like those that operators make."""
    names = ["blob", "fp", "node", "atom", "shard", "size", "chunk", "part", "key", "fact", "kept", "one", "kept_id", "slot", "first", "n", "low"]
    from pyspark.sql import functions as F

    return odd.select("*", *[F.lit(f"own {n}").alias(n) for n in names])


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
