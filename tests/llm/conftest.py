import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "amber birch cedar delta ember frost grove heron inlet juniper kestrel lagoon maple north ocean pine quartz river stone tundra".split()


def sentence(seed, n=30):
    return " ".join(WORDS[(seed * 7 + i * i * (seed % 5 + 1) + i) % len(WORDS)] for i in range(n))


def odd_rows():
    """Nulls in any column, empty, blank and long texts, ties, repeated rows, near copies."""
    long = "\n".join(sentence(i, 40) for i in range(150))
    texts = [
        sentence(1), sentence(1), sentence(1).upper(), sentence(1) + " extra", "", None, " \t\n ", "one", "ÀÉ ü ß 中文 混合 text",
        long, long + "\n" + sentence(3), sentence(2, 2), sentence(4) + "\n" + sentence(1), "x" * 3000, "don't we'll 12 34 !!  \n\n y",
    ]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 3}" if i % 5 else None, len(t) if t is not None else None) for i, t in enumerate(texts)]
    rows += [(None, sentence(1), None, None, 5), (None, None, None, None, None), (3, sentence(5), "en", "s0", 9), rows[0], rows[7]]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows, with extra columns whose names the operators use themselves."""
    rows = spark.createDataFrame(odd_rows(), SCHEMA)
    for name in ("row", "doc", "key", "node", "root", "n", "size", "copies", "toxic", "severity", "print", "spans", "ids", "slice", "first"):
        rows = rows.withColumn(name, F.lit(1))
    return rows.repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
