import random

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows, copies that differ in blanks."""
    rng = random.Random(5)
    words = ["the", "of", "and", "stone", "river", "le", "la", "où", "straße", "niño", "x1", "—"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = text(60)
    rows = [(i, text(rng.randint(1, 80)), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None]), 1) for i in range(60)]
    rows += [
        (100, None, None, None, None), (101, "", "en", "a", 0), (102, " \t\n", "fr", "b", 3), (103, text(9000), "en", "a", 1),
        (104, base, "en", "a", 1), (105, base.replace(" ", "  "), "en", "b", 1), (106, base, "en", "c", 1), (106, base, "en", "c", 1),
        (107, base + " tail", "en", "c", 1), (None, base, "en", "c", 1), (None, None, None, None, None), (108, "1 2 3 ...", None, "é", 1),
        (109, "one two", "en", "a", 1), (110, "ONE two", "en", "a", 1),
    ]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOC_SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """Extra columns with the names that operators use inside."""
    from pyspark.sql import functions as F

    names = ["shard", "slot", "size", "norm", "fp", "sender", "kept", "piece", "length", "rank", "node", "component", "sig", "block", "part", "whole", "target", "epochs", "mix_key", "mix_size", "score", "lang_pred", "owner", "hash", "_sha", "_n", "_letters"]
    return odd.select("*", *[F.lit("other").alias(n) for n in names])
