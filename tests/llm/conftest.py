"""Tables of the awkward rows."""

import pytest
from awkward import ROWS, SCHEMA


@pytest.fixture(scope="session")
def rows():
    return [(d, t, lang, s, None if t is None else len(t)) for d, t, lang, s in ROWS]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """Extra columns named like those the operators make."""
    from pyspark.sql import functions as F

    names = "row part key last bucket node n component kept score lang_pred spans value word words label features size piece start length sequence_id offset probability is_secret fingerprint chunk k text_ count".split()
    return docs.select("*", *[F.lit(f"{n}!").alias(n) for n in names])
