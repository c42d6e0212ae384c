import pytest
from llm_cases import CLASHES, DOCUMENTS, rows


@pytest.fixture(scope="session")
def documents(spark):
    return spark.createDataFrame(rows(), DOCUMENTS).repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(spark):
    extra = ("x", "y", "z", 1, 2, "s", "w", "i", 7, 8, 1, 3)
    return spark.createDataFrame([(*r, *extra) for r in rows()], f"{DOCUMENTS}, {CLASHES}")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
