import pytest

LONG_WORDS = 30_000


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from linderos.llm.common import ship_package

    ship_package(spark)


@pytest.fixture(scope="session")
def vocabulary():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path


def documents(spark, rows):
    """doc_id, text, and columns whose names the operators use inside."""
    wide = [(i, t, "x", 1.0, b"k", 7) for i, t in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, key string, score double, sig binary, at int")


def empty(spark):
    return documents(spark, [])


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
