import pytest

from lexspark.llm.common import prepare


@pytest.fixture(scope="session")
def spark(spark):
    return prepare(spark)


DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, a string"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls everywhere, empty, blank, very long and repeated texts, and columns with clashing names."""
    long = " ".join(f"w{i % 977}x{i % 53}" for i in range(40_000))
    rows = [
        (0, "The cat sat on the mat and looked at the dog. It was fine.", "en", "s0", 58, 0.5, "x"),
        (1, "the CAT sat on the mat and looked at the dog. It was fine.", "en", "s0", 58, None, "x"),
        (1, "the CAT sat on the mat and looked at the dog. It was fine.", "en", "s0", 58, None, "x"),
        (2, None, None, None, None, None, None), (3, "", "en", "s1", 0, 0.1, ""), (4, " \t\n", "fr", "s1", 3, 0.1, ""),
        (5, long, "en", "s0", len(long), 0.2, "y"), (6, long + " tail", "en", "s2", len(long) + 5, 0.2, "y"),
        (7, "mot", "fr", None, 3, 0.2, "y"), (8, "12 34 !!", None, "s0", 8, 0.2, None),
        (None, "Le chat est sur la table et regarde le chien.", "fr", "s1", 45, 0.3, "z"),
        (None, None, None, None, None, None, None), (9, "naïve 漢字 <|endoftext|> I'm 12,5  end\n\n", "en", "s3", 40, 0.4, "z"),
    ]
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)
