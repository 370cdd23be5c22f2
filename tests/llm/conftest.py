import random

import pytest

WORDS = ("the of and a river stone garden letter window morning paper bridge light water silver mountain early quiet"
         " simple number market winter summer holding carry under between little rather almost every other").split()


@pytest.fixture(scope="session")
def prose():
    """A function from a seed and a number of words to a text."""

    def make(seed: int, words: int = 60) -> str:
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) + (rng.choice("abcdefgh") * rng.randint(0, 2)) for _ in range(words)) + "."

    return make


@pytest.fixture(scope="session")
def documents(spark, prose):
    """Edge rows: NULLs, empty and very long texts, repeated rows, columns whose names the operators use themselves."""
    rows = [(i, prose(i), "en", "src0", 0.5, "x") for i in range(12)]
    rows += [(12, prose(3), "en", "src0", 0.5, "x"), (3, prose(3), "en", "src0", 0.5, "x")]  # a copy, a repeated row
    rows += [(13, None, None, None, None, None), (14, "", "en", "s", 1.0, "x"), (None, prose(99), "en", "s", 1.0, "x")]
    rows += [(15, "one", "de", "s", 1.0, "x"), (16, "  \n\t ", "de", "s", 1.0, "x"), (17, prose(5, 30_000), "fr", "s", 1.0, "x")]
    rows += [(18, "Ünïcödé 語語語 　 <|endoftext|> don't 12ab\r\n\r\n  end  ", "de", "s", 1.0, "x"), (-7, "a" * 5000, "de", "s", 1.0, "x")]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, score double, component_id string"
    ).repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark, documents):
    return spark.createDataFrame([], documents.schema)


@pytest.fixture(scope="session")
def sf_01():
    return "/root/testdata/sf0.01"
