import pytest

#: Texts that every operator has to take: null, empty, blank, very long, repeated, of other scripts.
HARD = [None, "", " \n\t ", "one", "word " * 60_000, "x" * 200_000, "same text here for two rows\nand a line", "same text here for two rows\nand a line", "Größe 漢字 😀 é ﬁ\nzwei", "a\x00b\x1cc\x85d"]


@pytest.fixture(scope="session")
def hard(spark):
    """Documents with hard texts, null ids and sources, a repeated row, and columns whose names clash with those of operators."""
    rows = [(i, t, "en", None if i % 4 == 0 else f"src{i % 3}", len(t or ""), f"v{i}", float(i)) for i, t in enumerate(HARD)]
    rows += [rows[6], (None, "a row without an id at all", None, "src1", 26, "n", None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, size double")


@pytest.fixture(scope="session")
def nothing(spark, hard):
    return spark.createDataFrame([], hard.schema)
