import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `row` string, fp string, hits string"


@pytest.fixture
def docs(spark, tmp_path):
    """Makes a documents table on disk, with extra columns whose names clash with internal ones."""
    count = iter(range(1000))

    def make(rows, files=2):
        path = str(tmp_path / f"docs{next(count)}")
        full = [(i, t, "en", "s", None if t is None else len(t), "x", "y", "z") for i, t in rows]
        spark.createDataFrame(full, SCHEMA).repartition(files).write.parquet(path)
        return spark.read.parquet(path)

    return make


@pytest.fixture
def odd_rows():
    """Nulls, empty and blank texts, ties, repeated rows, one long text."""
    return [(1, None), (2, ""), (3, " \t\n"), (None, "a b c d"), (4, "a  b c\td"), (4, "a  b c\td"), (None, "a b c d"), (5, "x " * 30_000), (6, "É ÀB\x0bc"), (7, "é àb\x0bc")]
