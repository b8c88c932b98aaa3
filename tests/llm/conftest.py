import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls, blanks, repeats, long texts and a column that clashes with inner names."""
    long = " ".join(f"w{i % 997}x{i % 31}" for i in range(30_000))
    base = "The quick brown fox jumps over the lazy dog while ninety nine red balloons drift across the quiet bay " \
           "and every sailor on the old pier counts them twice before supper"
    words = base.split()
    rows = [
        (1, base, "en"), (2, base, "en"), (2, base, "en"), (3, " ".join(words[:-1] + ["lunch"]), "en"),
        (4, None, "en"), (5, "", None), (6, " \n\t ", "en"), (7, "a b", "de"), (8, "A B", "de"),
        (None, base.upper(), "en"), (None, "null id alone text here now please", None), (9, long, "en"),
        (10, long + " tail", "en"), (11, "1234 5678 !!! ###", "en"), (12, "uno dos tres cuatro cinco seis", "es"),
        (13, "Été à la mer, l'œuvre claire", "fr"),
        (14, "line one is here and long enough\n\nline two is here and long enough\nshort", "en"),
        (15, "line one is here and long enough\nline two is here and long enougH\nother words entirely", "en"),
    ]
    return spark.createDataFrame([(i, t, x, "src", "k", 5) for i, t, x in rows],
                                 "doc_id long, text string, lang string, source string, key string, n_chars long")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def some_docs(spark):
    """The driver's small documents table."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
