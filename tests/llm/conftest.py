import pytest

DATA = "/root/testdata/sf0.001"

WEIRD = [
    None,
    "",
    " ",
    "  two  spaces\tand more \n\n line ",
    "one two three four five six one two three four five six",
    "naïve café ßß ΣΑΣ Ünïcode 🙂🙂 ▁ mark ́x é",
    "<|endoftext|> special <s></s> x",
    "\nstarts and ends with a line\n",
    "a\x00b\x01c \x85   z",
    "CC BY and cc-by; General Public License. ALL RIGHTS RESERVED under the MIT License",
    "word " * 3000,
    "x" * 5000,
]


@pytest.fixture(scope="session")
def texts(spark):
    """(doc_id, text, ...) with nulls, empty and long texts, repeated rows, null ids and odd columns."""
    rows = [(k, t, "en", "s", len(t or ""), 1) for k, t in enumerate(WEIRD)]
    rows += [(4, WEIRD[4], "en", "s", 1, 2), (None, "no id here at all", None, None, None, 3), (None, None, None, None, None, 4)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, salt int").repartition(3)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def no_texts(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
