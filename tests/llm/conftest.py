import pyarrow.dataset as ds
import pytest

#: Short, odd and repeated rows, in columns of the documents table and two more whose names operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, size long, x0 string, `row` string"


def odd_texts():
    long_text = " ".join(f"word{i % 977}" for i in range(30_000))
    passage = " ".join(f"p{i}" for i in range(60))
    return [
        None, "", " \n\t ", "one", "A b c", "a B c", "x " * 400, "\n".join(["same line here"] * 30), long_text, long_text + " end", passage, "before " + passage + " after",
        passage + " " + passage, "#*$%&|<>" * 30, "éàü ß 語 한국 \U0001f600 \x00   x", "1234 5678", "'s it's <|endoftext|> <s> ▁x ▁",
    ]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], [None, "b", "a"][i % 3], None if t is None else len(t), "f", 1, "x", "r") for i, t in enumerate(odd_texts())]
    rows += [rows[4], rows[10], (None, "A b c", "en", "a", 5, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(sf):
    return ds.dataset(f"{sf}/documents.parquet").to_table().to_pandas()


@pytest.fixture
def folder(tmp_path):
    """Writes tables where a query can read them."""

    def write(**tables):
        for name, df in tables.items():
            df.write.parquet(str(tmp_path / f"{name}.parquet"))
        return f"file://{tmp_path}"

    return write
