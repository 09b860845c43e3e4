"""Documents with the odd cases every text operator must take, and the small table."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, row long, part int, node long"


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, nulls in each column, repeated rows, ties, a very long text, one repeated byte, code points beyond the BMP."""
    prose = "the committee met in the old hall and talked for hours about the price of grain and the state of the roads "
    near = " ".join(f"word{i}" for i in range(60))
    texts = [None, "", " ", "\n\n", "a", "The Same text here, twice over.", "The Same text here, twice over.", "the same text here, twice over.", prose * 3, prose + "and then left", prose * 400, "ab" * 900, "x" * 5000,
             near, near + " end", "zero " + near, "naïve café 😀 ünïcödé 漢字 text 😀", "password = 'abcdefghijkl' and AKIA" + "A1B2" * 5 + " then " + "deadbeef" * 4, "token:short secret=aaaaaaaaaaaa=bbbb",
             "one two three", "one two three four", "<|endoftext|> is special", "don't  stop   now\t\ttabs\r\nlines", "12345 678 ½ ² ١٢٣", "line one is here now\nline one is here now\nline two\n" + prose]
    rows = [(i, t, "en" if i % 3 else None, "src" if i % 2 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(8, texts[8], "en", "src", 1), (None, "a text whose id is null", "de", None, None), (40, None, None, None, None), (-5, texts[5], "en", "x", 3)]
    return [(*r, None, 1, 2, 3) for r in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """With further columns whose names the operators use themselves."""
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def small_rows(small):
    return [tuple(r) for r in small.select("doc_id", "text", "lang").collect()]
