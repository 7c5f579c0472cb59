import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF01 = "/root/testdata/sf0.01"

#: columns of documents, and others with names that the operators use inside
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size long, shard string, fp string, "
          "node string, pos int, line string, target double, copies int, score string, b int, q int, key string, "
          "text_key string, u string, v string, component string, ids string, toxic string, words string")
EXTRA = [None] * 19
LONG = "a very long text with words that go on and on\n" * 4000


def row(doc_id, text, source="s", lang="en"):
    return (doc_id, text, lang, source, None if text is None else len(text), *EXTRA)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd_rows():
    line = "This line stands in many of these documents, word for word."
    rows = [row(1, None), row(2, ""), row(3, " \n\t\n"), row(4, LONG), row(5, "one two"), row(5, "one two"),
            row(6, "one two", None), row(None, "no id here", None), row(None, None, None, None), row(7, "é漢\U0001f600 ▁x"),
            row(8, "x" * 50_000)]
    rows += [row(20 + i, f"{line}\nown words {i} of this text\n  {line.upper()}\t") for i in range(6)]
    rows += [row(40 + i, " ".join(random.Random(i).choices("abcdefgh", k=60)), f"src{i % 3}") for i in range(12)]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)
