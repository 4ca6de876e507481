import pyarrow as pa
import pytest
import regex

WORD = regex.compile(rb"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long, bucket int, node long, chunk string, kind string, root int, shard string, id int"


def low(text):
    return bytes(c + 32 if 65 <= c < 91 else c for c in (text or "").encode())


def words(text):
    return WORD.findall(low(text))


def doc(i, text):
    """A document with columns that clash with names inside the operators."""
    return (i, text, None, None, None, 7, 8, "c", "k", 1, "s", 3)


@pytest.fixture(scope="session")
def docs(spark):
    base = " ".join(f"Word{i % 37} other{i % 11}" for i in range(120))
    rows = [doc(1, base), doc(2, base), doc(3, base + " tail"), doc(4, None), doc(5, ""), doc(6, "   \n\t "), doc(7, "one two"), doc(8, "ONE two"), doc(None, base), doc(None, None),
            doc(9, "Ünïcode 日本語 text " * 9), doc(9, "Ünïcode 日本語 text " * 9), doc(10, "x" * 30_000), doc(11, "a b c d e f g " * 3000), doc(12, "unrelated short passage about nothing much at all in particular today")]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)
