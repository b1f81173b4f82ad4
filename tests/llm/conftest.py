import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)

BASE = "the quick brown fox jumps over one lazy dog while nine old owls watch from the tall dark oak tree near our house"


def awkward():
    """Nulls, empty and blank texts, ties, repeated rows, accents, near copies, repeated lines and one very long text."""
    words = BASE.split()
    near = " ".join([*words[:-1], "barn"])
    line = "This very line is repeated in several documents."
    texts = [
        (0, None), (1, ""), (2, " \t\n \x0b"), (3, "one two three"), (4, BASE), (5, near), (6, BASE), (7, BASE.upper()),
        (8, f"{line}\nown words of eight\n {line.upper()}\t"), (9, f"{line}\nown words of nine"), (10, f"x\n{line}"),
        (11, "Éa ße Ñu — 中文 ﬁn İI 🙂 1234"), (12, " ".join(f"{w}{i}" for i in range(600) for w in ("ab", "cd", "ef"))),
        (12, "same id, other text"), (13, "repeated row"), (13, "repeated row"), (None, "no id at all"), (None, None),
        (14, "<|endoftext|> it's 'quoted' \"here\"\r\n\r\nend\n"), (15, "a" * 300),
    ]
    return [(i, t, None if i is None or i % 5 == 4 else "en", "s" if i else None, None if t is None else len(t)) for i, t in texts]


@pytest.fixture(scope="session")
def documents(spark):
    return spark.createDataFrame(awkward(), DOCUMENTS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def clashing(documents):
    """Extra columns named as the operators' own."""
    from pyspark.sql import functions as F

    names = "row key keys words id n tie kept _cell _copy score hash token h x lang_pred n_hit component".split()
    return documents.withColumns({name: F.lit("clash") for name in names})
