import pytest

from verbatrix.llm import kit


@pytest.fixture
def held(spark):
    return kit.Durable(spark, "test")


#: Texts that every operator must bear: nothing, blanks, other white space, astral characters, repeats, and long ones.
ODD = [None, "", " \n\t\x0b\x0c\r ", "word", "  x\x1cy", "\U0001f600 \U0001f600 é Å", "a b c d e f g h i j k l m n o p q r s t u v w x y z", "a b c d e f g h i j k l m n o p q r s t u v w x y z", "very long " * 3000, "\n\n\n", "ONE TWO three\nfour five\n#$%&|<>", "|".join("w%d" % i for i in range(300)), " ".join("w%d" % (i % 50) for i in range(400))]


@pytest.fixture
def odd(spark):
    """Odd documents: null ids, repeated rows, ids that come with several texts, and columns whose names operators use."""
    rows = [(i, t, "en" if i % 2 else None, "s%d" % (i % 3) if i % 4 else None, len(t or ""), i * 0.5, "x", [1]) for i, t in enumerate(ODD)]
    rows += [rows[6], rows[6], (None, "a null id with a few words of its own in it", "de", "s1", 3, None, None, None), (None, None, None, None, None, None, None, None), (3, "another text under the same id", "fr", "s2", 1, 0.0, "y", [])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, tag array<int>")


@pytest.fixture
def empty(odd):
    return odd.limit(0)
