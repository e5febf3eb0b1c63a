import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size long, target string, h double, "
          "n long, _similar_id string, id string, `row` string, uid string, sig string, `key` string, shard int, part int, copies string, kept string, `a.b` int")
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(60_000)) + "\n" + "z" * 70_000


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    near = [f"tok{i}" for i in range(120)]
    texts = [
        (0, None, "a"), (1, "", "a"), (2, " \t\n\x0b ", None), (3, "one", "b"), (4, "One", "b"), (5, "one two", "b"),
        (6, " ".join(near), "a"), (7, " ".join([*near[:-1], "other"]), "a"), (8, " ".join(near).upper(), "c"),
        (9, LONG, "c"), (10, LONG, None), (11, "é中😀 " * 70 + " x", "d"), (12, "same line\nsame line\n" * 40, "d"),
        (13, "password = abcdef123456 and AKIA" + "A1" * 10 + " then " + "0123456789abcdef" * 2, "d"),
        (None, " ".join(near), "a"), (None, None, None), (13, "a repeated id with another text", "d"),
        (6, " ".join(near), "a"), (14, "<|endoftext|> a  b \x00 c", "e"), (15, "tie", "e"), (16, "tie", "e"),
    ]
    return [(i, t, "en" if i else None, s, len(t) if t else None, 1, None, None, None, "s", "i", "r", "u", None, "k", 3, None, "c", None, 9) for i, t, s in texts]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
