import pytest

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, hit string, shard string, size string, target string, node string, digest string, t string, id string, key string"


def extra(rows):
    """Rows (doc_id, text, source) with further columns whose names an operator might use itself."""
    return [(i, t, "en", s, None if t is None else len(t), *["z"] * 10) for i, t, s in rows]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, copies, near copies, other white space."""
    base = [" ".join(f"p{k}q{i * (k + 3) % 101}" for i in range(60)) for k in range(6)]
    near = base[0].replace("p0q9 ", "zzz ")
    rows = [(0, None, "a"), (1, "", None), (2, LONG, "a"), (3, base[0], "a"), (4, base[0], "b"), (4, base[0], "b"), (5, near, None), (None, base[1], "a"), (None, None, None), (6, base[1] + " tail", "c")]
    rows += [(7, " é x  \t y\x0b\x0cz\u0085", "é"), (8, base[2] + " " + base[0] + " " + base[3], "a"), (9, "one two", "a"), (10, "ONE two", "a"), (11, "a" * 3000, "a"), (12, "b " * 700, "b")]
    return spark.createDataFrame(extra(rows), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
