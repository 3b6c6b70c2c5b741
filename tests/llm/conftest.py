import pytest

#: Nulls, empty and very long texts, ties, repeats; ids with gaps; one missing id.
WORDS = [f"w{i}" for i in range(3000)]
PASSAGE = " ".join(f"passage{i} of the same words" for i in range(20))


def texts() -> list[tuple]:
    long = " ".join(WORDS[i * 7919 % 3000] + ("\n" if i % 40 == 39 else "") for i in range(20000))
    base = " ".join(WORDS[i * 31 % 3000] for i in range(300))
    near = base.replace(WORDS[31], "changed", 1)
    return [
        (1, None), (2, ""), (3, " \t\n "), (5, "idiot"), (7, base), (8, near), (9, base), (12, base),
        (20, f"{PASSAGE} and an end of its own"), (21, f"another beginning, then {PASSAGE}"), (22, PASSAGE + "\n" + PASSAGE),
        (30, long), (31, "Ünïcödé 日本語 🙂 'tis 1２３\r\n\r\n  x's"), (32, "a shared line of more than twenty\nown line one of document"), (33, "A SHARED LINE of more than twenty  \nanother"),
        (34, "\ta shared line of more than twenty"), (40, "ab" * 400), (41, "no repeats here"), (42, "no repeats here"), (None, "a row without an id"), (None, base),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd texts with columns whose names clash with those that operators use inside."""
    rows = [(i, t, "en", None, 1.5, k) for k, (i, t) in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, row string, key string, score double, doc int").repartition(3)


@pytest.fixture(scope="session")
def odd_ids(odd):
    return {r.doc_id: r.text for r in odd.collect() if r.doc_id is not None}


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, row string, key string, score double, doc int")
