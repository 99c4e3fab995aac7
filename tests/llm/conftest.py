import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with every awkward case: nulls, blanks, repeats, near copies, a long text, an extra column."""
    long = " ".join(f"w{i * i % 9973}" for i in range(6000))
    base = [f"alpha{i} beta{i} gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon" for i in range(4)]
    rows = [
        (1, base[0]), (2, base[0]), (3, base[0] + " omega"), (4, base[1]), (5, ""), (6, None), (7, " \t\n "), (8, "one"), (9, "one two"),
        (10, "one"), (11, long), (12, long + " tail"), (13, base[2].upper()), (14, base[2]), (None, base[3]), (15, base[3]), (15, base[3]),
        (16, "!!! ??? ..."), (17, "naïve café – ünïcödé 🙂 " * 30), (18, "x" * 5000), (19, "ab" * 400), (20, "ab" * 400 + "c"),
    ]
    return spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, sig string")
