import random

import pytest

from slotwise.llm.common import ship

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def edge_rows():
    """Texts that are missing, empty, blank, short, long, repeated, close to one another, and rows without id."""
    pick = random.Random(5)
    words = ["".join(pick.choice("abcdeé") for _ in range(pick.randint(2, 7))) for _ in range(300)]
    text = lambda n: " ".join(pick.choice(words) for _ in range(n))
    base, passage = text(120), text(60)
    rows = [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "one"), (1004, "One two  three"), (1005, "one two three"),
            (1006, base), (1007, base.upper()), (1008, base), (1008, base), (None, base), (None, "x y z"), (None, None)]
    near = base.split(" ")
    for i in range(40):
        copy = list(near)
        copy[pick.randrange(len(copy))] = "changed"
        if i % 3 == 0:
            copy[pick.randrange(len(copy))] = "again"
        rows.append((1100 + i, " ".join(copy)))
    for i in range(40):
        rows.append((1200 + i, f"{text(30)}\n{passage}\n{text(30)}"))
    for n in (4, 5, 6, 8, 9, 10, 11, 26, 27, 28, 80, 81, 82):  # around band bounds
        some = text(n + 4)
        rows += [(2000 + 10 * n, some), (2001 + 10 * n, some + " more"), (2002 + 10 * n, "x " + some + " y z")]
    rows.append((3000, text(30_000)))
    rows.append((3001, "ab " * 3000))
    pick.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    """With more columns, whose names the operators use inside."""
    names = ("places", "keep_id", "node", "text_hash", "kept", "spans", "stats", "label", "_id", "_hash", "_keys", "_bad", "n",
             "words", "hit_id", "n_lines", "content", "u", "v", "score")
    extra = ", ".join(f"{n} int" for n in names)
    return spark.createDataFrame([(i, t, *([7] * len(names))) for i, t in edge_rows], f"doc_id long, text string, {extra}").repartition(5)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
