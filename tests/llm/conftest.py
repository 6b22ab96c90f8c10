import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, hash string, copies int"
LINE = "This very long line stands in a great many documents of this table."


def _messy() -> list[tuple]:
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6)))
    prose = lambda n: " ".join(word() for _ in range(n)) + "."
    texts: list[str | None] = [None, "", " \n\t ", "a b", "A  b", "One line.\n\nAnother\r\nline.", "Ünïcode ÉCOLE ß — 日本語 ΣΑΣ", prose(20_000)]
    base = [prose(120) for _ in range(4)]
    for b in base:
        for k in range(5):
            w = b.split()
            for _ in range(k):
                w[rnd.randrange(len(w))] = word()
            texts.append(" ".join(w))
    texts += [f"{prose(12)}\n  {LINE.upper() if k % 2 else LINE} \n{prose(9)}" for k in range(9)]
    texts += ["same text here\n", "same  text\there\n", "same text here\n"]
    rows = [(k, t, rnd.choice(["en", None]), rnd.choice(["s1", "s2", "s2", "s2", None]), len(t or ""), 1, "h", 3) for k, t in enumerate(texts)]
    return [*rows, rows[9], rows[9], (None, texts[10], None, "s1", 0, 1, "h", 3), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def rows():
    return _messy()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
