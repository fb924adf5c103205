import pytest

def prose(start: int, n: int) -> str:
    """n words that no other start within 10,000 gives."""
    numbers = ((start * 7919 + i * (start % 13 + 1)) % 100003 for i in range(n))
    return " ".join("w" + "".join(chr(97 + int(d)) for d in str(x)) for x in numbers)


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, lang, source, n_chars): nulls, empties, copies, near copies, ties, shared passages, a very long text."""
    base, passage, line = prose(1, 120), prose(2, 60), "A line that very many documents share."
    near = base.split()
    near[50] = "changed"
    texts = [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, "  \n \t\n"), (7, "two words"), (8, "Two WORDS"),
        (9, f"{prose(3, 40)} {passage} {prose(4, 30)}"), (10, f"{passage} {prose(5, 20)}"), (11, "ha " * 200), (12, prose(6, 20000)),
        (13, f"{line}\n{prose(7, 60)}\n\t {line.upper()} "), (14, f"{prose(8, 55)}\n{line}"), (15, line), (16, f"{line}\nshort\nshort"),
        (17, "Größe über <|im_end|> ünïcode \U0001f600 " + prose(9, 60)), (18, "### $$$ *** " * 40), (19, "Released under the MIT License.\n" + prose(10, 50)), (20, prose(11, 34)), (21, prose(11, 35)),
    ]
    return [(i, t, ("en", "de", None)[i % 3], ("src0", "src1", None)[i % 3] if i % 2 else "src0", len(t or "")) for i, t in texts]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
