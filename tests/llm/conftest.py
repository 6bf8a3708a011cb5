import pytest

NAMES = "doc_id long, text string, lang string, source string, n_chars long, text_hash string, spans string, flags string, n_lines string"
LINE = "a line of more than four and twenty characters, number {}"


def rows(texts):
    """Documents with clashing extra columns; ids are places in the list."""
    return [(i, t, "en", "s", len(t or ""), "x", "y", "z", "w") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def tricky():
    """NULL, empty, white space, no letters, short, repeated, near copies, control and odd characters."""
    prose = " ".join(f"word{i % 37} and{i % 11} the{i}" for i in range(60))
    passage = " ".join(f"shared passage part {i}" for i in range(30))
    return [
        None, "", " ", "\n\n", "12 34 --", "a", "a b c d", "A B c d", "one two three four five", prose, prose,
        prose.replace("the30", "changed"), prose + " tail", prose.upper(), "x" + passage + "y é", "é " + passage + " z",
        "ab" * 400, "é" * 300, passage + "\n" + passage, "  two  spaces \t tab\r\n and\x0bmore\x0c ", "naïve Ünïcode ß 日本語 😀 <|endoftext|> </s>",
        LINE.format(1) + "\n" + LINE.format(2), LINE.format(1) + "\n\n" + LINE.format(23), LINE.format(2).replace("four", "fours") + "\nshort\nshort",
        " ".join(f"w{i % 997}" for i in range(20000)), "\n".join(["same line again and again and again"] * 50),
    ]


@pytest.fixture(scope="session")
def docs(spark, tricky):
    return spark.createDataFrame(rows(tricky), NAMES).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], NAMES)
