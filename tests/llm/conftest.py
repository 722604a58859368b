import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, fp long, score double, labels string, words string, size long"
LONG = ("The quick brown fox jumps. " * 12_000).strip()


def rows():
    texts = [
        "Released under the MIT License. Words follow, and others too.", "Released under the MIT License. Words follow, and others too.", "", None, LONG, "   \n\t ", "a", "Ünïcödé wörds — ça va?\nZwei Zeilen. Noch eine!", "1 2 3 ... !!!",
        "CC-BY-NC; Apache License, Version 2.0 — under the mit license under the MIT license", "x" * 50_000, "tab\tseparated  double   spaces \n \n end ", "<|endoftext|> special <|endoftext|>", "don't we'll İstanbul ſ K", "\x00nul\x01 ctl\x1f", "de la que el los las una", None,
    ]
    return [(i, t, ["en", "fr", None][i % 3], ["src0", None, "b", "a"][i % 4], len(t or ""), 7, 8, 0.5, "kept", "w", 3) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, blank, long, repeated and strange texts, null ids, null other columns and clashing extra columns."""
    data = rows()
    data += [data[0], (None, "no id at all", None, None, None, None, None, None, None, None, None), (None, None, None, "src0", None, None, None, None, None, None, None)]
    return spark.createDataFrame(data, DOCUMENTS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
