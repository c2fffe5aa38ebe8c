import pytest

from helixframe.llm import shared

CLASH = "id bigint, run int, shard int, fp bigint, kept string, gone string, component_id bigint, spans string, n_words bigint, lang_pred string, score double, start bigint, label string, node bigint, cell bigint, c_lang string"


@pytest.fixture(scope="session", autouse=True)
def scratch(spark):
    yield shared.checkpoint_dir(spark)
    shared.discard_all(spark)


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    long = " ".join(f"word{k % 977}x{k % 31}" for k in range(30_000))
    texts = [
        (1, "the same long enough line\nand another one here\nshort", "en"),
        (2, "  The SAME long enough line \nsomething else entirely", "en"),
        (2, "  The SAME long enough line \nsomething else entirely", "en"),
        (3, None, "en"),
        (4, "", None),
        (5, " \t\n \x0b", "fr"),
        (6, long, "en"),
        (7, long + " and an end", None),
        (8, "Ünïcode wörds fließen, ça va? 日本語のテキスト token = 'abc123def' " * 3, "de"),
        (None, "the same long enough line\nof a row without an id", "en"),
        (None, None, None),
        (9, "12345 !!! ???", "es"),
        (10, "zwölf\r\nZeilen\x85ohne Ende\n\n\n", "de"),
        (-5, "the same long enough line", "en"),
        (2**62, " ".join(f"word{k % 977}x{k % 31}" for k in range(100, 160)), "en"),
    ]
    rows = [(d, t, g, None if d == 4 else "src", None if t is None else len(t), *[None] * 16) for d, t, g in texts]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + CLASH)


@pytest.fixture(scope="session")
def no_documents(spark, odd_documents):
    return odd_documents.limit(0)
