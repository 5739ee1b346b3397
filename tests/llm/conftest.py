import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty and long texts, repeats, and columns whose names clash."""
    long = "lorem ipsum dolor sit amet " * 4000
    rows = [
        (1, "The quick brown fox jumps over the lazy dog. Write to ann.lee@mail.example.com now", "en", 1, 7),
        (1, "The quick brown fox jumps over the lazy dog. Write to ann.lee@mail.example.com now", "en", 1, 7),
        (2, None, None, None, None),
        (3, "", "en", 3, 3),
        (4, " \t\n ", None, 4, 4),
        (5, long, "en", 5, 5),
        (6, "call +1 (274) 555-9629 or 97.207.164.162, card 4586 4796 8699 8659", "en", 6, 6),
        (None, "no id but a text", "en", 8, 8),
        (7, "Größe ÉCLAIR Σίσυφος 中文 <|endoftext|> 😀", "de", 9, 9),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, fp bigint, component_id bigint")
