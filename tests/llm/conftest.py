import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from (doc_id, text, ...) rows; the other columns default to null."""
    from wattledger.llm.common import prepare

    def build(rows, schema=SCHEMA):
        width = schema.count(",") + 1
        return prepare(spark).createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], schema)

    return build


@pytest.fixture(scope="session")
def odd(make):
    """Nulls in every column, empty and long texts, ties, repeated rows and columns named like results."""
    long = " ".join(f"word{i % 977} und{i % 31}" for i in range(6000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "src1", 0), (3, long, "en", "src2", len(long)),
        (4, "the cat sat on the mat " * 9, "en", "src1", 207), (5, "the cat sat on the mat " * 9, "de", "src1", 207),
        (5, "the cat sat on the mat " * 9, "de", "src1", 207), (None, "lone text without an id", "en", None, 23),
        (7, "🙂é ß 中文 " * 30, None, "src9", None), (8, " \t\r\n\x0b\x0c ", "fr", "src3", 7), (9, "42 $$$ ---", "fr", "x", 10),
        (10, "\x00 nul \x1f sep", "de", "src4", 11),
    ]
    extra = "fp long, ref string, h int, ids string, n_tokens int, kept int, score int, labels int, part int, doc int, times int"
    wide = [(r + (1, "r", 2, "i", 3, 4, 5, 6, 7, 8, 9)) for r in rows]
    return make(wide, f"{SCHEMA}, {extra}")
