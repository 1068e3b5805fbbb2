import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that clash with the operators' own
        T.StructField("k", T.StringType()),
        T.StructField("h", T.StringType()),
        T.StructField("digest", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("pattern", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("label", T.StringType()),
    ]
)

WORDS = (
    "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa "
    "quebec romeo sierra tango uniform victor whiskey xray yankee zulu"
).split()


def prose(n: int, seed: int) -> str:
    """n words that depend on the seed, without a fixed period."""
    state, out = seed * 7919 + 17, []
    for _ in range(n):
        state = (state * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(state >> 8) % len(WORDS)] + WORDS[(state >> 16) % len(WORDS)][:2])
    return " ".join(out)


@pytest.fixture(scope="module")
def make_docs(spark):
    def build(rows):
        """Documents from (doc_id, text[, lang[, source]])."""
        full = [(*r, *([None] * (4 - len(r))), 0, *(["x"] * 7)) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return build


@pytest.fixture(scope="module")
def odd_rows():
    """Nulls, empty and blank texts, ties, repeated rows and a very long text."""
    long_text = prose(20_000, 5)
    return [
        (1, "same  text\there", "en", "a"),
        (2, "same text here", "en", "b"),
        (3, None, None, None),
        (4, "", "en", "a"),
        (4, "", "en", "a"),
        (5, " \n\t ", "en", None),
        (None, "no id", None, "a"),
        (None, "no id", None, "a"),
        (6, long_text, "en", "a"),
        (7, "é, ç … 漢字 🙂 ▁ x", "fr", "b"),
        (8, prose(60, 1), "en", "a"),
        (9, prose(60, 1) + " tail", "en", "a"),
    ]
