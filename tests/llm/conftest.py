import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = ("size", "taken", "score", "labels", "n_words", "n_hit", "items", "is_toxic", "p_toxic", "held_out", "lang_pred", "removed", "component_id", "target")


def make_docs(spark, texts, **columns):
    """texts: id to text, or (id, text) pairs."""
    pairs = list(texts.items()) if isinstance(texts, dict) else texts
    rows = [(i, t, columns.get("lang", {}).get(i, "en"), columns.get("source", {}).get(i, "s"), len(t or "")) for i, t in pairs]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def docs(spark):
    return lambda texts, **columns: make_docs(spark, texts, **columns)


@pytest.fixture
def odd(spark):
    """Documents with nulls, blanks, repeats, a very long text, and columns named as the operators' own."""
    long = " ".join(f"wort{i % 977} zeile" for i in range(60_000))
    texts = [(1, "plain words that stand here for all to read"), (1, "plain words that stand here for all to read"), (2, None), (3, ""), (4, " \t\n"), (None, "without an id but with some words"), (5, long), (6, "ça été Ünïcode 😀 words"), (7, "!!! ??? ..."), (8, "1 2 3")]
    df = make_docs(spark, texts)
    from pyspark.sql import functions as F

    return df.withColumn("lang", F.when(F.col("doc_id") == 6, None).otherwise(F.col("lang"))).withColumn("source", F.when(F.col("doc_id") == 3, None).otherwise(F.col("source"))).withColumns({n: F.lit("clash") for n in NAMES})
