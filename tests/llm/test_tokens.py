import tiktoken
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidepath.llm import tokens

TEXTS = [
    None, "", " ", "\r\n\r\n x\t\ty  z ", "I'll say they've <|endoftext|> done", "a b c d　e", "naïve café Übersicht für alle", "お世話になっております。 我真笨，忘了表格。",
    "मैं कल देखूँगा। שלום مرحبا", "👍🏽👩‍💻 ok �﻿", "x9Fj+/Q0zz==\nAbCdEfGhIjKlMnOp" * 20, "pneumonoultramicroscopicsilicovolcanoconiosis", "12345 6789.001 ١٢٣", "_" * 40 + "!!!???...", "Ã¼bersicht \x00\x1f\x7f", "  \n \n  a", "a" * 3000 + "ab" * 500, "\uffff\uffff\u0100x\uffff", "zq" * 3_000,
]


def reference():
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=tokens.ranks(), special_tokens={})


def encoded(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids_", F.lit(1)).repartition(2)
    return {r.doc_id: list(r.ids) for r in tokens.encode_documents(df).collect()}


def test_ids_equal_the_public_tokenizer(spark):
    e, got = reference(), encoded(spark, TEXTS)
    assert got == {i: e.encode_ordinary(t) if t else [] for i, t in enumerate(TEXTS)}


def test_round_trip_and_empty_table(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS if t], "text string")
    assert df.select((tokens.decode_ids(tokens.encode(F.col("text"))) == F.col("text")).alias("same")).where("not same").count() == 0
    assert tokens.encode_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_rows_stay(spark):
    df = spark.createDataFrame([(1, "abc"), (1, "abc"), (None, "abc")], "doc_id long, text string")
    assert tokens.encode_documents(df).count() == 3


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=60), min_size=20, max_size=60))
def test_any_text(spark, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    e = reference()
    assert encoded(spark, texts) == {i: e.encode_ordinary(t) for i, t in enumerate(texts)}
