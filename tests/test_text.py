"""Scalar text functions (P1-P12, P25-P31) on small literal frames."""

import datetime

from pyspark.sql import functions as F

from quaestio.functions import text as T


def one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr(F.col("v")).alias("o")).first()["o"]


def test_parse_date(spark):
    assert one(spark, T.parse_date, "2021-03-04 10:11:12") == datetime.date(2021, 3, 4)
    assert one(spark, T.parse_date, "2021-03-04") == datetime.date(2021, 3, 4)
    assert one(spark, T.parse_date, "2021-3-5") == datetime.date(2021, 3, 5)
    assert one(spark, T.parse_date, "2021-03-05 7:08:09") == datetime.date(2021, 3, 5)
    assert one(spark, T.parse_date, "04/03/2021") is None
    assert one(spark, T.parse_date, None) is None


def test_parse_hashtag_list(spark):
    assert one(spark, T.parse_hashtag_list, "['Aa', 'bB', 'aa']") == ["aa", "bb", "aa"]
    assert one(spark, T.parse_hashtag_list, "[]") == []
    assert one(spark, T.parse_hashtag_list, "") == []
    assert one(spark, T.parse_hashtag_list, None) == []
    assert one(spark, T.parse_hashtag_list, '["x" , \' Y \']') == ["x", "y"]


def test_repair_whitespace(spark):
    assert one(spark, T.repair_whitespace, "a\rb  c   d     e") == "a b  c\td\te"


def test_clean_sentence(spark):
    df = spark.createDataFrame([
        ("@joe_1 Is #this ok?  ", "english"),
        ("➡️ Qu'est-ce que c'est ?", "french"),
        ("Ã© et Ã la", "french"),
        ("Ã© stays", "english"),
        ("a-b-c-d", "french"),
        ("  spaced  ", "dutch"),
    ], "t string, l string")
    got = [r[0] for r in df.select(T.clean_sentence(F.col("t"), F.col("l"))).collect()]
    assert got == ["Is this ok?", "Qu'est -ce que c'est ?", "é et à la", "Ã© stays", "a -b -c -d", "spaced"]
    assert all("#" not in g for g in got)


def test_question_marks(spark):
    df = spark.createDataFrame([("a? b?",), ("?",), ("none",)], "t string")
    chars = [r[0] for r in df.select(T.num_questions(F.col("t"))).collect()]
    whole = [r[0] for r in df.select(T.num_questions(F.col("t"), "whole_text")).collect()]
    assert chars == [2, 1, 0]
    assert whole == [0, 1, 0]


def test_ends_with_question_mark(spark):
    df = spark.createDataFrame([("Really?!",), ("!Why?!!",), ("No.",), ("?!x",)], "t string")
    assert [r[0] for r in df.select(T.ends_with_question_mark(F.col("t"))).collect()] == [True, True, False, False]


def test_language_lookups(spark):
    df = spark.createDataFrame([("dutch10K",), ("french_x",), ("german",), ("englishA",)], "d string")
    assert [r[0] for r in df.select(T.language_from_dataset(F.col("d"))).collect()] == \
        ["dutch", "french", "???", "english"]
    df2 = spark.createDataFrame([("nl",), ("it",), ("de",)], "c string")
    assert [r[0] for r in df2.select(T.language_of_code(F.col("c"))).collect()] == ["dutch", "italian", None]


def test_question_id_and_join(spark):
    df = spark.createDataFrame([("17", 3, ["wie", "wat"])], "id string, j int, w array<string>")
    r = df.select(T.question_id(F.col("id"), F.col("j")).alias("q"), T.join_words(F.col("w")).alias("w")).first()
    assert (r["q"], r["w"]) == ("Q17.3", "wie|wat")


def test_render_tagged_line(spark):
    toks = [("Wie", " ", "fronted"), ("komt", " ", None), ("er", "", None), ("?", " ", None)]
    df = spark.createDataFrame([(toks, "wh")], "t array<struct<text:string,ws:string,qtype:string>>, s string")
    r = df.select(T.render_tagged_line(F.col("t"), F.col("s")).alias("l"), T.tag_summary(F.col("t")).alias("m")).first()
    assert r["l"] == "Wie[fronted] komt er? | wh"
    assert r["m"] == "Wie-fronted"
