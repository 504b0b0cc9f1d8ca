"""Sentence split and candidates."""

from pyspark.sql import functions as F

from quaestio.operators import sentences
from quaestio.plans import jobs
from quaestio.sources import posts as P


def raw_posts(spark, rows):
    return spark.createDataFrame(rows, "id string, created_at string, full_text string, quoted_text string, "
                                       "hashtags string, favorite_count string, retweet_count string, dataset string")


def test_split_offsets_reproduce_text(spark):
    texts = ["Hello there. Who are you?  Fine!\nOK", "no terminator", "", "3.5 is fine. “Quoted.” Next…  end",
             "Why?!? Because."]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", sentences.split_sentences(F.col("t")).alias("s")).collect()
    for r in rows:
        t = r["t"]
        for s in r["s"]:
            assert t[s["start"]:s["start"] + len(s["text"])] == s["text"]
    first = [s["text"] for s in rows[0]["s"]]
    assert first == ["Hello there.", "Who are you?", "Fine!", "OK"]
    assert [s["text"] for s in rows[3]["s"]] == ["3.5 is fine.", "“Quoted.”", "Next…", "end"]


def test_candidates_ordinals_and_columns(spark):
    raw = raw_posts(spark, [
        ("1", "2020-01-02", "Is it? What now. @who", None, "['Hoax']", "3", "4", "english_a"),
        ("2", "bad", "Wie komt er? Niet ik.", "q", "[]", "0", "0", "dutch_b"),
        ("3", "2020-01-02", "Como? Nada.", "", "[]", "0", "0", "spanish"),
    ])
    posts = jobs.analysed_posts_from_raw(raw)
    q = sentences.question_candidates(posts)
    got = sorted((r["id"], r["text"], r["offset"], r["j"]) for r in q.collect())
    # '@who' is a candidate (question word) but cleans to '' -> dropped (F2, its ordinal 2 is
    # not reused); a '???' language keeps sentences that end with '?'
    assert got == [("Q1.0", "Is it?", 0, 0), ("Q1.1", "What now.", 7, 1), ("Q2.0", "Wie komt er?", 0, 0),
                   ("Q3.0", "Como?", 0, 0)]
    cols = q.columns
    assert "tweet_full_text" not in cols and "tweet_quoted_text" not in cols
    assert {"tweet_id", "tweet_hashtags", "tweet_has_question", "created_at", "dataset", "language"} <= set(cols)
    with_text = sentences.question_candidates(posts, include_post_text=True)
    assert "tweet_full_text" in with_text.columns
    ordered = sentences.order_question_columns(q).columns
    assert ordered[:2] == ["id", "text"]
    assert all(c.startswith("tweet_") for c in ordered[-5:])


def test_posts_load(spark, tmp_path):
    path = tmp_path / "posts.csv"
    path.write_text('id,created_at,full_text,quoted_text,hashtags,favorite_count,retweet_count,extra\n'
                    '1,2020-05-06 07:08:09,"line one\r\nline ""two""   wide",,"[\'A\', \'b\']",5,6,x\n'
                    '2,,,"q",[],0,0,y\n', encoding="utf-8")
    df = P.load_raw_posts(spark, {"french_test": str(path)})
    rows = {r["id"]: r for r in df.collect()}
    assert rows["1"]["full_text"] == 'line one \nline "two"\twide'
    assert rows["1"]["hashtags"] == ["a", "b"]
    assert str(rows["1"]["created_at"]) == "2020-05-06"
    assert rows["2"]["full_text"] == "" and rows["2"]["quoted_text"] == "q"
    assert rows["2"]["created_at"] is None
    assert rows["1"]["language"] == "french" and rows["1"]["dataset"] == "french_test"
    assert rows["1"]["extra"] == "x"
    assert P.read_posts_csv(spark, str(path)).count() == 2


def test_split_of_many_sentences(spark):
    text = "".join(f"Sentence {i}. " for i in range(1000))
    df = spark.createDataFrame([(text,), ("",), (None,)], "text string")
    from quaestio.operators.sentences import split_sentences
    many, empty, null = [r["s"] for r in df.select(split_sentences(F.col("text")).alias("s")).collect()]
    assert [(x["start"], x["text"]) for x in many[:1000]] == [
        (text.index(f"Sentence {i}. "), f"Sentence {i}.") for i in range(1000)]
    assert [x["text"] for x in empty] == [""] and null is None
