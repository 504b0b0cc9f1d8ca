"""Profiles and samples."""

from pyspark.sql import functions as F

from quaestio.operators import post_features, profile, sampling


def questions(spark):
    rows = [
        ("Q1.0", "d1", "english", "Who?", "wh", "direct", "who", True, None),
        ("Q2.0", "d1", "english", "Who?", "wh", "direct", "who", False, None),
        ("Q3.0", "d1", "english", "Is it?", "polar", "direct", "", True, None),
        ("Q4.0", "d2", "english", "Why?", "wh", "direct", "why", None, None),
        ("Q5.0", "d2", "english", "I know why.", "decl", "indirect", "why", True, True),
        ("Q6.0", None, "english", "x?", "elliptic", "direct", "", True, False),
    ]
    schema = ("id string, dataset string, language string, text string, structure string, use string, "
              "qwords_functional string, has_negation boolean, subj_verb_inversion boolean")
    df = spark.createDataFrame(rows, schema)
    for c in ["has_ref_to_other", "has_ref_to_group", "has_conjunction", "has_leveler", "has_question_mark"]:
        df = df.withColumn(c, F.lit(False))
    return df


def test_question_profiles(spark):
    q = questions(spark)
    assert {r["dataset"]: r["num_questions"] for r in profile.questions_per_dataset(q).collect()} == {"d1": 3, "d2": 2}
    means = {r["dataset"]: r for r in profile.question_feature_means(q).collect()}
    assert abs(means["d1"]["mean_has_negation"] - 2 / 3) < 1e-12
    assert means["d2"]["mean_has_negation"] == 1.0           # NULL skipped
    assert means["d1"]["mean_subj_verb_inversion"] is None   # all NULL -> NULL
    counts = {(r["dataset"], r["structure"], r["use"]): r["num_questions"] for r in profile.structure_use_counts(q).collect()}
    assert counts[("d1", "wh", "direct")] == 2
    top = [(r["dataset"], r["qwords_functional"], r["num_questions"]) for r in profile.top_functional_qwords(q, 2).collect()]
    assert top == [("d1", "who", 2), ("d2", "why", 2)]  # equal counts: keys ascending


def test_top_hashtags_ties_and_skew(spark):
    rows = [("p%d" % i, "big", ["a", "b"] if i % 2 else ["a"]) for i in range(300)] + [("q", "small", ["z", "y"])]
    df = spark.createDataFrame(rows, "id string, dataset string, hashtags array<string>")
    got = [(r["dataset"], r["hashtag"], r["num"], r["rank"]) for r in
           profile.top_hashtags(df, 1).orderBy("dataset").collect()]
    assert got == [("big", "a", 300, 1), ("small", "y", 1, 1)]


def test_posts_profile_and_split(spark):
    df = spark.createDataFrame([
        ("1", "d", True, True, False, None, None),
        ("2", "d", False, False, False, False, None),
        ("3", None, True, True, True, True, None),
    ], "id string, dataset string, has_question boolean, has_disinfo_hashtags boolean, has_disinfo_text boolean, "
       "has_negation boolean, created_at date")
    r = profile.posts_per_dataset(df).first()
    assert (r["dataset"], r["num_posts"], r["share_question"], r["share_negation"]) == ("d", 2, 0.5, 0.0)
    df = df.withColumn("has_disinfo_text_or_hashtags", F.col("has_disinfo_text") | F.col("has_disinfo_hashtags"))
    yes, no = post_features.split_by_flag(df)
    assert sorted(r["id"] for r in yes.collect()) == ["1", "3"]
    assert sorted(r["id"] for r in no.collect()) == ["2"]
    assert [r["dataset"] for r in profile.distinct_datasets(df).collect()] == ["d"]


def test_samples_bounded_and_deterministic(spark):
    rows = [("t%d" % i, "english", "wh" if i % 5 else "polar", "direct", "text %d?" % i, i % 2 == 0) for i in range(500)]
    df = spark.createDataFrame(rows, "id string, language string, structure string, use string, text string, "
                                     "has_negation boolean")
    s1 = sampling.classification_sample(df, 20)
    s2 = sampling.classification_sample(df.repartition(7), 20)
    c = {(r["structure"]): r["n"] for r in s1.groupBy("structure").agg(F.count("*").alias("n")).collect()}
    assert c == {"wh": 20, "polar": 20}
    assert sorted(r["text"] for r in s1.collect()) == sorted(r["text"] for r in s2.collect())
    for c2 in ["has_ref_to_other", "has_ref_to_group", "has_conjunction", "has_leveler"]:
        df = df.withColumn(c2, F.lit(None).cast("boolean"))
    fs = sampling.feature_sample(df, 50)
    got = {(r["feature"], r["value"]): r["n"] for r in fs.groupBy("feature", "value").agg(F.count("*").alias("n")).collect()}
    assert got == {("has_negation", True): 50, ("has_negation", False): 50}


def test_short_distinct_texts(spark):
    df = spark.createDataFrame([("a", "x" * 69), ("a", "x" * 69), ("a", "y" * 70), ("b", "x" * 69)], "g string, text string")
    got = sorted((r["g"], len(r["text"])) for r in sampling.short_distinct_texts(df, ["g"]).collect())
    assert got == [("a", 69), ("b", 69)]


def test_schema_listing_and_union(spark):
    a = spark.createDataFrame([(1, "x")], "id int, s string")
    b = spark.createDataFrame([(2,)], "id int")
    u = profile.union_datasets([a, b])
    assert sorted((r["id"], r["s"]) for r in u.collect()) == [(1, "x"), (2, None)]
    listing = [(r["column_name"], r["data_type"]) for r in profile.schema_listing(u).orderBy("position").collect()]
    assert listing == [("id", "int"), ("s", "string")]
