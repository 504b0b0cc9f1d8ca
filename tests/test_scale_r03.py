"""Round 3: parses as Arrow columns, work done once a row, corpora of several part files, files per dataset."""

import glob
import os
import random

from pyspark.sql import functions as F

from quaestio.functions import text as T
from quaestio.operators import annotate, evaluate, post_features, rules, sampling, sentences
from quaestio.operators.closed_class import ClosedClassProvider
from quaestio.plans import catalog, file_job, jobs
from quaestio.sources import posts as P

RAW = "id string, created_at string, full_text string, quoted_text string, hashtags string, favorite_count bigint, retweet_count bigint, dataset string"


def candidates_of(spark, texts):
    rows = [(str(i), "2024-01-01", text, "", "[]", 0, 0, "english_a") for i, text in texts]
    return sentences.question_candidates(post_features.flag_posts(P.normalise_posts(P.type_posts(spark.createDataFrame(rows, RAW)))))


def test_parses_pass_as_arrow_columns(spark):
    df = spark.createDataFrame([("a", "english", "So? Who knows?", 3, {"k": [1]}), ("b", None, "Who?", 0, None), ("c", "english", None, None, {}),
                                ("a", "english", "So? Who knows?", 3, {"k": [1]})], "id string, language string, text string, offset int, other map<string, array<int>>")
    out = annotate.annotate_with_python(df, ClosedClassProvider)
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    rows = sorted(out.collect(), key=lambda r: r.id)
    assert [(r.text, r.offset, r.other, [t.text for t in r.tokens or ()]) for r in rows] == [
        *[("Who knows?", 7, {"k": [1]}, ["Who", "knows", "?"])] * 2, ("Who?", 0, None, []), (None, None, {}, [])]
    assert rows[0].tokens[1].morph == {"VerbForm": ["Fin"], "Tense": ["Pres"]} and rows[0].tokens[2].morph == {}
    assert rows[2].tokens is None and rows[3].tokens is None


def test_candidates_are_cleaned_once(spark):
    plan = candidates_of(spark, [(1, "Who? @who Why so?")]).select("id", "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("@[A-Za-z0-9_]+") == 2  # the clean-up's two branches (French or not), in one place


def test_strip_equals_str_strip(spark):
    seed = random.Random(3)
    texts = ["".join(seed.choices(T.PY_WS_CHARACTERS + "ab.​᠎﻿", k=seed.randint(0, 8))) for _ in range(2000)] + [None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.py_strip(F.col("t")).alias("s")).collect()
    assert all(r.s == (r.t if r.t is None else r.t.strip()) for r in got)
    assert "regexp" not in spark.range(1).select(T.py_strip(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()


def test_corpus_of_one_bucket_has_several_ordered_parts(spark, tmp_path):
    path = str(tmp_path / "corpus")
    jobs.write_corpus(candidates_of(spark, [(i, "Who is it? Why so?") for i in range(0, 60)] + [(7, "Who is it? Why so?")]), path, files=1)
    assert len(glob.glob(f"{path}/bucket=0/part-*")) > 1
    rows = sorted(evaluate.gold_lines(evaluate.read_corpus(spark, path)).collect(), key=lambda r: r.line_no)
    assert len(rows) == 122 and {r.language for r in rows} == {"english"} and len({r.line_no for r in rows}) == 122
    numbers = [int(r.line.rsplit("Q", 1)[1].split(".")[0]) for r in rows]
    assert numbers == sorted(numbers) and len({r.path for r in rows}) == 1


def test_comparison_reads_stored_rows(spark):
    df = spark.createDataFrame([("a", "english", "Who[fronted] is it? | wh"), ("a", "english", "Who[no] is it? | wh")], "id string, language string, line string")
    out = rules.classify_sentences(annotate.annotate_with_python(evaluate.parse_gold(df), ClosedClassProvider))
    compared = evaluate.tag_comparison(out)
    assert "MapInArrow" not in compared._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.gold for r in compared.collect() if r.gold) == ["fronted", "fronted", "no", "no"]  # a repeated key pairs with both


def test_feature_sample_moves_a_text_once(spark):
    df = spark.createDataFrame([("x", "a", True, None), ("x", "a", False, None), ("x", "b", True, False), (None, "a", None, True)],
                               "language string, text string, f boolean, g boolean")
    out = sampling.feature_sample(df, 5, ["f", "g"])
    assert sorted((str(r.language), r.feature, r.value, r.text) for r in out.collect()) == [
        ("None", "g", True, "a"), ("x", "f", False, "a"), ("x", "f", True, "a"), ("x", "f", True, "b"), ("x", "g", False, "b")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_tables_have_few_files_per_dataset(spark, tmp_path):
    df = spark.range(0, 400, 1, 20).select(F.col("id").cast("string"), F.concat(F.lit("d"), (F.col("id") % 3).cast("string")).alias("dataset"))
    path = str(tmp_path / "t")
    file_job.overwrite_datasets(df, path)
    assert sum(f.endswith(".parquet") for _, _, fs in os.walk(path) for f in fs) == 3  # 60 with a file of every task
    assert spark.read.parquet(path).count() == 400


def test_rising_declaratives_compute_only_what_they_read(spark):
    df = spark.createDataFrame([("a", "english", "You know it?"), ("b", "english", "Do you know it?")], "id string, language string, text string")
    parsed = annotate.annotate_with_python(df, ClosedClassProvider)
    want = ["ends_with_question_mark", "subj_verb_inversion"]
    few, all_of = rules.classify_sentences(parsed, results=want), rules.classify_sentences(parsed)
    assert few.columns == [*df.columns, *want]
    assert sorted(few.collect()) == sorted(all_of.select(few.columns).collect())
    assert "qtype" not in few._jdf.queryExecution().optimizedPlan().toString()


def test_post_text_of_candidates_is_written_once(spark, tmp_path):
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda i: F.md5(F.concat_ws("-", "id", i))), " ")
    text = F.when(F.col("id") == 7, None).otherwise(F.concat(words, F.lit("? "), F.reverse(words), F.lit("? "), F.substring(words, 1, 33000), F.lit("?")))
    docs = spark.range(0, 200, 1, 4).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"),
                                            F.lit("web").alias("source"), F.lit(10).cast("bigint").alias("n_chars"))
    docs.union(docs.filter("doc_id < 2")).write.parquet(str(tmp_path / "documents.parquet"))  # two keys come twice
    catalog.QUERIES["p27_s8_question_columns"](spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    got, docs = spark.read.parquet(str(tmp_path / "out")), spark.read.parquet(str(tmp_path / "documents.parquet"))
    ids = sorted(r.id for r in got.select("id").collect())
    assert ids == sorted(f"Q{d}.{j}" for d in [*range(200), 0, 1] if d != 7 for j in range(3 + (d % 4 in (0, 3))))
    pairs = got.join(docs.dropDuplicates(["doc_id"]), F.col("tweet_id") == F.col("doc_id").cast("string"))
    assert pairs.filter(F.contains("tweet_full_text", "text")).count() == len(ids)
    size = {x: sum(os.path.getsize(f) for f in glob.glob(str(tmp_path / x / "*.parquet"))) for x in ("documents.parquet", "out")}
    assert size["out"] < 1.2 * size["documents.parquet"]
