"""Sinks and streaming (S6, S8-S13, streaming stages)."""

import os

from pyspark.sql import functions as F

import standin_parse as testdata
from quaestio.operators import annotate
from quaestio.plans import jobs
from quaestio.operators import sampling
from quaestio.sources import posts as P
from quaestio.sources import sinks
from quaestio.streaming import posts_stream


def annotate_standin(df):
    return annotate.annotate_with_expression(df, testdata.standin_parse)


def test_csv_round_trip_keeps_lists(spark, tmp_path):
    df = spark.createDataFrame([("1", ["a", "b"], 'say "hi"\nnow', "")],
                               "id string, hashtags array<string>, full_text string, quoted_text string")
    out = str(tmp_path / "posts_csv")
    sinks.write_table(df, out, fmt="csv")
    back = P.read_table(spark, out, fmt="csv").first()
    assert back["hashtags"] == ["a", "b"]
    assert back["full_text"] == 'say "hi"\nnow'
    assert back["quoted_text"] == ""


def test_write_modes_and_paths(spark, tmp_path):
    df = spark.createDataFrame([("Q1.0", "t", "d", 1)], "id string, text string, dataset string, tweet_x int")
    out = str(tmp_path / "q")
    sinks.write_questions(df, out)
    try:
        sinks.write_questions(df, out)
        raise AssertionError("second write must fail without overwrite")
    except Exception as exc:  # noqa: BLE001
        assert "already exists" in str(exc).lower() or "path" in str(exc).lower()
    sinks.write_questions(df, out, mode="overwrite", partition_by=["dataset"])
    assert os.path.isdir(os.path.join(out, "dataset=d"))
    assert sinks.default_output_path("data", "questions", ["dutch10K", "french10K"]) == "data/questions_dutch10K_french10K"


def test_feature_sheet_files(spark, tmp_path):
    rows = [("english", "q%d?" % i, i % 2 == 0, False, False, False, False) for i in range(8)]
    q = spark.createDataFrame(rows, "language string, text string, has_negation boolean, has_ref_to_other boolean, "
                                    "has_ref_to_group boolean, has_conjunction boolean, has_leveler boolean")
    lines = sampling.feature_sheet_lines(sampling.feature_sample(q, 3))
    out = str(tmp_path / "sheets")
    sinks.write_sheets(lines, out)
    sheet_dir = os.path.join(out, "language=english", "sheet=has-negation")
    text = "".join(open(os.path.join(sheet_dir, f), encoding="utf-8").read()
                   for f in sorted(os.listdir(sheet_dir)) if f.startswith("part-"))
    body = text.splitlines()
    assert body[0].startswith("// English: sampled questions")
    i_false = body.index("// These questions are predicted to have has_negation == False:")
    i_true = body.index("// These questions are predicted to have has_negation == True:")
    assert i_false < i_true
    assert len([b for b in body[i_false + 1:i_true] if b.startswith("q")]) == 3
    assert len([b for b in body[i_true + 1:] if b.startswith("q")]) == 3


def test_streaming_questions(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.csv").write_text("id,created_at,full_text,quoted_text,hashtags,favorite_count,retweet_count,dataset\n"
                               "1,2020-01-01,Who knows? Not me.,,[],0,0,english_s\n", encoding="utf-8")
    raw = posts_stream.read_post_stream(spark, str(src))
    q = posts_stream.start_question_stream(raw, str(tmp_path / "out"), str(tmp_path / "ckpt"),
                                           lambda batch: jobs.classify_questions(batch, annotate_standin))
    q.awaitTermination(300)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert [r["text"] for r in out.collect()] == ["Who knows?"]
    assert out.columns[:2] == ["id", "text"]
