"""The run through files: tables read back, dynamic overwrite, quality counts, corpus files."""

import glob

import pytest
from pyspark.sql import functions as F

from quaestio.operators import annotate, closed_class, evaluate, rules
from quaestio.plans import file_job, jobs
from quaestio.sources import posts as P
from quaestio.sources import sinks

SCHEMA = "id string, created_at string, full_text string, quoted_text string, hashtags string, favorite_count long, retweet_count long, dataset string"


def parsed(df):
    return annotate.annotate_with_python(df, closed_class.ClosedClassProvider)


def single(df):
    return annotate.annotate_with_python(df, closed_class.single_sentence)


def raw(spark, rows):
    return spark.createDataFrame([(i, d, t, None, "['Hoax', 'b']", 1, 2, s) for i, d, t, s in rows], SCHEMA)


ROWS = [("1", "2024-01-02", "Do you know who said it? Yes.", "english_a"), ("2", "x", "Who is it?\nNo one knows!", "english_a"),
        ("3", "2024-01-02 10:00:00", "Weet je wie het heeft gezien?", "dutch_a"), ("4", None, "Warum nicht?", "other_a"),
        ("5", "2024-02-03", "Nothing here.", "english_a")]


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    return file_job.run(spark, raw(spark, ROWS), str(tmp_path_factory.mktemp("run")), parsed, single)


def test_tables_and_quality(spark, done):
    posts, questions = P.read_table(spark, done.posts), P.read_table(spark, done.questions)
    assert {r.id for r in posts.collect()} == {"1", "2", "3", "4", "5"}
    assert {(r.text, r.structure) for r in questions.collect()} >= {("Who is it?", "wh"), ("Warum nicht?", None)}
    assert done.quality["posts"] == 5 and done.quality["unknown_language"] == 1 and done.quality["no_date"] == 2
    assert done.quality["questions"] == questions.count() and done.quality["unclassified"] == questions.filter("structure IS NULL").count() == 1


def test_sheets(done):
    files = {f.split("/sheets/")[1].rsplit("/", 1)[0]: open(f, encoding="utf-8").read().split("\n") for f in glob.glob(f"{done.sheets}/*/*/*.txt")}
    lines = files["language=english/sheet=classification"]
    assert lines[0].startswith("// English") and lines[3] == "// english" and "Who[fronted] is it? | wh" in lines
    assert {k for k in files if "english" in k} == {f"language=english/sheet={s}" for s in (
        "classification", "has-negation", "has-ref-to-other", "has-ref-to-group", "has-conjunction", "has-leveler")}


def test_profiles_and_summary(spark, done):
    found = {k: v.count() for k, v in file_job.profiles(spark, done).items()}
    assert found["posts_per_dataset"] == 3 and found["columns"] > 10 and all(found.values())
    kinds = {(r.kind, r.name): r.num_rows for r in file_job.summary(spark, done).collect()}
    assert kinds["posts", "english_a"] == 3 and ("sheet", "english/classification") in kinds


def test_overwrite_keeps_other_datasets(spark, tmp_path):
    first = file_job.run(spark, raw(spark, ROWS), str(tmp_path), parsed, single)
    again = file_job.run(spark, raw(spark, [("9", "2024-05-05", "Who left?", "dutch_a")]), str(tmp_path), parsed, single)
    posts = {(r.id, r.dataset) for r in P.read_table(spark, again.posts).select("id", "dataset").collect()}
    assert posts == {("1", "english_a"), ("2", "english_a"), ("5", "english_a"), ("4", "other_a"), ("9", "dutch_a")}
    assert first.posts == again.posts and again.quality["posts"] == 1


def test_question_table_from_csv(spark, done, tmp_path):
    path = str(tmp_path / "questions")
    sinks.write_table(P.read_table(spark, done.questions), path, "csv")
    back = P.read_table(spark, path, "csv")
    types = dict(back.dtypes)
    assert types["has_question_mark"] == "boolean" and types["offset"] == "int" and types["created_at"] == "date"
    assert {r.text for r in back.collect()} == {r.text for r in P.read_table(spark, done.questions).collect()}


def test_corpus_files(spark, tmp_path):
    typed = P.normalise_posts(P.type_posts(raw(spark, [(str(i), "2024-01-01", f"Who is {i}?\nWhat? Why so?", "english_a" if i % 2 else "dutch_a") for i in range(395, 405)])))
    from quaestio.operators import post_features, sentences
    candidates = sentences.question_candidates(post_features.flag_posts(typed))
    path = str(tmp_path / "corpus")
    jobs.write_corpus(candidates, path, files=2)
    lines = evaluate.gold_lines(evaluate.read_corpus(spark, path)).collect()
    assert {r.language for r in lines} == {"english", "dutch"}
    assert not any("Q402" in r.line or "Q404" in r.line for r in lines)  # 400 ends its file, after its first line
    assert any("Q403" in r.line for r in lines) and sum("note Q400." in r.line for r in lines) == 1


def test_comparison_counts_gold_tags_without_a_token(spark):
    df = spark.createDataFrame([("a", "english", "Who[fronted] is Ann-x[no]ia? | polar"), ("b", "english", "Who is it? | wh")], "id string, language string, line string")
    out = rules.classify_sentences(single(evaluate.parse_gold(df)))
    rows = evaluate.tag_comparison(out).collect()
    alone = [r for r in rows if not r.has_token]
    assert [(r.id, r.gold, r.differs) for r in alone] == [("a", "no", True)]
    scores = {r.id: (r.tag_errors, r.structure_error) for r in evaluate.score(out).collect()}
    assert scores == {k: (sum(r.differs for r in rows if r.id == k), e) for k, e in (("a", True), ("b", False))}
    total = evaluate.total_errors(evaluate.score(out)).first()
    assert total.errors == sum(a + b for a, b in scores.values()) and total.lines == 2
