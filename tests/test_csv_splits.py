"""Splittable CSV against the multiLine scan, with quoted breaks and quotes at split borders."""

import random

import pytest

from quaestio.sources import csv_splits, posts


def write(path, rnd, n, long):
    def field():
        parts = ["a", "é", ",", '""', "\n", "\n\n", "b c", "x" * rnd.randrange(long), "''", "\t", "日本"]
        return '"' + "".join(rnd.choice(parts) for _ in range(rnd.randrange(6))) + '"' if rnd.random() < 0.7 else rnd.choice(["", "plain", "7", "é"])
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write('id,"full_text",quoted_text,hashtags\n')
        for i in range(n):
            f.write(f"{i},{field()},{field()},{field()}\n")
            if rnd.random() < 0.02:
                f.write("\n")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("split,long", [(97, 20), (1000, 40), (4096, 3000)])
def test_equal_to_multiline(spark, tmp_path, split, long):
    rnd = random.Random(split)
    for k in range(3):
        write(tmp_path / f"{k}.csv", rnd, 120, long)
    path = str(tmp_path)
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        lines = csv_splits.numbered_lines(spark, path)
        assert lines.select("path", "block").distinct().count() > 3 * 3  # several splits for one file
        got = rows(csv_splits.read_csv(spark, path))
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    want = rows(spark.read.options(**posts.CSV_OPTIONS).csv(path))
    assert len(want) == 360
    assert got == want


def test_one_record_over_many_splits(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,full_text\n1,"' + "line\n" * 400 + '"\n2,end\n3,"q""\n""r"\n', encoding="utf-8")
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
        got = rows(csv_splits.read_csv(spark, str(tmp_path)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
    assert got == sorted([("1", "line\n" * 400), ("2", "end"), ("3", 'q"\n"r')], key=repr)


def test_crlf_and_carriage_returns(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'id,full_text\r\n1,"a\rb"\r\n2,plain\r\n')
    assert rows(csv_splits.read_csv(spark, str(tmp_path))) == [("1", "a\rb"), ("2", "plain")]


def test_only_a_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,full_text\n", encoding="utf-8")
    assert csv_splits.read_csv(spark, str(tmp_path)).columns == ["id", "full_text"]
    assert csv_splits.read_csv(spark, str(tmp_path)).count() == 0


def test_posts(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,created_at,full_text,quoted_text,hashtags\n1,2024-01-02 03:04:05,"two\nlines ""q""",,"[\'A\', \'b\']"\n',
                                    encoding="utf-8")
    r = posts.read_posts_csv(spark, str(tmp_path)).first()
    assert (r.id, str(r.created_at), r.full_text, r.quoted_text, list(r.hashtags)) == ("1", "2024-01-02", 'two\nlines "q"', "", ["a", "b"])
