"""Gold scoring (S15, E1-E4, A17) on a small self-written corpus with planted errors."""

from pyspark.sql import functions as F

from parse_fixtures import DO_THEY_KNOW, I_WONDER_WHY, WHAT_DO_YOU_WANT, YOU_ARE_COMING, tokens
from quaestio.operators import annotate, evaluate, rules
from quaestio.operators.annotate import PARSE_TYPE

CORPUS = """// english
// a comment line
Do they know why[no]? | polar
What[insitu] do you want? | wh   // planted: the tag should be fronted

I wonder why[indirect] he left. | polar
You are coming? | risingdecl // see http://example.org/x//y
You are coming? |
// stop
Tomorrow? | polar
"""


def _schema():
    from pyspark.sql import types as ST
    return ST.StructType([ST.StructField("language", ST.StringType()), ST.StructField("text", ST.StringType()),
                          ST.StructField("parse", PARSE_TYPE)])


def test_extract_tags(spark):
    df = spark.createDataFrame([("Wie[fronted] eet jij op?",), ("qu'[no]il vient quand[insitu]",),
                                ("a [x] b[no]",), ("geen tags",), ("twee[no] tags[indirect] hier",)], "s string")
    got = [(r["t"]["untagged"], [(x["start"], x["tag"]) for x in r["t"]["tags"]])
           for r in df.select(evaluate.extract_tags(F.col("s")).alias("t")).collect()]
    assert got[0] == ("Wie eet jij op?", [(0, "fronted")])
    assert got[1] == ("qu'il vient quand", [(0, "no"), (12, "insitu")])
    assert got[2] == ("a  b", [(6, "no")])  # unmatched tag still shifts later offsets, as in the reference
    assert got[3] == ("geen tags", [])
    assert got[4] == ("twee tags hier", [(0, "no"), (5, "indirect")])


def test_gold_lines_and_scores(spark, tmp_path):
    path = tmp_path / "gold.txt"
    path.write_text(CORPUS, encoding="utf-8")
    lines = evaluate.gold_lines(evaluate.read_corpus(spark, str(path)))
    gold = evaluate.parse_gold(lines)
    rows = gold.orderBy("line_no").collect()
    assert [r["text"] for r in rows] == ["Do they know why?", "What do you want?", "I wonder why he left.",
                                         "You are coming?", "You are coming?"]
    assert all(r["language"] == "english" for r in rows)
    assert rows[1]["comment"] == "planted: the tag should be fronted"
    assert rows[3]["comment"] == "see http://example.org/x//y"
    assert rows[4]["gold_structure"] == ""
    parsed = annotate.annotate_with_lookup(gold, spark.createDataFrame(
        [("english", t, [tokens(t, s)]) for t, s in [DO_THEY_KNOW, WHAT_DO_YOU_WANT, I_WONDER_WHY, YOU_ARE_COMING]],
        _schema()))
    scored = evaluate.score(rules.classify_sentences(parsed))
    per_line = {r["line_no"]: (r["tag_errors"], r["structure_error"]) for r in scored.collect()}
    assert per_line == {2: (0, False), 3: (1, False), 5: (0, True), 6: (0, False), 7: (0, False)}
    total = evaluate.total_errors(scored).first()
    assert (total["errors"], total["tag_errors"], total["structure_errors"], total["lines"]) == (2, 1, 1, 5)
    conf = {(r["gold"], r["predicted"]): r["tokens"] for r in evaluate.confusion(scored).collect()}
    assert conf == {("no", "no"): 1, ("insitu", "fronted"): 1, ("indirect", "indirect"): 1}


def test_gold_lines_across_splits(spark, tmp_path):
    lines = ["// dutch"] + [f"zin {i}?" for i in range(40)] + ["// french"] + [f"phrase {i} ?" for i in range(40)] \
        + ["", "// stop", "na stop?"]
    path = tmp_path / "big.txt"
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        raw = evaluate.read_corpus(spark, str(path))
        assert raw.select("block").distinct().count() > 5
        got = sorted((r["line_no"], r["language"], r["line"]) for r in evaluate.gold_lines(raw).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = [(i, "dutch", lines[i]) for i in range(1, 41)] + [(i, "french", lines[i]) for i in range(42, 82)]
    assert got == want
