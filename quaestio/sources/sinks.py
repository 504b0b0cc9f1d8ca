"""Sinks (S6, S8-S13).

Stage outputs are written as Parquet by default (arrays and '' survive the round trip,
Q20); CSV export renders arrays as list text. Writers never prompt: the save mode is
an argument (``errorifexists`` by default, S10).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestio.operators.sentences import order_question_columns


def default_output_path(base_dir: str, kind: str, datasets: list[str]) -> str:
    """``<base>/<kind>_<dataset names joined by _>``."""
    return f"{base_dir}/{kind}_{'_'.join(datasets)}"


def _csv_ready(df: DataFrame) -> DataFrame:
    """Arrays -> list text (``['a', 'b']``), so a CSV reader with P2 gets them back."""
    cols = []
    for name, dtype in df.dtypes:
        if dtype.startswith("array<string"):
            cols.append(F.concat(F.lit("["), F.array_join(F.transform(F.col(name), lambda x: F.concat(
                F.lit("'"), x, F.lit("'"))), ", "), F.lit("]")).alias(name))
        elif dtype.startswith(("array", "map", "struct")):
            cols.append(F.to_json(F.col(name)).alias(name))
        else:
            cols.append(F.col(name))
    return df.select(*cols)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists",
                partition_by: list[str] | None = None) -> None:
    """S6 / S8 writer: Parquet (default) or CSV with a header and no index."""
    out = _csv_ready(df) if fmt == "csv" else df
    w = out.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", "true").option("escape", '"').csv(path)
    else:
        w.format(fmt).save(path)


def write_questions(questions: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists",
                    partition_by: list[str] | None = None) -> None:
    """``id, text`` first, ``tweet_*`` last, parse column dropped."""
    write_table(order_question_columns(questions), path, fmt, mode, partition_by)


# The headers of the annotation sheets. Readers skip // lines; FIXED VALUE: the last line
# of the classification header, which names the section's language.
CLASSIFICATION_HEADER = """// {Language}: sampled questions with their predicted word tags and structure.
// Tags stand behind a word as [no], [insitu], [fronted] or [indirect]; the structure follows the bar.
// To correct a line, put // in front of it and add the corrected line below; remarks go behind // at a line's end.
// {language}"""

FEATURE_HEADER = """// {Language}: sampled questions without and with one feature.
// To mark a wrong prediction, put // in front of the line; remarks go behind // at a line's end.
"""


def with_headers(lines: DataFrame) -> DataFrame:
    """Prefix every (language, sheet) with its instruction header lines (section ''),
    one header per sheet, built from the distinct sheet keys (no collect)."""
    keys = lines.select("language", "sheet").distinct()
    header = F.when(F.col("sheet") == "classification", _fill(CLASSIFICATION_HEADER)).otherwise(_fill(FEATURE_HEADER))
    head = (keys.select("language", "sheet", F.posexplode(F.split(header, "\n")).alias("rank", "line"))
            .select("language", "sheet", F.lit("").alias("section"), (F.col("rank") - 10_000).alias("rank"), "line"))
    return head.unionByName(lines.select("language", "sheet", "section", "rank", "line"))


def _fill(template: str):
    lang = F.col("language")
    cap = F.concat(F.upper(F.substring(lang, 1, 1)), F.substring(lang, 2, 1 << 20))
    parts = template.split("{")
    expr = [F.lit(parts[0])]
    for p in parts[1:]:
        key, rest = p.split("}", 1)
        expr.append(cap if key == "Language" else lang)
        expr.append(F.lit(rest))
    return F.concat(*expr)


def write_sheets(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One text file per (language, sheet), lines ordered by section and rank.

    The rows are hash-partitioned by the two keys and sorted inside each partition, so
    the writer's own ordering requirement is already met and every sheet is written by
    one task in order.
    """
    (with_headers(lines)
     .repartition("language", "sheet")
     .sortWithinPartitions("language", "sheet", "section", "rank")
     .select("language", "sheet", "line")
     .write.mode(mode).partitionBy("language", "sheet").text(path))
