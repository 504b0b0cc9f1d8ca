"""CSV records with quoted line breaks from file splits.

Spark's ``multiLine`` CSV scan reads a whole file in one task. Here files are read as lines by
splits, and whether a line break stands inside quotes follows from the parity of the
quotes before it (a doubled quote counts twice and changes nothing):

1. every line gets its number within its split, the parity of the quotes before it in the
   split, and the last line that begins a record for either parity at the split's begin;
2. one row a split (its parity, its last record begins) is scanned in file order, which
   gives each split's parity at its begin and the record that is still open there;
3. a line that begins a record and ends it is that record; all other lines are grouped by
   the line where their record begins, in order, however many splits it crosses;
4. the records are parsed by ``from_csv``.

Only lines of records with line breaks are shuffled. The scan of step 2 holds one row a split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

LINES = "path string, block long, idx long, parity int, quotes int, even_begin long, odd_begin long, line string"


def _number(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1. Lines of a split come in order, splits of a task one after the other."""
    split, idx, parity, begins = None, 0, 0, [-1, -1]
    for batch in rows:
        path, block = batch.column("path").to_pylist(), batch.column("block").to_pylist()
        quotes = pc.count_substring(batch.column("line"), '"').to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = [0, *(i for i in range(1, len(path)) if block[i] != block[i - 1] or path[i] != path[i - 1]), len(path)]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi == lo:
                continue
            if (path[lo], block[lo]) != split:
                split, idx, parity, begins = (path[lo], block[lo]), 0, 0, [-1, -1]
            after = (parity + np.cumsum(quotes[lo:hi])) % 2
            before = np.concatenate(([parity], after[:-1]))
            number = idx + np.arange(hi - lo)
            last = [np.maximum(np.maximum.accumulate(np.where(before == p, number, -1)), begins[p]) for p in (0, 1)]
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays(
                [part.column("path"), part.column("block"), pa.array(number), pa.array(before.astype(np.int32)),
                 pa.array(quotes[lo:hi].astype(np.int32)), pa.array(last[0]), pa.array(last[1]), part.column("line")],
                names=["path", "block", "idx", "parity", "quotes", "even_begin", "odd_begin", "line"])
            idx, parity, begins = idx + hi - lo, int(after[-1]), [int(last[0][-1]), int(last[1][-1])]


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Step 1 over the files at ``path``. Only line feeds end a line, as within a quoted field
    a carriage return is text."""
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    return raw.mapInArrow(_number, LINES)


def split_states(lines: DataFrame) -> DataFrame:
    """Step 2: per split ``at_begin`` (the parity of all quotes before it in its file) and
    ``open_block``, ``open_idx`` (the line where the record begins that is open there)."""
    splits = lines.groupBy("path", "block").agg(
        F.sum("quotes").alias("quotes"), F.max("even_begin").alias("even_begin"), F.max("odd_begin").alias("odd_begin"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begun = splits.withColumn("at_begin", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).cast("int")).withColumn(
        "own", F.when(F.col("at_begin") == 0, F.col("even_begin")).otherwise(F.col("odd_begin")))
    last = F.last(F.when(F.col("own") >= 0, F.struct("block", "own")), ignorenulls=True).over(before)
    return begun.withColumn("last", last).select("path", "block", "at_begin", F.col("last.block").alias("open_block"),
                                                 F.col("last.own").alias("open_idx"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """Step 3: one row a record: path, block and idx of its first line, and its text."""
    lines = numbered_lines(spark, path)
    placed = lines.join(split_states(lines), ["path", "block"])
    own = F.when(F.col("at_begin") == 0, F.col("even_begin")).otherwise(F.col("odd_begin"))
    begins, whole = own == F.col("idx"), F.col("quotes") % 2 == 0
    one = placed.filter(begins & whole).select("path", "block", "idx", F.col("line").alias("record"))
    key_block = F.when(own >= 0, F.col("block")).otherwise(F.col("open_block"))
    key_idx = F.when(own >= 0, own).otherwise(F.col("open_idx"))
    # a line inside a quoted field never begins a record; one that begins a record and leaves its quotes open goes on
    many = (placed.filter(~(begins & whole))
            .groupBy("path", key_block.alias("rb"), key_idx.alias("ri"))
            .agg(F.array_sort(F.collect_list(F.struct("block", "idx", "line"))).alias("parts"))
            .select("path", F.col("rb").alias("block"), F.col("ri").alias("idx"),
                    F.array_join(F.transform("parts", lambda p: p["line"]), "\n").alias("record")))
    return one.union(many)


def read_csv(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """The rows of CSV files with a header, every column as text: equal to a ``multiLine``
    scan with doubled quotes, but in as many tasks as the files have splits."""
    if quote != '"':
        raise ValueError("quotes are counted as \"")
    options = {"header": "true", "quote": '"', "escape": '"', "mode": "PERMISSIVE", "multiLine": "true"}
    names = spark.read.options(**options).csv(path).columns  # reads one record
    schema = ST.StructType([ST.StructField(n, ST.StringType()) for n in names])
    ddl = ", ".join(f"`{n}` STRING" for n in names)
    text = F.regexp_replace("record", "\r$", "")
    rows = records(spark, path).filter((text != "") & ~((F.col("block") == 0) & (F.col("idx") == 0)))
    parsed = rows.select(F.from_csv(text, ddl, {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "multiLine": "true"}).alias("r"))
    return parsed.select(*[F.col("r").getField(n).alias(n) for n in schema.names])
