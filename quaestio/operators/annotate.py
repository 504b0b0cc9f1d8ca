"""Annotator hook (L0) and the last-sentence rule.

A parse is ``array<array<token>>``: the sentences an annotator finds in a text, each a
token array (D4) whose ``idx`` is relative to that text. Parses enter in one of four
ways:

* :func:`annotate_with_lookup` — an equi-join with a table of precomputed parses keyed
  by ``(language, text)``; Catalyst picks broadcast or sort-merge from the table's size.
* :func:`annotate_with_python` — ``mapInArrow`` with a provider object created once
  per Python worker (e.g. a statistical parser); Arrow batches, no per-row UDF calls.
* :func:`annotate_with_expression` — any Column-building parse function (JVM-side).

* :func:`annotate_with_cache` — a stored table of parses that is filled by a provider with
  the texts it does not hold yet, then looked up.

All of them then apply G4 the same way: keep only the last sentence; when there were
several, its text replaces the question text, the offset moves by its start, and the
text is parsed again on its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql.pandas.types import to_arrow_type

from quaestio.operators.tokens import TOKEN_TYPE, TOKENS_TYPE

PARSE_TYPE = ST.ArrayType(TOKENS_TYPE)


def sentence_text(text: Column, sentence: Column) -> Column:
    """Text of one parsed sentence: from its first token's start to its last token's end."""
    first = F.get(sentence, 0)
    last = F.try_element_at(sentence, F.lit(-1))
    start = first["idx"]
    end = last["idx"] + F.length(last["text"])
    return text.substr(start + 1, end - start)


def keep_last_sentence(df: DataFrame, parse_col: str, reparse: Callable[[Column, Column], Column],
                       text_col: str = "text", language_col: str = "language", offset_col: str = "offset",
                       tokens_col: str = "tokens") -> DataFrame:
    """G4 (Q7): only the last sentence survives; re-parse it alone when it was not the only one."""
    p = F.col(parse_col)
    multi = F.size(p) > 1
    last = F.try_element_at(p, F.lit(-1))
    out = (df.withColumn("_multi", multi)
           .withColumn("_shift", F.when(multi, F.get(last, 0)["idx"]).otherwise(F.lit(0)))
           .withColumn(text_col, F.when(multi, sentence_text(F.col(text_col), last)).otherwise(F.col(text_col))))
    if offset_col in df.columns:
        out = out.withColumn(offset_col, F.col(offset_col) + F.col("_shift"))
    reparsed = F.try_element_at(reparse(F.col(text_col), F.col(language_col)), F.lit(-1))
    return (out.withColumn(tokens_col, F.when(F.col("_multi"), reparsed).otherwise(last))
            .drop("_multi", "_shift", parse_col))


def annotate_with_expression(df: DataFrame, parse: Callable[[Column, Column], Column],
                             text_col: str = "text", language_col: str = "language") -> DataFrame:
    """L0 with a JVM-side parse function, then G4. In single-sentence mode ``parse`` gives one sentence."""
    parsed = df.withColumn("_parse", parse(F.col(text_col), F.col(language_col)))
    return keep_last_sentence(parsed, "_parse", parse, text_col, language_col)


def annotate_with_lookup(df: DataFrame, parses: DataFrame, text_col: str = "text",
                         language_col: str = "language", single_sentence: bool = False) -> DataFrame:
    """L0 from a parse table ``(language, text, parse)``, then G4 (a second lookup of the
    last sentence's text when needed). A key with several parses counts once; a text
    without a parse keeps its row, with NULL tokens. A table that holds parses of both modes
    tells them apart by a column ``single_sentence``; in single-sentence mode a parse of
    several sentences does not count."""
    if "single_sentence" in parses.columns:
        parses = parses.filter(F.col("single_sentence") == single_sentence)
    elif single_sentence:
        parses = parses.filter(F.size("parse") == 1)
    table = (parses.select(F.col("language").alias("_pl"), F.col("text").alias("_pt"), F.col("parse").alias("_parse"))
             .dropDuplicates(["_pl", "_pt"]))
    joined = df.join(table, (F.col(language_col) == F.col("_pl")) & (F.col(text_col) == F.col("_pt")), "left").drop("_pl", "_pt")
    multi = F.coalesce(F.size(F.col("_parse")) > 1, F.lit(False))
    last = F.try_element_at(F.col("_parse"), F.lit(-1))
    staged = (joined.withColumn("_multi", multi)
              .withColumn("_shift", F.when(multi, F.get(last, 0)["idx"]).otherwise(F.lit(0)))
              .withColumn(text_col, F.when(multi, sentence_text(F.col(text_col), last)).otherwise(F.col(text_col)))
              .withColumn("_last", last))
    if "offset" in df.columns:
        staged = staged.withColumn("offset", F.col("offset") + F.col("_shift"))
    again = table.select(F.col("_pl").alias("_rl"), F.col("_pt").alias("_rt"),
                         F.try_element_at(F.col("_parse"), F.lit(-1)).alias("_reparsed"))
    cond = F.col("_multi") & (F.col(language_col) == F.col("_rl")) & (F.col(text_col) == F.col("_rt"))
    return (staged.join(again, cond, "left")
            .withColumn("tokens", F.when(F.col("_multi"), F.col("_reparsed")).otherwise(F.col("_last")))
            .drop("_multi", "_shift", "_last", "_parse", "_rl", "_rt", "_reparsed"))


class ParseProvider:
    """Interface of a Python-side annotator: ``parse(texts, language)`` returns, per text,
    a list of sentences, each a list of token dicts with the D4 fields. A factory for
    single-sentence mode gives a provider that returns one sentence a text."""

    def parse(self, texts: list[str], language: str) -> list[list[list[dict]]]:  # pragma: no cover
        raise NotImplementedError


def parse_key(language: Column, text: Column) -> Column:
    """The 128-bit key of a text in a language."""
    return F.md5(F.concat_ws("\u0001", F.coalesce(language, F.lit("")), F.coalesce(text, F.lit(""))))


def parse_texts(texts: DataFrame, provider_factory: Callable[[], ParseProvider]) -> DataFrame:
    """``texts`` (key, language, text) with their parses, whole (every sentence)."""
    key = hashlib.sha256(cloudpickle.dumps(provider_factory)).hexdigest()
    schema = ST.StructType([*texts.schema.fields, ST.StructField("parse", PARSE_TYPE)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = _worker_provider(key, provider_factory)
        for pdf in batches:
            parses: list = [None] * len(pdf)
            for lang, idx in pdf.groupby("language").indices.items():
                for k, sentences in zip(idx, provider.parse([pdf["text"].iloc[i] for i in idx], lang)):
                    parses[k] = sentences or None
            yield pdf.assign(parse=parses)
    return texts.mapInPandas(run, schema)


def fill_parse_cache(df: DataFrame, path: str, provider_factory: Callable[[], ParseProvider], text_col: str = "text",
                     language_col: str = "language", single_sentence: bool = False) -> int:
    """Parse the texts of ``df`` that the table at ``path`` does not hold yet, and, where a parse
    has several sentences, the text of the last one (G4); append them. Returns how many
    texts were parsed. The table is ``(key, language, text, parse)``, partitioned by
    ``single_sentence``; texts are matched by their 128-bit key."""
    spark = df.sparkSession
    asked = df.select(F.col(language_col).alias("language"), F.col(text_col).alias("text")).filter("language IS NOT NULL AND text IS NOT NULL")
    parsed = 0
    for _ in range(2):
        known = read_parse_cache(spark, path)
        wanted = asked.withColumn("key", parse_key(F.col("language"), F.col("text"))).dropDuplicates(["key"]).select("key", "language", "text")
        if known is not None:
            wanted = wanted.join(known.filter(F.col("single_sentence") == single_sentence).select("key"), "key", "left_anti")
        done = Observation()
        (parse_texts(wanted, provider_factory).withColumn("single_sentence", F.lit(single_sentence))
         .observe(done, F.count(F.lit(1)).alias("n")).write.mode("append").partitionBy("single_sentence").parquet(path))
        parsed += done.get["n"]
        if single_sentence:
            break
        # the last sentences of parses with several
        last = F.try_element_at("parse", F.lit(-1))
        asked = (asked.withColumn("key", parse_key(F.col("language"), F.col("text"))).select("key").distinct()
                 .join(read_parse_cache(spark, path).filter((F.col("single_sentence") == single_sentence) & (F.size("parse") > 1)), "key")
                 .select("language", sentence_text(F.col("text"), last).alias("text")))
    return parsed


def read_parse_cache(spark, path: str) -> DataFrame | None:
    """The cache table, None before its first parses."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        return None
    schema = ST.StructType([ST.StructField("key", ST.StringType()), ST.StructField("language", ST.StringType()),
                            ST.StructField("text", ST.StringType()), ST.StructField("parse", PARSE_TYPE),
                            ST.StructField("single_sentence", ST.BooleanType())])
    return spark.read.schema(schema).parquet(path)


def annotate_with_cache(df: DataFrame, path: str, provider_factory: Callable[[], ParseProvider], text_col: str = "text",
                        language_col: str = "language", single_sentence: bool = False) -> DataFrame:
    """L0 through a table of parses that grows: texts it does not hold are parsed once and
    appended, then all rows look theirs up (and G4 follows). A later run over the same texts
    parses nothing."""
    fill_parse_cache(df, path, provider_factory, text_col, language_col, single_sentence)
    return annotate_with_lookup(df, read_parse_cache(df.sparkSession, path), text_col, language_col, single_sentence)


#: Rows whose parses are held at a time.
PARSED_ROWS = 1024


def _token_arrays(tokens: list[list[dict] | None]) -> pa.Array:
    """Token lists as one Arrow column, field by field; tokens that share a morphology object share its map."""
    flat = [t for own in tokens if own is not None for t in own]
    known: dict[int, int] = {}
    maps = [t.get("morph") for t in flat]
    places = [known.setdefault(id(m), len(known)) for m in maps]
    first = dict(zip(map(id, maps), maps))
    fields = {}
    for field in TOKEN_TYPE.fields:
        kind = to_arrow_type(field.dataType)
        if field.name == "morph":
            distinct = pa.array([None if m is None else list(m.items()) for m in (first[k] for k in known)], kind)
            fields[field.name] = distinct.take(pa.array(places, pa.int32()))
        else:
            fields[field.name] = pa.array([t.get(field.name) for t in flat], kind)
    structs = pa.StructArray.from_arrays(list(fields.values()), fields=[pa.field(n, a.type) for n, a in fields.items()])
    ends = np.cumsum([0, *(len(own or ()) for own in tokens)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs, mask=pa.array([own is None for own in tokens], pa.bool_()))


def parse_last_sentences(provider: ParseProvider, texts: list[str | None], languages: list[str | None]) -> tuple[list, list[int]]:
    """L0 and G4 for a batch: per text the tokens of its last sentence (None without a parse or a language), and how
    far the text's start moved. ``texts`` gets the shortened texts."""
    tokens: list = [None] * len(texts)
    shifts = [0] * len(texts)
    by_language: dict[str, list[int]] = {}
    for k, lang in enumerate(languages):
        if lang is not None:
            by_language.setdefault(lang, []).append(k)
    for lang, idx in by_language.items():
        redo = []
        for k, sents in zip(idx, provider.parse([texts[k] for k in idx], lang)):
            if not sents:
                continue
            last = sents[-1]
            tokens[k] = last
            if len(sents) > 1:
                start = last[0]["idx"]
                end = last[-1]["idx"] + len(last[-1]["text"])
                texts[k] = texts[k][start:end]
                shifts[k] = start
                redo.append(k)
        if redo:
            again = provider.parse([texts[k] for k in redo], lang)
            for k, sents in zip(redo, again):
                tokens[k] = sents[-1] if sents else None
    return tokens, shifts


def parsed_columns(provider: ParseProvider, batch: pa.RecordBatch, text_col: str, language_col: str) -> tuple[dict, list, list, list]:
    """A batch's columns behind L0 and G4 (text and offset replaced), with its languages, texts and tokens as lists."""
    columns = dict(zip(batch.schema.names, batch.columns))
    texts, languages = columns[text_col].to_pylist(), columns[language_col].to_pylist()
    tokens, shifts = parse_last_sentences(provider, texts, languages)
    columns[text_col] = pa.array(texts, columns[text_col].type)
    if "offset" in columns:
        columns["offset"] = pc.add(columns["offset"], pa.array(shifts, columns["offset"].type))
    return columns, languages, texts, tokens


def in_parsed_batches(df: DataFrame, provider_factory: Callable[[], ParseProvider], schema: ST.StructType,
                      work: Callable[[ParseProvider, pa.RecordBatch], pa.RecordBatch], provider_key: str | None = None) -> DataFrame:
    """``work`` over the rows in batches of PARSED_ROWS, with the worker's provider. Workers tell providers apart by
    ``provider_key``, by default a hash of the pickled factory, so two factories never share an instance."""
    key = provider_key or hashlib.sha256(cloudpickle.dumps(provider_factory)).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = _worker_provider(key, provider_factory)
        for batch in batches:
            for lo in range(0, batch.num_rows, PARSED_ROWS):
                yield work(provider, batch.slice(lo, PARSED_ROWS))
    return df.mapInArrow(run, schema)


def annotate_with_python(df: DataFrame, provider_factory: Callable[[], ParseProvider],
                         text_col: str = "text", language_col: str = "language",
                         provider_key: str | None = None) -> DataFrame:
    """L0 through ``mapInArrow``: the provider is built once per worker process and
    called once per language and PARSED_ROWS rows; G4 runs in the same pass (it needs the
    provider again for the re-parse). Only text and language become Python objects, other columns
    pass as Arrow columns."""
    out_schema = ST.StructType(list(df.schema.fields) + [ST.StructField("tokens", TOKENS_TYPE)])

    def parsed(provider: ParseProvider, batch: pa.RecordBatch) -> pa.RecordBatch:
        columns, _, _, tokens = parsed_columns(provider, batch, text_col, language_col)
        columns["tokens"] = _token_arrays(tokens)
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    return in_parsed_batches(df, provider_factory, out_schema, parsed, provider_key)


class PythonAnnotator:
    """:func:`annotate_with_python` with its provider, as a step ``DataFrame -> DataFrame``.
    :func:`quaestio.operators.rules.classified` classifies in the same pass."""

    def __init__(self, provider_factory: Callable[[], ParseProvider]):
        self.provider_factory = provider_factory

    def __call__(self, df: DataFrame) -> DataFrame:
        return annotate_with_python(df, self.provider_factory)


#: Providers built in this worker, by the key of their factory; the oldest goes first.
_PROVIDERS: dict[str, ParseProvider] = {}
KEPT_PROVIDERS = 4


def _worker_provider(key: str, factory: Callable[[], ParseProvider]) -> ParseProvider:
    if key not in _PROVIDERS:
        while len(_PROVIDERS) >= KEPT_PROVIDERS:
            del _PROVIDERS[next(iter(_PROVIDERS))]
        _PROVIDERS[key] = factory()
    return _PROVIDERS[key]
