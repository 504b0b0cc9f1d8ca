"""Decontamination against a plain search for every phrase in every document."""

import hashlib
import random
import re

import numpy as np
import pytest

from quaestio.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, item_id string, spans string, n_words string"
ITEMS = "item_id {}, text string, doc_id string, items string"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def phrases(text, width):
    w = words(text)
    return [w[i:i + width] for i in range(max(len(w) - width + 1, 1))] if w else []


def plain(rows, items, width=D.WIDTH):
    out = []
    for doc, text, *_ in rows:
        w, hit, names = words(text), set(), set()
        for item, t, *_ in items:
            for p in phrases(t, width):
                for i in range(len(w) - len(p) + 1):
                    if w[i:i + len(p)] == p:
                        hit.update(range(i, i + len(p)))
                        names.add("" if item is None else str(item))
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=repr)


def tables(seed, id_type):
    rnd = random.Random(seed)
    vocabulary = ["a", "b", "Été", "日本", "c3", "D", "ee"]
    sep = [" ", ", ", "-", "\n", " ' "]

    def text(n, words=vocabulary):
        return "".join(rnd.choice(words) + rnd.choice(sep) for _ in range(n))
    make = int if id_type == "long" else str
    items = [(make(i), text(rnd.choice([1, 3, 9, 10, 11, 14, 40])), None, None) for i in range(25)]
    items += [(None, text(12), None, None), (make(3), text(12), None, None), (make(50), "", None, None), (make(51), None, None, None),
              (make(52), "...", None, None), items[4], (make(100), "same same same same same same same same same same same", None, None)]
    rows = []
    for i in range(120):
        parts = [text(rnd.randrange(30), [*vocabulary, "other", "words", "of", "prose"])]
        if i % 2:
            parts += [" ", rnd.choice(items)[1] or "", " "]
        parts.append(text(rnd.randrange(20), ["plain", "words", "a"]))
        rows.append((i, "".join(parts), None, None, None))
    rows += [(None, rows[1][1], None, None, None), rows[1], rows[1], (200, None, None, None, None), (201, "", None, None, None),
             (202, "same " * 3000, None, None, None), (203, "a b " * 4000 + (items[0][1] or ""), None, None, None)]
    return rows, items


@pytest.mark.parametrize("seed,id_type", [(1, "long"), (2, "string")])
def test_report(spark, monkeypatch, seed, id_type):
    monkeypatch.setattr(D, "CHUNK", 24)
    rows, items = tables(seed, id_type)
    docs, bench = spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(items, ITEMS.format(id_type))
    assert got(D.report(docs, bench)) == plain(rows, items)


def test_blocks_give_the_same(spark):
    rows, items = tables(3, "string")
    docs, bench = spark.createDataFrame(rows, DOCS).repartition(2), spark.createDataFrame(items, ITEMS.format("string"))
    a, b = (sorted(((r.doc_id, r.n_words, r.spans, r["items"]) for r in D.find(docs, bench, block_bytes=x).collect()), key=repr)
            for x in (1 << 20, 1 << 10))
    assert a == b


def test_parts_overlap():
    rnd = random.Random(4)
    for _ in range(200):
        counts = [rnd.choice([0, 1, 5, 30, 100]) for _ in range(8)]
        ends, size, width = np.cumsum(counts), rnd.choice([8, 25, 60]), 5
        n = int(ends[-1])
        got = list(D.parts(ends, n, size, width))
        seen = {i for a, b in got for i in range(a, b - width + 1)}
        doc = np.searchsorted(ends, np.arange(n), side="right")
        assert all(i in seen for i in range(n - width + 1) if doc[i] == doc[i + width - 1])
        assert all(b - a <= size for a, b in got) and {i for a, b in got for i in range(a, b)} == set(range(n))


def test_long_text_in_parts(monkeypatch):
    rows, items = tables(5, "string")
    import pyarrow as pa
    phrases_ = D.Phrases([x[0] or "" for x in items], D.texts(pa.array([x[1] for x in items])), D.WIDTH)
    column = D.texts(pa.array([r[1] for r in rows]))
    batch = pa.RecordBatch.from_arrays([pa.nulls(len(rows), pa.binary()), pa.nulls(len(rows), pa.list_(pa.string()))], names=["spans", "items"])
    whole = D._shard(column, batch, phrases_)
    monkeypatch.setattr(D, "SHARD_WORDS", 50)
    cut = D._shard(column, batch, phrases_)
    assert whole[1:] == cut[1:]


def test_remove(spark):
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(1, f"Keep, this! {item.title()}. And - this", None, None, None), (2, "clean text\n", None, None, None), (3, None, None, None, None),
            (4, f"{item} x {item}", None, None, None)]
    out = D.remove(spark.createDataFrame(rows, DOCS), spark.createDataFrame([("q", item, None, None)], ITEMS.format("string")))
    assert {r.doc_id: r.text for r in out.collect()} == {1: "Keep, this! . And - this", 2: "clean text\n", 3: None, 4: " x "}


def test_empty_tables(spark):
    rows, items = tables(6, "string")
    none, bench = spark.createDataFrame([], DOCS), spark.createDataFrame(items, ITEMS.format("string"))
    assert D.report(none, bench).count() == 0
    empty = spark.createDataFrame([], ITEMS.format("string"))
    assert got(D.report(spark.createDataFrame(rows[:5], DOCS), empty)) == plain(rows[:5], [])
