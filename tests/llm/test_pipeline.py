"""Every stage of the pipeline against a plain version of it on the stage's own input."""

import hashlib
import random
from collections import Counter, defaultdict

import corpus_pipeline
from quaestio.llm import quality
from quaestio.llm.words import words

from .test_jaccard import brute_roots
from .test_line_dedup import brute as line_brute
from .test_mixing import water_fill
from .test_packing import check as check_packing
from .test_text_operators import plain_counts, prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, size string, key string, votes string, row_id string"


def row(doc_id, text, source="s"):
    return (doc_id, text, "aa", source, None if text is None else len(text), "own", "own", "own", "own", "own")


def odd(at):
    """Rows that the stages before may have dropped, put into every stage's input."""
    return [row(at, None), row(at + 1, ""), row(at + 2, " \n\t", None), row(at + 3, "two words", "t"), row(None, f"without an id {at}", "t")]


def plain_quality(rows):
    votes = [quality.vote(quality.measure(r[1] or "")[1]) for r in rows]
    by = Counter(votes)
    model = quality.LabelModel(sorted(by), quality.np.array([by[p] for p in sorted(by)]))
    out = []
    for r, v in zip(rows, votes):
        n, _, _, _, repeat = plain_counts(r[1] or "")
        if n >= 50 and 2 * repeat <= n and model.posterior(v) >= 0.5:
            out.append(r)
    return out


def plain_lines(rows):
    left, out = line_brute(rows, 2, 32), []
    for r in rows:
        text = r[1] if r[1] is None else left[r[:2]]
        if text == r[1]:
            out.append(r)
        elif words(text):
            out.append((r[0], text, *r[2:4], len(text), *r[5:]))
    return out


def plain_near(rows):
    group, out, seen = brute_roots(rows, 5, 4, 5), [], set()
    for i, r in enumerate(rows):
        if i not in group:
            out.append(r)
        elif r[0] == min((rows[j][0] for j in group[i]), key=lambda d: (d is None, d or 0)) and id(group[i]) not in seen:
            seen.add(id(group[i]))
            out.append(r)
    return out


def plain_mix(rows):
    by = defaultdict(list)
    for r in rows:
        n = len(words(r[1] or ""))
        name = f"mix:{'null' if r[0] is None else r[0]}:{n}"
        by[r[3]].append((int(hashlib.md5(name.encode()).hexdigest()[:15], 16), n, r))
    sizes = {s: sum(n for _, n, _ in x) for s, x in by.items()}
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    target = water_fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values()), 2)
    out = []
    for s, x in by.items():
        passes = int(target[s] + 1e-9) // sizes[s] if sizes[s] else 0
        rest, start = int(target[s] + 1e-9) - passes * sizes[s], 0
        for _, n, r in sorted(x, key=lambda y: y[0]):
            part = max(0, min(n, rest - start))
            out += [r] * (passes + (start < rest if not n else 2 * part >= n))
            start += n
    return out


PLAIN = [plain_quality, plain_lines, plain_near, plain_mix]


def fixture():
    rnd, rows = random.Random(8), []
    for i in range(40):
        text = prose(rnd, rnd.choice(["aa", "bb", "cc"]), rnd.randint(70, 160))
        rows.append(row(i, text, "stu"[i % 3] if i % 7 else None))
    for i in range(8):  # near copies: every line misses its near line by more than 2 edits, 1 to 8 words differ
        w = rows[i][1].replace(".\n", ". ").split(" ")
        for at in range(i + 1):
            w[at * len(w) // 8] = "another"
        rows.append(row(100 + i, " ".join(w)))
    rows += [row(200 + i, "the first line of this text is short here\n" + rows[10 + i][1]) for i in range(3)]  # repeated lines
    rows += [row(300 + i, " | ".join(rows[20 + i][1].split())) for i in range(4)]  # junk
    return [*rows, rows[5], rows[5], row(None, rows[6][1])]


def test_stages_against_plain_versions(spark):
    rows, changed = fixture(), 0
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = rows + odd(1000 + 10 * k)
        got = stage(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "")
        if k == len(PLAIN):
            check_packing(rows_by_copy(rows), got.collect())
            break
        assert got.columns == [x.split()[0] for x in SCHEMA.split(", ")], name
        got, want = [tuple(r) for r in got.collect()], PLAIN[k](rows)
        assert Counter(got) == Counter(want), name
        changed += Counter(want) != Counter(rows)
        rows = sorted(got, key=str)
    assert changed == len(PLAIN)  # the fixture gives every stage something to do


def rows_by_copy(rows):
    return [(r[0], r[1]) for r in rows]


def test_empty_table(spark):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], SCHEMA), "").count() == 0, name
