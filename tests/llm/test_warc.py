"""WARC round trip, and salvage of damaged archives."""

import gzip
import random
from collections import Counter

from quaestio.llm import warc as W

SCHEMA = "page_id long, url string, html string, first long, value string"


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(W, "ARCHIVE_BYTES", 3000)
    html = ["<p>one</p>", "", "zwei ü", "x" * 5000, "a\0b\r\n\r\nWARC/1.1\r\nc", "\x1f\x8b\x08"]
    rows = [(i, f"http://h/{i} ü", html[i % 6], None, None) for i in range(40)]
    rows += [(100, None, None, None, None), (None, "u", "lone", None, None), (None, "u", "zwei ü", None, None), rows[3], rows[0]]
    got = W.round_trip(spark.createDataFrame(rows, SCHEMA)).collect()
    least = {}
    for i, _, h, *_ in rows:
        if i is not None:
            least[h or ""] = min(least.get(h or "", i), i)
    want = []
    for i, _, h, *_ in rows:
        data, first = (h or "").encode(), least.get(h or "")
        again = first is not None and i != first
        want.append((i, len(data), W.sha1(data), "revisit" if again else "response", first if again else None))
    assert Counter(tuple(r) for r in got) == Counter(want)


def test_least_bytes(spark):
    rows = [(1, "u", "ab", None, None), (2, "u", "ab", None, None), (3, "u", "abcdef", None, None), (4, "u", "abcdef", None, None)]
    got = {r.page_id: r.record_type for r in W.round_trip(spark.createDataFrame(rows, SCHEMA), 5).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_empty(spark):
    assert W.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def archive(n=12, zipped=True):
    parts = [W.record(i, f"http://x/{i}", (f"page {i} " * 50).encode(), None, False) for i in range(n)]
    return [W.member(p) + b"\0" if zipped else p for p in parts]


def ids(data):
    found = list(W.salvage(data))
    names = [W._page(r.headers["warc-record-id"]) for r in found if not r.is_gap]
    return [int(x) for x in names if x.isdigit()], [(r.offset, r.end) for r in found if r.is_gap]


def test_members_are_gzip():
    parts = archive()
    assert gzip.decompress(b"".join(parts)).count(b"WARC/1.1") == 12
    assert ids(b"".join(parts)) == (list(range(12)), [])
    odd = W.member(b"y" * (1 << 24)) + b"\0"
    assert gzip.decompress(odd) == b"y" * (1 << 24)


def test_salvage():
    rnd = random.Random(1)
    for zipped in (True, False):
        parts = archive(zipped=zipped)
        ends = [sum(map(len, parts[:i])) for i in range(13)]
        whole = b"".join(parts)
        # a flipped byte in record 3, record 6 cut in half, junk before record 9, a cut end
        for _ in range(30):
            at = rnd.randrange(ends[3] + 12, ends[4] - 6)
            data = bytearray(whole)
            data[at] ^= 0x55
            good, gaps = ids(bytes(data))
            assert set(good) >= set(range(12)) - {3} and (gaps == [] or gaps[0][0] == ends[3] and gaps[-1][1] <= ends[4])
        data = b"".join(parts[:6]) + parts[6][:len(parts[6]) // 2] + b"".join(parts[7:9]) + b"junk \x1f\x8b\x08 junk" + b"".join(parts[9:])
        good, gaps = ids(data)
        assert good == [0, 1, 2, 3, 4, 5, 7, 8, 9, 10, 11]
        assert gaps[0] == (ends[6], ends[6] + len(parts[6]) // 2) and len(gaps) == 2
        assert gaps[1][1] - gaps[1][0] == len(b"junk \x1f\x8b\x08 junk")
        # the last record is whole if only the end of its member is cut
        for cut, last in ((9, zipped), (len(parts[11]) - 40, False)):
            good, gaps = ids(whole[:-cut])
            assert good == list(range(12 if last else 11)) and gaps == [(ends[11], len(whole) - cut)]
    assert list(W.salvage(b"")) == []


def test_salvage_inside_a_member():
    parts = archive(6, zipped=False)
    at = parts[3].index(b"page 3 page 3")
    broken = parts[:3] + [parts[3][:at] + b"PAGE" + parts[3][at + 4:]] + parts[4:]
    inner = [sum(map(len, broken[:i])) for i in range(7)]
    one, before, behind = gzip.compress(b"".join(broken)), gzip.compress(b"".join(parts[:2])), gzip.compress(parts[5])
    # one wrong digest among six records of a member: the other five stay
    found = list(W.salvage(before + one + behind))
    assert [int(W._page(r.headers["warc-record-id"])) for r in found if not r.is_gap] == [0, 1, 0, 1, 2, 4, 5, 5]
    gap, = (r for r in found if r.is_gap)
    assert (gap.offset, gap.end, gap.inner, gap.inner_end) == (len(before), len(before) + len(one), inner[3], inner[4]) and "digest" in gap.reason
    # without compression the same
    assert ids(b"".join(broken)) == ([0, 1, 2, 4, 5], [(inner[3], inner[4])])
    # a member that breaks off or breaks: its first records and the members behind it stay
    rnd = random.Random(2)
    whole = gzip.compress(b"".join(W.record(i, "u", rnd.randbytes(3000), None, False) for i in range(8)))
    for k in (len(whole) // 2, len(whole) * 3 // 4):
        for data in (whole[:k], whole[:k] + behind, whole[:k] + rnd.randbytes(50) + whole[k + 50:] + behind):
            good, gaps = ids(data)
            assert good[:3] == [0, 1, 2] and good[-1] == (5 if len(data) > k else good[-1])
            assert gaps[0][0] == 0 and gaps[0][1] == (len(data) - len(behind) if len(data) > k else len(data))


def test_read_logs_gaps(spark, tmp_path):
    parts = archive()
    (tmp_path / "a.warc").write_bytes(b"".join(archive(zipped=False)[:3]) + b"WARC/1.1\r\nbroken")
    (tmp_path / "b.warc.gz").write_bytes(parts[0] + parts[1][5:] + parts[2])
    rows = W.read(spark, str(tmp_path)).collect()
    assert Counter(r.is_gap for r in rows) == {False: 5, True: 2}
    gap = next(r for r in rows if r.is_gap and r.path.endswith("gz"))
    assert (gap.offset, gap.gap_end) == (len(parts[0]), len(parts[0]) + len(parts[1]) - 5) and gap.reason
