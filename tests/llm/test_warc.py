import hashlib
import zlib

import pytest

from loomlog.llm import warc


def pages(spark, rows, more=""):
    return spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING" + more)


def round_trip(spark, df, tmp_path, **options):
    warc.write_archives(df, str(tmp_path / "out"), **options)
    return warc.read_archives(spark, str(tmp_path / "out")).collect()


def test_every_page_comes_back(spark, tmp_path):
    big, other = "x" * 1500 + "é", "y" * 1000
    rows = [
        (1, "http://a/1", big), (2, None, big), (9, "http://a/9\r\nInjected: 1", big), (3, "u", "short"), (4, "u", "short"),
        (5, "u", None), (6, "u", ""), (7, "u", other), (8, "u", "WARC/1.1 \x1f\x8b\x08 inside" + "z" * 2000),
        (None, "u", other), (7, "u", other),
    ]
    df = pages(spark, [r + ("c", "d") for r in rows], ", payload STRING, digest STRING")
    found = round_trip(spark, df, tmp_path, archive_bytes=4000)
    assert not [r for r in found if r.kind == "gap"]
    assert len({r.archive for r in found}) > 1
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.kind, r.refers_to) for r in found), key=str)
    expected = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        same = [i for i, _, h in rows if h == html and i is not None]
        revisit = len(raw) >= 1000 and page_id != max(same)
        expected.append((page_id, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None))
    assert got == sorted(expected, key=str)
    assert {r.url for r in found if r.page_id == 9} == {"http://a/9Injected: 1"}


def test_no_pages(spark, tmp_path):
    assert round_trip(spark, pages(spark, []), tmp_path) == []


def make(i, payload=b"p" * 50):
    return warc.record(i, f"http://x/{i}", payload, hashlib.sha1(payload).hexdigest(), None, False)


def ids(found):
    return [int(f.headers["warc-record-id"].strip("<>").rpartition(":")[2]) for f in found if f.problem is None]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_goes_on_after_damage(packed):
    parts = [warc.member(make(i)) if packed else make(i) for i in range(6)]
    whole = b"".join(parts)
    assert ids(warc.salvage(whole)) == list(range(6))
    starts = [sum(map(len, parts[:i])) for i in range(7)]
    broken = bytearray(whole)
    broken[starts[3] - 10] ^= 0x55
    broken[starts[3] + 1] ^= 0xFF
    found = list(warc.salvage(bytes(broken)))
    assert ids(found) == [0, 1, 4, 5]
    (gap,) = [f for f in found if f.problem]
    assert (gap.position, gap.position + gap.length) == (starts[2], starts[4])
    cut = list(warc.salvage(whole[: starts[5] + 20]))
    assert ids(cut) == [0, 1, 2, 3, 4] and cut[-1].problem and cut[-1].length == 20
    noise = list(warc.salvage(b"noise" + whole))
    assert ids(noise) == list(range(6)) and noise[0].length == 5
    assert list(warc.salvage(b"")) == [] and ids(warc.salvage(whole + b"\x00" * 20)) == list(range(6))


def test_a_wrong_digest_and_a_wrong_length_are_quarantined():
    wrong = make(1).replace(b"sha1:", b"sha1:0", 1)
    long = make(2).replace(b"Content-Length: ", b"Content-Length: 9", 1)
    found = list(warc.salvage(make(0) + wrong + long + make(3)))
    assert ids(found) == [0, 3] and sum(f.length for f in found if f.problem) == len(wrong) + len(long)


def test_members_end_in_zero():
    for raw in (b"", b"a", b"x" * 70_000):
        data = warc.member(raw)
        assert data[-1] == 0 and zlib.decompressobj(31).decompress(data) == raw
