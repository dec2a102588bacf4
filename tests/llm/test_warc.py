import hashlib

import pytest

from jobloom.llm import warc
from jobloom.session import fresh_path

BIG = "<p>" + "héllo " * 300 + "</p>"


def roundtrip(spark, rows, schema="page_id long, url string, html string, payload string"):
    path = fresh_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(rows, schema), path)
    return path, warc.read_archives(spark, path)


def test_revisits_ties_nulls(spark):
    rows = [(1, "http://a/\r\nx y", BIG, "c"), (5, None, BIG, None), (3, "u", BIG, ""), (5, "again", BIG, "z"),
            (7, "u", None, ""), (8, "u", "", ""), (9, "u", "small", ""), (10, "u", "small", ""), (None, "u", BIG, ""),
            (11, "w", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 40, "")]
    _, read = roundtrip(spark, rows)
    assert warc.gaps(read).count() == 0
    got = sorted((r.record_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in read.collect())
    digest = lambda s: hashlib.sha1((s or "").encode()).hexdigest()
    want = []
    for i, _, html, _ in rows:
        kind = "revisit" if html == BIG and i != 5 else "response"
        want.append((warc.page_urn(i), kind, "urn:page:5" if kind == "revisit" else None, len((html or "").encode()), digest(html)))
    assert got == sorted(want, key=str)
    stored = {r.record_id: bytes(r.payload) for r in read.collect() if r.record_type == "response"}
    assert stored["urn:page:11"] == rows[-1][2].encode() and stored["urn:page:5"] == BIG.encode()


def test_empty_table(spark):
    _, read = roundtrip(spark, [])
    assert read.count() == 0


def plain(n):
    return [warc.record("response", f"urn:page:{i}", "u", "2026-01-01T00:00:00Z", hashlib.sha1(b"payload %d" % i).hexdigest(), 9, None,
                        b"payload %d" % i) for i in range(n)]


@pytest.mark.parametrize("packed", [False, True])
def test_salvage_after_damage(packed):
    members = [warc._gzip(r) for r in plain(6)] if packed else plain(6)
    damaged = bytearray(members[2])
    damaged[len(damaged) - 12] ^= 0xFF
    cut = members[4][:len(members[4]) // 2]
    data = b"junk" + members[0] + members[1] + bytes(damaged) + members[3] + cut + members[5] + b"tail"
    found = list(warc.salvage(data))
    ids = [f.headers["warc-record-id"] for f in found if not f.reason]
    assert ids == [f"<urn:page:{i}>" for i in (0, 1, 3, 5)]
    lost = [(f.offset, f.length) for f in found if f.reason]
    a, b = 4 + len(members[0]) + len(members[1]), len(members[3])
    assert lost == [(0, 4), (a, len(damaged)), (a + len(damaged) + b, len(cut)), (len(data) - 4, 4)]


def test_damage_inside_a_member_and_wrong_digest():
    bad = plain(1)[0].replace(b"payload 0", b"payloaX 0")
    data = warc._gzip(plain(2)[1] + bad + plain(3)[2]) + b"\0\0" + warc._gzip(b"no records here")
    found = list(warc.salvage(data))
    assert [f.reason for f in found] == [None, "payload digest", None, "member without records"]
    assert found[1].inner == len(plain(2)[1]) and found[1].length == len(bad)


def test_every_byte_is_in_a_record_or_a_gap():
    import random
    source = b"".join(plain(8))
    for seed in range(30):
        r, data = random.Random(seed), bytearray(source)
        for _ in range(r.randint(1, 4)):
            at = r.randrange(len(data))
            del data[at:at + r.randint(0, 40)]
        at = 0
        for f in warc.salvage(bytes(data)):
            assert f.offset == at
            at += f.length
        assert at == len(data)


def test_records_before_the_damage_of_a_member():
    whole = warc._gzip(b"".join(plain(100)))
    found = list(warc.salvage(whole[:-20] + warc._gzip(plain(1)[0])))
    good = [f for f in found if not f.reason]
    # the end of the member is lost, with the record that lay there
    assert [f.headers["warc-record-id"] for f in good] == [f"<urn:page:{i}>" for i in (*range(len(good) - 1), 0)] and len(good) in (99, 100)
    assert [(f.offset, f.length, f.reason) for f in found if f.reason] == [(0, len(whole) - 20, "damaged member")]
    flipped = bytearray(whole)
    flipped[len(whole) // 2] ^= 0xFF
    good = [f for f in warc.salvage(bytes(flipped)) if not f.reason]
    assert 10 < len(good) < 100 and all(f.payload == b"payload %d" % i for i, f in enumerate(good))
