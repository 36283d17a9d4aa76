import base64
import hashlib
import random
import zlib

from gridloom.llm import warc


def gz(data):
    z = zlib.compressobj(6, wbits=31)
    return z.compress(data) + z.flush()


def told(data):
    out = warc.salvage(warc.Source(lambda n, pos: bytes(data[pos : pos + n]), len(data)))
    return [(f["page_id"] if kind == "record" else "gap", start, end) for kind, f, start, end in out]


def test_round_trip(spark):
    rows = [(1, "http://a/1", "<p>same</p>"), (2, "http://a/2\r\nX: y", "<p>same</p>"), (3, None, None), (4, "u", ""), (5, "u", "é" * 3000), (6, "u", "<p>same</p>"), (6, "u", "<p>same</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    last = {"<p>same</p>": 6, "": 4, "é" * 3000: 5}
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if last[h or ""] == i else "revisit", None if last[h or ""] == i else last[h or ""]))
    assert sorted(map(tuple, warc.round_trip(pages).collect()), key=str) == sorted(want, key=str)
    assert {r.record_type for r in warc.round_trip(pages, min_bytes=10**6).collect()} == {"response"}
    assert warc.round_trip(pages.limit(0)).collect() == []
    back = {r.page_id: r for r in warc.read(warc.write(pages), with_payload=True).collect()}
    assert bytes(back[5].payload).decode() == "é" * 3000 and back[2].url == "http://a/2\r\nX: y" and back[3].url is None


def test_salvage_of_compressed_members():
    members = [gz(warc.encode_record(i, f"http://a/{i}", f"payload {i} ".encode() * 50, None)) for i in range(20)]
    at = [sum(map(len, members[:i])) for i in range(21)]
    data = bytearray(b"".join(members))
    data[at[5] + 40] ^= 0xFF
    data[at[11] + 2] ^= 1
    del data[at[18] + 10 : at[18] + 30]
    found = told(data)
    assert [x[0] for x in found] == [*range(5), "gap", *range(6, 11), "gap", *range(12, 18), "gap", 19]
    assert found[5][1:] == (at[5], at[6])
    assert told(b"".join(members)[:-7])[-1][0] == "gap" and told(b"junk" + members[0])[1][0] == 0


def test_very_long_urls(spark):
    urls = {1: "http://a/" + "x" * 70_000, 2: "http://a/" + "%" * 300_000, 3: "http://a/3"}
    pages = spark.createDataFrame([(i, u, "same" if i < 3 else "other") for i, u in urls.items()], "page_id long, url string, html string")
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()) == [(1, "revisit", 2), (2, "response", None), (3, "response", None)]
    assert {r.page_id: r.url for r in warc.read(warc.write(pages)).collect()} == urls
    plain = [warc.encode_record(i, u, b"payload", None) for i, u in urls.items()]
    assert [x[0] for x in told(b"".join(plain))] == [1, 2, 3]
    assert [x[0] for x in told(plain[0][:80_000].replace(b"\r\n\r\n", b"") + b"\r\n" + plain[1])] == ["gap", 2]


def test_salvage_of_plain_records():
    records = [warc.encode_record(i, None, f"payload {i} ".encode() * 50, 1 if i == 3 else None) for i in range(8)]
    data = bytearray(b"".join(records))
    data[data.index(b"payload 5 ")] = 65
    assert [x[0] for x in told(data)] == [0, 1, 2, 3, 4, "gap", 6, 7]
    cut = data.index(b"Content-Length", sum(map(len, records[:2])))
    data[cut : cut + 14] = b"Content-Lxngth"
    assert [x[0] for x in told(data)] == [0, 1, "gap", 3, 4, "gap", 6, 7]


def test_salvage_inside_members():
    """A bad record among others in one member, a member cut short, and one whose CRC fails."""
    records = [warc.encode_record(i, f"http://a/{i}", bytes(random.Random(i).randbytes(3000)), 0 if i == 2 else None) for i in range(6)]
    bad = bytearray(records[3])
    bad[-100] ^= 0xFF
    found = told(gz(b"".join([*records[:3], bad, *records[4:]])) + gz(records[0]))
    assert [x[0] for x in found] == [0, 1, 2, "gap", 4, 5, 0]
    data = gz(b"".join([*records[:3], bad, *records[4:]]))
    inner = [f for kind, f, *_ in warc.salvage(warc.Source(lambda n, pos: data[pos : pos + n], len(data))) if kind == "gap"]
    assert (inner[0]["inner_start"], inner[0]["inner_end"]) == (sum(map(len, records[:3])), sum(map(len, records[:4]))) and inner[0]["reason"] == "payload digest"
    whole = gz(b"".join(records))
    assert [x[0] for x in told(whole[:-9])] == [0, 1, 3, 4, 5, "gap"] or [x[0] for x in told(whole[:-9])] == [0, 1, 3, 4, "gap"]
    assert [x[0] for x in told(whole[: len(whole) // 2])][:2] == [0, 1] and told(whole[: len(whole) // 2])[-1][0] == "gap"
    wrong = bytearray(whole)
    wrong[-6] ^= 1  # the CRC: records that a digest covers are kept, the revisit is not
    assert [x[0] for x in told(bytes(wrong) + gz(records[2]))] == [0, 1, 3, 4, 5, "gap", 2]
    stored = zlib.compressobj(0, wbits=31)
    stored = bytearray(stored.compress(b"".join(records)) + stored.flush())
    stored[-6] ^= 1
    assert [x[0] for x in told(bytes(stored))] == [0, 1, 3, 4, 5, "gap"]  # once each, though the text lies open


def test_urls_are_written_as_they_are(spark):
    urls = {1: "http://a/b%20c%2520d", 2: "http://a/x\r\nWARC-Type: y", 3: " http://a/ ", 4: "", 5: None, 6: "http://é/%"}
    record = warc.encode_record(1, urls[1], b"p", None)
    assert b"WARC-Target-URI: http://a/b%20c%2520d\r\n" in record
    pages = spark.createDataFrame([(i, u, str(i), "clash", 1) for i, u in urls.items()], "page_id long, url string, html string, kind string, path int")
    rows = warc.read(warc.write(pages))
    records, gaps = warc.split(rows)
    assert {r.page_id: r.url for r in records.collect()} == urls and gaps.collect() == []
    foreign = record.replace(b"b%20c%2520d", b"%0A%25")
    assert next(warc.salvage(warc.Source(lambda n, pos: foreign[pos : pos + n], len(foreign))))[1]["url"] == "http://a/%0A%25"
