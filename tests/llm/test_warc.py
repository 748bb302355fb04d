import hashlib
import random

from veilspark.llm import warc
from veilspark.llm.util import materialize, new_path

FIELDS = "page_id long, url string, html string, payload string"


def pages(spark):
    rng = random.Random(2)
    big = "<html>" + "x" * 1500 + "\x1f\x8b\x08 é</html>"
    rows = [(i, f"http://a/{i}", "".join(rng.choice("abc <>é\n\r") for _ in range(rng.randint(0, 4000))), "clash") for i in range(60)]
    rows += [(100 + i, "http://b/", big, "clash") for i in range(5)] + [(200, None, None, None), (201, "u\r\nv", "", None), (202, "x", "tiny", None), (203, "x", "tiny", None)]
    return rows, spark.createDataFrame(rows, FIELDS)


def test_round_trip_with_revisits(spark):
    rows, df = pages(spark)
    got = {r.page_id: r for r in warc.op9(df).collect()}
    assert len(got) == len(rows)
    for i, _, html, _ in rows:
        b = (html or "").encode()
        assert got[i].payload_bytes == len(b) and got[i].payload_digest == hashlib.sha1(b).hexdigest()
        revisit = 100 <= i < 104
        assert got[i].record_type == ("revisit" if revisit else "response") and got[i].refers_to == (104 if revisit else None)


def test_any_split_size_reads_all_records_once(spark):
    rows, df = pages(spark)
    files = materialize(warc.write_archives(warc.with_revisits(df.drop("payload")), new_path(spark, "warc")), "files")
    want = {i: (html or "").encode() for i, _, html, _ in rows}
    for split in (64, 1000, 10**9):
        got = warc.read_archives(files, split).collect()
        assert sorted(r.page_id for r in got) == sorted(want)
        assert all(bytes(r.payload) == want[r.page_id] for r in got if r.record_type == "response")


def test_archives_roll_over(spark):
    rows, df = pages(spark)
    files = materialize(warc.write_archives(warc.with_revisits(df.drop("payload")), new_path(spark, "warc"), 5000), "files")
    assert files.count() > 10 and files.count() == files.select("path").distinct().count()
    got = warc.read_archives(files).collect()
    assert sorted(r.page_id for r in got) == sorted(r[0] for r in rows)


def test_a_record_is_an_http_response():
    import zlib

    record = zlib.decompress(warc.encode(1, "http://a/", b"body\r\n\r\nmore", 12, "d", None), 31)
    head, http, payload = record.split(b"\r\n\r\n", 2)
    assert b"Content-Type: application/http; msgtype=response" in head and http.startswith(b"HTTP/1.1 200 OK") and payload == b"body\r\n\r\nmore\r\n\r\n"
    assert f"Content-Length: {len(http) + 4 + 12}".encode() in head.split(b"\r\n")


def test_false_magic_inside_a_member(tmp_path):
    a = warc.encode(1, "u", warc.MAGIC * 50, 150, hashlib.sha1(warc.MAGIC * 50).hexdigest(), None)
    b = warc.encode(2, "u", b"two", 3, hashlib.sha1(b"two").hexdigest(), None)
    junk = b"junk" + warc.MAGIC + b"junk"
    path = tmp_path / "x.warc.gz"
    path.write_bytes(a + junk + b)
    size = path.stat().st_size
    for cut in range(0, size, 7):
        ids = [r["page_id"] for lo, hi in ((0, cut), (cut, size)) for r in warc.read_range(str(path), lo, hi, size)]
        assert ids == [1, 2]


def test_empty_pages(spark):
    assert warc.op9(spark.createDataFrame([], FIELDS)).count() == 0
