"""Archives: both ARC versions, the conversion and the way back."""

import base64
import gzip
import hashlib
import random

import duckdb
import pytest

from flagtide.llm import warc as W
from flagtide.llm.common import shared_folder

SF = "/root/testdata/sf0.001"

ARC = {
    "1": b"filedesc://a.arc 0.0.0.0 20010203 text/plain 76\n1 0 someone\nURL IP-address Archive-date Content-type Archive-length\n\n\n"
         b"http://a.example/ 1.2.3.4 20010203040506 text/html 9\nline\nline\nhttp://b.example/x 1.2.3.4 200102 text/plain 0\n\n",
    "2": b"filedesc://a.arc 0.0.0.0 20010203 text/plain 200 - - 0 a.arc 124\n2 0 someone\nURL IP-address Archive-date Content-type "
         b"Result-code Checksum Location Offset Filename Archive-length\n\n\n"
         b"http://a.example/ 1.2.3.4 20010203040506 text/html 404 abc - 77 a.arc 9\nline\nline\n",
}


def _fixed(data):
    """The declared length of the version block, as it really is."""
    head, rest = data.split(b"\n", 1)
    body = rest.split(b"\n\n", 1)[0] + b"\n\n"
    return head.rsplit(b" ", 1)[0] + b" %d\n" % len(body) + rest


def test_version_specific_headers_and_lengths():
    whole = lambda data: list(W.arc_records([data]))
    one = whole(_fixed(ARC["1"]))
    assert [(f["URL"], f["Content-type"], c) for _, f, c in one] == [
        ("http://a.example/", "text/html", b"line\nline"), ("http://b.example/x", "text/plain", b"")]
    two = whole(_fixed(ARC["2"]) + _fixed(ARC["1"]))  # the version changes on the way
    assert [f.get("Result-code") for _, f, _ in two] == ["404", None, None]
    with pytest.raises(ValueError):
        whole(_fixed(ARC["1"]).replace(b"text/html 9", b"text/html 9000"))
    with pytest.raises(ValueError):
        whole(_fixed(ARC["1"]).replace(b"text/html 9", b"text/html extra 9"))
    data = _fixed(ARC["2"]) + _fixed(ARC["1"])
    for size in (1, 2, 3, 7, 50):  # whatever the pieces
        assert list(W.arc_records(data[i:i + size] for i in range(0, len(data), size))) == two


def test_dates_digests_and_members():
    assert W.warc_date("20010203040506") == "2001-02-03T04:05:06Z"
    assert W.warc_date("200102") == "2001-02-01T00:00:00Z"
    assert W.base32_sha1(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    assert [W.records_per_file(n) for n in (None, 100, 1 << 20, 1 << 28)] == [5_000, 5_000, 63, 1]


def test_one_record_is_held_at_a_time():
    """Of a long file no more than a record and a piece is in memory."""
    record = b"http://a.example/ 1.2.3.4 20010203040506 text/html 100000\n" + b"x" * 100_000 + b"\n"
    head = _fixed(ARC["1"])
    head = head[:head.index(b"http://a")]
    longest = 0

    def pieces():
        nonlocal longest
        yield head
        for _ in range(300):
            for at in range(0, len(record), 4096):
                yield record[at:at + 4096]
                longest = max(longest, len(source.held))

    made = W._Source

    def kept(x):
        nonlocal source
        source = made(x)
        return source

    source = None
    W._Source, n = kept, 0
    try:
        for _ in W.arc_records(pieces()):
            n += 1
    finally:
        W._Source = made
    assert n == 300 and longest < len(record) + 2 * 4096


def test_files_of_several_gzip_members(spark, tmp_path):
    (tmp_path / "a.arc.gz").write_bytes(gzip.compress(_fixed(ARC["2"])) + gzip.compress(_fixed(ARC["1"])))
    rows = W.read_arc(spark, f"file:{tmp_path}", True).collect()
    assert [(r.uri, bytes(r.payload)) for r in rows] == [("http://a.example/", b"line\nline"), ("http://a.example/", b"line\nline"),
                                                         ("http://b.example/x", b"")]


def test_pieces_at_the_very_end(spark):
    """Payloads that end in parts of the mark that files are cut at, and clashing columns."""
    rows = [(i, "http://x", "q" + end) for i, end in enumerate(["\r\n\r\n", "\r\n\r", "\r\n", "\r", "\r\n\r\n\r\n\r\n", "\n", ""])]
    for some in ([r] for r in rows):
        df = spark.createDataFrame([(*r, "mine", "f") for r in some], "page_id long, url string, html string, payload_digest string, file string")
        (got,) = W.archive_pages(df).collect()
        payload = some[0][2].encode()
        assert (got.payload_bytes, got.record_type) == (len(payload), "response")
        assert got.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()


def brute(rows):
    top = {}
    for i, _, html in rows:
        top[html or ""] = max((i is not None, i or 0), top.get(html or "", (False, 0)))
    return top


def test_pages_there_and_back(spark):
    rng = random.Random(1)
    tricky = ["", None, "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", "filedesc://x 1 2 3 4\n", "é \x00\x85日",
              "a" * 500_000, "HTTP/1.1 200 OK\r\n\r\nbody", "\n" * 50]
    rows = [(i, rng.choice(["http://x.example/a b", None, "", "http://é.example"]), rng.choice(tricky)) for i in range(300)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "page_id long, url string, html string, payload_bytes int").repartition(3)
    got = {r.page_id: r for r in W.archive_pages(df).collect()}
    top = brute(rows)
    assert set(got) == set(range(300))
    for i, _, html in rows:
        payload, r = (html or "").encode(), got[i]
        assert r.payload_bytes == len(payload)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        keep = top[html or ""][1]
        assert (r.record_type, r.refers_to) == (("response", None) if i == keep else ("revisit", keep))


def test_payloads_and_records_of_the_archive(spark):
    df = spark.createDataFrame([(1, "http://a", "x"), (2, "http://b", "x"), (3, "http://c", "yy")], "page_id long, url string, html string")
    base = shared_folder(spark, "test_warc")
    W.write_arc(df, f"{base}/arc", "2", date="20200102030405")
    W.convert(spark, f"{base}/arc", f"{base}/warc", least=2)  # one-byte payloads are all responses
    rows = sorted(W.read_warc(spark, f"{base}/warc").collect(), key=lambda r: r.page_id)
    assert [(r.record_type, bytes(r.payload), r.uri, r.date) for r in rows] == [
        ("response", b"x", "http://a", "2020-01-02T03:04:05Z"), ("response", b"x", "http://b", "2020-01-02T03:04:05Z"),
        ("response", b"yy", "http://c", "2020-01-02T03:04:05Z")]
    assert len({r.record_id for r in rows}) == 3 and all(r.record_id.startswith("urn:uuid:") for r in rows)


def test_odd_rows(spark):
    rows = [(None, None, None), (None, "u", "q"), (4, "u", "q"), (4, "u", "q"), (5, "v", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.page_id or 0, r.record_type, r.refers_to) for r in W.archive_pages(df).collect()), key=repr)
    assert got == sorted([(0, "response", None), (0, "revisit", 4), (4, "response", None), (4, "revisit", 4),
                          (5, "response", None)], key=repr)
    assert W.archive_pages(df.limit(0)).count() == 0


def test_query_equals_its_oracle(spark):
    from flagtide.llm import queries  # noqa: F401
    from flagtide.llm.registry import ORACLES, QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF}/pages.parquet')")
    res = con.execute(ORACLES["op5_warc"])
    want = sorted(res.fetchall(), key=repr)
    df = QUERIES["op5_warc"](spark, SF)
    assert df.columns == [d[0] for d in res.description]
    assert sorted(map(tuple, df.collect()), key=repr) == want
