"""Archives: a round trip, and assembling transactions of all shapes."""

import glob
import gzip
import hashlib

from channelweave.llm.warc import assemble, op9_warc_transactions, read_archives, restore_payloads, write_archives

SCHEMA = "page_id long, url string, html string, date string"
BIG, SMALL = "é" * 700 + "\r\n\r\nWARC/1.1\r\n", "small"
PAGES = [
    (1, "http://a/1", BIG), (2, "http://a/2 x\r\nEvil: y", BIG), (3, None, BIG), (4, "http://a/4", SMALL), (5, "http://a/5", SMALL), (6, "http://a/6", None),
    (7, "http://a/7", ""), (8, "http://a/8", "x" * 3_000_000), (9, "http://a/9", "y" * 1000), (9, "http://a/9", "y" * 1000), (None, "http://a/n", "z" * 2000), (11, "http://a/11", "w" * 999), (12, "http://a/12", "w" * 999),
]


def pages(spark):
    return spark.createDataFrame([(i, u, h, "later") for i, u, h in PAGES], SCHEMA)


def test_query(spark, tmp_path):
    pages(spark).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((tuple(r) for r in op9_warc_transactions(spark, str(tmp_path)).collect()), key=str)
    want = []
    for i, _, h in PAGES:
        raw = (h or "").encode()
        same = [j for j, _, x in PAGES if (x or "") == (h or "") and j is not None]
        top = max(same, default=None)
        revisit = len(raw) >= 1000 and i != top and i is not None
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    assert got == sorted(want, key=str)


def test_round_trip(spark, tmp_path):
    write_archives(pages(spark), f"{tmp_path}/w")
    files = glob.glob(f"{tmp_path}/w/*.gz")
    assert files and all(gzip.open(f).read().startswith(b"WARC/1.1\r\n") for f in files if len(gzip.open(f).read()))
    captures = restore_payloads(assemble(read_archives(spark, f"{tmp_path}/w")))
    rows = captures.collect()
    assert len(rows) == len(PAGES) - 1  # repeated rows are one capture, counted twice
    assert sorted(r.n_responses for r in rows)[-1] == 2
    assert all(r.response and r.request and r.metadata for r in rows)
    assert sorted(bytes(r.payload) for r in rows) == sorted({(i, u, h or "") for i, u, h in PAGES} and [(h or "").encode() for i, u, h in PAGES if i != 9] + [b"y" * 1000])


def test_assemble_shapes(spark):
    schema = "record_id string, type string, concurrent_to array<string>, refers_to string, date string, size int"
    rows = [
        ("r1", "response", [], None, "d", 1), ("q1", "request", ["r1"], None, "d", 2), ("m1", "metadata", ["r1"], None, "d", 3), ("m2", "metadata", ["r1"], None, "d", 4),
        ("r2", "response", ["q2"], None, "d", 5), ("q2", "request", [], None, "d", 6), ("q3", "request", ["gone"], None, "d", 7), ("m4", "metadata", None, None, None, 8), (None, "metadata", [], None, "d", 9),
    ]
    got = {r.capture_id: r for r in assemble(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {"r1", "r2", "gone", "m4", None}
    assert (got["r1"].request["size"], got["r1"].metadata.record_id, got["r1"].n_metadata) == (2, "m1", 2)
    assert got["r2"].request.record_id == "q2" and got["gone"].response is None and got["m4"].metadata["size"] == 8
    assert assemble(spark.createDataFrame([], schema)).collect() == []


def test_truncated_and_foreign_files(spark, tmp_path):
    whole = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <u:1>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(whole + whole.replace(b"<u:1>", b"<u:2>")[:-6])
    (tmp_path / "b.warc").write_bytes(b"no archive")
    got = read_archives(spark, str(tmp_path)).collect()
    assert [(r.record_id, r.type, bytes(r.payload)) for r in got] == [("<u:1>", "resource", b"abc")]
