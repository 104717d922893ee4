"""WARC files: brute force, files of other writers, and awkward pages."""

import gzip
import hashlib
import random

import pytest

from spanworks.llm import warc

PAGES = "page_id long, url string, html string, row int, digest string, record_id string, value string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    texts = ["".join(rng.choice(["a", "é", "😀", "\r\n", "\r", "\n", "\r\n\r\n", "WARC/1.", "WARC", "/1.1\r\n", " "]) for _ in range(rng.randrange(900)))
             for _ in range(120)]
    texts += [None, "", "x" * 999, "x" * 999, "x" * 1000, "x" * 1000, "é" * 500, "é" * 500, "é" * 499 + "x", "é" * 499 + "x"]
    texts += ["WARC/1.1\r\nWARC-Type: response\r\n\r\nabc", "\r\n\r\nWARC/1.0\r\n\r\n" * 200, "\r\n\r\n", "\r\n", "long " * 400_000]
    texts += ["the same page of which there are many copies " * 30] * 300
    out = [(k * 7 % 1009, f"http://h{k % 5}.example/p?k={k}", t, 1, "d", "r", "v") for k, t in enumerate(texts)]
    out += [(2000, url, "y" * 2000, 1, "d", "r", "v") for url in (None, "", "not a url\r\nX: y", "http://[bad", "http://x/ä b")]
    out += [(2001, "http://x/", "y" * 2000, 1, "d", "r", "v")] * 3  # repeated rows, the largest id among them
    out += [(None, "http://x/", "z" * 1500, 1, "d", "r", "v")] * 2 + [(-5, "http://x/", "z" * 1500, 1, "d", "r", "v")]
    out += [(None, None, "q" * 1500, 1, "d", "r", "v"), (None, None, None, None, None, None, None)]
    return out


def by_force(rows):
    groups = {}
    for page, _, html, *_ in rows:
        groups.setdefault((html or "").encode(), []).append(page)
    out = []
    for payload, pages in groups.items():
        digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
        pages = sorted(pages, key=lambda p: (p is not None, p or 0))
        revisits = pages[:-1] if size >= 1000 else []
        out += [(p, size, digest, "revisit", pages[-1]) for p in revisits]
        out += [(p, size, digest, "response", None) for p in pages[len(revisits) :]]
    return sorted(out, key=str)


def test_round_trip(spark, rows):
    pages = spark.createDataFrame(rows, PAGES).repartition(5)
    got = warc.round_trip(pages).collect()
    assert sorted((tuple(r) for r in got), key=str) == by_force(rows)


@pytest.mark.parametrize("compression", ["gzip", None])
def test_archive(spark, rows, tmp_path, compression):
    """All payloads come back, from files that other readers can take apart by their lengths."""
    path = f"file://{tmp_path}/archive"
    warc.write(spark.createDataFrame(rows, PAGES).repartition(3), path, compression, date="2026-01-02T03:04:05Z")
    records = warc.read(spark, path).collect()
    assert all(r.intact and r.date == "2026-01-02T03:04:05Z" for r in records) and len({r.record_id for r in records}) == len(records)
    assert {r.target_uri for r in records if r.target_uri and "not" in r.target_uri} == {"not%20a%20url%0D%0AX:%20y"}
    payloads = [bytes(r.payload) for r in records if r.kind == "response"]
    assert {(h or "").encode() for _, _, h, *_ in rows} == set(payloads)
    kinds = [r.kind for r in records]
    assert kinds.count("request") == kinds.count("metadata") == kinds.count("response") + kinds.count("revisit") == len(rows)
    count = 0
    for file in (tmp_path / "archive").glob("part-*"):
        data = gzip.open(file).read() if compression else file.read_bytes()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\n")
            length = int(dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])[b"Content-Length"])
            assert rest[length : length + 4] == b"\r\n\r\n"
            data, count = rest[length + 4 :], count + 1
    assert count == len(records)


def test_small_splits(spark, rows, tmp_path):
    """Records cut by the bounds of splits are read once and whole."""
    path = f"file://{tmp_path}/archive"
    warc.write(spark.createDataFrame(rows, PAGES).coalesce(1), path, None)
    whole = warc.read(spark, path).count()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4099")
    try:
        records = warc.read(spark, path)
        assert records.rdd.getNumPartitions() > 100
        assert records.count() == whole and records.where("not intact").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def foreign(kind, own, block=b"", version=b"1.0", content_type="text/plain", **fields):
    lines = [f"warc-type: {kind}", f"WARC-RECORD-ID: {own}", f"Content-Length: {len(block)}", f"Content-Type: {content_type}"]
    lines += [f"{k.replace('_', '-')}: {x}" for k, v in fields.items() for x in (v if isinstance(v, list) else [v])]
    return b"WARC/" + version + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_files_of_other_writers(spark, tmp_path):
    http = "application/http; msgtype=response"
    body = b"HTTP/1.0 200 OK\r\nTransfer-Encoding: Chunked\r\n\r\n3;x=y\r\nabc\r\n0A\r\n0123456789\r\n0\r\n\r\n"
    hello = hashlib.sha1(b"hello").hexdigest()
    records = [
        foreign("warcinfo", "<i>", b"software: other\r\n", content_type="application/warc-fields"),
        foreign("response", "<r1>", body, content_type=http, WARC_Concurrent_To=["<q1>", "<m1>"], WARC_Target_URI="http://a/"),
        foreign("request", "<q1>", b"GET / HTTP/1.0\r\nHost: a\r\n  b\r\n\r\n", content_type="application/http; msgtype=request"),
        foreign("metadata", "<m1>", b"k: v\r\nk: w\r\n", content_type="application/warc-fields"),
        foreign("metadata", "<m2>", b"free text", WARC_Concurrent_To="<q1>"),
        foreign("resource", "<r2>", b"hello", b"1.1", WARC_Payload_Digest=f"sha1:{hello}"),
        foreign("request", "<q2>", WARC_Concurrent_To=["<r2>", "<r2>"]),
        foreign("response", "<r3>", b"HTTP/1.1 200 OK\r\n\r\nother", content_type=http, WARC_Payload_Digest=f"sha1:{hello}"),
        foreign("revisit", "<r4>", b"HTTP/1.1 200 OK\r\n\r\n", content_type=http, WARC_Refers_To="<r3>"),
        foreign("metadata", "<orphan>", WARC_Concurrent_To="<nowhere>"),
        b"WARC/1.0\r\nno type: here\r\n\r\n\r\n\r\n",
    ]
    cut = foreign("resource", "<r5>", b"cut short")[:-8]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records[:6]))
    (tmp_path / "in" / "b.warc").write_bytes(b"".join(records[6:]) + cut)
    got = warc.read(spark, f"file://{tmp_path}/in")
    intact = {r.record_id: r.intact for r in got.collect()}
    assert len(intact) == 11 and not intact["<r3>"] and not intact["<r5>"] and sum(intact.values()) == 9
    nested = {r.capture.record_id: r for r in warc.transactions(got).collect()}
    assert set(nested) == {"<r1>", "<r2>", "<r3>", "<r4>", "<r5>"}
    first = nested["<r1>"]
    assert bytes(first.capture.payload) == b"abc0123456789" and first.capture.target_uri == "http://a/"
    assert [r.record_id for r in first.requests] == ["<q1>"] and [r.record_id for r in first.metadata] == ["<m1>", "<m2>"]
    assert [tuple(f) for f in first.requests[0].fields] == [("host", "a b")] and first.requests[0].start == "GET / HTTP/1.0"
    assert [tuple(f) for f in first.metadata[0].fields] == [("k", "v"), ("k", "w")]
    assert [r.record_id for r in nested["<r2>"].requests] == ["<q2>"] and nested["<r2>"].capture.payload_digest == hello
    assert nested["<r3>"].requests is None and nested["<r4>"].capture.refers_to == "<r3>"


def test_ends_of_records_at_the_end_of_a_buffer(spark, tmp_path):
    """Blocks that end in line ends, at every place around the 64 KB that are read at once."""
    for shift in range(-24, 25):
        first = foreign("metadata", f"<a{shift}>")
        block = b"x" * ((1 << 16) + shift - len(foreign("request", f"<b{shift}>")) - 4 - len(first)) + b"\r\n\r\n\r\n"
        (tmp_path / f"{shift}.warc").write_bytes(first + foreign("request", f"<b{shift}>", block) + foreign("metadata", f"<c{shift}>"))
    got = warc.read(spark, f"file://{tmp_path}").collect()
    assert len(got) == len({r.record_id for r in got}) == 3 * 49 and all(r.intact for r in got)


def test_empty_table(spark, tmp_path):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).collect() == []


def test_no_payload_ends_its_record():
    rng = random.Random(1)
    for _ in range(500):
        payload = b"".join(rng.choice([b"\r\n\r\n", b"WARC/1.", b"WARC", b"/1.", b"W", b"\r\n"]) for _ in range(rng.randrange(12)))
        written = warc.record("response", "<r>", "d", "application/http", warc.http_response(payload))
        assert written.count(b"WARC/1.") == 1 and bytes(warc.parse(written + b"\r\n\r\n")["payload"]) == payload
