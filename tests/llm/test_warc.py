import gzip
import hashlib
import os

import pytest

from siftline.llm import warc

SCHEMA = "page_id long, url string, html string, digest string"


def pages():
    rows = [(k, f"http://a/{k}", f"<p>{k % 7}</p>") for k in range(40)]
    rows += [(50, None, "<p>1</p>"), (None, "http://n", "<p>n</p>"), (51, "http://e", ""), (52, "http://f", ""), (53, "http://g", None), (54, "http://h", None), rows[3], (60, "http://big", "é" * 400_000)]
    return rows


def brute():
    rows = sorted(set(pages()), key=lambda r: (r[0] is None, r[0] or 0))
    first, out = {}, []
    for i, u, h in rows:
        d = None if h is None else "sha1:" + hashlib.sha1(h.encode()).hexdigest()
        if d is not None and d in first:
            out.append((i, u, warc.DATE, "revisit", d, *first[d], 0))
        else:
            if d is not None:
                first[d] = (i, u)
            out.append((i, u, warc.DATE, "response", d, None, None, len((h or "").encode())))
        out.append((i, u, warc.AGAIN, "revisit", d, *first.get(d, (None, None)), 0))
    return sorted(map(str, out))


def test_pages_against_brute_force(spark):
    df = spark.createDataFrame([(*r, "x") for r in pages()], SCHEMA).repartition(3)
    assert sorted(str(tuple(r)) for r in warc.dedup_pages(df).collect()) == brute()
    assert warc.dedup_pages(df.where("false")).count() == 0


def test_archives_round_trip_and_resolve_revisits(spark, tmp_path):
    df = spark.createDataFrame([(*r, "x") for r in pages()], SCHEMA).repartition(3)
    one = str(tmp_path / "one")
    manifest = warc.deduplicate(warc.from_pages(df), one).collect()
    html = {r[0]: r[2] for r in pages()}
    for r in manifest:
        with open(r.archive, "rb") as f:
            f.seek(r["at"])
            ((head, body),) = warc.parse(gzip.decompress(f.read(r.size)))
        assert head["WARC-Type"] == r.warc_type
        if r.warc_type == "response":
            assert body.decode() == (html[r.id] or "")
        elif r.refers_to_uri:
            assert head["WARC-Refers-To-Target-URI"] == r.refers_to_uri
    # archives with revisit records: read, resolve and write again
    back = warc.read(spark, one)
    assert back.count() == len(manifest)
    again = warc.deduplicate(back, str(tmp_path / "two")).collect()
    key = lambda rows: sorted(str((r.id, r.uri, r.warc_type, r.payload_digest, r.refers_to_id, r.content_length)) for r in rows)
    assert key(again) == key(manifest)
    # a revisit without its original refers to what it referred to before, and to no row
    lone = warc.deduplicate(back.where("type = 'revisit'"), str(tmp_path / "three")).collect()
    assert lone and all(r.warc_type == "revisit" and r.refers_to_id is None for r in lone)
    was, now = ({h["WARC-Record-ID"]: h for name in os.listdir(tmp_path / x) for h, _ in warc.parse((tmp_path / x / name).read_bytes()) if h["WARC-Type"] == "revisit"} for x in ("one", "three"))
    assert was == now


def record(kind, rid, body, *lines):
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{rid}>", "WARC-Date: 2023-05-05T00:00:00Z", *lines, f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


@pytest.mark.parametrize("packed", [False, True])
def test_foreign_archive_keeps_bodies_and_lines(spark, tmp_path, packed):
    page, uri = b"HTTP/1.1 200 OK\r\n\r\n\xff\x00page", "WARC-Target-URI: http://x/a"
    dig = "WARC-Payload-Digest: sha1:" + hashlib.sha1(page).hexdigest()
    all_of = [
        record("warcinfo", "w", b"software: some crawler\r\n", "Content-Type: application/warc-fields"),
        record("request", "q", b"GET /a HTTP/1.1\r\n\r\n", uri, "WARC-Concurrent-To: <urn:uuid:r>", "Content-Type: application/http; msgtype=request"),
        record("response", "r", page, uri, dig, "WARC-IP-Address: 10.0.0.1"),
        record("response", "s", page, uri, dig),
        record("response", "t", page + b"!", uri),
        record("metadata", "m", b"via: http://x/", uri, "WARC-Refers-To: <urn:uuid:r>"),
        record("resource", "o", b"", uri),
        record("revisit", "v", b"HTTP/1.1 304 Not Modified\r\n\r\n", uri, "WARC-Payload-Digest: sha1:unknown", "WARC-Refers-To: <urn:uuid:gone>", "WARC-Refers-To-Date: 2020-01-01T00:00:00Z"),
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a b.warc").write_bytes(b"".join(map(gzip.compress, all_of)) if packed else b"".join(all_of))
    rows = warc.deduplicate(warc.read(spark, str(tmp_path / "in")), str(tmp_path / "out")).collect()
    assert len(rows) == len(all_of)
    got = {}
    for name in os.listdir(tmp_path / "out"):
        got |= {h.pop("WARC-Record-ID"): (h, b) for h, b in warc.parse((tmp_path / "out" / name).read_bytes())}
    for x in all_of:
        ((h, b),) = warc.parse(x)
        rid = h.pop("WARC-Record-ID")
        if rid == "<urn:uuid:s>":
            assert got[rid][0]["WARC-Type"] == "revisit" and got[rid][0]["WARC-Refers-To"] == "<urn:uuid:r>" and got[rid][1] == b""
        else:
            assert got[rid] == (h, b)


def test_two_records_of_one_address_have_two_ids(spark):
    df = spark.createDataFrame([(1, "http://a", "x"), (1, "http://a", "y"), (1, "http://a", None)], "page_id long, url string, html string")
    rows = warc.deduplicate(warc.from_pages(df).unionByName(warc.revisits(warc.from_pages(df)))).collect()
    assert len(rows) == 6 == len({r.record_id for r in rows})


@pytest.mark.parametrize("data", [b"HTTP/1.1 200 OK\r\n\r\n", b"WARC/1.0\r\nWARC-Type: response\r\n\r\n", b"WARC/1.0\r\nContent-Length: 9\r\n\r\nab"])
def test_malformed_records_are_errors(data):
    with pytest.raises(ValueError):
        list(warc.parse(data))
