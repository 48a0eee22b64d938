"""WARC revisit resolution and deduplicated archives.

Only headers are shuffled to find originals: (record id, row id, URI, date,
digest) by payload digest. The least (date, id) of a digest's responses is its
original; other responses of that digest become revisits, and revisit records
are joined to the original they refer to. Then the payloads that stay are joined
by record, and every task writes its records, with fresh headers, as gzip
members of one archive in the shared folder. A retried task replaces its own
file.

Fresh are type, record id, URI, date, digest, length, and in a revisit with an
original its profile and what it refers to. Records of all types are kept with
their bodies and their further header lines, in order. A record keeps the
record id it came with, so that lines such as WARC-Concurrent-To stay true; one
without gets a URN that depends on its row id, URI, date, type, digest and
content.

Cases: a null payload is a response without content and without digest, never
a duplicate; an empty payload has a digest like any other. A revisit whose
original isn't there stays a revisit with the body and the lines it came with.
Rows that agree in record id, id, URI, date, type, digest, and where there is no
digest in content, are one record; a null id is an id of its own, ordered last;
a null URI leaves its header out; a null date comes last. Payloads of any length
are written whole. Archives in the file system are read record by record. A
record without a version line or a length, or one cut short, is an error.
Further columns are ignored. An empty table writes no archive.
"""

from __future__ import annotations

import gzip
import io
import os
import urllib.parse
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.ngram_lm import local_path
from siftline.plans.scratch import cut, new_path

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
AGAIN = "2024-01-02T00:00:00Z"
FIELDS = "rid string, id long, uri string, date string, type string, digest string, lines array<string>"
_FRESH = {"warc-type", "warc-record-id", "x-row-id", "warc-target-uri", "warc-date", "warc-payload-digest", "content-length"}
_REFERS = {"warc-profile", "warc-refers-to", "warc-refers-to-target-uri", "warc-refers-to-date"}
MANIFEST = "record_id string, id long, date string, uri string, warc_type string, payload_digest string, refers_to_id long, refers_to_uri string, content_length long, archive string, at long, size long"


def digest(payload: Column) -> Column:
    return F.concat(F.lit("sha1:"), F.sha1(payload))


def build(rid, i, uri, date, kind, payload_digest, lines, payload: bytes, refers=None) -> bytes:
    """One WARC record with fresh headers; ``refers``: (record id, URI, date) of the original."""
    out = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{rid}>"]
    if i is not None:
        out.append(f"X-Row-ID: {i}")
    if uri is not None:
        out.append("WARC-Target-URI: " + "".join(uri.split()))
    if date is not None:
        out.append(f"WARC-Date: {date}")
    if payload_digest is not None:
        out.append(f"WARC-Payload-Digest: {payload_digest}")
    if refers is not None:
        out += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers[0]}>"]
        if refers[1] is not None:
            out.append("WARC-Refers-To-Target-URI: " + "".join(refers[1].split()))
        if refers[2] is not None:
            out.append(f"WARC-Refers-To-Date: {refers[2]}")
    gone = _FRESH | _REFERS if refers is not None else _FRESH
    out += [x for x in lines if x.partition(":")[0].strip().lower() not in gone]
    out.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(out).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def records_of(f) -> Iterator[tuple[list[str], bytes]]:
    """(header lines, body) of each record of an open archive."""
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        lines, length = [], None
        while (line := f.readline()).strip():
            text = line.decode("utf-8", "surrogateescape").rstrip("\r\n")
            if text[:1] in " \t" and lines:  # a folded line goes on with the one before
                lines[-1] += " " + text.strip()
                continue
            lines.append(text)
            name, _, value = text.partition(":")
            if name.strip().lower() == "content-length":
                length = int(value)
        if length is None:
            raise ValueError("a WARC record has no Content-Length")
        body = f.read(length)
        if len(body) < length:
            raise ValueError("a WARC record is cut short")
        yield lines, body


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, payload) of each record of an archive, gzip members or plain."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    for lines, body in records_of(io.BytesIO(data)):
        yield {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, body


def _row(lines: list[str], body: bytes) -> tuple:
    h = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    rid, i = h.get("warc-record-id"), h.get("x-row-id")
    rest = [x.encode("utf-8", "replace").decode() for x in lines if x.partition(":")[0].strip().lower() not in _FRESH]
    return (
        rid.strip("<>") if rid else None, int(i) if i else None, h.get("warc-target-uri"), h.get("warc-date"), h.get("warc-type", "unknown"), h.get("warc-payload-digest"), rest, body,
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """(rid, id, uri, date, type, digest, lines, payload BINARY) of the archives at ``path``."""
    near = path.startswith(("/", "file:"))
    names = [c.split()[0] for c in FIELDS.split(", ")] + ["payload"]

    def frame(rows):
        got = pd.DataFrame(rows, columns=names)
        return got.assign(id=got["id"].astype("Int64"))

    def run(it):
        for pdf in it:
            for x in pdf.iloc[:, 0]:
                raw = open(urllib.parse.unquote(x.removeprefix("file:")), "rb") if near else io.BytesIO(x)
                with raw:
                    packed = raw.read(2) == b"\x1f\x8b"
                    raw.seek(0)
                    held, size = [], 0
                    for lines, body in records_of(gzip.open(raw) if packed else raw):
                        held.append(_row(lines, body))
                        size += len(body)
                        if size > 16 << 20 or len(held) == 10_000:
                            yield frame(held)
                            held, size = [], 0
                    if held:
                        yield frame(held)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path)
    return files.select("path" if near else "content").mapInPandas(run, FIELDS + ", payload binary")


def from_pages(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of the table ``pages``."""
    html = F.col("html").cast("binary")
    return pages.select(
        F.lit(None).cast("string").alias("rid"), F.col("page_id").cast("long").alias("id"), F.col("url").alias("uri"), F.lit(date).alias("date"), F.lit("response").alias("type"),
        digest(html).alias("digest"), F.array(F.lit("Content-Type: text/html")).alias("lines"), html.alias("payload"),
    )


def revisits(records: DataFrame, date: str = AGAIN) -> DataFrame:
    """A later visit that found each response unchanged: revisit records without a body."""
    return records.where("type = 'response'").withColumns({"rid": F.lit(None).cast("string"), "date": F.lit(date), "type": F.lit("revisit"), "payload": F.lit(None).cast("binary")})


_KEY = ("rid", "id", "uri", "date", "type", "digest")


def _named(records: DataFrame) -> DataFrame:
    """``records`` with a record id each, and a hash of it and the headers as key for plain equi-joins."""
    own = F.to_json(F.struct(*_KEY[1:], F.when(F.col("digest").isNull(), F.sha1("payload")).alias("body")), {"ignoreNullFields": "false"})
    md5 = F.md5(own)
    parts = [F.substring(md5, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return records.withColumn("rid", F.coalesce("rid", F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *parts)))).withColumn("key", F.sha2(F.concat_ws("|", "rid", own), 256))


def resolve(records: DataFrame) -> DataFrame:
    """Headers → (key, rid, id, uri, date, type, digest, warc_type, original STRUCT<rid, id, uri, date>), one row a record."""
    return _resolved(_named(records))


def _resolved(named: DataFrame) -> DataFrame:
    heads = named.select("key", *_KEY).distinct()
    order = F.struct(F.col("date").isNull().alias("a"), "date", F.col("id").isNull().alias("b"), "id", F.col("uri").isNull().alias("c"), "uri", "rid", "key")
    originals = (
        heads.where("type = 'response' and digest is not null").groupBy(F.col("digest").alias("d")).agg(F.min(order).alias("first"))
    )
    o = F.col("first")
    later = o.isNotNull() & F.col("type").isin("response", "revisit") & (F.col("key") != o.key)
    return heads.join(originals, F.col("digest") == F.col("d"), "left").select(
        "key", *_KEY,
        F.when(later, "revisit").otherwise(F.col("type")).alias("warc_type"),
        F.when(later, F.struct(o.rid.alias("rid"), o.id.alias("id"), o.uri.alias("uri"), o.date.alias("date"))).alias("original"),
    )


def _write(folder: str):
    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        name = f"{folder}/part-{part:06d}.warc.gz"
        tmp, at, rows = f"{name}.{uuid.uuid4().hex}", 0, []
        f = None
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                i = None if r.id is None or r.id != r.id else int(r.id)
                uri, date, dig = r.uri, r.date, r.digest
                refers = o_id = None
                if r.o_rid is not None:
                    refers = (r.o_rid, r.o_uri, r.o_date)
                    o_id = None if r.o_id is None or r.o_id != r.o_id else int(r.o_id)
                payload = bytes(r.payload) if r.payload is not None else b""
                lines = [] if r.lines is None else list(r.lines)
                member = gzip.compress(build(r.rid, i, uri, date, r.warc_type, dig, lines, payload, refers), 4, mtime=0)
                f = f or open(tmp, "wb")
                f.write(member)
                rows.append((r.rid, i, date, uri, r.warc_type, dig, o_id, refers[1] if refers else None, len(payload), name, at, len(member)))
                at += len(member)
        if f:
            f.close()
            os.replace(tmp, name)
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in MANIFEST.split(", ")])
        yield out.assign(id=out["id"].astype("Int64"), refers_to_id=out["refers_to_id"].astype("Int64"))

    return run


def deduplicate(records: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the deduplicated archives into ``folder``; returns their manifest.

    Columns of the manifest: record_id, id, date, uri, warc_type,
    payload_digest, refers_to_id, refers_to_uri, content_length, archive, at,
    size (of the gzip member).
    """
    spark = records.sparkSession
    folder = local_path(folder or new_path(spark, "warc"))
    os.makedirs(folder, exist_ok=True)
    named = _named(records)
    heads = _resolved(named)
    bodies = named.groupBy("key").agg(F.first("lines").alias("lines"), F.first("payload").alias("payload"))
    o = F.col("original")
    dropped = (F.col("type") == "response") & o.isNotNull()
    whole = heads.join(bodies, "key", "left").select(
        *_KEY, "warc_type", o.rid.alias("o_rid"), o.id.alias("o_id"), o.uri.alias("o_uri"), o.date.alias("o_date"), "lines", F.when(~dropped, F.col("payload")).alias("payload"),
    )
    return cut(whole.mapInPandas(_write(folder), MANIFEST), "manifest")


def dedup_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, date, warc_type, payload_digest, refers_to_id, refers_to_uri, content_length) as archived.

    The pages as a first crawl, and a second one that found each page unchanged.
    """
    first = from_pages(pages)
    m = deduplicate(first.unionByName(revisits(first)))
    return m.select(F.col("id").alias("page_id"), F.col("uri").alias("url"), "date", "warc_type", "payload_digest", "refers_to_id", "refers_to_uri", "content_length")


SQL = """
WITH h AS (SELECT page_id, url, 'sha1:' || sha1(html) AS d, strlen(html) AS n FROM pages),
o AS (SELECT *, row_number() OVER w AS k, first_value(page_id) OVER w AS oid, first_value(url) OVER w AS ouri FROM h
      WINDOW w AS (PARTITION BY d ORDER BY page_id, url))
SELECT page_id, url, '2024-01-01T00:00:00Z' AS date, CASE WHEN k = 1 OR d IS NULL THEN 'response' ELSE 'revisit' END AS warc_type, d AS payload_digest,
       CASE WHEN k > 1 AND d IS NOT NULL THEN oid END AS refers_to_id, CASE WHEN k > 1 AND d IS NOT NULL THEN ouri END AS refers_to_uri,
       CASE WHEN k = 1 OR d IS NULL THEN coalesce(n, 0) ELSE 0 END::BIGINT AS content_length
FROM o
UNION ALL
SELECT page_id, url, '2024-01-02T00:00:00Z', 'revisit', d, CASE WHEN d IS NOT NULL THEN oid END, CASE WHEN d IS NOT NULL THEN ouri END, 0::BIGINT
FROM o
"""
