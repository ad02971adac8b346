"""WARC archives with an index first.

Writing: every task writes its rows as gzip members, one per record, into one
archive file of the shared folder, and returns one index row per record: file,
offset, length, URL, digest. Of records with equal payloads of at least 1000
bytes that with the largest page_id is a response and the others are revisits
that name it; their payloads are left out. The index is a table; a task that is
run again writes another file, and only the index of the run that counted is
kept, so half-written files are never read.

Reading: selected index rows are sorted by file and offset in ranges; ranges of
bytes that touch or nearly touch are read at once (up to MAX_READ bytes), each
record is unpacked, and its payload is held against its digest.

Defined cases: a null html is an empty payload; a null URL has no target URI; a
null page_id counts as smaller than any other; where the largest page_id of a
payload occurs twice, both are responses; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmap.llm.shared import Tables, sized, table, with_columns_renamed_apart

MIN_SHARED = 1000
MAX_GAP, MAX_READ = 64 << 10, 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def _open(path: str):
    """(file system, path in it) of a path below the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _urn(page_id) -> str:
    return f"urn:page:{'null' if page_id is None else page_id}"


def _uri(url: str) -> str:
    return "".join(c if 32 < ord(c) != 127 and c != "%" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record. The block of a revisit has the HTTP head of the response alone."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_urn(page_id)}>"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_uri(url)}")
    lines += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_urn(refers_to)}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of one record; its payload, or of a revisit the payload's length."""
    head, rest = data.split(b"\r\n\r\n", 1)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    ids = {k: re.search(r"urn:page:(null|-?\d+)", fields.get(k, "")) for k in ("warc-record-id", "warc-refers-to")}
    number = lambda m: None if m is None or m[1] == "null" else int(m[1])
    return {
        "type": fields["warc-type"],
        "page_id": number(ids["warc-record-id"]),
        "refers_to": number(ids["warc-refers-to"]),
        "url": unquote(fields["warc-target-uri"]) if "warc-target-uri" in fields else None,
        "digest": base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex(),
        "length": int(re.search(rb"(?i)content-length: *(\d+)", http)[1]),
        "payload": payload,
    }


def _writer(folder: str):
    def run(stream):
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in stream:
            rows = {"file": [], "offset": [], "length": [], "url": [], "digest": [], "page_id": [], "record_type": []}
            for page_id, url, html, digest, refers_to in zip(*[c.to_pylist() for c in batch.columns]):
                if out is None:
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = z.compress(record(page_id, url, html or b"", digest, refers_to)) + z.flush()
                out.write(data)
                for k, v in zip(rows, (f"{folder}/{name}", at, len(data), url, digest, page_id, "response" if refers_to is None else "revisit")):
                    rows[k].append(v)
                at += len(data)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds)], names=list(rows))
        if out is not None:
            out.close()

    return run


def roles(pages: DataFrame, tables: Tables, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """page_id, url, html (bytes), digest, refers_to (null: a response)."""
    rows = with_columns_renamed_apart(pages, {id_col: "page_id", url_col: "url", payload_col: "html"})
    rows = rows.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    # A few bytes for each large payload that occurs twice. Other rows stay out of the join, and none is shuffled if those fit.
    large = F.octet_length("html") >= MIN_SHARED
    most = rows.filter(large).groupBy("digest").agg(F.max("page_id").alias("most"), F.count("*").alias("m")).filter("m > 1 AND most IS NOT NULL").select("digest", "most")
    columns = ["page_id", "url", "html", "digest"]
    joined = rows.filter(large).join(sized(tables, most, "shared"), "digest", "left").select(*columns, F.when(~F.col("page_id").eqNullSafe(F.col("most")), F.col("most")).alias("refers_to"))
    return joined.union(rows.filter(~large).select(*columns, F.lit(None).cast("long")))


def write_archives(pages: DataFrame, tables: Tables, **columns) -> DataFrame:
    """Writes the archives, then the index, which it returns; into the folder of the tables, Tables(spark, folder) for one that stays."""
    return tables.keep(roles(pages, tables, **columns).mapInArrow(_writer(tables.path("archives")), INDEX), "index")


def coalesced(rows: list[tuple[str, int, int]]):
    """Runs of index rows (sorted by file and offset) that one read serves: first, end, byte range."""
    at = 0
    while at < len(rows):
        file, start, length = rows[at]
        stop, end = start + length, at + 1
        while end < len(rows) and rows[end][0] == file and rows[end][1] - stop <= MAX_GAP and rows[end][1] + rows[end][2] - start <= MAX_READ:
            stop = max(stop, rows[end][1] + rows[end][2])
            end += 1
        yield at, end, start, stop
        at = end


def _read(stream):
    held: tuple[str, object] = ("", None)
    for batch in stream:
        rows = list(zip(*[batch.column(k).to_pylist() for k in range(3)]))
        out = []
        for a, b, start, stop in coalesced(rows):
            if held[0] != rows[a][0]:
                if held[1] is not None:
                    held[1].close()
                fs, path = _open(rows[a][0])
                held = (rows[a][0], fs.open_input_file(path))
            data = held[1].read_at(stop - start, start)
            for _, offset, length in rows[a:b]:
                r = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                if r["type"] == "response" and hashlib.sha1(r["payload"]).hexdigest() != r["digest"]:
                    raise ValueError(f"payload of page {r['page_id']} doesn't fit its digest")
                out.append((r["page_id"], r["length"], r["digest"], r["type"], r["refers_to"], r["url"]))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
        columns = list(zip(*out)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])
    if held[1] is not None:
        held[1].close()


def read_records(index: DataFrame) -> DataFrame:
    """The records of the index rows, read by coalesced byte ranges in the order of files and offsets."""
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = index.select("file", "offset", "length").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    return rows.mapInArrow(_read, READ)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS n, sha1(h) AS digest FROM p),
m AS (SELECT digest, max(page_id) AS most FROM d WHERE n >= 1000 GROUP BY 1)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN most IS NULL OR most = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN most <> page_id THEN most END AS refers_to FROM d LEFT JOIN m USING (digest)
"""


def op2_warc_index(spark, sf_dir: str) -> DataFrame:
    index = write_archives(table(spark, sf_dir, "pages"), Tables(spark))
    return read_records(index).drop("url")
