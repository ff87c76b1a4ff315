"""WARC archives: written with an index, read back by coalesced byte ranges.

Each attempt of a task writes one archive (a gzip member per record) under a name
of its own and returns the index: archive, offset, length, URL and digest of
every record. The index is stored as a table before anything is read, so it
holds one attempt's rows for each task and names that attempt's file, however
often a task was repeated or doubled; archives that no index row names are
deleted then. Reading sorts the selected
index rows by archive and offset, merges neighbouring byte ranges, fetches each
merged range once, and cuts the records out of it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, drop_path, names_in, shared_path, slices, table

INDEX = "archive string, offset long, length long, url string, payload_digest string, page_id long, record_type string"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Ranges are merged over gaps of at most GAP bytes, up to RANGE bytes.
GAP, RANGE = 64 << 10, 8 << 20


def base32_of_hex(hexa):
    """Column: the base32 form (RFC 4648) of 40 hexadecimal digits."""
    out = []
    for k in range(4):
        n = F.conv(F.substring(hexa, 10 * k + 1, 10), 16, 10).cast("long")
        out += [F.substring(F.lit(ALPHABET), (F.shiftright(n, 35 - 5 * j).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for j in range(8)]
    return F.concat(*out)


def classify(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) with payload_digest, record_type, refers_to and refers_url.

    Of equal payloads of at least ``min_bytes`` bytes that with the smallest
    page_id is the response, null ids last; the others revisit it. Rows that
    repeat its id and payload are responses too; refers_url is the smallest URL
    among them. A null html is empty. Other columns aren't archived.
    """
    html = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("hex"), F.octet_length(html).cast("long").alias("payload_bytes"))
    first = keyed.where(F.col("payload_bytes") >= min_bytes).groupBy("hex").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("url").isNull().alias("bare"), "url")).alias("first"))
    out = keyed.join(first, "hex", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return out.select("page_id", "url", "html", "payload_bytes", base32_of_hex(F.col("hex")).alias("payload_digest"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first.page_id")).alias("refers_to"), F.when(revisit, F.col("first.url")).alias("refers_url"))


def record(row: dict, date: str) -> bytes:
    """One record, uncompressed; a revisit has no block, a page without URL no such
    header. Control characters of a URL are written in percent form."""
    uri = lambda i: f"<urn:page:{'none' if i is None else i}>"
    clean = lambda s: "".join(c if c >= " " else f"%{ord(c):02X}" for c in s)
    block = b"" if row["record_type"] == "revisit" else row["html"].encode("utf-8", "surrogatepass")
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {uri(row['page_id'])}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{row['payload_digest']}", f"X-Payload-Length: {row['payload_bytes']}"]
    if row["url"] is not None:
        head.append(f"WARC-Target-URI: {clean(row['url'])}")
    if row["record_type"] == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {uri(row['refers_to'])}"]
        if row["refers_url"] is not None:
            head.append(f"WARC-Refers-To-Target-URI: {clean(row['refers_url'])}")
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of an uncompressed record."""
    end = raw.index(b"\r\n\r\n")
    lines = raw[:end].decode("utf-8", "surrogatepass").split("\r\n")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    size = int(head["Content-Length"])
    block = raw[end + 4 : end + 4 + size]
    if not lines[0].startswith("WARC/") or len(block) != size or raw[end + 4 + size :] != b"\r\n\r\n":
        raise ValueError("broken record")
    return head, block


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", level: int = 5) -> DataFrame:
    """Write classified pages as archives under ``path``; the index as a stored table."""

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(path)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        out, at = None, 0
        for batch in slices(batches):
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
            rows = []
            for row in batch.to_pylist():
                member = gzip.compress(record(row, date), level, mtime=0)
                out.write(member)
                rows.append({"archive": name, "offset": at, "length": len(member), **{k: row[k] for k in ("url", "payload_digest", "page_id", "record_type")}})
                at += len(member)
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string())]))
        if out is not None:
            out.close()

    index = pages.select("page_id", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to", "refers_url").mapInArrow(run, INDEX)
    index = checkpointed(index)
    named = {r["archive"] for r in index.select("archive").distinct().toLocalIterator()}
    for extra in set(names_in(pages.sparkSession, path)) - named:
        drop_path(pages.sparkSession, f"{path}/{extra}")
    return index


def read_records(index: DataFrame, path: str) -> DataFrame:
    """The records of index rows: headers as columns and the block.

    Each record is checked: its digest against the index, and a response's
    block against its digest; a broken one raises.
    """
    rows = index.select("archive", "offset", "length", "payload_digest").repartitionByRange("archive", "offset").sortWithinPartitions("archive", "offset")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("block", pa.binary())])

    def ranges(batches):
        """Runs of neighbouring records of an archive."""
        run = []
        for batch in batches:
            for r in batch.to_pylist():
                if run and (r["archive"] != run[0]["archive"] or r["offset"] - run[-1]["offset"] - run[-1]["length"] > GAP or r["offset"] + r["length"] - run[0]["offset"] > RANGE):
                    yield run
                    run = []
                run.append(r)
        if run:
            yield run

    def number(urn: str | None):
        tail = urn[len("<urn:page:") : -1] if urn else "none"
        return None if tail == "none" else int(tail)

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(path)
        name, file = None, None
        for part in ranges(batches):
            if part[0]["archive"] != name:
                if file:
                    file.close()
                name = part[0]["archive"]
                file = fs.open_input_file(f"{root}/{name}")
            start = part[0]["offset"]
            data = memoryview(file.read_at(part[-1]["offset"] + part[-1]["length"] - start, start))
            rows = []
            for r in part:
                raw = gzip.GzipFile(fileobj=io.BytesIO(data[r["offset"] - start : r["offset"] - start + r["length"]])).read()
                head, block = parse(raw)
                digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                if digest != r["payload_digest"] or head["WARC-Type"] == "response" and base64.b32encode(hashlib.sha1(block).digest()).decode() != digest:
                    raise ValueError(f"digest mismatch in {name} at {r['offset']}")
                rows.append({"page_id": number(head["WARC-Record-ID"]), "url": head.get("WARC-Target-URI"), "record_type": head["WARC-Type"], "payload_bytes": int(head["X-Payload-Length"]), "payload_digest": digest, "refers_to": number(head.get("WARC-Refers-To")), "block": block})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
        if file:
            file.close()

    return rows.mapInArrow(run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, block binary")


def op4_warc(spark, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    path = shared_path(spark, "warc")
    index = write_archives(classify(table(spark, sf_dir, "pages")), path)
    return read_records(index, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_DIGIT = " || ".join(
    f"substr('{ALPHABET}', CAST((CAST('0x' || substr(hex, {10 * k + 1}, 10) AS BIGINT) >> {35 - 5 * j}) & 31 AS INTEGER) + 1, 1)" for k in range(4) for j in range(8)
)
OP4_SQL = f"""
WITH p AS (SELECT page_id, sha1(encode(coalesce(html, ''))) AS hex, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
f AS (SELECT hex, min(page_id) AS first_id FROM p GROUP BY hex)
SELECT page_id, payload_bytes, {_DIGIT} AS payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN NULL ELSE first_id END AS refers_to
FROM p JOIN f USING (hex)
"""
