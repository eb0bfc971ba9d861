"""WARC archives with a two-level capture index.

Each task writes its records, one gzip member each, to a file of its own in the shared folder and returns where
they lie. Index lines are sorted by reversed-host URL key and packed into compressed blocks; a sparse directory
holds the first key of each block. A look-up finds blocks by binary search in the directory, reads them by
range, and then reads the records by range.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROWS_PER_FILE, broadcast_within, shared_dir, staged

BLOCK_LINES = 256
MAX_BLOCKS = 500_000
MAX_BROADCAST_ROWS = 200_000
READS_PER_TASK = 5_000
DATE = "1970-01-01T00:00:00Z"
CAPTURE = "key string, page_id long, file string, offset long, length long"


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query: com,example,blog)/path?query. Without a host the text itself."""
    try:
        parts = urlsplit(url or "")
        host = parts.hostname
    except ValueError:
        host = None
    if not host:
        return f"-){url or ''}"
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def gzip_member(data: bytes, level: int = 3) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def header_text(value: object) -> str:
    return str(value).replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record with its payload, or a revisit record that names the response."""
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {header_text(url or '')}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}",
    ]
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if refers_to is None:
        body += payload
    else:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    body = rest[: int(headers["Content-Length"])]
    return headers, body.partition(b"\r\n\r\n")[2]


def page_number(name: str) -> int | None:
    digits = name.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@dataclass
class Archive:
    folder: str
    directory: DataFrame  # first, file, offset, length of each index block
    captures: int


def responses(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, payload) with refers_to: null for responses."""
    sized = pages.withColumn("sha", F.sha1("payload"))
    narrow = sized.where(F.octet_length("payload") >= min_bytes).select("page_id", "sha")
    first = narrow.groupBy("sha").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").drop("n")
    repeated = narrow.join(first, "sha").where("page_id != response OR (page_id IS NULL AND response IS NOT NULL)").distinct()
    repeated = staged(repeated, "warc-repeated", pages.count())
    same = sized["page_id"].eqNullSafe(repeated["page_id"]) & (sized["sha"] == repeated["sha"])
    return sized.join(broadcast_within(repeated, MAX_BROADCAST_ROWS), same, "left").select(sized["page_id"], "url", "payload", F.col("response").alias("refers_to"))


def write_archive(pages: DataFrame, min_bytes: int = 0) -> Archive:
    """Write pages (page_id, url, html) and their index; null html is an empty payload."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8").alias("payload"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        name, out, offset = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                rows = []
                for row in batch.slice(a, 256).to_pylist():
                    out = out or store.open_output_stream(f"{path}/{name}", compression=None)
                    data = gzip_member(record(row["page_id"], row["url"], row["payload"], digest_of(row["payload"]), row["refers_to"]))
                    out.write(data)
                    rows.append({"key": url_key(row["url"]), "page_id": row["page_id"], "file": name, "offset": offset, "length": len(data)})
                    offset += len(data)
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
        if out:
            out.close()

    captures = staged(responses(own, min_bytes).mapInArrow(write, CAPTURE), "warc-captures")
    total = captures.count()
    lines = max(BLOCK_LINES, -(-total // MAX_BLOCKS))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        name, out, offset, held = f"{uuid.uuid4().hex}.idx", None, 0, []
        kind = pa.schema([("first", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

        def flush(n: int) -> list[dict]:
            nonlocal out, offset, held
            done = []
            while len(held) >= n and held:
                part, held = held[:lines], held[lines:]
                out = out or store.open_output_stream(f"{path}/{name}", compression=None)
                data = zlib.compress("\n".join(json.dumps([r["key"], r["page_id"], r["file"], r["offset"], r["length"]]) for r in part).encode(), 6)
                out.write(data)
                done.append({"first": part[0]["key"], "file": name, "offset": offset, "length": len(data)})
                offset += len(data)
            return done

        for batch in batches:
            held += batch.to_pylist()
            yield pa.RecordBatch.from_pylist(flush(lines), kind)
        yield pa.RecordBatch.from_pylist(flush(1), kind)
        if out:
            out.close()

    dealt = captures.repartitionByRange(max(1, -(-total // ROWS_PER_FILE)), "key", "page_id").sortWithinPartitions("key", "page_id")
    directory = staged(dealt.mapInArrow(index, "first string, file string, offset long, length long"), "warc-directory")
    return Archive(folder, directory, total)


def look_up(archive: Archive, keys: DataFrame) -> DataFrame:
    """Records of distinct URL keys (column key): page_id, payload, payload_bytes, payload_digest, record_type, refers_to."""
    spark, folder = keys.sparkSession, archive.folder
    rows = sorted((r["first"], r["file"], r["offset"], r["length"]) for r in archive.directory.collect())  # at most MAX_BLOCKS
    blocks = spark.sparkContext.broadcast(rows)
    per_task = max(1, READS_PER_TASK * len(rows) // max(1, archive.captures))  # blocks; a key of many captures lies in many

    def packed(pairs: list[tuple[str, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in pairs], pa.string()), pa.array([b for _, b in pairs], pa.int32())], names=["key", "block"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = [b[0] for b in blocks.value]
        for batch in batches:
            pairs: list[tuple[str, int]] = []
            for key in batch.column(0).to_pylist():
                for block in range(max(0, bisect_left(firsts, key) - 1), bisect_right(firsts, key)):
                    pairs.append((key, block))
                    if len(pairs) == 10_000:
                        yield packed(pairs)
                        pairs = []
            yield packed(pairs)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        table, files, cached = blocks.value, {}, {}
        kind = pa.schema([("page_id", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

        def span(name: str, offset: int, length: int) -> bytes:
            if name not in files:
                if len(files) > 200:
                    files.popitem()[1].close()
                files[name] = store.open_input_file(f"{path}/{name}")
            return files[name].read_at(length, offset)

        def entries(block: int) -> list:
            if block not in cached:
                if len(cached) > 8:
                    cached.clear()
                _, name, offset, length = table[block]
                cached[block] = [json.loads(line) for line in zlib.decompress(span(name, offset, length)).decode().split("\n")]
            return cached[block]

        for batch in batches:
            wanted = []
            for key, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lines = entries(block)
                low = bisect_left(lines, key, key=lambda x: x[0])
                wanted += lines[low : bisect_right(lines, key, key=lambda x: x[0])]
            wanted.sort(key=lambda x: (x[2], x[3]))
            for a in range(0, len(wanted), 64):
                out = []
                for _, page_id, name, offset, length in wanted[a : a + 64]:
                    headers, payload = parse(zlib.decompress(span(name, offset, length), 31))
                    told, kind_of = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
                    if kind_of == "response" and (digest_of(payload) != told or len(payload) != int(headers["X-Payload-Length"])):
                        raise ValueError(f"record of page {page_id} in {name} at {offset} is damaged")
                    refers = headers.get("WARC-Refers-To")
                    out.append({"page_id": page_id, "payload": payload if kind_of == "response" else None, "payload_bytes": int(headers["X-Payload-Length"]), "payload_digest": told, "record_type": kind_of, "refers_to": page_number(refers) if refers else None})
                yield pa.RecordBatch.from_pylist(out, kind)
        for f in files.values():
            f.close()

    sought = keys.mapInArrow(find, "key string, block int")
    sought = sought.repartitionById(max(1, -(-len(rows) // per_task)), F.floor(F.col("block") / per_task).cast("int")).sortWithinPartitions("block", "key")
    return sought.mapInArrow(read, "page_id long, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def url_keys(pages: DataFrame) -> DataFrame:
    """Distinct URL keys of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted({url_key(u) for u in batch.column(0).to_pylist()}), pa.string())], names=["key"])

    return pages.select(F.col("url").cast("string").alias("url")).mapInArrow(run, "key string").distinct()


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all of pages, then find and read every record through the index.

    Of records with equal payloads of at least min_bytes, the one of the largest page_id is the response. Null
    URLs have a key of their own; rows that repeat a page are written and read as often; an empty table gives none.
    """
    archive = write_archive(pages, min_bytes)
    return look_up(archive, url_keys(pages))
