"""WARC: a deterministic sharded writer with manifests, and a reader."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.llm.common import range_bounds, saved, shard_of

#: Payloads of at least so many bytes are stored once.
REVISIT_BYTES = 1000
#: A file is closed by the first record that takes it to this many compressed bytes or over.
ROLL_BYTES = 16 << 20
#: Payload bytes for each range of ids, a task's work: several files, as web pages shrink to a third or a quarter.
SHARD_BYTES = 256 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122's name space for URLs (fixed value)


def b32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record(page_id: int | None, copy: int, uri: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """One WARC/1.1 record as a gzip member without time stamp: the same input always gives the same bytes.

    A revisit holds the HTTP header alone, with the length of the payload that its response record holds, which is the
    first copy of the payload under the page it refers to.
    """
    digest = hashlib.sha1(payload).digest()
    name = lambda i: "" if i is None else str(i)
    urn = lambda i, n: f"<urn:uuid:{uuid.uuid5(_SPACE, f'{name(i)}/{n}/{digest.hex()}')}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {urn(page_id, copy)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {' '.join((uri or '').split())}",
        f"WARC-Block-Digest: {b32(hashlib.sha1(block).digest())}",
        f"WARC-Payload-Digest: {b32(digest)}",
        f"X-Page-ID: {name(page_id)}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {urn(refers_to, 1)}", f"X-Refers-To-Page-ID: {name(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of each record of a file's bytes, one record in memory at a time; block digests are verified."""
    inflate, held = zlib.decompressobj(31), []
    for chunk in chunks:
        while chunk:
            held.append(inflate.decompress(chunk))
            chunk = inflate.unused_data
            if inflate.eof:
                header, _, rest = b"".join(held).partition(b"\r\n\r\n")
                named = dict(x.split(": ", 1) for x in header.decode().split("\r\n")[1:])
                block = rest[: int(named["Content-Length"])]
                if b32(hashlib.sha1(block).digest()) != named["WARC-Block-Digest"]:
                    raise ValueError(f"record {named['WARC-Record-ID']} is damaged")
                yield named, block
                inflate, held = zlib.decompressobj(31), []
    if any(held):
        raise ValueError("the file ends within a record")


def roles(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, digest, refers_to) of each row whose payload a row with a larger page_id holds too, of `least` bytes or more."""
    rows = pages.where(F.octet_length("html") >= least).select("page_id", F.unhex(F.sha1(F.encode("html", "utf-8"))).alias("digest"))
    tops = rows.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    return rows.join(tops.drop("n"), "digest").where("not (page_id <=> refers_to)").select("page_id", "digest", "refers_to")


def write(pages: DataFrame, path: str, least: int = REVISIT_BYTES, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) under path, a URI of a shared store; returns the manifest.

    Rows are dealt into ranges of page_id whose bounds depend on the rows alone, and sorted within; a row that tells of
    an equal payload elsewhere sorts just before the page it is about, so payloads are shuffled once. Each task
    writes its range to files with a temporary name of its own and returns (file, temporary, bytes, records, sha1); the
    manifest keeps only what successful tasks returned, and a second job renames those files. A task that is
    lost leaves only temporary files that no manifest names, and renaming may be repeated.

    Null html is an empty payload, null ids sort first. Of equal payloads of `least` bytes or more, the one with the
    largest page_id is the response and the others are revisits; of rows with the same id and payload, the first is.
    Rows without an id, or of one id, are written by one task, which streams them. No rows give no files. Other columns
    aren't read.
    """
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    total = base.agg(F.count("*"), F.sum(F.octet_length("html"))).first()
    shards = max(1, -(-(total[1] or 0) // shard_bytes), min(total[0] // 1000, 32))
    bounds = range_bounds(base, "page_id", shards, total[0])
    full = base.select("page_id", F.lit(1).alias("kind"), "url", F.encode("html", "utf-8").alias("html"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("bigint").alias("refers_to"))
    told = roles(base, least).select("page_id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("html"), "digest", "refers_to").distinct()
    dealt = full.union(told).withColumn("shard", shard_of(F.col("page_id"), bounds)).repartitionById(len(bounds) + 1, F.col("shard"))
    ordered = dealt.sortWithinPartitions("shard", "page_id", "kind", F.sha1("html"), "url")

    def run(batches):
        store, root = fs.FileSystem.from_uri(path)
        out = name = here = None
        done, of, refer, held, parts, size, count, whole = [], None, {}, {}, 0, 0, 0, None

        def close():
            out.close()
            done.append((name, here, size, count, whole.hexdigest()))

        for batch in batches:
            for row in (r for i in range(0, batch.num_rows, 64) for r in batch.slice(i, 64).to_pylist()):
                if of != (row["page_id"],):
                    of, refer, held = (row["page_id"],), {}, {}
                if row["kind"] == 0:
                    refer[row["digest"]] = row["refers_to"]
                    continue
                payload = row["html"]
                key = hashlib.sha1(payload).digest()
                copy = held[key] = held.get(key, 0) + 1
                again = len(payload) >= least and (key in refer or copy > 1)
                member = record(row["page_id"], copy, row["url"], payload, refer.get(key, row["page_id"]) if again else None, again)
                if out is None:
                    name = f"part-{row['shard']:06d}-{parts:04d}.warc.gz"
                    here = f"_temporary/{uuid.uuid4().hex}-{name}"
                    store.create_dir(f"{root}/_temporary", recursive=True)
                    out, size, count, whole = store.open_output_stream(f"{root}/{here}", compression=None), 0, 0, hashlib.sha1()
                    parts += 1
                out.write(member)
                whole.update(member)
                size, count = size + len(member), count + 1
                if size >= roll_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.record_batch([pa.array(x, t) for x, t in zip(list(zip(*done, strict=True)) or [[]] * 5, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["file", "temporary", "bytes", "records", "sha1"])

    manifest = saved(ordered.mapInArrow(run, "file string, temporary string, bytes long, records long, sha1 string"), "manifest")

    def commit(batches):
        store, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for row in batch.to_pylist():
                there = store.get_file_info(f"{root}/{row['file']}")
                if there.type == fs.FileType.NotFound or there.size != row["bytes"]:
                    store.move(f"{root}/{row['temporary']}", f"{root}/{row['file']}")
            yield batch

    committed = manifest.repartition(spread(manifest), "file").mapInArrow(commit, manifest.schema)
    committed.write.parquet(f"{path}/_manifest")
    return pages.sparkSession.read.schema(manifest.schema).parquet(f"{path}/_manifest")


def spread(files: DataFrame, most: int = 4096) -> int:
    """How many tasks to deal files out to: a stated number, as adaptive execution would join such short rows into one task."""
    return max(1, min(most, files.count()))


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload of each record that path's manifest names.

    Block digests and, where the payload is there, payload digests are verified; a revisit's payload is null. A task reads
    whole files, one record in memory at a time.
    """
    files = spark.read.parquet(f"{path}/_manifest").select("file", "records")

    def run(batches):
        store, root = fs.FileSystem.from_uri(path)
        for name, expected in ((r["file"], r["records"]) for b in batches for r in b.to_pylist()):
            rows, weight, count = [], 0, 0
            with store.open_input_stream(f"{root}/{name}", compression=None) as file:
                for named, block in records(iter(lambda: file.read(1 << 20), b"")):
                    head, _, body = block.partition(b"\r\n\r\n")
                    size = int(head.rpartition(b"Content-Length: ")[2])
                    digest = base64.b32decode(named["WARC-Payload-Digest"].removeprefix("sha1:"))
                    revisit = named["WARC-Type"] == "revisit"
                    if not revisit and (len(body) != size or hashlib.sha1(body).digest() != digest):
                        raise ValueError(f"the payload of {named['WARC-Record-ID']} is damaged")
                    number = lambda key: int(named[key]) if named.get(key) else None  # noqa: B023, E731
                    rows.append((number("X-Page-ID"), named["WARC-Target-URI"], size, digest.hex(), named["WARC-Type"], number("X-Refers-To-Page-ID"), None if revisit else body))
                    weight, count = weight + len(block), count + 1
                    if weight > 8 << 20:
                        yield batch_of(rows)
                        rows, weight = [], 0
            if count != expected:
                raise ValueError(f"{name} holds {count} records, its manifest says {expected}")
            yield batch_of(rows)

    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")

    def batch_of(rows):
        return pa.record_batch([pa.array(x, t) for x, t in zip(list(zip(*rows, strict=True)) or [[]] * 7, kinds, strict=True)], names)

    return files.repartition(spread(files), "file").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


#: What the query returns of pages with distinct ids, in SQL.
WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS size FROM pages),
top AS (SELECT html, max(page_id) AS top FROM p WHERE size >= {REVISIT_BYTES} GROUP BY html)
SELECT p.page_id, p.size AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN t.top <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN t.top <> p.page_id THEN t.top END AS refers_to
FROM p LEFT JOIN top t ON t.html = p.html
"""
