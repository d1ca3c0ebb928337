"""WARC archives with a two-level capture index.

Captures are written as gzip members, a record each. The index is sorted by reversed-host URL keys and
stored as compressed blocks of lines; each index file has a sparse directory of its blocks (first key,
offset, length), and a table lists the index files by first key. A look-up bisects the list, then one
directory, reads one block's range and bisects its lines, and reads the record's range.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import groups_by_file, parts, shared_dir, staged

#: Bytes of an archive file after which the next begins, and lines of an index block.
FILE, BLOCK = 64 << 20, 3000
#: The profile of revisit records that name an identical payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def opened(uri: str):
    """File system and path of a URI that executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def url_key(url: str | None) -> str:
    """Reversed-host key: com,example,www)/path?query, lower-case host, without scheme, port and user."""
    try:
        u = urlsplit(url or "")
        host = (u.hostname or "").lower()
    except ValueError:
        return ")" + (url or "")
    return ",".join(reversed(host.split("."))) + ")" + (u.path or "/") + (f"?{u.query}" if u.query else "")


def record_id(page_id: int | None, digest: str) -> str:
    """The id that a revisit can compute of the response it refers to; repeated rows of one page share it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; a revisit (refers_to given) has no payload of its own."""
    revisit = refers_to is not None
    block = HTTP if revisit else HTTP + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {''.join((url or '').splitlines())}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def zipped(data: bytes) -> bytes:
    z = zlib.compressobj(1, wbits=31)
    return z.compress(data) + z.flush()


def sha1_base32(hex_: Column) -> Column:
    """Base32 of 40 hex digits: eight groups of five bytes, eight digits each."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    out = []
    for g in range(4):
        n = F.conv(F.substring(hex_, 10 * g + 1, 10), 16, 10).cast("long")
        out += [F.substring(F.lit(alphabet), F.shiftright(n, 35 - 5 * k).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for k in range(8)]
    return F.concat(*out)


def write(pages: DataFrame, least: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> str:
    """Writes archive and index of all rows to a new folder in the shared one; returns the folder.

    Of the rows with equal payloads of at least `least` bytes that with the largest key is a response and
    the others revisit it; smaller payloads are all responses. A null payload is empty, a null URL an empty
    string; rows with the key of the largest are responses as well, so repeated rows do not refer to
    themselves. Payloads are shuffled once; digests alone decide. A task that is run again writes new files,
    and only the files of the attempt that succeeded are in the index.
    """
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", sha1_base32(F.sha1(F.col("html").cast("binary"))))
    seen = staged(rows.where(F.octet_length("html") >= least).select("page_id", "digest"), "warc-seen")
    top = seen.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    again = seen.join(top, "digest").where("page_id is null or page_id < refers_to").select("page_id", "digest", "refers_to").distinct()
    again = staged(again, "warc-revisit")
    made = rows.join(again.withColumnsRenamed({"page_id": "p", "digest": "d"}), F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")
    # what revisits carries no payload any further
    made = made.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "digest", "refers_to")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = opened(folder)
        fs.create_dir(at, recursive=True)
        name, out, offset = "", None, 0
        for b in batches:
            lines = []
            for p, u, h, d, r in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if out is None or offset >= FILE:
                    if out is not None:
                        out.close()
                    name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{at}/{name}", compression=None)
                raw = zipped(record(p, u, (h or "").encode(), d, r))
                out.write(raw)
                lines.append((url_key(u), p, name, offset, len(raw)))
                offset += len(raw)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*lines, strict=True) if lines else [[]] * 5, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)],
                names=["key", "page_id", "file", "offset", "length"],
            )
        if out is not None:
            out.close()

    entries = staged(made.mapInArrow(save, "key string, page_id long, file string, offset long, length long"), "warc-entry")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = opened(folder)
        name, out, offset, held, directory, end = f"{uuid.uuid4().hex}.cdx.gz", None, 0, [], [], ""

        def block() -> None:
            nonlocal out, offset, held, end
            if out is None:
                out = fs.open_output_stream(f"{at}/{name}", compression=None)
            raw = zipped("".join(json.dumps(x, ensure_ascii=False) + "\n" for x in held).encode())
            out.write(raw)
            directory.append([held[0][0], offset, len(raw), len(held)])
            offset += len(raw)
            held, end = [], held[-1][0]

        for b in batches:
            for x in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                held.append(x)
                if len(held) >= BLOCK:
                    block()
        if held:
            block()
        if out is not None:
            out.close()
            with fs.open_output_stream(f"{at}/{name}.dir") as f:
                f.write(json.dumps(directory, ensure_ascii=False).encode())
            yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([end]), pa.array([name]), pa.array([len(directory)], pa.int32())], names=["first", "last", "file", "blocks"])

    ranged = entries.repartitionByRange(parts(spark), "key", "page_id").sortWithinPartitions("key", "page_id")
    ranged.mapInArrow(index, "first string, last string, file string, blocks int").write.parquet(f"{folder}/index")
    return folder


def blocks_of(fs, at: str, name: str) -> list[list]:
    with fs.open_input_file(f"{at}/{name}.dir") as f:
        return json.loads(f.read())


def lines_of(fs, at: str, name: str, offset: int, length: int) -> list[list]:
    with fs.open_input_file(f"{at}/{name}") as f:
        raw = f.read_at(length, offset)
    return [json.loads(x) for x in zlib.decompress(raw, 31).decode().split("\n") if x]


def listing(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """First keys and names of the index files, a row each, in the order of their keys: of equal first keys by the last."""
    rows = sorted((r["first"], r["last"], r["file"]) for r in spark.read.parquet(f"{folder}/index").collect())
    return [(first, file) for first, _, file in rows]


def lookup(spark: SparkSession, folder: str, url: str) -> list[tuple[dict[str, str], bytes]]:
    """Headers and payload of every capture of a URL, by the two levels of the index and range reads."""
    fs, at = opened(folder)
    files = listing(spark, folder)
    key, found = url_key(url), []
    first = max(0, bisect.bisect_left([f[0] for f in files], key) - 1)
    for start, name in files[first:]:
        if start > key:
            break
        directory = blocks_of(fs, at, name)
        for _, offset, length, _ in directory[max(0, bisect.bisect_left([d[0] for d in directory], key) - 1) : bisect.bisect_right([d[0] for d in directory], key)]:
            lines = lines_of(fs, at, name, offset, length)
            ks = [x[0] for x in lines]
            for x in lines[bisect.bisect_left(ks, key) : bisect.bisect_right(ks, key)]:
                with fs.open_input_file(f"{at}/{x[2]}") as f:
                    found.append(parsed(zlib.decompress(f.read_at(x[4], x[3]), 31)))
    return found


def looked_up(spark: SparkSession, folder: str, urls: DataFrame) -> DataFrame:
    """(file, offset, length) of every capture of each URL in the one column of urls, by the two levels of the index.

    Distinct keys are sorted; a task bisects the list of index files (a row a file, so as many as a write has
    partitions) and their sparse directories, and names the blocks that hold a key. Blocks are then dealt out,
    so that the captures of one frequent URL are read in many tasks, and keys bisected in the lines of each.
    """
    name = urls.columns[0]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in b.column(0).to_pylist()], pa.string())], names=["key"])

    wanted = urls.select(F.coalesce(F.col(name).cast("string"), F.lit("")).alias("url")).distinct().mapInArrow(keys, "key string").distinct()
    listed = listing(spark, folder)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = opened(folder)
        firsts = [f for f, _ in listed]
        held: dict[str, list[list]] = {}
        for b in batches:
            out = []
            for key in b.column(0).to_pylist():
                for first, file in listed[max(0, bisect.bisect_left(firsts, key) - 1) :]:
                    if first > key:
                        break
                    if file not in held:
                        if len(held) > 1:  # keys come in order: at most two directories are needed at a time
                            del held[next(iter(held))]
                        held[file] = blocks_of(fs, at, file)
                    directory = held[file]
                    low = max(0, bisect.bisect_left(directory, key, key=lambda d: d[0]) - 1)
                    for _, offset, length, _ in directory[low : bisect.bisect_right(directory, key, key=lambda d: d[0])]:
                        out.append((file, offset, length, key))
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["file", "offset", "length", "key"])

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = opened(folder)
        block, held, ks = None, [], []
        for b in batches:
            out = []
            for file, offset, length, key in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (file, offset) != block:
                    block, held = (file, offset), lines_of(fs, at, file, offset, length)
                    ks = [x[0] for x in held]
                out += [x[2:] for x in held[bisect.bisect_left(ks, key) : bisect.bisect_right(ks, key)]]
            columns = zip(*out, strict=True) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["file", "offset", "length"])

    n = parts(spark)
    named = wanted.repartitionByRange(n, "key").sortWithinPartitions("key").mapInArrow(blocks, "file string, offset long, length long, key string")
    dealt = named.repartition(n, "file", "offset").sortWithinPartitions("file", "offset", "key")
    return dealt.mapInArrow(lines, "file string, offset long, length long")


def read(spark: SparkSession, folder: str, urls: DataFrame) -> DataFrame:
    """(page_id, url, record_type, payload_digest, html, refers_to) of every capture of the URLs.

    A revisit's html is null; payload_digest is computed anew from a response's payload, and is the header
    of a revisit. Places come from the index and are regrouped by archive file; neighbours are read as one range.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = opened(folder)
        for name, offsets, lengths in groups_by_file(batches):
            with fs.open_input_file(f"{at}/{name}") as f:
                out = []
                for lo, whole, part in joined(offsets, lengths):
                    raw = f.read_at(whole, lo)
                    for o, n in part:
                        h, payload = parsed(zlib.decompress(raw[o - lo : o - lo + n], 31))
                        old = h["WARC-Type"] == "revisit"
                        digest = h["WARC-Payload-Digest"].split(":")[1] if old else base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        to = int(h["X-Refers-To-Page-ID"]) if old else None
                        out.append((int(h["X-Page-ID"]) if h["X-Page-ID"] else None, h["WARC-Target-URI"], h["WARC-Type"], digest, None if old else payload.decode(), to))
                kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["page_id", "url", "record_type", "payload_digest", "html", "refers_to"])

    there = looked_up(spark, folder, urls)
    # an archive file is read in stretches of 4 MB, so that a large one is spread over tasks
    there = there.withColumn("stretch", F.floor(F.col("offset") / (4 << 20)))
    dealt = there.repartition(parts(spark), "file", "stretch").sortWithinPartitions("file", "offset").select("file", "offset", "length")
    return dealt.mapInArrow(records, "page_id long, url string, record_type string, payload_digest string, html string, refers_to long")


def joined(offsets: list[int], lengths: list[int], most: int = 8 << 20, gap: int = 4096) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Sorted ranges joined where they follow one another but for a small gap: offset, length and the ranges within."""
    at = 0
    for e in range(1, len(offsets) + 1):
        if e == len(offsets) or offsets[e] - offsets[e - 1] - lengths[e - 1] > gap or offsets[e] + lengths[e] - offsets[at] > most:
            yield offsets[at], offsets[e - 1] + lengths[e - 1] - offsets[at], list(zip(offsets[at:e], lengths[at:e], strict=True))
            at = e


def op8_warc(spark, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read back from the archives."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder = write(pages, least=0)
    back = read(spark, folder, pages.select("url")).select("page_id", F.octet_length("html").cast("long").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    back = staged(back, "warc-read")
    whole = back.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("size"))
    out = back.join(whole, "payload_digest")
    return out.select("page_id", F.coalesce("payload_bytes", "size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
